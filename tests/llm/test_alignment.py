import hashlib
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import awkward, stored
from tokenizers import Tokenizer

from claimsweep.llm import alignment
from claimsweep.llm.queries import QUERIES
from claimsweep.llm.tokens import byte_letters

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["a  b\n\n c\td \n e\x1c f <|endoftext|> <s>x ", "x▁y", " ", "\n", "  \n ", "ÿ　z \n日本  語", "a\r\n b\x0b\x0c c 's 'll I'm\t\t x  ",
       "\x00 \x85 q", "▁", "tail \n", "don't won't\u2028x\u00a0 y", "🙂🙂 é́"]


def plain(texts):
    """The definition, text by text, with the libraries' encodings of whole texts."""
    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    letters = byte_letters()

    def bytes_of(piece, i):
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        pieces = b.encode(text) if text else []
        spelled_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids]
        spelled_b = [bytes_of(b.id_to_piece(i), i) for i in pieces]
        if not text or b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            found.append(([], [], []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, spelled_a))).tolist(), np.cumsum(list(map(len, spelled_b))).tolist()
        at_a, at_b = {e: i for i, e in enumerate(ends_a)}, {e: i for i, e in enumerate(ends_b)}
        found.append((ids, pieces, [(at_a[e], at_b[e]) for e in ends_a if e in at_b]))
    counts = Counter((ids[i], pieces[j]) for ids, pieces, links in found for i, j in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for ids, pieces, links in found:
        pairs = [(ids[i], pieces[j]) for i, j in links]
        groups, x, y = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, ids[x:i + 1])) + "|" + ",".join(map(str, pieces[y:j + 1])))
            x, y = i + 1, j + 1
        text = ";".join(groups)
        out.append((len(ids), len(pieces), len(links), len(links), sum(counts[p] == best[p[1]] for p in pairs),
                    sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, counts, best


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def test_query_against_whole_texts(spark, tmp_path):
    rows = awkward() + [(500 + i, t, "a") for i, t in enumerate(ODD)]
    stored(spark, rows, tmp_path / "documents.parquet")
    got = ordered(map(tuple, QUERIES["op13_alignment"](spark, str(tmp_path)).collect()))
    expected, counts, best = plain([t for _, t, *_ in rows])
    assert got == ordered((r[0], *e) for r, e in zip(rows, expected))
    table = alignment.pair_table(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
    assert {(r["a_id"], r["b_id"]): r["n"] for r in table} == counts
    assert all(r["best"] == (r["n"] == best[r["b_id"]]) for r in table)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = ordered(map(tuple, QUERIES["op13_alignment"](spark, "/root/testdata/sf0.001").collect()))
    assert got == ordered((i, *e) for (i, _), e in zip(rows, plain([t for _, t in rows])[0]))


def test_empty_table(spark, tmp_path):
    empty = stored(spark, [], tmp_path / "d")
    assert alignment.align(empty).collect() == []
    assert alignment.pair_table(empty).collect() == []
    assert alignment.align(stored(spark, [(1, None), (2, "")], tmp_path / "e")).count() == 2


def test_units_are_forgotten_in_between(spark, tmp_path, monkeypatch):
    rows = awkward(3)
    files = [open(public_tokenizers.path(p), "rb").read() for p in (A, B)]
    units, small = alignment.Units(alignment.Encoders(*files)), alignment.Units(alignment.Encoders(*files))
    monkeypatch.setattr(alignment, "CACHED", 5)
    monkeypatch.setattr(alignment, "CHUNK", 40)
    for _, text, *_ in rows:
        if text:
            split = units.encoders.units(" " + text)
            assert "".join(split) == " " + text
            x, y = units.numbers([split])[0], small.numbers([split])[0]
            assert np.frombuffer(units.n_b, np.int64)[x].sum() == np.frombuffer(small.n_b, np.int64)[y].sum()
            small.trim()


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 60000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 62, n))
    h = alignment.MinimalHash(keys)
    assert sorted(h(keys)) == list(range(len(keys)))
    other = np.setdiff1d(rng.integers(0, 1 << 62, 3000), keys)
    assert (h(other) == -1).all()


def test_pairs_have_a_bound_of_the_vocabularies():
    e = alignment.Encoders(*[open(public_tokenizers.path(p), "rb").read() for p in (A, B)])
    assert e.most_pairs() < 600_000
    short = alignment.Encoders.most_pairs
    tiny = type("E", (), {"a_bytes": [b"a", b"ba", b""], "b_bytes": [b"a", b"cba", b"a"]})()
    # a-a twice (two ids of B), ba-a twice, a-cba, ba-cba
    assert short(tiny) >= 6


def test_time_is_linear_in_the_length_of_a_text():
    e = alignment.Encoders(*[open(public_tokenizers.path(p), "rb").read() for p in (A, B)])
    rng = np.random.default_rng(0)
    word = ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(60000)]
    took = []
    for n in (30000, 60000):
        text, started = " " + " ".join(word[:n]), time.process_time()
        units = alignment.Units(e)
        units.numbers([e.units(text)])
        took.append(time.process_time() - started)
    assert took[1] < 4 * took[0] + 0.5
