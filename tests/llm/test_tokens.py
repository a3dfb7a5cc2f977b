import itertools
import random

import public_tokenizers
import pytest
from helpers import awkward, stored
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimsweep.llm import pieces, tokens

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(BPE))


@pytest.fixture(scope="module")
def counter():
    with open(public_tokenizers.path(BPE), "rb") as f:
        return tokens.ByteCounter(f.read())


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path(PIECES), "rb") as f:
        return pieces.PieceModel(f.read())


def test_counts_equal_the_library(counter, library):
    r, letters = random.Random(0), "ab eE\n\t'sé!ß日1२  ?\x1c\x85￿😀"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(2000)]
    texts += [t[:7] + "<|endoftext|>" + t[7:] for t in texts[:200]] + ["a" * 20000, "the " * 5000, " " * 3000, "<|endoftext|>" * 3]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == expected


def test_every_character(counter, library):
    texts = [f"a{chr(c)}b {chr(c)}1" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_count_query(spark, tmp_path, library):
    rows = awkward()
    got = tokens.count_tokens(stored(spark, rows, tmp_path / "d"), limit=50).collect()
    expected = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t, *_ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert tokens.count_tokens(stored(spark, [], tmp_path / "e")).count() == 0


def all_segmentations(model, text):
    z, out = model.normalize(text), []

    def go(at, score, ids):
        if at == len(z):
            out.append((score, ids))
            return
        for end in range(at + 1, len(z) + 1):
            found = model.pieces.get(z[at:end])
            if found:
                go(end, score + found[1], ids + (found[0],))
            elif end == at + 1:
                go(end, score + model.unknown_score, ids + tuple(model.bytes[b] for b in z[at:end].encode()))

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["", " ", "a", "hello the", "a b c", "the  oo", "x2². e1,b", "日本 x", "a\n\n b", "it's.com", "to,to\nto", "\x00ererer", "▁ a", "to, a. é!"])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_n_best_against_all_segmentations(model, text, n):
    every = all_segmentations(model, text)
    ids, score, others = model.encode(text, n)
    assert [score] + [o["score"] for o in others] == [s for s, _ in every[:n]]
    scores = {ids: s for s, ids in every}
    assert scores[tuple(ids.tolist())] == score
    seen = {tuple(ids.tolist())}
    for other in others:
        changed = ids.tolist()
        for c in reversed(other["changes"]):
            changed[c["first"]:c["last"] + 1] = c["ids"]
        assert scores[tuple(changed)] == other["score"]
        seen.add(tuple(changed))
    assert len(seen) == 1 + len(others)


def test_segments_are_cut_where_no_piece_crosses(model):
    for pieces_, text in ((["a", "b▁a"], "a▁b"), (["a.b"], "a.b\n▁c"), (["\n"], "a\n▁b")):
        cuts = pieces.segment_pattern(*pieces.cut_rules(pieces_)).findall(text)
        assert "".join(cuts) == text
        for piece in pieces_:
            for at in range(len(text)):
                if text.startswith(piece, at):
                    ends = list(itertools.accumulate(map(len, cuts)))
                    assert not any(at < e < at + len(piece) for e in ends)


def test_encode_and_decode_columns(spark, tmp_path, model):
    rows = awkward()
    docs = stored(spark, rows, tmp_path / "d")
    out = pieces.encode_documents(docs)
    assert out.where("not round_trip").count() == 0 and out.count() == len(rows)
    back = out.withColumn("back", pieces.decode(spark, F.col("ids"))).select("doc_id", "back").collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((i, t or "")) for i, t, *_ in rows)
    for r in out.where("doc_id = 106").collect():
        assert r["ids"] == model.encode(rows[[x[0] for x in rows].index(106)][1], 1)[0].tolist()
    assert pieces.encode_documents(stored(spark, [], tmp_path / "e")).count() == 0
