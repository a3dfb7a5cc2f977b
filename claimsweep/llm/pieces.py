"""SentencePiece encoding and decoding over the piece lattice, with the n best segmentations.

The forward pass finds for each place the best score of what lies before it. Those scores are exact
heuristics for a search from the end: A-star meets the segmentations in the order of their scores.
Pieces hold the blank mark only at their start, so a text falls into segments that no piece crosses:
each different segment is solved once, and the n best of a text combine those of its segments.
"""

from __future__ import annotations

from array import array
from heapq import heappop, heappush, nsmallest

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship
from .vocab import Cache, parsed, vocabulary

MARK = "▁"
#: Words remembered in a worker, and the longest of them.
CACHED, LONGEST = 400_000, 64
#: Signs that often end a word.
CLOSING = frozenset(".,;:!?|)]}\"'")
#: How far below the worst piece a character without a piece of its own scores, as the library has it.
UNKNOWN_PENALTY = 10.0

ENCODED = ("ids array<int>, score double, others array<struct<score: double, changes: array<struct<"
           "first: int, last: int, ids: array<int>>>>>, round_trip boolean")
OTHERS = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([
    ("first", pa.int32()), ("last", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
#: Documents whose piece ids a worker holds at once.
ROWS = 200


def cut_rules(pieces) -> tuple[bool, bool]:
    """Where no piece of this vocabulary can lie across, checked on all its pieces.

    First: before a blank mark, if pieces hold it only at their start. Second: also around line ends, if no
    piece has one, and between a letter and what is neither letter, mark nor digit, if no piece joins those.
    """
    apart = regex.compile(rf"[\p{{L}}\p{{M}}][^\p{{L}}\p{{M}}\p{{N}}{MARK}]")
    marks = not any(MARK in p.lstrip(MARK) for p in pieces)
    return marks, marks and not any("\n" in p or apart.search(p) for p in pieces)


def segment_pattern(marks: bool, words: bool) -> regex.Pattern:
    """The segments of a text by these rules."""
    word = r"\p{L}\p{M}\p{N}"
    if words:
        return regex.compile(rf"{MARK}*[^{MARK}\n{word}]*[{word}]*[\p{{L}}\p{{M}}](?![{word}])|\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
    return regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if marks else r"(?s).+")


class Words(dict):
    """Solutions of words behind a blank mark. What is put together from parts is not remembered."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[bytes, float, float]:
        model = self.model
        if model.cuts_words and word[-1:] in CLOSING and word[:-1].isalpha():
            return joined([self[word[:-1]], model.cache[word[-1]]])
        found = [MARK + word] if word.isalpha() else model.segments.findall(MARK + word)
        if len(found) == 1:
            value = model.solve(found[0])
            if len(word) <= LONGEST:
                self[word] = value
            return value
        return joined([self[found[0][1:]], *[model.cache[part] for part in found[1:]]])


def joined(parts: list[tuple[bytes, float, float]]) -> tuple[bytes, float, float]:
    return b"".join([p[0] for p in parts]), sum([p[1] for p in parts]), min([p[2] for p in parts])


class PieceModel:
    """Pieces of a SentencePiece model read as an additive lattice."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_proto=data)
        self.normalize = sp.normalize
        n = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.texts[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.spelled = [b"" if sp.is_control(i) else t.encode() for i, t in enumerate(self.texts)]
        for value, i in self.bytes.items():
            self.spelled[i] = bytes([value])
        self.unknown = sp.unk_id()
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {self.texts[i]: (i, sp.get_score(i)) for i in usual}
        self.matches = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            self.matches.add_word(piece, (len(piece), i, score))
        self.matches.make_automaton()
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.cuts_marks, self.cuts_words = cut_rules(self.pieces)
        self.segments = segment_pattern(self.cuts_marks, self.cuts_words)
        self.singles = {p for p in self.pieces if len(p) == 1}
        self.cache = Cache(self.solve, CACHED // 4)
        self.marked = Words(self)
        self.n_choices = 3
        self.choices = Cache(lambda segment: self.n_best(segment, self.n_choices), CACHED // 20)
        self.prefix = sp.normalize("x") == MARK + "x"

    def edges(self, text: str) -> list[list[tuple[int, int, float]]]:
        """For each place the lattice's edges that end there: (start, id, score), longest first.

        A character without a piece of its own has an edge of id -1.
        """
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(len(text) + 1)]
        for last, (length, piece, score) in self.matches.iter(text):
            ends[last + 1].append((last + 1 - length, piece, score))
        for end in range(1, len(text) + 1):
            if not ends[end] or ends[end][-1][0] != end - 1:
                ends[end].append((end - 1, -1, self.unknown_score))
        return ends

    def forward(self, text: str) -> tuple[list, list[float], list[tuple[int, int, float]], list[float]]:
        """Edges, and for each place the best score before it, the edge that gives it, the score by the next best."""
        ends, worst = self.edges(text), float("-inf")
        best, back, second = [0.0], [(0, -1, 0.0)], [worst]
        for edges in ends[1:]:
            if len(edges) == 1:
                chosen, top, runner = edges[0], best[edges[0][0]] + edges[0][2], worst
            else:
                top = runner = worst
                for edge in edges:
                    score = best[edge[0]] + edge[2]
                    if score > top:
                        top, runner, chosen = score, top, edge
                    elif score > runner:
                        runner = score
            best.append(top)
            back.append(chosen)
            second.append(runner)
        return ends, best, back, second

    def spell(self, text: str, edges: list[tuple[int, int, int]]) -> list[int]:
        """Ids of a path; a character without a piece becomes its bytes, or the unknown id."""
        out = []
        for start, end, piece in edges:
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in text[start:end].encode("utf-8"))
            else:
                out.append(self.unknown)
        return out

    def solve(self, text: str) -> tuple[bytes, float, float]:
        """(ids as 32-bit numbers, score, how much worse the next best segmentation is) of a segment."""
        n, worst = len(text), float("-inf")
        if self.singles.issuperset(text):  # forward pass without unknown characters, edge by edge
            best, second, starts, ids = [worst] * (n + 1), [worst] * (n + 1), [0] * (n + 1), [0] * (n + 1)
            best[0] = 0.0
            for last, (length, piece, score) in self.matches.iter(text):
                end = last + 1
                score += best[end - length]
                if score > best[end]:
                    second[end], best[end], starts[end], ids[end] = best[end], score, end - length, piece
                elif score > second[end]:
                    second[end] = score
        else:
            _, best, back, second = self.forward(text)
            starts, ids = [x[0] for x in back], [x[1] for x in back]
        out, ends, gap, end = [], [], float("inf"), n
        while end:
            lost = best[end] - second[end]  # by leaving the best path here; what follows stays best
            if lost < gap:
                gap = lost
            out.append(ids[end])
            ends.append(end)
            end = starts[end]
        out.reverse()
        if -1 in out:
            ends = [0, *reversed(ends)]
            out = self.spell(text, list(zip(ends, ends[1:], out)))
        return array("i", out).tobytes(), best[n], gap

    def n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a segment, best first: A-star from its end."""
        ends, best, _, _ = self.forward(text)
        heap, found, tie = [(-best[-1], 0, len(text), 0.0, None)], [], 0
        while heap and len(found) < n:
            _, _, place, tail, path = heappop(heap)
            if place == 0:
                edges = []
                while path is not None:
                    edge, path = path
                    edges.append(edge)
                found.append((tail, self.spell(text, edges)))
                continue
            for start, piece, score in ends[place]:
                tie += 1
                total = tail + score
                heappush(heap, (-(total + best[start]), tie, start, total, ((start, place, piece), path)))
        return found

    def encode(self, text: str, n: int):
        """(ids, score, others): others holds the next n - 1 segmentations as score and changed runs of ids."""
        normal = self.normalize(text)
        if self.cuts_marks and normal.startswith(MARK) and MARK * 2 not in normal:
            segments, mark = normal[1:].split(MARK), MARK  # words with one mark before each
            solved = list(map(self.marked.__getitem__, segments))
        else:
            segments, mark = self.segments.findall(normal), ""
            solved = list(map(self.cache.__getitem__, segments))
        parts = [s[0] for s in solved]
        score = sum([s[1] for s in solved])
        others = self.others(segments, mark, parts, np.array([s[2] for s in solved]), score, n) if n > 1 else []
        self.cache.trim()
        self.choices.trim()
        if len(self.marked) > CACHED:
            self.marked.clear()
        return np.frombuffer(b"".join(parts), np.int32), score, others

    def others(self, segments: list[str], mark: str, parts: list[bytes], gaps: np.ndarray, score: float, n: int) -> list[dict]:
        # the n - 1 next segmentations leave the best path only in the n - 1 segments where that costs least
        nearest = np.arange(len(gaps)) if len(gaps) < n else np.sort(np.argpartition(gaps, n - 2)[:n - 1])
        nearest = [int(i) for i in nearest if gaps[i] < np.inf]
        combined = [(0.0, ())]
        for i in nearest:
            segment = mark + segments[i]
            choices = self.choices[segment] if n == self.n_choices else self.n_best(segment, n)
            lost = [(choices[0][0] - s, ids) for s, ids in choices]
            combined = nsmallest(n, ((c + d, (*ch, (i, ids)) if k else ch) for c, ch in combined
                                     for k, (d, ids) in enumerate(lost)), key=lambda x: x[0])
        begins = {i: sum(map(len, parts[:i])) // 4 for i in nearest}  # places of the segments' first ids
        return [{"score": score - lost, "changes": [
            {"first": begins[i], "last": begins[i] + len(parts[i]) // 4 - 1, "ids": ids} for i, ids in changes]}
            for lost, changes in combined[1:]]

    def decode(self, ids) -> str:
        """The text of ids: marks become blanks, runs of bytes are read as UTF-8, control pieces are silent."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode_documents(docs: DataFrame, path: str = "piece_bpe_32k.model", n_best: int = 3, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, score, others, round_trip)``, a row for each row of ``docs``.

    ids and score are those of the best segmentation; others holds the next ``n_best - 1`` by falling score,
    each the best one's ids with the runs first..last replaced; fewer where the lattice has fewer paths.
    round_trip says whether decoding the ids gives the text. Equal scores come in a fixed order. No begin or
    end pieces are added; their strings in a text are ordinary text. Null and empty texts have no ids,
    score 0 and no others; ids of rows may be null or repeated; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    data = vocabulary(spark, path)

    def run(batches):
        model = parsed(PieceModel, data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # piece ids of a few documents at a time
                part = batch.slice(at, ROWS)
                texts = part.column("text").to_pylist()
                solved = [model.encode(t, n_best) for t in texts]
                places = np.cumsum([0] + [len(ids) for ids, _, _ in solved], dtype=np.int32)
                values = np.concatenate([ids for ids, _, _ in solved])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.ListArray.from_arrays(pa.array(places), pa.array(values, pa.int32())),
                    pa.array([s for _, s, _ in solved], pa.float64()), pa.array([o for _, _, o in solved], OTHERS),
                    pa.array([model.decode(ids.tolist()) == t for t, (ids, _, _) in zip(texts, solved)])],
                    ["doc_id", "ids", "score", "others", "round_trip"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, {ENCODED}")


def decode(spark: SparkSession, ids: Column, path: str = "piece_bpe_32k.model") -> Column:
    """The text of an array of ids; null arrays give null, null or unknown ids an error."""
    ship(spark)
    data = vocabulary(spark, path)

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        model = parsed(PieceModel, data.value)
        return batch.map(lambda x: None if x is None else model.decode(np.asarray(x).tolist()), na_action=None)

    return run(ids)
