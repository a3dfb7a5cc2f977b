"""Toxicity by a bidirectional gated recurrent network with attention, trained and run in numpy.

A word enters as a vector of its own, if it is known, next to the mean of its character trigrams. Both
directions of the network read windows of words; attention pools their states into one score. A
text is cut into overlapping windows that cover all of it, and scores as its worst window does.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..staging import stage
from .common import fresh, ship
from .vocab import held

WORD = regex.compile(r"[^\W_]+")
#: Words of a window, and from one window's start to the next.
WINDOW, STEP = 32, 24
WORD_SIZE = CHAR_SIZE = HIDDEN = 8
ATTENTION = 8
TRIGRAMS = 4096
KNOWN_WORDS = 4096
#: A word gets a vector of its own if it is in so many texts of the sample.
LEAST_TEXTS = 8
#: Bounds of the labelled sample that the network is fitted on: rows of each label, bytes altogether.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 64 << 20
#: Words whose input a worker remembers; windows that run through the network at a time.
CACHED, BATCH = 200_000, 1024


def text_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def trigrams(word: str) -> list[int]:
    marked = f"<{word}>".encode()
    return [zlib.crc32(marked[i:i + 3]) % TRIGRAMS for i in range(max(len(marked) - 2, 1))]


def window_starts(n: int) -> list[int]:
    """Starts of windows that cover n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STEP), n - WINDOW]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    known: dict[str, int]
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    cache: dict = field(default_factory=dict)  # word -> its row in ``table``
    table: np.ndarray | None = None

    @classmethod
    def start(cls, known: dict[str, int], rng: np.random.Generator) -> Network:
        def draw(*shape, by):
            return rng.normal(0, by, shape).astype(np.float32)

        size = WORD_SIZE + CHAR_SIZE
        return cls(known, {
            "words": draw(len(known) + 1, WORD_SIZE, by=0.1), "chars": draw(TRIGRAMS, CHAR_SIZE, by=0.3),
            "in": draw(2, size, 3 * HIDDEN, by=size ** -0.5), "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "state": draw(2, HIDDEN, 3 * HIDDEN, by=HIDDEN ** -0.5),
            "look": draw(2 * HIDDEN, ATTENTION, by=(2 * HIDDEN) ** -0.5), "mark": draw(ATTENTION, by=ATTENTION ** -0.5),
            "out": draw(2 * HIDDEN, by=(2 * HIDDEN) ** -0.5), "base": np.zeros(1, np.float32)})

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Vectors of different words, and what their gradients need."""
        own = np.array([self.known.get(w, 0) for w in words], np.int64)
        grams = [trigrams(w) for w in words]
        sizes = np.array([len(g) for g in grams], np.int64)
        flat = np.array([x for g in grams for x in g], np.int64)
        chars = np.add.reduceat(self.p["chars"][flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        known = self.p["words"][own] * (own > 0)[:, None]
        return np.hstack([known, chars]).astype(np.float32), (own, flat, sizes)

    def run(self, projected: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Scores of windows. projected: [2, T, B, 3H], the second direction's time reversed; mask: [T, B]."""
        p, (_, steps, b, _), h3 = self.p, projected.shape, HIDDEN
        h, states, saved = np.zeros((2, b, HIDDEN), np.float32), np.empty((steps, 2, b, HIDDEN), np.float32), []
        for t in range(steps):
            a, g = projected[:, t], h @ p["state"]
            zr = _sigmoid(a[..., :2 * h3] + g[..., :2 * h3])
            z, r = zr[..., :h3], zr[..., h3:]
            n = np.tanh(a[..., 2 * h3:] + r * g[..., 2 * h3:])
            after = n + z * (h - n)
            if mask is not None:
                m = np.stack([mask[t], mask[steps - 1 - t]])[..., None]
                after = h + m * (after - h)
            if keep:
                saved.append((h, z, r, n, g[..., 2 * h3:]))
            states[t] = h = after
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)  # [T, B, 2H]
        seen = np.tanh(both @ p["look"])
        weight = seen @ p["mark"]
        if mask is not None:
            weight = np.where(mask > 0, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[..., None] * both).sum(axis=0)
        score = pooled @ p["out"] + p["base"]
        return (score, (saved, both, seen, weight, pooled)) if keep else score

    def forget(self) -> None:
        self.cache, self.table = {}, None

    def _project(self, new_words: list[str]) -> np.ndarray:
        """The inputs of both directions' gates for all words seen, after adding those of new words."""
        if self.table is None or len(self.cache) > len(self.table):
            larger = np.zeros((max(2 * len(self.cache), 4096), 2, 3 * HIDDEN), np.float32)
            if self.table is not None:
                larger[:len(self.table)] = self.table
            self.table = larger
        first = len(self.cache) - len(new_words)
        for i in range(0, len(new_words), 1 << 14):
            x, _ = self.inputs(new_words[i:i + (1 << 14)])
            self.table[first + i:first + i + len(x)] = (x @ self.p["in"] + self.p["bias"]).transpose(1, 0, 2)
        return self.table

    def window_scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The scores of every window of every text."""
        if len(self.cache) > CACHED:
            self.forget()
        cache, new_words, ids = self.cache, [], []
        for words in texts:
            row = list(map(cache.get, words))
            if None in row:
                for j, i in enumerate(row):
                    if i is None:
                        i = cache.get(words[j])
                        if i is None:
                            i = cache[words[j]] = len(cache)
                            new_words.append(words[j])
                        row[j] = i
            ids.append(np.array(row, np.int32))
        table = self._project(new_words)
        full, short, where = [], [], []
        for words in ids:
            starts = window_starts(len(words))
            where.append((len(words) >= WINDOW, len(starts)))
            if len(words) >= WINDOW:
                full.append(np.lib.stride_tricks.sliding_window_view(words, WINDOW)[starts])
            else:
                short.append(words)
        full = np.concatenate(full) if full else np.zeros((0, WINDOW), np.int64)
        scores = np.empty(len(full), np.float32)
        for i in range(0, len(full), BATCH):
            part = table[full[i:i + BATCH].T]  # [T, B, 2, 3H]
            scores[i:i + BATCH] = self.run(np.stack([part[:, :, 0], part[::-1, :, 1]]), None)
        few = np.empty(len(short), np.float32)
        for i in range(0, len(short), BATCH):
            rows = short[i:i + BATCH]
            padded, mask = np.zeros((len(rows), WINDOW), np.int64), np.zeros((WINDOW, len(rows)), np.float32)
            for j, words in enumerate(rows):
                padded[j, :len(words)], mask[:len(words), j] = words, 1.0
            part = table[padded.T]
            few[i:i + BATCH] = self.run(np.stack([part[:, :, 0], part[::-1, :, 1]]), mask)
        out, at, at_short = [], 0, 0
        for is_full, n in where:
            out.append(scores[at:at + n] if is_full else few[at_short:at_short + 1])
            at, at_short = (at + n, at_short) if is_full else (at, at_short + 1)
        return out

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """A score from 0 to 1 for each whole text, in groups of texts that keep memory small."""
        out, group, words = [], [], 0

        def flush():
            out.extend(float(s.max()) for s in self.window_scores(group))

        for text in texts:
            group.append(text_words(text))
            words += len(group[-1])
            if words > 100_000:
                flush()
                group, words = [], 0
        flush()
        return _sigmoid(self.scale * np.array(out, np.float64) + self.shift)

    def gradients(self, windows: list[list[str]], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the windows and its gradients, back through time."""
        p, h3, b = self.p, HIDDEN, len(windows)
        index: dict[str, int] = {}
        ids, mask = np.zeros((WINDOW, b), np.int64), np.zeros((WINDOW, b), np.float32)
        for j, words in enumerate(windows):
            ids[:len(words), j] = [index.setdefault(w, len(index)) for w in words]
            mask[:len(words), j] = 1.0
        x, (own, flat, sizes) = self.inputs(list(index) or [""])
        table = x @ p["in"] + p["bias"]  # [2, words, 3H]
        score, (saved, both, seen, weight, pooled) = self.run(np.stack([table[0][ids], table[1][ids[::-1]]]), mask, keep=True)
        q = _sigmoid(score)
        loss = float(-np.mean(labels * np.log(q + 1e-7) + (1 - labels) * np.log(1 - q + 1e-7)))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d = ((q - labels) / b).astype(np.float32)
        g["base"][0], g["out"] = d.sum(), pooled.T @ d
        d_pool = d[:, None] * p["out"]
        d_both = weight[..., None] * d_pool
        d_weight = (both * d_pool).sum(axis=-1)
        d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["mark"] = np.einsum("tb,tba->a", d_weight, seen)
        d_seen = d_weight[..., None] * p["mark"] * (1 - seen ** 2)
        g["look"] = np.einsum("tbh,tba->ha", both, d_seen)
        d_both = d_both + d_seen @ p["look"].T
        d_states = np.stack([d_both[..., :h3], d_both[::-1, :, h3:]], axis=1)  # [T, 2, B, H], by direction's time
        d_table, dh = np.zeros_like(table), np.zeros((2, b, h3), np.float32)
        for t in range(WINDOW - 1, -1, -1):
            h, z, r, n, gn = saved[t]
            m = np.stack([mask[t], mask[WINDOW - 1 - t]])[..., None]
            dh = dh + d_states[t]
            after, dh = dh * m, dh * (1 - m)
            d_n = after * (1 - z) * (1 - n ** 2)
            d_z = after * (h - n) * z * (1 - z)
            d_r = d_n * gn * r * (1 - r)
            dh = dh + after * z
            d_g = np.concatenate([d_z, d_r, d_n * r], axis=-1)
            g["state"] += h.transpose(0, 2, 1) @ d_g
            dh = dh + d_g @ p["state"].transpose(0, 2, 1)
            d_a = np.concatenate([d_z, d_r, d_n], axis=-1)
            for way in (0, 1):
                np.add.at(d_table[way], ids[t if way == 0 else WINDOW - 1 - t], d_a[way])
        g["bias"] = d_table.sum(axis=1, keepdims=True)
        g["in"] = x.T @ d_table
        d_x = (d_table @ p["in"].transpose(0, 2, 1)).sum(axis=0)
        np.add.at(g["words"], own, d_x[:, :WORD_SIZE] * (own > 0)[:, None])
        np.add.at(g["chars"], flat, np.repeat(d_x[:, WORD_SIZE:] / sizes[:, None], sizes, axis=0))
        return loss, g


def train(texts: list[str], labels: list[int], share: float, steps: int = 400, batch: int = 64, rate: float = 0.01,
          decay: float = 0.2, seed: int = 0) -> Network:
    """Fits a network to whole texts and their labels; ``share`` of all texts are labelled 1.

    Epochs are run until ``steps`` batches have been learnt from. In the first quarter a random window stands
    for its text, later the window that scores worst, so that what makes a text toxic is found in it, and clean
    texts teach by what looks worst in them.
    """
    rng = np.random.default_rng(seed)
    words, y = [text_words(t) for t in texts], np.array(labels, np.float32)
    counts = Counter(w for ws in words for w in set(ws))
    common = sorted((w for w, n in counts.items() if n >= LEAST_TEXTS), key=lambda w: (-counts[w], w))[:KNOWN_WORDS]
    net = Network.start({w: i + 1 for i, w in enumerate(common)}, rng)
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    starts = [window_starts(len(ws)) for ws in words]
    while step < steps:
        worst = None
        if 4 * step >= steps:
            net.forget()
            worst = [int(s.argmax()) for s in net.window_scores(words)]
        chosen = []
        for i, s in enumerate(starts):
            picks = {int(rng.integers(len(s)))} if worst is None or not y[i] else set()
            if worst is not None:
                picks.add(worst[i])
            chosen += [(i, s[j]) for j in sorted(picks)]
        order = rng.permutation(len(chosen))
        for at in range(0, len(order), batch):
            part = [chosen[j] for j in order[at:at + batch]]
            _, grads = net.gradients([words[i][s:s + WINDOW] for i, s in part], y[[i for i, _ in part]])
            step += 1
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                if k not in ("bias", "base"):
                    net.p[k] *= 1 - rate * decay
                net.p[k] -= rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-6)
    net.forget()
    top = np.array([float(s.max()) for s in net.window_scores(words)])
    net.scale, net.shift = calibrate(top, y, np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)))
    net.forget()
    return net


def calibrate(score: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through weighted rows, by Newton's steps."""
    x = np.column_stack([score, np.ones_like(score)]).astype(np.float64)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = _sigmoid(x @ w)
        grad = x.T @ (weight * (q - y)) + penalty * len(y) * (w - np.array([1.0, 0.0]))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + penalty * len(y) * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id):
    """Whether a row may not be learnt from: CRC-32 of the id as text, modulo 5, is 0 (null ids: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def one_each(docs: DataFrame, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row for each id: the one with the least text (then the least further columns). Null ids take no part."""
    own = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra)
    least = own.groupBy("doc_id").agg(F.min(F.struct("text", *extra)).alias("r"))
    return least.select("doc_id", "r.*")


def sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, n_bytes: int, id_col: str = "doc_id",
           text_col: str = "text", extra: tuple[str, ...] = ()) -> tuple[list, float]:
    """(rows of the labelled sample, share of label 1 among all labels of the table that may be learnt from).

    Labels are met with the table's ids first. Up to ``rows`` of each label are taken, in the order of a hash of the
    id. A text that does not fit into what is left of ``n_bytes`` is passed over, those after it are not; the first
    text of a label is taken in any case. A repeated id counts once, with its least text.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(target).alias("y"))
    there = docs.select(F.col(id_col).alias("there")).where("there is not null").distinct()
    known = stage(known.join(there, F.col("doc_id") == F.col("there"), "left_semi"), "labels-known")
    n, ones = known.agg(F.count("*"), F.sum("y")).first()
    if not n or not ones or ones == n:
        return [], float(ones or 0) / max(n, 1)
    picked = None
    for y in (0, 1):
        side = known.where(F.col("y") == y).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
        picked = side if picked is None else picked.union(side)
    # 2 * rows ids: bounded by the parameter
    few = docs.join(F.broadcast(picked.select(F.col("doc_id").alias("picked_id"), "y")), F.col(id_col) == F.col("picked_id"))
    found = one_each(few, id_col, text_col, ("y", *extra))
    out, size, seen = [], 0, set()
    for r in found.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").toLocalIterator():
        own = len(r["text"].encode())
        if size + own <= n_bytes or r["y"] not in seen:
            out.append(r)
            size += own
            seen.add(r["y"])
    return out, float(ones) / n


class Unlearnable(ValueError):
    """There are labels, but not both of them among the rows that may be learnt from."""


def labels_or_none(found: list, labels: DataFrame, target: str, missing: str) -> bool:
    """Whether ``found`` holds both labels. Without any label nothing can be said; with one only, that is an error to see."""
    if len({r["y"] for r in found}) == 2:
        return True
    n = labels.where(F.col(target).isin(0, 1)).count()
    if n and missing == "raise":
        raise Unlearnable(f"{n} labels, but not both values of {target} on rows that may be learnt from")
    return False


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, n_bytes: int = SAMPLE_BYTES, missing: str = "none", **columns) -> Network | None:
    """The network learnt from a bounded labelled sample; None without labels of both kinds, or an error if ``missing`` says so."""
    found, share = sample(docs, labels, "toxic", rows, n_bytes, **columns)
    if not labels_or_none(found, labels, "toxic", missing):
        return None
    return train([r["text"] for r in found], [r["y"] for r in found], share)


def with_score(docs: DataFrame, network: Network | None, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` and a column with the toxicity of each whole text, from 0 to 1; all 0 without a network."""
    if network is None:
        return docs.withColumn(name, F.lit(0.0))
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((network.known, network.p, network.scale, network.shift))

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_worker_network(sent).probabilities(list(texts)))

    return docs.withColumn(name, score(F.col(text_col)))


def _worker_network(sent) -> Network:
    known, p, scale, shift = sent.value
    return held(("network", zlib.crc32(p["out"].tobytes() + p["in"].tobytes())), lambda: Network(known, p, scale, shift))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs``.

    Learns from labelled rows that are not held out. Null and empty texts score as a window without
    words; ids may be null or repeated; labels of unknown documents, null and repeated labels (the larger
    counts) do no harm; of a repeated id the least text is learnt from; other columns are ignored; without both
    labels every score is 0. Texts of any length are scored whole, window by window; equal texts score alike.
    """
    network = fit(docs, labels, id_col=id_col, text_col=text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = with_score(own, network, "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns.

    Without any label all rows stay. Labels that cannot be learnt from (one value only, or on no row of ``docs`` that is
    not held out) are an error: a filter that lets all pass must not go unseen. An empty table stays empty.
    """
    name = fresh(docs, "toxicity")
    network = fit(docs, labels, id_col=id_col, text_col=text_col, missing="none" if docs.isEmpty() else "raise")
    return with_score(docs, network, name, text_col).where(F.col(name) < 0.5).drop(name)
