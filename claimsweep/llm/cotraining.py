"""Quality by co-training: a text view and a metadata view teach each other with confident pseudo-labels."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .common import ship
from .toxicity import calibrate, held_out, labels_or_none, sample
from .vocab import Cache

#: Hashed features of each view; the text view has shape features beside them.
TEXT_SIZE, META_SIZE = 4096, 512
#: Signs whose share of a text the text view sees.
SIGNS = "#*$%&|<>!?.,;:{}=_@/\\\"'"
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
SHAPES = len(SIGNS) + 6
#: Bounds of the labelled sample: rows of each label, bytes of their texts (and of the texts handed over in a round).
LABELLED_ROWS, SAMPLE_BYTES = 1500, 64 << 20
#: Rounds of the exchange, rows that a view may hand over in one, and how sure it has to be.
ROUNDS, HANDED, SURE = 3, 200, 0.97
#: The views, their penalties, the columns of the metadata view, and shares into which a source's rows are dealt.
VIEWS, PENALTIES, META, SPREAD = ("text", "meta"), (1e-4, 1e-3), ("lang", "source", "n_chars"), 64
CACHED = 300_000


def _slot(word: bytes) -> int:
    return zlib.crc32(word) % TEXT_SIZE


_slots = Cache(_slot, CACHED)


def text_features(text: str | None) -> np.ndarray:
    """Hashed words weighed by the logarithm of their number, of length 1, and shares of signs, cases and repeats."""
    data = (text or "").encode()
    words = data.lower().split()
    out = np.zeros(TEXT_SIZE + SHAPES, np.float32)
    n, size = max(len(words), 1), max(len(data), 1)
    if words:
        counts = np.bincount(np.fromiter(map(_slots.__getitem__, words), np.int64, len(words)), minlength=TEXT_SIZE)
        logs = np.log1p(counts)
        out[:TEXT_SIZE] = logs / np.sqrt((logs * logs).sum())
    _slots.trim()
    lines = [x for x in data.split(b"\n") if x.strip()]
    shapes = [min(data.count(s.encode()) / n, 2.0) for s in SIGNS]
    shapes += [(len(data) - len(data.translate(None, UPPER))) / size, (len(data) - len(data.translate(None, DIGITS))) / size,
               len(set(words)) / n, 1 - len(set(lines)) / max(len(lines), 1), min(math.log1p(len(words)) / 10, 2.0),
               min(size / n / 20, 2.0)]
    out[TEXT_SIZE:] = np.array(shapes, np.float32) * 2
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language, source and both, and a step of the logarithm of the length; nulls are values of their own."""
    out = np.zeros(META_SIZE, np.float32)
    step = "none" if n_chars is None else str(int(2 * math.log2(max(n_chars, 0) + 1)))
    for key in (f"l{lang}", f"s{source}", f"b{lang}/{source}", f"n{step}"):
        out[zlib.crc32(key.encode()) % META_SIZE] += 0.5
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 200) -> np.ndarray:
    """Weights and intercept of a penalised logistic regression, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    weight = (weight / weight.sum()).astype(np.float32)
    bound = 0.25 * float((weight * (x * x).sum(axis=1)).sum()) + penalty
    w = v = np.zeros(x.shape[1], np.float32)
    for i in range(steps):
        q = 0.5 * np.tanh(0.5 * (x @ v)) + 0.5
        grad = x.T @ (weight * (q - y))
        grad[:-1] += penalty * v[:-1]
        after = v - grad / bound
        w, v = after, after + i / (i + 3) * (after - w)
    return w


@dataclass
class View:
    """A linear classifier and the curve that makes its scores log odds."""

    weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scale * (x @ self.weights[:-1] + self.weights[-1]) + self.shift, -15, 15)


@dataclass
class Model:
    text: View
    meta: View
    prior: float  # log odds of label 1

    def combine(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Views that are independent given the label: log odds add up, the prior counts once."""
        return 0.5 * np.tanh(0.5 * (text + meta - self.prior)) + 0.5


def balance(labels: np.ndarray, share: float) -> np.ndarray:
    """Weights under which label 1 has its share."""
    return np.where(labels > 0, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))


def fit_view(x: np.ndarray, y: np.ndarray, apart: np.ndarray, taught: np.ndarray, taught_labels: np.ndarray, share: float,
             penalty: float) -> View:
    """A view from labelled rows and rows that the other view has labelled; ``apart`` are kept for calibration only."""
    test = apart if apart.any() else ~apart
    labels = np.concatenate([y[~apart], taught_labels])
    view = View(logistic(np.vstack([x[~apart], taught]), labels, balance(labels, share), penalty))
    view.scale, view.shift = calibrate(x[test] @ view.weights[:-1] + view.weights[-1], y[test], balance(y[test], share))
    return view


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, share: float, hand_over, rounds: int = ROUNDS) -> Model:
    """Two views that teach each other. A fifth of the labelled rows is kept for calibration only.

    ``hand_over(model)`` looks at all unlabelled rows with the current views and says for each view which rows the
    other one now teaches it: (features, labels), those of earlier rounds among them, or None if nothing is new.
    """
    apart = np.arange(len(y)) % 5 == 0
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)
    prior = math.log(share / (1 - share))
    taught = [(np.zeros((0, x.shape[1]), np.float32), np.zeros(0)) for x in (text, meta)]
    for turn in range(rounds + 1):
        views = [fit_view(x, y, apart, *extra, share, penalty) for x, extra, penalty in zip((text, meta), taught, PENALTIES)]
        model = Model(*views, prior)
        if turn == rounds:
            break
        more = hand_over(model)
        if more is None:
            break
        taught = more
    return model


def features(rows) -> tuple[np.ndarray, np.ndarray]:
    if not rows:
        return np.zeros((0, TEXT_SIZE + SHAPES), np.float32), np.zeros((0, META_SIZE), np.float32)
    return (np.stack([text_features(r["text"]) for r in rows]),
            np.stack([meta_features(r["lang"], r["source"], r["n_chars"]) for r in rows]))


def odds_of(sent):
    """A column function ``(text, lang, source, n_chars) -> struct<text, meta>`` with both views' log odds."""

    @F.pandas_udf("text double, meta double")
    def both(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        m, t, s = sent.value, np.empty(len(text)), np.empty(len(text))
        for i, (a, b, c, d) in enumerate(zip(text, lang, source, n_chars)):
            t[i] = m.text.log_odds(text_features(a))
            s[i] = m.meta.log_odds(meta_features(b, c, None if pd.isna(d) else int(d)))
        return pd.DataFrame({"text": t, "meta": s})

    return both


def most_confident(odds: DataFrame, share: float, handed: int, sure: float) -> DataFrame:
    """``(view, label, source, row, t, odds)``: what each view hands over from ``odds(row, t, source, text, meta)``.

    Of each label and source the rows that a view is most sure of: of all rows that it is sure of by ``sure`` or more,
    each label hands over ``handed`` by the labels' shares, and each source a part of these by its number of
    such rows, one at least. Ties go to the smaller row, then ``t``. Ranks are cut in shares of a source before they meet.
    """
    limit = math.log(sure / (1 - sure))
    sides = [(view, label, sign, max(1, round(handed * part))) for view in VIEWS
             for label, sign, part in ((1, 1.0, share), (0, -1.0, 1 - share))]
    each = odds.select("row", "t", "source", F.explode(F.array(*[F.struct(
        F.lit(view).alias("view"), F.lit(label).alias("label"), F.lit(n).alias("wanted"), (sign * F.col(view)).alias("odds"))
        for view, label, sign, n in sides])).alias("s")).select("row", "t", "source", "s.*").where(F.col("odds") >= limit)
    sizes = each.groupBy("view", "label", "source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("all", F.sum("n").over(Window.partitionBy("view", "label")))
    key = ["view", "label", "source"]
    order = [F.desc("odds"), "row", "t"]
    share_of = F.pmod(F.xxhash64("row", "t"), F.lit(SPREAD))
    first = each.withColumn("place", F.row_number().over(Window.partitionBy(*key, share_of).orderBy(*order))).where("place <= wanted")
    first = first.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("place <= wanted")
    sized = sizes.select(*[F.col(c).alias(f"of_{c}") for c in key], "n", "all")
    met = first.join(sized, (F.col("view") == F.col("of_view")) & (F.col("label") == F.col("of_label")) & F.col("source").eqNullSafe(F.col("of_source")))
    part = F.greatest(F.lit(1), F.round(F.col("wanted") * F.col("n") / F.col("all")))
    return met.where(F.col("place") <= part).select(*key, "row", "t", "odds")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = LABELLED_ROWS, n_bytes: int = SAMPLE_BYTES,
        rounds: int = ROUNDS, handed: int = HANDED, sure: float = SURE) -> Model | None:
    """Learns from a bounded sample of labelled rows that are not held out, and from all rows without a label.

    In each round both views score every unlabelled row, on the workers; what each is most sure of, in all sources,
    goes over to the other one. Only numbers are shuffled for that; texts are fetched for the rows handed over.
    These are bounded by ``handed`` (a source hands over one at least, up to that many sources by their surest row).
    """
    spark = docs.sparkSession
    found, share = sample(docs, labels, target, rows, n_bytes, extra=META)
    if not labels_or_none(found, labels, target, "none"):
        return None
    text, meta = features(found)
    known = labels.where("doc_id is not null").select(F.col("doc_id").alias("known_id")).distinct()
    own = docs.where("doc_id is not null").select(F.col("doc_id").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text", *META)
    kept: dict[str, dict] = {view: {} for view in VIEWS}  # rows that a view was taught: label and features

    def hand_over(model: Model):
        sent = spark.sparkContext.broadcast(model)
        odds = own.select("row", "t", "source", odds_of(sent)("text", *META).alias("o")).select("row", "t", "source", "o.*")
        odds = stage(odds, "cotraining-odds").join(known, F.col("row") == F.col("known_id"), "left_anti")
        picked = most_confident(odds.dropDuplicates(["row", "t", "source"]), share, handed, sure)
        # bounded, however many sources there are
        few = stage(picked.orderBy(F.desc("odds"), "row", "t").limit(4 * len(VIEWS) * handed), "cotraining-handed")
        wanted = few.select(F.col("row").alias("r"), F.col("t").alias("u")).distinct()
        texts = own.join(F.broadcast(wanted), (F.col("row") == F.col("r")) & (F.col("t") == F.col("u"))).groupBy("row", "t").agg(
            F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), *META)).alias("x"))
        new, size = 0, 0
        for r in few.join(texts, ["row", "t"]).select("view", "label", "row", "t", "x.*").orderBy(
                "view", F.desc("label"), F.md5(F.col("row").cast("string")), "row", "t").toLocalIterator():
            taught = kept[VIEWS[1 - VIEWS.index(r["view"])]]
            key, length = (r["row"], r["t"]), len(r["text"].encode())
            if key not in taught and size + length <= n_bytes:  # one that does not fit is passed over
                taught[key] = (float(r["label"]), features([r]))
                size += length
                new += 1
        sent.destroy()
        if not new:
            return None
        out = []
        for i, (view, width) in enumerate(zip(VIEWS, (TEXT_SIZE + SHAPES, META_SIZE))):
            given = [kept[view][key] for key in sorted(kept[view])]
            out.append((np.vstack([np.zeros((0, width), np.float32), *[f[i] for _, f in given]]), np.array([y for y, _ in given], float)))
        return out

    return co_train(text, meta, np.array([r["y"] for r in found], np.float64), share, hand_over, rounds)


def score_documents(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """``(doc_id, held_out, text_score, meta_score, score, predicted, kept)``, a row for each row of ``docs``.

    Scores are chances of label 1 from 0 to 1; a row is kept from 0.5 on. Metadata are lang, source and
    n_chars; nulls are values of their own. Null and empty texts have no words. Repeated rows, unknown or
    repeated labels and null labels do no harm; of a repeated id the least row is learnt from; without both labels
    every score is 0.5 and all is kept. Texts of any length are read whole; equal rows score alike. Rows without
    an id are scored, but neither teach nor are taught.
    """
    ship(docs.sparkSession)
    model = fit(docs, labels, target)
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "lang", "source", "n_chars")
    if model is None:
        half = F.lit(0.5)
        return own.select("doc_id", "held_out", half.alias("text_score"), half.alias("meta_score"), half.alias("score"),
                          F.lit(1).alias("predicted"), F.lit(True).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    chance = lambda odds: 1 / (1 + F.exp(-odds))
    odds = own.select("doc_id", "held_out", odds_of(sent)("text", "lang", "source", "n_chars").alias("o"))
    out = odds.select("doc_id", "held_out", chance(F.col("o.text")).alias("text_score"), chance(F.col("o.meta")).alias("meta_score"),
                      chance(F.col("o.text") + F.col("o.meta") - F.lit(model.prior)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("kept", F.col("score") >= 0.5)
