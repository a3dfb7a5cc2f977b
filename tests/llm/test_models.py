"""The two learnt filters: gradients, held-out accuracy, awkward tables."""

import random

import numpy as np
import pytest
from helpers import awkward, stored
from pyspark.sql import functions as F

from claimsweep.llm import cotraining, toxicity


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network.start({"a": 1, "bb": 2}, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows, y = [["a", "bb", "ccc", "a"], ["zz"] * 32, [], ["bb", "q"]], np.array([1.0, 0.0, 1.0, 0.0])
    _, grads = net.gradients(windows, y)
    for name, p in net.p.items():
        flat, g = p.reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:4]:
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = net.gradients(windows, y)[0]
            flat[i] = old - step
            down = net.gradients(windows, y)[0]
            flat[i] = old
            assert g[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-5), name


def plain_window(net, words):
    """One window's score from the definition, a word at a time."""
    p, h3 = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    if not words:
        return float(p["base"][0])
    xs = [np.concatenate([p["words"][net.known[w]] if net.known.get(w, 0) else np.zeros(toxicity.WORD_SIZE),
                          np.mean([p["chars"][g] for g in toxicity.trigrams(w)], axis=0)]) for w in words]

    def states(seq, way):
        h, out = np.zeros(h3), []
        for x in seq:
            a, g = x @ p["in"][way] + p["bias"][way, 0], h @ p["state"][way]
            z, r = sig(a[:h3] + g[:h3]), sig(a[h3:2 * h3] + g[h3:2 * h3])
            n = np.tanh(a[2 * h3:] + r * g[2 * h3:])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    both = [np.concatenate(pair) for pair in zip(states(xs, 0), states(xs[::-1], 1)[::-1])]
    look = np.array([np.tanh(b @ p["look"]) @ p["mark"] for b in both])
    weight = np.exp(look - look.max())
    return float(sum(w * b for w, b in zip(weight / weight.sum(), both)) @ p["out"] + p["base"][0])


def test_scores_against_a_plain_forward_pass():
    r = random.Random(3)
    words = [f"w{i}" for i in range(50)] + ["Ünï", "日本", "x" * 40]
    net = toxicity.Network.start({w: i + 1 for i, w in enumerate(words[:30])}, np.random.default_rng(1))
    net.p = {k: (v * 3).astype(np.float32) for k, v in net.p.items()}
    net.scale, net.shift = 1.7, -0.4
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (0, 1, 5, 31, 32, 33, 57, 130)] + [None]
    got = net.probabilities(texts)
    for text, score in zip(texts, got):
        own = toxicity.text_words(text)
        starts = toxicity.window_starts(len(own))
        best = max(plain_window(net, own[s:s + toxicity.WINDOW]) for s in starts)
        assert score == pytest.approx(1 / (1 + np.exp(-(net.scale * best + net.shift))), abs=2e-4)


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 32, 33, 56, 57, 200):
        starts = toxicity.window_starts(n)
        covered = {i for s in starts for i in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n)) and len(set(starts)) == len(starts)
        assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))


def corpus(n, seed=1):
    r = random.Random(seed)
    plain = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        text = [r.choice(plain) for _ in range(r.randint(20, 200))]
        bad = r.random() < 0.3
        if bad:
            text.insert(r.randrange(len(text)), r.choice(["nasty", "vile", "vilest"]))
        rows.append((i, " ".join(text), bad))
    return rows


def test_toxicity_on_held_out_rows(spark, tmp_path):
    rows = corpus(500)
    docs = stored(spark, [(i, t) for i, t, _ in rows] + [r for r in awkward() if r[0] is None or r[0] > 600], tmp_path / "d")
    labels = spark.createDataFrame([(i, int(b), None) for i, _, b in rows] + [(None, 1, 0), (9999, 1, 0), (3, None, 0)],
                                   "doc_id long, toxic int, quality int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {i: int(b) for i, _, b in rows}
    test = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(test) > 60 and sum(a == b for a, b in test) / len(test) > 0.95
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


@pytest.mark.parametrize("model", [toxicity, cotraining])
def test_without_labels_or_rows(spark, tmp_path, model):
    docs, none = stored(spark, awkward(), tmp_path / "d"), stored(spark, [], tmp_path / "e")
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "doc_id long, toxic int, quality int")
    assert model.score_documents(docs, labels.limit(0)).count() == docs.count()
    assert model.score_documents(docs, labels).count() == docs.count()
    assert model.score_documents(none, labels).count() == 0


def test_quality_on_held_out_rows(spark, tmp_path):
    r, rows = random.Random(2), []
    for i in range(600):
        good = r.random() < 0.6
        text = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + ("" if good else r.choice(["###", "$$$", "!!"])) for _ in range(40))
        rows.append((i, text, "s" + str(r.randint(0, 3) if good else r.randint(2, 5))))
    docs = stored(spark, rows + [x for x in awkward() if x[0] is None or x[0] > 600], tmp_path / "d")
    truth = {i: int("###" not in t and "$$$" not in t and "!!" not in t) for i, t, _ in rows}
    labels = spark.createDataFrame([(i, y, None) for i, y in truth.items() if i % 3], "doc_id long, quality int, toxic int")
    got = cotraining.score_documents(docs, labels).collect()
    assert len(got) == docs.count()
    test = [(truth[x["doc_id"]], x["predicted"]) for x in got if x["doc_id"] in truth and (x["held_out"] or x["doc_id"] % 3 == 0)]
    assert sum(a == b for a, b in test) / len(test) > 0.97


def test_views_teach_each_other():
    """One view knows half of the cases, the other one the rest: pseudo-labels carry what each knows."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600).astype(float)
    sign = (2 * y - 1)[:, None]
    text, meta = sign + rng.normal(0, 1.0, (600, 3)), sign + rng.normal(0, 1.0, (600, 2))
    pool = (text[30:400], meta[30:400])
    kept = [{}, {}]

    def hand_over(model):
        """What a view is sure of goes to the other one."""
        for me, view in enumerate((model.text, model.meta)):
            odds = view.log_odds(pool[me])
            for i in np.argsort(-np.abs(odds))[:60]:
                if abs(odds[i]) > 1.4:
                    kept[1 - me].setdefault(int(i), float(odds[i] > 0))
        return [(pool[me][list(kept[me])], np.array(list(kept[me].values()))) for me in (0, 1)]

    model = cotraining.co_train(text[:30], meta[:30], y[:30], 0.5, hand_over)
    chance = model.combine(model.text.log_odds(text[400:]), model.meta.log_odds(meta[400:]))
    assert ((chance >= 0.5) == (y[400:] > 0)).mean() > 0.93
    assert chance.min() >= 0 and chance.max() <= 1


def test_what_is_handed_over_against_the_definition(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.gauss(0, 4), r.gauss(1, 3)) for i in range(900)] + [(5000 + i, "c", 4.0, 4.0) for i in range(40)]
    share, handed, sure = 0.3, 50, 0.9
    table = spark.createDataFrame(rows, "row long, source string, text double, meta double").withColumn("t", F.lit(0).cast("long"))
    got = cotraining.most_confident(table, share, handed, sure)
    limit = np.log(sure / (1 - sure))
    expected = set()
    for at, view in ((2, "text"), (3, "meta")):
        for label, sign, part in ((1, 1, share), (0, -1, 1 - share)):
            able = [x for x in rows if sign * x[at] >= limit]
            for source in {x[1] for x in able}:
                own = sorted((x for x in able if x[1] == source), key=lambda x: (-sign * x[at], x[0]))
                n = max(1, int(np.floor(round(handed * part) * len(own) / len(able) + 0.5)))
                expected |= {(view, label, source, x[0]) for x in own[:min(n, round(handed * part))]}
    assert {(x["view"], x["label"], x["source"], x["row"]) for x in got.collect()} == expected


def test_every_unlabelled_row_is_looked_at(spark, tmp_path):
    """The rows that teach most come last by any order of ids, and a very long text stands first."""
    r = random.Random(6)
    words = lambda bad: " ".join(r.choice(["alpha", "beta", "gamma"]) + ("##" if bad else "") for _ in range(30))
    rows = [(i, words(i % 2), "s0" if i % 2 else "s1") for i in range(5200)] + [(99999, "long " * 400000, "s1")]
    docs = stored(spark, rows, tmp_path / "d")
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(0, 60)], "doc_id long, quality int, toxic int")
    seen = []
    pick = cotraining.most_confident

    def counted(odds, *rest):
        seen.append(odds.count())
        return pick(odds, *rest)

    cotraining.most_confident = counted
    try:
        model = cotraining.fit(docs, labels, n_bytes=1 << 20)
    finally:
        cotraining.most_confident = pick
    assert seen and set(seen) == {5201 - 60} and model is not None


def test_scores_against_a_plain_computation(spark, tmp_path):
    """op5: both views' linear scores, calibrated and added up, from the definition."""
    rows = [(i, t, "s1" if bad else "s2") for i, t, bad in corpus(200, 3)]
    docs = stored(spark, rows, tmp_path / "d")
    labels = spark.createDataFrame([(i, int(s == "s2"), None) for i, _, s in rows[:120]], "doc_id long, quality int, toxic int")
    model = cotraining.fit(docs, labels)
    got = {x["doc_id"]: x for x in cotraining.score_documents(docs, labels).collect()}
    for i, text, source in rows:
        odds = []
        for view, x in ((model.text, cotraining.text_features(text)), (model.meta, cotraining.meta_features("en", source, len(text)))):
            raw = sum(float(a) * float(b) for a, b in zip(x, view.weights[:-1])) + float(view.weights[-1])
            odds.append(min(max(view.scale * raw + view.shift, -15), 15))
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-(odds[0] + odds[1] - model.prior))), abs=1e-4)


def test_samples_pass_over_what_does_not_fit_and_meet_the_table_first(spark, tmp_path):
    rows = [(i, "x" * (400_000 if i % 7 == 0 else 10)) for i in range(70)] + [(3, "less"), (None, "no id")]
    docs = stored(spark, rows, tmp_path / "d")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    found, share = toxicity.sample(docs, labels, "toxic", 1000, 500_000)
    able = [i for i in range(70) if __import__("zlib").crc32(str(i).encode()) % 5]
    assert len(found) >= sum(i % 7 != 0 for i in able) and {x["doc_id"] for x in found} <= set(able)
    assert sum(len(x["text"]) for x in found) <= 500_000 + 400_000
    assert [x["text"] for x in found if x["doc_id"] == 3] in (["less"], [])
    assert share == pytest.approx(sum(i % 2 for i in able) / len(able))
    few, _ = toxicity.sample(docs, labels, "toxic", 5, 1 << 20)
    assert len(few) == 10  # labels of absent documents take no place


def test_a_filter_that_cannot_learn_is_an_error(spark, tmp_path):
    docs = stored(spark, awkward(), tmp_path / "d")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.keep_clean(docs, none).count() == docs.count()
    with pytest.raises(toxicity.Unlearnable):
        toxicity.keep_clean(docs, spark.createDataFrame([(777777, 1, 0), (777778, 0, 0)], none.schema))
    empty = stored(spark, [], tmp_path / "e")
    assert toxicity.keep_clean(empty, spark.createDataFrame([(1, 1, 0)], none.schema)).count() == 0


def test_held_out_fold(spark):
    import zlib

    df = spark.range(200).select(F.col("id"), toxicity.held_out(F.col("id")).alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in df.collect())
