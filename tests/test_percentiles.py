import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from claimsweep.operators import evaluate


def exact(values, q):
    ordered = sorted(values, key=lambda v: (math.isnan(v), v))
    return ordered[round(q * (len(ordered) - 1))]


def tenths(v):
    return v if math.isnan(v) or math.isinf(v) or abs(v) > 1e15 else round(v, 1)


QUANTILES = {"low": 0.0, "mid": 0.5, "most": 0.95, "top": 1.0}


@pytest.mark.parametrize("listed", [1, 7, 50_000])
def test_ranks_with_values_far_off(spark, listed):
    r = random.Random(listed)
    keys = {"far": [float(i) for i in range(1, 400)] + [1e300], "same": [7.5] * 300, "one": [3.25], "two": [1.0, 2.0],
            "signs": [r.choice([-1, 1]) * 2.0 ** r.randint(-60, 60) * r.random() for _ in range(300)] + [0.0, -0.0],
            "odd": [float("inf"), float("-inf"), 5e-324, -5e-324, 1.7e308, -1.7e308] * 3, None: [float(i) for i in range(50)]}
    rows = [(k, v) for k, vs in keys.items() for v in vs] + [("far", None), ("none", None)]
    r.shuffle(rows)
    got = evaluate.nearest_rank_percentile(spark.createDataFrame(rows, "k string, v double"), "k", "v", QUANTILES, listed=listed).collect()
    assert {x["k"] for x in got} == set(keys)
    for x in got:
        own = keys[x["k"]]
        assert x["n"] == len(own)
        for name, q in QUANTILES.items():
            assert tenths(x[name]) == pytest.approx(tenths(exact(own, q)), abs=0.051), (x["k"], name)


def test_image_never_falls(spark):
    r = random.Random(0)
    values = [struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)] + [2.0 ** e for e in range(-1074, 1024, 7)]
    values += [math.nextafter(2.0 ** e, d) for e in range(-1000, 1000, 13) for d in (-math.inf, math.inf)] + [0.0, math.inf, -math.inf, 5e-324]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", evaluate.ordered_image(F.col("v")).alias("i")).collect()
    ordered = sorted((x["v"], x["i"]) for x in rows)
    images = [i for _, i in ordered]
    assert images == sorted(images) and 0 <= images[0] and images[-1] < 1 << 63
    assert len(set(images)) > 0.95 * len(set(v for v, _ in ordered))


def test_no_rows(spark):
    assert evaluate.nearest_rank_percentile(spark.createDataFrame([], "k string, v double"), "k", "v", QUANTILES).collect() == []
