import datetime as dt
import random

from claimsweep.sources import registry

ROWS = "claim_id string, invoice_number string, invoice_date string, invoice_amount string, created_at timestamp_ntz"


def batch(seed, n=80):
    r = random.Random(seed)
    return [(f"c{r.randrange(30)}", f"N{r.randrange(25)}", r.choice([None, "2026-01-01"]), r.choice([None, "5.00", "6.00"]),
             dt.datetime(2026, 1, 1 + r.randrange(20))) for _ in range(n)]


def latest(rows):
    out = {}
    for claim, number, day, amount, at in rows:
        new = (at, day is not None, day or "", amount is not None, amount or "")
        if (claim, number) not in out or new > out[claim, number][0]:
            out[claim, number] = (new, day, amount, at)
    return {(c, n, d, a, t) for (c, n), (_, d, a, t) in out.items()}


def test_upserts_touch_their_own_shards(spark, tmp_path):
    registry.create_registry(spark, "reg_t", str(tmp_path / "reg"), 4)
    every = []
    for seed in (1, 2, 3):
        rows = batch(seed)
        every += rows
        for _ in range(2):  # a repeated upsert changes nothing
            registry.upsert(spark, "reg_t", spark.createDataFrame(rows, ROWS))
            assert {tuple(x) for x in spark.table("reg_t").select(*registry.COLUMNS).collect()} == latest(every)
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "reg").rglob("part-*")}
    one = spark.createDataFrame([("new", "N3", None, None, dt.datetime(2026, 5, 1))], ROWS)
    registry.upsert(spark, "reg_t", one)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "reg").rglob("part-*")}
    changed = {p.parent.name for p in stamps.keys() ^ after.keys()}
    assert len(changed) == 1 and spark.table("reg_t").count() == len(latest(every)) + 1
    found = registry.known_numbers(spark, "reg_t", one)
    assert {x["claim_id"] for x in found.collect()} == {"new"} | {c for c, n, *_ in every if n == "N3"}


def test_registry_side_is_not_shuffled(spark, tmp_path):
    registry.create_registry(spark, "reg_p", str(tmp_path / "reg"), 4)
    registry.upsert(spark, "reg_p", spark.createDataFrame(batch(4), ROWS))
    new = spark.createDataFrame(batch(5), ROWS)
    with registry._settings(spark, **registry.BY_NUMBER, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        for df in (registry.merged(spark, "reg_p", new), registry.known_numbers(spark, "reg_p", new)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("\n")
            scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "reg_p" in x)
            depth = lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)"))
            above, at = [], depth(lines[scan])
            for x in reversed(lines[:scan]):
                if depth(x) < at:
                    above.append(x)
                    at = depth(x)
            to_join = above[:next(i for i, x in enumerate(above) if "Join" in x)]
            assert not any("Exchange" in x for x in to_join), plan
