"""Streams over several batches: duplicates across batches, resubmissions, late events, repeated runs."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from claimsweep.operators import policy
from claimsweep.plans.audit import audit
from claimsweep.streaming import jobs


def arrive(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(day, hour=0, minute=0):
    return dt.datetime(2026, 3, day, hour, minute)


def test_duplicates_across_batches_and_a_repeated_run(spark, tmp_path):
    schema = "claim_id string, submitted_at timestamp_ntz, invoice_number string, invoice_date string, invoice_amount string"
    batches = [[("a", at(1), "N1", "2026-03-01", "5.00"), ("b", at(1), None, None, None)],
               [("c", at(2), "N1", "2026-03-01", "5.00"), ("d", at(2), "N1", "2026-03-01", "6.00"), ("e", at(2), "N2", None, None)],
               [("a", at(1), "N1", "2026-03-01", "5.00"), ("f", at(3), "N2", "2026-03-02", "7.00")]]
    found = []
    for run in range(2):  # the second run repeats all batches over the same state
        stream = arrive(spark, str(tmp_path / f"in{run}"), batches, schema)
        jobs.stream_duplicate_registry(stream, str(tmp_path / "registry"), str(tmp_path / "out"), str(tmp_path / f"check{run}")).awaitTermination()
        rows = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).collect()
        assert {r["batch"] for r in rows} == {0, 1, 2}
        found.append({(r["batch"], r["claim_id"], r["name"], r["passed"]) for r in rows})
    assert found[0] == found[1] == {
        (0, "a", "duplicate_invoice", True), (0, "b", "duplicate_invoice", True), (1, "c", "duplicate_invoice", False),
        (1, "d", "invoice_number_conflict", False), (1, "e", "duplicate_invoice", True), (2, "a", "duplicate_invoice", True),
        (2, "f", "invoice_number_conflict", False)}
    kept = spark.read.parquet(str(tmp_path / "registry"))
    assert kept.select("claim_id", "invoice_number").distinct().count() == 5 and "bucket" in kept.columns


# Spark drops by the watermark that the batch before the last has left
def test_late_events_are_dropped(spark, tmp_path):
    batches = [[(at(1, 10, 5), "view"), (at(1, 10, 50), "view")], [(at(1, 12, 30), "view")], [(at(1, 12, 31), "view")], [(at(1, 10, 59), "view"), (at(1, 12, 40), "view")]]
    events = arrive(spark, str(tmp_path / "in"), batches, "created_at timestamp, event_type string")
    jobs.stream_event_counts(events, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r["h"], r["n"]) for r in jobs.event_counts(spark, str(tmp_path / "out")).select(F.hour("window_start").alias("h"), "n").collect()}
    assert got == {(10, 2), (12, 3)}


def plain_hits(batches):
    """(batch, claim) -> (exact, any): the earliest other claim before it among the latest records, by brute force."""
    latest, out = {}, {}
    for n, rows in enumerate(batches):
        for claim, when, number, day, amount in rows:
            if number is not None:
                now = (when, day or "", amount or "")
                latest[claim, number] = max(latest.get((claim, number), now), now)
        for claim, when, number, day, amount in rows:
            before = sorted((r, c) for (c, k), r in latest.items() if k == number)
            exact = [(r[0], c) for r, c in before if (not day or r[1] == day) and (not amount or r[2] == amount)]
            first = lambda found: min(found, default=None)
            pick = lambda f: f[1] if f and f[1] != claim and f < (when, claim) else None
            out[n, claim, when] = (pick(first(exact)), pick(first([(r[0], c) for r, c in before])))
    return out


def test_registry_state_over_ten_batches_and_a_restart(spark, tmp_path):
    r = random.Random(5)
    schema = "claim_id string, submitted_at timestamp_ntz, invoice_number string, invoice_date string, invoice_amount string"
    batches = []
    for n in range(10):
        batches.append([(f"c{r.randrange(25)}", at(1 + r.randrange(20), r.randrange(24), i), r.choice(["N1", "N1", "N2", "N3", f"M{n}", None]),
                         r.choice(["2026-03-01", "2026-03-02", None]), r.choice(["5.00", "6.00", None])) for i in range(12)])
    expected = plain_hits(batches)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    updated = []
    for part in (batches[:4], batches[4:]):  # the second start goes on from the checkpoint of the first
        query = jobs.stream_duplicate_registry(arrive(spark, source, part, schema), str(tmp_path / "registry"), out, str(tmp_path / "check"))
        query.awaitTermination()
        updated += [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    rows = spark.read.option("basePath", out).parquet(out).collect()
    got = {}
    for x in rows:
        other = re.search(r"任务(c\d+)", x["detail"])
        got.setdefault((x["batch"], x["claim_id"]), []).append((x["name"], x["passed"], other and other[1]))
    wanted = {}
    for (n, claim, _), (exact, some) in expected.items():
        wanted.setdefault((n, claim), []).append(
            ("duplicate_invoice", False, exact) if exact else ("invoice_number_conflict", False, some) if some else ("duplicate_invoice", True, None))
    assert {k: sorted(map(str, v)) for k, v in got.items()} == {k: sorted(map(str, v)) for k, v in wanted.items()}
    # what a batch touches follows its own rows, not the number of batches before
    assert len(updated) == 10 and max(updated) <= 12 * 12


PAGE = "claim_id string, file_order int, document_id string, file_name string, page_no int, text string"


def test_material_stream_over_snapshots_of_the_registry(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "SNAPSHOT", 2)
    claims = [(f"c{i}", at(1, i), "市场部") for i in range(5)]
    texts = ["发票号码：AB12345\n发票金额：500.00\n发票日期：2026-03-02\n购买方：张三", "付款金额：500.00\n收款方：张三",
             "申请人：张三\n出差城市：北京\n出差开始：2026-03-01\n出差结束：2026-03-03"]
    page = lambda c, i: (c, i, f"{c}-{i}", f"f{i}.txt", 1, texts[i])
    batches = [[page(f"c{i}", 0)] for i in range(5)] + [[page(f"c{i}", 1) for i in range(5)], [page("c0", 2), page("c4", 2)]]
    table = spark.createDataFrame(claims, "claim_id string, submitted_at timestamp_ntz, department string")
    out, registry = str(tmp_path / "out"), str(tmp_path / "registry")
    jobs.stream_material_ingest(arrive(spark, str(tmp_path / "in"), batches, PAGE), table, registry, out, str(tmp_path / "check")).awaitTermination()
    # the last batch sees all files of its claims, and the registrations of all batches before
    last = {x["claim_id"]: x for x in spark.read.parquet(f"{out}/batch=6").collect()}
    whole = audit(table, spark.createDataFrame([p for b in batches for p in b], PAGE), policy.baseline_chunks(spark)).verdicts()
    assert {c: x.asDict() for c, x in last.items()} == {x["claim_id"]: x.asDict() for x in whole.collect() if x["claim_id"] in ("c0", "c4")}
    assert last["c4"]["status"] == "REVIEW_REQUIRED" and (tmp_path / "registry" / "snapshot=6").exists()
    assert spark.read.parquet(f"{registry}/snapshot=6").select("claim_id", "invoice_number").count() == 5
