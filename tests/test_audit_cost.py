"""What the audit opens of structured responses."""

import json

from pyspark.sql import functions as F

from claimsweep import catalog
from claimsweep.operators import merge
from claimsweep.sources import synth


def test_several_levels_are_opened_in_one_pass(spark, monkeypatch):
    staged = []
    kept = merge.stage
    monkeypatch.setattr(merge, "stage", lambda df, name: staged.append(name) or kept(df, name))

    def wrapped(value, depth):
        return value if depth == 0 else {"word": wrapped(value, depth - 1)}

    items = [[{"text": "甲"}], [], [{"value": {"word": "乙"}}], "丙"]
    bodies = [("c%d" % n, json.dumps({"words_result": {"InvoiceNum": "N%d" % n, "PurchaserName": wrapped("甲", n)}})) for n in range(10)]
    bodies += [("list", json.dumps({"words_result": {"PurchaserName": items, "InvoiceNum": {"other": "x"}}})), ("none", None), ("bad", "{")]
    rows = merge.structured_response_fields(spark.createDataFrame(bodies, "claim_id string, body string")).collect()
    got = {(r["claim_id"], r["name"]): r["value"] for r in rows}
    wanted = {(f"c{n}", "invoice_number"): f"N{n}" for n in range(10)} | {(f"c{n}", "invoice_buyer"): "甲" for n in range(10)}
    assert got == wanted | {("list", "invoice_buyer"): "甲 乙 丙"} and len(rows) == len(got)
    assert len(staged) == 3  # nine levels, four in a pass


def test_only_scanned_responses_are_opened_for_the_audit(spark, tmp_path, monkeypatch):
    orders = spark.range(1, 41).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7).alias("o_custkey"), F.lit(100.5).alias("o_totalprice"),
                                       F.lit("1997-03-01 00:00:00").cast("timestamp_ntz").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    x = catalog.Inputs(spark, str(tmp_path))
    asked = []
    whole = merge.structured_response_fields
    monkeypatch.setattr(merge, "structured_response_fields", lambda df: asked.append(df.count()) or whole(df))
    got = sorted(map(tuple, x.scanned.select("claim_id", "name", "value").collect()))
    assert asked == [x.claims.where("k % 4 = 2").count()]
    every = x.api.join(synth.scanned(x.claims), "claim_id", "left_semi")
    assert got and got == sorted(map(tuple, every.select("claim_id", "name", "value").collect()))
