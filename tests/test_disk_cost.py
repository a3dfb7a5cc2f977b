"""What a query leaves on the shared disk."""

import os

from pyspark.sql import functions as F

from claimsweep import catalog, staging
from claimsweep.plans import audit as A


def test_a_single_check_writes_no_wide_rows(spark, tmp_path, monkeypatch):
    orders = spark.range(1, 61).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7).alias("o_custkey"), F.lit(100.5).alias("o_totalprice"),
                                       F.lit("1997-03-01 00:00:00").cast("timestamp_ntz").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    x, names = catalog.Inputs(spark, str(tmp_path)), []
    for place in (catalog, A):
        kept = place.stage
        monkeypatch.setattr(place, "stage", lambda df, name, kept=kept: names.append(name) or kept(df, name))
    tools = ("date_range", "required_documents", "check_duplicate_invoice", "amount_match", "applicant_match")
    alone = [sorted(map(str, catalog.one_check(x, t).collect())) for t in tools]
    assert not {"facts", "document-facts"} & set(names)
    x.facts
    assert all(alone) and alone == [sorted(map(str, catalog.one_check(x, t).collect())) for t in tools]


def test_tables_on_the_way_to_a_stage_are_removed(spark):
    written = staging._written.setdefault(spark.sparkContext.applicationId, [])
    before = list(written)
    out = staging.stage_result(spark, lambda: staging.stage(spark.range(5), "on-the-way").where("id > 1"), "result")
    new = [p for p in written if p not in before]
    assert len(new) == 1 and "/result-" in new[0] and sorted(r[0] for r in out.collect()) == [2, 3, 4]
    folder = os.path.dirname(new[0].removeprefix("file://"))
    assert not [n for n in os.listdir(folder) if n.startswith("on-the-way-")]
