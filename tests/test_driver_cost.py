"""What the driver has to hold for the clauses of an audit: small plans, and no rows of generators gathered for a broadcast."""

from pyspark.sql import functions as F

from claimsweep.operators import policy
from claimsweep.plans import audit


def lines(df):
    return df._jdf.queryExecution().sparkPlan().toString().splitlines()


def published(spark):
    rows = [(f"P{i:03d}", t, f"{city}的住宿标准为{300 + i}元/晚。", d) for i, (t, city, d) in enumerate(
        (t, city, d) for t in ("MEDICAL", "", "TRAVEL") for city in ("北京", "上海") for d in ("ALL", "研发部"))]
    return spark.createDataFrame(rows, "chunk_id string, expense_type string, content string, department string").select(
        "*", F.col("chunk_id").alias("ord"), F.lit("4").alias("section_path"), F.lit("p").alias("policy_id"), F.lit("V1").alias("version"),
        F.lit("").alias("effective_from"), F.lit("").alias("effective_to"))


def test_days_at_their_nodes_are_not_broadcast(spark):
    asked = spark.createDataFrame([("北京", "研发部", "1997-03-01", "TRAVEL")], "city string, department string, as_of string, expense_type string")
    for found, wanted in ((policy.named_in_force(asked, published(spark), 3), 4), (policy.applicable_chunks(asked, published(spark)), 8)):
        assert found.count() == wanted
        assert not [x for x in lines(found) if "BroadcastHashJoin" in x and "node#" in x]


def test_clauses_are_found_by_plans_of_few_steps(spark, monkeypatch):
    steps, kept = {}, audit.stage
    monkeypatch.setattr(audit, "stage", lambda df, name: steps.update({name: len(lines(df))}) or kept(df, name))
    facts = spark.createDataFrame([("a", "TRAVEL", "北京", "研发部", "1997-03-01"), ("b", "MEDICAL", None, None, "1997-03-02"), ("c", "TRAVEL", None, "ALL", None)],
                                  "claim_id string, expense_type string, city string, department string, as_of string")
    found = audit.with_evidence(facts, policy.baseline_chunks(spark), published(spark))
    steps["attached"] = len(lines(found))
    got = {r["claim_id"]: [e["chunk_id"] for e in r["evidence"]] for r in found.collect()}
    assert got["a"][:1] == ["P004"] and got["c"] == [] and "P000" in got["b"]
    assert max(steps.values()) < 400, steps
