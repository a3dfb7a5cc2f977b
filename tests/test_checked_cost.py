"""What the checked claims of an audit carry."""

import pytest
from pyspark.sql import functions as F

from claimsweep.operators import policy
from claimsweep.plans.audit import audit


@pytest.mark.parametrize("published", [False, True])
def test_checked_claims_carry_values_only(spark, published):
    claims = spark.createDataFrame([("a", "1997-03-01 00:00:00", "研发部")], "claim_id string, submitted_at string, department string")
    claims = claims.withColumn("submitted_at", F.col("submitted_at").cast("timestamp_ntz"))
    pages = spark.createDataFrame([("a", 1, "d1", "invoice.txt", 1, "发票号码：INV-00001\n发票金额：500.00\n出差城市：北京\n")],
                                  "claim_id string, file_order int, document_id string, file_name string, page_no int, text string")
    clauses = spark.createDataFrame(
        [(f"P{i}", t, "北京的住宿标准为300元/晚。", t) for i, t in enumerate(("MEDICAL", "", "TRAVEL"))],
        "chunk_id string, ord string, content string, expense_type string").select(
            "*", F.lit("p").alias("policy_id"), F.lit("4").alias("section_path"), F.lit("V1").alias("version"), F.lit("ALL").alias("department"),
            F.lit("").alias("effective_from"), F.lit("").alias("effective_to"))
    run = audit(claims, pages, policy.baseline_chunks(spark), clauses if published else None)
    row = run.claims.first()
    assert run.claims.schema["f_invoice_amount"].dataType.names == ["value"]
    assert row["f_invoice_amount"]["value"] == "500.00" and row["f_payment_amount"] is None
    wanted = {"P1", "P2"} if published else {"TRAVEL-V1-4.2-A"}  # a clause without a type holds for all, one of another type does not
    assert {e["chunk_id"] for e in row["evidence"]} == wanted
