"""Risks from checks and documents, and what follows from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.materials import hard_level, injection_snippets
from ..rules import risks as R

RISK_COLUMNS = ("risk_type", "level", "reason", "evidence_refs", "policy_refs")


def severity(risk_type: Column, table=R.SEVERITY) -> Column:
    kind = F.upper(F.trim(risk_type))
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit(R.DEFAULT_LEVEL))


def risk(risk_type: Column, reason: Column, evidence_refs: Column, policy_refs: Column | None = None,
         level: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.upper(risk_type).alias("risk_type"), (severity(risk_type) if level is None else level).alias("level"),
        reason.alias("reason"), evidence_refs.alias("evidence_refs"),
        (none if policy_refs is None else policy_refs).alias("policy_refs"))


def needs_review(level: Column) -> Column:
    return level.isin(*R.REVIEW_LEVELS)


def level_action(level: Column) -> Column:
    actions = F.create_map(*[F.lit(x) for pair in R.LEVEL_ACTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(actions, level), F.lit(R.LEVEL_ACTIONS[R.DEFAULT_LEVEL]))


def check_risks(checks: Column, evidence: Column) -> Column:
    """Array of risks: every check that did not pass."""
    clause_ids = F.transform(evidence, lambda e: e["chunk_id"])
    none = F.array().cast("array<string>")
    return F.transform(
        F.filter(checks, lambda c: ~F.coalesce(c["passed"], F.lit(False))),
        lambda c: risk(
            F.when(c["passed"].isNull() & (c["name"] == "amount_match"), "AMOUNT_UNVERIFIABLE").otherwise(c["name"]),
            c["detail"], c["evidence_refs"], F.when(c["name"] == "hotel_limit", clause_ids).otherwise(none)))


def risk_build(checked: DataFrame) -> DataFrame:
    """``risks`` from the checks of wide claim rows; no shuffle."""
    return checked.select("claim_id", F.inline(check_risks(F.col("checks"), F.col("evidence"))))


def hard_region_risk(signals: DataFrame, used_documents: DataFrame) -> DataFrame:
    """Handwriting is for review; a hard document is only for information once it produced a field."""
    used = used_documents.select("claim_id", "document_id", F.lit(True).alias("used")).distinct()
    informative = (F.col("level") == "hard") & F.coalesce("used", F.lit(False))
    kind = F.when(F.col("level") == "handwriting", "HANDWRITING_REVIEW").otherwise("OCR_QUALITY_REVIEW")
    reason = F.concat("file_name", F.lit(" 含困难区域("), "level", F.lit(")，OCR 识别质量不足，建议人工核对原文"))
    r = risk(kind, reason, F.array("file_name"), level=F.when(informative, "INFO").otherwise(severity(kind)))
    return (signals.where("level <> 'normal'").join(used, ["claim_id", "document_id"], "left")
            .select("claim_id", "file_order", r.alias("r")).select("claim_id", "file_order", "r.*"))


def injection_risk(signals: DataFrame) -> DataFrame:
    """One HIGH risk per document with injected instructions; no check changes for it."""
    reason = F.concat("file_name", F.lit(" 含疑似指令注入文本（"), F.array_join("snippets", "、"),
                      F.lit("），已按不可信数据处理，需人工确认"))
    return (signals.where("size(snippets) > 0")
            .select("claim_id", "file_order",
                    risk(F.lit("PROMPT_INJECTION"), reason, F.array("file_name")).alias("r"))
            .select("claim_id", "file_order", "r.*"))


def level_counts(level: Column | str = "level") -> list[Column]:
    return [F.count_if(F.col(level) == lv).alias(f"n_{lv.lower()}") for lv in R.LEVELS]


def level_map(counts) -> Column:
    """``map<level,count>`` in fixed level order, zero levels omitted."""
    entries = F.array(*[F.struct(F.lit(lv).alias("key"), n.cast("int").alias("value")) for lv, n in counts.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def level_text(counts) -> Column:
    shown = [F.when(n > 0, F.concat(F.lit(f"{lv}:"), n.cast("string"))) for lv, n in counts.items()]
    return F.concat_ws(",", *shown)


def risk_level_summary(risks: DataFrame) -> DataFrame:
    counted = risks.groupBy("claim_id").agg(*level_counts())
    counts = {lv: F.col(f"n_{lv.lower()}") for lv in R.LEVELS}
    return counted.select("claim_id", level_map(counts).alias("level_counts"), level_text(counts).alias("level_text"))


def overall_status(n_high: Column, n_medium: Column) -> Column:
    return F.when(n_high + n_medium > 0, "REVIEW_REQUIRED").otherwise("PASS")
