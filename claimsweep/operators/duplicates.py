"""Duplicate invoices against everything registered before, and the registry itself."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null

REGISTRY_KEY = ("claim_id", "invoice_number")


def registry_rows(claims: DataFrame) -> DataFrame:
    """What a finished claim registers, whatever its verdict; no number, no row."""
    return claims.select(
        "claim_id", blank_to_null(F.col("invoice_number")).alias("invoice_number"),
        blank_to_null(F.col("invoice_date")).alias("invoice_date"),
        blank_to_null(F.col("invoice_amount")).alias("invoice_amount"),
        F.col("submitted_at").alias("created_at"),
    ).where("invoice_number is not null")


def registry_upsert(registry: DataFrame, new_rows: DataFrame) -> DataFrame:
    """One row per (claim, number): the latest registration replaces earlier ones."""
    return registry_latest(registry.unionByName(new_rows))


def registry_latest(rows: DataFrame) -> DataFrame:
    record = F.struct("created_at", "invoice_date", "invoice_amount")
    return (
        rows.groupBy(*REGISTRY_KEY).agg(F.max(record).alias("r"))
        .select("claim_id", "invoice_number", "r.invoice_date", "r.invoice_amount", "r.created_at")
    )


def earliest_lookup(registry: DataFrame) -> DataFrame:
    """Earliest registration per number alone and per number with date, amount or both.

    ``mode`` says which of date (1) and amount (2) belong to the key. Minima combine map-side, so a
    number that holds a large share of the registry costs one row per task. Numbers registered once
    are left out: their only record is the claim's own.
    """
    first = F.struct(F.col("created_at"), F.col("claim_id"), F.col("invoice_date"), F.col("invoice_amount"))
    fine = registry.groupBy("invoice_number", "invoice_date", "invoice_amount").agg(
        F.min(first).alias("first"), F.count("*").alias("n"))
    repeated = fine.groupBy("invoice_number").agg(F.sum("n").alias("total")).where("total > 1")
    dated, priced = F.col("mode").bitwiseAND(1) == 1, F.col("mode").bitwiseAND(2) == 2
    keyed = (
        fine.join(repeated, "invoice_number", "left_semi")
        .select("*", F.explode(F.array(*[F.lit(m) for m in range(4)])).alias("mode"))
        .where((~dated | F.col("invoice_date").isNotNull()) & (~priced | F.col("invoice_amount").isNotNull()))
    )
    return (
        keyed.groupBy("mode", "invoice_number",
                      F.when(dated, F.col("invoice_date")).otherwise("").alias("key_date"),
                      F.when(priced, F.col("invoice_amount")).otherwise("").alias("key_amount"))
        .agg(F.min("first").alias("first"))
    )


def duplicate_hits(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """``(claim_id, dup_exact, dup_any)`` of claims with an earlier record of another claim, and no others.

    ``registry`` holds one row per (claim, number), each claim's own among them. Since the earliest
    record of a key precedes all others, it is either the claim's own (then nothing came before) or
    the answer, so no pair of claims is ever formed. Only the compared values travel; each claim asks
    one lookup table twice, by number and by all that it has.
    """
    number, date, amount = (blank_to_null(F.col(c)) for c in ("invoice_number", "invoice_date", "invoice_amount"))
    mode = date.isNotNull().cast("int") + amount.isNotNull().cast("int") * 2

    def key(kind: Column, day: Column, price: Column) -> Column:
        return F.struct(kind.alias("mode"), day.alias("key_date"), price.alias("key_amount"))

    none = F.lit("")
    asked = claims.select(
        "claim_id", "submitted_at", number.alias("invoice_number"), mode.alias("own_mode"),
        F.explode(F.array_distinct(F.array(key(F.lit(0), none, none), key(
            mode, F.coalesce(date, none), F.coalesce(amount, none))))).alias("key")).where("invoice_number is not null")
    asked = asked.select("claim_id", "submitted_at", "invoice_number", "own_mode", "key.*")
    found = asked.join(earliest_lookup(registry), ["mode", "invoice_number", "key_date", "key_amount"])
    found = found.where((F.col("first.claim_id") != F.col("claim_id")) & (
        F.struct(F.col("first.created_at"), F.col("first.claim_id")) < F.struct(F.col("submitted_at"), F.col("claim_id"))))
    return found.groupBy("claim_id").agg(
        F.max(F.when(F.col("mode") == F.col("own_mode"), F.col("first"))).alias("dup_exact"),
        F.max(F.when(F.col("mode") == 0, F.col("first"))).alias("dup_any"))


def with_duplicate_hits(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``dup_exact`` and ``dup_any``: the first earlier record of another claim, if there is one."""
    number, date, amount = (blank_to_null(F.col(c)) for c in ("invoice_number", "invoice_date", "invoice_amount"))
    return claims.join(duplicate_hits(claims, registry), "claim_id", "left").select(
        *claims.columns, number.alias("clean_number"), date.alias("clean_date"), amount.alias("clean_amount"),
        "dup_exact", "dup_any")


def duplicate_check(check) -> Column:
    """The check struct over the columns of :func:`with_duplicate_hits`."""
    number, date, amount = F.col("clean_number"), F.col("clean_date"), F.col("clean_amount")
    exact, other = F.col("dup_exact"), F.col("dup_any")
    shown = lambda c: F.coalesce(c, F.lit("未知"))
    matched = F.concat(
        F.lit("发票号码"), F.when(date.isNotNull(), "、开票日期").otherwise(""),
        F.when(amount.isNotNull(), "、金额").otherwise(""))
    return (
        F.when(number.isNull(), check("duplicate_invoice", F.lit(True), F.lit("材料未提供发票号码，重复发票检查跳过"), []))
        .when(exact.isNotNull(), check(
            "duplicate_invoice", F.lit(False),
            F.concat(F.lit("重复发票：号码"), number, F.lit("已由任务"), exact["claim_id"],
                     F.lit("提交（命中字段："), matched, F.lit("）")),
            ["invoice_number", "invoice_date", "invoice_amount"]))
        .when(other.isNotNull(), check(
            "invoice_number_conflict", F.lit(False),
            F.concat(F.lit("发票号码"), number, F.lit("与任务"), other["claim_id"],
                     F.lit("的历史记录相同，但开票日期或金额不一致（历史："), shown(other["invoice_date"]), F.lit("/"),
                     shown(other["invoice_amount"]), F.lit("，本次："), shown(date), F.lit("/"), shown(amount),
                     F.lit("），需人工核实")),
            ["invoice_number"]))
        .otherwise(check("duplicate_invoice", F.lit(True),
                         F.concat(F.lit("发票号码"), number, F.lit("未命中历史记录")), ["invoice_number"]))
    )
