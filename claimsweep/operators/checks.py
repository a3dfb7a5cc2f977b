"""The six deterministic checks, as column expressions over a wide claim row.

A wide row has one ``f_<field>`` struct per field (see :mod:`.extract`), the material flags
``has_<type>``, the clause array ``evidence`` and the duplicate columns of :mod:`.duplicates`.
"""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..functions.values import MONEY, amount_parse, date_parse
from ..rules import materials as M
from ..rules import policies as P
from ..rules import risks as R
from .duplicates import duplicate_check

CHECK_TYPE = "struct<name:string,passed:boolean,detail:string,evidence_refs:array<string>>"


def check(name, passed: Column, detail: Column, refs) -> Column:
    """One check result; ``refs`` is a list of literals or columns, or an array column."""
    if not isinstance(refs, Column):
        refs = F.array(*[r if isinstance(r, Column) else F.lit(r) for r in refs])
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), passed.cast("boolean").alias("passed"), detail.alias("detail"),
                    refs.cast("array<string>").alias("evidence_refs"))


def value(field: str) -> Column:
    return F.col(f"f_{field}.value")


#: inputs parsed once per claim, in a projection of their own, before the checks use them repeatedly
PARSED = {
    "p_invoice_amount": ("invoice_amount", amount_parse),
    "p_payment_amount": ("payment_amount", amount_parse),
    "p_invoice_date": ("invoice_date", date_parse),
    "p_travel_start": ("travel_start_date", date_parse),
    "p_travel_end": ("travel_end_date", date_parse),
    "p_person": ("applicant_name", blank_to_null),
    "p_buyer": ("invoice_buyer", blank_to_null),
    "p_payee": ("payment_party", blank_to_null),
}


def _none() -> Column:
    return F.lit(None)


def required_documents() -> Column:
    missing = F.array_compact(F.array(*[
        F.when(~F.col(f"has_{kind}"), label) for kind, label in M.MATERIAL_LABELS.items()]))
    complete = F.size(missing) == 0
    return check("required_documents", complete,
                 F.when(complete, "材料齐全").otherwise(F.concat(F.lit("缺少："), F.array_join(missing, "、"))), [])


def amount_match() -> Column:
    a, b = F.col("p_invoice_amount"), F.col("p_payment_amount")
    gap = (a - b).cast(MONEY)
    text = F.concat(F.lit("发票"), a.cast("string"), F.lit("元，付款"), b.cast("string"),
                    F.lit("元，差额"), gap.cast("string"), F.lit("元"))
    return (F.when(a.isNull() | b.isNull(), check("amount_match", _none(), F.lit("金额字段缺失或无效"), []))
            .otherwise(check("amount_match", gap == 0, text, ["invoice_amount", "payment_amount"])))


def date_range() -> Column:
    day, start, end = F.col("p_invoice_date"), F.col("p_travel_start"), F.col("p_travel_end")
    text = F.concat(F.lit("发票日期"), day.cast("string"), F.lit("，出差时间"), start.cast("string"),
                    F.lit("至"), end.cast("string"))
    return (
        F.when(day.isNull() | start.isNull() | end.isNull(),
               check("date_range", _none(), F.lit("日期字段缺失或无效"), []))
        .when(start > end, check("date_range", _none(), F.lit("出差开始日期晚于结束日期"), []))
        .otherwise(check("date_range", day.between(start, end), text,
                         ["invoice_date", "travel_start_date", "travel_end_date"])))


def hotel_limit() -> Column:
    clause = F.try_element_at(F.col("evidence"), F.lit(1))
    paid, limit = F.col("p_invoice_amount"), F.col("p_limit")
    over = F.greatest((paid - limit).cast(MONEY), F.lit(0).cast(MONEY))
    text = F.concat(F.lit("示例按一晚计算：实际"), paid.cast("string"), F.lit("元，上限"), limit.cast("string"),
                    F.lit("元，超出"), over.cast("string"), F.lit("元"))
    return (
        F.when(clause.isNull(), check("rule_missing", _none(),
                                      F.lit("未检索到适用的住宿标准条款，缺少规则依据，需人工确认"), []))
        .when(paid.isNull(), check("hotel_limit", _none(), F.lit("缺少住宿金额或适用制度"), []))
        .when(limit.isNull(), check("hotel_limit", _none(), F.lit("制度条款中未找到可计算上限"), []))
        .otherwise(check("hotel_limit", paid <= limit, text, ["invoice_amount", clause["chunk_id"]])))


def applicant_match() -> Column:
    person = F.col("p_person")
    parties = [("发票购买方", "invoice_buyer", F.col("p_buyer")), ("付款收款方", "payment_party", F.col("p_payee"))]
    refs = F.array_compact(F.array(F.lit("applicant_name"), *[F.when(p.isNotNull(), ref) for _, ref, p in parties]))
    none_present = F.col("p_buyer").isNull() & F.col("p_payee").isNull()
    differs = [F.when(p != person, F.concat(F.lit(label), p)) for label, _, p in parties]
    labels = F.concat_ws("、", *[F.when(p.isNotNull(), label) for label, _, p in parties])
    return (
        F.when(person.isNull(), check("applicant_match", _none(), F.lit("缺少申请人字段"), []))
        .when(none_present, check("applicant_match", F.lit(True),
                                  F.lit("材料未包含购买方或收款方主体信息，主体一致性检查跳过"), ["applicant_name"]))
        .when(F.coalesce(*differs).isNotNull(), check(
            "applicant_match", F.lit(False),
            F.concat(F.lit("申请人"), person, F.lit(" 与 "), F.concat_ws("、", *differs), F.lit(" 不一致")), refs))
        .otherwise(check("applicant_match", F.lit(True),
                         F.concat(F.lit("申请人"), person, F.lit(" 与 "), labels, F.lit(" 一致")), refs)))


@dataclass(frozen=True)
class CheckSpec:
    """A registered check: what it needs and how its result column is built."""

    name: str
    category: str
    inputs: tuple[str, ...]
    build: Callable[[], Column]


REGISTRY = {spec.name: spec for spec in (
    CheckSpec("required_documents", "document", ("document_names", "material_types"), required_documents),
    CheckSpec("amount_match", "amount", ("invoice_amount", "payment_amount"), amount_match),
    CheckSpec("date_range", "date", ("invoice_date", "travel_start_date", "travel_end_date"), date_range),
    CheckSpec("hotel_limit", "policy", ("invoice_amount", "policy_evidence"), hotel_limit),
    CheckSpec("applicant_match", "document", ("applicant_name", "invoice_buyer", "payment_party"), applicant_match),
    CheckSpec("check_duplicate_invoice", "database",
              ("invoice_number", "invoice_date", "invoice_amount", "task_id"), lambda: duplicate_check(check)),
)}


def get_check(name: str) -> CheckSpec:
    if name not in REGISTRY:
        raise ValueError(f"unknown check: {name}")
    return REGISTRY[name]


def with_parsed(wide: DataFrame, evidence: bool = True) -> DataFrame:
    """Adds the parsed inputs of the checks, of the fields that the rows have: some checks need none."""
    parsed = wide.select("*", *[parse(value(n)).alias(name) for name, (n, parse) in PARSED.items() if f"f_{n}" in wide.columns])
    if not evidence:
        return parsed
    limit = F.regexp_extract(F.try_element_at(F.col("evidence"), F.lit(1))["content"], "(?U)" + P.NIGHTLY_LIMIT, 1)
    return parsed.withColumn("p_limit", amount_parse(limit))


def with_checks(wide: DataFrame, names=tuple(REGISTRY)) -> DataFrame:
    """Adds ``checks``, the results in registry order."""
    parsed = with_parsed(wide, "hotel_limit" in names)
    return parsed.select(*wide.columns, F.array(*[get_check(n).build() for n in names]).alias("checks"))


def check_readiness(wide: DataFrame) -> DataFrame:
    """The planned steps of every claim: which inputs are missing and whether the step may end open."""
    has_evidence = F.size("evidence") > 0

    def step(order, tool, needs):
        missing = F.array_compact(F.array(*[
            F.when(~(has_evidence if n == "policy_evidence" else F.col(f"f_{n}").isNotNull()), n) for n in needs]
        )).cast("array<string>") if needs else F.array().cast("array<string>")
        note = F.concat(F.lit(f"{tool} 缺少字段 "), F.array_join(missing, "、"), F.lit("，该步可能无结论"))
        return F.struct(
            F.lit(order).alias("step_order"), F.lit(f"check_{tool}").alias("step_name"), F.lit(tool).alias("tool"),
            F.lit(R.PLAN_REASONS[tool]).alias("reason"), (F.size(missing) == 0).alias("required"),
            (F.size(missing) > 0).alias("may_skip"), F.when(F.size(missing) > 0, note).alias("note"))

    steps = [step(i, t, needs) for i, (t, needs) in enumerate(R.PLAN_STEPS.items(), 1) if t in REGISTRY]
    return wide.select("claim_id", F.inline(F.array(*steps)))
