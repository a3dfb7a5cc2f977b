"""Expected against actual outcomes, and the metrics over them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import ratio
from ..staging import stage


def case_compare(cases: DataFrame, actual: DataFrame) -> DataFrame:
    """Case results. ``cases(case_id, expected_status, expected_risks, expected_policy_refs,
    expected_fields, expected_tools, category)`` meet ``actual(case_id, status, risks, policy_refs,
    fields, tools, tool_total, tool_passed, tool_skipped, duration_ms, error)`` by ``case_id``.
    """
    j = cases.join(actual, "case_id", "left")
    none = F.array().cast("array<string>")
    expected_risks = F.array_sort(F.array_distinct("expected_risks"))
    failed = F.col("error").isNotNull() | F.col("status").isNull()
    got = lambda c: F.when(failed, none).otherwise(F.array_sort(F.array_distinct(F.coalesce(c, none))))
    risks, refs = got(F.col("risks")), got(F.col("policy_refs"))
    wrong_fields = F.when(failed, F.map_from_arrays(none, none)).otherwise(F.map_filter(
        "expected_fields", lambda k, v: ~F.coalesce(F.try_element_at("fields", k) == v, F.lit(False))))
    r = j.select(
        "case_id", "category", "expected_status", F.when(failed, "ERROR").otherwise(F.col("status")).alias("actual_status"),
        expected_risks.alias("expected_risks"), risks.alias("actual_risks"),
        F.array_sort(F.array_except("expected_policy_refs", refs)).alias("missing_policy_refs"),
        F.array_sort(F.map_keys(wrong_fields)).alias("wrong_fields"),
        F.when(failed, 0).otherwise(F.col("tool_total")).alias("tool_total"),
        F.when(failed, 0).otherwise(F.col("tool_passed")).alias("tool_passed"),
        F.when(failed, 0).otherwise(F.col("tool_skipped")).alias("tool_skipped"),
        F.when(~failed & (F.size("expected_tools") > 0),
               F.size(F.array_except(F.transform("expected_tools", lambda t: F.lower(t)), "tools")) == 0).alias("tools_selected"),
        F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"),
        F.when(failed, F.coalesce("error", F.lit("no result"))).alias("error"))
    r = r.select("*", F.array_except("expected_risks", "actual_risks").alias("missing_risks"),
                 F.array_except("actual_risks", "expected_risks").alias("unexpected_risks"))
    passed = (F.col("error").isNull() & (F.col("expected_status") == F.col("actual_status")) & (F.size("missing_risks") == 0)
              & (F.size("unexpected_risks") == 0) & (F.size("wrong_fields") == 0) & (F.size("missing_policy_refs") == 0))
    return r.select("*", passed.alias("passed"))


LATENCIES = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95, "latency_max_ms": 1.0}


def eval_metrics(results: DataFrame) -> DataFrame:
    """One row of metrics over case results: one aggregation, and the percentiles of their durations."""
    results = stage(results, "case-results")
    one = nearest_rank_percentile(results.select(F.lit("all").alias("key"), "duration_ms"), "key", "duration_ms", LATENCIES)
    scores = _scores(results)
    return scores.withColumn("key", F.lit("all")).join(one, "key", "left").select(
        *scores.columns, *[F.coalesce(name, F.lit(0.0)).alias(name) for name in LATENCIES])


def _scores(results: DataFrame) -> DataFrame:
    n_true = lambda c: F.count_if(c)
    sums = results.agg(
        F.count("*").alias("total"), n_true(F.col("passed")).alias("ok"),
        n_true(F.col("expected_status") == F.col("actual_status")).alias("status_ok"),
        n_true((F.size("missing_risks") == 0) & (F.size("unexpected_risks") == 0)).alias("risks_ok"),
        n_true(F.size("wrong_fields") == 0).alias("fields_ok"), n_true(F.size("missing_policy_refs") == 0).alias("refs_ok"),
        F.sum(F.size(F.array_intersect("expected_risks", "actual_risks"))).alias("tp"),
        F.sum(F.size("unexpected_risks")).alias("fp"), F.sum(F.size("missing_risks")).alias("fn"),
        F.sum("tool_total").alias("tools"), F.sum("tool_passed").alias("tools_ok"), F.sum("tool_skipped").alias("tools_open"),
        F.count("tools_selected").alias("declared"), n_true(F.col("tools_selected")).alias("selected"),
        n_true(F.col("actual_status") == "REVIEW_REQUIRED").alias("review"),
        n_true(F.col("error").isNotNull()).alias("errors"),
        n_true(F.coalesce(F.col("error").contains("max_steps"), F.lit(False))).alias("loops"))
    c = F.col
    m = sums.select(
        c("total").alias("total_cases"), c("ok").alias("passed_cases"), (c("total") - c("ok")).alias("failed_cases"),
        ratio(c("ok"), c("total")).alias("pass_rate"), ratio(c("status_ok"), c("total")).alias("status_accuracy"),
        ratio(c("risks_ok"), c("total")).alias("risk_accuracy"), ratio(c("fields_ok"), c("total")).alias("field_accuracy"),
        ratio(c("refs_ok"), c("total")).alias("policy_ref_accuracy"),
        ratio(c("tp"), c("tp") + c("fp")).alias("risk_precision"), ratio(c("tp"), c("tp") + c("fn")).alias("risk_recall"),
        ratio(c("tools_ok"), c("tools") - c("tools_open")).alias("tool_success_rate"),
        c("tools_open").alias("tool_skipped_total"), ratio(c("tools_open"), c("tools")).alias("tool_param_missing_rate"),
        F.when(c("declared") > 0, ratio(c("selected"), c("declared"))).alias("tool_selection_accuracy"),
        c("tools").alias("tool_calls_total"), ratio(c("review"), c("total")).alias("review_rate"),
        ratio(c("loops"), c("total")).alias("dead_loop_rate"), c("errors").alias("error_cases"))
    both = c("risk_precision") + c("risk_recall")
    return m.withColumn("risk_f1", F.when(both > 0, F.bround(2 * c("risk_precision") * c("risk_recall") / both, 4)).otherwise(0.0))


def category_breakdown(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed_cases"))


#: Ranges that a round divides a range into, and values of a range that are listed one by one.
RANGES, LISTED = 1 << 16, 50_000
#: Bits of the ordered image, and of the part of it below the exponent.
IMAGE, FRACTION = 63, 50


def ordered_image(v: Column) -> Column:
    """A whole number from 0 to 2**63 - 1 that never falls as ``v`` rises: sign, exponent and leading bits of a double.

    Values that differ in their last bits only, or by rounding at a power of two, may share a number. NaN is last.
    """
    a = F.abs(v)
    e = F.when(a == float("inf"), 1024).otherwise(F.greatest(F.least(F.floor(F.log2(a)), F.lit(1024)), F.lit(-1075))).cast("int")
    half = F.floor(e / 2)
    scaled = F.when(a == float("inf"), 1.0).otherwise(a * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), -(e - half)))
    low = F.least(F.greatest(F.floor((scaled - 1) * float(1 << FRACTION)), F.lit(0)), F.lit((1 << FRACTION) - 1))
    size = F.shiftleft((e + 1076).cast("long"), FRACTION) + low.cast("long")
    image = F.when(a == 0, F.lit(0).cast("long")).when(v < 0, -size).otherwise(size) + F.lit(1 << (IMAGE - 1))
    return F.when(F.isnan(v), F.lit((1 << IMAGE) - 1)).otherwise(image)


def nearest_rank_percentile(values: DataFrame, key: str, value: str, quantiles, ranges: int = RANGES,
                            listed: int = LISTED) -> DataFrame:
    """The element at the half-even rounded rank ``q * (n - 1)`` per key, one decimal; ``n`` values that are not null.

    Radix selection: a round counts values by the next leading bits of their ordered image (as many as tell ``ranges``
    apart), which says under which bits each wanted rank lies, and only values there go on. Counts combine map-side and rounds depend on the bits
    alone, so one value far off the others changes nothing. Rounds end when no wanted range holds more than ``listed``
    values, or no bit is left; then equal values are counted together and few different ones are put in order.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    rows = stage(rows.withColumn("image", ordered_image(F.col("v"))), "percentile-values")
    ends = stage(rows.groupBy("k").agg(F.count("*").alias("n")), "percentile-keys")
    # what is asked: the rank inside the range of those images that start with ``head``
    asked = ends.select("k", F.col("n").alias("size"), F.lit(0).cast("long").alias("head"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.bround(F.lit(q) * (F.col("n") - 1)).cast("bigint").alias("rank"))
        for name, q in quantiles.items()])).alias("a")).select("k", "head", "size", "a.*")
    left = IMAGE
    while left and (asked.agg(F.max("size")).first()[0] or 0) > listed:
        step = min(max(1, ranges.bit_length() - 1), left)
        inside = _in_ranges(rows, asked, left)
        left -= step
        counts = inside.groupBy("k", "head", F.shiftright("image", left).alias("next")).agg(F.count("*").alias("c"))
        asked = stage(_narrowed(counts, asked, "next", F.col("c")).select(
            "k", F.col("next").alias("head"), F.col("c").alias("size"), "name", "rank"), "percentile-ranges")
    counts = _in_ranges(rows, asked, left).groupBy("k", "head", "v").agg(F.count("*").alias("c"))
    found = _narrowed(counts, asked, "v", F.col("c"))
    picks = [F.bround(F.max(F.when(F.col("name") == name, F.col("v"))), 1).alias(name) for name in quantiles]
    out = found.groupBy("k").agg(*picks).withColumnRenamed("k", "k_")
    return ends.join(out, F.col("k").eqNullSafe(F.col("k_"))).select(F.col("k").alias(key), "n", *quantiles)


def _in_ranges(rows: DataFrame, asked: DataFrame, left: int) -> DataFrame:
    """The values in ranges that are asked for; ``left`` bits of the images are not looked at yet."""
    wanted = asked.select(F.col("k").alias("k_"), F.col("head").alias("head_")).distinct()
    head = rows.withColumn("head", F.shiftright("image", left) if left < IMAGE else F.lit(0).cast("long"))
    return head.join(wanted, F.col("k").eqNullSafe(F.col("k_")) & (F.col("head") == F.col("head_")), "left_semi")


def _narrowed(counts: DataFrame, asked: DataFrame, by: str, n: Column) -> DataFrame:
    """For each rank asked inside (k, head): the part ``by`` that holds it, and its rank inside that part."""
    before = W.partitionBy("k", "head").orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = counts.withColumn("upto", F.sum(n).over(before))
    ranks = asked.select(F.col("k").alias("k_"), F.col("head").alias("head_"), "name", "rank")
    met = upto.join(ranks, F.col("k").eqNullSafe(F.col("k_")) & (F.col("head") == F.col("head_")))
    met = met.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - n))
    return met.withColumn("rank", F.col("rank") - F.col("upto") + n)


def field_compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Outcome per (case, field): matched, missing, unexpected or wrong."""
    e = expected.select("case_id", "name", F.col("value").alias("expected"))
    a = actual.select("case_id", "name", F.col("value").alias("actual"))
    outcome = (F.when(F.col("expected").isNull(), "unexpected").when(F.col("actual").isNull(), "missing")
               .when(F.col("expected") == F.col("actual"), "matched").otherwise("wrong"))
    return e.join(a, ["case_id", "name"], "full").select("case_id", "name", "expected", "actual", outcome.alias("outcome"))


def candidate_metrics(parsed: DataFrame, validated: DataFrame) -> DataFrame:
    """Counts per error and rejection class, accepted and refused fields, and runs that fell back."""
    accepted = validated.groupBy("claim_id").agg(
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
        *[F.count_if(F.col("reject_class") == k).alias(k) for k in (
            "low_confidence", "source_text_not_found", "missing_source_text", "unknown_field", "invalid_format")],
        F.count("reject_reason").alias("rejected"))
    j = parsed.select("claim_id", "error_type").join(accepted, "claim_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    is_error = lambda k: F.count_if(F.col("error_type") == k)
    return j.agg(
        F.count("*").alias("total_cases"), F.count_if(F.coalesce("accepted", F.lit(0)) == 0).alias("fallback_cases"),
        is_error("json_format_error").alias("json_format_errors"),
        is_error("schema_validation_error").alias("schema_validation_errors"),
        is_error("model_call_error").alias("model_call_errors"),
        total("low_confidence").alias("low_confidence_rejections"),
        total("source_text_not_found").alias("hallucinated_evidence_rejections"),
        total("missing_source_text").alias("missing_source_text_rejections"),
        total("unknown_field").alias("unknown_field_rejections"), total("invalid_format").alias("invalid_format_rejections"),
        total("accepted").alias("accepted_field_count"), total("rejected").alias("rejected_field_count"))


def retrieval_hit_rate(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of cases whose expected clauses are all among their hits; cases without any are left out."""
    found = hits.groupBy("case_id").agg(F.collect_set("chunk_id").alias("found"))
    j = cases.join(found, "case_id", "left").select(
        F.size("expected_policy_refs").alias("wanted"),
        F.size(F.array_except("expected_policy_refs", F.coalesce("found", F.array().cast("array<string>")))).alias("missing"))
    declared = F.count_if(F.col("wanted") > 0)
    hit = F.count_if((F.col("wanted") > 0) & (F.col("missing") == 0))
    return j.agg(F.count("*").alias("total_cases"), declared.alias("evaluated_cases"), hit.alias("passed_cases"),
                 (declared - hit).alias("failed_cases"), ratio(hit, declared).alias("hit_rate"))
