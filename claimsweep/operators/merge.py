"""Field values from other sources, and their merge by precedence."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import blank_to_null, error_class, json_object, reply_parts, strip, unparsable
from ..functions.values import model_amount, model_date, value_normalize
from ..rules import fields as R
from ..staging import stage
from .extract import API, FIELDS, MODEL, RULES, field_struct

REPLY_SCHEMA = "struct<fields:map<string,struct<value:string,confidence:double,source_text:string,page_no:int>>>"


# ---------------------------------------------------------------- structured responses

def _nested(kind: Column) -> Column:
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def _member(keys) -> Column:
    """The first non-empty wrapper member of an object."""
    return F.coalesce(*[F.when(F.try_variant_get("v", f"$.{key}", "string") != "", F.try_variant_get("v", f"$.{key}", "variant"))
                        for key in keys])


def _unwrapped(rows: DataFrame, keys) -> DataFrame:
    """One level of wrapper objects opened where they stand: a row stays a row, and what is no object is not looked at."""
    wrapped = F.col("kind").startswith("OBJECT")
    rows = rows.select("claim_id", "name", "path", "kind", F.when(wrapped, _member(keys)).otherwise(F.col("v")).alias("v"))
    return rows.withColumn("kind", F.when(wrapped, F.schema_of_variant("v")).otherwise(F.col("kind")))


def _opened(rows: DataFrame, keys) -> DataFrame:
    """One level of every nested value opened: an object's first non-empty wrapper member, a list's items in order.

    Values that are marked as plain stay as they are, without another look.
    """
    kind, item = F.schema_of_variant("v"), lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    items = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x, i: item(F.concat("path", F.array(i)), x))
    inner = F.when(~F.col("nested"), F.array(item(F.col("path"), F.col("v")))).when(kind.startswith("ARRAY"), items).otherwise(
        F.array(item(F.col("path"), _member(keys))))
    opened = rows.select("claim_id", "name", "nested", inner.alias("inner"))  # computed in a projection, not inside the generator
    opened = opened.select("claim_id", "name", "nested", F.inline("inner")).where("v is not null")
    return opened.withColumn("nested", F.when(F.col("nested"), _nested(F.schema_of_variant("v"))).otherwise(False))


#: So many levels of nested values are opened in one pass over the rows; what is open already stays as it is.
LEVELS_A_PASS = 4


def structured_response_fields(responses: DataFrame, field_map=None, container: str = R.API_FIELDS_PATH,
                               keys=R.API_WRAPPER_KEYS) -> DataFrame:
    """``(claim_id, name, value)`` from JSON responses: path walk, wrapper removal, normal form.

    Wrappers and lists are opened level by level until no value holds another, however deep: one job for every
    ``LEVELS_A_PASS`` levels that the data have, over the values that are nested still. The first pass opens wrappers alone,
    which makes no rows; lists are left to the next ones. The parts of lists keep their order.
    """
    field_map = field_map or R.API_FIELD_MAP
    parsed = responses.select("claim_id", F.try_parse_json("body").alias("doc"))
    entries = F.array(*[
        F.struct(F.lit(name).alias("name"),
                 F.try_variant_get("doc", "$." + ".".join([container, path]), "variant").alias("v"))
        for name, path in field_map.items()])
    rows = parsed.select("claim_id", F.inline(entries)).where(F.col("v").isNotNull()).select(
        "claim_id", "name", F.array().cast("array<int>").alias("path"), "v", F.schema_of_variant("v").alias("kind"))
    for _ in range(LEVELS_A_PASS):
        rows = _unwrapped(rows, keys)
    # a wrapper without a member leaves no value: it is no nested one, and its empty text is dropped with the others
    rows = rows.withColumn("nested", F.coalesce(_nested(F.col("kind")), F.lit(False)))
    leaves, plain = [], F.try_variant_get("v", "$", "string")
    while True:
        level = stage(rows.select("claim_id", "name", "path", "nested", F.when(~F.col("nested"), plain).alias("raw"),
                                  F.when(F.col("nested"), F.to_json("v")).alias("json")), "api-level")
        leaves.append(level.where("not nested").select("claim_id", "name", "path", "raw"))
        left = level.where("nested")
        if left.isEmpty():
            break
        rows = left.select("claim_id", "name", "path", F.parse_json("json").alias("v"), "nested")
        for _ in range(LEVELS_A_PASS):
            rows = _opened(rows, keys)
    every = leaves[0]
    for part in leaves[1:]:
        every = every.unionByName(part)
    every = every.withColumn("value", value_normalize(F.col("name"), F.col("raw"))).where("value <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda p: p["value"])
    return every.groupBy("claim_id", "name").agg(F.array_join(parts, " ").alias("value"))


def response_text(fields: DataFrame, field_map=None, labels=R.FIELD_TEXT_LABELS) -> DataFrame:
    """Readable one-line form of a claim's structured fields, in field-map order."""
    names = list(field_map or R.API_FIELD_MAP)
    label = F.coalesce(*[F.when(F.col("name") == k, v) for k, v in labels.items()], F.col("name"))
    shown = fields.select("claim_id", "name", F.concat(label, F.lit("："), F.col("value")).alias("shown"))
    parts = [F.max(F.when(F.col("name") == n, F.col("shown"))).alias(n) for n in names]
    return shown.groupBy("claim_id").agg(*parts).select(
        "claim_id", F.concat(F.lit("OCR结构化字段 "), F.concat_ws(" ", *names)).alias("text"))


# ---------------------------------------------------------------- model candidates

def parse_candidates(replies: DataFrame) -> DataFrame:
    """``(claim_id, fields, error, error_type)``; ``fields`` is null when the reply is refused as a whole."""
    # step by step: the object is sought once and parsed once, however often its outcome is asked for
    parsed = replies.select("claim_id", json_object(F.col("payload")).alias("body"))
    parsed = parsed.withColumn("bad", unparsable(F.col("body"))).select("claim_id", reply_parts(F.col("body"), F.col("bad")).alias("p"))
    fields = F.from_json("p.body", REPLY_SCHEMA)["fields"]
    parsed = parsed.select("claim_id", F.col("p.error").alias("error"), fields.alias("raw"))
    broken = F.exists(F.map_values("raw"), lambda v: ~F.coalesce(v["confidence"], F.lit(0.0)).between(0, 1)
                      | (F.coalesce(v["page_no"], F.lit(1)) < 1))
    schema_error = F.col("error").isNull() & (F.col("raw").isNull() | broken)
    return parsed.select(
        "claim_id",
        F.when(F.col("error").isNull() & ~schema_error, F.col("raw")).alias("fields"),
        F.when(schema_error, "validation error").otherwise(F.col("error")).alias("error"),
    ).withColumn("error_type", F.when(F.col("error").isNotNull(), error_class(F.col("error"))))


#: What stands between two pages of a claim in the text that a model is shown.
BETWEEN = "\n\n---\n\n"


def claim_context(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """The text a model was shown for a claim that has a reply, page by page: ``(claim_id, at, shown, first_document_id)``.

    The pages of a claim follow each other as ``at`` counts; ``shown`` is a page with its heading and what stands
    before the next one. They are never put together into one row.
    """
    block = F.concat(F.lit("file="), "file_name", F.lit("\ndocument_id="), "document_id",
                     F.lit("\npage="), F.col("page_no").cast("string"), F.lit("\n"), "text")
    asked = claims.select("claim_id").distinct()
    order = ["file_order", "page_no", "block", "document_id"]
    blocks = pages.join(asked, "claim_id", "left_semi").select("claim_id", "file_order", "page_no", block.alias("block"), "document_id")
    within, every = W.partitionBy("claim_id").orderBy(*order), W.partitionBy("claim_id")
    present = F.col("block").isNotNull().cast("int")
    # pages without a block stand in no text, but may be the claim's first; one row stays for a claim that has no others
    placed = blocks.select(
        "claim_id", "block", F.sum(present).over(within.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int").alias("at"),
        F.row_number().over(within).alias("n"), F.first("document_id").over(within).alias("first_document_id"),
        F.sum(present).over(every).alias("blocks"))
    placed = placed.where("block is not null or (blocks = 0 and n = 1)")
    shown = F.concat("block", F.when(F.col("at") < F.col("blocks"), BETWEEN).otherwise(""))
    return placed.select("claim_id", "first_document_id", F.when(F.col("blocks") > 0, F.col("at")).alias("at"), shown.alias("shown"))


def found_in_context(asked: DataFrame, context: DataFrame) -> DataFrame:
    """The rows of ``asked(claim_id, source_text)`` whose text stands in the claim's context, across pages too.

    A text inside one page is found there. One that spans pages starts as the end of a page and goes on with the
    next ones: from each place where the rest of a page is a beginning of the text, the text is followed page by page.
    """
    s, page = F.col("source_text"), F.col("shown")
    met = asked.where("source_text <> ''").distinct().join(context.select("claim_id", "at", "shown"), "claim_id").where("shown is not null")
    reach = F.least(F.length(s) - 1, F.length(page))
    begun = F.filter(F.sequence(F.lit(1), reach), lambda n: F.right(page, n) == F.left(s, n))
    # a text that the end of a page begins holds the page's last character
    begun = F.when(s.contains(F.right(page, F.lit(1))) & (reach > 0), begun).otherwise(F.array().cast("array<int>"))
    met = met.select("claim_id", "source_text", "at", page.contains(s).alias("inside"), begun.alias("begun"))
    met = stage(met.where("inside or size(begun) > 0"), "context-met")
    found = met.where("inside").select("claim_id", "source_text")
    open_ = met.where("size(begun) > 0").select("claim_id", "source_text", (F.col("at") + 1).alias("at"), F.explode("begun").alias("done"))
    while not open_.isEmpty():
        rest = F.substr(s, F.col("done") + 1)
        on = open_.join(context.select("claim_id", "at", "shown"), ["claim_id", "at"]).withColumn("rest", rest)
        on = stage(on.select("claim_id", "source_text", "at", (F.col("done") + F.length(page)).alias("done"),
                             F.startswith(page, F.col("rest")).alias("ended"),
                             ((F.length("rest") > F.length(page)) & F.startswith(F.col("rest"), page)).alias("goes_on")), "context-followed")
        found = found.union(on.where("ended").select("claim_id", "source_text"))
        open_ = on.where("goes_on").select("claim_id", "source_text", (F.col("at") + 1).alias("at"), "done")
    return found.distinct()


def candidate_validate(parsed: DataFrame, context: DataFrame, min_confidence: float = R.MIN_CONFIDENCE) -> DataFrame:
    """Every proposed field with its normal form or the reason it is refused."""
    context = stage(context, "context")  # met twice: by the texts, and for the first document
    rows = parsed.where("fields is not null").select("claim_id", F.explode("fields").alias("name", "cand")).select(
        "claim_id", "name", F.col("cand.value").alias("raw"), F.coalesce("cand.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("cand.source_text", F.lit("")).alias("source_text"), F.coalesce("cand.page_no", F.lit(1)).alias("page_no"))
    found = found_in_context(rows.select("claim_id", "source_text"), context).withColumn("found", F.lit(True))
    first = context.groupBy("claim_id").agg(F.max("first_document_id").alias("first_document_id"))
    rows = rows.join(first, "claim_id", "left").join(found, ["claim_id", "source_text"], "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))
    name, raw = F.col("name"), strip(F.col("raw"))
    money, day = model_amount(raw), model_date(raw)
    formats = [F.when((name == n) & ~F.coalesce(raw.rlike(f"^(?:{p})$"), F.lit(False)), why)
               for n, (p, why) in R.CANDIDATE_FORMATS.items()]
    reason = (
        F.when(~name.isin(*R.CANDIDATE_FIELDS), "unknown field")
        .when(F.coalesce(F.col("raw"), F.lit("")) == "", "empty value")
        .when(F.col("confidence") < min_confidence, F.concat(F.lit("low confidence "), F.col("confidence").cast("string")))
        .when(F.col("source_text") == "", "missing source_text")
        .when(~F.col("found"), "source_text not found in documents")
        .when(name.endswith("_amount"), money["reason"])
        .when(name.endswith("_date"), day["reason"])
        .otherwise(F.coalesce(*formats))
    )
    value = F.when(name.endswith("_amount"), money["value"]).when(name.endswith("_date"), day["value"]).otherwise(raw)
    return rows.select(
        "claim_id", "name", F.when(reason.isNull(), value).alias("value"), "confidence", "page_no", "source_text",
        F.col("first_document_id").alias("document_id"), reason.alias("reject_reason"),
        F.when(reason.isNotNull(), rejection_class(reason)).alias("reject_class"))


def rejection_class(reason: Column) -> Column:
    return (
        F.when(reason.startswith("low confidence"), "low_confidence")
        .when(reason == "source_text not found in documents", "source_text_not_found")
        .when(reason == "missing source_text", "missing_source_text")
        .when(reason == "unknown field", "unknown_field")
        .when(reason == "empty value", "empty_value")
        .when(reason.startswith("invalid") | (reason == "negative amount"), "invalid_format")
        .otherwise("other_rejection")
    )


# ---------------------------------------------------------------- corrections and the merge

def correction_latest(corrections: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """The last correction per (claim, field), with the value it replaces when ``fields`` is given."""
    latest = (
        corrections.groupBy("claim_id", "field_name")
        .agg(F.max_by(F.struct("corrected_value", "reason", "created_at"),
                      F.struct("created_at", "corrected_value")).alias("last"))
        .select("claim_id", "field_name", "last.*")
    )
    if fields is None:
        return latest
    originals = fields.select("claim_id", F.col("name").alias("field_name"), F.col("value").alias("original_value"))
    return latest.join(originals, ["claim_id", "field_name"], "left")


def overrides_by_claim(latest: DataFrame) -> DataFrame:
    """``(claim_id, m_<field>)``: the claim's corrections as one struct column per known field."""
    entry = F.struct(F.col("corrected_value").alias("value"), "reason")
    return latest.groupBy("claim_id").agg(
        *[F.max(F.when(F.col("field_name") == n, entry)).alias(f"m_{n}") for n in FIELDS])


def overlay(field: Column, manual: Column) -> Column:
    """A hand correction laid over a field: it keeps the place of the value it replaces."""
    corrected = field_struct(
        0, manual["value"], F.lit(1.0), F.coalesce(field["document_id"], F.lit("manual")),
        F.coalesce(field["page_no"], F.lit(1)),
        F.concat(F.when(field.isNotNull(), "人工修正：").otherwise("人工补充："),
                 F.coalesce(manual["reason"], F.lit("人工修正"))))
    return F.when(manual.isNotNull(), corrected).otherwise(field)


def api_struct(name: Column, value: Column) -> Column:
    return field_struct(API, value, F.lit(0.99), F.lit("ocr-api"), F.lit(1),
                        F.concat(F.lit("OCR结构化字段："), name, F.lit("="), value))


def field_merge(rules: DataFrame, api: DataFrame | None = None, candidates: DataFrame | None = None,
                corrections: DataFrame | None = None) -> DataFrame:
    """Final field per (claim, name): correction, then structured response, then rules, then model.

    ``api_conflict`` holds the differing value a structured response replaced. One shuffle, combined
    map-side, whatever the number of sources.
    """
    kinds = rules.select(
        "claim_id", "name", field_struct(RULES, F.col("value"), F.col("confidence"), F.col("document_id"),
                                         F.col("page_no"), F.col("source_text")).alias("f"))
    if api is not None:
        kinds = kinds.unionByName(api.select("claim_id", "name", api_struct(F.col("name"), F.col("value")).alias("f")))
    if candidates is not None:
        kinds = kinds.unionByName(candidates.where("reject_reason is null").select(
            "claim_id", "name", field_struct(MODEL, F.col("value"), F.col("confidence"), F.col("document_id"),
                                             F.col("page_no"), F.col("source_text")).alias("f")))
    rows = kinds.withColumn("m", F.lit(None).cast("struct<value:string,reason:string>"))
    if corrections is not None:
        rows = rows.unionByName(
            corrections.select("claim_id", F.col("field_name").alias("name"),
                               F.struct(F.col("corrected_value").alias("value"), "reason").alias("m")),
            allowMissingColumns=True)
    merged = rows.groupBy("claim_id", "name").agg(
        F.min("f").alias("f"), F.max("m").alias("m"),
        F.min(F.when(F.col("f.prio") != API, F.col("f"))).alias("read"))
    final = overlay(F.col("f"), F.col("m"))
    replaced = F.when((F.col("f.prio") == API) & (F.col("read.value") != F.col("f.value")), F.col("read.value"))
    return merged.select("claim_id", "name", final.alias("final"), replaced.alias("api_conflict")).select(
        "claim_id", "name", "final.value", "final.confidence", "final.document_id", "final.page_no",
        "final.source_text", "api_conflict")
