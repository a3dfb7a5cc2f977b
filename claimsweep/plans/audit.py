"""The audit of a table of claims, from pages to verdicts."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.materials import hard_level, injection_snippets, is_short, is_synthetic, material_type
from ..operators import duplicates as D
from ..operators import merge as M
from ..operators import policy as P
from ..operators import risks as R
from ..operators.checks import with_checks
from ..operators.extract import FIELDS, first_hits, wide_to_fields, with_field_hits
from ..functions.text import contains_any
from ..rules.materials import DEFAULT_EXPENSE_TYPE, EXPENSE_KEYWORDS, MATERIAL_LABELS, MIN_READABLE_CHARS
from ..rules.risks import LEVELS
from ..staging import stage


def document_text(pages: DataFrame) -> DataFrame:
    """Pages joined by line breaks in page order, one row per document."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    keys = [c for c in pages.columns if c not in ("page_no", "text")]
    return pages.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def expense_type_infer(files: DataFrame) -> DataFrame:
    """Expense type per claim from its file names; the first keyword group that any name matches."""
    name = F.lower("file_name")
    hits = files.groupBy("claim_id").agg(
        *[F.bool_or(contains_any(name, words)).alias(kind) for kind, words in EXPENSE_KEYWORDS.items()])
    return hits.select("claim_id", _first_kind("").alias("expense_type"))


def _first_kind(prefix: str) -> Column:
    return F.coalesce(*[F.when(F.col(prefix + kind), kind) for kind in EXPENSE_KEYWORDS], F.lit(DEFAULT_EXPENSE_TYPE))


SIGNAL_COLUMNS = ("file_order", "file_name", "document_id", "material", "synthetic", "short", "level", "snippets")


def document_facts(pages: DataFrame, documents: DataFrame | None = None, api: DataFrame | None = None) -> DataFrame:
    """Everything the audit takes from a text, without the text: a narrow pass, no shuffle.

    ``documents`` is given when files have several pages; then field hits come from pages and the other
    signals from whole documents. ``api`` holds structured fields, whose names count for the file type.
    """
    structured = None
    if api is not None:
        names = api.groupBy("claim_id").agg(F.collect_set("name").alias("api_names"))
        structured = F.col("api_names")
        if documents is None:
            pages = pages.join(names, "claim_id", "left")
        else:
            documents = documents.join(names, "claim_id", "left")

    def signals(df: DataFrame) -> DataFrame:
        text = F.col("text")
        return df.select("*", material_type(F.col("file_name"), text, structured).alias("material"),
                         is_synthetic(text).alias("synthetic"), is_short(text).alias("short"),
                         hard_level(text).alias("level"), injection_snippets(text).alias("snippets"))

    fields = [f"f_{n}" for n in FIELDS]
    if documents is None:
        return with_field_hits(signals(pages)).select("claim_id", *SIGNAL_COLUMNS, *fields)
    return signals(documents).select("claim_id", *SIGNAL_COLUMNS).unionByName(
        with_field_hits(pages).select("claim_id", *fields), allowMissingColumns=True)


def claim_facts(document_facts: DataFrame, api: DataFrame | None = None, candidates: DataFrame | None = None,
                corrections: DataFrame | None = None) -> DataFrame:
    """One wide row per claim: final fields, material flags and readability counts.

    Everything is a minimum, a maximum or a count over the claim's documents, so a claim of any size is
    combined before the one shuffle by ``claim_id``.
    """
    slim = document_facts
    if api is not None:
        slim = slim.unionByName(_as_hits(api.select("claim_id", "name", M.api_struct(F.col("name"), F.col("value")).alias("f"))),
                                allowMissingColumns=True)
    if candidates is not None:
        accepted = candidates.where("reject_reason is null").select("claim_id", "name", M.field_struct(
            M.MODEL, F.col("value"), F.col("confidence"), F.col("document_id"), F.col("page_no"),
            F.col("source_text")).alias("f"))
        slim = slim.unionByName(_as_hits(accepted), allowMissingColumns=True)
    facts = slim.groupBy("claim_id").agg(
        *first_hits(),
        *[F.coalesce(F.bool_or(F.col("material") == kind), F.lit(False)).alias(f"has_{kind}") for kind in MATERIAL_LABELS],
        *[F.coalesce(F.bool_or(contains_any(F.lower("file_name"), words)), F.lit(False)).alias(f"names_{kind}")
          for kind, words in EXPENSE_KEYWORDS.items()],
        F.count("material").alias("n_documents"),
        F.count_if("synthetic").alias("n_synthetic"), F.count_if("short").alias("n_short"))
    if corrections is None:
        return facts.select("*", *[F.lit(False).alias(f"manual_{n}") for n in FIELDS])
    manual = M.overrides_by_claim(M.correction_latest(corrections))
    return facts.join(manual, "claim_id", "left").select(
        "claim_id", *[M.overlay(F.col(f"f_{n}"), F.col(f"m_{n}")).alias(f"f_{n}") for n in FIELDS],
        *[F.col(f"m_{n}").isNotNull().alias(f"manual_{n}") for n in FIELDS],
        *[c for c in facts.columns if c != "claim_id" and not c.startswith("f_")])


def _as_hits(rows: DataFrame) -> DataFrame:
    return rows.select("claim_id", *[F.when(F.col("name") == n, F.col("f")).alias(f"f_{n}") for n in FIELDS])


def readability_code() -> Column:
    """Why a claim cannot be judged, or null; over the columns of :func:`claim_facts`."""
    any_field = F.lit(False)
    for n in FIELDS:
        any_field = any_field | F.col(f"f_{n}").isNotNull()
    return (
        F.when(F.col("n_documents") == 0, "NO_TEXT")
        .when(F.col("n_synthetic") > 0, "MOCK_OCR")
        .when(F.col("n_short") == F.col("n_documents"), "NO_TEXT")
        .when(~any_field, "NO_FIELDS"))


@dataclass
class Audit:
    """The tables of one audit run. All lazy; each reads only the columns it needs."""

    documents: DataFrame   # staged document facts (no texts)
    facts: DataFrame       # staged wide claim rows: fields, material flags, counts
    claims: DataFrame      # staged: field values and material flags with clauses, checks and check risks
    engine: str = "mock"

    @property
    def fields(self) -> DataFrame:
        return wide_to_fields(self.facts)

    def document_risks(self) -> DataFrame:
        """Risks of single documents. Field use is looked up only for claims with a hard document."""
        signals = self.documents.where("material is not null").select(
            "claim_id", "file_order", "file_name", "document_id", "level", "snippets")
        ids = F.array_distinct(F.array_compact(F.array(*[F.col(f"f_{n}.document_id") for n in FIELDS])))
        hard = signals.where("level = 'hard'").select("claim_id")
        used = self.facts.join(hard, "claim_id", "left_semi").select("claim_id", F.explode(ids).alias("document_id"))
        return R.hard_region_risk(signals, used).withColumn("part", F.lit(2)).unionByName(
            R.injection_risk(signals).withColumn("part", F.lit(3)))

    def raw_risks(self) -> DataFrame:
        """All risks found, before unreadable claims are cleared: (part, ord) is the report order."""
        own = self.claims.select("claim_id", F.lit(1).alias("part"), F.posexplode("check_risks").alias("ord", "r")).select(
            "claim_id", "part", "ord", "r.*")
        return own.unionByName(self.document_risks().withColumnRenamed("file_order", "ord"))

    def unreadable(self) -> DataFrame:
        """Claims that get no verdict, with the reason and the files concerned."""
        marked = self.facts.where("unreadable_code is not null").select("claim_id", F.col("unreadable_code").alias("code"))
        names = self.documents.where("material is not null").select(
            "claim_id", "file_order", "file_name", "synthetic", "short")
        concerned = (F.col("code") == "NO_FIELDS") | ((F.col("code") == "MOCK_OCR") & F.col("synthetic")) | (
            (F.col("code") == "NO_TEXT") & F.col("short"))
        files = names.join(marked, "claim_id").where(concerned).groupBy("claim_id").agg(
            F.array_sort(F.collect_list(F.struct("file_order", "file_name"))).alias("fs"))
        listed = marked.join(files, "claim_id", "left").select(
            "claim_id", "code", F.coalesce(F.transform("fs", lambda f: f["file_name"]), F.array().cast("array<string>")).alias("files"))
        shown = F.array_join("files", "、")
        reason = (
            F.when(F.col("code") == "MOCK_OCR", F.concat(
                shown, F.lit(f" 的内容并未被真正识别：当前 OCR 引擎是演示模式（OCR_ENGINE={self.engine}），"
                             "系统解析出的是内置演示文本，与上传材料无关。因此不能对该材料作出审核结论。"
                             "请在 .env 配置真实 OCR 引擎（OCR_ENGINE=tesseract|http|mineru）后重新提交。")))
            .when((F.col("code") == "NO_TEXT") & (F.size("files") == 0), "未收到任何可解析的材料，无法作出审核结论。")
            .when(F.col("code") == "NO_TEXT", F.concat(
                F.lit("全部材料（"), shown, F.lit(f"）均未解析出有效文本（不足 {MIN_READABLE_CHARS} 字），"
                                             "系统读不到材料内容，无法作出审核结论。请确认文件完整、清晰，或更换识别引擎后重新提交。")))
            .otherwise("材料已解析出文本，但未抽取到任何可用字段（金额、日期、发票号等），"
                       "没有可用于确定性检查的证据，无法作出审核结论。请补充材料或人工修正字段后重跑。"))
        return listed.select("claim_id", "code", reason.alias("reason"), "files")

    def risks(self) -> DataFrame:
        """Reported risks: an unreadable claim keeps the missing-document risk behind its blocker."""
        blocked = self.unreadable()
        blocker = blocked.select("claim_id", F.lit(0).alias("part"), F.lit(0).alias("ord"),
                                 R.risk(F.lit("MATERIAL_UNREADABLE"), F.col("reason"), F.col("files")).alias("r")).select(
            "claim_id", "part", "ord", "r.*")
        kept = F.expr("filter(check_risks, r -> unreadable_code is null or r.risk_type = 'REQUIRED_DOCUMENTS')")
        own = self.claims.select("claim_id", F.lit(1).alias("part"), F.posexplode(kept).alias("ord", "r")).select(
            "claim_id", "part", "ord", "r.*")
        documents = self.document_risks().withColumnRenamed("file_order", "ord").join(
            self.facts.where("unreadable_code is not null").select("claim_id"), "claim_id", "left_anti")
        return own.unionByName(documents).unionByName(blocker)

    def report_fields(self) -> DataFrame:
        """Reported fields: of an unreadable claim only what a person entered."""
        return wide_to_fields(self._shown())

    def _shown(self) -> DataFrame:
        return self.facts.select("claim_id", *[
            F.when(F.col("unreadable_code").isNull() | F.col(f"manual_{n}"), F.col(f"f_{n}")).alias(f"f_{n}") for n in FIELDS])

    def field_maps(self) -> DataFrame:
        """Reported field values as one map per claim, straight from the wide rows."""
        entries = F.array_compact(F.array(*[F.when(F.col(f"f_{n}").isNotNull(), F.struct(
            F.lit(n).alias("key"), F.col(f"f_{n}.value").alias("value"))) for n in FIELDS]))
        return self._shown().select("claim_id", F.map_from_entries(entries).alias("values"))

    def verdicts(self, failed: DataFrame | None = None) -> DataFrame:
        """Status and level counts per claim. ``failed(claim_id, failure)`` names runs that were stopped."""
        found = self.document_risks().groupBy("claim_id").agg(*[
            F.count_if(F.col("level") == lv).alias(f"d_{lv.lower()}") for lv in LEVELS])
        unreadable = F.col("unreadable_code").isNotNull()
        counts = {}
        for lv in LEVELS:
            own = F.size(F.filter("check_risks", lambda r: r["level"] == lv)) + F.coalesce(f"d_{lv.lower()}", F.lit(0))
            kept = F.size(F.filter("check_risks", lambda r: (r["level"] == lv) & (r["risk_type"] == "REQUIRED_DOCUMENTS")))
            blocker = 1 if lv == R.R.SEVERITY["MATERIAL_UNREADABLE"] else 0
            counts[lv] = F.when(unreadable, kept + blocker).otherwise(own).cast("int")
        joined = self.claims.join(found, "claim_id", "left")
        if failed is not None:
            joined = joined.join(failed.select("claim_id", "failure"), "claim_id", "left")
        else:
            joined = joined.withColumn("failure", F.lit(None).cast("string"))
        counted = joined.select("claim_id", "unreadable_code", "failure",
                                *[c.alias(f"n_{lv.lower()}") for lv, c in counts.items()])
        status = (F.when(F.col("failure").isNotNull(), "FAILED").when(unreadable, "UNDETERMINED")
                  .otherwise(R.overall_status(F.col("n_high"), F.col("n_medium"))))
        return counted.select("claim_id", status.alias("status"), *[f"n_{lv.lower()}" for lv in LEVELS],
                              "unreadable_code", "failure")


def claim_rows(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """``claims(claim_id, submitted_at, department)`` with their facts, one wide row each."""
    joined = claims.join(facts, "claim_id", "left").select(
        "claim_id", "submitted_at", "department", F.date_format("submitted_at", "yyyy-MM-dd").alias("as_of"),
        *[f"f_{n}" for n in FIELDS], *[F.coalesce(f"manual_{n}", F.lit(False)).alias(f"manual_{n}") for n in FIELDS],
        *[F.coalesce(f"has_{k}", F.lit(False)).alias(f"has_{k}") for k in MATERIAL_LABELS],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "n_synthetic", "n_short")],
        *[F.col(f"f_{n}.value").alias(n) for n in ("invoice_number", "invoice_date", "invoice_amount")],
        F.col("f_travel_city.value").alias("city"), _first_kind("names_").alias("expense_type"))
    return joined.withColumn("unreadable_code", readability_code())


def staged_facts(claims: DataFrame, facts: DataFrame, name: str = "facts") -> DataFrame:
    """The rows of :func:`claim_rows`, written once.

    Clause search, the registry, document risks and the checks all read from this table, so texts are
    scanned and shuffled a single time.
    """
    return stage(claim_rows(claims, facts), name)


def with_evidence(facts: DataFrame, chunks: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Facts with their clauses: travel claims by city, others by the keyword gate of their expense type.

    Clauses are found once for each different (type, city, department, day), a table that is made in one pass over the
    claims, and attached by claim id.
    """
    keys = ["expense_type", "city", "department", "as_of"]
    slim = facts.select("claim_id", *keys)
    asked = stage(slim.select(*keys).distinct(), "asked").select("*", F.struct(*keys).alias("asked"))
    travel = F.col("expense_type") == DEFAULT_EXPENSE_TYPE
    # each search is a job of its own, and so is the join below: one plan of all would be held and compiled by the driver at once
    found = [stage(part.where(F.size("evidence") > 0).select("asked", F.col("evidence").alias("found")), f"clauses-{kind}")
             for kind, part in (("city", P.clause_match_city(asked.where(travel), chunks, published)),
                                ("expense", P.clause_match_expense(asked.where(~travel), chunks, published)))]
    found = found[0].unionByName(found[1])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"asked.{k}"))
    # the same few clauses fill these files, which are far smaller than their rows: no side is broadcast for its files' size
    found = slim.join(found.hint("merge"), same).select("claim_id", "found")
    return facts.join(found, "claim_id", "left").select(
        *facts.columns, F.coalesce("found", F.array().cast(P.EVIDENCE)).alias("evidence"))


def audit_facts(facts: DataFrame, documents: DataFrame, chunks: DataFrame, published: DataFrame | None = None,
                registry: DataFrame | None = None) -> Audit:
    """Audit of staged facts. ``registry`` holds earlier registrations; the claims register themselves too."""
    own = D.registry_rows(facts)
    # the checks read values only: what else a field holds is not carried through the joins, nor written again
    slim = facts.select("claim_id", "submitted_at", "department", "as_of", "invoice_number", "invoice_date", "invoice_amount", "city",
                        "expense_type", "unreadable_code", *[f"has_{k}" for k in MATERIAL_LABELS],
                        *[F.when(F.col(f"f_{n}").isNotNull(), F.struct(F.col(f"f_{n}.value").alias("value"))).alias(f"f_{n}") for n in FIELDS])
    known = own if registry is None else D.registry_upsert(registry, own)
    wide = with_checks(D.with_duplicate_hits(with_evidence(slim, chunks, published), known))
    wide = wide.drop("clean_number", "clean_date", "clean_amount", "dup_exact", "dup_any").withColumn(
        "check_risks", R.check_risks(F.col("checks"), F.col("evidence")))
    return Audit(documents=documents, facts=facts, claims=stage(wide, "checked"))


def audit(claims: DataFrame, pages: DataFrame, chunks: DataFrame, published: DataFrame | None = None,
          registry: DataFrame | None = None, documents: DataFrame | None = None, api: DataFrame | None = None,
          candidates: DataFrame | None = None, corrections: DataFrame | None = None) -> Audit:
    """Audits ``claims(claim_id, submitted_at, department)`` with their material pages."""
    read = stage(document_facts(pages, documents, api), "documents")
    facts = staged_facts(claims, claim_facts(read, api, candidates, corrections))
    return audit_facts(facts, read, chunks, published, registry)
