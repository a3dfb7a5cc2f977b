"""Every operator as a query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import materials as FM
from .functions import naming as FN
from .functions import text as FT
from .functions import values as FV
from .operators import chunking, duplicates, evaluate, extract, merge, policy, review, risks, search, tasks
from .operators.checks import check_readiness as planned_steps
from .operators.checks import with_checks
from .plans import audit as A
from .rules import policies as P
from .session import configure, shared_dir
from .sources import files, registry, synth
from .staging import release, stage, stage_result
from .streaming import jobs

# English rule packs for the document table, whose texts hold none of the default labels
ENGLISH_KEYWORDS = ("the", "tion", "que", "und")
ENGLISH_HANDWRITING = ("license", "stamp")
ENGLISH_INJECTION = (("license", r"licen[cs]e[^\n]{0,20}"), ("mail", r"[a-z0-9._]+@[a-z0-9.]+"),
                     ("license", r"all rights[^\n]{0,12}reserved"))
ENGLISH_MARKERS = ("stupid",)
EVENT_STATES = {"signup": "CREATED", "view": "READY", "purchase": "COMPLETED", "error": "FAILED"}


class Inputs:
    """Tables shared by the queries of one session and data folder; audit stages are written once."""

    _made: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Inputs":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._made:
            cls._made[key] = cls(configure(spark), sf_dir)
        return cls._made[key]

    @classmethod
    def close(cls, spark: SparkSession) -> None:
        """Forgets the session's inputs and removes their stage tables."""
        cls._made = {k: v for k, v in cls._made.items() if k[0] != spark.sparkContext.applicationId}
        release(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def claims(self) -> DataFrame:
        return stage(synth.claims_truth(self.spark, self.sf_dir), "claims")

    @cached_property
    def materials(self) -> DataFrame:
        return stage(synth.materials(self.claims), "materials")

    @cached_property
    def chunks(self) -> DataFrame:
        return policy.baseline_chunks(self.spark)

    @cached_property
    def policies(self) -> DataFrame:
        return synth.policy_documents(self.spark, self.sf_dir)

    @cached_property
    def published(self) -> DataFrame:
        # dealt out, whatever files the policies come from: what is made of the clauses stays spread
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return stage(policy.published_chunks(synth.policy_clauses(self.policies), self.policies).repartition(n, "chunk_id"), "published")

    @cached_property
    def scanned(self) -> DataFrame:
        """Structured fields of the claims whose invoice was sent to a recognition service; only their responses are opened."""
        responses = synth.api_responses(self.claims.join(synth.scanned(self.claims), "claim_id", "left_semi"))
        return stage_result(self.spark, lambda: merge.structured_response_fields(responses), "scanned-fields")

    @cached_property
    def documents(self) -> DataFrame:
        return stage(A.document_facts(self.materials, api=self.scanned), "document-facts")

    def _facts_of(self, documents: DataFrame, build=A.claim_rows) -> DataFrame:
        return build(self.claims.select("claim_id", "submitted_at", "department"), A.claim_facts(
            documents, self.scanned, self.validated, synth.corrections(self.claims)))

    @cached_property
    def facts(self) -> DataFrame:
        return self._facts_of(self.documents, A.staged_facts)

    def facts_once(self) -> DataFrame:
        """The rows of ``facts`` for a query that reads them a single time.

        Unless other queries have had them written, they are not: only the columns that the query asks for are made, and
        only these fields are sought in the texts.
        """
        if "facts" in self.__dict__:
            return self.facts
        written = "documents" in self.__dict__
        return self._facts_of(self.documents if written else A.document_facts(self.materials, api=self.scanned))

    @cached_property
    def audit(self) -> A.Audit:
        return A.audit_facts(self.facts, self.documents, self.chunks, self.published)

    @cached_property
    def verdicts(self) -> DataFrame:
        """Status and level counts per claim, as lists and dashboards read them."""
        return stage(self.audit.verdicts(), "verdicts")

    @cached_property
    def risks(self) -> DataFrame:
        return stage(self.audit.risks(), "risks")

    @cached_property
    def parsed(self) -> DataFrame:
        return stage(merge.parse_candidates(synth.candidates(self.claims)), "candidates")

    @cached_property
    def validated(self) -> DataFrame:
        parsed, context = self.parsed, merge.claim_context(self.materials, self.parsed)
        return stage_result(self.spark, lambda: merge.candidate_validate(parsed, context), "validated")

    @cached_property
    def api(self) -> DataFrame:
        responses = synth.api_responses(self.claims)
        return stage_result(self.spark, lambda: merge.structured_response_fields(responses), "api-fields")

    @cached_property
    def rule_fields(self) -> DataFrame:
        """Fields that rules find in the texts; nothing else of the document facts is made for them."""
        return stage(self.read_fields(self.materials), "rule-fields")

    @staticmethod
    def read_fields(pages: DataFrame) -> DataFrame:
        return extract.wide_to_fields(A.claim_facts(A.document_facts(pages)))

    @cached_property
    def truth_claims(self) -> DataFrame:
        """Claims with their invoice values as columns, without reading any file."""
        return self.claims.select("claim_id", "submitted_at", "invoice_number", "invoice_date",
                                  synth.money_text(F.col("invoice_cents")).alias("invoice_amount"))

    @cached_property
    def tasks(self) -> DataFrame:
        return synth.tasks(self.claims)


QUERIES = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Inputs.of(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def joined(c, sep="|"):
    return F.array_join(c, sep)


def _registering(x: Inputs) -> DataFrame:
    """What the registry asks of the claims, written alone: it is read several times."""
    return stage(x.facts_once().select("claim_id", "submitted_at", "invoice_number", "invoice_date", "invoice_amount"), "registering")


def one_check(x: Inputs, tool: str) -> DataFrame:
    """One check of the registry, over the inputs it needs and no others."""
    if tool == "hotel_limit":
        wide = A.with_evidence(x.facts, x.chunks, x.published)
    elif tool == "check_duplicate_invoice":
        wide = _registering(x)
        wide = duplicates.with_duplicate_hits(wide, duplicates.registry_rows(wide))
    else:
        wide = x.facts_once()
    rows = with_checks(wide, (tool,)).select("claim_id", F.col("checks")[0].alias("c")).select("claim_id", "c.*")
    return rows.withColumn("evidence_refs", joined("evidence_refs"))


def flat_risks(df: DataFrame) -> DataFrame:
    return df.select("claim_id", "risk_type", "level", "reason", joined("evidence_refs").alias("evidence_refs"),
                     joined("policy_refs").alias("policy_refs"))


# ---------------------------------------------------------------- sources and sinks

@query
def claim_synth(x):
    t = x.claims.join(x.materials.groupBy("claim_id").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars")),
                      "claim_id", "left")
    return t.select("claim_id", F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss").alias("submitted_at"), "department",
                    "applicant_name", "invoice_buyer", "payment_party", "travel_city", "invoice_cents", "payment_cents",
                    F.col("travel_start").cast("string").alias("travel_start"),
                    F.col("travel_end").cast("string").alias("travel_end"), "invoice_date", "invoice_number",
                    F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chars", F.lit(0)).alias("chars"))


@query
def material_scan(x):
    d = F.col("doc_id")
    content = F.when(d % 10 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    content = F.when(d % 40 == 3, F.lit("").cast("binary")).when(d % 40 == 4, F.concat(content, F.unhex(F.lit("FF")))).otherwise(content)
    name = F.format_string("in/doc_%d%s", d, F.when(d % 20 == 1, ".exe").when(d % 20 == 2, ".PDF").otherwise(".txt"))
    folder = shared_dir(x.spark, "uploads")
    files.write_files(x.table("documents").select(name.alias("path"), content.alias("content")), folder)
    good, bad = files.material_scan(x.spark, folder)
    # hard-region suffixes are compared by region_assess; here the kind before them
    good = good.select("file_name", "document_id", F.regexp_replace("document_type", "_(hard|handwriting)$", "").alias("kind"),
                       "size", F.length("text").alias("chars"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(bad.select("file_name", "reason"), allowMissingColumns=True)


@query
def policy_scan(x):
    chunks = policy.policy_chunks(files.policy_rows(synth.policy_files(x.policies)))
    return chunks.select("ord", "chunk_id", "section_path", "content", "policy_id", "version", "department", "expense_type")


@query
def document_text(x):
    pages = x.table("conversations").select("conv_id", F.col("turn").alias("page_no"), "text")
    return A.document_text(pages).select("conv_id", "text")


@query
def structured_response_fields(x):
    fields = x.api
    text = merge.response_text(fields).select("claim_id", F.lit("(text)").alias("name"), F.col("text").alias("value"))
    return fields.unionByName(text)


@query
def task_files_summary(x):
    every = x.risks
    summary = tasks.task_files_summary(x.tasks, x.materials, every, review.stored_items(every))
    return tasks.newest_first(summary).select(
        "claim_id", "status", "applicant", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "file_count", "risk_count", "review_count")


@query
def case_scan(x):
    k = F.col("k")
    body = F.to_json(F.struct(
        F.when(k % 3 != 0, F.col("claim_id")).alias("case_id"), F.when(k % 3 == 0, F.col("claim_id")).alias("case"),
        F.when(k % 3 != 0, F.concat(F.lit("dir/"), "claim_id")).alias("documents_dir"), F.lit("PASS").alias("expected_status"),
        F.when(k % 2 == 0, F.array(F.lit("A"), F.col("travel_city"))).alias("expected_risks")))
    cases = files.cases_from_json(x.claims.select(body.alias("body")))
    return cases.select("case_id", "name", "documents_dir", "expected_status", joined("expected_risks").alias("expected_risks"),
                        "category", F.size("expected_fields").alias("n_fields"))


def _reports(x):
    a = x.audit
    return review.reports(x.verdicts, a.claims, a.report_fields(), x.risks)


@query
def report_export(x):
    path = shared_dir(x.spark, "reports")
    review.report_export(_reports(x), path)
    back = x.spark.read.parquet(f"{path}/reports")

    def flat(part, *columns):
        rows = x.spark.read.parquet(f"{path}/{part}").select("claim_id", F.struct("position", F.concat_ws(":", *[
            F.col(c).cast("string") for c in columns]).alias("t")).alias("r"))
        return rows.groupBy("claim_id").agg(joined(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"])).alias(part))

    body = F.from_json("report_json", "fields array<struct<name string, value string>>, risks array<struct<risk_type string, level string>>")
    out = back.select("claim_id", "status", body.alias("b")).select(
        "claim_id", "status", joined(F.transform("b.fields", lambda f: F.concat_ws("=", f["name"], f["value"]))).alias("json_fields"),
        joined(F.transform("b.risks", lambda r: F.concat_ws(":", r["risk_type"], r["level"]))).alias("json_risks"))
    for part, columns in (("risks", ("risk_type", "level", "reason")), ("checks", ("name", "passed")), ("fields", ("name", "value"))):
        out = out.join(flat(part, *columns), "claim_id", "left")
    return out.select("claim_id", "status", "json_fields", "json_risks", *[F.coalesce(c, F.lit("")).alias(c) for c in ("risks", "checks", "fields")])


@query
def registry_upsert(x):
    rows = duplicates.registry_rows(x.truth_claims)
    # every fourth claim was registered before with another amount; the later registration stays
    earlier = rows.where(F.substring("claim_id", -1, 1).isin("0", "4", "8")).select(
        "claim_id", "invoice_number", "invoice_date", F.lit("1.00").alias("invoice_amount"),
        (F.col("created_at") - F.make_dt_interval(days=F.lit(1))).alias("created_at"))
    path = shared_dir(x.spark, "registry")
    table = "registry_" + path.rpartition("-")[2]
    registry.create_registry(x.spark, table, path)
    registry.upsert(x.spark, table, earlier)
    registry.upsert(x.spark, table, rows)
    return x.spark.table(table).select(
        "claim_id", "invoice_number", "invoice_date", "invoice_amount",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


# ---------------------------------------------------------------- text

@query
def markup_normalize(x):
    return x.table("pages").select("page_id", FT.markup_normalize(F.col("html")).alias("plain"))


@query
def value_normalize(x):
    money = synth.money_text(F.col("invoice_cents"))
    d = "travel_start"
    raw = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("raw")) for n, v in (
        ("invoice_date", F.date_format(d, "yyyy年M月d日")), ("travel_end_date", F.date_format(d, "yyyy/M/d")),
        ("invoice_date", F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 00:00:00"))), ("invoice_date", F.lit(" 待 确认 ")),
        ("invoice_amount", F.concat(F.lit("￥"), F.format_number((F.col("invoice_cents") * 100).cast("decimal(20,0)"), 0), F.lit("元"))),
        ("payment_amount", money), ("invoice_amount", F.lit("无")),
        ("invoice_number", F.regexp_replace("invoice_number", "-", " - ")), ("applicant_name", F.concat(F.lit("  "), F.col("applicant_name"), F.lit("　先生 "))),
        ("travel_city", F.lit("  ")))])
    rows = x.claims.select("claim_id", F.posexplode(raw).alias("n", "r"))
    return rows.select("claim_id", "n", "r.name", FV.value_normalize(F.col("r.name"), F.col("r.raw")).alias("value"))


@query
def amount_parse(x):
    k, money = F.col("k"), synth.money_text(F.col("invoice_cents"))
    raw = (F.when(k % 6 == 0, money).when(k % 6 == 1, F.concat(F.lit("　"), money, F.lit(" ")))
           .when(k % 6 == 2, F.concat(money, F.lit("5"))).when(k % 6 == 3, F.lit("一百"))
           .when(k % 6 == 4, F.concat(F.lit("￥"), money, F.lit("元"))).otherwise(F.concat(F.lit("-"), money)))
    model = FV.model_amount(F.col("raw"))
    return x.claims.select("claim_id", raw.alias("raw")).select(
        "claim_id", FV.amount_parse(F.col("raw")).cast("string").alias("amount"), model["value"].alias("model_amount"),
        model["reason"].alias("model_reason"))


@query
def date_parse(x):
    k, d = F.col("k"), "travel_start"
    raw = (F.when(k % 6 == 0, F.date_format(d, "yyyy年M月d日")).when(k % 6 == 1, F.date_format(d, "yyyy/M/d"))
           .when(k % 6 == 2, F.date_format(d, "yyyy.MM.dd")).when(k % 6 == 3, F.lit("2026-02-31"))
           .when(k % 6 == 4, F.date_format(d, "yyyy-MM")).otherwise(F.lit("待确认")))
    model = FV.model_date(F.col("raw"))
    return x.claims.select("claim_id", raw.alias("raw")).select(
        "claim_id", FV.date_parse(F.col("raw")).cast("string").alias("day"), model["value"].alias("model_day"),
        model["reason"].alias("model_reason"))


@query
def text_quality(x):
    return x.table("documents").select("doc_id", FM.text_quality(F.col("text"), ENGLISH_KEYWORDS).alias("quality"))


@query
def region_assess(x):
    rows = x.table("documents").select("doc_id", FM.region_assess(F.col("text"), ENGLISH_HANDWRITING).alias("r"))
    return rows.select("doc_id", "r.level", joined("r.reasons").alias("reasons"), "r.needs_review", "r.engine", "r.suffix")


@query
def injection_scan(x):
    def scan(df, key, **rules):
        return df.select(key.cast("string").alias("id"), joined(FM.injection_snippets(F.col("text"), **rules)).alias("snippets"),
                         joined(FM.injection_labels(F.col("text"), **rules)).alias("labels"))

    docs = scan(x.table("documents"), F.col("doc_id"), rules=ENGLISH_INJECTION)
    return docs.unionByName(scan(x.materials, F.concat_ws("/", "claim_id", F.col("file_order").cast("string"))))


@query
def material_type(x):
    names = x.api.groupBy("claim_id").agg(F.collect_set("name").alias("names"))
    rows = x.materials.join(names, "claim_id", "left")
    return rows.select("claim_id", "file_order", FM.material_type(F.col("file_name"), F.col("text")).alias("material"),
                       FM.material_type(F.col("file_name"), F.col("text"), F.col("names")).alias("with_fields"))


@query
def expense_type_infer(x):
    k = F.col("k")
    name = (F.when((F.col("file_order") == 2) & (k % 9 == 0), "门诊处方.txt").when((F.col("file_order") == 1) & (k % 6 == 0), "Office_desk.txt")
            .otherwise(F.col("file_name")))
    rows = x.materials.join(x.claims.select("claim_id", "k"), "claim_id").select("claim_id", name.alias("file_name"))
    return A.expense_type_infer(rows)


@query
def claim_title(x):
    c = x.tasks.join(x.claims.select("claim_id", "k", "travel_start", "travel_end"), "claim_id")
    end = F.when(synth.every(4), F.col("travel_start")).otherwise(F.col("travel_end")).cast("string")
    titled = FN.with_claim_title(c, "title", F.col("applicant"), F.col("expense_type"), F.col("travel_start").cast("string"), end,
                                 F.col("note"), F.col("claim_id"))
    return titled.select("claim_id", "title").select("claim_id", "title", FN.safe_file_name(F.col("title")).alias("file_title"))


@query
def tokenize(x):
    docs = x.table("documents").select(F.col("doc_id").cast("string").alias("id"), FT.tokenize(F.col("text")).alias("t"))
    own = x.materials.select(F.concat_ws("/", "claim_id", F.col("file_order").cast("string")).alias("id"), FT.tokenize(F.col("text")).alias("t"))
    return docs.unionByName(own).select("id", F.size("t").alias("n"), joined("t", " ").alias("tokens"))


@query
def model_json_parse(x):
    k = F.col("event_id")
    raw = (F.when(k % 5 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k % 5 == 1, F.col("event_type"))
           .when(k % 5 == 2, F.concat(F.lit("结果 {\"k\": ["), F.col("user_id").cast("string"), F.lit("}")))
           .when(k % 5 == 3, F.concat(F.lit("说明：\n"), "props", F.lit(" 完"))).otherwise(F.col("props")))
    p = x.table("events").select("event_id", FT.model_json_parse(raw).alias("p"))
    return p.select("event_id", F.get_json_object("p.body", "$.k").alias("k"), "p.error",
                    F.when(F.col("p.error").isNotNull(), FT.error_class(F.col("p.error"))).alias("error_type"))


# ---------------------------------------------------------------- filters

@query
def ocr_needed(x):
    kind = F.when(F.col("doc_id") % 25 == 0, "pdf_ocr_hard").when(F.col("doc_id") % 25 == 1, "image_ocr").otherwise("pdf_text")
    return files.ocr_needed(x.table("documents").select("doc_id", "text", kind.alias("document_type"))).select("doc_id", "document_type")


@query
def synthetic_text_filter(x):
    rows = x.table("documents").select("doc_id", FM.is_synthetic(F.col("text"), ENGLISH_MARKERS).alias("synthetic"),
                                       FM.is_short(F.col("text")).alias("short"))
    return rows.where("synthetic or short")


@query
def owner_row_filter(x):
    k = F.col("k")
    user = F.when(k % 2 == 0, F.col("applicant_name")).otherwise("甲乙")
    requests = x.claims.select(F.when(k % 101 == 0, "none").otherwise(F.col("claim_id")).alias("claim_id"), user.alias("user_id"),
                               F.when(k % 7 == 0, "auditor").otherwise("applicant").alias("role"))
    seen, denied = tasks.owner_row_filter(requests, x.tasks)
    return seen.select("claim_id", F.lit("VIEW").alias("event_type"), F.concat_ws("/", "user_id", "role").alias("message")).unionByName(denied)


# ---------------------------------------------------------------- fields

@query
def field_extract(x):
    return extract.field_extract(x.materials)


@query
def candidate_validate(x):
    return x.validated.select("claim_id", "name", "value", "confidence", "page_no", "document_id", "reject_reason", "reject_class")


@query
def field_merge(x):
    latest = merge.correction_latest(synth.corrections(x.claims))
    rules = x.rule_fields if "rule_fields" in x.__dict__ else x.read_fields(x.materials)  # read once: not written for this alone
    return merge.field_merge(rules, x.api, x.validated, latest)


@query
def correction_latest(x):
    edits = synth.corrections(x.claims)
    # original values are asked for corrected claims only: no other claim's texts are searched
    pages = x.materials.join(edits.select("claim_id").distinct(), "claim_id", "left_semi")
    rows = merge.correction_latest(edits, x.read_fields(pages))
    return rows.select("claim_id", "field_name", "original_value", "corrected_value", "reason",
                       F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


# ---------------------------------------------------------------- joins

def _asking(x, types):
    return x.claims.select("claim_id", F.col("travel_city").alias("city"), "department",
                           synth.pick(types, F.col("k")).alias("expense_type"),
                           F.date_format("submitted_at", "yyyy-MM-dd").alias("as_of"))


@query
def policy_as_of_join(x):
    found = policy.policy_as_of_join(_asking(x, synth.EXPENSE_TYPES), synth.policy_clauses(x.policies), x.policies,
                                     ("chunk_id", "policy_id", "version"))
    return found.select("claim_id", "department", "expense_type", "as_of", "chunk_id", "policy_id", "version")


@query
def clause_match_city(x):
    found = policy.clause_match_city(_asking(x, ("TRAVEL",)), x.chunks, x.published)
    return policy.evidence_long(found).select("claim_id", "rank", "chunk_id", "section", "content", "score")


@query
def clause_match_expense(x):
    found = policy.clause_match_expense(_asking(x, ("EXPENSE", "MEDICAL", "PURCHASE")), x.chunks, x.published)
    return policy.evidence_long(found).select("claim_id", "rank", "chunk_id", "content", "score")


@query
def duplicate_invoice(x):
    return one_check(x, "check_duplicate_invoice")


@query
def required_documents(x):
    return one_check(x, "required_documents")


@query
def subject_match(x):
    return one_check(x, "applicant_match")


# ---------------------------------------------------------------- checks to verdict

@query
def amount_match(x):
    return one_check(x, "amount_match")


@query
def date_range(x):
    return one_check(x, "date_range")


@query
def hotel_limit(x):
    return one_check(x, "hotel_limit")


@query
def check_readiness(x):
    return planned_steps(A.with_evidence(x.facts, x.chunks, x.published))


@query
def risk_build(x):
    return flat_risks(risks.risk_build(x.audit.claims))


@query
def hard_region_risk(x):
    return flat_risks(x.audit.document_risks().where("part = 2"))


@query
def injection_risk(x):
    return flat_risks(x.audit.document_risks().where("part = 3"))


@query
def readability_verdict(x):
    return x.audit.unreadable().select("claim_id", "code", "reason", joined("files").alias("files"))


@query
def verdict(x):
    failed = x.tasks.where("status = 'FAILED'").select("claim_id", F.lit("max_steps").alias("failure"))
    return x.audit.verdicts(failed)


def _critique(x):
    return review.critique(x.audit.claims, x.audit.raw_risks())


@query
def critique(x):
    return _critique(x).withColumn("issues", joined("issues")).withColumn("missing_policy_risks", joined("missing_policy_risks"))


@query
def review_route(x):
    return review.review_route(_critique(x), x.audit.raw_risks())


@query
def review_queue(x):
    return review.review_queue(x.risks)


@query
def check_log(x):
    return review.check_log(x.audit.claims).withColumn("evidence_refs", joined("evidence_refs"))


@query
def audit_summary(x):
    out = review.audit_summary(x.verdicts, x.audit.unreadable(), _reports(x))
    text = lambda c, *names: joined(F.transform(c, lambda e: F.concat_ws(":", *[e[n] for n in names]))).alias(c)
    return out.select("claim_id", "status", "conclusion", "next_action", text("key_fields", "name", "value"),
                      text("risks", "risk_type", "level", "next_action"), text("checks", "name", "status"),
                      text("policy_evidence", "chunk_id"))


# ---------------------------------------------------------------- search

@query
def doc_frequency(x):
    return search.doc_frequency(x.table("documents"))


@query
def tfidf_search(x):
    return search.tfidf_search(x.table("benchmark").select(F.col("item_id").alias("query_id"), "text"),
                               x.table("documents").select("doc_id", "text"), 5)


def _vectors(x):
    corpus = x.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"),
                                          F.col("label").alias("filter_key"))
    dims = corpus.select("filter_key", F.posexplode("vector").alias("dim", "v")).groupBy("filter_key", "dim").agg(
        F.avg(F.col("v").cast("double")).alias("v"))
    # one query per label: the mean of its vectors, rounded so that both engines ask the same
    queries = dims.groupBy("filter_key").agg(F.array_sort(F.collect_list(F.struct("dim", F.round("v", 6).alias("v")))).alias("d"))
    return queries.select(F.col("filter_key").alias("query_id"), "filter_key", F.transform("d", lambda e: e["v"]).alias("vector")), corpus


@query
def vector_topk(x):
    queries, corpus = _vectors(x)
    # ids from 100 on: the same questions without the metadata filter
    free = search.vector_topk(queries.withColumn("query_id", F.col("query_id") + 100), corpus, filter_on=None)
    return search.vector_topk(queries, corpus).unionByName(free)


@query
def hybrid_topk(x):
    queries, corpus = _vectors(x)

    def sparse(df, least):
        entries = F.filter(F.transform("vector", lambda v, i: F.struct(i.alias("i"), v.cast("double").alias("w"))), lambda e: e["w"] > least)
        return df.withColumn("sparse", F.map_from_entries(entries))

    return search.hybrid_topk(sparse(queries, 0.02), sparse(corpus, 0.1), 5, 0.3)


def _city_hits(x, k):
    """Keyword hits for the fixed question of every city the claims name, over the built-in and the published clauses."""
    asked = x.claims.select(F.col("travel_city").alias("city")).where("city is not null").distinct().select(
        F.col("city").alias("query_id"), "city", search.expand_city_query(F.col("city")).alias("text"))
    clauses = [c.select(F.col("chunk_id").alias("doc_id"), F.concat_ws(" ", "content", "section_path").alias("text"), "content",
                        F.concat(F.lit(first), F.col("ord").cast("string")).alias("ord")) for first, c in (("0", x.chunks), ("1", x.published))]
    corpus = clauses[0].unionByName(clauses[1])
    hits = search.tfidf_search(asked, corpus, k, adjust_city=True)
    return hits.join(asked.select("query_id", "city", F.col("text").alias("query_text")), "query_id").join(
        corpus.select("doc_id", "content"), "doc_id")


def _for_claims(x, ranked):
    return x.claims.select("claim_id", F.col("travel_city").alias("query_id")).join(ranked, "query_id").select(
        "claim_id", "rank", F.col("doc_id").alias("chunk_id"), "score")


@query
def entity_rerank(x):
    return _for_claims(x, search.entity_rerank(_city_hits(x, P.RERANK_POOL)))


@query
def city_rerank(x):
    return _for_claims(x, search.city_rerank(_city_hits(x, P.CLAUSES_KEPT)))


@query
def chunk_text(x):
    one = x.table("documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("policy_id"), "doc_id", "text")
    # a second version of every policy: a chapter before the text and a table behind it
    longer = F.concat(F.lit("第一章 总则\n"), "text", F.lit("\n1.1 附则\n| a | b |\n|---|---|\n| "), F.col("doc_id").cast("string"), F.lit(" | x |"))
    both = one.select("policy_id", F.inline(F.array(
        F.struct(F.lit("V1").alias("version"), F.col("text").alias("text")), F.struct(F.lit("V2").alias("version"), longer.alias("text")))))
    return chunking.chunk_text(both)


@query
def table_row_split(x):
    rows = synth.part_tables(x.spark, x.sf_dir)
    return rows.select("p_partkey", F.inline(policy.table_row_split(F.col("content"))))


# ---------------------------------------------------------------- dashboards, histories, evaluation

@query
def status_dashboard(x):
    return tasks.status_dashboard(x.tasks, x.verdicts)


def _decisions(x, items):
    k = F.regexp_extract("claim_id", r"(\d+)$", 1).cast("bigint")
    when = lambda d: F.lit("2002-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(d))
    choice = F.when(k % 3 == 0, "APPROVED").when(k % 3 == 1, "REJECTED")
    decided = items.select("review_item_id", F.inline(F.array(
        F.struct(F.lit("REJECTED").alias("decision"), when(1).alias("decided_at"), choice.isNotNull().alias("real")),
        F.struct(choice.alias("decision"), when(2).alias("decided_at"), choice.isNotNull().alias("real")))))
    return decided.where("real").drop("real")


@query
def review_progress(x):
    items = review.stored_items(x.risks)
    return review.review_progress(items, _decisions(x, items))


def _events(x):
    return x.table("events").select(F.col("user_id").alias("task_id"), "event_id", "event_type", F.col("ts").alias("created_at"))


@query
def task_state(x):
    state = tasks.task_state(_events(x), EVENT_STATES)
    return state.select("task_id", "state", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query
def event_timeline(x):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return tasks.event_timeline(_events(x)).select(
        "task_id", "event_id", "event_type", "position", stamp("created_at").alias("created_at"), stamp("previous_at").alias("previous_at"))


@query
def title_autofill(x):
    return tasks.title_autofill(x.tasks, x.facts_once()).select("claim_id", "title", "title_locked")


def _policy_state(x):
    return policy.policy_status(synth.policy_events(x.policies))


@query
def policy_status(x):
    return _policy_state(x).select("policy_id", "name", "version", "status", "chunk_count", "published_at", "refused", "last_refusal")


@query
def policy_version_switch(x):
    return policy.policy_version_switch(_policy_state(x)).select("policy_id", "name", "version", "status", "switched_off")


def _cases(x):
    k = F.col("k")
    limit = F.when(F.col("travel_city").isin(*P.FIRST_TIER_CITIES), 60000).otherwise(45000)
    planted = F.array_compact(F.array(
        F.when(k % 13 == 0, "AMOUNT_MATCH"), F.when(k % 11 == 0, "APPLICANT_MATCH"),
        F.when(F.col("invoice_cents") > limit, "HOTEL_LIMIT"), F.when((k % 4 == 3) | (k % 31 == 0), "DATE_RANGE"),
        F.when(F.col("resubmitted") == 1, "DUPLICATE_INVOICE"), F.when(F.col("travel_city").isNull(), "RULE_MISSING"),
        F.when(k % 40 == 1, "INVOICE_NUMBER_CONFLICT"))).cast("array<string>")
    clause = F.when(F.col("travel_city").isin(*P.FIRST_TIER_CITIES), "TRAVEL-V1-4.2-A").otherwise("TRAVEL-V1-4.2-B")
    none = F.array().cast("array<string>")
    fields = F.array_compact(F.array(F.struct(F.lit("invoice_number").alias("key"), F.col("invoice_number").alias("value")),
                                     F.when(F.col("travel_city").isNotNull(), F.struct(F.lit("travel_city").alias("key"), F.col("travel_city").alias("value")))))
    return x.claims.select(
        F.col("claim_id").alias("case_id"), F.when(F.size(planted) > 0, "REVIEW_REQUIRED").otherwise("PASS").alias("expected_status"),
        planted.alias("expected_risks"), F.when(F.col("travel_city").isNull(), none).otherwise(F.array(clause)).alias("expected_policy_refs"),
        F.map_from_entries(fields).alias("expected_fields"),
        F.when(k % 40 == 1, F.array(F.lit("invoice_number_conflict"))).when(k % 2 == 0, F.array(F.lit("AMOUNT_MATCH"))).otherwise(none).alias("expected_tools"),
        F.when(k % 13 == 0, "金额不一致").when(k % 11 == 0, "主体不一致").otherwise("正常合规").alias("category"), "k", "travel_city")


def _actual(x):
    a = x.audit
    found = x.risks.groupBy("claim_id").agg(F.collect_set("risk_type").alias("risks"))
    fields = a.field_maps().withColumnRenamed("values", "fields")
    checks = a.claims.select(
        "claim_id", F.transform("evidence", lambda e: e["chunk_id"]).alias("policy_refs"),
        F.transform("checks", lambda c: c["name"]).alias("tools"), F.size("checks").alias("tool_total"),
        F.size(F.filter("checks", lambda c: c["passed"])).alias("tool_passed"),
        F.size(F.filter("checks", lambda c: c["passed"].isNull())).alias("tool_skipped"))
    k = F.regexp_extract("claim_id", r"(\d+)$", 1).cast("bigint")
    return (x.verdicts.select("claim_id", "status").join(checks, "claim_id").join(found, "claim_id", "left").join(fields, "claim_id", "left")
            .withColumn("duration_ms", (k % 50).cast("double")).withColumn("error", F.when(k % 97 == 0, "RuntimeError: max_steps"))
            .withColumn("fields", F.coalesce("fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
            .withColumnRenamed("claim_id", "case_id"))


def _results(x):
    return evaluate.case_compare(_cases(x), _actual(x))


@query
def case_compare(x):
    lists = ("expected_risks", "actual_risks", "missing_risks", "unexpected_risks", "missing_policy_refs", "wrong_fields")
    return _results(x).select("case_id", "category", "expected_status", "actual_status", "passed", "tool_total", "tool_passed",
                              "tool_skipped", "tools_selected", "error", *[joined(c).alias(c) for c in lists])


@query
def eval_metrics(x):
    return evaluate.eval_metrics(_results(x))


@query
def category_breakdown(x):
    return evaluate.category_breakdown(_results(x))


@query
def nearest_rank_percentile(x):
    return evaluate.nearest_rank_percentile(x.table("events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "pmax": 1.0})


@query
def candidate_metrics(x):
    return evaluate.candidate_metrics(x.parsed, x.validated)


@query
def field_compare(x):
    money = synth.money_text(F.col("payment_cents"))
    wanted = x.claims.select(F.col("claim_id").alias("case_id"), F.inline(F.array(
        F.struct(F.lit("payment_amount").alias("name"), money.alias("value")),
        F.struct(F.lit("applicant_name").alias("name"), F.col("invoice_buyer").alias("value")),
        F.struct(F.lit("invoice_code").alias("name"), F.lit("1234").alias("value")))))
    return evaluate.field_compare(wanted, x.rule_fields.withColumnRenamed("claim_id", "case_id"))


@query
def retrieval_hit_rate(x):
    cases = _cases(x)
    hits = _city_hits(x, P.CLAUSES_KEPT).groupBy("query_id").agg(F.collect_set("doc_id").alias("found"))
    by_case = cases.select("case_id", F.col("travel_city").alias("query_id")).join(hits, "query_id").select(
        "case_id", F.explode("found").alias("chunk_id"))
    return evaluate.retrieval_hit_rate(cases, by_case)


@query
def risk_level_summary(x):
    return risks.risk_level_summary(x.risks).select("claim_id", "level_text", F.size("level_counts").alias("levels"))


@query
def dedupe_documents(x):
    rows = x.table("documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return tasks.dedupe_documents(rows).select("document_id", "kept", "copies")


# ---------------------------------------------------------------- streams

def _stream_dirs(x, name, n):
    base = shared_dir(x.spark, name)
    return [f"{base}/{part}" for part in ("out", "checkpoint", "registry")[:n]]


FILES_A_BATCH = 4


def _as_stream(x, parts, name):
    """A file stream that delivers the tables ``parts`` one after the other, a batch each."""
    path = shared_dir(x.spark, name)
    for part in parts:  # files are taken in the order in which they were written
        part.repartition(FILES_A_BATCH).write.mode("append").parquet(path)
    return x.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(path)


def _thirds(df, time):
    """Three tables by time: what comes later is in a later table."""
    cuts = df.select(F.percentile_approx(F.col(time).cast("timestamp"), [1 / 3, 2 / 3])).first()[0] or [None, None]
    low, high = (F.lit(c).cast("timestamp") for c in cuts)
    at = F.col(time).cast("timestamp")
    return [df.where(at <= low), df.where((at > low) & (at <= high)), df.where((at > high) | at.isNull())]


@query
def stream_event_counts(x):
    events = x.table("events").select(F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    out, checkpoint = _stream_dirs(x, "stream-events", 2)
    jobs.stream_event_counts(_as_stream(x, _thirds(events, "created_at"), "arriving-events"), out, checkpoint).awaitTermination()
    return jobs.event_counts(x.spark, out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query
def stream_duplicate_registry(x):
    out, checkpoint, registry = _stream_dirs(x, "stream-duplicates", 3)
    arriving = _as_stream(x, _thirds(_registering(x), "submitted_at"), "arriving-claims")
    jobs.stream_duplicate_registry(arriving, registry, out, checkpoint).awaitTermination()
    return jobs.latest_by_batch(x.spark, out).select("claim_id", "name", "passed", "detail", joined("evidence_refs").alias("evidence_refs"))


@query
def stream_material_ingest(x):
    out, checkpoint, registry = _stream_dirs(x, "stream-materials", 3)
    claims = x.claims.select("claim_id", "submitted_at", "department")
    # invoices first, then payments, then the rest: claims are audited again as their files arrive
    order = F.col("file_order")
    parts = [x.materials.where(order == 1), x.materials.where(order == 2), x.materials.where(order > 2)]
    jobs.stream_material_ingest(_as_stream(x, parts, "arriving-files"), claims, registry, out, checkpoint,
                                corrections=synth.corrections(x.claims), chunks=x.chunks, published=x.published,
                                api=x.scanned, candidates=x.validated).awaitTermination()
    return jobs.latest_by_batch(x.spark, out).select("claim_id", "status", "n_high", "n_medium", "n_low", "n_info", "unreadable_code")
