"""Task lists, dashboards and event histories."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.naming import sanitize_title, with_claim_title
from ..staging import stage


def task_files_summary(tasks: DataFrame, files: DataFrame, risks: DataFrame, items: DataFrame,
                       applicant: str | None = None) -> DataFrame:
    """Tasks with file, risk and review counts: each child table is counted first, then joined once."""
    mine = tasks if applicant is None else tasks.where(F.col("applicant") == applicant)

    def counts(df, name):
        return df.groupBy("claim_id").agg(F.count("*").alias(name))

    joined = (mine.join(counts(files, "file_count"), "claim_id", "left")
              .join(counts(risks, "risk_count"), "claim_id", "left")
              .join(counts(items, "review_count"), "claim_id", "left"))
    return joined.fillna(0, ["file_count", "risk_count", "review_count"])


def newest_first(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.desc("created_at"), "claim_id")


def owner_row_filter(requests: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests an applicant may see, and the ``ACCESS_DENIED`` events of the others.

    Reviewers see everything; a task without an applicant is open. Unknown tasks give neither.
    """
    known = requests.join(tasks.select("claim_id", "applicant"), "claim_id")
    foreign = (F.col("role") == "applicant") & (F.coalesce("applicant", F.lit("")) != "") & (F.col("applicant") != F.col("user_id"))
    denied = known.where(foreign).select(
        "claim_id", F.lit("ACCESS_DENIED").alias("event_type"),
        F.concat(F.lit("用户 "), "user_id", F.lit("（"), "role", F.lit("）尝试访问非本人任务")).alias("message"))
    return known.where(~foreign).select(*requests.columns), denied


def status_dashboard(tasks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Totals by task status and by report status, in one row."""
    joined = tasks.select("claim_id", F.col("status").alias("task_status")).join(
        verdicts.select("claim_id", "status"), "claim_id", "left")
    return joined.agg(
        F.count("*").alias("total"), F.count_if(F.col("task_status") == "READY").alias("ready"),
        F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("review_required"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "UNDETERMINED").alias("undetermined"))


#: task state each event leads to; other events leave it as it is
EVENT_STATES = {
    "TASK_CREATED": "CREATED", "DOCUMENT_UPLOADED": "READY", "FIELD_CORRECTED": "READY",
    "AUDIT_COMPLETED": "COMPLETED", "AUDIT_FAILED": "FAILED",
}


def task_state(events: DataFrame, states: dict[str, str] | None = None) -> DataFrame:
    """Current state per task from its event log ``(task_id, event_id, event_type, created_at)``.

    A maximum over (time, id), so a task with most of the events is reduced before the shuffle.
    """
    states = states or EVENT_STATES
    state = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in states.items()])
    changes = events.select("task_id", "event_id", "created_at", state.alias("state")).where("state is not null")
    return changes.groupBy("task_id").agg(F.max(F.struct("created_at", "event_id", "state")).alias("last")).select(
        "task_id", "last.state", F.col("last.created_at").alias("updated_at"))


def event_timeline(events: DataFrame) -> DataFrame:
    """Events of each task in (created_at, event_id) order with their position and the gap before.

    Events are dealt out by ranges of (task, time, id), so a task with very many of them, on one day even, falls into
    many parts. Each part is numbered on its own; a task's parts before it add their counts, one row for each.
    """
    dealt = events.repartitionByRange("task_id", "created_at", "event_id").withColumn("_part", F.spark_partition_id())
    rows = stage(dealt, "timeline-parts")
    sizes = rows.groupBy("task_id", "_part").agg(F.count("*").alias("_n"), F.max("created_at").alias("_last"))
    parts = W.partitionBy("task_id").orderBy("_part")
    earlier = sizes.select("task_id", "_part", F.lag("_last").over(parts).alias("_previous"), F.coalesce(
        F.sum("_n").over(parts.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = W.partitionBy("_part", "task_id").orderBy("created_at", "event_id")
    placed = rows.select("*", F.row_number().over(inner).alias("_k"), F.lag("created_at").over(inner).alias("_gap"))
    return placed.join(earlier, ["task_id", "_part"]).select(
        *events.columns, (F.col("_k") + F.col("_before")).alias("position"), F.coalesce("_gap", "_previous").alias("previous_at"))


def title_autofill(tasks: DataFrame, wide: DataFrame) -> DataFrame:
    """Titles after an audit: a name given by a person stays, others follow the extracted fields."""
    fields = wide.select("claim_id", *[F.col(f"f_{n}.value").alias(f"x_{n}") for n in (
        "travel_start_date", "travel_end_date", "invoice_date", "applicant_name")])
    start = F.coalesce("x_travel_start_date", "x_invoice_date")
    end = F.coalesce("x_travel_end_date", "x_invoice_date")
    own = F.nullif(F.coalesce("applicant", F.lit("")), F.lit(""))
    titled = with_claim_title(tasks.join(fields, "claim_id", "left"), "auto", F.coalesce(own, F.col("x_applicant_name")),
                              F.col("expense_type"), start, end, F.col("note"), F.col("claim_id"))
    return titled.select(
        *[c for c in tasks.columns if c != "title"],
        F.when(F.col("title_locked"), sanitize_title(F.col("title"))).otherwise(F.col("auto")).alias("title"))


def dedupe_documents(documents: DataFrame, content: str = "content", key: str = "doc_id") -> DataFrame:
    """Exact duplicates by content hash: the first document of each content and its copy count."""
    return documents.groupBy(F.sha2(F.col(content), 256).alias("content_hash")).agg(
        F.min(key).alias("kept"), F.count("*").alias("copies")).withColumn(
        "document_id", F.substring("content_hash", 1, 16))
