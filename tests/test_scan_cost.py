"""What the queries over all claims read, open and search, and how often."""

import datetime as dt
import json

from pyspark.sql import functions as F

from claimsweep import catalog
from claimsweep.functions import naming, values
from claimsweep.operators import extract, merge, policy
from claimsweep.plans import audit as A
from claimsweep.sources import files, synth


def inputs(spark, tmp_path, n=70):
    orders = spark.range(1, n + 1).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7).alias("o_custkey"), F.lit(100.5).alias("o_totalprice"),
                                          F.lit("1997-03-01 00:00:00").cast("timestamp_ntz").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    return catalog.Inputs(spark, str(tmp_path))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_one_folder_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for n in range(60):
        (tmp_path / "in" / ("deep" if n % 7 == 0 else "") / f"{n}.txt").write_bytes(b"x" * n)
    (tmp_path / "in" / "_hidden.txt").write_bytes(b"no")
    (tmp_path / "top.txt").write_bytes(b"top")
    rows = files.uploaded_files(spark, str(tmp_path)).select("path", F.length("content").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert sorted(r["n"] for r in rows) == sorted([*range(60), 3])
    assert len({r["task"] for r in rows}) > 10


def test_clauses_are_sought_once_for_claims_that_ask_alike(spark, monkeypatch):
    names = "claim_id string, expense_type string, city string, department string, as_of string"
    asks = [("TRAVEL", "北京市", "研发部", "1997-03-01"), ("TRAVEL", None, None, "1997-03-01"), ("TRAVEL", "成都", None, None),
            ("MEDICAL", "北京", None, "1997-03-01"), ("PURCHASE", None, "ALL", "1997-03-01"), (None, "上海", "ALL", "1997-03-01")]
    claims = spark.createDataFrame([(f"c{n}", *asks[n % len(asks)]) for n in range(60)] + [("c0", *asks[0]), (None, *asks[0])], names)
    clauses = spark.createDataFrame(
        [(f"P{i}", f"{c}的住宿标准为300元/晚。", t) for i, (c, t) in enumerate((("北京", "TRAVEL"), ("上海", ""), ("成都", "TRAVEL"), ("北京", "MEDICAL")))],
        "chunk_id string, content string, expense_type string").select(
            "*", F.col("chunk_id").alias("ord"), F.lit("p").alias("policy_id"), F.lit("4").alias("section_path"), F.lit("V1").alias("version"),
            F.lit("ALL").alias("department"), F.lit("").alias("effective_from"), F.lit("").alias("effective_to"))
    base, asked = policy.baseline_chunks(spark), []
    for name in ("clause_match_city", "clause_match_expense"):
        whole = getattr(policy, name)
        monkeypatch.setattr(policy, name, lambda df, *a, whole=whole: asked.append(df.count()) or whole(df, *a))
    for published in (None, clauses):
        asked.clear()
        got = A.with_evidence(claims, base, published)
        assert sorted(asked) == [2, 3]
        assert got.columns == [*claims.columns, "evidence"]
        travel = claims.where("expense_type = 'TRAVEL'")
        other = claims.where("expense_type <> 'TRAVEL'")
        alone = policy.clause_match_city(travel, base, published).unionByName(policy.clause_match_expense(other, base, published))
        wanted = {r["claim_id"]: r["evidence"] for r in alone.where("claim_id is not null").collect()}
        rows = got.collect()
        assert len(rows) == 60 - 1 + 4 + 1  # a repeated claim id meets its clauses twice, as before
        assert all(r["evidence"] == wanted.get(r["claim_id"], []) for r in rows if r["claim_id"] is not None)
        assert any(wanted.values())


def test_rule_fields_need_no_structured_responses(spark, tmp_path, monkeypatch):
    x = inputs(spark, tmp_path)
    monkeypatch.setattr(merge, "structured_response_fields", None)
    wanted = sorted(map(str, extract.field_extract(x.materials).collect()))
    assert wanted and sorted(map(str, x.rule_fields.collect())) == wanted


def test_originals_are_read_for_corrected_claims_only(spark, tmp_path, monkeypatch):
    x = inputs(spark, tmp_path, 130)
    read, whole = [], A.document_facts
    monkeypatch.setattr(A, "document_facts", lambda pages, *a, **k: read.append(pages) or whole(pages, *a, **k))
    monkeypatch.setattr(catalog.Inputs, "of", classmethod(lambda cls, spark, sf_dir: x))
    got = catalog.QUERIES["correction_latest"](spark, x.sf_dir).collect()
    edited = {r["claim_id"] for r in synth.corrections(x.claims).collect()}
    assert {r["claim_id"] for r in got} == edited and len(edited) == 2
    assert {r["claim_id"] for r in read[0].collect()} == edited
    fields = {(r["claim_id"], r["name"]): r["value"] for r in x.rule_fields.collect()}
    assert all(r["original_value"] == fields.get((r["claim_id"], r["field_name"])) for r in got)


def test_wrappers_are_opened_without_making_rows(spark, monkeypatch):
    lists, whole = [], merge._opened
    monkeypatch.setattr(merge, "_opened", lambda rows, keys: lists.append(1) or whole(rows, keys))

    def fields(*values):
        bodies = [(str(n), json.dumps({"words_result": {"PurchaserName": v}})) for n, v in enumerate(values)]
        rows = merge.structured_response_fields(spark.createDataFrame(bodies, "claim_id string, body string")).collect()
        return {int(r["claim_id"]): r["value"] for r in rows}

    assert fields("a", {"text": {"value": {"word": {"content": "b"}}}}, {}, {"text": ""}, {"text": {}}, None, "", 7, {"value": "", "word": "c"}) == {
        0: "a", 1: "b", 7: "7", 8: "c"}
    assert not lists
    assert fields(["a", {"text": ["b", {"word": "c"}]}], {"value": {"text": ["d"]}}) == {0: "a b c", 1: "d"} and lists


def test_a_reply_is_searched_and_parsed_once(spark):
    replies = spark.createDataFrame([("a", '说明 {"fields": {"x": {"value": "1"}}} 完'), ("b", "{x}"), ("c", "none"), ("d", None), ("e", '{"fields": {"x": {"page_no": 0}}}')],
                                    "claim_id string, payload string")
    parsed = merge.parse_candidates(replies)
    assert plan_of(parsed).count("regexp_extract(") <= 2  # one search, compared and kept
    got = {r["claim_id"]: (r["fields"] and r["fields"]["x"]["value"], r["error_type"]) for r in parsed.collect()}
    assert got == {"a": ("1", None), "b": (None, "json_format_error"), "c": (None, "json_format_error"), "d": (None, "json_format_error"),
                   "e": (None, "schema_validation_error")}


def test_titles_in_steps_are_those_of_one_expression(spark):
    notes = ["", None, "  客户 拜访 ", "2019.2.19 出差 7", "张三 2019-2-19 会议", "2019年2月19日\t会议", "2019.2.19\n甲\n乙"]
    dates = [("2026-09-18", "2026-09-19"), ("2026-09-18", "2027-01-02"), ("2026-09-18", "2026-09-18"), (None, "2026-9-1"), ("x", ""), ("2026-13-01", "2026-01-02")]
    rows = [(f"c{i}", who, kind, a, b, note) for i, who in enumerate(("张三", " ", None, "李\t四")) for kind in ("HOTEL", "hotel ", "机票x", "", None, "其他")
            for a, b in dates for note in notes]
    df = spark.createDataFrame(rows, "claim_id string, who string, kind string, a string, b string, note string")
    parts = [F.col(c) for c in ("who", "kind", "a", "b", "note", "claim_id")]
    both = naming.with_claim_title(df.withColumn("whole", naming.claim_title(*parts)), "title", *parts)
    assert both.columns == [*df.columns, "whole", "title"]
    assert both.where(~F.col("title").eqNullSafe(F.col("whole"))).count() == 0
    steps = plan_of(naming.with_claim_title(df, "title", *parts))
    assert steps.count("regexp_extract(") == 6 and steps.count("regexp_replace(") <= 11


def test_iso_days_need_no_loose_pattern(spark):
    texts = ["1997-03-01", "1997-02-30", "0997-03-01", "0000-01-01", "1997-3-1", " 1997-03-01", "1997-03-01\n", "1997-03-01 x", "19970301", "2026年8月1日",
             "1997/03/01", "12-3-4", "", None, "１９９７-03-01", "1997-13-01", "1997-00-10"]
    df = spark.createDataFrame([(t,) for t in texts], "c string").select("c", values.date_parse(F.col("c")).alias("a"), values._loose_date(F.col("c")).alias("b"))
    assert df.where("not (a <=> b)").count() == 0
    assert {r["c"]: r["a"] for r in df.collect()}["1997-03-01"] == dt.date(1997, 3, 1)
