"""Clauses in force by the tree of days, and the rarest-piece index, against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimsweep.operators import policy

CHUNK = ("ord string, chunk_id string, section_path string, content string, policy_id string, version string, department string, "
         "expense_type string, effective_from string, effective_to string")


def day(n):
    return (dt.date(2024, 1, 1) + dt.timedelta(days=n)).isoformat()


def clauses(seed, n=150):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        start = r.choice(["", day(r.randrange(-400, 400)), "0001-01-01"])
        end = r.choice(["", None, day(r.randrange(-400, 800)), "9999-12-31"])
        if i % 10 == 0:  # one day, and the day that touches it
            start = end = day(i)
        if i % 10 == 1:
            start, end = day(i), ""
        city = r.choice(["北京", "上海", "乌", "乌鲁木齐市", "鲁木", ""])
        rows.append((f"{i:04d}", f"K{i}", "1", f"{city}的住宿标准为{i}元", f"P{i}", "V1", r.choice(["ALL", "市场部", "研发部"]),
                     r.choice(["", "TRAVEL", "EXPENSE"]), start, end))
    return rows


def holds(c, department, kind, as_of):
    return ((department in (None, "", "ALL") or c[6] in ("ALL", department)) and c[7] in ("", kind)
            and (not c[8] or as_of >= c[8]) and (not c[9] or as_of <= c[9]))


def asking(seed, n=60):
    r = random.Random(seed)
    return sorted({(r.choice(["ALL", "", "市场部", "财务部"]), r.choice(["TRAVEL", "EXPENSE"]), day(r.randrange(-500, 900))) for _ in range(n)}
                  | {("市场部", "TRAVEL", day(x)) for x in (9, 10, 11, 20, 21)})


@pytest.mark.parametrize("seed", [1, 2])
def test_every_clause_in_force(spark, seed):
    own, asked = clauses(seed), asking(seed)
    table = spark.createDataFrame(own, CHUNK)
    combos = spark.createDataFrame(asked, "department string, expense_type string, as_of string")
    got = policy.applicable_chunks(combos, table)
    expected = sorted((*a, c[1]) for a in asked for c in own if holds(c, *a))
    assert sorted((r["department"], r["expense_type"], r["as_of"], r["chunk_id"]) for r in got.collect()) == expected
    few = policy.applicable_chunks(combos, table, 2).collect()
    for a in asked:  # what is left still holds the first two
        first = [c[1] for c in own if holds(c, *a)][:2]
        kept = sorted((r["ord"], r["chunk_id"]) for r in few if (r["department"], r["expense_type"], r["as_of"]) == a)
        assert [c for _, c in kept[:2]] == first


def test_rows_of_the_index_do_not_hang_on_days(spark):
    table = spark.createDataFrame(clauses(3, 300), CHUNK)
    sizes = [r["n"] for r in table.select(F.size(policy._valid_nodes()).alias("n")).collect()]
    assert max(sizes) <= 2 * policy.DAY_LEVELS + 1 and min(sizes) >= 0
    open_ = table.where("effective_from = '' and coalesce(effective_to, '') = ''").select(F.size(policy._valid_nodes()).alias("n"))
    assert {r["n"] for r in open_.collect()} == {1}


@pytest.mark.parametrize("hot", [1, 7, 4096])
def test_cities_ask_for_their_rarest_piece(spark, hot):
    own = clauses(4) + [("9998", "K9998", "1", None, "P", "V", "ALL", "", "", ""), ("9999", "K9999", "1", "", "P", "V", "ALL", "", "", "")]
    cities = ["北京", "上海", "乌", "乌鲁木齐市", "鲁木", "木齐", "标", "没有", "住宿标准为1", None]
    found = policy.naming_pairs(spark.createDataFrame([(c,) for c in cities], "city string"), spark.createDataFrame(own, CHUNK), hot)
    expected = sorted((c, x[1]) for c in cities if c for x in own if x[3] and c in x[3])
    assert sorted((r["city"], r["chunk_id"]) for r in found.collect()) == expected


def test_published_clauses_of_a_city(spark):
    own = clauses(5, 200)
    asked = [(c, *a) for c in ("北京", "乌鲁木齐市", "乌") for a in asking(5, 30)]
    combos = spark.createDataFrame(asked, "city string, department string, expense_type string, as_of string")
    for keep in (1, 3):
        got = policy.named_in_force(combos, spark.createDataFrame(own, CHUNK), keep).collect()
        for a in asked:
            first = [c[1] for c in own if a[0] in c[3] and holds(c, *a[1:])][:keep]
            mine = sorted((r["ord"], r["chunk_id"]) for r in got if (r["city"], r["department"], r["expense_type"], r["as_of"]) == a)
            assert [c for _, c in mine[:keep]] == first


CLAIM = "claim_id string, department string, expense_type string, as_of string"


def joined(spark, claims, own, **options):
    table = spark.createDataFrame(own, CHUNK).drop("ord")
    documents = table.select("policy_id", F.lit("published").alias("status"))
    return policy.policy_as_of_join(spark.createDataFrame(claims, CLAIM), table, documents, **options)


@pytest.mark.parametrize("share", [3, 1024])
def test_every_claim_meets_every_clause_in_force(spark, share):
    own = clauses(6, 200) + clauses(6, 5)  # the first clauses twice
    own += [(f"x{i}", f"X{i}", "1", "", f"PX{i}", "V1", "ALL", "TRAVEL", since, until) for i, (since, until) in enumerate(
        [("2024-1-5", ""), ("", "2024-01"), ("soon", "2024-02-01"), ("", "+10000-01-01"), (None, ""), ("2024-01-01", "never")])]
    days = [*asking(7, 40), ("市场部", "TRAVEL", "2024-1-7"), ("ALL", "TRAVEL", None), (None, None, day(10)), ("研发部", "OTHER", "no day")]
    claims = [(f"c{i % 90}", *days[i % len(days)]) for i in range(200)]  # some claims twice
    filled = [(c, d or "", t or "TRAVEL", a) for c, d, t, a in claims]
    dated = [r for r in filled if r[3] and r[3] != "no day"]
    expected = sorted((*r, c[1], c[4]) for r in dated for c in own if c[8] is not None and holds(c, *r[1:]) and c[8] != "soon" and (c[9] or "") != "never")
    got = joined(spark, claims, own, share=share)
    assert got.columns == ["department", "expense_type", "as_of", "claim_id", *policy.CLAUSE_COLUMNS]
    names = ("claim_id", "department", "expense_type", "as_of", "chunk_id", "policy_id")
    plain = [r for r in got.select(*names).collect() if r["as_of"] != "2024-1-7" and not r["chunk_id"].startswith("X")]
    assert sorted(map(tuple, plain)) == [r for r in expected if r[3] != "2024-1-7" and not r[4].startswith("X")]
    table = spark.createDataFrame(own, CHUNK)  # odd ends and days: as one by one
    asked = spark.createDataFrame(filled, CLAIM)
    single = policy.applicable_chunks(asked.select("department", "expense_type", "as_of"), table)
    every = asked.join(single, ["department", "expense_type", "as_of"]).select(*names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, every.collect()))


def test_the_product_of_one_frequent_day_is_dealt_out(spark):
    claims = [(f"c{i}", "市场部", "TRAVEL", day(5)) for i in range(9000)]
    own = [(f"{i:04d}", f"K{i}", "1", "", f"P{i}", "V1", "ALL", "TRAVEL", "", "") for i in range(100)]
    rows = joined(spark, claims, own).groupBy(F.spark_partition_id().alias("task")).count().collect()
    sizes = [r["count"] for r in rows]
    assert sum(sizes) == 9000 * 100 and max(sizes) < 0.6 * sum(sizes)
