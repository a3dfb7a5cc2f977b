"""Policy clauses: splitting, life cycle, and the joins that find the clauses of a claim.

Clause joins are solved over the distinct parameter combinations of the claims (city, department,
day, ...), never over the claims themselves, and attached by an equi-join. The "clause names the
city" test runs as an equi-join on two-character pieces, checked by ``contains``.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import LINE_BREAKS, WS, contains_any, strip
from ..rules import policies as P
from ..staging import stage

EVIDENCE = "array<struct<rank:int,chunk_id:string,section:string,content:string,score:double>>"


# ---------------------------------------------------------------- clauses from policy rows

def _cells(line: Column) -> Column:
    inner = F.regexp_replace(line, r"^\|+|\|+$", "")
    return F.array_join(F.transform(F.split(inner, r"\|", -1), strip), " ｜ ")


def table_row_split(content: Column) -> Column:
    """array<struct(suffix, content)>: one entry per table row behind its header, or the text as it is."""
    lines = F.filter(F.transform(F.split(content, LINE_BREAKS), strip),
                     lambda ln: ln.contains("|") & ~ln.contains("---"))
    header = _cells(F.try_element_at(lines, F.lit(1)))
    rows = F.transform(
        F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))),
        lambda ln, i: F.struct(F.concat(F.lit("-R"), (i + 1).cast("string")).alias("suffix"),
                               F.concat(header, F.lit("｜"), _cells(ln)).alias("content")))
    whole = F.array(F.struct(F.lit("").alias("suffix"), content.alias("content")))
    return F.when(F.size(lines) >= 2, rows).otherwise(whole)


def policy_chunks(rows: DataFrame) -> DataFrame:
    """Clauses with metadata from ``(source_file, row_no, chunk_id, section, content)``.

    ``ord`` sorts clauses by file, row and table row.
    """
    parts = rows.where(strip(F.col("content")) != "").select(
        "source_file", "row_no", F.coalesce("chunk_id", F.lit("")).alias("kid"),
        strip(F.coalesce("section", F.lit(""))).alias("section"),
        F.posexplode(table_row_split(strip(F.col("content")))).alias("part_no", "part"))
    kid = F.upper("kid")
    prefix = F.when(kid.contains("-"), F.substring_index(kid, "-", 1)).otherwise("TRAVEL")

    def meta(i):
        return F.coalesce(*[F.when(prefix == k, v[i]) for k, v in P.PREFIX_META.items()], F.lit("TRAVEL"))

    department = F.when(F.col("part.suffix") != "", F.coalesce(
        *[F.when(F.col("part.content").contains(d), d) for d in P.DEPARTMENTS], F.lit("ALL"))).otherwise("ALL")
    return parts.select(
        F.format_string("%s#%09d#%06d", "source_file", "row_no", "part_no").alias("ord"),
        F.concat("kid", "part.suffix").alias("chunk_id"), F.col("section").alias("section_path"),
        F.col("part.content").alias("content"), meta(0).alias("policy_id"),
        F.when(kid.contains("V1"), "V1").when(kid.contains("V2"), "V2").otherwise("V1").alias("version"),
        department.alias("department"), meta(1).alias("expense_type"),
        F.lit(P.BASELINE_EFFECTIVE_FROM).alias("effective_from"), F.lit("").alias("effective_to"))


def baseline_chunks(spark: SparkSession) -> DataFrame:
    """The built-in clauses, split (a fixed table of 16 rows)."""
    rows = spark.createDataFrame(
        [(f, i, k, s, c) for i, (f, k, s, c) in enumerate(P.BASELINE_ROWS)],
        "source_file string, row_no long, chunk_id string, section string, content string")
    return policy_chunks(rows)


# ---------------------------------------------------------------- life cycle

def policy_status(events: DataFrame) -> DataFrame:
    """Current state of each policy from its events; refused publications name their reason.

    Events: ``(policy_id, event_no, action, name, version, department, expense_type, effective_from,
    effective_to, chunk_count)`` with action create / chunk / publish / disable. A re-creation starts
    over as a draft without clauses.
    """
    w = W.partitionBy("policy_id").orderBy("event_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    created = F.col("action") == "create"
    known = events.withColumn("life", F.sum(created.cast("int")).over(w))
    life = W.partitionBy("policy_id", "life").orderBy("event_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    meta = F.struct("name", "version", "department", "expense_type", "effective_from", "effective_to")
    known = known.select(
        "*", F.last(F.when(created, meta), True).over(life).alias("meta"),
        F.coalesce(F.last(F.when(F.col("action") == "chunk", F.col("chunk_count")), True).over(life), F.lit(0)).alias("chunks"))
    filled = F.lit(True)
    for c in ("name", "version", "effective_from", "department", "expense_type"):
        filled = filled & (strip(F.coalesce(F.col(f"meta.{c}"), F.lit(""))) != "")
    refusal = (
        F.when(F.col("life") == 0, "not found")
        .when(F.col("action") != "publish", None)
        .when(~filled, "制度元数据不完整（名称/版本/生效时间/部门/费用类型），不允许发布")
        .when(F.col("chunks") <= 0, "制度尚未切片，不允许发布"))
    step = (F.when(F.col("action") == "create", "draft")
            .when((F.col("action") == "publish") & refusal.isNull(), "published")
            .when(F.col("action") == "disable", "disabled"))
    known = known.select("*", refusal.alias("refusal"), step.alias("step"))
    latest = F.struct("event_no", "meta", "chunks", "life")
    return known.where("life > 0").groupBy("policy_id").agg(
        F.max(latest).alias("l"),
        F.max_by("step", F.when(F.col("step").isNotNull(), F.col("event_no"))).alias("status"),
        F.max(F.struct("life", F.when(F.col("step") == "published", F.col("event_no")).alias("at"))).alias("pub"),
        F.count_if(F.col("refusal").isNotNull()).alias("refused"),
        F.max_by("refusal", F.when(F.col("refusal").isNotNull(), F.col("event_no"))).alias("last_refusal"),
    ).select("policy_id", "l.meta.*", F.col("l.chunks").alias("chunk_count"), "status",
             F.when(F.col("pub.life") == F.col("l.life"), F.col("pub.at")).alias("published_at"),
             "refused", "last_refusal")


def policy_version_switch(policies: DataFrame) -> DataFrame:
    """Publishing with a version switch leaves, per name, only the last published version in force.

    Only the newest publication per name is needed, so it is a maximum joined back by name.
    """
    newest = policies.where("status = 'published'").groupBy("name").agg(
        F.max(F.struct("published_at", "policy_id")).alias("newest"))
    kept = F.col("policy_id") == F.col("newest.policy_id")
    return policies.join(newest, "name", "left").select(
        *[c for c in policies.columns if c != "status"],
        F.when((F.col("status") == "published") & ~kept, "disabled").otherwise(F.col("status")).alias("status"),
        ((F.col("status") == "published") & ~kept).alias("switched_off"))


def published_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Clauses of published policies, in clause-id order, each under its policy's own id."""
    return chunks.join(documents.where("status = 'published'").select("policy_id"), "policy_id", "left_semi") \
        .withColumn("ord", F.col("chunk_id"))


# ---------------------------------------------------------------- clause search

def clean_city(c: Column) -> Column:
    cleaned = F.regexp_replace(c, "市$", "")
    return F.when(cleaned != "", cleaned)


def _runs(text: Column, size: int) -> Column:
    """All different runs of ``size`` characters of a text; none of a shorter one."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(size)))))


#: Clauses that hold a piece, beyond which its rows are dealt out to more tasks.
HOT_PIECE = 4096


def naming_pairs(cities: DataFrame, chunks: DataFrame, hot: int = HOT_PIECE) -> DataFrame:
    """Every (city, clause) where the clause's text contains the city.

    A city asks for the rarest of its two-character pieces only (its one character, if it has no more): the one
    that the fewest clauses hold. Pieces that many clauses hold are dealt out in shares, and a city that has
    no rarer piece asks all shares.
    """
    size = F.when(F.length("city") > 1, 2).otherwise(1)
    parts = cities.where("city is not null").distinct().select("city", F.explode(
        F.when(size == 2, _runs(F.col("city"), 2)).otherwise(F.array("city"))).alias("piece"))
    wanted = parts.select("piece").distinct()
    content = F.coalesce(F.col("content"), F.lit(""))
    none = F.array().cast("array<string>")
    every = F.explode(F.concat(F.coalesce(_runs(content, 1), none), F.coalesce(_runs(content, 2), none))).alias("piece")
    seen = chunks.select(every).join(wanted, "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("df"))
    rarest = parts.join(seen, "piece", "left").groupBy("city").agg(
        F.min(F.coalesce("df", F.lit(0))).alias("df"), F.min_by("piece", F.struct(F.coalesce("df", F.lit(0)), "piece")).alias("piece"))
    # written, so that its two readers, and the readers of the pairs, have plans of a few steps
    rarest = stage(rarest.where("df > 0").withColumn("shares", F.ceil(F.col("df") / hot).cast("long")), "city-pieces")
    asked = rarest.select("city", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    index = _met(chunks.select("*", every), rarest.select("piece", "shares").distinct(), ["piece"]).withColumn(
        "share", F.pmod(F.xxhash64("content", *[c for c in ("chunk_id", "ord") if c in chunks.columns]), F.col("shares"))).drop("shares")
    return stage(_met(asked, index, ["piece", "share"]).where(F.col("content").contains(F.col("city"))).drop("piece", "share"), "city-clauses")


def _met(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """A join by a shuffle, where generators make a side's rows: a clause for each piece of its text, a day for each level.

    Spark's estimate leaves such rows out. It would take a side of a million of them for small, and gather it in the driver
    to broadcast it.
    """
    return left.hint("merge").join(right.hint("merge"), keys)


def _numbered(candidates: DataFrame, keys, keep: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "source_rank", "ord")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _collected(ranked: DataFrame, keys) -> DataFrame:
    """At most ``keep`` clauses per key as one array; the rank filter bounds it."""
    item = F.struct(F.col("rank").cast("int").alias("rank"), "chunk_id", F.col("section_path").alias("section"),
                    "content", F.col("score").cast("double").alias("score"))
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("evidence"))


def _tier(city: Column) -> Column:
    return F.when(city.isin(*P.FIRST_TIER_CITIES), "first").otherwise("other")


def _other_tier() -> Column:
    """The tier a fallback clause serves, read from its text so that the join keeps its key."""
    return F.when(F.col("content").contains(P.FALLBACK_PHRASE), "other")


def _fallback_head(chunks: DataFrame, keep: int, gate: str | None = None) -> DataFrame:
    """The first ``keep`` fallback clauses (per gate).

    Exact: a clause of this head that also names the city is skipped there, but then it takes a place
    among the top with a higher score, so no later fallback clause can be among the first ``keep``.
    """
    found = chunks.where(F.col("content").contains(P.FALLBACK_PHRASE))
    if gate is None:
        return found.orderBy("ord").limit(keep)
    order = W.partitionBy(gate).orderBy("ord")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n")


def _travel_baseline(cities: DataFrame, chunks: DataFrame, keep: int) -> DataFrame:
    travel = chunks.where(F.col("chunk_id").startswith("TRAVEL"))
    named = naming_pairs(cities, travel).withColumn("score", F.lit(P.SCORE_CITY))
    head = _fallback_head(travel, keep).withColumn("tier", _other_tier())
    other = (cities.select("city", _tier(F.col("city")).alias("tier")).join(head, "tier").drop("tier")
             .where(~F.col("content").contains(F.col("city"))).withColumn("score", F.lit(P.SCORE_FALLBACK)))
    return named.unionByName(other).withColumn("source_rank", F.lit(0))


def _in_force(day: Column, clause: Column | None = None) -> Column:
    since, until = (F.col(c) if clause is None else clause[c] for c in ("effective_from", "effective_to"))
    return ((since == "") | (day >= since)) & ((F.coalesce(until, F.lit("")) == "") | (day <= until))


def _department_keys(department: Column) -> Column:
    """A claim without department, or of ALL, sees every department's clauses; others their own and those for ALL."""
    everyone = F.coalesce(department, F.lit("")).isin("", "ALL")
    return F.explode(F.when(everyone, F.array(F.lit("*"))).otherwise(F.array(F.lit("ALL"), department)))


#: Levels of the tree of days: 2**22 days reach past the year 9999.
DAY_LEVELS = 22


def _day_number(day: Column) -> Column:
    """Days since the year 1; null for what is no ISO day."""
    return F.datediff(day.try_cast("date"), F.lit("0001-01-01").cast("date")).cast("long")


def _halved(n: Column, level: Column) -> Column:
    return F.call_function("shiftright", n, level)


def _valid_nodes() -> Column:
    """The fewest nodes (level, node) of the tree of days that make up a clause's validity, ends included.

    At most two on each level, however long the interval is. An end that is empty, or no day, is open.
    """
    first = F.coalesce(_day_number(F.col("effective_from")), F.lit(0).cast("long"))
    last = F.coalesce(_day_number(F.coalesce("effective_to", F.lit(""))), F.lit((1 << DAY_LEVELS) - 1).cast("long"))

    def on(level):
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = _halved(first + size - 1, level), _halved(last + 1, level)
        node = lambda n: F.struct(level.alias("level"), n.alias("node"))
        return F.array(F.when((low < high) & (low % 2 == 1), node(low)), F.when((high % 2 == 1) & (low + low % 2 < high), node(high - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(DAY_LEVELS)), on)))


def _nodes_of(day: Column) -> Column:
    """The node of a day on each level."""
    number = _day_number(day)
    nodes = F.transform(F.sequence(F.lit(0), F.lit(DAY_LEVELS)), lambda i: F.struct(i.alias("level"), _halved(number, i).alias("node")))
    return F.when(number.isNotNull(), nodes)


def _plain_days() -> Column:
    """Whether both ends are ISO days or empty: then a clause holds on every day of its nodes."""
    plain = lambda c: (c == "") | (c.try_cast("date").cast("string") == c)
    return F.coalesce(plain(F.col("effective_from")) & plain(F.coalesce("effective_to", F.lit(""))), F.lit(False))


def _first_of_nodes(index: DataFrame, keys, keep: int | None) -> DataFrame:
    """Of the clauses of one node that score alike, only the first ``keep``: a day meets all of a node's clauses or none."""
    if keep is None:
        return index
    order = W.partitionBy(*keys, "level", "node", "plain").orderBy("ord")
    return index.withColumn("n", F.row_number().over(order)).where(~F.col("plain") | (F.col("n") <= keep)).drop("n")


def named_in_force(combos: DataFrame, published: DataFrame, keep: int) -> DataFrame:
    """Published clauses that name the city of ``(city, department, as_of, expense_type)`` and hold for it.

    A clause stands at the nodes of the tree of days that make up its validity, a day asks its node on each level:
    each clause in force is met once, and a clause without end costs no more rows than one of a year. ``as_of`` is
    an ISO day. Of a node only the first ``keep`` clauses of a (city, department, type) are kept.
    """
    columns = ["ord", "chunk_id", "section_path", "content"]
    asked = combos.select("*", _department_keys(F.col("department")).alias("dept_key"))
    asked = asked.select("*", F.explode(F.array_distinct(F.array(F.col("expense_type"), F.lit("")))).alias("chunk_type"))
    asked = asked.select("*", F.inline(_nodes_of(F.col("as_of"))))
    clauses = published.select(*columns, F.col("department").alias("chunk_department"),
                               F.col("expense_type").alias("chunk_type"), "effective_from", "effective_to")
    index = naming_pairs(combos.select("city").distinct(), clauses).withColumn("plain", _plain_days())
    index = index.select("*", F.explode(F.array_distinct(F.array(F.col("chunk_department"), F.lit("*")))).alias("dept_key"))
    index = index.select("*", F.inline(_valid_nodes()))
    index = _first_of_nodes(index, ["city", "dept_key", "chunk_type"], keep)
    return (_met(asked, index, ["city", "dept_key", "chunk_type", "level", "node"])
            .where(_in_force(F.col("as_of")))
            .select(*combos.columns, *columns))


def clause_match_city(claims: DataFrame, chunks: DataFrame, published: DataFrame | None = None,
                      keep: int = P.CLAUSES_KEPT) -> DataFrame:
    """Claims with the ``evidence`` array of their travel clauses.

    Claims: ``(claim_id, city, ...)``; with ``published`` also ``department`` and ``as_of`` (ISO day).
    """
    keys = ["city"] if published is None else ["city", "department", "as_of"]
    keyed = claims.withColumn("city", clean_city(F.col("city")))
    combos = keyed.select(*keys).where("city is not null").distinct()
    columns = ["ord", "chunk_id", "section_path", "content"]
    base = _travel_baseline(combos.select("city").distinct(), chunks.select(*columns), keep)
    best = _numbered(base, ["city"], keep).drop("rank")
    if published is None:
        ranked = _numbered(best, keys, keep)
    else:
        best = combos.select(*keys).join(best, "city")
        travel = published.where(F.col("expense_type").isin("", "TRAVEL"))  # clauses of other types hold for no travel claim
        named = named_in_force(combos.withColumn("expense_type", F.lit("TRAVEL")), travel, keep).select(
            *keys, *columns, F.lit(P.SCORE_PUBLISHED_CITY).alias("score"), F.lit(1).alias("source_rank"))
        ranked = _numbered(best.unionByName(named), keys, keep)
    return attach_evidence(keyed, _collected(ranked, keys), keys, claims.columns)


def attach_evidence(claims: DataFrame, evidence: DataFrame, keys, columns) -> DataFrame:
    marked = claims
    for k in keys:  # null-safe keys without losing the hash join
        marked = marked.withColumn(f"_{k}", F.coalesce(F.col(k).cast("string"), F.lit("")))
        evidence = evidence.withColumn(f"_{k}", F.coalesce(F.col(k).cast("string"), F.lit(""))).drop(k)
    joined = marked.join(evidence, [f"_{k}" for k in keys], "left")
    return joined.select(*columns, F.coalesce("evidence", F.array().cast(EVIDENCE)).alias("evidence"))


def evidence_long(claims: DataFrame) -> DataFrame:
    return claims.select("claim_id", F.inline("evidence"))


def _asked_nodes(combos: DataFrame) -> DataFrame:
    """Rows of ``(department, expense_type, as_of, ...)`` with every node that may hold clauses for them."""
    asked = combos.select("*", _department_keys(F.col("department")).alias("dept_key"),
                          F.explode(F.array_distinct(F.array(F.col("expense_type"), F.lit("")))).alias("chunk_type"))
    return asked.select("*", F.inline(_nodes_of(F.col("as_of"))))


def _clauses_at_nodes(published: DataFrame) -> DataFrame:
    """Clauses at the nodes of the tree of days, under their own department's key and under the key of all."""
    index = published.select(
        "ord", "chunk_id", "section_path", "content", "policy_id", "version", "effective_from", "effective_to",
        F.col("department").alias("chunk_department"), F.col("expense_type").alias("chunk_type")).withColumn("plain", _plain_days())
    index = index.select("*", F.explode(F.array(F.col("chunk_department"), F.lit("*"))).alias("dept_key"))
    return index.select("*", F.inline(_valid_nodes()))


def applicable_chunks(combos: DataFrame, published: DataFrame, keep: int | None = None) -> DataFrame:
    """(department, expense_type, as_of) x clause in force: an interval join made of equi-joins.

    Clauses stand at nodes of the tree of days, see :func:`named_in_force`; with ``keep`` only the first ones
    of each node and type.
    """
    asked = _asked_nodes(combos.select("department", "expense_type", "as_of").distinct())
    index = _first_of_nodes(_clauses_at_nodes(published), ["dept_key", "chunk_type"], keep)
    return (_met(asked, index, ["chunk_type", "dept_key", "level", "node"])
            .where(_in_force(F.col("as_of"))).drop("level", "node", "dept_key", "chunk_type", "plain"))


#: About as many clauses go into one row of the product's side of clauses.
CLAUSE_BLOCK = 64
#: Claims of one (department, type, day) beyond which they are dealt out to more tasks.
CLAIM_SHARE = 1024
CLAUSE_COLUMNS = ("ord", "chunk_id", "section_path", "content", "policy_id", "version", "effective_from", "effective_to", "chunk_department")


def applicable_blocks(combos: DataFrame, published: DataFrame, columns=CLAUSE_COLUMNS, block: int = CLAUSE_BLOCK) -> DataFrame:
    """The clauses of :func:`applicable_chunks` as arrays ``clauses`` of about ``block`` structs; ``combos`` are different rows.

    The clauses of a node are cut into blocks once, by hash, and a day meets whole blocks: clauses are compared one by one only
    where an end, or the day, is no ISO day. A node that holds many clauses is met block by block, in different tasks.
    """
    at = ["chunk_type", "dept_key", "level", "node"]
    iso = lambda c: c.try_cast("date").cast("string").eqNullSafe(c) & (F.length(c) == 10)
    ten = lambda c: F.length(F.coalesce(c, F.lit(""))).isin(0, 10)
    sure = F.col("plain") & ten(F.col("effective_from")) & ten(F.col("effective_to"))
    index = _clauses_at_nodes(published)
    sizes = index.groupBy(*at).agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    member = F.struct(F.struct(*columns).alias("clause"), "effective_from", "effective_to")
    blocks = index.select(*at, sure.alias("sure"), member.alias("member")).join(sizes, at)
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")))
    blocks = blocks.groupBy(*at, "block", "sure").agg(F.collect_list("member").alias("members"))
    asked = _asked_nodes(combos).join(sizes, at)
    asked = asked.select(*combos.columns, *at, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    day = F.col("as_of")
    met = F.when(F.col("sure") & iso(day), F.col("members")).otherwise(F.filter("members", lambda c: _in_force(day, c)))
    return asked.join(blocks, [*at, "block"]).select(*combos.columns, met["clause"].alias("clauses"))


def policy_as_of_join(claims: DataFrame, chunks: DataFrame, documents: DataFrame, columns=CLAUSE_COLUMNS,
                      share: int = CLAIM_SHARE) -> DataFrame:
    """Every clause in force for every claim, by department, expense type and day; ``columns`` of the clauses.

    Clauses are found once for each (department, type, day) that occurs, in blocks; the result is the requested product of claims
    and clauses. Its sides are small beside it, so they are dealt out to a fixed number of tasks instead of one for so many bytes
    read, and the claims of a frequent (department, type, day) in shares. For a claim's best clauses use the matching operators below.
    """
    keys = ["department", "expense_type", "as_of"]
    n = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = claims.select("claim_id", F.coalesce("department", F.lit("")).alias("department"),
                           F.coalesce("expense_type", F.lit("TRAVEL")).alias("expense_type"), "as_of")
    combos = filled.groupBy(*keys).agg(F.ceil(F.count("*") / share).cast("long").alias("shares"))
    published = published_chunks(chunks, documents).repartition("chunk_id")
    found = applicable_blocks(combos, published, columns)
    found = found.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "clauses")
    dealt = filled.join(combos, keys).withColumn("share", F.pmod(F.xxhash64("claim_id"), F.col("shares"))).drop("shares")
    return (dealt.repartition(n, *keys, "share").join(found.repartition(n, *keys, "share"), [*keys, "share"])
            .select(*keys, "claim_id", F.inline("clauses")).select(*keys, "claim_id", *columns))


def clause_match_expense(claims: DataFrame, chunks: DataFrame, published: DataFrame | None = None,
                         keep: int = P.CLAUSES_KEPT) -> DataFrame:
    """The same for other expense types: a keyword gate per type, clauses without a city count too."""
    keys = ["expense_type", "city", "department", "as_of"]
    keyed = claims.withColumn("city", F.coalesce(clean_city(F.col("city")), F.lit(""))).withColumn(
        "department", F.coalesce("department", F.lit("")))
    combos = keyed.select(*keys).distinct()
    columns = ["ord", "chunk_id", "section_path", "content"]
    gate = F.when(F.col("expense_type").isin(*P.EXPENSE_GATES), F.col("expense_type")).otherwise("*").alias("gate")
    gates = F.explode(F.array_compact(F.array(
        F.lit("*"), *[F.when(contains_any(F.col("content"), words), t) for t, words in P.EXPENSE_GATES.items()])))
    gated = chunks.select(*columns, gates.alias("gate"))
    asked = combos.select("city", gate).distinct()
    cities = asked.where("city <> ''").select("city").distinct()

    named = naming_pairs(cities, gated).join(asked, ["city", "gate"]).withColumn("score", F.lit(P.SCORE_CITY))
    head = _fallback_head(gated, keep, "gate").withColumn("tier", _other_tier())
    other = (asked.where("city <> ''").withColumn("tier", _tier(F.col("city"))).join(head, ["gate", "tier"]).drop("tier")
             .where(~F.col("content").contains(F.col("city"))).withColumn("score", F.lit(P.SCORE_FALLBACK)))
    first = gated.withColumn("n", F.row_number().over(W.partitionBy("gate").orderBy("ord"))).where(F.col("n") <= keep).drop("n")
    cityless = asked.where("city = ''").join(first, "gate").withColumn("score", F.lit(P.SCORE_FALLBACK))
    base = named.unionByName(other).unionByName(cityless).withColumn("source_rank", F.lit(0))
    base = _numbered(base, ["city", "gate"], keep).drop("rank")
    pool = combos.withColumn("gate", gate).join(base, ["city", "gate"]).drop("gate")
    if published is not None:
        types = combos.select("expense_type", "department", "as_of").distinct()
        head = applicable_chunks(types, published, keep)
        head = head.withColumn("n", F.row_number().over(
            W.partitionBy("expense_type", "department", "as_of").orderBy("ord"))).where(F.col("n") <= keep)
        general = (combos.join(head.select("expense_type", "department", "as_of", *columns),
                               ["expense_type", "department", "as_of"])
                   .where((F.col("city") == "") | ~F.col("content").contains(F.col("city")))
                   .withColumn("score", F.lit(P.SCORE_PUBLISHED)))
        local = named_in_force(combos.where("city <> ''"), published, keep).withColumn("score", F.lit(P.SCORE_PUBLISHED_CITY))
        both = general.select(*keys, *columns, "score").unionByName(local.select(*keys, *columns, "score"))
        pool = pool.unionByName(both.withColumn("source_rank", F.lit(1)))
    ranked = _numbered(pool, keys, keep)
    return attach_evidence(keyed, _collected(ranked, keys), keys, claims.columns)
