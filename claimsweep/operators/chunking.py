"""Policy text to clauses, inside the row of each text: no line leaves it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAKS, strip
from ..rules import policies as P


def _lines(text: Column) -> Column:
    """The lines of a text: ``(body, heading, chapter, tab, rule)``."""
    def facts(raw):
        line = F.regexp_replace(raw, r"(?U)[\s\x1c-\x1f]+$", "")
        return F.struct(strip(line).alias("body"), line.rlike("(?U)" + P.HEADING_PATTERN).alias("heads"), line.contains("|").alias("tab"))

    def marks(x):
        heading = F.when(x["heads"], F.substring(x["body"], 1, P.HEADING_CHARS))
        return F.struct(x["body"].alias("body"), heading.alias("heading"), x["tab"].alias("tab"),
                        (x["tab"] & x["body"].rlike(r"^[|\-: ]+$")).alias("rule"),
                        (x["heads"] & F.coalesce(heading.rlike("(?U)" + P.CHAPTER_PATTERN), F.lit(False))).alias("chapter"))

    return F.transform(F.transform(F.split(text, LINE_BREAKS), facts), marks)


def _places(rows: Column, test) -> Column:
    """Places, from 0, of the rows that pass the test."""
    return F.filter(F.transform(rows, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def _cut(rows: Column, starts: Column) -> Column:
    """Slices of an array that begin at these places."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(rows)))
    return F.transform(starts, lambda a, i: F.slice(rows, a + 1, F.get(ends, i) - a))


def _units(lines: Column, header_at: Column) -> Column:
    """Units of a section in order: each run of text lines, and each table row under the section's first table line."""
    header = F.get(lines, header_at)["body"]

    def row(x, i):
        known = F.coalesce(header_at < i, F.lit(False))
        after = F.get(lines, i + 1)  # the line after the last one is a heading, or there is none
        opens = ~known & F.coalesce(after["rule"], F.lit(False)) & after["heading"].isNull()
        kept = x["tab"] & ~x["rule"] & ~opens & ~(known & (header == x["body"]))
        text = F.when(known, F.concat_ws("\n", header, x["body"])).otherwise(x["body"])
        return F.when(kept, F.struct(F.lit(True).alias("tab"), text.alias("text")))

    def run(part):  # the first line may be a table or an empty line; what follows it is text
        bodies = F.transform(F.filter(part, lambda y: ~y["x"]["tab"] & (y["x"]["body"] != "")), lambda y: y["x"]["body"])
        text = F.when(F.size(bodies) > 0, F.struct(F.lit(False).alias("tab"), F.array_join(bodies, " ").alias("text")))
        return F.array(row(part[0]["x"], part[0]["i"]), text)

    placed = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    breaks = _places(lines, lambda x: x["tab"] | (x["body"] == ""))
    starts = F.array_distinct(F.concat(F.array(F.lit(0)), breaks))
    return F.array_compact(F.flatten(F.transform(_cut(placed, starts), run)))


def chunk_text(texts: DataFrame) -> DataFrame:
    """``texts(policy_id, version, text, ...)`` to ``(policy_id, chunk_no, chunk_id, section_path, content)``.

    A text is cut into lines, these at headings into sections, a section at table and empty lines into units, and its
    units into clauses, each from a unit that is long enough to the next one. Each step cuts an array of the row into
    slices: its work follows the text's length, nothing is shuffled, and versions of a policy are apart as rows.
    """
    first = F.array(F.lit(0))
    rows = texts.where("text is not null").select("policy_id", "version", _lines(F.col("text")).alias("lines"))
    heads = F.array_distinct(F.concat(first, _places(F.col("lines"), lambda x: x["heading"].isNotNull())))
    rows = rows.select("policy_id", "version", F.transform(_cut(F.col("lines"), heads), lambda part: F.struct(
        part.alias("lines"), part[0]["heading"].alias("own"), part[0]["chapter"].alias("chapter"))).alias("sections"))
    chapters = F.array_distinct(F.concat(first, _places(F.col("sections"), lambda s: s["chapter"])))

    def placed(group):
        """The sections of one chapter with their paths, and the place of the first table line of each."""
        parent = F.when(group[0]["chapter"], group[0]["own"])

        def section(s):
            path = (F.when(s["own"].isNull(), P.DEFAULT_SECTION).when(s["chapter"] | parent.isNull(), s["own"])
                    .otherwise(F.concat_ws("·", parent, s["own"])))
            return F.struct(path.alias("path"), s["lines"].alias("lines"), F.get(_places(s["lines"], lambda x: x["tab"] & ~x["rule"]), F.lit(0)).alias("at"))

        return F.transform(group, section)

    rows = rows.select("policy_id", "version", F.flatten(F.transform(_cut(F.col("sections"), chapters), placed)).alias("sections"))
    rows = rows.select("policy_id", "version", F.transform("sections", lambda s: F.struct(
        s["path"].alias("path"), _units(s["lines"], s["at"]).alias("units"))).alias("sections"))
    rows = rows.select("policy_id", "version", F.transform("sections", lambda s: F.struct(
        s["path"].alias("path"), s["units"].alias("units"),
        _places(s["units"], lambda u: u["tab"] | (F.length(u["text"]) >= P.MIN_PIECE_CHARS)).alias("keepers"))).alias("sections"))

    def clauses(s):
        return F.transform(_cut(s["units"], s["keepers"]), lambda part: F.struct(
            F.concat(s["path"], F.when(part[0]["tab"], "·" + P.TABLE_ROW_SUFFIX).otherwise("")).alias("section_path"),
            F.array_join(F.transform(part, lambda u: u["text"]), " ").alias("content")))

    rows = rows.select("policy_id", "version", F.posexplode(F.flatten(F.transform("sections", clauses))).alias("at", "c"))
    number = (F.col("at") + 1).cast("int")
    return rows.select("policy_id", number.alias("chunk_no"), F.concat_ws("-", "policy_id", "version", F.format_string("%03d", number)).alias("chunk_id"),
                       "c.section_path", "c.content")
