"""Quality rules: text rules of a document, and lines that many documents of a host share."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import bound, fresh, lower_ascii, window_hashes, with_row_id, words_of
from .components import components

#: A line in more different texts of one host than this is boilerplate there.
LINE_LIMIT = 20
#: A document with less than this percentage of its words outside boilerplate lines is depleted.
LEAST_LEFT = 20
WINDOW = 8
#: Judged by share, a line is boilerplate in more than this part of a host's groups of near copies (20 of 500), and
#: in more than LINE_LIMIT of them: in fewer, nothing tells boilerplate from chance.
LINE_SHARE = 0.04
#: Near copies: of the hashes of all runs of NEAR_RUN words the minima under NEAR_BANDS * NEAR_ROWS orders; texts that
#: agree in all NEAR_ROWS minima of a band are linked, of two texts in more than nine of ten cases if every fifteenth
#: word of one is another one, whatever their length.
NEAR_RUN, NEAR_BANDS, NEAR_ROWS = 4, 12, 3
SYMBOLS = r"[^#*$%&|<>]+"
#: Copies of a small table's row for each side's salt, so that a line in a third of all texts meets in many tasks.
SALTS = 16


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in ``window``-word windows that occur twice or more in the text, the first included."""
    def twins(order: Column) -> Column:  # places of windows whose hash has a neighbour in the sorted windows
        def same(entry, at):
            return (F.get(order, at - 1)["h"] == entry["h"]) | (F.get(order, at + 1)["h"] == entry["h"])

        return F.array_sort(F.transform(F.filter(order, lambda e, at: F.coalesce(same(e, at), F.lit(False))), lambda e: e["i"]))

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(places, j + 1) - p, F.lit(window))))
        return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

    def count(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)  # most texts end here
        return F.when(repeats, bound(bound(order, twins), covered)).otherwise(0)

    return bound(window_hashes(words, window), count).cast("long")


def normal_line(line: Column) -> Column:
    """A-Z in lower case, white space between words as one blank, none around them."""
    return F.trim(F.regexp_replace(lower_ascii(line), r"[\x20\x09\x0B-\x0D]+", " "))


def normal_lines(text: Column) -> Column:
    """The normalised lines that hold a word; a text is normalised as a whole, then cut."""
    whole = F.regexp_replace(lower_ascii(text), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.array_remove(F.transform(F.split(whole, "\n", -1), lambda x: F.trim(x)), "")


def near_bands(words: Column) -> Column:
    """A hash for each band of minima over the text's word runs (shorter texts: none)."""
    def minimum(runs: Column, i: int) -> Column:  # each mask puts the hashes in another order
        mask = int.from_bytes(hashlib.md5(b"near %d" % i).digest()[:8], "big", signed=True)
        return F.array_min(F.transform(runs, lambda h: h.bitwiseXOR(F.lit(mask))))

    def bands(runs: Column) -> Column:
        some = [F.xxhash64(F.lit(b), *[minimum(runs, b * NEAR_ROWS + i) for i in range(NEAR_ROWS)]) for b in range(NEAR_BANDS)]
        return F.when(F.size(runs) > 0, F.array(*some)).otherwise(F.array().cast("array<bigint>"))

    return bound(window_hashes(words, NEAR_RUN), bands)


def document_facts(docs: DataFrame, id_col: str, text_col: str, host_col: str, keep: tuple[str, ...] = (),
                   bands: bool = False) -> DataFrame:
    """One pass over the texts; what leaves it is numbers, a hash for each line, and those of :func:`near_bands` if asked for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"), *keep)
    parts = parts.select("*", words_of(F.col("text")).alias("words"), normal_lines(F.col("text")).alias("normal"),
                         F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    line = F.transform("normal", lambda x: F.struct(
        F.xxhash64(x).alias("line"), (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")))
    return parts.select(
        "doc_id", "host", *keep, F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), line.alias("lines"),
        *([near_bands(F.col("words")).alias("bands")] if bands else []))


def _near_copies(texts: DataFrame) -> DataFrame:
    """``(u, v)``: each node of ``texts(node, host, bands)`` that is a near copy of another of its host, and its group's least."""
    meets = texts.select("node", F.explode("bands").alias("band"), "host").select(
        "node", F.xxhash64("band", F.col("host").isNull(), "host").alias("band"))
    first = meets.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    edges = meets.join(first.select(F.col("band").alias("b"), "least"), F.col("band") == F.col("b")).where("node <> least")
    return components(edges.select(F.col("node").alias("u"), F.col("least").alias("v")))


def _shared_lines(facts: DataFrame, least: int, share: float) -> DataFrame:
    """As :func:`_common_lines`, judged by the share of the host's groups of near copies that hold the line."""
    host = ["host", "t1", "t2"]
    texts = facts.select(*host, "bands").dropDuplicates(host)
    texts = texts.select("host", F.xxhash64(F.col("host").isNull(), *host).alias("node"), "bands")
    roots = _near_copies(texts)
    sizes = texts.join(roots, F.col("node") == F.col("u"), "left").groupBy("host").agg((F.count("*") - F.count("v")).alias("groups"))
    # lines of too few texts are of too few groups; few are left, each with the texts that hold it
    met = stage(_common_lines(facts, least), "quality-lines")
    own = met.select("host", "line", F.xxhash64(F.col("host").isNull(), *host).alias("node"))
    own = own.join(roots, F.col("node") == F.col("u"), "left").select("host", "line", F.coalesce("v", "node").alias("group")).distinct()
    counts = own.groupBy("host", "line").agg(F.count("*").alias("n_groups"))
    sizes = sizes.select(F.col("host").alias("h"), "groups")
    common = counts.join(sizes, F.col("host").eqNullSafe(F.col("h"))).where(
        (F.col("n_groups") > least) & (F.col("n_groups") > share * F.col("groups")))
    return _meet(met, common.select("host", "line"))


def _meet(lines: DataFrame, common: DataFrame) -> DataFrame:
    """The rows of ``lines(host, t1, t2, line, n)`` whose host and line are in ``common``."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    common = common.select(F.col("host").alias("h"), F.col("line").alias("l"), salts.alias("s"))
    salted = lines.withColumn("salt", F.pmod("t2", F.lit(SALTS)).cast("int"))
    return salted.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")) & (F.col("salt") == F.col("s"))).select(
        "host", "t1", "t2", "line", "n")


def _common_lines(facts: DataFrame, line_limit: int) -> DataFrame:
    """``(host, t1, t2, line, n)``: boilerplate lines of each different text of a host, n words in each."""
    host = ["host", "t1", "t2"]
    # each different text of a host once, its lines once each with the words that they hold altogether
    texts = facts.select(*host, "lines").dropDuplicates(host)
    lines = texts.select(*host, F.explode("lines").alias("x")).select(*host, "x.line", "x.n")
    lines = lines.groupBy(*host, "line").agg(F.sum("n").alias("n"))
    common = lines.groupBy("host", "line").count().where(F.col("count") > line_limit)
    return _meet(lines, common)


def apply_rules(docs: DataFrame, line_limit: int = LINE_LIMIT, least_left: int = LEAST_LEFT, min_words: int = 20,
                most_repeated: int = 30, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_left, kept)``.

    Lines are compared with A-Z in lower case and white space between words as one space. A line is
    removed where it occurs in more than ``line_limit`` different texts of a host; exact copies of a text
    count once, so copies alone make no line boilerplate. words_left counts the words outside removed
    lines. A document is kept unless it has fewer than ``min_words`` words, more than ``most_repeated``
    percent of its words in repeated windows, or less than ``least_left`` percent of its words left.
    Null texts count as empty (and fail); null hosts are one host; repeated rows are judged alike; no
    rows give no rows. Columns named in ``keep`` are carried along, others are ignored.
    """
    facts = stage(document_facts(docs, id_col, text_col, host_col, keep), "quality-facts")
    return _judged(facts, _common_lines(facts, line_limit), least_left, min_words, most_repeated).select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", "kept")


def _judged(facts: DataFrame, met: DataFrame, least_left: int, min_words: int, most_repeated: int) -> DataFrame:
    """``facts`` without lines, plus ``gone`` (hashes of the removed lines), ``base_failed``, ``words_left`` and ``kept``."""
    removed = met.groupBy("host", "t1", "t2").agg(F.sum("n").alias("removed"), F.collect_set("line").alias("gone"))  # lines of one text
    removed = removed.select(F.col("host").alias("h"), F.col("t1").alias("x1"), F.col("t2").alias("x2"), "removed", "gone")
    judged = facts.drop("lines", "bands").join(
        removed, F.col("host").eqNullSafe(F.col("h")) & (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2")), "left")
    words_left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    depleted = 100 * words_left < least_left * F.col("n_words")
    return judged.select("*", base.alias("base_failed"), words_left.cast("long").alias("words_left"), (~base & ~depleted).alias("kept"))


def without_common_lines(docs: DataFrame, line_limit: int = LINE_LIMIT, id_col: str = "doc_id", text_col: str = "text",
                         host_col: str = "source") -> DataFrame:
    """``docs`` (a stored table) with boilerplate lines taken out of the texts; null texts stay null."""
    row = fresh(docs, "row")
    numbered = with_row_id(docs, row)
    facts = stage(document_facts(numbered, id_col, text_col, host_col, (row,)), "quality-facts")
    lines = _common_lines(facts, line_limit).groupBy("host", "t1", "t2").agg(F.collect_set("line").alias("gone"))  # lines of one text
    lines = lines.select(F.col("host").alias("h"), F.col("t1").alias("x1"), F.col("t2").alias("x2"), "gone")
    found = facts.select(F.col(row).alias("r"), "host", "t1", "t2").join(
        lines, F.col("host").eqNullSafe(F.col("h")) & (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2"))).select("r", "gone")
    out = numbered.join(found, F.col(row) == F.col("r"), "left")
    return out.select(*[_cut(c, "gone").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _cut(text_col: str, gone: str) -> Column:
    """The text without the lines whose hashes are in ``gone`` (null: none)."""
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x: ~F.array_contains(gone, F.xxhash64(normal_line(x)))), "\n")
    return F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)


def keep_good(docs: DataFrame, line_limit: int | None = None, least_left: int = LEAST_LEFT, min_words: int = 20,
              most_repeated: int = 30, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
              line_share: float = LINE_SHARE, least_groups: int = LINE_LIMIT) -> DataFrame:
    """The rows of ``docs`` (a stored table) that the rules keep, with boilerplate lines taken out of their texts.

    Near copies of a text count once, and a line is boilerplate if more than ``least_groups`` and more than
    ``line_share`` of the host's groups of near copies hold it: a group alone makes no line boilerplate, and
    a larger host does not lose more. With ``line_limit``, lines are judged by that number of different texts,
    as in :func:`apply_rules`. Other columns stay as they are, those that were computed from the text too.

    Verdict and cut hang on host and text alone, so rows are met by these: no row numbers are needed.
    """
    facts = stage(document_facts(docs, id_col, text_col, host_col, bands=line_limit is None), "quality-facts")
    met = _shared_lines(facts, least_groups, line_share) if line_limit is None else _common_lines(facts, line_limit)
    good = _judged(facts, met, least_left, min_words, most_repeated).where("kept").select(
        "host", "t1", "t2", "gone").dropDuplicates(["host", "t1", "t2"])
    own = {c: fresh(docs, c) for c in ("good_host", "good_t1", "good_t2", "gone")}
    good = good.select(F.col("host").alias(own["good_host"]), F.col("t1").alias(own["good_t1"]), F.col("t2").alias(own["good_t2"]),
                       F.col("gone").alias(own["gone"]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.join(good, F.col(host_col).eqNullSafe(F.col(own["good_host"])) & (F.xxhash64(text) == F.col(own["good_t1"]))
                    & (F.xxhash64(F.lit(1), text) == F.col(own["good_t2"])))
    return out.select(*[_cut(c, own["gone"]).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
