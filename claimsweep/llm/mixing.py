"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the rest.

A document's expected copies are e = rate of its source * weight, at most ``most``; the rate is such that the
sizes times e add up to the source's target. floor(e) copies are certain. The rest of the target is filled by order sampling: with u uniform and
p = e - floor(e), documents come in the order of (u / (1 - u)) / (p / (1 - p)), until the words that are
still wanted are taken. The sample's size is fixed in words: it misses by half a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .common import fresh, with_row_id, words_of

#: Pareto ranks are cut into so many ranges of each source; only the range that the cut falls in matters
#: row by row, and no task holds more than one range of a source.
RANGES = 4096


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of the key; the same in every run and engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes(source, source_size)`` plus ``target``: one row for each source.

    Sources in code point order (null last) take the weights in turn. A source whose part would exceed
    ``most`` times its size gets just that; what it leaves goes to the others by weight. With sources
    ordered by limit over weight the saturated ones come first, so prefix sums give the common rate.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = sizes.select("*", turn.alias("weight"), (F.col("source_size") * float(most)).alias("limit"))
    limit = limit.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    earlier, later = (order.rowsBetween(Window.unboundedPreceding, -1),
                      order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rates = limit.select(
        "*", ((F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) * float(share)
               - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)).alias("rate"))
    rate = F.min(F.struct(F.when(F.col("rate") <= F.col("ratio"), F.col("ratio")).isNull().alias("no"),
                          "ratio", F.col("source").isNull().alias("last"), "source", "rate")).over(Window.partitionBy())  # first in that order
    fits = rates.select("*", rate.alias("first"))
    return fits.select("source", "source_size", F.when(
        F.col("first.no"), F.col("limit")).otherwise(F.least("limit", F.col("first.rate") * F.col("weight"))).alias("target"))


def rates(levels: DataFrame, most: float) -> DataFrame:
    """``(source, rate)`` from ``levels(source, own, words, target)``: words of each weight of each source.

    Documents of the largest weights reach ``most`` copies first; what they cannot take goes to the others. The rate
    is null where all weights reach it. A source has few different weights: they stand in one window.
    """
    order = Window.partitionBy("source").orderBy(F.desc("own"))
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.coalesce(F.sum(F.col("words") * float(most)).over(earlier), F.lit(0.0))
    rate = (F.col("target") - full) / F.sum(F.col("words") * F.col("own")).over(later)
    fits = levels.where("own > 0 and words > 0").withColumn("rate", rate)
    return fits.groupBy("source").agg(F.max_by("rate", F.when(F.col("rate") * F.col("own") <= most, F.col("own"))).alias("rate"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0,
        weight_col: str | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, a row for each row of ``docs``.

    ``weight_col`` makes documents of a source more or less likely (default: all alike, so likelihoods
    differ between sources only); it holds few different values, such as classes of length. Null or non-positive
    weights count as 0, and a source whose weights are all 0 takes no copies. taken = copies * size; no document is taken more than ``most`` times.
    Null and empty texts have size 0. Null sources form one source, ordered last. Rows are drawn by id,
    by the text where the id is null; repeated rows are drawn one by one, in a fixed order. No rows give
    no rows. Columns named in ``keep`` are carried along.
    """
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit(""))
    facts = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        F.size(words_of(F.col(text_col))).cast("long").alias("size"),
                        weight.alias("own"), uniform(key, seed).alias("u"), *keep)
    facts = stage(facts, "mix-facts")
    sizes = facts.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stage(targets(sizes, weights, share, most), "mix-targets")
    own_source = goals.select(F.col("source").alias("s"), "target")
    levels = facts.groupBy("source", "own").agg(F.sum("size").alias("words")).join(
        own_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = rates(levels, most).select(F.col("source").alias("s"), "rate")
    goals = goals.join(rate, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # one row for each source; Spark broadcasts it only if it is small, and else splits a hot source's rows
    hoped = facts.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    expected = F.when((F.col("own") > 0) & (F.col("target") > 0), F.coalesce(F.least(F.col("rate") * F.col("own"), F.lit(float(most))), F.lit(float(most)))).otherwise(0.0)
    hoped = hoped.withColumn("expected", expected).withColumn("certain", F.floor("expected").cast("long"))
    hoped = hoped.withColumn("p", F.col("expected") - F.col("certain"))
    # words left to draw, and what may be drawn, for each source
    open_ = F.col("p") > 0
    left = hoped.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("wanted"),
        F.sum(F.when(open_, F.col("p") * F.col("size"))).alias("hoped_words"),
        F.sum(F.when(open_, F.col("size"))).alias("open_words"))
    left = left.select(F.col("source").alias("s"), "wanted",
                       F.least(F.coalesce(F.try_divide("hoped_words", "open_words"), F.lit(0.5)), F.lit(1 - 1e-9)).alias("mean_p"))
    drawn = hoped.join(left, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rank = F.when(open_, (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p")))
    drawn = drawn.withColumn("rank", rank)
    # monotone in rank and about even over the rows of a source
    even = 1 - 1 / (1 + F.col("rank") * (F.col("mean_p") / (1 - F.col("mean_p"))))
    # rows without a draw need no order: they are only spread
    place = F.when(F.col("rank").isNull(), -1 - F.floor(F.col("u") * RANGES)).otherwise(F.least(F.floor(even * RANGES), F.lit(RANGES)))
    drawn = drawn.withColumn("range", place.cast("int"))
    drawn = drawn.repartition(F.col("source"), F.col("range"))
    ranges = drawn.where("rank is not null").groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"),
                           F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"))
    inside = Window.partitionBy("source", "range").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("words_in_range", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    drawn = drawn.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")), "left")
    hit = (F.col("rank").isNotNull() & (F.col("words_before") + F.col("words_in_range") + F.col("size") / 2 <= F.col("wanted")))
    copies = F.col("certain") + F.coalesce(hit, F.lit(False)).cast("long")
    return drawn.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                        (copies * F.col("size")).alias("taken"), *keep)


def middle_length(text: Column, few: int = 50, many: int = 1000) -> Column:
    """A weight of 2 for texts of ``few`` to ``many`` words, else 1: fragments and very long texts come less often."""
    return F.when(F.size(words_of(text)).between(few, many), 2.0).otherwise(1.0)


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (a stored table), with all their columns, each as often as the mixture takes it."""
    row, copies = fresh(docs, "row"), fresh(docs, "copies")
    numbered = with_row_id(docs, row)
    taken = mix(numbered, keep=(row,), **options).where("copies > 0").select(F.col(row).alias("r"), F.col("copies").cast("int").alias("c"))
    out = numbered.join(taken, F.col(row) == F.col("r"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col("c"))).alias(copies)).drop(copies)
