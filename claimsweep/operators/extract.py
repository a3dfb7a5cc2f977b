"""Labelled field extraction from material pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_contained, strip
from ..functions.values import iso_date_text
from ..rules import fields as R

FIELDS = tuple(R.FIELD_PATTERNS)

# where a field value comes from; the lowest wins, hand corrections are laid over the winner
API, RULES, MODEL = 1, 2, 3


def field_struct(source: int, value: Column, confidence: Column, document_id: Column, page_no: Column,
                 source_text: Column, file_order: Column | None = None) -> Column:
    """A field value that sorts by precedence, then by reading order."""
    order = F.lit(0) if file_order is None else file_order.cast("int")
    return F.struct(
        F.lit(source).alias("prio"), order.alias("file_order"), page_no.cast("int").alias("page_no"),
        value.alias("value"), confidence.alias("confidence"), document_id.alias("document_id"),
        source_text.alias("source_text"))


def _from_first_start(text: Column, starts) -> Column:
    """The text from the first word that a match may start with; null without one; all of it if none are stated.

    Characters are counted only up to words that a byte search has found.
    """
    if not starts:
        return text
    places = [F.when(text.contains(word), F.instr(text, word)) for word in starts]
    return F.substr(text, places[0] if len(places) == 1 else F.least(*places))


def _accepted(name: str, pattern: str, text: Column, value: Column) -> Column:
    """Payee values that are labels themselves, or stand in a signature row, are refused."""
    refused = R.REJECTED_VALUES.get(name)
    if not refused:
        return value != ""
    line = F.regexp_extract(text, rf"(?U)[^\n]*?(?:{pattern})[^\n]*", 0)
    signed = F.when(count_contained(text, R.SIGNATURE_LABELS) >= 2, count_contained(line, R.SIGNATURE_LABELS) >= 2)
    return (value != "") & ~value.isin(*refused) & ~F.coalesce(signed, F.lit(False))


def _plain(name: str, value: Column) -> Column:
    """Whether a value is accepted whatever the text around it."""
    return F.lit(False) if name in R.REJECTED_VALUES else value != ""


def with_field_hits(pages: DataFrame, patterns=None, prefix: str = "f_", starts=None) -> DataFrame:
    """Adds one struct column per field: the first accepted hit over its patterns, null without one.

    Narrow projections: where a pattern may start, what it matches there, what is kept. Where the
    rule pack states the words that matches start with (``starts``, by field and pattern), byte searches
    for them come first, so a pattern runs only on pages that can match it; other patterns run on all.
    Later patterns of a field run only where the earlier ones found nothing.
    """
    if patterns is None:
        patterns, starts = R.FIELD_PATTERNS, R.FIELD_STARTS
    stated = starts or {}
    rules = [(n, i, p) for n, ps in patterns.items() for i, p in enumerate(ps)]
    matched = pages.select("*", *[
        _from_first_start(F.col("text"), stated[n][i] if n in stated else ()).alias(f"t_{n}_{i}") for n, i, p in rules])
    for turn in range(max((len(ps) for ps in patterns.values()), default=0)):
        def value_of(name, i, pattern):
            text, found = F.col(f"t_{name}_{i}"), F.lit(False)
            for j in range(i):  # a refused value does not end the search
                found = found | F.coalesce(_plain(name, F.col(f"v_{name}_{j}")), F.lit(False))
            return strip(F.regexp_extract(text if i == 0 else F.when(~found, text), "(?U)" + pattern, 1))

        matched = matched.select("*", *[value_of(n, i, p).alias(f"v_{n}_{i}") for n, i, p in rules if i == turn])

    def hit(name, i, pattern):
        value = F.col(f"v_{name}_{i}")
        shown = iso_date_text(value) if name.endswith("_date") else value
        source = F.regexp_extract(f"t_{name}_{i}", "(?U)" + pattern, 0)
        return F.when(_accepted(name, pattern, F.col("text"), value), field_struct(
            RULES, shown, F.lit(1.0), F.col("document_id"), F.col("page_no"), source, F.col("file_order")))

    return matched.select(*pages.columns, *[
        F.coalesce(*[hit(n, i, p) for m, i, p in rules if m == n]).alias(prefix + n)
        for n in dict.fromkeys(n for n, _, _ in rules)])


def first_hits(names=FIELDS, prefix: str = "f_") -> list[Column]:
    """Aggregates that keep each field's winner by (source, file, page): a minimum, so it combines map-side."""
    return [F.min(prefix + n).alias(prefix + n) for n in names]


def wide_to_fields(wide: DataFrame, names=FIELDS, prefix: str = "f_") -> DataFrame:
    """Wide claim rows to the long ``fields`` table."""
    entries = F.array_compact(F.array(*[
        F.when(F.col(prefix + n).isNotNull(), F.struct(
            F.lit(n).alias("name"), F.col(f"{prefix}{n}.value").alias("value"),
            F.col(f"{prefix}{n}.confidence").alias("confidence"), F.col(f"{prefix}{n}.document_id").alias("document_id"), F.col(f"{prefix}{n}.page_no").alias("page_no"),
            F.col(f"{prefix}{n}.source_text").alias("source_text")))
        for n in names]))
    return wide.select("claim_id", F.inline(entries))


def field_extract(pages: DataFrame, patterns=None, starts=None) -> DataFrame:
    """``fields(claim_id, name, value, confidence, document_id, page_no, source_text)``.

    One scan and one shuffle: page texts stay where they are read, only hits travel.
    """
    names = tuple(patterns or R.FIELD_PATTERNS)
    wide = with_field_hits(pages, patterns, starts=starts).groupBy("claim_id").agg(*first_hits(names))
    return wide_to_fields(wide, names)
