"""Scalar expressions for amounts, dates and normalized field values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.naming import DATE_PATTERN
from .text import blank_to_null, fold, strip

MONEY = "decimal(20,2)"


def amount_parse(c: Column) -> Column:
    """Decimal with two places, half-even; null when it is no number."""
    return F.bround(strip(c).try_cast("decimal(38,18)"), 2).cast(MONEY)


def model_amount(c: Column) -> Column:
    """The stricter form for proposed values: currency signs and commas go, negatives are refused."""
    cleaned = strip(F.translate(c, "￥¥元,", ""))
    value = F.bround(cleaned.try_cast("decimal(38,18)"), 2).cast(MONEY)
    return F.struct(
        F.when(value >= 0, value.cast("string")).alias("value"),
        F.when(value.isNull(), "invalid amount format").when(value < 0, "negative amount").alias("reason"),
    )


def _dashed(c: Column) -> Column:
    return F.translate(c, "年月/.日", "----")


def _calendar_date(text: Column, pattern: str) -> Column:
    part = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    iso = F.concat_ws("-", F.lpad(part[0], 4, "0"), F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0"))
    return F.when(text.rlike(pattern), iso.try_cast("date"))


def date_parse(c: Column) -> Column:
    """A real calendar date from loose year-month-day text, else null. Text in ISO form needs no other pattern."""
    return F.when(c.rlike(r"^[1-9]\d{3}-\d\d-\d\d$"), c.try_cast("date")).otherwise(_loose_date(c))


def _loose_date(c: Column) -> Column:
    return _calendar_date(_dashed(c), r"^\s*0*([1-9]\d{0,3})-\s*0*(\d{1,2})-\s*0*(\d{1,2})\s*$")


def model_date(c: Column) -> Column:
    text = _dashed(strip(c))
    pattern = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    value = _calendar_date(text, pattern)
    return F.struct(
        value.cast("string").alias("value"),
        F.when(~text.rlike(pattern), "invalid date format").when(value.isNull(), "invalid date value").alias("reason"),
    )


def iso_date_text(c: Column) -> Column:
    """Zero-padded ISO form of the first date-like run, without a calendar check; else folded text."""
    y, m, d = (F.regexp_extract(c, DATE_PATTERN, i) for i in (1, 2, 3))
    done = c.rlike(r"^\d{4}-\d\d-\d\d$")
    return F.when(done, c).when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(fold(c))


def value_normalize(name: Column, raw: Column) -> Column:
    """Normal form of a structured value, chosen by the field's name; empty text when nothing is left."""
    key = F.lower(name)
    digits = F.regexp_extract(F.replace(raw, F.lit(","), F.lit("")), r"-?\d+(?:\.\d{1,2})?", 0)
    money = F.coalesce(digits.try_cast("decimal(38,2)").cast("string"), F.lit(""))
    return F.coalesce(
        F.when(blank_to_null(raw).isNull(), "")
        .when(key.contains("date"), iso_date_text(raw))
        .when(key.contains("amount"), money)
        .when(key.contains("number") | key.contains("code"), F.regexp_replace(raw, r"[^0-9A-Za-z]", ""))
        .otherwise(fold(raw)),
        F.lit(""),
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Four-place ratio, 0 over an empty denominator."""
    return F.when(denominator > 0, F.bround(numerator / denominator, 4)).otherwise(F.lit(0.0))
