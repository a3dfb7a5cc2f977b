"""Scalar expressions for claim titles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import naming as R
from .text import fold, strip


def sanitize_title(c: Column) -> Column:
    """Control characters out, white space folded, length bound applied."""
    cleaned = fold(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]+", " "))
    return F.trim(F.substring(cleaned, 1, R.MAX_TITLE_CHARS))


def _parts(c: Column):
    return tuple(F.regexp_extract(F.coalesce(c, F.lit("")), R.DATE_PATTERN, i).try_cast("int") for i in (1, 2, 3))


def _is_date(parts) -> Column:
    y, m, d = parts
    return y.isNotNull() & m.between(1, 12) & d.between(1, 31)


def single_date(c: Column) -> Column:
    return _single(_parts(c))


def _single(parts) -> Column:
    return F.when(_is_date(parts), F.concat_ws(".", *parts)).otherwise("")


def date_range(start: Column, end: Column) -> Column:
    """``2026.9.18-9.19``; the right end shows its year only when it differs."""
    return _range(_parts(start), _parts(end))


def _range(start, end) -> Column:
    (y1, m1, d1), (y2, m2, d2) = start, end
    has_start, has_end = _is_date(start), _is_date(end)
    head = F.concat_ws(".", y1, m1, d1)
    tail = F.when(y1 == y2, F.concat_ws(".", m2, d2)).otherwise(F.concat_ws(".", y2, m2, d2))
    same = (y1 == y2) & (m1 == m2) & (d1 == d2)
    return (F.when(has_start & has_end & ~same, F.concat_ws("-", head, tail))
            .when(has_start, head).otherwise(_single(end)))


def event_label(expense_type: Column, note: Column | None = None) -> Column:
    """The user's own words first, then the type's name, then a keyword in it, then the type itself."""
    return _label(_code(expense_type), sanitize_title(expense_type), None if note is None else sanitize_title(note))


def _code(expense_type: Column) -> Column:
    return F.upper(strip(F.coalesce(expense_type, F.lit(""))))


def _label(code: Column, text: Column, own: Column | None) -> Column:
    label = F.coalesce(
        *[F.when(code == k, v) for k, v in R.EVENT_LABELS.items()],
        *[F.when(text.contains(k), v) for k, v in R.EVENT_KEYWORDS],
        text,
    )
    return label if own is None else F.when(own != "", own).otherwise(label)


def _unfolded_title(event: Column, person: Column, named: Column, dates: Column) -> Column:
    """Dates, person and event; the person goes right behind the first date inside the event text."""
    after_date = strip(F.regexp_replace(event, rf"(?s)^(.*?{R.DATE_PATTERN})\s*(.*)$",
                                        "$1\u0001$5"))
    with_person = F.replace(after_date, F.lit("\u0001"), F.concat(F.lit(" "), person, F.lit(" ")))
    own_dates = F.when(named | (person == ""), event).otherwise(with_person)
    built = F.array_join(F.filter(F.array(dates, F.when(named, "").otherwise(person), event), lambda p: p != ""), " ")
    return F.when(event.rlike(R.DATE_PATTERN), own_dates).otherwise(built)


def _or_fallback(title: Column, fallback: Column | None) -> Column:
    return title if fallback is None else F.when(title != "", title).otherwise(sanitize_title(fallback))


def claim_title(applicant: Column, expense_type: Column, start: Column, end: Column,
                note: Column | None = None, fallback: Column | None = None) -> Column:
    """Date range, person, event. What the event text already says is not said again."""
    event, clean = event_label(expense_type, note), sanitize_title(applicant)
    named = (clean != "") & event.contains(clean)
    title = _unfolded_title(event, strip(F.coalesce(applicant, F.lit(""))), named, date_range(start, end))
    return _or_fallback(sanitize_title(title), fallback)


def with_claim_title(rows: DataFrame, name: str, applicant: Column, expense_type: Column, start: Column, end: Column,
                     note: Column, fallback: Column) -> DataFrame:
    """Adds :func:`claim_title` as a column, in projections: each part is read once, however often the title asks for it."""
    read = {"person": strip(F.coalesce(applicant, F.lit(""))), "clean": sanitize_title(applicant), "code": _code(expense_type),
            "text": sanitize_title(expense_type), "own": sanitize_title(note), "other": fallback}
    for side, c in (("start", start), ("end", end)):
        read |= {f"{side}_{part}": v for part, v in zip("ymd", _parts(c))}
    c = {k: F.col(f"title_{k}") for k in read}
    start, end = ([c[f"{side}_{part}"] for part in "ymd"] for side in ("start", "end"))
    steps = rows.select("*", *[v.alias(f"title_{k}") for k, v in read.items()])
    steps = steps.withColumn("title_event", _label(c["code"], c["text"], c["own"]))
    event = F.col("title_event")
    named = (c["clean"] != "") & event.contains(c["clean"])
    steps = steps.select("*", named.alias("title_named"), _range(start, end).alias("title_dates"))
    steps = steps.withColumn("title_folded", sanitize_title(
        _unfolded_title(event, c["person"], F.col("title_named"), F.col("title_dates"))))
    kept = [k for k in rows.columns if k != name]
    return steps.select(*kept, _or_fallback(F.col("title_folded"), c["other"]).alias(name))


def safe_file_name(title: Column, fallback: str = R.DEFAULT_FILE_NAME) -> Column:
    cleaned = F.regexp_replace(sanitize_title(title), R.UNSAFE_FILE_CHARS, "_")
    return F.when(cleaned != "", cleaned).otherwise(fallback)
