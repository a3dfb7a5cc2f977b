"""Scalar expressions over one material: quality, hard regions, injection, type, readability."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import materials as R
from .text import contains_any, count_contained, fold, strip


def meaningful_chars(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "(?U)" + R.MEANINGFUL_CHARS.replace(r"\s", r"\s\x1c-\x1f") + "+", ""))


def text_quality(c: Column, keywords=R.QUALITY_KEYWORDS) -> Column:
    """0.6 x share of readable characters + 0.4 x keyword coverage (three keywords are enough)."""
    text = strip(F.coalesce(c, F.lit("")))
    clean = meaningful_chars(text) / F.greatest(F.length(text), F.lit(1))
    words = F.least(count_contained(text, keywords) / F.lit(3.0), F.lit(1.0))
    return F.when(text == "", 0.0).otherwise(F.bround(F.lit(0.6) * clean + F.lit(0.4) * words, 4))


def region_assess(c: Column, keywords=R.HANDWRITING_KEYWORDS) -> Column:
    """struct(level, reasons, needs_review, engine, suffix) of one recognized text."""
    text = strip(F.coalesce(c, F.lit("")))
    n = F.length(text)
    garbled = F.lit(1) - meaningful_chars(text) / F.greatest(n, F.lit(1))
    noisy = garbled > R.MAX_GARBLED_RATIO
    short = n < R.MIN_REGION_CHARS
    handwritten = contains_any(text, keywords)
    hits = F.array_compact(F.array(*[F.when(text.contains(k), k) for k in keywords]))
    level = F.when(short, "hard").when(handwritten, "handwriting").when(noisy, "hard").otherwise("normal")
    noise_reason = F.when(noisy, F.format_string("乱码率偏高(%.0f%%)", garbled * 100))
    reasons = (
        F.when(short, F.array(F.format_string("识别文本过少(%d字符)", n)))
        .when(handwritten, F.array_compact(F.array(
            noise_reason, F.concat(F.lit("含手写/盖章关键词("), F.array_join(hits, "、"), F.lit(")")))))
        .when(noisy, F.array(noise_reason))
        .otherwise(F.array(F.lit("文本质量正常")))
    )
    return F.struct(
        level.alias("level"),
        reasons.alias("reasons"),
        (level != "normal").alias("needs_review"),
        F.when(level == "normal", "tesseract").otherwise("mineru").alias("engine"),
        F.when(level == "normal", "").otherwise(F.concat(F.lit("_"), level)).alias("suffix"),
    )


def hard_level(c: Column, keywords=R.HANDWRITING_KEYWORDS) -> Column:
    """Only the level of :func:`region_assess`."""
    text = strip(F.coalesce(c, F.lit("")))
    n = F.length(text)
    noisy = F.lit(1) - meaningful_chars(text) / F.greatest(n, F.lit(1)) > R.MAX_GARBLED_RATIO
    return (F.when(n < R.MIN_REGION_CHARS, "hard").when(contains_any(text, keywords), "handwriting")
            .when(noisy, "hard").otherwise("normal"))


#: Letters that no other character but their capital equals when case is ignored.
_PLAIN_LETTERS = set("abcdefghjlmnopqrtuvwxyz")


def _holds(c: Column, words) -> Column:
    """Whether the case-folded text holds one of the words, as far as a match may need it.

    Words without case are sought in the text as it is. The text is folded for the others only, and only if it
    holds a letter of theirs.
    """
    hit = contains_any(c, [w for w in words if w == w.upper()])
    for word in words:
        if word != word.upper():
            letter = next((x for x in word if x in _PLAIN_LETTERS), None)
            found = F.lower(F.upper(c)).contains(word)
            hit = hit | (found if letter is None else (c.contains(letter) | c.contains(letter.upper())) & found)
    return hit


def _may_hit(c: Column, groups) -> Column:
    """Necessary condition for one rule: plain word searches, far cheaper than it; those without case come first."""
    possible = F.lit(True)
    for words in sorted(groups, key=lambda ws: any(w != w.upper() for w in ws)):
        possible = possible & _holds(c, words)
    return possible


def _by_rule(c: Column, rules, words, found) -> Column:
    """``found(label, pattern)`` for the rules that may hit at all, null for the others.

    ``words`` holds each rule's word groups as the rule pack states them; without it every rule is run.
    """
    if rules is None:
        rules, words = R.INJECTION_RULES, R.INJECTION_WORDS
    if not words:
        return F.array(*[found(label, p) for label, p in rules])
    return F.array(*[F.when(_may_hit(c, groups), found(label, p)) for (label, p), groups in zip(rules, words, strict=True)])


def injection_labels(c: Column, rules=None, words=None) -> Column:
    """Labels of the rules that hit, in rule order; a label repeats when two of its rules hit."""
    hits = F.array_compact(_by_rule(c, rules, words, lambda label, p: F.when(c.rlike("(?iU)" + p), label)))
    return F.coalesce(hits, F.array().cast("array<string>"))


def injection_snippets(c: Column, rules=None, words=None, keep: int = R.MAX_INJECTION_SNIPPETS) -> Column:
    """Distinct folded snippets in rule order, at most ``keep``."""
    found = F.flatten(F.array_compact(
        _by_rule(c, rules, words, lambda label, p: F.regexp_extract_all(c, F.lit("(?iU)" + p), F.lit(0)))))
    distinct = F.array_distinct(F.filter(F.transform(found, fold), lambda s: s != ""))
    return F.coalesce(F.slice(distinct, 1, keep), F.array().cast("array<string>"))


def filename_type(file_name: Column, hints=R.FILENAME_HINTS) -> Column:
    name = F.lower(F.coalesce(file_name, F.lit("")))
    kind = F.lit(None).cast("string")
    for material, words in reversed(list(hints.items())):
        kind = F.when(contains_any(name, [w.lower() for w in words]), material).otherwise(kind)
    return kind


def content_scores(text: Column, structured: Column | None = None, signals=R.CONTENT_SIGNALS) -> dict[str, Column]:
    """Signals found in the text, plus those among the claim's structured field names."""
    scores = {}
    for material, words in signals.items():
        score = count_contained(F.coalesce(text, F.lit("")), words)
        if structured is not None:
            for field in R.STRUCTURED_SIGNALS.get(material, ()):
                score = score + F.coalesce(F.array_contains(structured, field), F.lit(False)).cast("int")
        scores[material] = score
    return scores


def material_type(file_name: Column, text: Column, structured: Column | None = None,
                  threshold: int = R.MIN_CONTENT_SIGNALS) -> Column:
    """Content decides when exactly one type reaches the threshold, else the file name, else ``other``."""
    scores = content_scores(text, structured)
    reached = sum((s >= threshold).cast("int") for s in scores.values())
    by_content = F.coalesce(*[F.when(s >= threshold, m) for m, s in scores.items()])
    return F.coalesce(F.when(reached == 1, by_content), filename_type(file_name), F.lit("other"))


def is_synthetic(c: Column, markers=R.SYNTHETIC_MARKERS) -> Column:
    return contains_any(F.coalesce(c, F.lit("")), markers)


def is_short(c: Column, minimum: int = R.MIN_READABLE_CHARS) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) < minimum


def document_id(content: Column) -> Column:
    """Sixteen hex characters of the content hash: equal content, equal id."""
    return F.substring(F.sha2(content, 256), 1, 16)
