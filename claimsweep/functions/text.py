"""Scalar text expressions: whitespace, markup, tokens, JSON replies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.materials import HTML_ENTITIES

# white space as Unicode text tools see it; Java needs (?U) and leaves the separators 1C-1F out
WS = r"[\s\x1c-\x1f]"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


# every character a Unicode-aware strip removes
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
            "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def fold(c: Column) -> Column:
    """Strip, and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def contains_any(c: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


def count_contained(c: Column, words) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + c.contains(word).cast("int")
    return total


def markup_normalize(c: Column) -> Column:
    """Markdown or HTML to plain lines, one line per table cell.

    Line work is done by multi-line patterns over the whole text rather than by splitting, so the
    chain stays inside generated code.
    """
    text = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", " ")
    text = F.regexp_replace(text, r"(?i)</t[dhr]\s*>|<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, char in HTML_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, LINE_BREAKS, "\n")
    text = F.regexp_replace(text, r"(?Udm)^[^\S\n]*#{1,6}[^\S\n]*", "")
    text = F.regexp_replace(text, r"(?U)[\s\x1f&&[^\n]]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def tokenize(c: Column) -> Column:
    """Latin/digit runs and CJK pieces of up to four; pieces of three or four add their bigrams."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+|[\u4e00-\u9fff]{1,4}"), F.lit(0))
    return F.flatten(F.transform(pieces, expand_piece))


def expand_piece(piece: Column) -> Column:
    bigrams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(piece) - 1, F.lit(1))),
                          lambda i: F.substr(piece, i, F.lit(2)))
    return F.when(piece.rlike(r"^[\u4e00-\u9fff]{3,4}$"), F.concat(F.array(piece), bigrams)).otherwise(F.array(piece))


def json_object(raw: Column) -> Column:
    """The object text of a model reply: first brace to last brace, or null."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(body != "", body)


def model_json_parse(raw: Column) -> Column:
    """struct(body, error): ``error`` tells a reply without an object from one that does not parse."""
    body = json_object(raw)
    return reply_parts(body, unparsable(body))


def unparsable(body: Column) -> Column:
    return body.isNotNull() & F.try_parse_json(body).isNull()


def reply_parts(body: Column, bad: Column) -> Column:
    """struct(body, error) of a reply's object text and whether it is :func:`unparsable`."""
    return F.struct(
        F.when(~bad, body).alias("body"),
        F.when(body.isNull(), "模型未返回JSON对象").when(bad, "模型JSON解析失败").alias("error"),
    )


def error_class(message: Column) -> Column:
    """Class of a model failure message."""
    return (
        F.when(message.contains("validation error"), "schema_validation_error")
        .when(contains_any(message, ("未返回JSON对象", "JSON解析失败", "JSON顶层必须是对象")), "json_format_error")
        .when(message.contains("模型调用失败"), "model_call_error")
        .otherwise("other_error")
    )
