"""Formatting and checking of answer texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom import fixed_values as V
from answerloom.functions.questions import strip_code_fence
from answerloom.functions.text import UNICODE, first_match, has_word


def format_number(answer: Column) -> Column:
    """First number of the text as ``{kind, number, text}``.

    kind is ``decimal`` (rounded half up to 2 digits), ``integer`` or ``text``
    (no number: unchanged). ``text`` keeps every digit of an integer.
    """
    clean = strip_code_fence(answer)
    digits = first_match(F.replace(clean, F.lit(","), F.lit("")), UNICODE + V.NUMBER, 0)
    has_dot = digits.contains(".")
    number = digits.try_cast("double")
    plain = F.regexp_replace(digits, r"^(-?)0+(?=\d)", "$1")
    whole = F.when(plain == "-0", F.lit("0")).otherwise(plain)
    return F.struct(
        F.when(digits.isNull(), "text").when(has_dot, "decimal").otherwise("integer").alias("kind"),
        F.when(has_dot, F.round(number, 2)).otherwise(number).alias("number"),
        F.when(digits.isNull(), clean).when(~has_dot, whole).alias("text"),
    )


def format_boolean(answer: Column) -> Column:
    """``{flag, text}``: the truth value, or the unchanged text where it is none."""
    clean = strip_code_fence(answer)
    low = F.lower(clean)
    flag = F.when(low.isin(*V.TRUE_WORDS), True).when(low.isin(*V.FALSE_WORDS), False)
    return F.struct(flag.alias("flag"), F.when(flag.isNull(), clean).alias("text"))


def format_json(answer: Column) -> Column:
    """The text if it is JSON, else the JSON inside it, else the text unchanged."""
    clean = strip_code_fence(answer)
    inner = first_match(clean, V.JSON_IN_TEXT)
    return (
        F.when(F.try_parse_json(clean).isNotNull(), clean)
        .when(F.try_parse_json(inner).isNotNull(), inner)
        .otherwise(clean)
    )


def format_string(answer: Column) -> Column:
    return strip_code_fence(answer)


def format_answer(answer: Column, kind: Column) -> Column:
    """One struct for every format: ``{number, flag, text}``, one of them set."""
    number, flag = format_number(answer), format_boolean(answer)
    return F.struct(
        F.when(kind == "number", number["number"]).alias("number"),
        F.when(kind == "boolean", flag["flag"]).alias("flag"),
        F.when(kind == "number", number["text"])
        .when(kind == "boolean", flag["text"])
        .when(kind == "json", format_json(answer))
        .otherwise(format_string(answer))
        .alias("text"),
    )


def hex_color(color: Column) -> Column:
    marked = F.when(color.startswith("#"), color).otherwise(F.concat(F.lit("#"), color))
    return F.substring(marked, 1, 7)


def rgb_color(color: Column) -> Column:
    """``rgb(r,g,b)`` of a hex colour, null when it is not six hex digits."""
    digits = F.regexp_replace(color, "^#+", "")
    parts = [F.conv(F.substring(digits, i, 2), 16, 10) for i in (1, 3, 5)]
    text = F.concat(F.lit("rgb("), F.concat_ws(",", *parts), F.lit(")"))
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}"), text)


def size_check(answer: Column, limit: int = V.MAX_ANSWER_BYTES) -> Column:
    """Null when the answer may be sent, else the reason it is rejected."""
    return F.when(F.octet_length(answer) > limit, F.lit(V.TOO_LARGE_REASON))


def parse_response(status: Column, body: Column) -> Column:
    """``{correct, reason, url, message}`` of a grading response."""
    is_json = F.try_parse_json(body).isNotNull()
    fields = F.from_json(
        F.when(is_json, body), "correct boolean, reason string, url string, message string"
    )
    ok = status == 200
    return F.struct(
        F.when(ok & is_json, F.coalesce(fields["correct"], F.lit(False)))
        .when(ok, has_word(body, V.CORRECT_WORDS))
        .otherwise(False)
        .alias("correct"),
        F.when(ok & is_json, fields["reason"])
        .when(~ok, F.concat(F.lit("HTTP "), status.cast("string")))
        .alias("reason"),
        F.when(ok & is_json, fields["url"]).alias("url"),
        F.when(ok & is_json, fields["message"]).otherwise(body).alias("message"),
    )


def personal_offset(user: Column, rule: Column) -> Column:
    """Whole-number offset of a user under a rule such as ``length_mod_7``."""
    modulo = first_match(rule, V.OFFSET_MODULO).try_cast("bigint")
    length = F.length(user).cast("bigint")
    codes = F.transform(F.split(user, ""), lambda c: F.ascii(c).cast("bigint"))
    total = F.aggregate(codes, F.lit(0).cast("bigint"), lambda s, c: s + c)
    return (
        F.when(rule.isNull() | rule.isin("", "none"), F.lit(0).cast("bigint"))
        .when(modulo.isin(*V.OFFSET_FIRST_MODULI), length % modulo)
        .when(rule.contains("checksum"), total % V.CHECKSUM_MODULO)
        .when(modulo > 0, length % modulo)
        .otherwise(F.lit(0).cast("bigint"))
    )


def short_id(url: Column, time: Column) -> Column:
    """First 12 hex digits of the md5 of url and time."""
    return F.substring(F.md5(F.concat(url, F.lit("-"), time.cast("string"))), 1, 12)
