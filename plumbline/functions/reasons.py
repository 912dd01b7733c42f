"""Why a value fails a format: one label per value, first matching reason wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import strip

# Accented vowels reported as a likely typing error in e-mail addresses.
ACCENTED_VOWELS = "áéíóúàèìòùâêîôûäëïöüÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ"


def email_reason(c: Column) -> Column:
    v = strip(c)
    domain = F.substring_index(v, "@", -1)
    return (
        F.when(v == "", "empty")
        .when(F.contains(v, F.lit(" ")), "contains spaces")
        .when(~F.contains(v, F.lit("@")), "no @")
        .when(v.rlike("@.*@"), "more than one @")
        .when(F.startswith(v, F.lit("@")), "no user before the @")
        .when(domain == "", "no domain after the @")
        .when(~F.contains(domain, F.lit(".")), "no dot in the domain")
        .when(F.contains(v, F.lit("..")), "two dots in a row")
        .when(v.rlike(f"[{ACCENTED_VOWELS}]"), "accented vowel")
        .otherwise("other")
    )


def phone_reason(c: Column) -> Column:
    v = strip(c)
    digits = F.char_length(F.regexp_replace(v, "[^0-9]", ""))
    return (
        F.when(v == "", "empty")
        .when(v.rlike(r"\p{L}"), F.concat(F.lit("letter "), F.regexp_substr(v, F.lit(r"\p{L}"))))
        .when(
            v.rlike(r"[^0-9 +\-()]"),
            F.concat(F.lit("character "), F.regexp_substr(v, F.lit(r"[^0-9 +\-()]"))),
        )
        .when(digits < 7, F.concat(F.lit("only "), digits.cast("string"), F.lit(" digits")))
        .when(F.char_length(v) > 15, F.concat(F.char_length(v).cast("string"), F.lit(" characters")))
        .otherwise("other")
    )


def url_reason(c: Column) -> Column:
    v = strip(c)
    return (
        F.when(v == "", "empty")
        .when(F.contains(v, F.lit(" ")), "contains spaces")
        .when(~v.rlike("^https?://"), "no http:// or https://")
        .otherwise("other")
    )


def tax_id_reason(c: Column) -> Column:
    v = strip(c)
    return (
        F.when(v == "", "empty")
        .when(v.rlike(r"\p{L}"), F.concat(F.lit("letter "), F.regexp_substr(v, F.lit(r"\p{L}"))))
        .when(
            v.rlike(r"[^0-9\-]"),
            F.concat(F.lit("character "), F.regexp_substr(v, F.lit(r"[^0-9\-]"))),
        )
        .otherwise("other")
    )


REASONS = {"email": email_reason, "phone": phone_reason, "url": url_reason, "tax_id": tax_id_reason}
