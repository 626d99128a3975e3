"""Number parsing and formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellmatch.functions.text import ascii_edges, let, regex_first
from dwellmatch.schema import RANGES

_GROUPED = r"^\d{1,3}(?:\.\d{3})+$"


def _num(c: Column) -> Column:
    return c.try_cast("double")


def _no_dots(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit(""))


def _comma_to_dot(c: Column) -> Column:
    """The first comma becomes a dot."""
    return F.regexp_replace(c, "^([^,]*),", "$1.")


def _decimal_comma(c: Column) -> Column:
    """Dots are grouping, the first comma is the decimal point."""
    return _comma_to_dot(_no_dots(c))


def first_number(c: Column) -> Column:
    """First numeral; comma decimal, groups of three after dots are grouping."""
    return let(
        regex_first(c, r"(\d[\d.,]*)"),
        lambda raw: _num(
            F.when(raw.contains(","), _decimal_comma(raw)).when(raw.rlike(_GROUPED), _no_dots(raw)).otherwise(raw)
        ),
    )


def spaced_number(c: Column) -> Column:
    """First numeral with inner spaces; several dots are grouping, one dot is decimal."""
    spaced = F.replace(c, F.lit("\u00a0"), F.lit(" "))
    return let(
        F.regexp_replace(regex_first(spaced, r"(\d[\d\s.,]*)"), r"\s+", ""),
        lambda raw: _num(
            F.when(raw.contains(","), _decimal_comma(raw)).when(raw.rlike(r"\..*\."), _no_dots(raw)).otherwise(raw)
        ),
    )


def stripped_number(c: Column) -> Column:
    """All characters but digits, comma, dot, minus dropped; longest numeric prefix counts."""
    prefix = r"^(-?(?:\d+\.?\d*|\.\d+))"
    return let(
        F.regexp_replace(c, r"[^\d,.\-]", ""),
        lambda raw: _num(
            regex_first(
                F.when(raw.contains(","), _decimal_comma(raw)).when(raw.rlike(_GROUPED), _no_dots(raw)).otherwise(raw),
                prefix,
            )
        ),
    )


def naive_number(c: Column) -> Column:
    """Digits, dots and commas kept, first comma becomes a dot, zero is null."""
    kept = _comma_to_dot(F.regexp_replace(c, "[^0-9.,]", ""))
    return F.nullif(_num(regex_first(kept, r"^((?:\d+\.?\d*|\.\d+))")), F.lit(0.0))


def in_range(c: Column, column: str) -> Column:
    """Value when inside the accepted range of the column, else null."""
    lo, hi = RANGES[column]
    return let(c, lambda v: F.when(v.between(lo, hi), v))


def at_least(c: Column, floor: float = 50.0) -> Column:
    return F.when(c >= floor, c)


def js_num(c: Column) -> Column:
    """Number text without a trailing '.0'."""
    d = c.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))


def round_half_up(c: Column) -> Column:
    """Nearest integer, halves up."""
    return F.floor(c + F.lit(0.5)).cast("double")


# The patterns of the following functions are fixed values: they decide which texts have a number.


def area_from_text(c: Column) -> Column:
    return spaced_number(regex_first(c, r"(?iu)(\d[\d\s.,]*)\s*m(?:²|2|&sup2;)"))


def rooms_from_text(c: Column) -> Column:
    return spaced_number(regex_first(c, r"(?iu)(\d+(?:[,.]\d+)?)\s*[- ]?\s*Zimmer"))


def cold_rent_from_text(c: Column) -> Column:
    return spaced_number(regex_first(c, r"(?iu)für\s+(\d[\d\s.,]*)\s*€\s*kalt"))


def price_from_text(c: Column) -> Column:
    """First in-range price: labelled amounts before amounts with a currency sign."""
    labelled = F.regexp_extract_all(
        c, F.lit(r"(?iu)(?:warmmiete|kaltmiete|miete|warm|rent)[^\d]{0,24}(\d[\d.\s]*[,.]?\d*)\s*(?:€|eur)?"), 1
    )
    signed = F.regexp_extract_all(
        c, F.lit(r"(?iu)(\d[\d.\s]*[,.]?\d*)\s*(?:€|eur)\s*(?:warm|kalt|miete|warmmiete)?"), 1
    )
    prices = F.transform(F.concat(labelled, signed), lambda x: in_range(stripped_number(x), "price"))
    return F.get(F.filter(prices, lambda x: x.isNotNull()), F.lit(0))


def rooms_or_shared(c: Column, kind: Column) -> Column:
    """Room count of a text; a shared-flat room without one counts as one room."""
    found = in_range(
        stripped_number(regex_first(c, ascii_edges(r"(?iu)(\d+(?:[,.]\d+)?)\s*(?:zimmer(?:n)?|zi\.?|rooms?)\b"))), "rooms"
    )
    return F.coalesce(found, F.when(kind == "wg_room", F.lit(1.0)))
