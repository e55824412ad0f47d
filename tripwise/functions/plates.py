"""Plate normalisation and scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike letters, plate shapes and what each slot reads its characters as.
CYRILLIC, LATIN = "АВЕКМНОРСТУХ", "ABEKMHOPCTYX"
GENERIC = "[A-Z012458]{2}[0-9OISZBEA]{4}[A-Z012458]{2}"
RU = "[ABEKMHOPCTYX08][0-9OISZBEA]{3}[ABEKMHOPCTYX08]{2}"
SHORT = "[ABEKMHOPCTYX048]{2}[0-9OISZBEA]{4}"
REGION = "[0-9OISZBEA]"
DIGITS = "OISZBEA", "0152864"
RU_DIGITS = "OISZBEA", "0152861"
GENERIC_HEAD = "015248", "OISZAB"
GENERIC_TAIL = ("015248", "OISZAA"), ("015248", "OISZAO")
RU_LETTERS = "08", "OB"
SHORT_LETTERS = "048", "OAB"


def compact(raw: Column) -> Column:
    """Upper case, Cyrillic twins as Latin letters, letters and digits only."""
    return F.regexp_replace(F.translate(F.upper(raw), CYRILLIC, LATIN), r"[^\p{L}\p{N}]", "")


def _slots(found: Column, *slots) -> Column:
    parts, at = [], 1
    for length, (old, new) in slots:
        parts.append(F.translate(F.substring(found, at, length), old, new))
        at += length
    return F.when(found != "", F.concat(*parts))


def normalize(raw: Column, include_region: bool = False) -> Column:
    """The canonical Latin plate in a text, or null: the generic shape first, then the RU and the short one."""
    text = compact(raw)
    find = lambda pattern: F.regexp_extract(text, pattern, 0)
    generic = _slots(find(GENERIC), (2, GENERIC_HEAD), (4, DIGITS), (1, GENERIC_TAIL[0]), (1, GENERIC_TAIL[1]))
    if include_region:
        # The leftmost RU shape decides; its region follows it, three digits if there are as many, else two.
        whole = F.regexp_extract(text, f"({RU})({REGION}{{2,3}})?", 0)
        core = F.substring(whole, 1, 6)
        region = F.translate(F.substring(whole, 7, 3), *RU_DIGITS)
        ru = F.concat(_slots(core, (1, RU_LETTERS), (3, RU_DIGITS), (2, RU_LETTERS)), region)
        ru = F.when(whole != "", ru)
    else:
        ru = _slots(find(RU), (1, RU_LETTERS), (3, RU_DIGITS), (2, RU_LETTERS))
    short = _slots(find(SHORT), (2, SHORT_LETTERS), (4, DIGITS))
    return F.coalesce(generic, ru, short)


def kind(plate: Column) -> Column:
    """3 full, 2 short, 1 RU core, 0 other."""
    return (
        F.when(plate.rlike("^[A-Z]{2}[0-9]{4}[A-Z]{2}$"), 3)
        .when(plate.rlike("^[A-Z]{2}[0-9]{4}$"), 2)
        .when(plate.rlike("^[A-Z][0-9]{3}[A-Z]{2}$"), 1)
        .otherwise(0)
    )


def shape_score(text: Column) -> Column:
    full = F.when(text.rlike("^[A-Z]{2}[0-9]{4}[A-Z]{2}$"), 200).otherwise(0)
    ru = F.when(text.rlike("^[A-Z][0-9]{3}[A-Z]{2}([0-9]{2}|[0-9]{3})?$"), 200).otherwise(0)
    return full + ru + F.when(F.length(text) == 8, 10).otherwise(0)


def loose_equal(a: Column, b: Column) -> Column:
    """Equal but for H and O in the last two of at least six characters."""
    n = F.length(a)
    head = F.substring(a, F.lit(1), n - 2) == F.substring(b, F.lit(1), n - 2)
    ends = F.translate(F.right(a, F.lit(2)), "H", "O") == F.translate(F.right(b, F.lit(2)), "H", "O")
    return (a == b) | ((n == F.length(b)) & (n >= 6) & head & ends)


def clean_token(raw: Column, whitelist: str = "ABEKMHOPCTYX0123456789") -> Column:
    """A token fit to hold a plate, or null: at least three characters, a digit, a letter and one of the whitelist."""
    text = F.regexp_replace(F.upper(raw), "[^A-Z0-9А-ЯЁ]", "")
    fit = (F.length(text) >= 3) & text.rlike("[0-9]") & text.rlike("[A-ZА-ЯЁ]") & text.rlike(f"[{whitelist}]")
    return F.when(fit, text)
