"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Unicode white space plus the four ASCII separator controls,
# the characters a blank test and a strip look at.
SPACE = r"[\s\x1c-\x1f]"

# Fixed value: letters that have case (Unicode "Cased"); every other character
# starts a new word for title case.
_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"

TEXT_CASES = ("lower", "upper", "title")


def strip(col: Column) -> Column:
    # The look-behind and the possessive run keep long inner gaps linear.
    return F.regexp_replace(col, rf"(?U)^{SPACE}++|(?<!{SPACE}){SPACE}++$", "")


def blank_to_null(col: Column) -> Column:
    # Equivalent to an anchored match on the whole text, but stops at the first
    # visible character instead of scanning long values.
    return F.when(col.rlike(rf"(?U)[^\s\x1c-\x1f]"), col)


def title_case(col: Column) -> Column:
    """Capitalise the first letter after any character without case.

    ``initcap`` starts words after spaces only.  A marked space is put before
    every letter that follows another character without case, and taken out again;
    the rare text holding the mark itself is cut into runs instead.
    """
    mark = "\x01 "
    spaced = F.regexp_replace(col, rf"([^ {_CASED}])(?=[{_CASED}])", "$1" + mark)
    runs = F.regexp_extract_all(col, F.lit(rf"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    by_run = F.array_join(F.transform(runs, F.initcap), "")
    return F.when(col.contains("\x01"), by_run).otherwise(F.replace(F.initcap(spaced), F.lit(mark), F.lit("")))


def text_case(col: Column, case: str) -> Column:
    """Apply a case; an unknown name leaves the text as it is."""
    if case == "lower":
        return F.lower(col)
    if case == "upper":
        return F.upper(col)
    if case == "title":
        return title_case(col)
    return col
