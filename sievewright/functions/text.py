"""Text column expressions for labels and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dash characters that stand for a hyphen in labels.
DASHES = "\\x{96}\\u2013\\u2014\\u2015\\u2212"
# Unicode white space plus the four separator controls.
SPACES = "[\\s\\x1c-\\x1f]"

# Texts a CSV reader takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"(?U)^{SPACES}+|{SPACES}+$", "")


def normal_form(col: Column) -> Column:
    """Lower case, one kind of dash, single spaces, no outer space."""
    dashed = F.regexp_replace(F.lower(col), f"[{DASHES}]+", "-")
    return F.trim(F.regexp_replace(dashed, f"(?U){SPACES}+", " "))


def title_case(col: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere.

    ``initcap`` only looks at spaces, so a marked space is put before each letter that follows
    a non-letter and taken out again. Unlike an array transform this compiles with the stage.
    """
    mark = "\u0001 "
    spaced = F.regexp_replace(F.lower(strip(col)), "(?<=[^\\p{L}])(?=\\p{L})", mark)
    return F.replace(F.initcap(spaced), F.lit(mark), F.lit(""))


def na_to_null(col: Column) -> Column:
    return F.when(~col.isin(NA_TOKENS), col)
