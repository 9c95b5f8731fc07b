"""Normal forms and row identity that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_key(c: Column) -> Column:
    """A corpus apart from case, padding and separators; null if nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(key != "", key)


def fixture_key(c: Column) -> Column:
    """A fixture id apart from spelling: the last part of a path or qualified name, without file ending, case,
    padding, kind of separator and leading zeros of numbers; null if nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(c)), "^.*[/\\\\:](?=[^/\\\\:]*[\\p{L}\\p{N}])", "")
    s = F.regexp_replace(F.trim(s), "\\.[a-z]{1,4}$", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", "")
    s = F.regexp_replace(s, "(?<![0-9])0+(?=[0-9])", "")
    return F.when(s != "", s)


def once(df: DataFrame, key: str) -> DataFrame:
    """Each key once, rows without a key left out. The copies of a delivered row agree in all selected columns."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def number(c: Column) -> Column:
    """c as a double, null where it is NaN, with one zero."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c + F.lit(0.0))
