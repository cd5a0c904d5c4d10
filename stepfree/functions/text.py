"""Labels and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_key(label: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 made one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_split(split: Column) -> Column:
    """train, val or test whatever the case and padding; blank is null."""
    s = F.lower(F.trim(split))
    return F.when(s == "validation", F.lit("val")).when(s != "", s)
