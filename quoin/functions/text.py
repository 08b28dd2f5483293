"""Name normalisation."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_name(name: str | Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def tidy(name: str | Column) -> Column:
    """Upper case without white space; null where nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(name, r"\s+", "")), F.lit(""))
