"""Average ratings with one decimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(total: Column, count: Column) -> Column:
    """Average ``total / count`` to four decimals, then one; null when there is nothing to average.

    The database average carries four decimals and the last step rounds the *binary*
    value half to even. ``format_number`` does exactly that; ``round`` and ``bround``
    work on the decimal text and differ on ties such as 1.15.
    """
    average = (total.cast("decimal(20,0)") / F.nullif(count, F.lit(0))).cast("decimal(14,4)")
    text = F.format_number(average.cast("double"), 1)
    return F.regexp_replace(text, ",", "").cast("double")
