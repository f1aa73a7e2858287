"""Competition ranks without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import summed_before
from ..plans.staging import staged


def competition_rank(df: DataFrame, by: str, name: str, ready: bool = False) -> DataFrame:
    """df with rank() over by, descending: the rows of each distinct value are counted, summed over ranges of values, and joined back.

    ready says that df is a staged table already; else it is staged, as it is used twice.
    """
    df = df if ready else staged(df, "to-rank")
    levels = df.groupBy(by).agg(F.count("*").alias("_n"))
    ranks = summed_before(levels, "_n", [F.desc(by)], into="_above").select(by, (F.col("_above") + 1).alias(name))
    return df.join(ranks, by)
