"""How tables are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table of less than this for each core can lie in one row group, which one task reads.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if the optimiser's estimate says that it is small, else df as it is: a file of one row group keeps
    one core busy, however many there are. Large tables have enough row groups and are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df
