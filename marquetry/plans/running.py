"""Running totals that don't put a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..folders import discard, fresh, is_written, written

def running_total(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the total of value, a whole number or a double without nulls, up to and with each row of its group, in order.

    Rows are written, as the range partitioner reads them twice; then they are range-partitioned by group and order, and added up within
    each partition as they stream by.  Only the first group of a partition can have begun before it, so that at most one sum a
    partition is carried on.  A hot group is thus spread over many tasks.  The order should be total within a group.
    """
    group, part, amount = fresh(df, "group", "part", "amount")
    rows = df.withColumns({amount: value, group: F.xxhash64(F.lit(0), *by)})
    whole = not isinstance(rows.schema[amount].dataType, DoubleType)
    rows = rows.withColumn(amount, F.col(amount).cast("long")) if whole else rows
    source = rows if is_written(df) else written(rows)
    ranged = source.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        before, carried = None, 0
        for b in batches:
            if b.num_rows == 0:
                continue
            groups, values = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (group, amount))
            sums = np.cumsum(values)
            starts = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1])
            base = np.where(starts > 0, -sums[starts - 1], 0)
            if groups[0] == before:
                base[0] = carried
            sums = sums + np.repeat(base, np.diff(np.concatenate([starts, [len(sums)]])))
            before, carried = groups[-1], sums[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums), pa.array(np.full(len(sums), here))], [*b.schema.names, out, part])

    number = LongType() if whole else DoubleType()
    schema = StructType([*ranged.schema.fields, StructField(out, number), StructField(part, LongType())])
    local = written(ranged.mapInArrow(add, schema))
    if not is_written(df):
        discard(source)
    sums = local.groupBy(part, group).agg(F.sum(amount).alias("sum"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.sum("sum").over(before)).where("before is not null")
    names = fresh(local, "p", "g", "before")
    sums = sums.select(F.col(part).alias(names[0]), F.col(group).alias(names[1]), F.col("before").alias(names[2]))
    joined = local.join(sums, (F.col(part) == F.col(names[0])) & (F.col(group) == F.col(names[1])), "left")
    total = F.col(out) + F.coalesce(F.col(names[2]), F.lit(0))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], total.alias(out))
