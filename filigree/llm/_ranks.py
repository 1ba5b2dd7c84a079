"""Running sums within groups over any number of partitions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm._scratch import arrow_map, stored


def running(df: DataFrame, group: str, order: list[str], weight: str, name: str = "before") -> DataFrame:
    """df with `name`: the sum of `weight` over the rows of the same group that come earlier in the order.

    group: an integer column. Rows are range-partitioned by group and order, so a large group spreads over many
    partitions. Each partition sums its own rows; the driver sees one row for each partition and group that meet (at most
    partitions + groups) and hands their offsets back. Stored once, so that sums and rows belong together.
    """
    schema = df.schema
    g, w = schema.fieldNames().index(group), schema.fieldNames().index(weight)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, so_far = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, weights = batch.column(g).to_numpy(), batch.column(w).to_numpy().astype(np.int64)
            sums = np.cumsum(weights) - weights
            first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            base = sums[first].copy()
            if groups[0] == last:
                base[0] -= so_far
            sums = sums - np.repeat(base, np.diff(np.append(first, len(groups))))
            last, so_far = groups[-1], int(sums[-1] + weights[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(groups), part, np.int32)), pa.array(sums)], names=[*schema.fieldNames(), "_part", "_sum"])

    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = stored(arrow_map(dealt, local, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", _part int, _sum long"), "ranks")
    sums = rows.groupBy("_part", group).agg(F.sum(weight).alias("s")).collect()
    offset: dict[int, int] = defaultdict(int)
    table = []
    for part, key, s in sorted(tuple(x) for x in sums):
        table.append((part, key, offset[key]))
        offset[key] += s
    kind = schema[group].dataType.simpleString()
    offsets = df.sparkSession.createDataFrame(table, f"_part int, `{group}` {kind}, _offset long")
    return rows.join(offsets, ["_part", group]).withColumn(name, F.col("_sum") + F.col("_offset")).drop("_part", "_sum", "_offset")
