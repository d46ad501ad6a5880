"""Passes over a table in sorted order: numbers and running sums that carry on from one partition to the next.

Rows are dealt by range of group and order, so a group that holds a third of all rows is spread over as many partitions
as it needs. Each partition counts for itself; what it hands on (its last group and the sums so far) is one row per
partition, which is all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.scratch import written

_PASS = ("pass_part", "pass_group", "pass_nth")


def _changes(batch: pa.RecordBatch, keys: Sequence[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a row's keys differ from those of the row before, and the keys of the last row."""
    changed = np.zeros(batch.num_rows, bool)
    columns = [batch.column(k) for k in keys]
    first = tuple(c[0].as_py() for c in columns)
    changed[0] = first != last
    for column in columns:
        changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return changed, tuple(c[-1].as_py() for c in columns)


def carried(
    frame: DataFrame, group: Sequence[str], order: Sequence[str | Column], sums: Sequence[str] = (), name: str = "sorted"
) -> DataFrame:
    """The rows with `nth` (place in the group, from 1), `rank` (number of the group in sorted order, from 1) and, for
    each long column in `sums`, its running sum within the group modulo 2**64 in the column's place.

    Group columns must not be null. Rows that tie in group and order come in any order. The result reads a written
    table that `scratch.drop` removes.
    """
    spark = frame.sparkSession
    fields = {f.name: f.dataType.simpleString() for f in frame.schema}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, groups, carry = None, 0, {c: 0 for c in (*sums, "")}
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            changed, last = _changes(batch, group, last)
            at = np.arange(size)
            first = np.maximum.accumulate(np.where(changed, at, -1))
            out = {c: batch.column(c) for c in fields}
            for c in carry:
                values = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) if c else np.ones(size, np.uint64)
                total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
                run = total[1:] - np.where(first < 0, np.uint64(0), total[np.maximum(first, 0)])
                run[first < 0] += np.uint64(carry[c])
                carry[c] = int(run[-1])
                out[c or "pass_nth"] = pa.array(run.view(np.int64))
            numbers = groups + np.cumsum(changed)
            groups = int(numbers[-1])
            columns = [*(out[c] for c in fields), pa.array(np.full(size, part, np.int32)), pa.array(numbers), out["pass_nth"]]
            yield pa.RecordBatch.from_arrays(columns, names=[*fields, *_PASS])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in fields.items()), "pass_part int, pass_group bigint, pass_nth bigint"])
    keys = [*group, *order]
    local = written(frame.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema), name)
    place = F.struct("pass_group", "pass_nth")
    ends = (
        local.groupBy("pass_part")
        .agg(
            F.min_by(F.struct(*group), place).alias("first"),
            F.max_by(F.struct(*group), place).alias("last"),
            F.max_by(F.struct("pass_nth", *sums), place).alias("at_end"),
            F.max("pass_group").alias("groups"),
        )
        .orderBy("pass_part")
        .collect()
        if group
        else local.groupBy("pass_part").agg(F.max(F.struct("pass_nth", *sums)).alias("at_end"), F.lit(1).alias("groups")).orderBy("pass_part").collect()
    )
    offsets: dict[int, tuple[int, list[int]]] = {}
    total, last, held = 0, None, [0] * (1 + len(sums))
    for end in ends:
        goes_on = last is not None and (not group or end["first"] == last)
        before = held if goes_on else [0] * len(held)
        offsets[end["pass_part"]] = (total - goes_on, before)
        total += end["groups"] - goes_on
        held = [(a + b if end["groups"] == 1 else b) % (1 << 64) for a, b in zip(before, end["at_end"], strict=True)]
        last = end["last"] if group else ()

    names = ", ".join([*(f"`{c}` {t}" for c, t in fields.items()), "nth bigint, rank bigint"])
    if not ends:
        empty = spark.createDataFrame([], names)
        empty.scratch_path = local.scratch_path
        return empty
    if not sums:
        # One row per partition, whatever the table holds.
        table = spark.createDataFrame([(p, r, n[0]) for p, (r, n) in offsets.items()], "pass_part int, more_rank bigint, more_nth bigint")
        nth = F.col("pass_nth") + F.when(F.col("pass_group") == 1, F.col("more_nth")).otherwise(0)
        joined = local.join(F.broadcast(table), "pass_part")
        result = joined.select(*fields, nth.alias("nth"), (F.col("pass_group") + F.col("more_rank")).alias("rank"))
        result.scratch_path = local.scratch_path
        return result

    def carry_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, at = np.unique(batch.column("pass_part").to_numpy(), return_inverse=True)
            rank = np.array([offsets[p][0] for p in parts.tolist()], np.int64)[at]
            groups = batch.column("pass_group").to_numpy()
            out = {c: batch.column(c) for c in fields}
            for i, c in enumerate(("pass_nth", *sums)):
                more = np.array([offsets[p][1][i] for p in parts.tolist()], np.uint64)[at]
                values = batch.column(c).to_numpy().view(np.uint64) + np.where(groups == 1, more, np.uint64(0))
                out[c] = pa.array(values.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(out[c] for c in fields), out["pass_nth"], pa.array(groups + rank)], names=[*fields, "nth", "rank"]
            )

    result = local.mapInArrow(carry_on, names)
    result.scratch_path = local.scratch_path
    return result
