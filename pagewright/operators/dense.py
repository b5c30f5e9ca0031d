"""Work along a total order without bringing all rows into one task.

Rows are range-partitioned by the order and sorted within partitions, so each
partition is a stretch of it.  What has to be known of the stretches before (how many
rows, the last row, a running sum) is one row a partition, as many as there are
shuffle partitions whatever the data, and is joined back by broadcast.  The rows
themselves are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import WindowSpec
from pyspark.sql.types import LongType, StructField, StructType

from pagewright.session import cut

#: The upper bits of a monotonically increasing id are the partition, the lower ones the place in it.
PLACE_BITS = 33


def _before() -> WindowSpec:
    """The stretches before each; as few rows as there are partitions."""
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def numbered(placed: DataFrame, name: str = "doc_id") -> DataFrame:
    """``name`` = 0, 1, 2, ... for rows whose ``_at`` has their partition in the upper bits and their place there (from 0, without gaps) in the lower ones."""
    part = F.shiftright("_at", PLACE_BITS)
    sizes = placed.groupBy(part.alias("_part")).count()
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(_before()), F.lit(0)).alias("_offset"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_offset") + inside).cast("long")).drop("_part", "_offset", "_at")


def with_dense_ids(rows: DataFrame, order: list[str], name: str = "doc_id") -> DataFrame:
    """The rows with ``name`` = 0, 1, 2, ... in the given order (which must be total to be repeatable)."""
    return numbered(cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())), name)


def _stretches(rows: DataFrame, order: list[str], fn: Callable[[pa.Table, dict], dict[str, pa.Array]], new: list[str]) -> DataFrame:
    """The rows in order, with the number of their stretch and the long columns ``new`` that ``fn`` computes
    batch by batch; what it keeps in its dictionary lasts through a stretch."""
    schema = StructType([*rows.schema.fields, *(StructField(n, LongType()) for n in new), StructField("_part", LongType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                added = fn(pa.Table.from_batches([batch]).combine_chunks(), state)
                columns = [*batch.columns, *(added[n] for n in new), pa.array(np.full(batch.num_rows, part, dtype=np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, target)], schema=target)

    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))


def _changes(column: pa.ChunkedArray, last: object) -> np.ndarray:
    """Whether each value differs from the one before; the first is compared with ``last``."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.ones(len(values), dtype=bool)
    if len(values) > 1:
        out[1:] = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    out[0] = last is None or values[0].as_py() != last
    return out


def with_gaps_along(rows: DataFrame, key: str, value: str, name: str = "gap") -> DataFrame:
    """``value`` less that of the key's row before, in the order of both; a key's first row counts from 0."""

    def gaps(table: pa.Table, state: dict) -> dict[str, pa.Array]:
        new = _changes(table[key], state.get("key"))
        values = table[value].to_numpy().astype(np.int64)
        before = np.concatenate([[state.get("value", 0)], values[:-1]])
        out = values - np.where(new, 0, before)
        known = np.ones(len(values), dtype=bool)
        known[0] = "key" in state  # only the first row of a stretch needs the stretch before
        state["key"], state["value"] = table[key][-1].as_py(), int(values[-1])
        return {name: pa.array(out, mask=~known)}

    placed = _stretches(rows, [key, value], gaps, [name])
    ends = placed.groupBy("_part").agg(F.max(F.struct(key, value)).alias("_end"))
    carried = ends.select("_part", F.last("_end").over(_before()).alias("_end"))
    first = F.col(value) - F.when(F.col(f"_end.{key}") == F.col(key), F.col(f"_end.{value}")).otherwise(0)
    return placed.join(F.broadcast(carried), "_part").withColumn(name, F.coalesce(F.col(name), first)).drop("_part", "_end")


def with_sums_along(rows: DataFrame, key: str, position: str, value: str, name: str) -> DataFrame:
    """Running sum of ``value`` over the rows of a key in the order of ``position``."""

    def sums(table: pa.Table, state: dict) -> dict[str, pa.Array]:
        new = _changes(table[key], state.get("key"))
        total = np.cumsum(table[value].to_numpy().astype(np.int64))
        starts = np.flatnonzero(new)
        base = np.zeros(len(total), dtype=np.int64)
        if len(starts):
            run = np.cumsum(new)
            at_start = np.concatenate([[0], total])[starts]
            base = np.where(run > 0, at_start[np.maximum(run, 1) - 1], 0)
        out = total - base
        out[np.cumsum(new) == 0] += state.get("sum", 0)
        state["key"], state["sum"] = table[key][-1].as_py(), int(out[-1])
        return {name: pa.array(out)}

    placed = _stretches(rows, [key, position], sums, [name])
    ends = placed.groupBy("_part").agg(F.min(key).alias("_first"), F.max(F.struct(key, position, name)).alias("_end"))
    # a key that began in earlier stretches is the last key of each of them
    tails = ends.select(F.col("_part").alias("_q"), F.col(f"_end.{key}").alias("_first"), F.col(f"_end.{name}").alias("_tail"))
    carried = ends.select("_part", "_first").join(tails, "_first", "left").groupBy("_part", "_first").agg(F.sum(F.when(F.col("_q") < F.col("_part"), F.col("_tail"))).alias("_carry"))
    more = F.when(F.col(key) == F.col("_first"), F.coalesce("_carry", F.lit(0))).otherwise(0)
    return placed.join(F.broadcast(carried), "_part").withColumn(name, F.col(name) + more).drop("_part", "_first", "_carry")


def with_floor(probes: DataFrame, samples: DataFrame, key: str, value: str, name: str = "floor") -> DataFrame:
    """The probes with the ``value`` (a long, rising with the key) of the largest sample key that isn't above theirs; null below the first."""
    both = samples.select(key, F.col(value).cast("long").alias("_value"), F.lit(0).alias("_probe")).unionByName(probes.select(key, F.lit(None).cast("long").alias("_value"), F.lit(1).alias("_probe")))

    def floors(table: pa.Table, state: dict) -> dict[str, pa.Array]:
        values = table["_value"].to_numpy(zero_copy_only=False).astype(float)
        known = ~np.isnan(values)
        at = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
        out = np.where(at >= 0, values[np.maximum(at, 0)], state.get("value", np.nan))
        state["value"] = out[-1]
        return {name: pa.array(np.where(np.isnan(out), 0, out).astype(np.int64), mask=np.isnan(out))}

    placed = _stretches(both, [key, "_probe"], floors, [name])
    ends = placed.groupBy("_part").agg(F.max("_value").alias("_end"))
    carried = ends.select("_part", F.max("_end").over(_before()).alias("_end"))
    return placed.where("_probe = 1").join(F.broadcast(carried), "_part").select(key, F.coalesce(F.col(name), F.col("_end")).alias(name))
