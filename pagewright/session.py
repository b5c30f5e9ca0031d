"""What a plan needs from its session: a shared folder to cut lineage in, and typed Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or the context names.  Only a session whose executors run on this
    machine may do without: it gets a local folder; on a cluster such a folder would be lost with its machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="pagewright-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: lineage ends, lost executors cost nothing that was
    written, and what reads it takes only the columns it needs.  ``codec``: another one than the engine's default."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/pagewright-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_columns(df: DataFrame, columns: list[str], fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str, step: int = 2000) -> DataFrame:
    """``mapInArrow`` over the named columns only; ``fn`` maps an iterator of
    column dictionaries (name to Python list) to an iterator of such
    dictionaries (lists or numpy arrays) that fit ``schema``."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns_of() -> Iterator[dict[str, list]]:
            for batch in batches:
                # the engine sends batches of up to 10,000 rows; long texts are taken in smaller steps
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}

        for out in fn(columns_of()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.select(*columns).mapInArrow(run, schema)
