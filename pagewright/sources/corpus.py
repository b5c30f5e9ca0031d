"""Corpus records (source, url, content) from a folder of JSON files, a ZIP archive, or a table.

Records whose JSON can't be read, isn't an object, or whose ``url`` or ``content`` is
missing or no string are left out.  A folder is ordered by the parts of its paths, a
ZIP archive by its entry names.
"""

from __future__ import annotations

import json
import posixpath
import zipfile
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source string, url string, content string"


def decode(raw: bytes) -> tuple[str, str] | None:
    """``(url without fragment, content)`` of one file, or None if it is no record."""
    try:
        value = json.loads(raw.decode("utf-8", errors="replace"))
    except ValueError:
        return None
    if not isinstance(value, dict) or not isinstance(value.get("url"), str) or not isinstance(value.get("content"), str):
        return None
    return value["url"].partition("#")[0], value["content"]


def _decoded(batches: Iterator) -> Iterator:
    import pandas as pd

    for pdf in batches:
        rows = [(p, *r) for p, raw in zip(pdf["path"], pdf["content"]) if (r := decode(bytes(raw))) is not None]
        yield pd.DataFrame(rows, columns=["source", "url", "content"])


def _json_files(spark: SparkSession, path: str) -> Iterator[str]:
    """Paths of all ``*.json`` files below a folder, as its file system lists them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(".json"):
            yield name


def folder_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all ``*.json`` files below a folder; ``source`` is the path.  Files that can't be read are left out."""
    reader = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    files = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", "content")
    base = posixpath.normpath(path)
    # the reader takes names that start with _ or . for hidden ones
    hidden = [f for f in _json_files(spark, path) if any(x[:1] in ("_", ".") for x in f[f.find(base) + len(base) :].split("/"))]
    records = files.mapInPandas(_decoded, SCHEMA)
    if not hidden:
        return records
    paths = spark.createDataFrame([(f,) for f in hidden], "path string").repartition(min(len(hidden), spark.sparkContext.defaultParallelism))
    return records.unionByName(paths.mapInPandas(_read, SCHEMA))


def _read(batches: Iterator) -> Iterator:
    import pandas as pd

    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            try:
                with _opened(path) as file:
                    record = decode(file.read())
            except OSError:
                continue
            if record is not None:
                rows.append((path, *record))
        yield pd.DataFrame(rows, columns=["source", "url", "content"])


def _opened(path: str):
    """A file that can be read at any place, on this machine or on the storage that its address names."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path, "rb")
    storage, inner = pafs.FileSystem.from_uri(path)
    return storage.open_input_file(inner)


class _Slice(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class ZipReader(DataSourceReader):
    def __init__(self, path: str, slices: int):
        self.path, self.slices = path, slices

    def partitions(self) -> list[_Slice]:
        with _opened(self.path) as file, zipfile.ZipFile(file) as archive:
            names = sorted(i.filename for i in archive.infolist() if not i.is_dir() and i.filename.endswith(".json"))
        step = max(1, -(-len(names) // self.slices))
        return [_Slice(names[i : i + step]) for i in range(0, len(names), step)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        with _opened(self.path) as file, zipfile.ZipFile(file) as archive:
            for name in partition.names:
                try:
                    raw = archive.read(name)
                except (KeyError, OSError, zipfile.BadZipFile):
                    continue
                record = decode(raw)
                if record is not None:
                    yield (name, *record)


class ZipSource(DataSource):
    """Data source ``zip_corpus``: the entries of an archive on storage that every executor sees, in slices."""

    @classmethod
    def name(cls) -> str:
        return "zip_corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"], int(self.options.get("slices", "64")))


def _kind(spark: SparkSession, path: str) -> str:
    """``folder`` or ``file``; FileNotFoundError if there is neither."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    storage = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not storage.exists(p):
        raise FileNotFoundError(f"no corpus at {path}")
    return "folder" if storage.getFileStatus(p).isDirectory() else "file"


def _is_archive(path: str) -> bool:
    with _opened(path) as file:
        return zipfile.is_zipfile(file)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Records of a folder or a ZIP archive on any storage that Spark and Arrow can reach, with ``position`` to order them by."""
    if _kind(spark, path) == "folder":
        return folder_records(spark, path).withColumn("position", F.split("source", "/"))
    if not _is_archive(path):
        raise ValueError(f"{path} is neither a folder nor a ZIP archive")
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_corpus").load(path).withColumn("position", F.array("source"))


def count_hint(spark: SparkSession, path: str) -> int:
    """Number of JSON members, without reading them."""
    if _kind(spark, path) == "folder":
        return sum(1 for _ in _json_files(spark, path))
    with _opened(path) as file, zipfile.ZipFile(file) as archive:
        return sum(not i.is_dir() and i.filename.endswith(".json") for i in archive.infolist())


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, query)`` of a query file: one a line, without blank lines and comments."""
    from pagewright.operators.dense import with_dense_ids

    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("query"), F.monotonically_increasing_id().alias("n"))
    return with_dense_ids(lines.where("query <> '' and not startswith(query, '#')"), ["n"], "query_id").select("query_id", "query")
