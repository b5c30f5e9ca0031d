"""Building, publishing, opening and upgrading an index.

``build`` takes records (source, url, content) in the order of ``source``: fragment
cut, greedy deduplication, analysis of each kept page, dense ids for the pages that
could be analysed, then the tables ``documents`` (sorted by id), ``postings`` and
``lexicon`` (both sorted by term in files of rising ranges, so that the row groups
without a wanted term are skipped) and ``meta``.  Everything is written to a folder
beside the target and renamed at the end, so a failed build leaves the index that was
there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from pagewright.functions.htmlfields import Fields, document_fields
from pagewright.functions.text import tokenize_column
from pagewright.functions.url import unquoted, without_fragment
from pagewright.operators.dedup import kept_records
from pagewright.operators.dense import PLACE_BITS, numbered
from pagewright.operators.postings import lexicon
from pagewright.plans.search import ANALYZERS, Index
from pagewright.session import cut, map_columns

FORMAT_VERSION = 2
V1_ENTRY = "map<string,array<bigint>>"
TABLES = ("documents", "postings", "lexicon")
#: Codec of tables that hold a word or more of every text: little over half the bytes of the engine's default.
CODEC = "zstd"
#: Pages whose terms a task holds at once while it analyses them.
PAGES = 200


@dataclass
class BuildStats:
    indexed_documents: int
    skipped_documents: int
    duplicate_documents: int
    unique_tokens: int
    partial_indexes: int = 0
    elapsed_seconds: float = 0.0
    index_bytes: int = 0
    postings_bytes: int = 0
    workers: int = 0


def analysed(records: DataFrame, order: str = "source", read: Callable[[str], Fields] = document_fields) -> DataFrame:
    """Fields of every page: ``(order, url, ok, doc_len, title, snippet, terms, _at)``; ok is false where analysis failed,
    ``_at`` is the task and the place among its pages that could be analysed."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        at = TaskContext.get().partitionId() << PLACE_BITS
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("ok", "doc_len", "title", "snippet", "terms", "_at")} | {"source": batch["source"], "url": batch["url"]}
            for content in batch["content"]:
                try:
                    f = read(content)
                    terms = [{"term": t, "tf": n, "important_tf": f.important.get(t, 0)} for t, n in f.total.items()]
                    row = True, sum(f.total.values()), f.title, f.snippet, terms
                except Exception:  # a page that can't be read is counted and left out
                    row = False, 0, None, None, None
                for name, value in zip(("ok", "doc_len", "title", "snippet", "terms", "_at"), (*row, at)):
                    out[name].append(value)
                at += row[0]
            yield out

    kind = dict(records.dtypes)[order]
    schema = f"source {kind}, url string, ok boolean, doc_len int, title string, snippet string, terms array<struct<term: string, tf: int, important_tf: int>>, _at bigint"
    return map_columns(records.select(F.col(order).alias("source"), "url", "content"), ["source", "url", "content"], run, schema, PAGES)


def index_of_pages(records: DataFrame, order: str = "source", read: Callable[[str], Fields] = document_fields) -> tuple[Index, BuildStats]:
    """An index (not published yet) of HTML or text pages, with stems."""
    records = records.where(F.col("url").isNotNull() & F.col("content").isNotNull()).withColumn("url", without_fragment(F.col("url")))
    # analysed in the order of their ids, so that no terms travel to get them
    kept = kept_records(records, order).select(order, "url", "content").repartitionByRange(order, "url").sortWithinPartitions(order, "url")
    pages = cut(analysed(kept, order, read).withColumn("url_terms", F.array_distinct(tokenize_column(unquoted(F.col("url"))))))
    good = numbered(pages.where("ok"))
    documents = good.select("doc_id", "url", "doc_len", "title", "snippet", "url_terms")
    postings = good.select("doc_id", "doc_len", F.explode("terms").alias("t")).select("t.term", "doc_id", "t.tf", "t.important_tf", "doc_len")
    words = cut(lexicon(postings))
    counts = pages.agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), F.coalesce(F.avg(F.when(F.col("ok"), F.greatest("doc_len", F.lit(1)))), F.lit(1.0)).alias("average")).first()
    stats = BuildStats(counts["good"], counts["bad"], records.count() - counts["good"] - counts["bad"], words.count(), workers=records.sparkSession.sparkContext.defaultParallelism)
    return Index(documents, postings, words, counts["good"], float(counts["average"]), "porter"), stats


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` with their array ``terms`` counted inside each row, as ``doc_len`` and structs of a term and its number."""
    others = [f for f in rows.schema.fields if f.name != "terms"]
    ddl = "array<struct<term: string, tf: bigint>>"
    schema = StructType([*others, StructField("doc_len", IntegerType()), StructField("terms", StructType.fromDDL(f"x {ddl}")["x"].dataType)])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            words = lists.flatten().dictionary_encode()
            keys = pc.list_parent_indices(lists).to_numpy().astype(np.int64) << 32 | words.indices.to_numpy()
            pairs, counts = np.unique(keys, return_counts=True)
            starts = np.searchsorted(pairs >> 32, np.arange(batch.num_rows + 1)).astype(np.int32)
            entries = pa.StructArray.from_arrays([words.dictionary.take(pa.array(pairs & 0xFFFFFFFF)), pa.array(counts.astype(np.int64))], names=["term", "tf"])
            columns = [*batch.columns[:-1], pc.list_value_length(lists), pa.ListArray.from_arrays(pa.array(starts), entries)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return rows.select(*(f.name for f in others), "terms").mapInArrow(run, schema)


def index_of_texts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", url_col: str = "url", analyzer: str = "surface") -> Index:
    """An index of plain texts under their own ids; each text is cut into terms once, and they are counted where they are."""
    analyze = ANALYZERS[analyzer]
    rows = texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    named = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.substring(F.col(text_col), 1, 320).alias("snippet"), analyze.column(F.col(text_col)).alias("terms"))
    good = cut(counted(named), CODEC)
    postings = good.select("doc_id", "doc_len", F.explode("terms").alias("t")).select("t.term", "doc_id", "t.tf", F.lit(0).alias("important_tf"), "doc_len")
    documents = good.select("doc_id", "url", "doc_len", F.lit("").alias("title"), "snippet", F.array_distinct(analyze.short(unquoted(F.col("url")))).alias("url_terms"))
    summary = good.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.greatest("doc_len", F.lit(1))), F.lit(1.0)).alias("a")).first()
    return Index(documents, postings, cut(lexicon(postings)), summary["n"], float(summary["a"]), analyzer)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _moved(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of each table of an index, metadata left out."""
    fs, hadoop = _fs(spark, path)
    folders = {name: hadoop.Path(f"{path}/{name}") for name in TABLES}
    return {name: fs.getContentSummary(p).getLength() for name, p in folders.items() if fs.exists(p)}


def _described(spark: SparkSession, path: str, meta: dict) -> dict:
    """Metadata with the sizes of what lies at ``path``."""
    found = sizes(spark, path)
    total = sum(found.values())
    return meta | {"format_version": FORMAT_VERSION, "index_bytes": total, "index_kb": round(total / 1024, 2), "postings_bytes": found.get("postings", 0)}


def _write_meta(spark: SparkSession, meta: dict, path: str) -> None:
    """The one-row table ``meta``, put in place of an older one by renames."""
    fs, hadoop = _fs(spark, path)
    new, now, old = (hadoop.Path(f"{path}/{name}") for name in ("meta.new", "meta", "meta.old"))
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta.new")
    if fs.exists(now):
        _moved(fs, now, old)
    _moved(fs, new, now)
    fs.delete(old, True)


def publish(spark: SparkSession, index: Index, stats: BuildStats, path: str, overwrite: bool = False) -> BuildStats:
    """Write the index to ``path``; an existing one is refused unless ``overwrite``, and kept until the new one is in place."""
    fs, hadoop = _fs(spark, path)
    target = hadoop.Path(path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(f"index exists: {path}")
    began = time.time()
    mark = uuid.uuid4().hex
    work, aside = f"{path.rstrip('/')}.{mark}.tmp", hadoop.Path(f"{path.rstrip('/')}.{mark}.old")
    try:
        index.documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{work}/documents", compression=CODEC)
        # a term of very many postings is spread over several files
        index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{work}/postings", compression=CODEC)
        index.lexicon.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{work}/lexicon")
        stats.partial_indexes = max(1, len(spark.read.parquet(f"{work}/postings").inputFiles()))
        stats.elapsed_seconds = round(stats.elapsed_seconds + time.time() - began, 3)
        given = asdict(stats) | {
            "analyzer": index.analyzer, "average_length": index.average_length, "flush_documents": int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")),
            "posting_codec": "Parquet, sorted by term and document", "scoring": "BM25 with important fields and URL terms; modes all, any, auto",
        }
        meta = _described(spark, work, given)
        stats.index_bytes, stats.postings_bytes = meta["index_bytes"], meta["postings_bytes"]
        _write_meta(spark, meta, work)
        if fs.exists(target):
            _moved(fs, target, aside)
            try:
                _moved(fs, hadoop.Path(work), target)
            except BaseException:
                _moved(fs, aside, target)
                raise
            fs.delete(aside, True)
        else:
            _moved(fs, hadoop.Path(work), target)
    except BaseException:
        fs.delete(hadoop.Path(work), True)
        raise
    return stats


def metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()["value"])


def open_index(spark: SparkSession, path: str) -> Index:
    """The index at ``path``; a version other than the current one is refused."""
    meta = metadata(spark, path)
    if meta.get("format_version") != FORMAT_VERSION:
        raise ValueError("unsupported index format; upgrade a version 1 index first")
    tables = (spark.read.parquet(f"{path}/{name}") for name in TABLES)
    return Index(*tables, int(meta["indexed_documents"]), float(meta["average_length"]), meta["analyzer"])


def build(spark: SparkSession, records: DataFrame, path: str, overwrite: bool = False, order: str = "source") -> BuildStats:
    """Build and publish; returns the counts."""
    began = time.time()
    fs, hadoop = _fs(spark, path)
    if fs.exists(hadoop.Path(path)) and not overwrite:
        raise FileExistsError(f"index exists: {path}")
    index, stats = index_of_pages(records, order)
    stats.elapsed_seconds = time.time() - began
    return publish(spark, index, stats, path, overwrite)


def lexicon_v1(spark: SparkSession, path: str) -> DataFrame:
    """``(term, offset, length, df, pos)`` of a version 1 lexicon: one JSON object of term to [offset, length, df]."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", V1_ENTRY)).alias("pos", "term", "entry")).select("term", F.get("entry", F.lit(0)).alias("offset"), F.get("entry", F.lit(1)).alias("length"), F.get("entry", F.lit(2)).alias("df"), "pos")


def upgrade(spark: SparkSession, path: str) -> dict:
    """Bring a version 1 index up to date in place, and return its metadata: its ``lexicon.json`` becomes the
    term-sorted table, sizes and version are refreshed, the old file goes.  Other versions are refused."""
    meta = metadata(spark, path)
    if meta.get("format_version") != 1:
        raise ValueError("only a version 1 index can be upgraded")
    fs, hadoop = _fs(spark, path)
    old, new, made = (hadoop.Path(f"{path}/{name}") for name in ("lexicon.json", "lexicon", "lexicon.new"))
    lexicon_v1(spark, str(old)).select("term", "offset", "length", "df").repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(str(made))
    fs.delete(new, True)
    _moved(fs, made, new)
    meta = _described(spark, path, meta)
    _write_meta(spark, meta, path)
    # the old file goes last: until then an upgrade that failed can be run again
    fs.delete(old, True)
    return meta
