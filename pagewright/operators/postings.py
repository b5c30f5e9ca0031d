"""Postings in long form (term, doc_id, tf, important_tf, doc_len), their gaps, packed blocks, lexicon and statistics.

A term can have as many postings as there are documents, so none of these gathers a
whole term: gaps and ids run along range partitions, and packed lists are cut into
blocks of document ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.dense import with_floor, with_gaps_along, with_sums_along

#: Document ids of one packed block, which bounds its list.
BLOCK = 4096


def term_frequencies(documents: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """``(doc_id, term, tf, doc_len)`` from an array column of terms."""
    # the terms are cut once: both columns read the finished array
    cut = documents.select(F.col(id_col).alias("doc_id"), terms.alias("_terms"))
    words = cut.select("doc_id", "_terms", F.explode("_terms").alias("term")).select("doc_id", F.size("_terms").alias("doc_len"), "term")
    return words.groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf")).select("doc_id", "term", "tf", "doc_len")


def lexicon(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column | float, df: Column) -> Column:
    return F.ln(1.0 + (n - df + 0.5) / (df + 0.5))


def with_gaps(postings: DataFrame) -> DataFrame:
    """Postings with ``gap``, the distance to the term's previous document (the first from 0)."""
    return with_gaps_along(postings, "term", "doc_id")


def without_gaps(gapped: DataFrame, position: str = "position") -> DataFrame:
    """Document ids back from gaps in the order of ``position``."""
    return with_sums_along(gapped, "term", position, "gap", "doc_id")


def packed(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(term, block, n, postings)``: a term's postings as lists of (gap, tf, important_tf), a list for each ``block``
    document ids; gaps start anew from the block's first id."""
    number = F.floor(F.col("doc_id") / block).cast("long")
    lists = postings.groupBy("term", number.alias("block")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf", "important_tf"))).alias("p"))

    def entry(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.col("block") * block).otherwise(F.get(F.col("p"), i - 1)["doc_id"])
        return F.struct((x["doc_id"] - before).alias("gap"), x["tf"].alias("tf"), x["important_tf"].alias("important_tf"))

    return lists.select("term", "block", F.size("p").alias("n"), F.transform("p", entry).alias("postings"))


def unpacked(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(term, doc_id, tf, important_tf)`` back from packed blocks."""
    start = F.struct(F.col("block") * block, F.array().cast("array<struct<doc_id: bigint, tf: bigint, important_tf: bigint>>"))

    def step(acc: Column, x: Column) -> Column:
        doc_id = acc["col1"] + x["gap"]
        one = F.struct(doc_id.alias("doc_id"), x["tf"].cast("long").alias("tf"), x["important_tf"].cast("long").alias("important_tf"))
        return F.struct(doc_id.alias("col1"), F.concat(acc["col2"], F.array(one)).alias("col2"))

    # a block is bounded, so is the list that grows here
    return blocks.select("term", F.explode(F.aggregate("postings", start, step)["col2"]).alias("p")).select("term", "p.doc_id", "p.tf", "p.important_tf")


def floor_positions(sparse: DataFrame, probes: DataFrame) -> DataFrame:
    """``(term, pos)``: where a sparse lexicon (term, pos) says that the block of each probed term begins; null below its first term."""
    return with_floor(probes.select("term"), sparse, "term", "pos", "pos")


def saturation(weighted: Column, length: Column, average: Column | float, k1: float = 1.2, b: float = 0.75) -> Column:
    return weighted * (k1 + 1.0) / (weighted + k1 * (1.0 - b + b * length / average))
