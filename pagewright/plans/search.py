"""Ranked retrieval over an index, for one query or a whole table of them in one job.

Score: sum over the known query terms of ``(1 + ln qtf) * idf * saturation`` with
``tf + 2 * important_tf``; modes ``all`` (every term, by score) and ``any`` / ``auto``
(by matched terms, then score); the head of ``max(256, 20 * limit)`` documents is
ranked again with ``0.75 *`` the idf of the query terms in the URL; ties go by id.

An index is looked up, not scanned: the terms that are asked for are few, so they go
into the scans of lexicon and postings as a filter (files are sorted by term, row
groups without any of them are skipped); postings carry their document's length;
URL terms are fetched for the head, titles and snippets for the winners only.

Defined cases: a query without terms, with limit below 1 or with an unknown mode has
no results (for a single query an unknown mode is an error); mode and padding are
read as in lower case without blanks, a null mode as ``auto``, a null limit as 5;
``all`` with a term that isn't in the index has no results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions.url import display_url, fallback_title
from pagewright.operators.dense import with_dense_ids
from pagewright.operators.postings import saturation
from pagewright.operators.scoring import HEADS, Kind, heads
from pagewright.session import cut

MODES = ("all", "any", "auto")
IMPORTANT_BOOST, URL_BOOST, HEAD, DEFAULT_LIMIT = 2.0, 0.75, 256, 5
#: Most different terms that go into a scan as a filter, most queries that are sent to all tasks, most different
#: queries that are scored in one pass (further ones in further passes), and the largest limit of a single query whose
#: head is ranked by the driver.
MOST_TERMS, MOST_ROWS, MOST_KINDS, MOST_RANKED = 20_000, 500_000, 50_000, 1_000
RESULT = "rank int, score double, url string, matched_terms int, query_terms int, title string, snippet string, display_url string"


@dataclass(frozen=True)
class Analyzer:
    """One way to cut texts into terms: as a column for many texts, as a column for short ones, for one text."""

    column: Callable[[Column], Column]
    short: Callable[[Column], Column]
    one: Callable[[str], list[str]]


ANALYZERS = {"surface": Analyzer(T.terms, T.surface_column, T.surface), "porter": Analyzer(T.tokenize_column, T.tokenize_column, T.tokenize)}


@dataclass
class Index:
    """``documents`` (doc_id, url, doc_len, title, snippet, url_terms), ``postings`` (term, doc_id, tf, important_tf, doc_len),
    ``lexicon`` (term, df), the number of documents and the analyzer that made the terms.

    As a context the index keeps its lexicon and documents in memory, and releases them at the end."""

    documents: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    n_documents: int
    average_length: float
    analyzer: str = "porter"
    _kept: list[DataFrame] = field(default_factory=list, repr=False)

    def warm(self) -> Index:
        """Keep lexicon and documents in the executors' memory (and on their disks beyond it)."""
        if not self._kept:
            self._kept = [self.lexicon.persist(), self.documents.persist()]
            for table in self._kept:
                table.count()
        return self

    def close(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    def __enter__(self) -> Index:
        return self.warm()

    def __exit__(self, *_: object) -> None:
        self.close()


def query_terms(queries: DataFrame, analyzer: str) -> DataFrame:
    """``(query_id, mode, limit, term, qtf)``, one row a distinct term."""
    read = queries.select(
        "query_id",
        F.coalesce(F.lower(F.trim("mode")), F.lit("auto")).alias("mode"),
        F.coalesce("limit", F.lit(DEFAULT_LIMIT)).alias("limit"),
        F.explode(ANALYZERS[analyzer].short(F.coalesce("query", F.lit("")))).alias("term"),
    ).where(F.col("mode").isin(*MODES) & (F.col("limit") >= 1))
    return read.groupBy("query_id", "mode", "limit", "term").agg(F.count("*").alias("qtf"))


def _exact_sum(c: Column) -> Column:
    """Sum of contributions as whole numbers of 2^-40, which is the same in any order and needs no list of the parts."""
    return F.sum(F.round(c * float(1 << 40)).cast("long")) / float(1 << 40)


def _contribution(index: Index, qtf: Column, weight: Column) -> Column:
    weighted = F.col("tf") + IMPORTANT_BOOST * F.col("important_tf")
    return (1.0 + F.ln(qtf)) * weight * saturation(weighted, F.greatest("doc_len", F.lit(1)), index.average_length)


def _shown(documents: DataFrame) -> list[Column]:
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(fallback_title(F.col("url")))
    return [F.col("url"), title.alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet"), display_url(F.col("url")).alias("display_url")]


def _among(table: DataFrame, names: list[str]) -> DataFrame:
    """The rows of the terms ``names``; a filter of the scan as long as there are few."""
    if len(names) <= MOST_TERMS:
        return table.where(F.col("term").isin(names))
    return table.join(F.broadcast(table.sparkSession.createDataFrame(pa.table({"term": pa.array(names, pa.string())}))), "term", "left_semi")


def _kinds(asked: DataFrame, rerank: bool) -> tuple[DataFrame, DataFrame]:
    """Queries of the same words whose modes rank alike have the same ranking, which is made once: the different ones
    ``(kind, words, every, reach)``, numbered from 0, and ``(query_id, limit, kind, reach)``.  ``reach`` is how deep
    the head goes: that of the query and, for a kind, that of its deepest query."""
    reach = F.greatest(F.lit(HEAD).cast("long"), 20 * F.col("limit").cast("long")) if rerank else F.col("limit").cast("long")
    whole = asked.groupBy("query_id", "mode", "limit").agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("words"))
    whole = cut(whole.select("query_id", "limit", "words", (F.col("mode") == "all").alias("every"), reach.alias("reach")))
    kinds = whole.groupBy("words", "every").agg(F.min("query_id").alias("_first"), F.max("reach").alias("reach"))
    kinds = cut(with_dense_ids(kinds, ["_first"], "kind").select("kind", "words", "every", "reach"))
    return kinds, cut(whole.join(kinds.select("kind", "words", "every"), ["words", "every"]).select("query_id", "limit", "kind", "reach"))


def _heads(index: Index, kinds: DataFrame, rerank: bool) -> DataFrame | None:
    """``(kind, doc_id, matched, score, nano)``: at least the best ``reach`` documents of every kind by ``nano``, with the
    URL's bonus in ``score`` if it is asked for; none if the index has none of the words."""
    spark = kinds.sparkSession
    asked = kinds.collect()  # MOST_KINDS rows at most
    names = sorted({w["term"] for r in asked for w in r["words"]})
    df = {r["term"]: r["df"] for r in _among(index.lexicon, names).select("term", "df").collect()}
    number = {t: i for i, t in enumerate(df)}
    weight = {t: math.log(1 + (index.n_documents - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    of_kind: list[Kind] = []
    for r in asked:
        known = [w for w in r["words"] if w["term"] in df]
        if known and (len(known) == len(r["words"]) or not r["every"]):
            # in the order of (df, term), so that equal inputs give equal bits
            words = [(number[w["term"]], (1.0 + math.log(w["qtf"])) * weight[w["term"]], weight[w["term"]]) for w in sorted(known, key=lambda w: df[w["term"]])]
            of_kind.append(Kind(r["kind"], words, len(words) if r["every"] else 1, r["reach"]))
    if not of_kind:
        return None
    numbers = spark.createDataFrame(pa.table({"term": pa.array(list(number), pa.string()), "number": pa.array(list(number.values()), pa.int32())}))
    weighted = F.col("tf") + IMPORTANT_BOOST * F.col("important_tf")
    hits = _among(index.postings, list(df)).join(F.broadcast(numbers), "term").select(F.col("doc_id").cast("long").alias("doc_id"), "number", weighted.cast("double").alias("weighted"), F.greatest("doc_len", F.lit(1)).cast("long").alias("doc_len"))
    named = None
    if rerank:
        named = index.documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode("url_terms").alias("term")).join(F.broadcast(numbers), "term").select("doc_id", "number")
    return heads(hits, sum(df.values()), of_kind, len(number), index.average_length, named, URL_BOOST)


def search_batch(index: Index, queries: DataFrame, rerank: bool = True) -> DataFrame:
    """Results of every query of ``queries`` (query_id, query, mode, limit)."""
    kinds, members = _kinds(cut(query_terms(queries, index.analyzer)), rerank)
    parts = [_heads(index, kinds.where(F.col("kind").between(i, i + MOST_KINDS - 1)), rerank) for i in range(0, kinds.count(), MOST_KINDS)]
    parts = [x for x in parts if x is not None] or [queries.sparkSession.createDataFrame([], HEADS)]
    small = members.count() <= MOST_ROWS

    def narrow(rows: DataFrame) -> DataFrame:
        """Rows of one a query at most."""
        return F.broadcast(rows) if small else rows

    # only documents with all words are left in mode all, so coverage may go first there, too
    best = Window.partitionBy("kind").orderBy(F.desc("matched"), F.desc("nano"), "doc_id")
    head = reduce(DataFrame.unionByName, parts).withColumn("place", F.row_number().over(best))
    asked = members.groupBy("kind", "reach").agg(F.max("limit").alias("most"))
    if rerank:
        again = Window.partitionBy("kind", "reach").orderBy(F.desc("matched"), F.desc(F.round("score", 9)), "doc_id")
        head = head.join(narrow(asked), "kind").where("place <= reach").withColumn("rank", F.row_number().over(again))
    else:
        head = head.join(narrow(asked), "kind").withColumn("rank", F.col("place"))
    won = head.where("rank <= most").select("kind", "reach", "rank", "score", "doc_id", F.col("matched").alias("matched_terms"))
    won = won.join(index.documents.select("doc_id", *_shown(index.documents)), "doc_id")
    size = kinds.select("kind", F.size("words").alias("query_terms"))
    served = won.join(narrow(members.join(narrow(size), "kind")), ["kind", "reach"]).where("rank <= limit")
    return served.select("query_id", F.col("rank").cast("int").alias("rank"), "score", "doc_id", "url", F.col("matched_terms").cast("int").alias("matched_terms"), "query_terms", "title", "snippet", "display_url")


def _literals(values: list, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def search(spark: SparkSession, index: Index, query: str, limit: int = DEFAULT_LIMIT, mode: str = "auto") -> DataFrame:
    """The ranked results of one query, by a few lookups: its words in the lexicon, their postings, the URL terms of the head."""
    if mode not in MODES:
        raise ValueError("mode must be 'all', 'any' or 'auto'")
    if limit > MOST_RANKED:
        rows = spark.createDataFrame([(0, query, mode, int(limit))], "query_id long, query string, mode string, limit int")
        return search_batch(index, rows).drop("query_id", "doc_id").orderBy("rank")
    nothing = spark.createDataFrame([], RESULT)
    asked = Counter(ANALYZERS[index.analyzer].one(query or ""))
    if limit < 1 or not asked:
        return nothing
    found = {r["term"]: r["df"] for r in index.lexicon.where(F.col("term").isin(list(asked))).collect()}  # a row a word of the query at most
    if not found or (mode == "all" and len(found) < len(asked)):
        return nothing
    words = sorted(found, key=lambda t: (found[t], list(asked).index(t)))  # the rarest first
    number = {t: i + 1 for i, t in enumerate(words)}
    weight = {t: math.log(1 + (index.n_documents - found[t] + 0.5) / (found[t] + 0.5)) for t in words}
    term = sum((F.when(F.col("term") == t, i).otherwise(0) for t, i in number.items()), F.lit(0))
    hits = index.postings.where(F.col("term").isin(words)).withColumn("w", term)
    qtf, idfs = _literals([asked[t] for t in words], "int"), _literals([weight[t] for t in words], "double")
    part = _contribution(index, F.element_at(qtf, F.col("w")), F.element_at(idfs, F.col("w")))
    scored = hits.select("doc_id", part.alias("c")).groupBy("doc_id").agg(F.count("*").cast("int").alias("matched"), _exact_sum(F.col("c")).alias("score"))
    if mode == "all":
        scored = scored.where(F.col("matched") == len(asked))
    coverage = [] if mode == "all" else [F.desc("matched")]
    # bounded by the limit
    head = scored.orderBy(*coverage, F.desc("score"), "doc_id").limit(max(HEAD, 20 * limit)).collect()
    if not head:
        return nothing
    ids = [r["doc_id"] for r in head]
    among = index.documents.where(F.col("doc_id").isin(ids)).select("doc_id", F.array_intersect("url_terms", _literals(words, "string")).alias("inside"))
    bonus = {r["doc_id"]: URL_BOOST * sum(weight[t] for t in words if t in r["inside"]) for r in among.collect()}
    ranked = sorted(((r["doc_id"], r["matched"], r["score"] + bonus.get(r["doc_id"], 0.0)) for r in head), key=lambda x: (0 if mode == "all" else -x[1], -x[2], x[0]))[:limit]
    won = _literals([x[0] for x in ranked], "bigint")
    rank = F.array_position(won, F.col("doc_id").cast("bigint")).cast("int")
    shown = index.documents.where(F.col("doc_id").isin([x[0] for x in ranked])).select(rank.alias("rank"), *_shown(index.documents))
    score, matched = (_literals([x[k] for x in ranked], kind) for k, kind in ((2, "double"), (1, "int")))
    return shown.select(
        "rank", F.element_at(score, F.col("rank")).alias("score"), "url", F.element_at(matched, F.col("rank")).alias("matched_terms"), F.lit(len(asked)).cast("int").alias("query_terms"), "title", "snippet", "display_url"
    ).orderBy("rank")
