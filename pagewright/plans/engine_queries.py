"""Queries for the search engine's operators, with SQL where SQL can say the same."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions.url import display_url, fallback_title, unquoted, without_fragment
from pagewright.operators import postings as P
from pagewright.operators.dedup import kept_records
from pagewright.operators.dense import with_dense_ids
from pagewright.operators.report import latency_summary, order_statistics
from pagewright.plans.index import BuildStats, analysed, index_of_pages, index_of_texts, metadata, open_index, publish, sizes, upgrade
from pagewright.plans.search import Index, search, search_batch
from pagewright.session import cut, shared_folder
from pagewright.sources.tables import table, texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return (texts if name in ("corpus_pages", "documents") else table)(spark, sf_dir, name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("text is not null")


def _new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.term_frequencies(_documents(spark, sf_dir), "doc_id", T.terms(F.col("text")))


def strip_fragment(spark, sf_dir):
    return _table(spark, sf_dir, "corpus_pages").select("page_id", without_fragment(F.col("url")).alias("url"))


def url_display(spark, sf_dir):
    return _table(spark, sf_dir, "corpus_pages").select("page_id", display_url(F.col("url")).alias("display_url"))


def url_fallback_title(spark, sf_dir):
    return _table(spark, sf_dir, "corpus_pages").select("page_id", fallback_title(F.col("url")).alias("title"))


def url_terms(spark, sf_dir):
    pages = _table(spark, sf_dir, "corpus_pages").where("url is not null")
    return pages.select("page_id", F.explode(F.array_distinct(T.terms(unquoted(F.col("url"))))).alias("term"))


def dedup_exact_pages(spark, sf_dir):
    pages = _table(spark, sf_dir, "corpus_pages").withColumn("url", without_fragment(F.col("url")))
    return kept_records(pages, order="page_id").select("page_id")


def dedup_exact_documents(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"), F.col("text").alias("content"))
    return kept_records(rows, order="doc_id").select("doc_id")


def assign_doc_ids(spark, sf_dir):
    pages = _table(spark, sf_dir, "corpus_pages").select("page_id", "source")
    return with_dense_ids(pages, ["source", "page_id"]).select("page_id", "doc_id")


def term_frequencies(spark, sf_dir):
    return _postings(spark, sf_dir).select("doc_id", "term", "tf")


def doc_lengths(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.size(T.terms(F.col("text"))).cast("long").alias("doc_len"))


def lexicon_df(spark, sf_dir):
    return P.lexicon(_postings(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    lengths = doc_lengths(spark, sf_dir)
    # one row of counts beside another
    words = lexicon_df(spark, sf_dir).agg(F.count("*").alias("unique_terms")).scalar()
    return lengths.agg(F.count("*").alias("documents"), F.round(F.coalesce(F.avg(F.greatest("doc_len", F.lit(1))), F.lit(1.0)), 6).alias("average_length"), F.sum("doc_len").alias("tokens")).withColumn("unique_terms", words)


def idf_table(spark, sf_dir):
    n = _documents(spark, sf_dir).agg(F.count("*").cast("double").alias("n")).scalar()
    return lexicon_df(spark, sf_dir).select("term", F.round(P.idf(n, F.col("df")), 6).alias("idf"))


def postings_delta(spark, sf_dir):
    # cut, as a range partitioning reads its rows twice: for the ranges and for the rows
    return P.with_gaps(cut(_postings(spark, sf_dir))).select("term", "doc_id", "gap")


def postings_roundtrip(spark, sf_dir):
    gapped = with_dense_ids(P.with_gaps(cut(_postings(spark, sf_dir))), ["term", "doc_id"], "position")
    return P.without_gaps(gapped.select("term", "gap", "position", "tf")).select("term", "doc_id", "tf")


def postings_packed(spark, sf_dir):
    """Packed blocks of (gap, tf); here of 64 document ids, so that terms have several."""
    blocks = P.packed(_postings(spark, sf_dir).withColumn("important_tf", F.lit(0)), block=64)
    return blocks.select("term", "block", F.col("n").cast("long").alias("n"), F.array_join(F.transform("postings", lambda x: F.concat_ws(":", x["gap"].cast("string"), x["tf"].cast("string"))), " ").alias("packed"))


def packed_roundtrip(spark, sf_dir):
    postings = _postings(spark, sf_dir).withColumn("important_tf", F.lit(0))
    return P.unpacked(P.packed(postings)).select("term", "doc_id", "tf")


def sparse_lexicon(spark, sf_dir):
    """Every 256th term of the lexicon in order."""
    return with_dense_ids(cut(lexicon_df(spark, sf_dir)), ["term"], "pos").where("pos % 256 = 0").select("term", "pos")


def sparse_floor(spark, sf_dir):
    """Where each query term's block of the lexicon begins."""
    asked = _table(spark, sf_dir, "queries").select(F.explode(T.terms(F.col("query_text"))).alias("term")).distinct()
    return P.floor_positions(sparse_lexicon(spark, sf_dir), asked)


def query_term_weights(spark, sf_dir):
    terms = _table(spark, sf_dir, "queries").select("query_id", F.explode(T.terms(F.col("query_text"))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.round(1.0 + F.ln(F.count("*")), 6).alias("weight"))


def _text_index(spark, sf_dir) -> Index:
    return index_of_texts(_table(spark, sf_dir, "documents"), url_col="url")


def _asked(spark, sf_dir, mode: str | None = None) -> DataFrame:
    q = _table(spark, sf_dir, "queries")
    return q.select("query_id", F.col("query_text").alias("query"), (F.lit(mode) if mode else F.col("query_mode")).alias("mode"), F.col("result_limit").alias("limit"))


def _ranked(results: DataFrame) -> DataFrame:
    return results.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "matched_terms", "query_terms")


def bm25_all(spark, sf_dir):
    return _ranked(search_batch(_text_index(spark, sf_dir), _asked(spark, sf_dir, "all"), rerank=False))


def bm25_any(spark, sf_dir):
    return _ranked(search_batch(_text_index(spark, sf_dir), _asked(spark, sf_dir, "any"), rerank=False))


def bm25_auto(spark, sf_dir):
    return _ranked(search_batch(_text_index(spark, sf_dir), _asked(spark, sf_dir, "auto"), rerank=False))


def url_boost_rerank(spark, sf_dir):
    return _ranked(search_batch(_text_index(spark, sf_dir), _asked(spark, sf_dir)))


def _published(spark, sf_dir) -> str:
    """The index of the texts, written and sorted."""
    path = _new_path(spark, "index")
    index = _text_index(spark, sf_dir)
    publish(spark, index, BuildStats(index.n_documents, 0, 0, index.lexicon.count()), path)
    return path


def search_published(spark, sf_dir):
    """Every logged query on an index that was written, opened and looked up."""
    return _ranked(search_batch(open_index(spark, _published(spark, sf_dir)), _asked(spark, sf_dir)))


#: Single queries of :func:`search_single`: text, mode and limit.
SINGLE = (("information retrieval", "auto", 5), ("the server", "any", 10), ("machine learning lab", "all", 3), ("course", "auto", 50), ("library library research", "any", 5), ("nosuchterm course", "all", 5))


def search_single(spark, sf_dir):
    """A few queries one by one, by lookups."""
    found = None
    with open_index(spark, _published(spark, sf_dir)) as index:
        for number, (query, mode, limit) in enumerate(SINGLE):
            rows = search(spark, index, query, limit, mode).select(F.lit(number).cast("long").alias("query_id"), "rank", "url", F.round("score", 6).alias("score"), "matched_terms", "query_terms")
            found = rows if found is None else found.unionByName(rows)
        return cut(found)


def search_pages(spark, sf_dir):
    """The whole path: deduplicated HTML pages, stems, fields, every logged query in one job."""
    records = _table(spark, sf_dir, "corpus_pages").select(F.col("page_id").alias("source"), "url", "content")
    index, _ = index_of_pages(records)
    return search_batch(index, _asked(spark, sf_dir)).withColumn("score", F.round("score", 6)).drop("doc_id")


def build_stats(spark, sf_dir):
    records = _table(spark, sf_dir, "corpus_pages").select(F.col("page_id").alias("source"), "url", "content")
    _, stats = index_of_pages(records)
    return spark.createDataFrame([(stats.indexed_documents, stats.skipped_documents, stats.duplicate_documents, stats.unique_tokens)], "indexed_documents long, skipped_documents long, duplicate_documents long, unique_tokens long")


def dedup_counts(spark, sf_dir):
    """Pages that a build indexes and that it leaves out as duplicates."""
    usable = _table(spark, sf_dir, "corpus_pages").where("url is not null and content is not null").count()
    kept = dedup_exact_pages(spark, sf_dir).count()
    return spark.createDataFrame([(kept, usable - kept)], "kept long, duplicates long")


def index_sizes(spark, sf_dir):
    """Files of a published index: each table has bytes, and the metadata has their sum."""
    path = _published(spark, sf_dir)
    found, meta = sizes(spark, path), metadata(spark, path)
    total = sum(found.values()) == meta["index_bytes"] and found["postings"] == meta["postings_bytes"]
    return spark.createDataFrame([(name, size > 0, total) for name, size in found.items()], "name string, has_bytes boolean, sums boolean")


def page_fields(spark, sf_dir):
    """Title, snippet and length of every page."""
    records = _table(spark, sf_dir, "corpus_pages").select(F.col("page_id").alias("source"), "url", "content")
    return analysed(records).select(F.col("source").alias("page_id"), "title", "snippet", "doc_len")


def important_tf(spark, sf_dir):
    records = _table(spark, sf_dir, "corpus_pages").select(F.col("page_id").alias("source"), "url", "content")
    terms = analysed(records).select(F.col("source").alias("page_id"), F.explode("terms").alias("t"))
    return terms.select("page_id", "t.term", "t.tf", "t.important_tf")


def stem_vocabulary(spark, sf_dir):
    words = lexicon_df(spark, sf_dir).select("term")
    return words.select("term", T.stem_column("term").alias("stem"))


#: Examples of the published description of the stemmer, with their stems.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust",
    "replacement": "replac", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}
#: Broken and nested pages with what the rules for fields make of them: title, snippet, length, and of the term ``x`` the counts in all and in important elements.
FIELDS = (
    ("<title>One x</title><p>two x", "One x", "One x two x", 4, 2, 1),
    ("<h1><b>x</b></h1> y", "x", "x y", 2, 1, 2),
    ("<script>alpha x</script>beta<style>x</style><noscript>x</noscript> x", "", "beta x", 2, 1, 0),
    ("<title></title><h1>Head</h1>x", "", "Head x", 2, 1, 0),
    ("ma<b>x</b>ine &amp; x<!-- x --> &eacute;x", "", "ma x ine & x éx", 5, 2, 1),
    ("<b>x <p>x</p> x", "", "x x x", 3, 3, 3),
    ("", "", "", 0, 0, 0),
)


#: Percent-escapes, also in the middle of a character's bytes, and a plus sign.
ESCAPED = ("plain", "a+b", "100%25", "New%20transfer_students", "%C3%A9t%C3%A9", "caf%C3%A9/%E6%97%A5%E6%9C%AC", "%41%2f%5A", "x%20%20y", "%d0%9f%d1%80")


def unquote_examples(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in ESCAPED], "text string").select("text", unquoted(F.col("text")).alias("decoded"))


def stem_examples(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in STEMS], "word string").select("word", T.stem_column("word").alias("stem"))


def field_examples(spark, sf_dir):
    rows = spark.createDataFrame([(i, "", x[0]) for i, x in enumerate(FIELDS)], "source long, url string, content string")
    x = F.filter("terms", lambda t: t["term"] == "x")

    def count(name):
        return F.coalesce(F.get(x, F.lit(0))[name], F.lit(0)).cast("long").alias(f"x_{name}")

    return analysed(rows).select("source", "title", "snippet", F.col("doc_len").cast("long").alias("doc_len"), count("tf"), count("important_tf"))


def latency_percentiles(spark, sf_dir):
    modes = _table(spark, sf_dir, "queries").select(F.coalesce(F.lower(F.trim("query_mode")), F.lit("auto")).alias("mode"), "elapsed_ms")
    return latency_summary(modes, ["mode"], "elapsed_ms")


def load_report(spark, sf_dir):
    rows = _table(spark, sf_dir, "load_report")
    sums = rows.groupBy("concurrency").agg(*(F.sum(c).alias(c) for c in ("requests", "successful", "errors")), F.bround(F.max("max_ms"), 2).alias("max_ms"))

    def statistic(value, of, name):
        return order_statistics(rows, ["concurrency"], value, {"p95": 0.95}).select("concurrency", F.bround(of, 2).alias(name))

    for part in (statistic("throughput_qps", "median", "throughput_qps"), statistic("median_ms", "median", "median_ms"), statistic("p95_ms", "p95", "p95_ms")):
        sums = sums.join(part, "concurrency")
    return sums.select("concurrency", "requests", "successful", "errors", "throughput_qps", "median_ms", "p95_ms", "max_ms")


def load_workload(spark, sf_dir):
    """Requests of a load test: the query file's lines in turn, 5 rounds."""
    queries = with_dense_ids(_table(spark, sf_dir, "queries").where("trim(query_text) <> '' and query_text is not null").select("query_id", F.trim("query_text").alias("query")), ["query_id"], "n")
    n = queries.count()
    requests = spark.range(5 * n).select(F.col("id").alias("request"), (F.col("id") % max(1, n)).alias("n"))
    return requests.join(queries, "n").select("request", "query")


def migrate_lexicon(spark, sf_dir):
    """A version 1 index folder (its lexicon one JSON object of term to [offset, length, df]) brought up to date in place."""
    path = _new_path(spark, "index-v1")
    # the old format is one object in one file
    entries = F.sort_array(F.collect_list(F.struct("term", F.array(F.lit(0).cast("long"), F.length("term").cast("long"), "df").alias("entry"))))
    lexicon_df(spark, sf_dir).agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.text(f"{path}/lexicon.json")
    spark.createDataFrame([(json.dumps({"format_version": 1}),)], "value string").coalesce(1).write.text(f"{path}/meta")
    assert upgrade(spark, path)["format_version"] == metadata(spark, path)["format_version"] == 2
    return spark.read.parquet(f"{path}/lexicon").select("term", "length", "df")


_QUERIES = (
    strip_fragment, url_display, url_fallback_title, url_terms, dedup_exact_pages, dedup_exact_documents, assign_doc_ids, term_frequencies, doc_lengths, lexicon_df, corpus_stats, idf_table, postings_delta,
    postings_roundtrip, postings_packed, packed_roundtrip, sparse_lexicon, sparse_floor, query_term_weights, bm25_all, bm25_any, bm25_auto, url_boost_rerank, search_published, search_single, search_pages, build_stats, dedup_counts,
    index_sizes, page_fields, field_examples, important_tf, stem_vocabulary, stem_examples, unquote_examples, latency_percentiles, load_report, load_workload, migrate_lexicon,
)
QUERIES = {f.__name__: f for f in _QUERIES}

# ---------------------------------------------------------------- SQL for the oracle

_TERMS = T.terms_sql("text")
_TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2)"
_LEN = f"len AS (SELECT doc_id, url, CAST(len({_TERMS}) AS BIGINT) AS doc_len FROM documents WHERE text IS NOT NULL)"
_LEX = "lex AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"
_HOST = "regexp_extract(url, '^(?:[^:/?#]+:)?(?://([^/?#]*))?([^?#]*)', 1)"
_PATH = "regexp_extract(url, '^(?:[^:/?#]+:)?(?://([^/?#]*))?([^?#]*)', 2)"


def _ranking(mode: str, rerank: bool, queries: str = "queries", shown: str = "doc_id") -> str:
    terms = T.terms_sql("coalesce(query_text, '')")
    bonus = ""
    score = "score"
    if rerank:
        words = T.terms_sql(_decoded("coalesce(url, '')"))
        bonus = f", urls AS (SELECT doc_id, unnest(list_distinct({words})) AS term FROM documents), bonus AS (SELECT k.query_id, u.doc_id, sum(k.idf) * 0.75 AS bonus FROM known k JOIN urls u USING (term) GROUP BY 1, 2)"
        score = "score + coalesce(bonus, 0)"
    order = "CASE WHEN mode = 'all' THEN 0 ELSE matched END DESC"
    return f"""WITH {_TF}, {_LEN}, {_LEX}, n AS (SELECT count(*) AS n, avg(greatest(doc_len, 1)) AS a FROM len),
q AS (SELECT query_id, {mode} AS mode, coalesce(result_limit, 5) AS lim, unnest({terms}) AS term FROM {queries}),
qt AS (SELECT query_id, mode, lim, term, count(*) AS qtf FROM q WHERE mode IN ('all', 'any', 'auto') AND lim >= 1 GROUP BY 1, 2, 3, 4),
req AS (SELECT query_id, count(*) AS required FROM qt GROUP BY 1),
known AS (SELECT qt.*, required, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM qt JOIN req USING (query_id) JOIN lex USING (term), n),
hits AS (SELECT query_id, mode, lim, required, tf.doc_id, (1 + ln(qtf)) * idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * greatest(doc_len, 1) / a)) AS c FROM known JOIN tf USING (term) JOIN len ON len.doc_id = tf.doc_id, n),
scored AS (SELECT query_id, mode, lim, required, doc_id, count(*) AS matched, sum(c) AS score FROM hits GROUP BY 1, 2, 3, 4, 5 HAVING mode <> 'all' OR count(*) = required),
head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, round(score, 9) DESC, doc_id) AS place FROM scored) WHERE place <= greatest(256, 20 * lim)){bonus},
fin AS (SELECT h.query_id, mode, lim, required, h.doc_id, matched, {score} AS score FROM head h {"LEFT JOIN bonus USING (query_id, doc_id)" if rerank else ""}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, round(score, 9) DESC, doc_id) AS rank FROM fin)
SELECT query_id, CAST(rank AS INTEGER) AS rank, {shown}, round(score, 6) AS score, CAST(matched AS INTEGER) AS matched_terms, CAST(required AS INTEGER) AS query_terms FROM ranked {"JOIN (SELECT doc_id AS d, coalesce(url, '') AS url FROM len) ON d = doc_id" if shown != "doc_id" else ""} WHERE rank <= lim"""


def _decoded(url: str) -> str:
    """Percent-decoded; a plus sign stays."""
    return f"url_decode(replace({url}, '+', '%2B'))"


def _values(rows) -> str:
    """Rows of numbers and strings as a list of SQL values."""
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_GREEDY = """WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY page_id) AS n, page_id, 'u' || split_part(url, '#', 1) AS u, 'h' || md5(content) AS h FROM corpus_pages WHERE url IS NOT NULL AND content IS NOT NULL),
s AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS page_id, false AS kept, CAST([] AS VARCHAR[]) AS seen
UNION ALL SELECT r.n, r.page_id, NOT (list_contains(seen, u) OR list_contains(seen, h)), CASE WHEN list_contains(seen, u) OR list_contains(seen, h) THEN seen ELSE seen || [u, h] END FROM s JOIN r ON r.n = s.n + 1)"""


def _percentile(column: str, fraction: float) -> str:
    return f"list_sort(list({column}) FILTER ({column} IS NOT NULL))[CAST(round_even((count({column}) - 1) * {fraction}, 0) AS INTEGER) + 1]"


ORACLES = {
    "strip_fragment": "SELECT page_id, split_part(url, '#', 1) AS url FROM corpus_pages",
    "url_display": f"SELECT page_id, {_HOST} || {_PATH} AS display_url FROM corpus_pages",
    "url_fallback_title": f"WITH t AS (SELECT page_id, {_HOST} AS host, regexp_extract(regexp_replace({_PATH}, '/+$', ''), '([^/]*)$', 1) AS tail FROM corpus_pages) SELECT page_id, CASE WHEN tail = '' THEN host ELSE array_to_string(list_transform(list_filter(string_split_regex(translate(url_decode(replace(tail, '+', '%2B')), '-_', '  '), '\\s+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS title FROM t",
    "url_terms": f"SELECT DISTINCT page_id, unnest({T.terms_sql(_decoded('url'))}) AS term FROM corpus_pages WHERE url IS NOT NULL",
    "dedup_exact_pages": f"{_GREEDY} SELECT page_id FROM s WHERE kept",
    "dedup_counts": f"{_GREEDY} SELECT count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS duplicates FROM s WHERE n > 0",
    "dedup_exact_documents": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text",
    "assign_doc_ids": "SELECT page_id, row_number() OVER (ORDER BY source, page_id) - 1 AS doc_id FROM corpus_pages",
    "term_frequencies": f"WITH {_TF} SELECT doc_id, term, tf FROM tf",
    "doc_lengths": f"WITH {_LEN} SELECT doc_id, doc_len FROM len",
    "lexicon_df": f"WITH {_TF}, {_LEX} SELECT term, df FROM lex",
    "corpus_stats": f"WITH {_TF}, {_LEN}, {_LEX} SELECT count(*) AS documents, round(avg(greatest(doc_len, 1)), 6) AS average_length, CAST(sum(doc_len) AS BIGINT) AS tokens, (SELECT count(*) FROM lex) AS unique_terms FROM len",
    "idf_table": f"WITH {_TF}, {_LEN}, {_LEX} SELECT term, round(ln(1 + ((SELECT count(*) FROM len) - df + 0.5) / (df + 0.5)), 6) AS idf FROM lex",
    "postings_delta": f"WITH {_TF} SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM tf",
    "postings_roundtrip": f"WITH {_TF} SELECT term, doc_id, tf FROM tf",
    "packed_roundtrip": f"WITH {_TF} SELECT term, doc_id, tf FROM tf",
    "postings_packed": f"WITH {_TF}, g AS (SELECT term, doc_id, tf, doc_id // 64 AS block, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, doc_id // 64 ORDER BY doc_id), doc_id // 64 * 64) AS gap FROM tf) SELECT term, block, count(*) AS n, string_agg(gap || ':' || tf, ' ' ORDER BY doc_id) AS packed FROM g GROUP BY 1, 2",
    "sparse_floor": f"WITH {_TF}, sp AS (SELECT term, pos FROM (SELECT term, row_number() OVER (ORDER BY term) - 1 AS pos FROM (SELECT DISTINCT term FROM tf)) WHERE pos % 256 = 0), q AS (SELECT DISTINCT unnest({T.terms_sql('query_text')}) AS term FROM queries) SELECT q.term, max(sp.pos) AS pos FROM q LEFT JOIN sp ON sp.term <= q.term GROUP BY 1",
    "sparse_lexicon": f"WITH {_TF} SELECT term, pos FROM (SELECT term, row_number() OVER (ORDER BY term) - 1 AS pos FROM (SELECT DISTINCT term FROM tf)) WHERE pos % 256 = 0",
    "query_term_weights": f"SELECT query_id, term, round(1 + ln(count(*)), 6) AS weight FROM (SELECT query_id, unnest({T.terms_sql('query_text')}) AS term FROM queries) GROUP BY 1, 2",
    "bm25_all": _ranking("'all'", False),
    "bm25_any": _ranking("'any'", False),
    "bm25_auto": _ranking("'auto'", False),
    "url_boost_rerank": _ranking("coalesce(lower(trim(query_mode)), 'auto')", True),
    "search_published": _ranking("coalesce(lower(trim(query_mode)), 'auto')", True),
    "search_single": _ranking("query_mode", True, f"(VALUES {_values((i, *x) for i, x in enumerate(SINGLE))}) AS t(query_id, query_text, query_mode, result_limit)", "url").replace("SELECT query_id, CAST(rank", "SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank"),
    "index_sizes": "SELECT name, true AS has_bytes, true AS sums FROM (VALUES ('documents'), ('postings'), ('lexicon')) AS t(name)",
    "unquote_examples": f"SELECT text, {_decoded('text')} AS decoded FROM (VALUES {_values((x,) for x in ESCAPED)}) AS t(text)",
    "stem_examples": f"SELECT * FROM (VALUES {_values(STEMS.items())}) AS t(word, stem)",
    "field_examples": f"SELECT CAST(source AS BIGINT) AS source, title, snippet, CAST(doc_len AS BIGINT) AS doc_len, CAST(x_tf AS BIGINT) AS x_tf, CAST(x_important_tf AS BIGINT) AS x_important_tf FROM (VALUES {_values((i, *x[1:]) for i, x in enumerate(FIELDS))}) AS t(source, title, snippet, doc_len, x_tf, x_important_tf)",
    "latency_percentiles": f"SELECT coalesce(lower(trim(query_mode)), 'auto') AS mode, count(elapsed_ms) AS samples, round_even(median(elapsed_ms), 3) AS median_ms, round_even({_percentile('elapsed_ms', 0.95)}, 3) AS p95_ms, round_even({_percentile('elapsed_ms', 0.99)}, 3) AS p99_ms, round_even(max(elapsed_ms), 3) AS max_ms FROM queries GROUP BY 1",
    "load_report": f"SELECT concurrency, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(successful) AS BIGINT) AS successful, CAST(sum(errors) AS BIGINT) AS errors, round_even(median(throughput_qps), 2) AS throughput_qps, round_even(median(median_ms), 2) AS median_ms, round_even({_percentile('p95_ms', 0.95)}, 2) AS p95_ms, round_even(max(max_ms), 2) AS max_ms FROM load_report GROUP BY 1",
    "load_workload": "WITH q AS (SELECT trim(query_text, ' ') AS query, row_number() OVER (ORDER BY query_id) - 1 AS n FROM queries WHERE trim(query_text, ' ') <> '') SELECT request, query FROM (SELECT range AS request FROM range(0, 5 * (SELECT count(*) FROM q))) JOIN q ON n = request % (SELECT count(*) FROM q)",
    "migrate_lexicon": f"WITH {_TF}, {_LEX} SELECT term, CAST(length(term) AS BIGINT) AS length, df FROM lex",
}
