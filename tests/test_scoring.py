"""Batches of queries: what is shuffled for them, and their ranking over many blocks."""

import math
import os
import random
from collections import Counter

import pytest

from pagewright.functions.htmlfields import document_fields
from pagewright.operators import scoring
from pagewright.plans import search as s
from pagewright.plans.index import BuildStats, index_of_pages, index_of_texts, open_index, publish
from pagewright.session import cut

WORDS = "anchor basil copper drum ember fern gravel hazel iris jetty kelp loom".split()
ASKED = "query_id long, query string, mode string, limit int"


def shuffled_rows(spark, act):
    """Rows that ``act`` writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    act()
    return written() - before


def texts_of(spark, n, seed=1, most=9):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, most))), f"https://a.example/{rng.choice(WORDS)}/{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, url string")


def test_no_row_for_each_query_and_document(spark):
    """Every query's words are in every text: 200 queries of 60 kinds over 800 texts would be 160,000 rows."""
    index = index_of_texts(spark.createDataFrame([(i, " ".join(WORDS), "") for i in range(800)], "doc_id long, text string, url string"))
    asked = [(i, f"{WORDS[i % 12]} {WORDS[(i + 1 + i % 5) % 12]}", ("all", "any", "auto")[i % 3], 5) for i in range(200)]
    found = []
    assert shuffled_rows(spark, lambda: found.extend(s.search_batch(index, spark.createDataFrame(asked, ASKED), rerank=False).collect())) < 60_000
    assert len(found) == 1000 and {(r["rank"], r.doc_id) for r in found} == {(i + 1, i) for i in range(5)}


def asked_often(spark):
    return spark.createDataFrame([(i, f"{WORDS[i % 12]} {WORDS[(i + 1 + i % 5) % 12]}", ("all", "any", "auto")[i % 3], 1) for i in range(200)], ASKED)


def test_no_row_for_each_query_and_document_when_published(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(s, "HEAD", 5)
    texts = index_of_texts(spark.createDataFrame([(i, " ".join(WORDS), "") for i in range(800)], "doc_id long, text string, url string"))
    publish(spark, texts, BuildStats(800, 0, 0, 12), str(tmp_path / "index"))
    index, found = open_index(spark, str(tmp_path / "index")), []
    assert shuffled_rows(spark, lambda: found.extend(s.search_batch(index, asked_often(spark)).collect())) < 60_000
    assert len(found) == 200 and {r.doc_id for r in found} == {0}


def test_a_published_index_is_written_small(spark, tmp_path):
    """Texts and postings lie there as zstd, and nothing is lost."""
    rows, texts = texts_of(spark, 300)
    index = index_of_texts(texts)
    publish(spark, index, BuildStats(300, 0, 0, 12), str(tmp_path / "index"))
    assert all(".zstd." in f for name in ("documents", "postings") for f in spark.read.parquet(str(tmp_path / "index" / name)).inputFiles())
    assert sorted(map(tuple, open_index(spark, str(tmp_path / "index")).postings.collect())) == sorted(map(tuple, index.postings.collect()))


def test_heads_are_shuffled_once(spark):
    """Their URLs' words are known where they are scored: 60 heads of 256 of 800 texts need no second shuffle to meet the texts."""
    index = index_of_texts(spark.createDataFrame([(i, " ".join(WORDS), f"https://a.example/{WORDS[i % 12]}") for i in range(800)], "doc_id long, text string, url string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = []
    try:
        assert shuffled_rows(spark, lambda: found.extend(s.search_batch(index, asked_often(spark)).collect())) < 35_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # all words have one idf, so the first text of the word that is asked for and smallest comes first
    assert {r.query_id: r.doc_id for r in found} == {i: min(i % 12, (i + 1 + i % 5) % 12) for i in range(200)}


def test_texts_that_score_alike_do_not_all_leave_their_blocks(spark, monkeypatch):
    """Of 800 equal texts in some 20 blocks a query wants 64, which is as many as a block has: 60 queries would send 48,000 rows."""
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 480)
    index = index_of_texts(spark.createDataFrame([(i, " ".join(WORDS), "") for i in range(800)], "doc_id long, text string, url string"))
    asked = spark.createDataFrame([(i, f"{WORDS[i % 12]} {WORDS[(i + 1 + i // 12) % 12]}", "any", 64) for i in range(60)], ASKED)
    found = []
    assert shuffled_rows(spark, lambda: found.extend(s.search_batch(index, asked, rerank=False).collect())) < 40_000
    assert len(found) == 60 * 64 and all(r.doc_id == r["rank"] - 1 for r in found)


def test_counted_texts_are_written_small(spark):
    rows = [(i, " ".join(f"{w}{i * 7919 % 9973}" for w in WORDS), f"https://a.example/{i}") for i in range(4000)]

    def size(codec):
        files = cut(index_of_texts(spark.createDataFrame(rows, "doc_id long, text string, url string")).documents, codec).inputFiles()
        return sum(os.path.getsize(f.removeprefix("file:")) for f in files)

    files = index_of_texts(spark.createDataFrame(rows, "doc_id long, text string, url string")).documents.inputFiles()
    assert all(".zstd." in f for f in files) and size("zstd") < 0.8 * size("snappy")


def ranking(rows, query, mode, limit, rerank):
    """By the rules alone: (doc_id, score, matched) in order."""
    texts = {i: Counter(text.split()) for i, text, _ in rows}
    lengths = {i: sum(c.values()) for i, c in texts.items()}
    average = sum(lengths.values()) / len(lengths)
    asked = Counter(query.split())
    df = {t: sum(t in c for c in texts.values()) for t in asked}
    known = [t for t in asked if df[t]]
    idf = {t: math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) for t in known}
    head = []
    for i, _, url in rows:
        has = [t for t in known if t in texts[i]]
        if has and (mode != "all" or len(has) == len(asked)):
            score = sum((1 + math.log(asked[t])) * idf[t] * texts[i][t] * 2.2 / (texts[i][t] + 1.2 * (0.25 + 0.75 * lengths[i] / average)) for t in has)
            head.append((-len(has), -round(score, 9), i, score, 0.75 * sum(idf[t] for t in known if t in url.split("/"))))
    head = sorted(head)[: max(s.HEAD, 20 * limit)]
    if rerank:
        head = sorted((m, -round(score + bonus, 9), i, score + bonus, 0) for m, _, i, score, bonus in head)
    return [(i, round(score, 6), -m) for m, _, i, score, _ in head[:limit]]


@pytest.mark.parametrize("rerank", [False, True])
def test_many_blocks_and_passes_rank_as_one(spark, monkeypatch, rerank):
    """Few postings a block, few queries a pass and a filter of few terms; many texts score alike, so ids decide."""
    rows, texts = texts_of(spark, 500)
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 150)
    monkeypatch.setattr(s, "MOST_KINDS", 9)
    monkeypatch.setattr(s, "MOST_TERMS", 4)
    monkeypatch.setattr(s, "HEAD", 30)
    rng = random.Random(2)
    asked = [(100 + i, " ".join(rng.choice([*WORDS, "nowhere"]) for _ in range(rng.randrange(1, 4))), rng.choice(["all", "any", "auto"]), rng.choice([1, 3, 20])) for i in range(40)]
    asked += [(200, "anchor basil", "any", 3), (201, "basil anchor", "auto", 1), (202, "anchor basil", "any", 20), (203, "nowhere", "any", 5), (204, "", "any", 5), (205, "anchor", "any", 0)]
    found = {}
    for r in s.search_batch(index_of_texts(texts), spark.createDataFrame(asked, ASKED), rerank).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.doc_id, round(r.score, 6), r.matched_terms, r.query_terms))
    for query_id, query, mode, limit in asked:
        want = ranking(rows, query, mode, limit, rerank) if query and limit else []
        assert sorted(found.get(query_id, [])) == [(k + 1, *w, len(set(query.split()))) for k, w in enumerate(want)], (query, mode, limit)


def test_terms_are_counted_in_their_rows(spark):
    index = index_of_texts(spark.createDataFrame([(1, "b a b", None), (2, "", "x"), (3, "A c", "y"), (4, None, "z")], "doc_id long, text string, url string"))
    assert sorted((r.term, r.doc_id, r.tf, r.doc_len) for r in index.postings.collect()) == [("a", 1, 1, 3), ("a", 3, 1, 2), ("b", 1, 2, 3), ("c", 3, 1, 2)]
    assert sorted((r.doc_id, r.doc_len) for r in index.documents.collect()) == [(1, 3), (2, 0), (3, 2)] and index.n_documents == 3
    assert shuffled_rows(spark, lambda: index.postings.collect()) == 0


def test_pages_are_numbered_where_they_are_analysed(spark, monkeypatch):
    """Ids follow source and url though pages that can't be read lie between, and a batch has no row for each query and page."""
    monkeypatch.setattr(s, "HEAD", 5)

    def read(content):
        return document_fields(content) if content != "<p>bad</p>" else 1 / 0

    rows = [(i * 7 % 150, f"https://a.example/{i}", "<p>bad</p>" if i == 70 else f"<p>{' '.join(WORDS)} x{i}</p>") for i in range(150)]
    index, stats = index_of_pages(spark.createDataFrame(rows, "source long, url string, content string").repartition(5), read=read)
    want = [url for source, url, content in sorted(rows) if content != "<p>bad</p>"]
    assert [(r.doc_id, r.url) for r in index.documents.orderBy("doc_id").collect()] == list(enumerate(want)) and stats.skipped_documents == 1
    found = []
    assert shuffled_rows(spark, lambda: found.extend(s.search_batch(index, asked_often(spark)).collect())) < 15_000
    assert len(found) == 200
