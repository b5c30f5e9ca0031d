import json
import math
import random
import statistics
import threading
import zipfile
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from urllib.error import HTTPError
from urllib.parse import quote, unquote
from urllib.request import urlopen

import pytest
from pyspark.sql import functions as F

from pagewright.cli import main, parser, result_lines
from pagewright.functions.htmlfields import document_fields, snippet_of
from pagewright.functions.text import stem, surface, terms, tokenize
from pagewright.functions.url import display_url, fallback_title, site, unquoted
from pagewright.operators import postings as P
from pagewright.operators.dedup import kept_records
from pagewright.operators.dense import with_dense_ids
from pagewright.operators.report import latency_summary, order_statistics
from pagewright.plans import index as ix
from pagewright.plans.reports import benchmark, load_test
from pagewright.plans.search import Index, search, search_batch
from pagewright.plans.service import create_server, parameters
from pagewright.session import shared_folder
from pagewright.sources.corpus import count_hint, read_corpus, read_queries

NAMES = "harbour lantern orchard granite meadow violin".split()


def garden_pages():
    """Invented pages: some headed, some with a telling address, a copy of one's content and another of one's address."""
    rng = random.Random(20)
    pages = []
    for i in range(30):
        words = " ".join(rng.choice(NAMES) for _ in range(rng.randrange(3, 40)))
        head = f"<h2>{rng.choice(NAMES)} notes</h2>" if i % 3 == 0 else ""
        pages.append((f"https://gardens.example/{NAMES[i % 6]}-walk/{i}#part", f"{head}<p>{words}</p>"))
    return [*pages, ("https://gardens.example/copied", pages[4][1]), (pages[7][0].replace("#part", "#other"), "<p>quite another text</p>"), ("https://gardens.example/empty", "")]


def expected(query, mode, limit):
    """Ranking by the rules alone: (url, score, matched) of the kept pages."""
    urls, texts, kept = set(), set(), []
    for url, content in garden_pages():
        url = url.partition("#")[0]
        if url not in urls and content not in texts:
            urls.add(url)
            texts.add(content)
            kept.append((url, document_fields(content)))
    lengths = [max(1, sum(f.total.values())) for _, f in kept]
    average = statistics.fmean(lengths)
    asked = Counter(tokenize(query))
    df = {t: sum(t in f.total for _, f in kept) for t in asked}
    known = [t for t in asked if df[t]]
    if not known or (mode == "all" and len(known) < len(asked)):
        return []
    idf = {t: math.log(1 + (len(kept) - df[t] + 0.5) / (df[t] + 0.5)) for t in known}
    rows = []
    for number, ((url, f), length) in enumerate(zip(kept, lengths)):
        score = matched = 0
        for t in known:
            if t in f.total:
                w = f.total[t] + 2.0 * f.important[t]
                score += (1 + math.log(asked[t])) * idf[t] * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * length / average))
                matched += 1
        if matched and (mode != "all" or matched == len(asked)):
            score += 0.75 * sum(idf[t] for t in known if t in tokenize(unquote(url)))
            rows.append((0 if mode == "all" else -matched, -score, number, url, matched))
    return [(url, round(-score, 9), matched) for _, score, _, url, matched in sorted(rows)[:limit]]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    archive = str(folder / "gardens.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for i, (url, content) in enumerate(garden_pages()):
            z.writestr(f"pages/{i:03d}.json", json.dumps({"url": url, "content": content, "encoding": "x"}))
        for name, value in (("no", "{no json"), ("list", "[1]"), ("number", json.dumps({"url": 5, "content": "x"})), ("without", json.dumps({"url": "x"}))):
            z.writestr(f"pages/z-{name}.json", value)
        z.writestr("pages/notes.txt", "x")
    path = str(folder / "index")
    stats = ix.build(spark, read_corpus(spark, archive), path, order="position")
    return archive, path, stats


def test_build_counts_and_metadata(spark, built):
    archive, path, stats = built
    assert (stats.indexed_documents, stats.duplicate_documents, stats.skipped_documents) == (31, 2, 0)
    assert count_hint(spark, archive) == 37
    meta = ix.metadata(spark, path)
    assert meta["format_version"] == 2 and meta["indexed_documents"] == 31 and meta["unique_tokens"] == stats.unique_tokens > 6 and meta["partial_indexes"] >= 1
    assert meta["index_bytes"] == sum(ix.sizes(spark, path).values()) == stats.index_bytes > meta["postings_bytes"] == stats.postings_bytes > 0
    assert meta["index_kb"] == round(meta["index_bytes"] / 1024, 2) and meta["workers"] >= 1 and meta["elapsed_seconds"] > 0
    assert {"skipped_documents", "duplicate_documents", "flush_documents", "posting_codec", "scoring"} <= meta.keys()
    index = ix.open_index(spark, path)
    assert [r.doc_id for r in index.documents.orderBy("doc_id").collect()] == list(range(31))


@pytest.mark.parametrize("query", ["harbour", "violin lantern", "granite granite meadow", "orchard nosuchword", "nosuchword", "note walk violin", " ", "NOTES Harbour's"])
def test_single_and_batch_follow_the_rules(spark, built, query):
    with ix.open_index(spark, built[1]) as index:
        batch = spark.createDataFrame([(i, query, mode, 7) for i, mode in enumerate(("all", "any", "auto"))], "query_id long, query string, mode string, limit int")
        found = search_batch(index, batch).collect()
        for i, mode in enumerate(("all", "any", "auto")):
            want = expected(query, mode, 7)
            one = search(spark, index, query, 7, mode).collect()
            assert [(r.url, round(r.score, 9), r.matched_terms) for r in one] == want
            rows = sorted((r for r in found if r.query_id == i), key=lambda r: r["rank"])
            assert [(r.url, round(r.score, 9), r.matched_terms) for r in rows] == want
            assert [r["rank"] for r in one] == list(range(1, len(want) + 1))
            for a, b in zip(one, rows):
                assert a.title == b.title and a.snippet == b.snippet and a.display_url == b.display_url == a.url.removeprefix("https://") and a.query_terms == b.query_terms


def test_lookups_reach_the_scan(spark, built):
    """The wanted terms are pushed to the files; a large limit goes the way of the batch."""
    index = ix.open_index(spark, built[1])
    plan = index.postings.where(F.col("term").isin(["harbour", "violin"]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [harbour,violin])]" in plan or "In(term" in plan
    assert [r.url for r in search(spark, index, "harbour", 2000).collect()] == [u for u, _, _ in expected("harbour", "auto", 2000)]


def test_defined_cases_of_a_query(spark, built):
    index = ix.open_index(spark, built[1])
    assert search(spark, index, "harbour", limit=0).collect() == [] and search(spark, index, "").collect() == []
    with pytest.raises(ValueError):
        search(spark, index, "harbour", mode="best")
    index.warm().close()
    index.close()


def test_publish_keeps_what_is_there(spark, built, tmp_path):
    archive, path, _ = built
    with pytest.raises(FileExistsError):
        ix.build(spark, read_corpus(spark, archive), path, order="position")
    own = str(tmp_path / "own")
    index = ix.open_index(spark, path)
    stats = ix.BuildStats(31, 0, 0, 1)
    ix.publish(spark, index, stats, own)
    broken = Index(index.documents.select("doc_id", F.raise_error(F.lit("broken")).alias("url")), index.postings, index.lexicon, 31, 1.0)
    with pytest.raises(Exception):
        ix.publish(spark, broken, stats, own, overwrite=True)
    assert ix.open_index(spark, own).documents.count() == 31
    ix.publish(spark, index, stats, own, overwrite=True)
    assert ix.open_index(spark, own).documents.count() == 31 and [p.name for p in tmp_path.iterdir()] == ["own"]


def test_folder_corpus_and_errors(spark, tmp_path):
    for name, url in (("a/1.json", "u1"), ("a-b/1.json", "u2")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"url": url, "content": "text"}))
    assert [r.url for r in read_corpus(spark, str(tmp_path)).orderBy("position").collect()] == ["u1", "u2"]
    archive = tmp_path / "c.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for name, url in (("a/1.json", "u1"), ("a-b/1.json", "u2")):
            z.writestr(name, json.dumps({"url": url, "content": "text"}))
    assert [r.url for r in read_corpus(spark, str(archive)).orderBy("position").collect()] == ["u2", "u1"]
    with pytest.raises(FileNotFoundError):
        read_corpus(spark, str(tmp_path / "nothing"))
    (tmp_path / "plain").write_text("x")
    with pytest.raises(ValueError):
        read_corpus(spark, str(tmp_path / "plain"))
    (tmp_path / "a" / "_hidden.json").write_text(json.dumps({"url": "u3", "content": "text"}))
    (tmp_path / ".deep").mkdir()
    (tmp_path / ".deep" / "4.json").write_text(json.dumps({"url": "u4", "content": "text"}))
    assert sorted(r.url for r in read_corpus(spark, str(tmp_path)).collect()) == ["u1", "u2", "u3", "u4"] and count_hint(spark, str(tmp_path)) == 4
    (tmp_path / "q.txt").write_text("# note\n one two \n\n  # more\nthree\n")
    assert [r["query"] for r in read_queries(spark, str(tmp_path / "q.txt")).orderBy("query_id").collect()] == ["one two", "three"]


def test_upgrade_in_place(spark, built, tmp_path):
    (tmp_path / "lexicon.json").write_text(json.dumps({"b": [0, 5, 2], "a": [5, 9, 1]}))
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "part").write_text(json.dumps({"format_version": 1, "indexed_documents": 2}))
    with pytest.raises(ValueError):
        ix.open_index(spark, str(tmp_path))
    meta = ix.upgrade(spark, str(tmp_path))
    assert meta == ix.metadata(spark, str(tmp_path)) and meta["format_version"] == 2 and meta["indexed_documents"] == 2 and meta["index_bytes"] > 0
    assert [(r.term, r.offset, r.length, r.df) for r in spark.read.parquet(str(tmp_path / "lexicon")).orderBy("term").collect()] == [("a", 5, 9, 1), ("b", 0, 5, 2)]
    assert not (tmp_path / "lexicon.json").exists()
    with pytest.raises(ValueError):
        ix.upgrade(spark, str(tmp_path))


def _greedy(rows):
    urls, hashes, kept = set(), set(), []
    for key, url, content in sorted(rows):
        if url not in urls and content not in hashes:
            urls.add(url)
            hashes.add(content)
            kept.append(key)
    return kept


def test_greedy_dedup(spark):
    rng = random.Random(3)
    for rows in ([(1, "u1", "h1"), (2, "u2", "h1"), (3, "u2", "h3")], [(i, f"u{rng.randrange(12)}", f"h{rng.randrange(12)}") for i in range(30)], []):
        df = spark.createDataFrame([(*r, 1) for r in rows], "source long, url string, content string, n_u long")
        assert sorted(r.source for r in kept_records(df).collect()) == _greedy(rows)
    df = spark.createDataFrame([(1, None, "x"), (2, "u", None), (3, "u", "x"), (3, "u", "x")], "source long, url string, content string")
    assert [r.source for r in kept_records(df).collect()] == [3]


def test_failed_page_still_blocks_its_twin(spark):
    def read(content):
        if content == "bad":
            raise ValueError
        return document_fields(content)

    rows = spark.createDataFrame([(1, "u1", "bad"), (2, "u1", "good"), (3, "u3", "c")], "source long, url string, content string")
    index, stats = ix.index_of_pages(rows, read=read)
    assert (stats.indexed_documents, stats.skipped_documents, stats.duplicate_documents) == (1, 1, 1)
    assert [(r.doc_id, r.url) for r in index.documents.collect()] == [(0, "u3")]


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert [r.doc_id for r in with_dense_ids(df, ["k"]).orderBy("k").collect()] == list(range(1000))
    assert with_dense_ids(df.where("false"), ["k"]).count() == 0


def test_gaps_and_floors_across_partitions(spark):
    """A term that fills several range partitions, small ones between them."""
    rng = random.Random(12)
    rows = sorted({(t, rng.randrange(5000)) for t, n in (("a", 3), ("hot", 900), ("ice", 1), ("z", 40)) for _ in range(n)})
    for parts in ("1", "7", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            df = spark.createDataFrame([(t, d, 1, 0, "x") for t, d in rows], "term string, doc_id long, tf int, important_tf int, extra string")
            gapped = P.with_gaps(df)
            got = {(r.term, r.doc_id): r.gap for r in gapped.collect()}
            assert got == {(t, d): d - (rows[i - 1][1] if i and rows[i - 1][0] == t else 0) for i, (t, d) in enumerate(rows)}
            back = P.without_gaps(gapped.withColumnRenamed("doc_id", "position").select("term", "gap", "position"))
            assert all(r.doc_id == r.position for r in back.collect()) and back.count() == len(rows)
            blocks = P.packed(df, block=100)
            assert blocks.agg(F.max("n")).first()[0] <= 100
            assert sorted((r.term, r.doc_id) for r in P.unpacked(blocks, block=100).collect()) == rows
            sparse = spark.createDataFrame([("b", 0), ("hot", 256), ("m", 512)], "term string, pos long")
            probes = ["a", "b", "bb", "hot", "hou", "z", "hot"]
            floors = sorted((r.term, r.pos) for r in P.floor_positions(sparse, spark.createDataFrame([(p,) for p in probes], "term string")).collect() if r.pos is not None)
            assert floors == [("b", 0), ("bb", 0), ("hot", 256), ("hot", 256), ("hou", 256), ("z", 512)]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert P.with_gaps(spark.createDataFrame([], "term string, doc_id long")).count() == 0


def test_rerank_head_is_bounded(spark):
    n = 300
    docs = spark.createDataFrame([(i, f"https://h/{i}" + ("/rare" if i == n - 1 else ""), 1, "", "", ["rare"] if i == n - 1 else []) for i in range(n)], "doc_id long, url string, doc_len int, title string, snippet string, url_terms array<string>")
    postings = spark.createDataFrame([("rare", i, 1, 0, 1) for i in range(n)], "term string, doc_id long, tf int, important_tf int, doc_len int")
    index = Index(docs, postings, postings.groupBy("term").count().withColumnRenamed("count", "df"), n, 1.0, "surface")
    ids = [r.doc_id for r in search_batch(index, spark.createDataFrame([(1, "rare", None, None), (2, "rare", "bad", 3), (3, None, "any", 2)], "query_id long, query string, mode string, limit int")).orderBy("rank").collect()]
    assert ids == [0, 1, 2, 3, 4]  # the URL hit is outside the head of 256
    assert [r.url for r in search(spark, index, "rare").collect()] == [f"https://h/{i}" for i in range(5)]
    assert search(spark, index, "rare", limit=20).first().url == "https://h/299/rare"


def test_stems_and_fields():
    assert tokenize("IT's gardens_1998") == ["it", "s", "garden", "1998"] and tokenize("Straße") == ["strass"]
    pairs = "caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit radically radic triplicate triplic formative form electrical electr hopeful hope revival reviv allowance allow adoption adopt effective effect probate probat cease ceas controll control roll roll dying die news news".split()
    assert {a: stem(a) for a in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))
    f = document_fields("<title>Old Gardens</title><p>gardening of gardens")
    assert f.total["garden"] == 3 and f.important["garden"] == 1 and f.title == "Old Gardens"
    f = document_fields("<h1><b>x</b></h1>")
    assert (f.total["x"], f.important["x"]) == (1, 2)
    assert dict(document_fields('<script>var t="</p>"; alpha</script>beta<noscript>no</noscript>').total) == {"beta": 1}
    assert document_fields("mach<b>ine</b> caf&eacute;s").total.keys() == {"mach", "in", "café"} or "mach" in document_fields("mach<b>ine</b>").total
    assert document_fields("<title></title><h1>x</h1>").title == "" and document_fields(None).snippet == "" and document_fields("").total == {}
    assert snippet_of("a" * 400) == "a" * 320 + "…" and snippet_of("ab " * 200).endswith("ab…") and snippet_of("x") == "x"


def test_columns(spark):
    df = spark.createDataFrame([("https://h/a/New%20transfer_students/", "Straße ΣΑΣ x_1 ﬁn"), ("https://WWW.h.example:80/?q=1", ""), (None, None), ("nothing", "a")], "u string, t string")
    rows = df.select(fallback_title(F.col("u")).alias("f"), display_url(F.col("u")).alias("d"), site(F.col("u")).alias("s"), terms(F.col("t")).alias("t")).collect()
    assert rows[0].f == "New Transfer Students" and rows[0].d == "h/a/New%20transfer_students/" and rows[0].t == ["strasse", "σασ", "x", "1", "fin"]
    assert rows[1].f == "WWW.h.example:80" and rows[1].s == "h.example" and rows[1].t == []
    assert rows[2].f is None and rows[2].s is None and rows[2].t is None and rows[3].s is None


def test_percent_decoding(spark):
    rng = random.Random(14)
    texts = ["", "a+b", "%", "%zz", "%4", "%41%", "%C3%A9t%C3%A9", "%C3é", "%E6%97%A5", "100%25", None] + ["".join(rng.choice(["%", "4", "1", "C3", "A9", "E2", "82", "AC", "é", "/", "z", "%20"]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "u string")
    assert [r.u for r in df.select(unquoted(F.col("u")).alias("u")).collect()] == [None if t is None else unquote(t) for t in texts]
    assert "ArrowEvalPython" not in df.select(fallback_title(F.col("u")))._jdf.queryExecution().toString()


def test_surface_terms_of_one_text(spark):
    texts = ["Straße ΣΑΣ x_1 ﬁn İa", "ǅ ß ẞ ſ µ", "", "a-b c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.t for r in df.select(terms(F.col("t")).alias("t")).collect()] == [surface(t) for t in texts]


def test_order_statistics(spark):
    rng = random.Random(13)
    rows = [(k, rng.choice([None, round(rng.random() * 50, 1)])) for k in ("a", "b", None) for _ in range(rng.randrange(5, 60))] + [("only nulls", None), ("one", 2.5)]
    got = {r.k: r for r in order_statistics(spark.createDataFrame([(*r, 1) for r in rows], "k string, v double, _pos int"), ["k"], "v", {"p95": 0.95, "p50": 0.5}).collect()}
    for k in {r[0] for r in rows}:
        values = sorted(v for g, v in rows if g == k and v is not None)
        r = got[k]
        assert r.samples == len(values)
        if not values:
            assert (r.median, r.p95, r.p50, r.max) == (None,) * 4
            continue
        assert r.median == statistics.median(values) and r.max == values[-1]
        assert r.p95 == values[round((len(values) - 1) * 0.95)] and r.p50 == values[round((len(values) - 1) * 0.5)]
    # half to even, and no group at all
    six = spark.createDataFrame([(float(v),) for v in range(6)], "v double")
    assert order_statistics(six, [], "v", {"p": 0.5}).first().p == 2.0
    assert order_statistics(six.where("false"), [], "v", {"p": 0.5}).count() == 0
    assert latency_summary(spark.createDataFrame([(0.125,), (0.375,)], "v double"), [], "v", 2).first().max_ms == 0.38


def test_benchmark(spark, built):
    with ix.open_index(spark, built[1]) as index:
        report = benchmark(spark, index, ["violin", "nothing at all"], runs=3)
    assert report["query_count"] == 2 and report["runs_per_query"] == 3 and 0 < report["median_ms"] <= report["p95_ms"] <= report["max_ms"]
    first, second = report["queries"]
    assert (first["query"], first["result_count"], first["top_url"]) == ("violin", 5, expected("violin", "auto", 5)[0][0])
    assert (second["query"], second["result_count"], second["top_url"]) == ("nothing at all", 0, None)
    assert benchmark(spark, None, [])["max_ms"] == 0.0


def test_service(spark, built):
    index = ix.open_index(spark, built[1])
    server = create_server(spark, index, port=0, workers=2)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        want = [u for u, _, _ in expected("violin lantern", "all", 10)]
        with ThreadPoolExecutor(4) as pool:
            for body in pool.map(lambda _: json.loads(urlopen(f"{base}/api/search?q={quote('violin lantern')}&mode=all").read()), range(8)):
                assert body["count"] == len(want) and [r["url"] for r in body["results"]] == want and body["mode"] == "all"
        assert json.loads(urlopen(f"{base}/health").read())["documents"] == 31
        for path in ("/", "/search?q=violin"):
            reply = urlopen(base + path)
            assert reply.headers["Content-Type"].startswith("text/html") and reply.headers["X-Content-Type-Options"] == "nosniff" and b"<form>" in reply.read()
        for path, status in (("/api/search", 400), ("/api/search?q=x&limit=x", 400), ("/api/search?q=x&mode=bad", 400), (f"/api/search?q={'x' * 513}", 400), ("/nothing", 404)):
            with pytest.raises(HTTPError) as e:
                urlopen(base + path)
            assert e.value.code == status
        report = load_test(spark, base, ["violin", "nothing"], [2, 3], requests=4)
        assert [(r["concurrency"], r["successful"], r["errors"]) for r in report["results"]] == [(2, 2, 2), (3, 2, 2)] and report["results"][0]["throughput_qps"] > 0
    finally:
        server.shutdown()
        server.server_close()
    assert parameters("q=a&limit=0") == ("a", 1, "auto") and parameters("q=a&limit=999")[1] == 50


def test_command_line(spark, built, tmp_path, capsys, monkeypatch):
    p = parser()
    assert p.parse_args(["search", "idx", "--query", "x"]).limit == 5 and p.parse_args(["load", "u", "q", "--concurrency", "2,4"]).concurrency == [2, 4]
    for wrong in (["benchmark", "i", "q", "--runs", "0"], ["load", "u", "q", "--concurrency", "2,x"], ["load", "u", "q", "--requests", "0"], ["serve", "i", "--workers", "0"], ["search", "i", "--mode", "bad"]):
        with pytest.raises(SystemExit):
            p.parse_args(wrong)
    capsys.readouterr()
    main(["search", built[1], "--query", "violin"])
    assert expected("violin", "auto", 5)[0][0] in capsys.readouterr().out
    answers = iter(["violin", "harbour"])

    def ask(_):
        try:
            return next(answers)
        except StopIteration:
            raise EOFError from None

    monkeypatch.setattr("builtins.input", ask)
    main(["search", built[1], "--mode", "all", "--limit", "1"])
    assert capsys.readouterr().out.count("https://") == 2
    (tmp_path / "q.txt").write_text("violin\n")
    main(["benchmark", built[1], str(tmp_path / "q.txt"), "--runs", "1", "--mode", "any", "--limit", "2", "--output", str(tmp_path / "r.json")])
    assert json.loads((tmp_path / "r.json").read_text())["queries"][0]["result_count"] == 2
    (tmp_path / "none.txt").write_text("# nothing\n")
    with pytest.raises(SystemExit):
        main(["benchmark", built[1], str(tmp_path / "none.txt")])
    assert result_lines([{"rank": 1, "score": 2.5, "matched_terms": 1, "query_terms": 2, "url": "u"}], 1.234) == [" 1.    2.5000  [1/2]  u", "1.23 ms"]
    assert result_lines([], 0)[0] == "No matching documents."


def test_shared_folder():
    """A session on a cluster must name a folder that its executors share."""

    class Session:
        def __init__(self, master, folder):
            self.conf, self.sparkContext = {"spark.checkpoint.dir": folder}, self
            self.master = master

        def getCheckpointDir(self):
            return None

    assert shared_folder(Session("spark://x", "hdfs://shared")) == "hdfs://shared"
    with pytest.raises(RuntimeError):
        shared_folder(Session("spark://x", None))
