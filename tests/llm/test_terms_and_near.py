import random
from collections import Counter

import pytest

from pagewright.functions.visible import terms
from pagewright.llm import neardup
from pagewright.llm.neardup import NearDuplicates, components
from pagewright.llm.termfreq import last_seen_counts, marked_terms


def test_last_seen_counts_flush_keeps_sums():
    batch = {"content": ["a a b", None, "", "a c", "b b"]}
    for most in (1, 2, 100):
        total = Counter()
        for out in last_seen_counts(iter([batch]), most):
            for t, o, r in zip(out["term"], out["occ"], out["recs"]):
                total[t] += 1000 * o + r
        assert total == {"a": 3002, "b": 3002, "c": 1001, None: 4}


def test_marked_terms(spark, pages_of):
    rows = [(i, None, "common <b>x</b> " + ("mid" if i < 3 else "w%d" % i)) for i in range(8)] + [(9, None, None), (10, None, ""), (0, None, "common")]
    got = {r.term: (r.occurrences, r.records, list(r.marks)) for r in marked_terms(pages_of(rows)).collect()}
    assert got["common"] == (9, 9, ["common"]) and got["mid"] == (3, 3, []) and got["w5"] == (1, 1, ["rare"])
    assert marked_terms(pages_of(rows[:0])).count() == 0
    long = pages_of([(1, None, "word " * 300_000)])
    assert marked_terms(long).collect()[0].occurrences == 300_000


def _brute(rows, width, least, top, bottom):
    sets = {}
    for page_id, _, content in rows:
        w = terms(content)
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        if content is not None and page_id is not None and len(s) >= least:
            sets[page_id] = s
    ids = sorted(sets)
    return {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) * bottom >= top * len(sets[a] | sets[b])}


def test_near_duplicates_against_brute_force(spark, pages_of):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(25):
        base = [rng.choice(vocabulary) for _ in range(200)]
        rows.append((10 * i, None, " ".join(base)))
        for k, edits in enumerate((1, 3, 6, 20)):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(200)] = rng.choice(vocabulary)
            rows.append((10 * i + k + 1, None, " ".join(words)))
        rows.append((10 * i + 6, None, "<p>" + " ".join(base).upper() + "</p>"))  # equal set
    rows += [(900, None, None), (901, None, ""), (902, None, "too short"), (None, None, rows[0][2]), rows[0]]
    near = NearDuplicates(pages_of(rows), "page_id", "content", width=3, threshold=(4, 5), least=100)
    links = near.links()
    found = [(r.page_id_a, r.page_id_b) for r in near.pairs(links).collect()]
    assert len(found) == len(set(found))
    assert set(found) == _brute(rows, 3, 100, 4, 5)
    groups = {r.page_id: r for r in near.groups(links).collect()}
    assert groups[0].class_id == groups[6].class_id and groups[1].group_id == groups[0].group_id
    assert len({g.group_id for g in groups.values()}) == 25 or len({g.group_id for g in groups.values()}) > 25


def test_groups_have_every_page(spark, pages_of):
    text = " ".join(f"w{i}" for i in range(150))
    near = NearDuplicates(pages_of([(1, None, text), (2, None, text), (3, None, "too short"), (4, None, None), (5, None, ""), (3, None, "too short"), (None, None, text)]), "page_id", "content", width=3, least=100)
    assert sorted(map(tuple, near.groups(near.links()).collect())) == [(1, 1, 0, 1), (2, 1, 0, 1), (3, 3, 0, 3), (4, 4, 0, 4), (5, 5, 0, 5)]


def test_near_duplicates_of_nothing(spark, pages_of):
    near = NearDuplicates(pages_of([]), "page_id", "content")
    assert near.pairs(near.links()).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (20, 30), (30, 40), (40, 50), (50, 20), (4, 60)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 60: 1, 10: 10, 11: 10, 20: 20, 30: 20, 40: 20, 50: 20}


@pytest.mark.parametrize("pages", [1, 10**5, 10**8])
def test_recall_at_the_threshold(pages):
    """Pairs of sets at J = 0.8 exactly: nearly all meet in a variant at every size of the collection; pages that share a frame hardly do."""
    design = neardup.Design.of(pages, 0.8)

    def keys(words):
        marks = next(neardup._fingerprints(1, 1, design)(iter([{"id": [1], "content": [" ".join(words)]}])))
        return {int(k) for out in neardup._variants(design)(iter([{c: marks[c] for c in marks if c not in ("n", "k1", "k2")}])) for k in out["key"]}

    met = alike = 0
    framed = []
    for i in range(300):
        shared = [f"s{i}x{k}" for k in range(160)]
        met += bool(keys(shared + [f"a{i}x{k}" for k in range(20)]) & keys(shared + [f"b{i}x{k}" for k in range(20)]))
        framed.append(keys([f"frame{k}" for k in range(33)] + [f"own{i}x{k}" for k in range(150)]))  # J = 0.1
    alike = sum(bool(framed[i] & framed[i - 1]) for i in range(300))
    assert met >= 297 and alike <= 2


def test_design_grows_with_the_collection():
    designs = [neardup.Design.of(10**k, 0.8) for k in range(4, 12)]
    assert [d.anchors for d in designs] == [2, 2, 2, 3, 4, 5, 6, 7] and all(b.tables <= 1.4 * a.tables for a, b in zip(designs, designs[1:]))


def test_partitions_grow_with_the_shuffle(spark):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    for size, parts in ((0, usual), (100 * neardup.PARTITION_BYTES, "100")):
        with neardup.shuffle_partitions(spark, size):
            assert spark.conf.get("spark.sql.shuffle.partitions") == parts
        assert spark.conf.get("spark.sql.shuffle.partitions") == usual
