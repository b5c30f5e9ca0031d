import random

import pytest

from pagewright.llm.lookalike import consistent_forms, plain, reading_keys, same_reading_pairs
from pagewright.llm.mixing import mixture, shares, sized_texts
from pagewright.llm.tokenizer import PIECE, decode, decoded, encode, encoding, pieces, with_ids

RNG = random.Random(7)


@pytest.fixture(scope="module")
def documents(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, tokens long, ids string")

    return make


# ---- p8

def test_ids(spark, documents):
    texts = [None, "", " ", "Hello  world\n\n it's", "<|endoftext|> is ordinary", "日本語 🎉 é", "a" * 120_000, "word " * 60_000, " \n" * 60_000]
    got = {r.doc_id: r.ids for r in with_ids(documents([(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert got[0] is None and got[1] == []
    for i in range(2, 6):
        assert got[i] == encoding().encode_ordinary(texts[i])
    assert got[7] == encoding().encode_ordinary(texts[7])
    assert all(decode(got[i]) == t for i, t in enumerate(texts) if t is not None)
    back = {r.doc_id: r.text for r in decoded(with_ids(documents([(i, t, None) for i, t in enumerate(texts[:6])]))).collect()}
    assert back == dict(enumerate(texts[:6]))
    assert with_ids(documents([])).count() == 0


def test_cuts_are_safe():
    alphabet = ["a", "b", " ", "  ", "\n", "\t ", "1", "!", "'s", "é", " ", "日", " x", " "]
    for _ in range(200):
        text = "".join(RNG.choice(alphabet) for _ in range(80))
        parts = pieces(text, 10)
        assert "".join(parts) == text
        assert [i for p in parts for i in encoding().encode_ordinary(p)] == encoding().encode_ordinary(text)
    assert pieces("x" * (2 * PIECE)) == ["x" * (2 * PIECE)] and encode(None) is None


# ---- p9

def test_mixture_reaches_its_shares(spark, documents):
    rows = [(i, f"text {i} " + "some more words " * RNG.randrange(1, 30), "Web ") for i in range(1500)] + [(5000 + i, f"note {i} " + "and so on " * RNG.randrange(1, 9), "notes") for i in range(200)]
    rows += [(9001, "text 0 twin", None), (9002, None, "web"), (9003, " ", "web"), (9004, "alone", "other"), (9005, rows[3][1], "notes"), rows[0]]
    targets = spark.createDataFrame([("web", 0.7, 1), ("notes", 0.25, 4), ("nothing", 0.05, 2)], "source string, target_share double, max_repeats int")
    texts = sized_texts(documents(rows))
    assert texts.count() == 1701
    mixed = mixture(texts, targets)
    used = mixed.collect()
    assert len({r.doc_id for r in used}) == len(used) and {r.source for r in used} == {"web", "notes"}
    assert max(r.copies for r in used if r.source == "web") <= 1 and max(r.copies for r in used if r.source == "notes") <= 4
    got = {r.source: r for r in shares(mixed, targets).collect()}
    assert abs(got["web"].share - 0.7 / 0.95) < 0.005 and abs(got["notes"].share - 0.25 / 0.95) < 0.005 and got["nothing"].share == 0.0
    assert {(r.doc_id, r.copies) for r in mixture(texts, targets).collect()} == {(r.doc_id, r.copies) for r in used}
    # a size that notes can't fill: every text as often as allowed, and the share reached says so
    capped = mixture(texts, targets, size=10.0 * sum(r.tokens for r in texts.collect()))
    assert all(r.copies == (4 if r.source == "notes" else 1) for r in capped.collect())
    assert mixture(sized_texts(documents([])), targets).count() == 0


def test_larger_texts_are_drawn_more_often(spark, documents):
    rows = [(i, f"{i} " + "word " * (5 if i % 2 else 50), "s") for i in range(2000)] + [(9999, "a b c d e f g h", "t")]
    targets = spark.createDataFrame([("s", 0.5, 1), ("t", 0.5, 1000)], "source string, target_share double, max_repeats int")
    used = [r for r in mixture(sized_texts(documents(rows)), targets, size=20_000.0).collect() if r.source == "s"]
    long = sum(r.tokens > 30 for r in used)
    assert long > 5 * (len(used) - long) and abs(sum(r.tokens for r in used) - 10_000) < 60


def test_certain_texts_and_a_fine_edge(spark, documents, monkeypatch):
    """A text larger than its share of the budget is certain; with few bins the edge is still found exactly."""
    from pagewright.llm import mixing

    rows = [(1, "word " * 4000, "s")] + [(10 + i, f"{i} " + "word " * 20, "s") for i in range(600)] + [(9999, "a b c d e f g h", "t")]
    targets = spark.createDataFrame([("s", 0.5, 1), ("t", 0.5, 100_000)], "source string, target_share double, max_repeats int")
    texts = sized_texts(documents(rows))
    used = {r.doc_id: r for r in mixture(texts, targets, size=16_000.0).collect() if r.source == "s"}
    assert 1 in used and abs(sum(r.tokens for r in used.values()) - 8_000) < 60
    monkeypatch.setattr(mixing, "BINS", 8)
    coarse = {r.doc_id for r in mixture(texts, targets, size=16_000.0).collect() if r.source == "s"}
    assert coarse == used.keys()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert {r.doc_id for r in mixture(texts, targets, size=16_000.0).collect() if r.source == "s"} == used.keys()


# ---- p10

def test_plain_form():
    assert plain("Ｆｕｌｌ　ｗｉｄｔｈ  ﬁx co­op​ é a‐b c‑d K Å") == "Full width fix coop é a-b c-d K Å"
    assert plain("x² ① ᵃ é — …") == "x² ① ᵃ é — …" and plain(" \n ") == "" and plain("👩‍🔬") == "👩‍🔬" and plain("a‍b") == "ab"


def test_same_reading(spark, documents):
    base = "The paper on search was read by the group, Soren said"
    russian = "Новая работа о сетях"
    rows = [
        (1, base, None), (2, base.replace("paper", "рареr"), None), (3, base.replace(" on ", " on\n"), None), (4, base.replace("search", "ｓｅａｒｃｈ"), None), (5, base.replace("group", "gro​up"), None), (6, base, None),
        (7, base.replace("a", "а").replace("Soren", "Ѕоrеn"), None), (8, base.replace("read", "réad"), None), (9, base.upper(), None), (10, base.replace("paper", "paрer").replace("group", "grоup"), None),
        (20, russian, None), (21, russian.replace("о", "o"), None), (22, russian + "!", None), (30, "l0 and I", None), (31, "lO and l", None), (40, "résumé", None), (41, "résumé", None), (42, "resume", None),
        (50, None, None), (51, "", None), (52, " ", None), (53, " ", None), (54, "x2", None), (55, "x²", None), (60, "a " * 100_000 + "е", None), (61, "a " * 100_000 + "e", None), (1, base, None),
    ]
    forms = consistent_forms(documents(rows))
    pairs = sorted((r.doc_id_a, r.doc_id_b) for r in same_reading_pairs(reading_keys(documents(rows))).collect())
    group = [1, 2, 3, 4, 5, 6, 7, 10]
    expected = {(a, b) for a in group for b in group if a < b} - {(1, 6)} | {(20, 21), (40, 41), (60, 61)}
    assert set(pairs) == expected and len(pairs) == len(expected)
    got = {r.doc_id: r.form for r in forms.collect()}
    assert got[2] == got[7] == got[10] == base and got[21] == russian and got[50] is None and got[52] == ""
    assert same_reading_pairs(reading_keys(documents([]))).count() == 0
