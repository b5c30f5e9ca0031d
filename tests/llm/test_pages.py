import math
import random
from collections import Counter, defaultdict

import pytest


from pagewright.functions.visible import visible_lines
from pagewright.llm import residue
from pagewright.llm import furniture as fu
from pagewright.llm.furniture import LineModel, LineReader, furniture_lines, main_content, page_furniture, places, region, snippet_has_furniture, snippet_verdicts, start
from pagewright.llm.mojibake import damage, garbled_pages, restore, restored_pages
from pagewright.llm.sitelines import chunks, letters, normalise, repeated_lines, without_lines
from pagewright.llm import stuffing
from pagewright.llm.stuffing import body_measures, curves, page_profiles, stuffing_scores

PROSE = "The committee led by the library measured five of the entries last October, and it asked the group to repeat the survey before the end of the term."
GERMAN = "Für die Prüfung müssen Sie sich bis zum März im Büro anmelden, weil die Plätze über den Sommer größtenteils vergeben wären."
RUSSIAN = "Студенты сравнили машинное обучение с методом и нашли ошибок. Каждая лекция должна содержать пример из проекта и список источников."
GREEK = "Κάθε ομάδα χρειάζεται παράδειγμα από το έργο. Μετά την μελέτη δημοσιεύθηκαν αποτελέσματα για την συνάντηση."
JAPANESE = "この講義では分散システムを扱い、例を紹介します。学生は講義の前に資料を読んでおく必要があります。"


# ---- p2

def test_repeated_lines_against_brute_force(spark, pages_of):
    rng = random.Random(1)
    common = ["© 2020 The Institute. All rights reserved.", "Call the front desk of the building: ext. %d", "short line", "<b>Share  this</b> STORY with everybody &amp; all", "ein gemeinsamer Satz über Straßen"]
    rows = []
    for i in range(60):
        lines = [f"page {i} has words {rng.random()} of its own kind here"]
        lines += [(c % rng.randrange(99) if "%d" in c else rng.choice([c, c.upper()])) for c in common if rng.random() < 0.5]
        rng.shuffle(lines)
        host = rng.choice(["http://www.A.example/x", "https://a.example:8080/y#z", "http://b.example/", None])
        rows.append((i, host, "\n".join(lines)))
    rows += [(100, "http://a.example/", None), (101, "http://a.example/", ""), (102, "no host", common[0]), rows[0], rows[0], rows[0], rows[0], rows[0]]
    pages = pages_of(rows)
    seen = defaultdict(set)
    where = defaultdict(set)
    for page_id, url, content in rows:
        if url is None or "//" not in url or content is None:
            continue
        host = "a" if "a.example" in url.lower() else "b"
        for n, line in enumerate(visible_lines(content)):
            if sum(map(str.isalpha, line)) >= 12:
                key = host, "".join(c for c in line.casefold() if not c.isspace() and not c.isdigit())
                seen[key].add(page_id)
                where[key].add((page_id, n))
    expected = {x for k, ids in seen.items() if len(ids) >= 5 for x in where[k]}
    found = repeated_lines(pages)
    assert {(r.page_id, r.line_no) for r in found.collect()} == expected and expected
    cleaned = {r.page_id: r.content for r in without_lines(pages, found).collect()}
    for page_id, _, content in rows:
        lines = [] if content is None else [x for n, x in enumerate(content.split("\n")) if (page_id, n) not in expected]
        assert cleaned[page_id] == (None if content is None else "\n".join(lines))
    assert repeated_lines(pages_of([])).count() == 0


def test_chunks_depend_on_the_line_only():
    lines = [normalise(x).encode() for x in ("some words in a line that is long enough for several chunks of text, one would hope so", "other", PROSE)]
    a, owner, anchor = chunks(lines)
    b, _, single = chunks([lines[2]])
    assert list(a[owner == 2]) == list(b) and anchor[2] == single[0] and letters("Ab1 ²é") == 3


# ---- p3

@pytest.mark.parametrize("text, wrote, read", [
    (GERMAN, "utf-8", "cp1252"), (GERMAN, "utf-8", "latin-1"), (GERMAN, "utf-8", "cp1251"), (GERMAN, "utf-8", "mac_roman"), (GERMAN, "utf-8", "cp437"), (RUSSIAN, "utf-8", "latin-1"), (RUSSIAN, "utf-8", "mac_roman"),
    (RUSSIAN, "utf-8", "cp866"), (RUSSIAN, "utf-8", "koi8_r"), (RUSSIAN, "cp1251", "latin-1"), (RUSSIAN, "koi8_r", "latin-1"), (RUSSIAN, "koi8_r", "cp1251"), (GREEK, "cp1253", "latin-1"), (GREEK, "utf-8", "latin-1"), (JAPANESE, "euc_jp", "latin-1"),
    (JAPANESE, "utf-8", "latin-1"), (GERMAN, "cp1252", "cp1251"),
])
def test_damage_is_found_and_restored(text, wrote, read):
    broken = text.encode(wrote).decode(read)
    fixed, kinds = restore(broken)
    assert kinds and damage(broken)
    assert fixed == text


def test_damage_in_places_and_twice():
    word = "café".encode().decode("cp1252")
    assert restore(f"one {word} in a sound text with ü and 日本語")[0] == "one café in a sound text with ü and 日本語"
    twice = GERMAN.encode().decode("latin-1").encode().decode("latin-1")
    assert restore(twice)[0] == GERMAN
    assert "lost characters" in damage("pr�fen")
    assert damage("fŸr die Ma§nahme")


@pytest.mark.parametrize("text", [GERMAN, RUSSIAN, GREEK, JAPANESE, GERMAN.upper(), RUSSIAN.upper(), "INSCRIÇÃO E AVALIAÇÃO: SELEÇÃO", "“Well” — it’s naïve… ÀÉÎ", "Её пёс нёс ВЕДЁТ", "", "ascii", "«Привет» №5", "µ² 😀 ½ × ÷", "Škoda Ångström ÅÄÖ", "L'été où l'élève a dû"])
def test_sound_text_stays(text):
    assert restore(text) == (text, set()) and not damage(text)


def test_garbled_pages(spark, pages_of):
    broken = GERMAN.encode().decode("cp1252")
    rows = [(1, None, f"<p>{broken}</p>"), (2, None, GERMAN), (3, None, None), (4, None, ""), (5, None, "&#195;&#188;ber &Atilde;&copy;"), (6, None, "x " * 200_000 + broken), (1, None, f"<p>{broken}</p>")]
    assert sorted(r.id for r in garbled_pages(pages_of(rows)).collect()) == [1, 1, 5, 6]
    restored = {r.id: (r.content, list(r.kinds)) for r in restored_pages(pages_of(rows)).collect()}
    assert restored[1][0] == f"<p>{GERMAN}</p>" and restored[2] == (GERMAN, []) and restored[3] == (None, []) and restored[4] == ("", []) and restored[5][0].startswith("über")
    assert garbled_pages(pages_of([])).count() == 0


# ---- p5

MENU = ["Home", "Research", "Contact", "News", "Library", "Opening hours", "Our teams", "Old films"]
#: Furniture that is on the lists, and furniture that is not.
LISTED = ["<div>Skip to main content</div>", "<p>We use cookies on this site. Accept all | Reject</p>", "<p>© 2020 The Institute. All rights reserved.</p>", "<p>Share this story: Mail | Print</p>"]
UNLISTED = ["<p>Jump past the banner of the Institute</p>", "<p>Small files help us to remember you. Fine | Rather not</p>", "<p>Built by the web crew of the Institute, build 17</p>", "<p>Tell a friend about the Institute - 3 visits today</p>", "<p>Lost? Ring the porter of the Institute, desk 4</p>"]
NOUNS = [a + b + c for a in ("sur", "lib", "ter", "gro", "com", "ent", "cou", "pap", "rea", "tab") for b in ("va", "ri", "no", "pe") for c in ("ry", "ness", "tion", "ter", "ly")]


def sentence(rng):
    a, b, c, d, e, f, g = (rng.choice(NOUNS) for _ in range(7))
    return f"The {a} of the {b} was {e}ed by the {c} before {rng.randrange(2, 30)} of the {d}s had been {f}ed and it was to {g} them."


def site_page(rng, number):
    """A page with the lines that are furniture."""
    title = f"A {rng.choice(NOUNS)} of {rng.choice(NOUNS)} {number}"
    lines, furniture = [f"<title>{title}</title>"], set()

    def put(line, is_furniture=False):
        if is_furniture:
            furniture.add(len(lines))
        lines.append(line)

    top = [x for x in LISTED[:2] + UNLISTED[:2] if rng.random() < 0.5]
    for line in top:
        put(line, True)
    for label in rng.sample(MENU, 5):
        put(f'<li><a href="/{number}">{label}</a></li>', True)
    put(f"<h1>{title}</h1>")
    put("<p>Posted on March 3, 2020 by A. Person</p>")
    for _ in range(rng.randrange(3, 7)):
        put("<p>" + " ".join(sentence(rng) for _ in range(rng.randrange(2, 5))) + "</p>")
        if rng.random() < 0.3:
            put("<h2>Methods</h2>")
    for line in rng.sample(LISTED[2:] + UNLISTED[2:], 4):
        put(line, True)
    return "\n".join(lines), sorted(furniture)


@pytest.fixture(scope="module")
def site():
    rng = random.Random(11)
    return [site_page(rng, i) for i in range(160)]


def fitted(contents, seeds=fu.SEEDS):
    reader, model = LineReader(), None
    for _ in range(2):
        seen = Counter()
        for content in contents:
            lines = LineReader()(content)
            for (_, line), place in zip(lines, places(lines, model and model.alone(lines))):
                seen[(*line.shape, place), line.words, *start(line, place, seeds)] += 1
        model = LineModel.fit([(*k, n) for k, n in seen.items()])
    return model


def agreement(model, pages):
    true = {(i, n) for i, (_, lines) in enumerate(pages) for n in lines}
    got = {(i, n) for i, (content, _) in enumerate(pages) for n in furniture_lines(model, LineReader(), content)}
    return len(true & got) / len(true), len(true & got) / max(1, len(got))


def test_furniture_is_learnt_beyond_the_lists(site):
    recall, precision = agreement(fitted([c for c, _ in site[:80]]), site[80:])
    assert recall >= 0.98 and precision >= 0.98


@pytest.mark.parametrize("kept", [range(0, len(fu.SEEDS), 2), range(1, len(fu.SEEDS), 2), []])
def test_half_of_the_lists_or_none(site, kept, monkeypatch):
    """The lists only start the fitting: with half of them, or none, the region teaches enough."""
    for name in ("NAVIGATION", "SIDEBARS"):
        monkeypatch.setattr(fu, name, frozenset(sorted(getattr(fu, name))[:: 2 if kept else 10_000]))
    recall, precision = agreement(fitted([c for c, _ in site[:80]], tuple(fu.SEEDS[i] for i in kept)), site[80:])
    assert recall >= 0.9 and precision >= 0.9


def test_without_the_region_most_is_lost(site, monkeypatch):
    with_region = fitted([c for c, _ in site[:80]])
    lines = {i: furniture_lines(with_region, LineReader(), c) for i, (c, _) in enumerate(site)}
    monkeypatch.setattr(fu, "region", lambda lines, odds=None: (0, -1))
    without = fitted([c for c, _ in site[:80]])
    assert sum(lines[i] != furniture_lines(without, LineReader(), c) for i, (c, _) in enumerate(site)) > len(site) / 2


def test_region_spans_the_paragraphs(site):
    content, _ = site[0]
    lines = LineReader()(content)
    first, last = region(lines)
    assert all(line.first == "p" for _, line in (lines[first], lines[last])) and lines[first][0] > content.split("\n").index(next(x for x in content.split("\n") if x.startswith("<h1>")))
    assert region([]) == (0, -1)


def test_lines_of_any_length_are_judged(site):
    model = fitted([c for c, _ in site[:80]])
    body = "\n".join(f"<p>{sentence(random.Random(i))} {sentence(random.Random(i + 50))}</p>" for i in range(5))
    footer = "<p>" + " ".join(x[3:-4] for x in LISTED[2:] + UNLISTED[2:]) * 3 + "</p>"
    menu = "<ul>" + "".join(f'<li><a href="/x">{x}</a></li>' for x in MENU * 5) + "</ul>"
    assert len(footer) > 400 and len(menu) > 400
    assert furniture_lines(model, LineReader(), f"{body}\n{footer}") == [5]
    assert furniture_lines(model, LineReader(), f"{menu}\n{body}") == [0]
    assert furniture_lines(model, LineReader(), "<p>" + sentence(random.Random(1)) * 4000 + "</p>") == []


def test_furniture_tables(spark, pages_of, site):
    rows = [(i, None, c) for i, (c, _) in enumerate(site)] + [(901, None, None), (902, None, ""), (903, None, "x" * 1_000_000), (0, None, site[0][0])]
    pages = pages_of(rows)
    model = fu.fit_lines(pages)
    again = fu.fit_lines(pages.repartition(5))
    assert model.odds.keys() == again.odds.keys() and all(abs(model.odds[x] - again.odds[x]) < 1e-9 for x in model.odds)
    assert page_furniture(pages, model).where("id = 0").count() == 2 * len(site[0][1])
    main = {r.id: r.content for r in main_content(pages, model).collect()}
    kept = [x for i, x in enumerate(site[1][0].split("\n")) if i not in site[1][1]]
    assert main[1] == "\n".join(kept) and main[901] is None and main[902] == "" and len(main[903]) == 1_000_000
    clean = sentence(random.Random(3))
    results = spark.createDataFrame([(1, "Home Research Contact News " + clean), (2, clean), (3, None), (4, ""), (5, f"{clean} Built by the web crew of the Institute, build 17")], "result_id long, snippet string")
    assert {r.id: r.dirty for r in snippet_verdicts(results, model).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    empty = fu.fit_lines(pages_of([]))
    assert page_furniture(pages_of(rows[:3]), empty).count() == 0 and not snippet_has_furniture(empty, "Skip to main content")


# ---- p1

#: Nothing is furniture.
PLAIN = LineModel({}, 0.0)


def prose(rng, n):
    return "\n".join(" ".join(sentence(rng) for _ in range(2)) for _ in range(n))


def spam_rows():
    rng = random.Random(2)
    spam = "\n".join(" ".join(f"{rng.choice(['buy', 'cheap', 'best', 'free'])} {rng.choice(['sofa', 'watch', 'laptop'])} zoran" for _ in range(20)) for _ in range(4))
    links = "\n".join(f"http://shop{i}.example/cheap/sofa/item{i}.html" for i in range(25))
    tags = "\n".join(" ".join(f"#cheapsofa{chr(97 + i)}{chr(97 + k)}" for k in range(6)) for i in range(10))
    listing = "\n".join(f"- Person {i}, room {i}, {rng.choice(NOUNS)} on the {rng.choice(NOUNS)} of {rng.choice(NOUNS)} with the {rng.choice(NOUNS)} of {rng.choice(NOUNS)}" for i in range(25))
    filler = "\n".join("lorem ipsum dolor parum sunt quorum fessi gravia " * 5 for _ in range(4))
    sofa = "\n".join("Cheap sofa from the shop is the cheap sofa that you want when you want a cheap sofa. With a cheap sofa from the shop, cheap sofa and best sofa deals are yours." for _ in range(9))
    single = "\n".join(rng.choice(["sofa", "cheap", "watch", "laptop", "deal"]) for _ in range(80))
    rows = [(100 + i, None, f"Page {i}\n" + prose(rng, 3 + i % 6)) for i in range(60)]
    rows += [(1, None, spam), (2, None, links), (3, None, tags), (4, None, f"{spam}\n{sentence(rng)}"), (5, None, sofa), (6, None, single)]
    rows += [(10, None, listing), (11, None, filler), (12, None, None), (13, None, ""), (14, None, "cheap sofa"), (15, None, RUSSIAN * 3), (16, None, JAPANESE * 6)]
    rows += [(17, None, (RUSSIAN * 3).encode().decode("latin-1")), (18, None, f"{prose(rng, 4)}\n{tags[:200]}")]
    return rows


def test_stuffed_pages(spark, pages_of):
    pages = pages_of(spam_rows())
    profiles = page_profiles(pages, PLAIN)
    assert {r.id for r in stuffing_scores(profiles).where("stuffed").collect()} == {1, 2, 3, 4, 5, 6}
    assert stuffing_scores(page_profiles(pages_of([]), PLAIN)).count() == 0


def test_stuffed_pages_within_furniture(spark, pages_of, site):
    """Promotion in place of the paragraphs of a page with menus and footers, which are learnt from the same pages."""
    rows = [(1000 + i, None, c) for i, (c, _) in enumerate(site)]
    for number, _, content in spam_rows():
        if number < 10:
            lines = site[number][0].split("\n")
            first = next(i for i, x in enumerate(lines) if x.startswith("<h1>"))
            kept = [x for i, x in enumerate(lines) if i <= first or i in site[number][1]]
            rows.append((number, None, "\n".join(kept[: first + 1] + [f"<p>{x}</p>" for x in content.split("\n")] + kept[first + 1 :])))
    pages = pages_of(rows)
    assert {r.id for r in stuffing_scores(page_profiles(pages, fu.fit_lines(pages))).where("stuffed").collect()} == {1, 2, 3, 4, 5, 6}


def test_the_curves_decide(spark, pages_of, monkeypatch):
    """Each measure admits pages by itself: without divergence the steep curve is left, and not the lists."""
    profiles = page_profiles(pages_of(spam_rows()), PLAIN)

    def found():
        return {r.id for r in stuffing_scores(profiles).where("stuffed").collect()}

    monkeypatch.setattr(stuffing, "RESIDUAL", 1e9)
    monkeypatch.setattr(stuffing, "STEEP", 1e9)
    assert found() >= {1, 2, 3, 4, 6}
    monkeypatch.undo()
    monkeypatch.setattr(stuffing, "DIVERGENCE", 1e9)
    assert 5 in found() and 3 not in found()


def test_curve_of_a_page_against_plain_python(spark):
    spectrum = [(9, 1), (4, 2), (2, 3), (1, 10)]
    row = spark.createDataFrame([(1, [{"tf": tf, "n": n} for tf, n in spectrum]), (2, []), (3, [{"tf": 1, "n": 5}])], "id long, spectrum array<struct<tf: int, n: int>>")
    got = {r.id: r for r in curves(row).collect()}
    points, rank = [], 0
    for tf, n in spectrum:
        points += [(math.log(rank + (n + 1) / 2), math.log(tf))] * n
        rank += n
    mx, my = (sum(p[k] for p in points) / len(points) for k in (0, 1))
    slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
    residual = math.sqrt(sum((y - my - slope * (x - mx)) ** 2 for x, y in points) / len(points))
    assert abs(got[1].slope - slope) < 1e-9 and abs(got[1].residual - residual) < 1e-9
    assert 2 not in got and got[3].slope == 0 and got[3].residual == 0


def test_body_measures():
    lang, words, heads, own = body_measures(["The survey of the library", "and 2 of the surveys"])
    assert lang == "en" and words == 10 and heads == {"the": 3, "of": 2, "and": 1} and own == {"survey": 1, "library": 1, "surveys": 1}
    assert body_measures([JAPANESE])[0] == "ja" and body_measures([RUSSIAN.encode().decode("latin-1")])[0] == "ru" and body_measures([]) == ("-", 0.0, {}, {})


# ---- p7

def test_residue(spark, pages_of):
    page = "<title>{}</title>\n<h1>{}</h1>\n<p>{}</p>\n<p>" + PROSE + "</p>"
    rng = random.Random(3)
    rows = [(100 + i, None, page.format(f"Report {i} on surveys", f"Report {i} on surveys", prose(rng, 2).replace("\n", "</p>\n<p>"))) for i in range(120)]
    rows += [
        (1, None, page.format("Untitled Document", "x y", PROSE)), (2, None, page.format("404 Not Found", "x y", PROSE)), (3, None, page.format("Fine", "Fine", "The {{ dept }} opens at nine.")), (4, None, page.format("Fine", "Fine", "Welcome %%name%% to the library.")),
        (5, None, "<title>Surveys</title>\n<p>Please turn on JavaScript to view abc-def.</p>"), (6, None, "<title>Surveys</title>\n<p>Lorem ipsum dolor sit amet lorem ipsum parum sunt</p>"), (7, None, "<title>Surveys</title>\n<p>500 Internal error while rendering abc-def: please try again later.</p>"),
        (20, None, page.format("Denied? A Lock of surveys", "A Lock of surveys", PROSE)), (21, None, page.format("Fine", "Fine", "In this template language a variable stands between braces.</p>\n<pre><code>Hello {{ name }}</code></pre>\n<p>It ends.")),
        (22, None, "<noscript>Please enable JavaScript.</noscript>\n" + page.format("Fine", "Fine", PROSE)), (23, None, None), (24, None, ""), (25, None, page.format("Fine", "Fine", "A server answers 404 Not Found when the paper is missing, and the students of the course write a handler for it.")),
        (8, None, page.format("Fine", "Fine", "{{ " + "a long filter of a long template " * 20 + "}}")),
    ]
    pages = pages_of(rows)
    model = residue.fit(pages, PLAIN)
    assert {r.id for r in residue.residue_pages(pages, PLAIN, model).collect()} == {1, 2, 3, 4, 5, 6, 7, 8}
    results = spark.createDataFrame([(1, "Untitled"), (2, "${title}"), (3, "Report 3 on surveys"), (4, None), (5, ""), (6, "New Page 12")], "result_id long, title string")
    assert {r.id for r in residue.residue_titles(results, model).collect()} == {1, 2, 6}
    empty = pages_of([])
    assert residue.residue_pages(empty, PLAIN, residue.fit(empty, PLAIN)).count() == 0


def rows_of(positive, negative):
    """Rows for fitting: (kind, text) of either class."""
    return [(tuple(residue.features(t, k)), True, 2) for k, t in positive] + [(tuple(residue.features(t, k)), False, 1) for k, t in negative]


def passage(text, kind="b"):
    return residue.Passage(kind, text, False)


def test_the_model_decides_and_not_the_lists():
    """Wordings that are on no list are found by the words they share with trusted ones; with no model nothing is."""
    rng = random.Random(4)
    unlabelled = [prose(rng, 1) for _ in range(300)]
    model = residue.Model.fit(rows_of([("b", x) for x in residue.NOTICES], [("b", x) for x in unlabelled]))
    new = ["This page is limited to members, please log in again", "Please try later, the server is down, the session expired", "Please turn scripts on, JavaScript is required", "Fatal fault: cannot connect to the database"]
    off = residue.Model({}, -50.0, 0.0)
    for text in new:
        assert not any(n in residue._flat(text) for n in residue.NOTICES)
        found = [passage(text)]
        assert residue.is_residue(model, found) and not residue.is_residue(off, found), text
    assert not any(residue.is_residue(model, [passage(prose(rng, 2))]) for _ in range(100))


def test_held_out_passages_are_told_apart():
    """Trained on half of the wordings, the classifier still tells most of the others from prose."""
    rng = random.Random(4)
    notices = list(residue.NOTICES)
    rng.shuffle(notices)
    half = len(notices) // 2
    prosaic = [" ".join(rng.sample(PROSE.split(), 14)) for _ in range(400)]
    model = residue.Model.fit(rows_of([("b", x) for x in notices[:half]], [("b", x) for x in prosaic[:200]]))
    assert sum(model.posterior(residue.features(x, "b")) < 0.5 for x in prosaic[200:]) >= 190
    assert sum(model.posterior(residue.features(x, "b")) >= 0.5 for x in notices[half:]) >= 0.6 * (len(notices) - half)


def test_all_words_of_a_long_passage_count():
    rng = random.Random(5)

    def words(n):
        return " ".join(rng.choice(PROSE.casefold().split()) for _ in range(n))

    model = residue.Model.fit(rows_of([("b", x) for x in residue.NOTICES], [("b", words(30)) for _ in range(200)]))
    error = "the page could not be found on this server please try again later or enable javascript and reload it " * 8
    for text, residual in ((words(65) + " " + error, True), (error[:380] + words(200), False), (words(300), False), (error, True)):
        assert len(text) > 160 and residue.is_residue(model, [passage(text)]) == residual
    cut = residue.windows(passage(words(1000)))
    assert sum(map(len, cut)) == 1000 + 2 * len(cut) and max(map(len, cut)) <= residue.WINDOW + 2


def test_placeholders_in_furniture_and_notes_and_first_headings(site):
    page = "<title>{}</title>\n<h2>{}</h2>\n<p>" + PROSE + "</p>\n<h2>{}</h2>\n<p>" + PROSE + "</p>\n{}"
    model = residue.Model.fit(rows_of([("t", x) for x in residue.TITLES], [(k, x) for x, k in (("Fine", "t"), (PROSE, "b")) for _ in range(50)]))
    reader = LineReader()
    lines = fitted([c for c, _ in site[:80]])
    for rest, residual in (
        (("Fine", "Fine", "Fine", "<p>Posted on {{ date }} by {{ author }}</p>"), True), (("Fine", "Fine", "Fine", "<p>© {{ year }} The Institute. All rights reserved.</p>"), True),
        (("Fine", "Page not found", "Fine", ""), True), (("Fine", "Fine", "Page not found", ""), False), (("Fine", "Fine", "Fine", "<p>Posted on March 3 by A. Person</p>\n<p>© 2020 The Institute. All rights reserved.</p>"), False),
    ):
        assert residue.is_residue(model, residue.passages(lines, reader, page.format(*rest))) == residual, rest


def test_titles_of_every_length():
    rng = random.Random(6)
    genuine = [" ".join(rng.sample(PROSE.split(), n)) for n in (4, 6, 9, 12, 16) for _ in range(40)]
    model = residue.Model.fit(rows_of([("t", x) for x in residue.TITLES], [("t", x) for x in genuine]))
    name = "Department of Comparative Literature and Applied Linguistics of the Institute"
    for title in (f"Page not found | {name}", f"Access denied | {name}", f"404 page not found - {name}"):
        assert len(title) > 60 and residue.is_residue_title(model, title), title
    assert not any(residue.is_residue_title(model, x) for x in genuine)


def test_bounded_sample_is_repeatable(spark, pages_of, monkeypatch):
    monkeypatch.setattr(residue, "SAMPLE_PASSAGES", 60)
    rng = random.Random(7)
    pages = pages_of([(i, None, "\n".join(" ".join(rng.sample(PROSE.split(), 12)) for _ in range(6))) for i in range(80)])
    models = [residue.fit(x, PLAIN) for x in (pages.coalesce(1), pages.repartition(7), pages.orderBy(pages.page_id.desc()))]
    assert models[0].odds == models[1].odds == models[2].odds and models[0].prior == models[1].prior
