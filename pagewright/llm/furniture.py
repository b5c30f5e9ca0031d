"""Page furniture and main content.

Each line of a page is fed to the standard library's HTML parser as a stream of
events; the text-to-tag ratio of the line (text characters per tag event) is
smoothed with a Gaussian over its neighbours, and two-means clustering of the
smoothed ratios sets the page's threshold.  The lines from the first to the last
one above it are the content region.

The region alone can't tell a byline at its rim from a cookie notice beside it, so
it teaches: a naive Bayes classifier of lines is fitted by expectation-maximization
on a bounded sample, where lines of the region, headings and notes about an article
start as content, lines that say a public phrase of furniture (``SEEDS`` and the
forms below) start as furniture, and all others are open and start from their place
outside the region.  Its features are the place against the region, the shape of
the line (first tag, length, ratio, separators, end) and the words of its skeleton.
Every line of every page is then settled by its posterior, together with those of
its neighbours, smoothed by the same Gaussian.  The phrases are never asked at that
point: a wording that is on no list is learnt from where it stands.

Words are compared on a skeleton of the line (casefolded, digits as ``#``, any run
of characters outside ASCII as ``~``, words of such letters only as ``^``), so text
with damaged characters still matches.

Defined cases: null and empty contents have no lines; a line without letter or
digit is no furniture; lines of any length are judged alike; repeated rows are
judged alike; a table without usable lines gives a model that finds nothing.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.visible import TAG, strip_markup
from pagewright.session import cut, map_columns

#: Bounds of the sample that the classifier is fitted on: records, and different lines of them.
SAMPLE_PAGES, SAMPLE_LINES = 4_000, 120_000
#: Rounds of expectation-maximization, start of open lines, smoothing, weights of shape and neighbours.
ROUNDS, OPEN_OUT, OPEN_IN, SMOOTH, SHAPE, BESIDE = 4, 0.8, 0.2, 0.5, 0.7, 0.15

_HIGH = re.compile(r"[^\x00-\x7f]+")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\s|/>·•,.:;!?\"()\[\]]+")
_HEADINGS = ("title", "h1", "h2", "h3", "h4", "h5", "h6")


def skeleton(text: str) -> str:
    text = _DIGITS.sub("#", text.casefold())
    if text.isascii():
        return text
    words = text.split()
    # a word of such letters only ("à") must not look like a separator
    return " ".join(w if w.isascii() else "^" if w.isalpha() and _HIGH.fullmatch(w) else _HIGH.sub("~", w) for w in words)


def _sk(words: str) -> frozenset[str]:
    return frozenset(skeleton(w) for w in words.split(","))


#: Usual labels of navigation menus (English, Spanish, German, French, Portuguese).
NAVIGATION = _sk(
    "Home,About,About us,Contact,Contact us,News,Events,Calendar,Help,Library,Research,People,Admissions,Careers,Jobs,Directory,Courses,Search,Sign in,Log in,Login,Register,Sitemap,FAQ,Blog,"
    "Services,Products,Privacy,Terms,Feedback,Menu,Next,Previous,Back,Inicio,Contacto,Noticias,Biblioteca,Ayuda,Buscar,Startseite,Aktuelles,Kontakt,Hilfe,Suche,Accueil,Actualités,Bibliothèque,Recherche,Aide,"
    "Início,Contato,Notícias,Pesquisa,Ajuda"
)
#: Usual headings of sidebars.
SIDEBARS = _sk("See also,Related pages,Related articles,Related links,Recent posts,Recent comments,Quick links,Most read,Popular now,In this section,Categories,Archives,Latest news")
#: Usual phrases of furniture, on skeletons.
SEEDS = (
    "all rights reserved", "alle rechte vorbehalten", "todos los derechos reservados", "todos os direitos reservados", "tous droits r~serv~s", "skip to content", "skip to main content", "jump to navigation", "toggle navigation",
    "search this site", "zum inhalt springen", "ir al contenido", "aller au contenu", "we use cookies", "uses cookies", "verwendet cookies", "utiliza cookies", "utilise des cookies", "accept all", "accept cookies", "we value your privacy",
    "privacy policy", "terms of use", "legal notice", "impressum", "aviso legal", "mentions l~gales", "share this", "newsletter", "subscribe to", "sign in with", "log in or register", "equal opportunity", "page maintained by", "last updated by",
)
_LABELLED = re.compile(r"^\W*(?:tags|related|read next|see also|categories|filed under|schlagw~rter|etiquetas|mots-cl~s) ?: ")
_PAGING = re.compile(r"^\W*(?:previous|prev|next|older|newer|zur~ck|weiter|anterior|siguiente|pr~c~dent|suivant) ?[:|] ?\S")
_SEPARATOR = re.compile(r"(?:^| )(?:[|/>~*\-]|::)(?= |$)")
_CRUMB = re.compile(r" (?:>|/|~|\|) ")
#: How bylines and notes about an article begin, on skeletons; these belong to the content.
NOTES = re.compile(
    r"^(?:posted on|published on|written by|updated on|by [^|]{2,60} \| #|[^,.]{2,60}, staff writer|views in this article|reprinted with|questions about this text|this notice was issued|ver~ffentlicht am|publi~ le|publicado el)"
)
_NAV_WORDS = max(len(x.split()) for x in NAVIGATION)


def _nav_cover(words: list[str]) -> int:
    """The number of navigation labels that the words are made of without rest, or 0."""
    i = n = 0
    while i < len(words):
        for size in range(min(_NAV_WORDS, len(words) - i), 0, -1):
            if " ".join(words[i : i + size]) in NAVIGATION:
                i, n = i + size, n + 1
                break
        else:
            return 0
    return n


def seed(s: str, seeds: tuple[str, ...] = SEEDS) -> int:
    """What a skeleton says before anything is learnt: 2 furniture, 1 a lone navigation label, 0 nothing."""
    if s.strip("*- ") in SIDEBARS or any(p in s for p in seeds) or _LABELLED.match(s) or _PAGING.match(s):
        return 2
    n = _nav_cover(_SEPARATOR.sub(" ", s).split())
    if n:
        return min(n, 2)
    parts = [p.strip() for p in _CRUMB.split(s) if p.strip()]
    return 2 if len(parts) >= 2 and all(p in NAVIGATION for p in parts[:-1]) else 0


class _Events(HTMLParser):
    """What the parser's events say of the tags of a line: their number, the first one, and whether the line shows code."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.begin()

    def begin(self) -> None:
        self.reset()
        self.tags, self.first, self.code = 0, "", False

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if not self.first and tag not in ("br", "hr", "script", "style", "noscript"):
            self.first = tag
        self.code |= tag in ("pre", "code")

    def handle_endtag(self, tag):
        self.tags += 1


class Line:
    """A line with what doesn't depend on its page."""

    __slots__ = ("text", "skeleton", "ratio", "first", "code", "shows", "shape", "words", "odds")

    def __init__(self, visible: str, events: tuple[int, str, bool]):
        self.text = text = " ".join(visible.split())
        tags, self.first, self.code = events
        self.ratio = len(text) / max(1, tags)
        self.shows = any(map(str.isalnum, text))
        s = self.skeleton = skeleton(text) if self.shows else ""
        found = _WORD.findall(s)
        self.words = tuple(dict.fromkeys(found))
        end = s.rstrip("\"') ")[-1:]
        self.shape = (
            f"tag={self.first}", f"size={min(8, len(found).bit_length())}", f"ratio={int(min(self.ratio, 4000.0)).bit_length()}", "end=." if end in (".", "!", "?") else "end=", f"parts={min(3, sum(map(s.count, '|/>~')))}",
        )
        #: weight of evidence of shape and words under a model, once it was asked for
        self.odds: float | None = None


#: Lines of less characters are kept: furniture repeats.
LONG = 200


class LineReader:
    """Lines of a page, with the lines of earlier pages and the events of their tags kept."""

    def __init__(self, keep: int = 60_000):
        self.parser, self.keep = _Events(), keep
        self.known: dict[str, Line] = {}
        self.events: dict[str, tuple[int, str, bool]] = {"": (0, "", False)}

    def _parsed(self, raw: str) -> tuple[int, str, bool]:
        """The parser's events for the tags of a line; the text between them makes none."""
        tags = "".join(TAG.findall(raw)) if "<" in raw else ""
        found = self.events.get(tags)
        if found is None:
            self.parser.begin()
            self.parser.feed(tags)
            self.parser.close()
            found = self.events[tags] = self.parser.tags, self.parser.first, self.parser.code
        return found

    def __call__(self, content: str | None) -> list[tuple[int, Line]]:
        """``(line number, line)`` of the lines that show a letter or digit."""
        if not content:
            return []
        for kept in (self.known, self.events):
            if len(kept) > self.keep:
                kept.clear()
        out = []
        stripped = strip_markup(content).split("\n")
        for number, (raw, shown) in enumerate(zip(content.split("\n"), stripped)):
            line = self.known.get(raw)
            if line is None:
                line = Line(html.unescape(shown) if "&" in shown else shown, self._parsed(raw))
                if len(raw) < LONG:
                    self.known[raw] = line
            if line.shows:
                out.append((number, line))
        return out


_KERNEL = [math.exp(-(k * k) / 2) for k in range(-2, 3)]


def smoothed(values: list[float], own: bool = True) -> list[float]:
    """Gaussian average of each value and its two neighbours on either side (or of the neighbours only)."""
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for k, w in enumerate(_KERNEL):
            j = i + k - 2
            if 0 <= j < n and (own or j != i):
                total += w * values[j]
                weight += w
        out.append(total / weight if weight else 0.0)
    return out


def region(lines: list[tuple[int, Line]], odds: list[float] | None = None) -> tuple[int, int]:
    """First and last position (inclusive) of the content region; (0, -1) if there is none.
    With log-odds of furniture each ratio counts by the probability that its line is content."""
    if not lines:
        return 0, -1
    raw = [line.ratio for _, line in lines]
    if odds:
        raw = [x / (1 + math.exp(max(-30.0, min(30.0, z)))) for x, z in zip(raw, odds)]
    smooth = smoothed(raw)
    low, high = min(smooth), max(smooth)
    if low == high:  # nothing stands out, so nothing is outside
        return 0, len(lines) - 1
    for _ in range(20):
        middle = (low + high) / 2
        a = [x for x in smooth if x <= middle]
        b = [x for x in smooth if x > middle]
        if not b:
            break
        new = sum(a) / len(a), sum(b) / len(b)
        if new == (low, high):
            break
        low, high = new
    inside = [i for i, x in enumerate(smooth) if x > (low + high) / 2 and raw[i] > low]
    return (inside[0], inside[-1]) if inside else (0, -1)


def places(lines: list[tuple[int, Line]], odds: list[float] | None = None) -> list[str]:
    """Where each line stands: before, in or after the content region, right beside it (1) or not, or on a page without one."""
    first, last = region(lines, odds)
    if last < first:
        return ["place=n"] * len(lines)
    return ["place=r" if first <= i <= last else f"place=b{int(i == first - 1)}" if i < first else f"place=a{int(i == last + 1)}" for i in range(len(lines))]


class LineModel:
    """Weights of evidence that a line is furniture."""

    def __init__(self, odds: dict[str, float], prior: float):
        self.odds, self.prior = odds, prior

    def evidence(self, shape: Iterable[str], words: tuple[str, ...]) -> float:
        """Shape counts in full; words stand together in a line, so their sum is damped by the root of their number."""
        known, none = self.odds.get, repeat(0.0)
        return SHAPE * sum(map(known, shape, none)) + sum(map(known, words, none)) / math.sqrt(max(1, len(words)))

    def wording(self, line: Line) -> float:
        """Evidence of a line's words only."""
        return self.evidence((), line.words)

    def alone(self, lines: list[tuple[int, Line]]) -> list[float]:
        """Log-odds of each line, wherever it stands."""
        out = []
        for _, line in lines:
            if line.odds is None:
                line.odds = self.prior + self.evidence(line.shape, line.words)
            out.append(line.odds)
        return out

    def judge(self, lines: list[tuple[int, Line]]) -> list[bool]:
        """For each line whether it is furniture only; titles and headings never are."""
        if not self.odds:
            return [False] * len(lines)
        alone = self.alone(lines)
        stands = places(lines, alone)
        scores = [max(-12.0, min(12.0, z + SHAPE * self.odds.get(place, 0.0))) for z, place in zip(alone, stands)]
        # inside the region neighbours can only speak for content
        return [
            line.first not in _HEADINGS and own + BESIDE * (min(0.0, near) if place == "place=r" else near) > 0
            for (_, line), own, near, place in zip(lines, scores, smoothed(scores, own=False), stands)
        ]

    @classmethod
    def fit(cls, rows: list[tuple[tuple[str, ...], tuple[str, ...], float, bool, int]], rounds: int = ROUNDS) -> "LineModel":
        """From (shape with place, words, start, whether that is open, times seen)."""
        codes: dict[str, int] = {}
        feature = np.array([codes.setdefault(x, len(codes)) for shape, words, *_ in rows for x in (*shape, *words)], dtype=np.int64)
        # the weight of each feature in its row's evidence
        sizes = np.array([(len(shape), len(words)) for shape, words, *_ in rows], dtype=np.int64).reshape(-1, 2)
        factor = np.repeat(np.stack([np.full(len(rows), SHAPE), 1 / np.sqrt(np.maximum(1, sizes[:, 1]))], axis=1).ravel(), sizes.ravel())
        row = np.repeat(np.arange(len(rows)), sizes.sum(axis=1))
        times = np.array([n for *_, n in rows], dtype=float)
        is_open = np.array([o for *_, o, _ in rows], dtype=bool)
        weight = np.array([w for _, _, w, _, _ in rows], dtype=float)
        often = np.bincount(feature, times[row], len(codes)) >= 3 if rows else np.zeros(0, dtype=bool)
        if not often.any():
            return cls({}, 0.0)
        place = np.cumsum(often) - 1
        known = often[feature]
        feature, factor, row = place[feature[known]], factor[known], row[known]
        number = [x for x, i in codes.items() if often[i]]
        model = cls({}, 0.0)
        for _ in range(rounds):
            for_it, against = times * weight, times * (1 - weight)
            if not for_it.sum() or not against.sum():
                return cls({}, 0.0)
            pos, neg = (np.bincount(feature, w[row], len(number)) for w in (for_it, against))
            odds = np.log((pos + SMOOTH) / (for_it.sum() + 2 * SMOOTH)) - np.log((neg + SMOOTH) / (against.sum() + 2 * SMOOTH))
            prior = math.log(for_it.sum() / against.sum())
            model = cls(dict(zip(number, odds.tolist())), prior)
            z = prior + np.bincount(row, odds[feature] * factor, len(rows))
            weight = np.where(is_open, 1 / (1 + np.exp(-np.clip(z, -30, 30))), weight)
        return model


def start(line: Line, place: str, seeds: tuple[str, ...] = SEEDS) -> tuple[float, bool]:
    """Probability of furniture that a line starts from in fitting, and whether it is open to change."""
    if line.first in _HEADINGS or NOTES.match(line.skeleton):
        return 0.0, False
    if seed(line.skeleton, seeds) == 2:
        return 1.0, False
    return (OPEN_IN if place == "place=r" else OPEN_OUT), True


def sampled_records(table: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, content)`` of about ``most`` records, taken by hash of the id; of all if there are no more."""
    n = table.count()
    records = table.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content"))
    return records.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / n)) if n > most else records


def fit_lines(pages: DataFrame, id_col: str = "page_id", text_col: str = "content", seeds: tuple[str, ...] = SEEDS) -> LineModel:
    """The classifier of lines, from a sample bounded by ``SAMPLE_PAGES`` and ``SAMPLE_LINES``; fitted twice, as
    the region is found better once furniture of long lines is known."""
    sample = cut(sampled_records(pages, SAMPLE_PAGES, id_col, text_col))
    return _fitted(sample, seeds, _fitted(sample, seeds, None))


def _fitted(sample: DataFrame, seeds: tuple[str, ...], before: LineModel | None) -> LineModel:
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        reader = LineReader()
        for batch in batches:
            seen: Counter = Counter()
            for content in batch["content"]:
                lines = reader(content)
                for (_, line), place in zip(lines, places(lines, before and before.alone(lines))):
                    seen[(*line.shape, place), line.words, *start(line, place, seeds)] += 1
            yield {"shape": [k[0] for k in seen], "words": [k[1] for k in seen], "start": [k[2] for k in seen], "open": [k[3] for k in seen], "n": list(seen.values())}

    lines = map_columns(sample, ["content"], run, "shape array<string>, words array<string>, start double, open boolean, n long")
    folded = lines.groupBy("shape", "words", "start", "open").agg(F.sum("n").alias("n"))
    # ordered by hash, so that the bound takes the same lines however they lie
    kept = folded.orderBy(F.xxhash64("shape", "words"), "shape", "words", "start").limit(SAMPLE_LINES)
    return LineModel.fit([(r["shape"], r["words"], r["start"], r["open"], r["n"]) for r in kept.toArrow().to_pylist()])


def furniture_lines(model: LineModel, reader: LineReader, content: str | None) -> list[int]:
    lines = reader(content)
    return [number for (number, _), is_furniture in zip(lines, model.judge(lines)) if is_furniture]


#: Evidence that the best span of a snippet must reach; most that one word counts for; what each word costs.
SPAN_AT, WORD_MOST, WORD_COST = 4.5, 6.0, 0.5


def best_span(model: LineModel, snippet: str | None) -> float:
    """The largest sum of evidence of any run of words; words that say nothing cost a little, so that runs stay together."""
    best = run = 0.0
    for w in _WORD.findall(skeleton(" ".join((snippet or "").split()))):
        run = max(0.0, run + max(-WORD_MOST, min(WORD_MOST, model.odds.get(w, 0.0))) - WORD_COST)
        best = max(best, run)
    return best


def snippet_has_furniture(model: LineModel, snippet: str | None) -> bool:
    """A snippet is one run of text: furniture in it is a run of words that speak for furniture."""
    return best_span(model, snippet) >= SPAN_AT


def _as_records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content"))


def page_furniture(pages: DataFrame, model: LineModel, id_col: str = "page_id", text_col: str = "content") -> DataFrame:
    """``(id, line_no)`` of the furniture lines."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        reader = LineReader()
        for batch in batches:
            found = [(i, n) for i, content in zip(batch["id"], batch["content"]) for n in furniture_lines(model, reader, content)]
            yield {"id": [i for i, _ in found], "line_no": [n for _, n in found]}

    return map_columns(_as_records(pages, id_col, text_col), ["id", "content"], run, "id long, line_no int")


def main_content(pages: DataFrame, model: LineModel, id_col: str = "page_id", text_col: str = "content") -> DataFrame:
    """``(id, content)``: every page without its furniture lines."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        reader = LineReader()
        for batch in batches:
            main = []
            for content in batch["content"]:
                drop = set(furniture_lines(model, reader, content))
                main.append(None if content is None else "\n".join(x for i, x in enumerate(content.split("\n")) if i not in drop))
            yield {"id": batch["id"], "content": main}

    return map_columns(_as_records(pages, id_col, text_col), ["id", "content"], run, "id long, content string")


def snippet_verdicts(results: DataFrame, model: LineModel, id_col: str = "result_id", text_col: str = "snippet") -> DataFrame:
    """``(id, dirty)``: whether each snippet holds any furniture (null and empty ones are clean)."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {"id": batch["id"], "dirty": [snippet_has_furniture(model, x) for x in batch["content"]]}

    return map_columns(_as_records(results, id_col, text_col), ["id", "content"], run, "id long, dirty boolean")
