"""Template residue and error-page text, by positive-unlabelled naive Bayes.

Passages are a record's titles (``title``, ``h1``, first heading of any level and
first line) and the lines of its main body; furniture and notes are searched for
placeholders only.  Trusted are passages that hold an unfilled placeholder, equal a
public default or error title, or hold a public wording of error messages and filler
(``TITLES``, ``NOTICES``); everything else is unlabelled.  Naive Bayes over the
words of the passages and pairs of them starts from the trusted ones against all
others and is then refined by expectation-maximization: unlabelled passages get their
posterior as weight.  Passages that the first round holds for negative are reliable
negatives and stay so, which keeps whole languages from drifting to the small class.

The classifier is fitted on a bounded sample (``SAMPLE_PAGES`` records taken by
hash of the id, at most ``SAMPLE_PASSAGES`` different passages, taken by hash too) and
then scores every passage of every record; the wordings are never asked at that point.
A passage of more than ``WINDOW`` words is cut into consecutive windows of about equal
size, in fitting and in scoring alike; each is scored and weighs by its length, so all
words of a passage count.  A record is residue if a passage has an unfilled
placeholder that is not shown as code or explained, if a title is scored as
residue, or if most of its main body is.

Defined cases: null and empty contents and titles are no residue; a body without
any line leaves the decision to the title; titles and passages of any length are
scored alike; repeated rows are judged alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.furniture import NOTES, LineModel, LineReader, sampled_records
from pagewright.session import map_columns

SAMPLE_PAGES, SAMPLE_PASSAGES = 4_000, 40_000
#: Words that are scored together.
WINDOW = 60
ROUNDS, TITLE_AT, BODY_AT, MOST, SMOOTH = 4, 0.9, 0.9, 0.5, 2.0

#: Syntax of unfilled placeholders.
PLACEHOLDER = re.compile(
    r"\{\{\{?[^{}\n]*\}?\}\}|\{%[^{}\n]*%\}|\$\{[\w. ]+\}|#\{[\w.]+\}|%%[\w. ]+%%|(?<![\w%])%[a-zA-Z_]{3,}%(?!\w)|<%=?[^%\n]*%>"
    r"|\[(?:insert|your|enter|title|name|add)\b[^\]\n]*\]|\b(?:TITLE|HEADING|NAME|TEXT|CAPTION)_\d+\b|__[A-Z][A-Z_]{2,}__|\[\[[\w. ]+\]\]",
    re.I,
)
#: Usual default and error titles, with digits as ``#``.
TITLES = (
    "untitled", "untitled document", "untitled page", "undefined", "null", "nan", "none", "new page", "page title", "title", "heading", "headline", "your title here", "under construction", "site under construction", "coming soon",
    "lorem ipsum", "object moved", "document moved", "just a moment", "oops", "error", "error #", "http error #", "# not found", "# internal server error", "# server error", "# forbidden", "# bad gateway", "# service unavailable",
    "not found", "page not found", "file not found", "access denied", "forbidden", "server error", "internal server error", "bad gateway", "service unavailable", "maintenance", "down for maintenance", "default page", "test page",
    "example page", "index of /", "it works", "welcome to nginx", "seite nicht gefunden", "zugriff verweigert", "fehler", "página no encontrada", "acceso denegado", "page introuvable", "accès refusé", "erreur",
    "sem título", "sin título", "ohne titel", "sans titre",
)
#: Usual wordings of error messages, script notices and filler, with digits as ``#`` and without punctuation.
NOTICES = (
    "the requested url was not found on this server", "page could not be found", "does not exist", "it may have been moved or deleted", "no longer here", "you don't have permission to access", "permission to read this page",
    "access to this page is limited", "log in to proceed", "your session has expired", "internal error", "please try again later", "try fewer words", "start again", "down for maintenance", "will be back soon", "too many requests", "too many connections",
    "could not connect to database", "fatal error", "call to undefined function", "cannot open stream", "traceback most recent call last", "your address has been blocked", "checking your browser before", "no results were found",
    "there are no items here", "please enable javascript", "turn on javascript", "javascript is disabled", "scripts are disabled", "aktivieren sie javascript", "lorem ipsum", "dolor sit amet", "consectetur adipiscing elit", "browser with scripting", "download failed",
    "your text goes here", "insert description here", "placeholder caption", "sample paragraph", "click to edit", "asdf asdf", "todo write", "coming soon", "content is being prepared", "the file is empty",
)
_EXPLAINS = re.compile(r"template|placeholder|variable|braces|macro|syntax|markup", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|#|[{}$%\[\]]{1,3}")
_SLUG = re.compile(r"\b\w+://\S+|/?\b[^\W\d_]{3,}(?:-[^\W\d_]{3,})+\b(?:\.\w+)?")
_PARTS = re.compile(r"\s[|·–—-]\s")
_PUNCTUATION = re.compile(r"[^\w#']+")


def _flat(text: str) -> str:
    return " ".join(_PUNCTUATION.sub(" ", re.sub(r"\d+", "#", text.casefold())).split())


def features(text: str, kind: str) -> list[str]:
    """Features of a passage: its kind with each word; addresses, slugs and numbers as one word each; its size last."""
    flat = _SLUG.sub(" slugword ", re.sub(r"\d+", "#", text.casefold()))
    found = _WORD.findall(flat)
    return [f"{kind} {w}" for w in found] + [f"{kind} size={min(6, len(found).bit_length())}"]


def windows(p: "Passage") -> list[list[str]]:
    """The features of a passage in consecutive windows that leave no word out; each has the size of the whole and
    that of the record's body (an error message often stands alone)."""
    *found, size = features(p.text, p.kind)
    n = max(1, -(-len(found) // WINDOW))
    whole = [size, f"b of={p.body.bit_length()}"] if p.kind == "b" else [size]
    return [[*found[len(found) * i // n : len(found) * (i + 1) // n], *whole] for i in range(n)]


def has_placeholder(text: str) -> bool:
    """Every placeholder has one of these characters, which is cheap to ask first."""
    return any(c in text for c in "{%$[_<#") and PLACEHOLDER.search(text) is not None


@dataclass
class Passage:
    #: ``t`` title, ``b`` body, ``f`` furniture or a note, kept for its placeholder only
    kind: str
    text: str
    placeholder: bool
    #: characters of the record's body, in hundreds
    body: int = 0


def passages(lines_model: LineModel, reader: LineReader, content: str | None) -> list[Passage]:
    lines = reader(content)
    out: list[Passage] = []
    before = ""
    titled = headed = False
    for (_, line), furniture in zip(lines, lines_model.judge(lines)):
        found = has_placeholder(line.text) and not (line.code or _EXPLAINS.search(before) or _EXPLAINS.search(PLACEHOLDER.sub("", line.text)))
        if not furniture:
            before = line.text
        if furniture or NOTES.match(line.skeleton):
            if found:
                out.append(Passage("f", line.text, True))
            continue
        heading = line.first in ("h1", "h2", "h3", "h4", "h5", "h6")
        # the first line of a page without marked title is one, unless it reads on like a body
        first = not titled and (line.first == "title" or not line.text.rstrip().endswith((".", "!", "?", "…")))
        kind = "t" if line.first in ("title", "h1") or first or (heading and not headed) else "b"
        titled, headed = True, headed or heading
        if kind == "b" and heading and not found:
            continue
        out.append(Passage(kind, line.text, found))
    body = sum(len(p.text) for p in out if p.kind == "b") // 100
    for p in out:
        p.body = body
    return out


class Wordings:
    """What is trusted before anything is learnt."""

    def __init__(self, titles: Iterable[str] = TITLES, notices: Iterable[str] = NOTICES):
        self.titles, self.notices = frozenset(map(_flat, titles)), tuple(map(_flat, notices))

    def trusts(self, p: Passage) -> bool:
        if p.placeholder:
            return True
        flat = _flat(p.text)
        return flat in self.titles if p.kind == "t" else any(x in flat for x in self.notices)


Rows = list[tuple[tuple[str, ...], bool, int]]


class Model:
    """Log-odds of the words of a passage; fitted by expectation-maximization."""

    def __init__(self, odds: dict[str, float], prior: float, unknown: float):
        self.odds, self.prior, self.unknown = odds, prior, unknown

    def posterior(self, found: Iterable[str]) -> float:
        z = self.prior + sum(self.odds.get(w, self.unknown) for w in found)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

    @classmethod
    def fit(cls, rows: Rows, rounds: int = ROUNDS) -> "Model":
        """From (features, whether trusted, times seen)."""
        codes: dict[str, int] = {}
        seen = np.array([codes.setdefault(x, len(codes)) for found, _, _ in rows for x in found], dtype=np.int64)
        row = np.repeat(np.arange(len(rows)), [len(found) for found, _, _ in rows])
        # words that one passage alone has are one word together, of number 0
        first = np.unique(seen * len(rows) + row) if rows else seen
        often = np.bincount(first // max(1, len(rows)), np.array([n for *_, n in rows], dtype=float)[first % max(1, len(rows))], len(codes)) >= 2 if rows else np.zeros(0, dtype=bool)
        if not often.any():
            return cls({}, -50.0, 0.0)
        feature = np.where(often, np.cumsum(often), 0)[seen]
        number = {x: int(i) for x, i in zip((x for x, i in codes.items() if often[i]), range(1, len(codes) + 1))}
        times = np.array([n for *_, n in rows], dtype=float)
        fixed = np.array([t for _, t, _ in rows], dtype=bool)
        weight = fixed.astype(float)
        model, is_open = cls({}, -50.0, 0.0), None
        for _ in range(rounds):
            pos, neg = (np.bincount(feature, (times * w)[row], len(number) + 1) for w in (weight, 1 - weight))
            # smoothed towards the word's share of all words, so that words of the large class don't favour the small one
            share = np.maximum(pos + neg, 0.5) / (pos.sum() + neg.sum())
            odds = np.log((pos + SMOOTH * share) / (pos.sum() + SMOOTH)) - np.log((neg + SMOOTH * share) / (neg.sum() + SMOOTH))
            odds[0] = min(odds[0], -0.5)
            prior = math.log(((times * weight).sum() + 1) / ((times * (1 - weight)).sum() + 1))
            model = cls({x: float(odds[i]) for x, i in number.items()}, prior, float(odds[0]))
            z = prior + np.bincount(row, odds[feature], len(rows))
            posterior = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            if is_open is None:
                # whose class is still open after the first round; the rest stay negative
                is_open = ~fixed & (posterior >= 0.5)
            weight = np.where(is_open, posterior, weight)
        return model


def sample_counts(lines_model: LineModel, reader: LineReader, contents: Iterable[str | None], wordings: Wordings) -> Counter:
    """``(features, trusted)`` of the windows of all passages; a sentence around a placeholder is ordinary text and teaches neither class."""
    seen: Counter = Counter()
    for content in contents:
        for p in passages(lines_model, reader, content):
            if not p.placeholder:
                trusted = wordings.trusts(p)
                for w in windows(p):
                    seen[tuple(w), trusted] += 1
    return seen


def fit_rows(rows: Rows, wordings: Wordings) -> Model:
    """The wordings themselves are trusted passages as well."""
    given = [(tuple(features(t, kind)), True, 2) for kind, texts in (("t", sorted(wordings.titles)), ("b", wordings.notices)) for t in texts]
    return Model.fit(given + rows)


def fit(pages: DataFrame, lines_model: LineModel, id_col: str = "page_id", text_col: str = "content", wordings: Wordings | None = None) -> Model:
    """The classifier from a bounded sample of the records."""
    trusted = wordings or Wordings()

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        reader = LineReader()
        for batch in batches:
            seen = sample_counts(lines_model, reader, batch["content"], trusted)
            yield {"features": [k[0] for k in seen], "trusted": [k[1] for k in seen], "n": list(seen.values())}

    found = map_columns(sampled_records(pages, SAMPLE_PAGES, id_col, text_col), ["content"], run, "features array<string>, trusted boolean, n long")
    folded = found.groupBy("features", "trusted").agg(F.sum("n").alias("n"))
    return fit_rows([(tuple(r["features"]), r["trusted"], r["n"]) for r in sampled(folded, SAMPLE_PASSAGES).toArrow().to_pylist()], trusted)


def sampled(passages: DataFrame, most: int) -> DataFrame:
    """At most so many rows, in an order that hangs on what they are and not on where they lie."""
    return passages.orderBy(F.xxhash64("features", "trusted"), "features", "trusted").limit(most)


def is_residue_title(model: Model, title: str | None) -> bool:
    if not title or not title.strip():
        return False
    # parts of two words and more are asked for themselves: an error beside the name of the site
    parts = [p for p in _PARTS.split(title) if len(p.split()) > 1]
    return has_placeholder(title) or any(model.posterior(features(p, "t")) >= TITLE_AT for p in (title, *(parts if len(parts) > 1 else ())))


def is_residue(model: Model, found: list[Passage]) -> bool:
    if any(p.placeholder or (p.kind == "t" and is_residue_title(model, p.text)) for p in found):
        return True
    body = sorted((p for p in found if p.kind == "b"), key=lambda p: -len(p.text))
    left = sum(len(p.text) for p in body) * (1 - MOST)
    for p in body:
        cut = windows(p)
        size = sum(map(len, cut))
        for w in cut:
            if model.posterior(w) < BODY_AT:
                left -= len(p.text) * len(w) / size
                if left < 0:  # the rest can't be most of the body any more
                    return False
    return bool(body)


def residue_pages(pages: DataFrame, lines_model: LineModel, model: Model, id_col: str = "page_id", text_col: str = "content") -> DataFrame:
    """``(id)`` of the pages that are residue."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        reader = LineReader()
        for batch in batches:
            yield {"id": [i for i, c in zip(batch["id"], batch["content"]) if is_residue(model, passages(lines_model, reader, c))]}

    return map_columns(pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content")), ["id", "content"], run, "id long")


def residue_titles(results: DataFrame, model: Model, id_col: str = "result_id", text_col: str = "title") -> DataFrame:
    """``(id)`` of the results whose title is residue."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {"id": [i for i, t in zip(batch["id"], batch["content"]) if is_residue_title(model, t)]}

    return map_columns(results.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content")), ["id", "content"], run, "id long")
