"""Keyword-stuffed pages and link lists, from rank-frequency curves.

One pass over the pages reads each page's main body (furniture, title and headings
left out; text in a wrong encoding restored first) and gives one row a page: its
language, its size in words, how often it says each function word, and the frequency
spectrum of all its other terms (how many terms occur ``tf`` times).

SQL windows over the spectrum give the ranks of the page's own terms; a regression of
log frequency on log rank, each term counting once, gives slope and residual.  SQL
windows over the function words of all prose of a language rank these as well; a
page's words fall into bins of those ranks (``BINS``) and a rest of all other words,
and the Kullback-Leibler divergence of this distribution from that of the language's
prose, as a share of the divergence that a text without any function word has, says
how far the page is from prose of its language.  Slope and residual are compared with
the median and quartiles of pages of the same language and length.

A page is stuffed if its curve is extreme: in divergence (lists of keywords, links or
tags hardly use function words), in a slope steeper than its peers' (sentences built
around one keyword), or in the residual.  Directories and reading lists diverge
from prose too, but keep some function words and say something new in each entry.

Defined cases: null, empty and very short bodies are not stuffed; filler text (lorem
ipsum) is not promotion; lines that are still garbled after restoring can't be told
from prose and are left out, and so is a body that is mostly such lines; a language without enough prose is compared with that of
all languages; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.visible import text_terms
from pagewright.llm.furniture import NOTES, LineModel, LineReader
from pagewright.llm.mojibake import damage, restore
from pagewright.llm.prose import ANY, CONNECTIVES, function_words, language, spaceless, units
from pagewright.session import cut, map_columns

#: A body with less words is too short to tell.
LEAST_WORDS = 30
#: Last ranks of the bins of function words.
BINS = (2, 8, 32)
#: Share of the largest possible divergence; standard scores of a steeper slope and of the residual.
DIVERGENCE, STEEP, RESIDUAL = 0.45, 8.0, 6.0
#: Least spread of slopes and residuals that a score is taken by, and rows that make a class of peers.
LEAST_SPREAD, LEAST_PEERS = 0.06, 5
_FILLER = re.compile(r"\b(?:lorem|ipsum|blindtext|asdf)\b", re.I)
SCHEMA = "id long, furniture array<int>, lang string, words double, heads array<struct<word: string, n: double>>, spectrum array<struct<tf: int, n: int>>"


def _counted(lines: list[str]) -> tuple[float, Counter, Counter]:
    """Words, function words and all other terms."""
    text = "\n".join(lines)
    tokens = text_terms(text)
    counts = Counter(tokens)
    own = Counter({t: n for t, n in counts.items() if t not in ANY and t not in CONNECTIVES and not t.isdigit()})
    if not spaceless(text):
        return float(len(tokens)), Counter({t: n for t, n in counts.items() if t in ANY}), own
    words, heads = 0.0, Counter()
    for line in lines:
        tokens = text_terms(line)
        words += units(line, tokens)
        heads.update(function_words(line, tokens))
    return words, heads, own


def body_measures(lines: list[str]) -> tuple[str, float, Counter, Counter]:
    """Language, words, function words and all other terms of the body lines."""
    words, heads, own = _counted(lines)
    # garbled text has few function words, or the same stray letters over and over
    if heads.total() < 0.2 * words or max(own.values(), default=0) > 0.08 * words:
        text = "\n".join(lines)
        if not text.isascii() and damage(text):
            restored = restore(text)[0]
            lines = restored.split("\n")
            if damage(restored):
                clean = [x for x in lines if not damage(x) and sum(c > "\x7f" for c in x) <= 0.3 * len(x)]
                lines = clean if 2 * sum(map(len, clean)) >= len(restored) else []
            words, heads, own = _counted(lines)
    return language(heads), words, heads, own


def _pass(model: LineModel):
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        reader = LineReader()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "furniture", "lang", "words", "heads", "spectrum")}
            for page_id, content in zip(batch["id"], batch["content"]):
                lines = reader(content)
                marks = model.judge(lines)
                # a line of words that don't speak for furniture themselves may be a keyword or a link of the body
                body = [line.text for (_, line), f in zip(lines, marks) if not (f and model.wording(line) > 0) and line.first not in ("title", "h1", "h2", "h3") and not NOTES.match(line.skeleton)]
                if sum(len(_FILLER.findall(text)) for text in body) >= 3:
                    body = []
                lang, words, heads, own = body_measures(body)
                out["id"].append(page_id)
                out["furniture"].append([n for (n, _), f in zip(lines, marks) if f])
                out["lang"].append(lang)
                out["words"].append(words)
                out["heads"].append([{"word": w, "n": n} for w, n in heads.items()])
                out["spectrum"].append([{"tf": tf, "n": n} for tf, n in Counter(own.values()).items()])
            yield out

    return run


def page_profiles(pages: DataFrame, model: LineModel, id_col: str = "page_id", text_col: str = "content") -> DataFrame:
    """One row a page: furniture lines and the measures of its main body (see SCHEMA)."""
    return map_columns(pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content")), ["id", "content"], _pass(model), SCHEMA)


def curves(profiles: DataFrame) -> DataFrame:
    """``(id, slope, residual)`` of each page's rank-frequency curve; 0 for curves of one frequency only."""
    spectrum = profiles.select("id", F.explode("spectrum").alias("s")).select("id", "s.tf", "s.n")
    above = Window.partitionBy("id").orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the terms of one frequency share their middle rank
    x, y, w = F.ln(F.sum("n").over(above) - (F.col("n") - 1) / 2), F.ln("tf"), F.col("n")
    sums = spectrum.select("id", w.alias("w"), (w * x).alias("x"), (w * y).alias("y"), (w * x * x).alias("xx"), (w * x * y).alias("xy"), (w * y * y).alias("yy"))
    s = sums.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("w", "x", "y", "xx", "xy", "yy")))
    across, up, both = (F.col(c) - F.col(a) * F.col(b) / F.col("w") for c, a, b in (("xx", "x", "x"), ("yy", "y", "y"), ("xy", "x", "y")))
    fitted = s.select("id", "w", across.alias("across"), up.alias("up"), both.alias("both")).withColumn("slope", F.when(F.col("across") > 1e-9, F.col("both") / F.col("across")).otherwise(0.0))
    return fitted.select("id", "slope", F.sqrt(F.greatest(F.lit(0.0), F.col("up") - F.col("slope") * F.col("both")) / F.col("w")).alias("residual"))


def _share(name: str = "heads") -> Column:
    return F.aggregate(name, F.lit(0.0), lambda acc, h: acc + h["n"]) / F.col("words")


_BINS = [f"n{b}" for b in range(len(BINS) + 1)]


def _expected(shares: list[Column]) -> Column:
    return F.array(*shares, F.greatest(F.lit(1e-3), 1 - sum(shares[1:], shares[0])))


def prose_ranks(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lang, word, bin)``: the bin of each function word in the prose of its language; and ``(lang, expected)``:
    the share of the prose that each bin and the rest have, with a row of null ``lang`` for all languages together.

    Prose are the pages with at least half the median share of function words, so that
    a class full of keyword pages doesn't set its own measure."""
    measured = profiles.where(F.col("words") >= LEAST_WORDS).withColumn("share", _share())
    # a row a language
    middle = measured.groupBy("lang").agg(F.percentile_approx("share", 0.5).alias("middle"))
    prose = measured.join(F.broadcast(middle), "lang").where("share > 0 and share >= middle / 2")
    sizes = prose.groupBy("lang").agg(F.sum("words").alias("total"), F.count("*").alias("k")).where(F.col("k") >= LEAST_PEERS)
    said = prose.select("lang", F.explode("heads").alias("h")).groupBy("lang", F.col("h.word").alias("word")).agg(F.sum("h.n").alias("n")).join(F.broadcast(sizes), "lang")
    # the function words of a language are a fixed list, so this window is small whatever the corpus
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    which = sum((F.when(F.col("rank") > last, 1).otherwise(0) for last in BINS), F.lit(0))
    ranked = cut(said.withColumn("rank", rank).withColumn("bin", which))
    counted = ranked.groupBy("lang", "total").agg(*(F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0.0)).alias(c) for b, c in enumerate(_BINS)))
    own = counted.select("lang", _expected([F.col(c) / F.col("total") for c in _BINS]).alias("expected"))
    # without ranks of its own language a text is compared by its share of function words alone: they all go to the first bin
    share = F.sum(sum((F.col(c) for c in _BINS[1:]), F.col(_BINS[0]))) / F.sum("total")
    pooled = counted.agg(_expected([share, *(F.lit(0.0) for _ in BINS)]).alias("expected")).select(F.lit(None).cast("string").alias("lang"), "expected")
    return ranked.select("lang", "word", "bin"), cut(own.unionByName(pooled))


def divergence(counts: list[Column], words: Column, expected: Column) -> Column:
    """Nats between a page's words over the rank bins and the prose of its language, over the most there can be."""
    last = len(counts)
    rest = F.greatest(F.lit(0.0), words - sum(counts[1:], counts[0]))

    def part(count: Column, b: int) -> Column:
        p = count / words
        return F.when(count > 0, p * F.ln(p / F.greatest(F.lit(1e-3), F.get(expected, F.lit(b))))).otherwise(0.0)

    total = sum((part(c, b) for b, c in enumerate(counts)), part(rest, last))
    # a text that says more function words than prose doesn't diverge towards lists
    return F.when(rest / words > F.get(expected, F.lit(last)), total / -F.ln(F.get(expected, F.lit(last)))).otherwise(0.0)


def divergences(profiles: DataFrame) -> DataFrame:
    """``(id, lang, words, divergence)`` of every page with enough words."""
    ranks, expected = prose_ranks(profiles)
    said = profiles.where(F.col("words") >= LEAST_WORDS).select("id", "lang", "words", F.explode_outer("heads").alias("h")).select("id", "lang", "words", F.col("h.word").alias("word"), F.col("h.n").alias("n"))
    # as many rows as there are languages, and function words in them
    placed = said.join(F.broadcast(expected.where("lang is not null")), "lang", "left").join(F.broadcast(ranks), ["lang", "word"], "left")
    which = F.when(F.col("expected").isNull(), 0).otherwise(F.coalesce("bin", F.lit(len(BINS))))
    summed = placed.groupBy("id", "lang", "words").agg(F.any_value("expected").alias("expected"), *(F.coalesce(F.sum(F.when(which == b, F.col("n"))), F.lit(0.0)).alias(c) for b, c in enumerate(_BINS)))
    pooled = expected.where("lang is null").select("expected").scalar()
    return summed.select("id", "lang", "words", divergence([F.col(c) for c in _BINS], F.col("words"), F.coalesce("expected", pooled)).alias("divergence"))


def stuffing_scores(profiles: DataFrame) -> DataFrame:
    """``(id, lang, words, divergence, slope, slope_score, residual_score, stuffed)`` of every page with enough words."""
    measured = divergences(profiles).join(curves(profiles), "id", "left").fillna(0.0, ["slope", "residual", "divergence"]).withColumn("size", F.floor(F.log2("words")).cast("int"))
    measured = cut(measured)
    names = ("slope", "residual")
    quartiles = [F.percentile_approx(n, [0.25, 0.5, 0.75]).alias(n) for n in names]
    # at most one row for each language and power of two of length: bounded
    same = measured.groupBy("lang", "size").agg(F.count("*").alias("k"), *quartiles).where(F.col("k") >= LEAST_PEERS).select("lang", "size", *(F.col(n).alias(f"q_{n}") for n in names))
    alike = measured.groupBy("size").agg(*quartiles).select("size", *(F.col(n).alias(f"a_{n}") for n in names))
    joined = measured.join(F.broadcast(same), ["lang", "size"], "left").join(F.broadcast(alike), "size", "left")

    def score(name: str) -> Column:
        q = F.coalesce(f"q_{name}", f"a_{name}")
        return (F.col(name) - F.get(q, F.lit(1))) / F.greatest(F.lit(LEAST_SPREAD), (F.get(q, F.lit(2)) - F.get(q, F.lit(0))) / 1.349)

    scored = joined.withColumns({"slope_score": -score("slope"), "residual_score": score("residual")})
    extreme = (F.col("divergence") >= DIVERGENCE) | (F.col("slope_score") >= STEEP) | (F.col("residual_score") >= RESIDUAL)
    return scored.select("id", "lang", "words", "divergence", "slope", "slope_score", "residual_score", extreme.alias("stuffed"))
