"""One consistent form for text that looks the same.

Every text is brought to composed form (NFC), with full-width letters, ligatures,
Roman numerals, no-break spaces and forms of the hyphen as the plain ones, without
characters that show nothing, and with runs of white space as one space.  Raised,
lowered and ringed characters, accents and case stay: they can be seen.

Look-alike letters are repaired by script: a word with letters of more than one of
the Latin, Cyrillic and Greek scripts is rewritten in its dominant script (the one
of the letters that look like no other; then by number; then the document's), and
the result is taken only if it is a word of the corpus vocabulary (words of one
script anywhere in the table); else the other script is tried.  A word made of
look-alikes only is treated the same way against its document's script.

Two documents read the same if their forms are equal once words that the
vocabulary can't settle (and words of look-alikes only) are folded letter by letter.

Defined cases: null stays null and blank becomes empty, and neither is paired with
anything; exact copies aren't pairs of each other but each is one of every other
spelling; repeated rows of one id count once; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import cut, map_columns

#: Letters of Cyrillic and Greek that look like the Latin letter below them.
_CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԚԜЁЇаеѕіјорсухүһԁԛԝёї"
_CYR_LATIN = "ABESIJKMHOPCTYXYQWËÏaesijopcyxyhdqwëï"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳν"
_GRE_LATIN = "ABEZHIKMNOPTYXojv"
TO_LATIN = {**dict(zip(_CYRILLIC, _CYR_LATIN)), **dict(zip(_GREEK, _GRE_LATIN))}
_TO = {
    "L": TO_LATIN,
    "C": {v: k for k, v in reversed(list(zip(_CYRILLIC, _CYR_LATIN)))},
    "G": {v: k for k, v in zip(_GREEK, _GRE_LATIN)},
}
_FOLD = str.maketrans(TO_LATIN)
_HAS_TWIN = frozenset(TO_LATIN) | frozenset(TO_LATIN.values())

#: Forms of the hyphen, and characters that show nothing by themselves.
_HYPHENS = "‐‑﹣－"
_NOTHING = "­͏؜​‌‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
_PLAIN: dict[int, str] = {ord(c): "-" for c in _HYPHENS} | {ord(c): "" for c in _NOTHING}
for _o in [*range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7), *range(0xFB00, 0xFB07), *range(0x2160, 0x2180), 0xB5, 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)]:
    _PLAIN.setdefault(_o, unicodedata.normalize("NFKC", chr(_o)))
_CHANGES = re.compile("[" + "".join(map(re.escape, map(chr, _PLAIN))) + "]")
#: A joiner between pictures or between letters of a joining script can be seen.
_JOINER = re.compile("(?<![←-⯿️\U0001f000-\U0001faff؀-෿])‍|‍(?![←-⯿\U0001f000-\U0001faff؀-෿])")
#: Letters of Greek and Cyrillic; a text without any has one script only.
_OTHER_SCRIPT = re.compile("[\u0370-\u052f\u1f00-\u1fff]")
_WORD = re.compile(r"[^\W\d_]+")


def plain(text: str) -> str:
    """The consistent form, but for look-alike letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "\u200d" in text:
            text = _JOINER.sub("", text)
        if _CHANGES.search(text):
            text = unicodedata.normalize("NFC", text.translate(_PLAIN))
    return " ".join(text.split())


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x400 <= o < 0x530:
        return "C"
    return "G" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "-"


def _scripts(word: str) -> set[str]:
    return {_script(c) for c in word} - {"-"}


def _rewrite(word: str, script: str) -> str | None:
    """The word in one script, or None if a letter has no twin in it."""
    out = []
    for c in word:
        if _script(c) in (script, "-"):
            out.append(c)
            continue
        twin = TO_LATIN.get(c, c if _script(c) == "L" else None)
        if script != "L" and twin is not None:
            twin = _TO[script].get(twin)
        if twin is None:
            return None
        out.append(twin)
    return "".join(out)


def _dominant(text: str) -> str:
    counts = Counter(s for c in text if c.isalpha() and (s := _script(c)) != "-" and (c not in _HAS_TWIN))
    return counts.most_common(1)[0][0] if counts else "L"


def _odd_words(text: str, words: set[str] | None = None) -> dict[str, list[str]]:
    """Words of mixed script, or of look-alikes only in another script than the document's, with the forms to try in order."""
    if text.isascii() or not _OTHER_SCRIPT.search(text):
        return {}
    document = None
    out: dict[str, list[str]] = {}
    for word in set(_WORD.findall(text)) if words is None else words:
        if word.isascii() and not all(c in _HAS_TWIN for c in word):
            continue
        scripts = _scripts(word)
        if document is None:
            document = _dominant(text)
        if len(scripts) < 2 and not (scripts and document not in scripts and all(c in _HAS_TWIN for c in word)):
            continue
        sure = Counter(_script(c) for c in word if _script(c) != "-" and c not in _HAS_TWIN)
        number = Counter(_script(c) for c in word if _script(c) != "-")
        order = sorted(scripts | {document}, key=lambda s: (-sure[s], -(s == document) if not sure else 0, -number[s], s))
        out[word] = [w for s in order if (w := _rewrite(word, s)) is not None and w != word]
    return {w: forms for w, forms in out.items() if forms}


def _hash(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def settled(text: str, repairs: dict[str, str], odd: dict[str, list[str]] | None = None) -> tuple[str, bytes]:
    """The form of a plain text with its repairs, and the key under which texts that read the same meet."""
    odd = _odd_words(text) if odd is None else odd

    def word(m: re.Match) -> str:
        return repairs.get(m.group(), m.group())

    form = _WORD.sub(word, text) if repairs else text

    def fold(m: re.Match) -> str:
        w = m.group()
        if all(c in _HAS_TWIN for c in w) or len(_scripts(w)) > 1:
            return w.translate(_FOLD)
        return w

    unsettled = odd.keys() - repairs.keys()
    # Latin letters fold to themselves
    key = _WORD.sub(fold, form) if unsettled or _OTHER_SCRIPT.search(form) else form
    return form, _hash(key)


SEEN = "doc_id long, key binary, raw binary, plain string, odd array<struct<word: string, forms: array<string>>>, word string"


def _seen_rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """All that one pass over the texts can tell: a row a document (a text without odd words has its key at once, one
    with odd words goes on in its plain form), and rows of the distinct words of one script, once a batch or so."""
    known: set[str] = set()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "key", "raw", "plain", "odd", "word")}
        fresh: set[str] = set()
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            key = raw = form = odd = None
            if text is not None:
                raw, form = _hash(text), plain(text)
                words = set(_WORD.findall(form))
                odd = _odd_words(form, words)
                fresh |= words - known
                if not odd:
                    key, form = settled(form, {}, odd)[1] if form else None, None
            for name, value in zip(out, (doc_id, key, raw, form if odd else None, [{"word": w, "forms": f} for w, f in odd.items()] if odd else None, None)):
                out[name].append(value)
        fresh = {w for w in fresh if w.isascii() or len(_scripts(w)) <= 1}
        known = known | fresh if len(known) < 200_000 else set()
        for name, value in out.items():
            value.extend(fresh if name == "word" else [None] * len(fresh))
        yield out


def _settled_rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for batch in batches:
        keys = [settled(text, {r["word"]: r["form"] for r in repairs or ()})[1] if text else None for text, repairs in zip(batch["plain"], batch["repairs"])]
        yield {"doc_id": batch["doc_id"], "key": keys, "raw": batch["raw"]}


def _form_rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for batch in batches:
        forms = [None if text is None else settled(plain(text), {r["word"]: r["form"] for r in repairs or ()})[0] for text, repairs in zip(batch["text"], batch["repairs"])]
        yield {"doc_id": batch["doc_id"], "form": forms}


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def seen_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the pass over the texts (see SEEN), written once."""
    return cut(map_columns(_texts(documents, id_col, text_col), ["doc_id", "text"], _seen_rows, SEEN))


def repairs(seen: DataFrame) -> DataFrame:
    """``(raw, repairs)``: the words of each odd text (by its hash) that are words of the corpus in another script, first choice first."""
    tried = seen.where("odd is not null").select("raw", F.explode("odd").alias("o")).select("raw", "o.word", F.posexplode("o.forms").alias("place", "form")).distinct()
    vocabulary = seen.where("word is not null").select(F.col("word").alias("form")).join(tried.select("form").distinct(), "form", "left_semi").distinct()
    accepted = tried.join(vocabulary, "form").groupBy("raw", "word").agg(F.min(F.struct("place", "form")).alias("best"))
    return accepted.groupBy("raw").agg(F.collect_list(F.struct("word", F.col("best.form").alias("form"))).alias("repairs"))


def reading_keys(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, raw)`` of every document: the key of texts that read the same (null for null and blank texts),
    and a hash of the text as it stands.  Texts are read once; only those with odd words are looked at again."""
    seen = seen_texts(documents, id_col, text_col)
    at_once = seen.where("word is null and odd is null").select("doc_id", "key", "raw")
    later = seen.where("odd is not null").select("doc_id", "raw", "plain").join(repairs(seen), "raw", "left")
    return at_once.unionByName(map_columns(later, ["doc_id", "plain", "raw", "repairs"], _settled_rows, "doc_id long, key binary, raw binary"))


def consistent_forms(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, form)``: every document in its consistent form."""
    seen = seen_texts(documents, id_col, text_col)
    fixed = seen.where("odd is not null and doc_id is not null").select("doc_id", "raw").distinct().join(repairs(seen), "raw").select("doc_id", "repairs").dropDuplicates(["doc_id"])
    return map_columns(_texts(documents, id_col, text_col).join(fixed, "doc_id", "left"), ["doc_id", "text", "repairs"], _form_rows, "doc_id long, form string")


def same_reading_pairs(keys: DataFrame) -> DataFrame:
    """``(doc_id_a, doc_id_b)`` of different texts that read the same, from :func:`reading_keys`."""
    keyed = cut(keys.where("key is not null and doc_id is not null").select("doc_id", "key", "raw").distinct())
    # only keys of at least two spellings are joined with themselves
    several = keyed.groupBy("key").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("key")
    some = keyed.join(several, "key", "left_semi")
    a = some.select("key", F.col("doc_id").alias("doc_id_a"), F.col("raw").alias("ra"))
    b = some.select("key", F.col("doc_id").alias("doc_id_b"), F.col("raw").alias("rb"))
    return a.join(b, "key").where("doc_id_a < doc_id_b and ra <> rb").select("doc_id_a", "doc_id_b")
