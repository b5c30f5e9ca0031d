"""Text decoded in the wrong encoding: find it and restore it.

Multibyte damage.  For each legacy encoding the characters of a text map back to
bytes; an automaton over the UTF-8 byte structure (lead byte, then its number of
continuation bytes), compiled to one character-class expression an encoding,
finds the maximal well-formed spans, and only those spans are decoded.  A second
automaton does the same for the two- and three-byte codes of EUC-JP and
Shift-JIS.  Rounds repeat while spans are found, for text damaged twice.

Single-byte damage (Cyrillic or Greek bytes read as Latin-1, Latin letters read
as Cyrillic, Mac bytes read as Windows ones, KOI8 read as Windows-1251) has no
byte structure.  It is recognised word by word from letters that no language
puts together, and the word is re-decoded if the result is plausible.  U+FFFD
counts as garbled but can't be restored.

Defined cases: null stays null and is not garbled, empty and plain ASCII texts
are not garbled and stay as they are; other columns are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.visible import visible_text
from pagewright.session import map_columns

#: Encodings that UTF-8 bytes are known to be read in.
CODECS = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866")
#: Leads that alone are proof, as no text has them before a continuation character.
PROOF = {"cp1252": "ÂÃ", "mac_roman": "√¬", "cp437": "├┬", "cp850": "├┬", "cp1251": "", "koi8_r": "", "cp866": ""}
#: Common pairs of Russian letters.
RUSSIAN = frozenset("ст но то на ен ов ни ра во ко по ро ли не пр ос ре та ва ер го от ль ес ет ть ор ом ка ал ат де ла ел ан ин за ия ри ле ой ог ны ск ем ти де".split())
#: Common pairs of Greek letters, without accents.
GREEK = frozenset("το ου ει αι τη στ ασ ησ οσ να ια απ ερ εν τα αν κα πο με οι τι ση σε δι ατ λο γι ον ρο τε ισ ντ ρι ολ εισ αρ ετ τρ ηρ οπ".split())
#: Cyrillic letters that look like Latin ones; a word with only these is not damage but look-alikes.
LOOK_ALIKE = frozenset("аеорсухіѕјһԁАВЕКМНОРСТУХІЅЈ")
ROUNDS = 3


@lru_cache(None)
def _reverse(codec: str) -> dict[str, int]:
    out = {}
    for byte in range(0x80, 0x100):
        try:
            char = bytes([byte]).decode(codec)
        except UnicodeDecodeError:
            char = chr(byte)  # undefined bytes come through as controls
        out[char] = byte
    if codec == "cp1252":  # Latin-1 readers keep the controls that Windows replaces
        out |= {chr(b): b for b in range(0x80, 0xA0)}
    return out


@lru_cache(None)
def _automaton(codec: str) -> re.Pattern:
    back = _reverse(codec)

    def chars(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in back.items() if low <= b <= high) + "]"

    tail = chars(0x80, 0xBF)
    return re.compile(f"(?:{chars(0xC2, 0xDF)}{tail}|{chars(0xE0, 0xEF)}{tail}{{2}}|{chars(0xF0, 0xF4)}{tail}{{3}})+")


def _plausible(c: str) -> bool:
    o = ord(c)
    return (
        0xA0 <= o <= 0x17F
        or 0x386 <= o <= 0x3CE
        or 0x401 <= o <= 0x45F
        or 0x490 <= o <= 0x491
        or 0x5D0 <= o <= 0x5EA
        or 0x621 <= o <= 0x64A
        or 0x2010 <= o <= 0x203A
        or 0x20A0 <= o <= 0x20BF
        or 0x2100 <= o <= 0x23FF
        or 0x2500 <= o <= 0x27BF
        or 0x3000 <= o <= 0x30FF
        or 0x3400 <= o <= 0x9FFF
        or 0xAC00 <= o <= 0xD7A3
        or 0xF900 <= o <= 0xFAFF
        or 0xFE00 <= o <= 0xFFFD
        or 0x1F000 <= o <= 0x1FAFF
        or 0x200B <= o <= 0x200F
        or 0x80 <= o <= 0x9F
        or o in (0x300, 0x301, 0x303, 0x308, 0x30A, 0x30C, 0x327, 0x160, 0x2C6, 0x2DC)
    )


def _decode_span(raw: str, codec: str) -> str | None:
    back = _reverse(codec)
    try:
        out = bytes(back[c] for c in raw).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return out if all(map(_plausible, out)) else None


def _letters_beside(text: str, start: int, end: int) -> tuple[str, str]:
    return text[start - 1] if start else " ", text[end] if end < len(text) else " "


def _sure(text: str, m: re.Match, out: str, codec: str) -> bool:
    """A span that is damage by itself, without other damage on the page."""
    raw = m.group()
    if raw[0] in PROOF[codec]:
        return True
    if len(out) >= 2:
        return codec in ("cp1252", "cp1251") or not raw.isalpha()
    before, after = _letters_beside(text, m.start(), m.end())
    if len(raw) >= 3:
        return not raw.isalpha() and codec not in ("koi8_r", "cp866")
    if codec == "cp1251":  # two Cyrillic characters inside a Latin word
        latin = (before.isascii() and before.isalpha()) or (after.isascii() and after.isalpha())
        return out.isalpha() and ord(out) < 0x180 and latin and not ("Ѐ" <= after <= "ӿ" or "Ѐ" <= before <= "ӿ")
    if codec == "cp1252":
        return out.isalpha() and ord(out) < 0x460 and after.isascii() and after.islower() and not raw.isalpha()
    return False


def _utf8(text: str, kinds: set[str]) -> str:
    """Decode the spans of the encoding that explains most of the text, if any of its spans is sure damage."""
    best: tuple[int, str, list] | None = None
    for codec in CODECS:
        spans = [(m, out) for m in _automaton(codec).finditer(text) if (out := _decode_span(m.group(), codec)) is not None]
        if codec in ("koi8_r", "cp866"):  # letters of these two are ordinary Russian
            spans = [x for x in spans if not x[0].group().isalpha()]
        if spans and any(_sure(text, m, out, codec) for m, out in spans):
            size = sum(m.end() - m.start() for m, _ in spans)
            if best is None or size > best[0]:
                best = size, codec, spans
    if best is None:
        return text
    _, codec, spans = best
    kinds.add(f"utf-8 as {codec}")
    parts, at = [], 0
    for m, out in spans:
        parts += [text[at : m.start()], out]
        at = m.end()
    return "".join(parts) + text[at:]


_EUC = re.compile("(?:\x8f[\xa1-\xfe]{2}|\x8e[\xa1-\xdf]|[\xa1-\xfe]{2})+")
_EUC_KANA = re.compile("[¤¥][\xa1-\xf6]")
#: three kana in a row; single ones also come from UTF-8 read in other encodings
_SJIS_KANA = re.compile("(?:‚[Ÿ\xa0-\xf1]|ƒ[@-~]){3}")


@lru_cache(None)
def _sjis() -> re.Pattern:
    lead = "".join(re.escape(c) for c, b in _reverse("cp1252").items() if 0x81 <= b <= 0x9F or 0xE0 <= b <= 0xFC)
    tail = "".join(re.escape(c) for c, b in _reverse("cp1252").items() if 0x80 <= b <= 0xFC)
    return re.compile(f"(?:[{lead}][@-~{tail}])+")


def _japanese(text: str, kinds: set[str]) -> str:
    """Maximal well-formed spans of the two- and three-byte codes, on pages whose spans are kana in good part."""
    if len(_EUC_KANA.findall(text)) >= 3:
        spans = "".join(_EUC.findall(text))
        out = [_or_same(x, "latin-1", "euc_jp") for x in _EUC.findall(text)]
        good = sum(1 for x in out for c in x if "぀" <= c <= "ヿ")
        if good >= 0.1 * len(spans):
            kinds.add("euc_jp as latin-1")
            text = _EUC.sub(lambda m: _or_same(m.group(), "latin-1", "euc_jp"), text)
    if _SJIS_KANA.search(text):
        back = _reverse("cp1252")

        def decode(raw: str) -> str:
            try:
                return bytes(back.get(c, ord(c)) for c in raw).decode("shift_jis")
            except (UnicodeDecodeError, ValueError):
                return raw

        spans = _sjis().findall(text)
        good = sum(1 for x in spans for c in decode(x) if "぀" <= c <= "ヿ")
        if good >= 0.1 * sum(map(len, spans)):
            kinds.add("shift_jis as cp1252")
            text = _sjis().sub(lambda m: decode(m.group()), text)
    return text


def _or_same(raw: str, read_as: str, codec: str) -> str:
    try:
        return raw.encode(read_as).decode(codec)
    except UnicodeError:
        return raw


_HIGH_RUN = re.compile("[\xc0-\xff\xa8\xb8\xa3\xb3]{4,}")
_HIGH_WORD = re.compile("(?<![A-Za-z])[\xc0-\xff\xa8\xb8\xa3\xb3]+(?![A-Za-z])")
_CYRILLIC = re.compile("[Ѐ-ӿ]+")
_INVERSE = re.compile("(?<![Ѐ-ӿ])[а-яё][А-ЯЁЈ]{3,}(?![Ѐ-ӿ])")
_MIXED = re.compile("[A-Za-z]*(?:[A-Za-z][Ѐ-ӿ]{1,3}|(?<![A-Za-zЀ-ӿ])[Ѐ-ӿ]{1,2}(?=[a-z]{2}))[A-Za-zЀ-ӿ]*")
#: Mac bytes read as Windows ones: symbols inside words, quotes as capitals around words, a right quote inside a word.
_MAC = re.compile("[A-Za-z][§‡ŽŸˆ‰•¿¯ƒ\x8d\x8f\x90\x9d][a-z]|\\b[a-z]+Õ(?:s|t|re|ll|ve)\\b|Ò[A-Za-z][^\\sÒÓ]*(?: [^ÒÓ\\n]{0,80})?Ó|(?:^|\\s)[§Ÿ‡Ž][a-z]{2,}|[a-z]{2,}[§‡Žˆ‰](?=[\\s.,;:)<])", re.M)
_MAC_CHARS = "‡ˆ‰ŠŽŸšœ•–—˜™›žÐÑÒÓÔÕÉ§¿¯Œƒ†\x8d\x8f\x90\x9d\x81’‘“”"


_PLAIN_GREEK = str.maketrans("άέήίόύώϊϋς", "αεηιουωιυσ")


def _pairs(word: str, common: frozenset[str]) -> float:
    w = word.lower().translate(_PLAIN_GREEK)
    return sum(w[i : i + 2] in common for i in range(len(w) - 1)) / max(1, len(w) - 1)


def _russian(word: str) -> float:
    return _pairs(word, RUSSIAN)


def _cased(words: list[str]) -> float:
    """Share of words that are lower, upper or title case."""
    return sum(w.islower() or w.isupper() or w.istitle() for w in words) / max(1, len(words))


def _best(words: list[str], read_as: str, codecs: tuple[str, ...]) -> tuple[str, dict[str, str]] | None:
    best = None
    for codec in codecs:
        out = {w: _or_same(w, read_as, codec) for w in words}
        changed = [v for w, v in out.items() if v != w and v.isalpha()]
        if len(changed) < 0.8 * len(words):
            continue
        common = GREEK if codec == "cp1253" else RUSSIAN
        score = sum(_pairs(v, common) * len(v) for v in changed) / sum(map(len, changed)) * _cased(changed)
        if score > 0.15 and (best is None or score > best[0]):
            best = (score, codec, out)
    return best and (best[1], best[2])


def _high(text: str, kinds: set[str]) -> str:
    """Cyrillic or Greek bytes read as Latin-1: four letters above ASCII in a row are no word of a Latin script."""
    if _HIGH_RUN.search(text):
        words = list(dict.fromkeys(_HIGH_WORD.findall(text)))
        if (best := _best(words, "latin-1", ("cp1251", "koi8_r", "cp1253", "iso8859_5"))) is not None:
            kinds.add(f"{best[0]} as latin-1")
            text = _HIGH_WORD.sub(lambda m: best[1][m.group()], text)
    return text


def _single(text: str, kinds: set[str]) -> str:
    inverse = _INVERSE.findall(text)
    if inverse:
        words = list(dict.fromkeys(_CYRILLIC.findall(text)))
        now = sum(map(_russian, words)) / len(words)
        for read_as, codec in (("cp1251", "koi8_r"), ("koi8_r", "cp1251")):
            out = {w: _or_same(w, read_as, codec) for w in words}
            if sum(map(_russian, out.values())) / len(words) > max(0.15, 1.5 * now):
                kinds.add(f"{codec} as {read_as}")
                text = _CYRILLIC.sub(lambda m, out=out: out[m.group()], text)
                break
    mixed = [m.group() for m in _MIXED.finditer(text)]
    if mixed:

        def latin(word: str) -> str:
            out = _or_same(word, "cp1251", "cp1252")
            return out if out.isalpha() and all(c < "Ѐ" for c in out) else word

        if any(latin(w) != w and any("Ѐ" <= c <= "ӿ" and c not in LOOK_ALIKE for c in w) for w in mixed):
            kinds.add("cp1252 as cp1251")
            text = _MIXED.sub(lambda m: latin(m.group()), text)
    if _MAC.search(text):
        kinds.add("mac_roman as cp1252")
        back = _reverse("cp1252")
        table = {ord(c): bytes([back[c]]).decode("mac_roman") for c in _MAC_CHARS if c in back}
        text = "\n".join(line.translate(table) if _MAC.search(line) else line for line in text.split("\n"))  # other lines may be sound
    return text


def restore(text: str) -> tuple[str, set[str]]:
    """The text with what is damaged restored as far as possible, and the kinds of damage found (empty: none)."""
    kinds: set[str] = set()
    if text.isascii():
        return text, kinds
    text = _high(_japanese(text, kinds), kinds)
    for _ in range(ROUNDS):
        before = text
        text = _utf8(text, kinds)
        if text == before:
            break
    text = _single(text, kinds)
    if "\ufffd" in text:
        kinds.add("lost characters")
    return text, kinds


def damage(visible: str) -> set[str]:
    """The kinds of damage in a text, from its distinct words with characters outside ASCII."""
    words = dict.fromkeys(w for line in visible.split("\n") for w in line.split(" ") if not w.isascii())
    return restore(" ".join(words))[1] if words else set()


_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,31});")


def _decoded(content: str) -> str:
    """Content with the references to characters outside ASCII decoded; markup characters stay escaped."""

    def one(m: re.Match) -> str:
        char = html.unescape(m.group())
        return m.group() if char.isascii() or char == m.group() else char

    return _REFERENCE.sub(one, content) if "&" in content else content


def _rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for batch in batches:
        out: dict[str, list] = {"id": batch["id"], "content": [], "kinds": []}
        for content in batch["content"]:
            kinds: set[str] = set()
            if content and (not content.isascii() or "&" in content):
                kinds = damage(visible_text(content))
                if kinds:
                    content = restore(_decoded(content))[0]
            out["content"].append(content)
            out["kinds"].append(sorted(kinds))
        yield out


def _kinds(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for batch in batches:
        found = [(i, sorted(damage(visible_text(c)))) for i, c in zip(batch["id"], batch["content"]) if c and (not c.isascii() or "&" in c)]
        found = [x for x in found if x[1]]
        yield {"id": [x[0] for x in found], "kinds": [x[1] for x in found]}


def garbled_pages(pages: DataFrame, id_col: str = "page_id", text_col: str = "content") -> DataFrame:
    """``(id, kinds)`` of the records with any garbled text."""
    return map_columns(pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content")), ["id", "content"], _kinds, "id long, kinds array<string>")


def restored_pages(pages: DataFrame, id_col: str = "page_id", text_col: str = "content") -> DataFrame:
    """``(id, content, kinds)`` of every record: content restored as far as possible, kinds empty where nothing was garbled."""
    return map_columns(pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content")), ["id", "content"], _rows, "id long, content string, kinds array<string>")
