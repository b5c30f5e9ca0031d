"""Function words by language, and how much of a text they make up (fixed values)."""

from __future__ import annotations

import re
from collections import Counter

#: Common function words, casefolded.
FUNCTION_WORDS = {
    "en": "the a an of to in on at by for from with and or but is are was were be been it its that this these those which who whom whose as not no than then there here how what when where why if into over about after before between during while will would can could should may must has have had do does did we you he she they i our your his her their one all each every some any more most also only very",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber ist sind war waren wird werden wurde hat haben hatte mit von zu zum zur im in an am auf aus bei nach vor für über unter durch gegen ohne um als wie ob dass nicht kein keine sich es er sie wir ihr ich man auch noch nur sehr wenn während bis seit können kann müssen muss diese dieser dieses",
    "fr": "le la les l un une des du de d et ou mais est sont était a ont été être avec pour par sur sous dans en au aux à ce cet cette ces qui que qu dont où il elle on nous vous ils elles se s ne n pas plus sa son ses leur leurs si même après avant chez entre comme dès déjà",
    "es": "el la los las un una unos unas de del y e o u pero es son era fue fueron ha han ser con por para sin sobre en a al que quien cual cuyo como cuando donde se su sus lo le les no más muy también ya si entre hasta desde según habrá está uno",
    "pt": "o a os as um uma uns umas de do da dos das e ou mas é são foi foram ser com por para sem sobre em no na nos nas ao à que quem qual como quando onde se seu sua seus não mais muito também já até desde segundo será além",
    "it": "il lo la gli le un una di del della dei e o ma è sono era con per senza su in al che chi come quando dove si non più molto anche già",
    "nl": "de het een en of maar is zijn was met voor van op in aan bij naar uit dat die dit niet ook nog als om te door over",
    "ru": "и в во не на что он она оно они с со как а то все но да ты к у же вы за бы по только ее его мне было вот от меня о из ему при после для до их или чтобы если про где когда это был была были есть очень каждый каждая вместо",
    "el": "ο η το οι τα του της των τον την τους τις στο στη στην στον στις και ή αλλά είναι ήταν με για από σε που πως ότι να θα δεν μη ένα μια μετά πριν κάθε όταν αν",
}
SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
#: Words that join nouns into one name ("sécurité des réseaux"); they say nothing about sentences.
CONNECTIVES = frozenset("de des du d del di da do dos das".split())
ANY = frozenset().union(*SETS.values()) - CONNECTIVES
#: Japanese and Chinese particles and endings; these scripts write no spaces.
_PARTICLE = re.compile("[はをのにがでとへも]|です|ます|的|了|是")
_WIDE = re.compile("[぀-ヿ㐀-鿿]")


def language(counts: Counter) -> str:
    """The language whose function words are most frequent, ``ja`` for wide scripts, ``-`` for none."""
    best, name = 0.0, "-"
    for code, known in SETS.items():
        n = sum(counts[w] for w in known & counts.keys())
        if n > best:
            best, name = n, code
    return "ja" if sum(n for w, n in counts.items() if _PARTICLE.fullmatch(w)) > best else name


def _wide(text: str) -> int:
    return 0 if text.isascii() else len(_WIDE.findall(text))


def spaceless(text: str) -> bool:
    """Whether any of the text is in a script without spaces."""
    return not text.isascii() and _WIDE.search(text) is not None


def units(text: str, words: list[str]) -> float:
    """Size of a line in words; a script without spaces has about one in 2.5 characters."""
    wide = _wide(text)
    return wide / 2.5 if wide > 0.3 * len(text) else float(len(words))


def function_words(text: str, words: list[str]) -> list[str]:
    """The function words of a line in order; particles, for text in a script without spaces."""
    if _wide(text) > 0.3 * len(text):
        return _PARTICLE.findall(text)
    return [w for w in words if w in ANY]
