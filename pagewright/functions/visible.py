"""Visible text of a page and the terms in it (plain Python, run inside Arrow batches).

Visible text is the content without comments, without ``script``, ``style`` and
``noscript`` elements and their content, with every other tag replaced by a
space, and then with character references decoded.  Nulls and empty contents
have no visible text (``""``).
"""

from __future__ import annotations

import html
import re

HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript)\b[^>]*>.*?</\1\s*>", re.S | re.I)
TAG = re.compile(r"<[A-Za-z/!][^>]*>")
#: Applied to text in which ``_`` is a space: ``\\w`` is then letters and digits (Unicode L and N).
TERM = re.compile(r"\w+")
#: Characters whose casefold has a combining mark, so that folding before cutting would split a term.
_MARKED = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x2000)) if not c.casefold().isalnum() and c.isalnum()) + "]")


def _blank(match: re.Match) -> str:
    """Keep the line breaks of what is cut, so that line numbers stay."""
    return "\n" * match.group(0).count("\n")


def strip_markup(content: str | None) -> str:
    """Content without hidden parts and tags; references are not decoded yet."""
    if not content:
        return ""
    if "<" not in content:
        return content
    return TAG.sub(" ", HIDDEN.sub(_blank, content))


def visible_text(content: str | None) -> str:
    text = strip_markup(content)
    return html.unescape(text) if "&" in text else text


def visible_lines(content: str | None) -> list[str]:
    """Visible text of each line, numbered as ``content.split("\\n")``."""
    return [html.unescape(line) if "&" in line else line for line in strip_markup(content).split("\n")]


def terms(content: str | None) -> list[str]:
    """Maximal runs of letters and digits of the visible text, casefolded, in order."""
    return text_terms(visible_text(content))


def text_terms(text: str) -> list[str]:
    """Terms of a plain text."""
    text = text.replace("_", " ")
    if text.isascii() or not _MARKED.search(text):
        return TERM.findall(text.casefold())
    return [t.casefold() for t in TERM.findall(text)]
