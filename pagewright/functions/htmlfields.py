"""Fields of a (possibly broken) HTML page: visible text, title, snippet, term counts.

A small tree builder over the standard library's parser: start tags nest, an end
tag closes up to the nearest open tag of its name and is ignored if there is none,
void elements hold nothing, and script, style and noscript elements are left out.
Every text node is stripped; the nodes are joined by one space.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pagewright.functions.text import tokenize

#: Elements whose text counts as important, that are ignored, and that never hold text.
IMPORTANT = ("title", "h1", "h2", "h3", "b", "strong")
IGNORED = ("script", "style", "noscript")
UNREAD = ("template", "rt", "rp")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
TITLE_LENGTH, SNIPPET_LENGTH = 240, 320


@dataclass
class Fields:
    total: Counter = field(default_factory=Counter)
    important: Counter = field(default_factory=Counter)
    title: str = ""
    snippet: str = ""


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.visible: list[str] = []
        self.elements: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        texts = [] if tag in IMPORTANT else None
        if texts is not None and not self._within(IGNORED):
            self.elements.append((tag, texts))
        if tag not in VOID:
            self.open.append((tag, texts))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def _within(self, names) -> bool:
        return any(tag in names for tag, _ in self.open)

    def handle_data(self, data):
        text = data.strip()
        if not text or self._within(IGNORED) or self._within(UNREAD):
            return
        self.visible.append(text)
        for _, texts in self.open:
            if texts is not None:
                texts.append(text)


def snippet_of(text: str) -> str:
    return text if len(text) <= SNIPPET_LENGTH else text[:SNIPPET_LENGTH].rsplit(" ", 1)[0] + "…"


def document_fields(html: str | None) -> Fields:
    """All fields of a page; null and empty pages have none."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    visible = " ".join(" ".join(reader.visible).split())
    out = Fields(total=Counter(tokenize(visible)), snippet=snippet_of(visible))
    for _, texts in reader.elements:  # once for every important element, nested ones included
        out.important.update(tokenize(" ".join(texts)))
    for name in ("title", "h1"):
        texts = next((t for tag, t in reader.elements if tag == name), None)
        if texts is not None:
            out.title = " ".join(" ".join(texts).split())[:TITLE_LENGTH]
            break
    return out
