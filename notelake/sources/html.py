"""HTML notes to plain text: the standard library's parser on the executors, then regexes.

Kept: text of allowed elements, links as ``text (url)``, marks of strong, emphasised and code text, tables as
tab-separated lines and preformatted text as it is, both between fences. Headings are led by ``#``,
which is what chunking reads. Which part of a page is its article is a heuristic of its own kind and
not attempted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_BLOCKS = frozenset("p div section article header h1 h2 h3 h4 h5 h6 ul ol li table tr blockquote pre br hr".split())
_DROPPED = frozenset("script style noscript template nav footer aside form iframe svg head".split())


_MARKS = {"strong": "**", "em": "_", "code": "`"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []
        self.links: list[str | None] = []
        self.pre = self.tables = 0
        #: the next number of each open list; 0 for bullets
        self.lists: list[int] = []
        #: where the marks stand that aren't closed yet
        self.marks: list[tuple[str, int]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _DROPPED:
            self.hidden.append(tag)
        elif self.hidden:
            return
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
        elif tag in ("td", "th"):
            self.out.append("\t" if self.out and not self.out[-1].endswith("\n") else "")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "table":
            self.tables += 1
            self.out.append("\n\n```" if self.tables == 1 else "\n")
        elif tag in _MARKS and not self.pre and not self.tables:
            self.marks.append((tag, len(self.out)))
            self.out.append(_MARKS[tag])
        elif tag in ("ul", "ol"):
            self.lists.append(int(tag == "ol"))
            self.out.append("\n")
        elif tag == "li":
            self.out.append(f"\n{self.lists[-1]}. " if self.lists and self.lists[-1] else "\n- ")
            if self.lists and self.lists[-1]:
                self.lists[-1] += 1
        elif tag in _BLOCKS:
            self.out.append("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else ""))

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
        elif tag == "a" and self.links:
            url = self.links.pop()
            self.out.append(f" ({url})" if url else "")
        elif tag in ("pre", "table"):
            name = "pre" if tag == "pre" else "tables"
            held = getattr(self, name)
            setattr(self, name, max(0, held - 1))
            self.out.append("\n```\n\n" if held == 1 or (held and tag == "pre") else "\n")
        elif tag in _MARKS and tag in [t for t, _ in self.marks]:
            while (last := self.marks.pop())[0] != tag:
                self.out[last[1]] = ""
            self.out.append(_MARKS[tag])
        elif tag in ("ul", "ol"):
            del self.lists[-1:]
            self.out.append("\n")
        elif tag in _BLOCKS and tag not in ("li", "br", "hr", "tr"):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data.strip("\n") if self.pre else re.sub(r"\s+", " ", data) if data.strip() or not self.tables else "")


def to_text(html: str | None) -> str:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    for _, at in reader.marks:
        reader.out[at] = ""
    if reader.pre or reader.tables:
        reader.out.append("\n```")
    lines, fenced = [], False
    for x in "".join(reader.out).split("\n"):
        fenced ^= x == "```"
        lines.append(x.rstrip(" ") if fenced else re.sub(r" {2,}", " ", x).strip(" "))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_to_text(docs: DataFrame, column: str = "body") -> DataFrame:
    """The rows with HTML in ``column`` turned to text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            yield b.set_column(at, b.schema.field(at), pa.array([to_text(x.as_py()) for x in b.column(at)], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
