"""What a block is, and HTML documents as blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .html import HEADINGS, Parsed, Tag, kept_texts, parse

#: Id code and sync role of each kind of block.
KINDS = {
    "heading-1": ("h1", "anchor"), "heading-2": ("h2", "anchor"), "heading-3": ("h3", "anchor"), "heading-4": ("h4", "anchor"), "heading-5": ("h5", "anchor"), "heading-6": ("h6", "anchor"),
    "paragraph": ("p", "anchor"), "table": ("t", "anchor"), "code-block": ("c", "anchor"), "list-item": ("li", "anchor"), "blockquote": ("q", "container"), "thematic-break": ("hr", "non-sync"),
    "image": ("img", "anchor"), "title": ("title", "non-sync"), "html": ("html", "anchor"), "skipped": ("x", "anchor"),
}
UNTRANSLATED = ("thematic-break", "image", "skipped")
CONTAINERS = frozenset("html body div section article main nav aside header footer hgroup figure details form fieldset search center ul ol menu dl".split())
SILENT = frozenset("script style link meta base".split())
PHRASING = frozenset(
    "a abbr audio b bdi bdo br button canvas cite code data del dfn em embed i img input ins kbd label mark math object optgroup option output picture q rp rt ruby s samp select small span "
    "strong sub sup svg textarea time u var video wbr".split()
)
LEAVES = {"p": "paragraph", "figcaption": "paragraph", "table": "table", "pre": "code-block", "blockquote": "blockquote"} | {h: f"heading-{h[1]}" for h in HEADINGS}
SPACES = b" \t\n\f\r"
BOM = "﻿".encode()


@dataclass
class Block:
    kind: str
    start: int
    end: int
    spelling: str = "markdown"
    info: str | None = None
    fenced: bool | None = None
    ordered: bool | None = None
    task: bool | None = None
    label: str | None = None
    html_type: int | None = None
    path: list[int] = field(default_factory=list)
    block_id: str = ""
    section: list[str] = field(default_factory=list)

    @property
    def level(self) -> int | None:
        return int(self.kind[-1]) if self.kind.startswith("heading-") else None


@dataclass
class Document:
    raw: bytes
    blocks: list[Block] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    ref_defs: str = ""
    too_deep: bool = False
    texts: list[int] = field(default_factory=list)  # places of an HTML document's text segments


def block_id(kind: str, ordinal: int) -> str:
    return f"{KINDS[kind][0]}-{ordinal:04d}"


def number(doc: Document) -> Document:
    """Gives blocks their ids and section paths: the ids of the open headings; a heading's own path excludes itself."""
    open_: list[tuple[int, str]] = []
    for i, b in enumerate(doc.blocks, 1):
        b.block_id = block_id(b.kind, i)
        if b.level:
            while open_ and open_[-1][0] >= b.level:
                open_.pop()
        b.section = [x for _, x in open_]
        if b.level:
            open_.append((b.level, b.block_id))
    return doc


class _Region:
    """Walks a document's tags; containers nest, everything else makes blocks or runs of text."""

    def __init__(self, p: Parsed) -> None:
        self.p, self.at, self.i, self.doc = p, p.at(), 0, Document(p.raw)

    def run(self, start: int, end: int, path: list[int], count: list[int], tags: list[Tag]) -> None:
        """Text and phrasing between two places, as a paragraph or an image."""
        skips = [(t.start, t.end) for t in tags if t.kind == "skip"]
        raw = self.p.raw
        firsts, lasts = dict(skips), {e: s for s, e in skips}
        while start < end:
            if raw[start : start + 1] in (b" ", b"\t", b"\n", b"\f", b"\r"):
                start += 1
            elif raw.startswith(BOM, start):
                start += len(BOM)
            elif start in firsts and firsts[start] <= end:
                start = firsts[start]
            else:
                break
        while end > start:
            if raw[end - 1] in SPACES:
                end -= 1
            elif raw.endswith(BOM, start, end):
                end -= len(BOM)
            elif end in lasts and lasts[end] >= start:
                end = lasts[end]
            else:
                break
        if start >= end:
            return
        bare, at = [], start
        for t in tags:
            if t.end > start and t.start < end:
                bare.append(raw[at : max(at, t.start)])
                at = max(at, t.end)
        bare.append(raw[at:end] if at < end else b"")
        if b"".join(bare).decode("utf-8", "replace").replace("﻿", "").strip():
            self.emit("paragraph", start, end, path, count)
        elif any(t.kind == "open" and t.name == "img" for t in tags):
            self.emit("image", start, end, path, count)

    def emit(self, kind: str, start: int, end: int, path: list[int], count: list[int], **more) -> Block:
        b = Block(kind, start, end, "html", path=[*path, count[0]], **more)
        count[0] += 1
        self.doc.blocks.append(b)
        return b

    def leaf(self, tag: Tag, kind: str, path: list[int], count: list[int], **more) -> int:
        """A block of the whole element; gives the place where it is consumed to."""
        e = self.at.get(tag.start)
        if e is None:
            self.emit(kind, tag.start, tag.end, path, count, **more)
            return tag.end
        end = e.end
        if not e.close:
            while end > tag.end and self.p.raw[end - 1] in SPACES:
                end -= 1
        self.emit(kind, tag.start, end, path, count, **more)
        if not e.close:
            where = "was still open at end of input and was force-closed" if e.content_end >= len(self.p.raw) else f"has no end tag and was closed implicitly at byte {e.content_end}"
            self.doc.warnings.append(f"html: <{e.name}> ({block_id(kind, len(self.doc.blocks))}) {where}")
        return e.end

    def skip_to(self, place: int) -> None:
        while self.i < len(self.p.tags) and self.p.tags[self.i].start < place:
            self.i += 1

    def head(self, end: int, path: list[int], count: list[int]) -> int:
        """The head: only the title is a block. A body start tag ends it early."""
        tags, done = self.p.tags, 0
        while self.i < len(tags) and tags[self.i].start < end:
            t = tags[self.i]
            if t.kind == "open" and t.name == "body":
                return t.start
            self.i += 1
            if t.kind == "open" and t.start in self.at:
                done = self.leaf(t, "title", path, count) if t.name == "title" else self.at[t.start].end
                self.skip_to(done)
        return max(end, done)

    def region(self, start: int, end: int, container: str, path: list[int]) -> None:
        tags, count, held, from_ = self.p.tags, [0], [], start
        while self.i < len(tags) and tags[self.i].start < end:
            t = tags[self.i]
            self.i += 1
            if t.kind == "skip":
                held.append(t)
                continue
            if t.name in PHRASING:
                held.append(t)
                hold = self.at[t.start].end if t.kind == "open" and t.start in self.at else 0
                while self.i < len(tags) and tags[self.i].start < hold:  # all in it belongs to the run
                    inner = tags[self.i]
                    held.append(inner)
                    if inner.kind == "open" and inner.start in self.at:
                        hold = max(hold, self.at[inner.start].end)
                    self.i += 1
                continue
            self.run(from_, t.start, path, count, held)
            held, from_ = [], t.end
            e = self.at.get(t.start) if t.kind == "open" else None
            if t.kind == "close":
                continue
            if t.name == "head":
                if e:
                    own = [*path, count[0]]
                    count[0] += 1
                    from_ = self.head(e.end, own, [0])
            elif t.name in CONTAINERS:
                if e:
                    own = [*path, count[0]]
                    count[0] += 1
                    self.region(t.end, e.content_end, t.name, own)
                    from_ = max(t.end, e.end)
                    self.skip_to(from_)
                    if not e.close and e.content_end >= len(self.p.raw):
                        self.doc.warnings.append(f"html: <{t.name}> was still open at end of input and was force-closed")
            elif t.name in SILENT:
                from_ = e.end if e else t.end
                self.skip_to(from_)
            elif t.name == "hr":
                self.emit("thematic-break", t.start, t.end, path, count)
            elif t.name == "li" and container in ("ul", "ol", "menu"):
                from_ = self.leaf(t, "list-item", path, count, ordered=container == "ol")
                self.skip_to(from_)
            else:
                from_ = self.leaf(t, LEAVES.get(t.name, "html"), path, count, **({"fenced": True} if t.name == "pre" else {}))
                self.skip_to(from_)
        self.run(from_, end, path, count, held)


def html_document(text: str) -> Document:
    """An HTML document as leaf blocks in source order."""
    p = parse(text.replace("\0", "�"))
    r = _Region(p)
    if p.breach is not None:
        r.doc.too_deep = True
        return r.doc
    r.region(0, len(p.raw), "", [])
    r.doc.texts = [s[0] for s in kept_texts(p)]
    return number(r.doc)


def html_marker(text: str, window: int = 4096) -> str | None:
    """The marker that shows a text to be an HTML document, looked for after a byte order mark, blank lines and comments."""
    raw = text.encode()[:window].decode("utf-8", "ignore").lstrip("﻿")
    m = re.match(r"(?:\s*\n)?(?: {0,3})(?:<!--.*?-->(?:\s*\n)?(?: {0,3}))*(<!doctype|<html)(?=[>\s]|\Z)", raw, re.S | re.I)
    return m[1].lower() if m else None
