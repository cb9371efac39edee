"""Markdown (with tables, task lists, strikethrough and autolinks) as blocks, and the facts that validation compares.

parse_lines() is a recursive block parser over lines: a container gathers the lines that belong to it,
strips their prefix and parses them again. document() turns the top level into leaf blocks, a list into one
block for each direct item. Places are bytes of the source.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from .blocks import Block, Document, number
from .html import parse as parse_html
from .text import line_starts

DEEPEST = 128
THEMATIC = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})([.)]))(?=[ \t]|$)")
TASK = re.compile(r"\[([ xX])\](?=[ \t])")
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<][^\s]*)(?:[ \t]+\n?[ \t]*|[ \t]*\n[ \t]*)?(?:(?<=\s)(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?=\n|$)")
HTML_OPEN = [
    (1, re.compile(r" {0,3}<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (2, re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (3, re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (4, re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (5, re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (6, re.compile(r" {0,3}</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=[\s>]|/>|$)", re.I), None),
    (7, re.compile(r" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$"), None),
]


@dataclass
class Node:
    """first and last: places among the lines given; the lines of an item or quote without their prefix are parsed to children."""

    kind: str
    first: int
    last: int
    children: list[Node] = field(default_factory=list)
    level: int = 0
    info: str | None = None
    fenced: bool | None = None
    html_type: int | None = None
    ordered: bool | None = None
    start: int | None = None
    delimiter: str | None = None
    task: bool | None = None
    tight: bool = True
    text: str = ""
    cells: list[list[str]] = field(default_factory=list)
    align: list[str] = field(default_factory=list)


def indent(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def outdent(line: str, n: int) -> str:
    """The line without n columns of white space."""
    at = 0
    for i, c in enumerate(line):
        if at >= n or c not in " \t":
            return " " * (at - n) + line[i:] if at > n else line[i:]
        at += 1 if c == " " else 4 - at % 4
    return " " * max(0, at - n)


def cells(row: str) -> list[str]:
    """Cells of a table row."""
    row = row.strip()
    row = row[1:] if row.startswith("|") else row
    parts = re.split(r"(?<!\\)\|", row)
    if len(parts) > 1 and not parts[-1].strip():
        parts.pop()
    return [p.strip() for p in parts]


def delimiter_row(line: str) -> list[str] | None:
    if not re.fullmatch(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*", line) or not re.search(r"[|:-]", line):
        return None
    return [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c.startswith(":"), c.endswith(":")), "none") for c in cells(line)]


def html_start(line: str, in_paragraph: bool) -> tuple[int, re.Pattern | None] | None:
    if "<" not in line:
        return None
    return next(((k, end) for k, start, end in HTML_OPEN if not (k == 7 and in_paragraph) and start.match(line)), None)


def interrupts(line: str) -> bool:
    """Whether the line begins a block that may follow a paragraph without a blank line."""
    if indent(line) >= 4:
        return False
    m = ITEM.match(line)
    item = m and line[m.end() :].strip() and m[3] in (None, "1")
    return bool(item or QUOTE.match(line) or ATX.match(line) or THEMATIC.match(line) or FENCE.match(line) or html_start(line, True))


def _open_paragraph(nodes: Sequence[Node], lines: Sequence[str]) -> bool:
    """Whether the last leaf is a paragraph that its last line leaves open."""
    while nodes:
        last = nodes[-1]
        if last.kind in ("paragraph", "table"):
            return last.kind == "paragraph" and bool(lines) and bool(lines[-1].strip())
        nodes = last.children
    return False


def parse_lines(lines: Sequence[str], refs: dict[str, str] | None = None, depth: int = 0) -> list[Node]:
    out: list[Node] = []
    refs = {} if refs is None else refs
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if indent(line) >= 4:
            j = last = i
            while j < n and (not lines[j].strip() or indent(lines[j]) >= 4):
                last = j if lines[j].strip() else last
                j += 1
            out.append(Node("code-block", i, last, fenced=False, text="\n".join(outdent(x, 4) for x in lines[i : last + 1])))
            i = last + 1
        elif m := FENCE.match(line):
            close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            j = next((j for j in range(i + 1, n) if close.match(lines[j])), n)
            out.append(Node("code-block", i, min(j, n - 1), fenced=True, info=m[3] or None, text="\n".join(outdent(x, min(indent(x), len(m[1]))) for x in lines[i + 1 : j])))
            i = j + 1
        elif m := ATX.match(line):
            out.append(Node("heading", i, i, level=len(m[1]), text=(m[2] or "").strip()))
            i += 1
        elif THEMATIC.match(line):
            out.append(Node("thematic-break", i, i))
            i += 1
        elif found := html_start(line, False):
            kind, end = found
            j = i
            if end is None:
                while j + 1 < n and lines[j + 1].strip():
                    j += 1
            else:
                while j < n and not end.search(lines[j]):
                    j += 1
                j = min(j, n - 1)
            last = j
            while last > i and not lines[last].strip():
                last -= 1
            out.append(Node("html", i, last, html_type=kind, text="\n".join(lines[i : last + 1])))
            i = j + 1
        elif QUOTE.match(line):
            inner, j = [], i
            while j < n:
                if m := QUOTE.match(lines[j]):
                    inner.append(lines[j][m.end() :])
                elif lines[j].strip() and not interrupts(lines[j]) and _open_paragraph(parse_lines(inner, {}, depth + 1), inner):
                    inner.append(lines[j].lstrip())
                else:
                    break
                j += 1
            out.append(Node("blockquote", i, j - 1, parse_lines(inner, refs, depth + 1) if depth < DEEPEST else []))
            i = j
        elif ITEM.match(line):
            i = _list(lines, i, out, refs, depth)
        else:
            i = _paragraph(lines, i, out, refs)
    return out


def _list(lines: Sequence[str], i: int, out: list[Node], refs: dict[str, str], depth: int) -> int:
    m = ITEM.match(lines[i])
    kind = m[4] or m[2]
    whole = Node("list", i, i, ordered=m[3] is not None, start=int(m[3]) if m[3] else None, delimiter=m[4])
    loose, n = False, len(lines)
    while i < n and (m := ITEM.match(lines[i])) and (m[4] or m[2]) == kind and not THEMATIC.match(lines[i]):
        rest = lines[i][m.end() :]
        pad = indent(rest)
        width = len(m[1]) + len(m[2]) + (1 if not rest.strip() or pad > 4 else pad)
        inner, j, last = [outdent(" " * (len(m[1]) + len(m[2])) + rest, width)], i + 1, i
        while j < n:
            x = lines[j]
            if not x.strip():
                if not inner[0].strip() and len(inner) == 1:  # an empty item ends at a blank line
                    break
                inner.append("")
            elif indent(x) >= width:
                inner.append(outdent(x, width))
                last = j
            elif inner[-1].strip() and not interrupts(x) and not ITEM.match(x) and _open_paragraph(parse_lines(inner, {}, depth + 1), inner):
                inner.append(x.lstrip())
                last = j
            else:
                break
            j += 1
        blank_after = j > last + 1 and j < n
        body = inner[: last - i + 1]
        item = Node("item", i, last, ordered=whole.ordered)
        if t := TASK.match(body[0].lstrip()):
            item.task = t[1] != " "
            body[0] = body[0].lstrip()[t.end() :].lstrip()
        item.children = parse_lines(body, refs, depth + 1) if depth < DEEPEST else []
        loose |= any(a.last + 1 < b.first for a, b in zip(item.children, item.children[1:], strict=False))
        whole.children.append(item)
        whole.last = last
        i = j
        again = ITEM.match(lines[i]) if i < n else None
        if blank_after and again and (again[4] or again[2]) == kind and not THEMATIC.match(lines[i]):
            loose = True
    whole.tight = not loose
    out.append(whole)
    return whole.last + 1


def _paragraph(lines: Sequence[str], i: int, out: list[Node], refs: dict[str, str]) -> int:
    n, j = len(lines), i
    while j < n:
        x = lines[j]
        if j > i:
            if not x.strip():
                break
            if (s := SETEXT.match(x)) and indent(x) < 4:
                body, first = _definitions(lines, i, j, refs)
                if body:
                    out.append(Node("heading", first, j, level=1 if s[1][0] == "=" else 2, text="\n".join(b.strip() for b in body)))
                    return j + 1
                i = j
            elif interrupts(x):
                break
        if j + 1 < n and "|" in x + lines[j + 1] and (align := delimiter_row(lines[j + 1])) and len(align) == len(cells(x)) and indent(x) < 4:
            if j > i:
                body, first = _definitions(lines, i, j, refs)
                if body:
                    out.append(Node("paragraph", first, j - 1, text="\n".join(b.strip() for b in body)))
            k = j + 2
            while k < n and lines[k].strip() and not interrupts(lines[k]):
                k += 1
            out.append(Node("table", j, k - 1, align=align, cells=[cells(r) for r in [x, *lines[j + 2 : k]]]))
            return k
        j += 1
    body, first = _definitions(lines, i, j, refs)
    if body:
        out.append(Node("paragraph", first, j - 1, text="\n".join(b.strip() for b in body)))
    return j


def label_key(label: str) -> str:
    return " ".join(label.split()).casefold()


def _definitions(lines: Sequence[str], i: int, j: int, refs: dict[str, str]) -> tuple[list[str], int]:
    """The paragraph's lines without the link definitions that begin it, and its first line."""
    while i < j and lines[i].lstrip().startswith("["):
        m = DEFINITION.match("\n".join(lines[i:j]))
        if not m or not m[1].strip():
            break
        refs.setdefault(label_key(m[1]), m[2][1:-1] if m[2].startswith("<") else m[2])
        i += m[0].count("\n") + 1
    return list(lines[i:j]), i


def split_lines(raw: bytes) -> tuple[list[str], list[int], list[int]]:
    """Lines without their ends, and the places of their beginnings and ends."""
    starts = line_starts(raw)
    ends = [len(raw[s:e].rstrip(b"\r\n")) + s for s, e in zip(starts, [*starts[1:], len(raw)], strict=True)]
    return [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts, ends, strict=True)], starts, ends


IMAGE_ONLY = re.compile(r"!\[(?:[^\[\]\\]|\\.)*\](?:\([^()\s]*(?:\s+\"[^\"]*\")?\)|\[[^\]]*\])?")


def document(text: str) -> Document:
    """A Markdown document as leaf blocks in source order."""
    raw = text.replace("\0", "�").encode()
    doc, refs = Document(raw), {}
    if depth_bound(text) > DEEPEST:
        doc.too_deep = True
        return doc
    lines, starts, ends = split_lines(raw)

    def add(kind: str, node: Node, path: list[int], **more) -> None:
        first = lines[node.first]
        start = starts[node.first] + (0 if node.fenced is False else len(first[: len(first) - len(first.lstrip(" \t"))].encode()))
        doc.blocks.append(Block(kind, start, max(start, ends[node.last]), path=path, **more))

    for i, node in enumerate(parse_lines(lines, refs)):
        if node.kind == "list":
            for k, item in enumerate(node.children):
                add("list-item", item, [i, k], ordered=node.ordered, task=item.task)
                if not item.children:
                    doc.warnings.append(f"markdown: list item at byte {doc.blocks[-1].start} is empty")
        elif node.kind == "heading":
            add(f"heading-{node.level}", node, [i])
        elif node.kind == "paragraph":
            add("image" if IMAGE_ONLY.fullmatch(node.text) or (node.text.startswith("![") and not IMAGE_ONLY.sub("", node.text).strip()) else "paragraph", node, [i])
        elif node.kind == "html":
            add("html", node, [i], html_type=node.html_type, spelling="html")
        elif node.kind == "code-block":
            add("code-block", node, [i], info=node.info, fenced=node.fenced)
        else:
            add(node.kind, node, [i])
    doc.ref_defs = reference_gaps(doc)
    return number(doc)


def gaps(doc: Document) -> list[tuple[int, int]]:
    """The ranges before, between and after blocks."""
    out, at = [], 0
    for b in doc.blocks:
        out.append((at, max(at, b.start)))
        at = max(at, b.end)
    return [*out, (at, len(doc.raw))]


def pure_definitions(gap: str) -> bool:
    lines = [x for x in gap.splitlines() if x.strip()]
    at, body = 0, "\n".join(lines)
    while at < len(body):
        m = DEFINITION.match(body, at)
        if not m:
            return False
        at = m.end() + 1
    return bool(lines)


def reference_gaps(doc: Document) -> str:
    """The gaps that are link definitions only, a line each."""
    found = [doc.raw[a:b].decode("utf-8", "replace") for a, b in gaps(doc)]
    return "\n".join(g.strip("\r\n") for g in found if g.strip() and pure_definitions(g))


def references(text: str) -> dict[str, str]:
    refs: dict[str, str] = {}
    parse_lines(split_lines(text.encode())[0], refs)
    return refs


def depth_bound(text: str) -> int:
    """An upper bound of how deep containers nest on any line."""
    worst = 0
    for line in text.splitlines():
        head = re.match(r"(?:[ \t]*(?:>|[-+*](?=[ \t]|$)|\d{1,9}[.)](?=[ \t]|$)))*", line)[0]
        worst = max(worst, len(re.findall(r">|[-+*]|\d+[.)]", head)) + indent(line) // 2)
    return worst


# --- facts about fragments ---


def table_facts(text: str) -> tuple[int, list[str], int] | None:
    """Columns, alignments and body rows of a fragment that is a table."""
    node = next(iter(parse_lines(split_lines(text.encode())[0])), None)
    return (len(node.align), node.align, len(node.cells) - 1) if node and node.kind == "table" else None


def table_rows(text: str) -> tuple[str, str, list[str]] | None:
    """Header, delimiter and body rows, with their line ends."""
    if table_facts(text) is None:
        return None
    lines = text.splitlines(keepends=True)
    return lines[0], lines[1], [x for x in lines[2:] if x.strip()]


def label_of(node: Node) -> str:
    return f"heading-{node.level}" if node.kind == "heading" else ("ordered-list" if node.ordered else "bullet-list") if node.kind == "list" else node.kind


def list_topology(text: str) -> list[dict] | None:
    """Items in pre-order with depth, order, task state, start, delimiter, tightness and the kinds of their children."""
    first = next(iter(parse_lines(split_lines(text.encode())[0])), None)
    if first is None or first.kind != "list":
        return None
    out: list[dict] = []

    def visit(node: Node, depth: int) -> None:
        for item in node.children:
            out.append({"depth": depth, "ordered": bool(node.ordered), "task": item.task, "child_kinds": [label_of(c) for c in item.children], "start": node.start, "delimiter": node.delimiter, "tight": node.tight})
            for c in item.children:
                if c.kind == "list":
                    visit(c, depth + 1)

    visit(first, 0)
    return out


def quote_children(text: str) -> list[str] | None:
    first = next(iter(parse_lines(split_lines(text.encode())[0])), None)
    return [label_of(c) for c in first.children] if first and first.kind == "blockquote" else None


CODE_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\([^\s()]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
REFERENCE = re.compile(r"!?\[((?:[^\[\]\\]|\\.)*)\](?:\[((?:[^\[\]\\]|\\.)*)\])?(?!\()")
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
BARE_URL = re.compile(r"(?<![\w/\"'<(])(?:https?://|www\.)[^\s<>\"'`)\]]+(?<![.,:;!?])")
INLINE_HTML = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|<\?.*?\?>", re.S)


@dataclass
class Inline:
    destinations: list[str] = field(default_factory=list)
    code: list[str] = field(default_factory=list)
    html: list[str] = field(default_factory=list)


def inline(text: str, refs: dict[str, str] | None = None) -> Inline:
    """Destinations in order, code spans, and inline HTML in order."""
    out, found, taken = Inline(), [], []
    free = lambda m: not any(a < m.end() and m.start() < b for a, b in taken)
    for m in CODE_SPAN.finditer(text):
        out.code.append(m[2].replace("\n", " "))
        taken.append(m.span())
    for pattern in (AUTOLINK, INLINE_HTML):
        for m in pattern.finditer(text):
            if free(m):
                taken.append(m.span())
                found.append((m.start(), "to" if pattern is AUTOLINK else "html", m[1] if pattern is AUTOLINK else m[0]))
    codes = list(taken)
    for m in LINK.finditer(text):
        if not any(a <= m.start() < b for a, b in codes):
            taken.append(m.span())
            found.append((m.start(), "to", m[3].strip("<>")))
    for m in REFERENCE.finditer(text):
        key = label_key(m[2] or m[1])
        if refs and key in refs and free(m):
            taken.append(m.span())
            found.append((m.start(), "to", refs[key]))
    for m in BARE_URL.finditer(text):
        if free(m):
            found.append((m.start(), "to", m[0]))
    for _, kind, value in sorted(found):
        (out.destinations if kind == "to" else out.html).append(value)
    return out


def plain_text(text: str, refs: dict[str, str] | None = None) -> str:
    """A heading's text without marks; soft breaks are spaces."""
    codes: list[str] = []

    def held(m: re.Match) -> str:  # marks around a code span, as of a link, are read without it
        codes.append(m[2].strip())
        return f"\ue000{len(codes) - 1}\ue001"

    plain = _plain(CODE_SPAN.sub(held, text.replace("\ue000", "")), refs)
    return re.sub("\ue000(\\d+)\ue001", lambda m: codes[int(m[1])], plain).replace("\n", " ").strip()


def visible_body(fragment: str, refs: dict[str, str] | None = None) -> str:
    """The plain text of a fragment without the marks of its blocks: headings, list items and quotes."""

    def texts(nodes: list[Node]) -> list[str]:
        return [x for n in nodes for x in (texts(n.children) if n.children else [n.text or ""])]

    nodes = parse_lines(split_lines(fragment.encode())[0])
    if all(n.kind in ("heading", "list", "blockquote") for n in nodes):
        return " ".join(plain_text(t, refs) for t in texts(nodes))
    return plain_text(fragment, refs)


def _plain(text: str, refs: dict[str, str] | None) -> str:
    text = LINK.sub(lambda m: m[2], text)
    text = REFERENCE.sub(lambda m: m[1] if refs and label_key(m[2] or m[1]) in refs else m[0], text)
    text = INLINE_HTML.sub("", AUTOLINK.sub(lambda m: m[1], text))
    text = re.sub(r"(?<!\\)(\*\*|__|~~|\*|(?<!\w)_|_(?!\w))", "", text)
    return entities.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text))


def heading_text(fragment: str, refs: dict[str, str] | None = None) -> str:
    first = next(iter(parse_lines(split_lines(fragment.encode())[0])), None)
    return plain_text(first.text, refs) if first else ""


def code_multiset_equal(a: Sequence[str], b: Sequence[str]) -> bool:
    return Counter(a) == Counter(b)


def fence(body: str, info: str | None) -> str:
    """A fenced block whose fence is longer than any run of backticks in the body."""
    mark = "`" * max(3, 1 + max((len(m) for m in re.findall("`+", body)), default=0))
    if info and "`" in info:
        mark = "~" * max(3, 1 + max((len(m) for m in re.findall("~+", body)), default=0))
    return f"{mark}{info or ''}\n{body}{'' if body.endswith(chr(10)) or not body else chr(10)}{mark}"


def html_visible(text: str) -> str:
    p = parse_html(text)
    return "".join(p.raw[a:b].decode("utf-8", "replace") for a, b, _, _ in p.texts)
