"""HTML: tags with byte places, the tree they imply, text segments, and safe embedding.

One pass over the bytes finds tags and keeps the stack of open elements, as the tokenizer depends on
it (raw text, CDATA, foreign content). The tree rules are those of the HTML standard's "in body" mode: implied end
tags, scopes, foreign elements and their integration points.
"""

from __future__ import annotations

import html as entities
import os
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ESCAPABLE = frozenset(("textarea", "title"))
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script "
    "search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section "
    "summary table ul xmp li dd dt".split()
)
CLOSES_TOP = {"tr": "td th tr", "td": "td th", "th": "td th", "tbody": "td th tr tbody tfoot thead", "tfoot": "td th tr tbody tfoot thead", "thead": "td th tr tbody tfoot thead", "option": "option", "optgroup": "option optgroup", "rp": "rp rt", "rt": "rp rt"}
ITEMS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
TABLE_PARTS = frozenset("table caption colgroup tbody tfoot thead tr td th".split())
BLOCK_ENDS = frozenset(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul dd dt form "
    "applet marquee object body html".split()
)
MATH_TEXT = frozenset("mi mo mn ms mtext".split())
SVG_TEXT = frozenset("foreignobject desc title".split())
SCOPE = {"normal": frozenset("applet caption html table td th marquee object template".split()), "table": frozenset("html table template".split())}
SCOPE |= {"button": SCOPE["normal"] | {"button"}, "item": SCOPE["normal"] | {"ol", "ul"}}
DEEPEST = 512
SYNC_ATTRIBUTES = ("data-sync-id", "data-sync-role", "data-sync-kind", "data-sync-status", "data-sync-order")

_NAME = re.compile(rb"[A-Za-z][^\t\n\f\r />]*")
_ATTR = re.compile(rb"[\t\n\f\r /]*(?:([^\t\n\f\r />=][^\t\n\f\r />=]*|=[^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|([^\t\n\f\r >\"'][^\t\n\f\r >]*)?))?)?")


@dataclass
class Tag:
    """kind: open, close, or skip (comments and the like). Places are bytes, the end exclusive."""

    kind: str
    name: str
    start: int
    end: int
    self_closing: bool = False
    done: bool = True


@dataclass
class Element:
    """An element that was put on the stack."""

    name: str
    depth: int
    start: int
    open_end: int
    content_end: int
    close: tuple[int, int] | None = None
    own: str = "html"

    @property
    def end(self) -> int:
        return self.close[1] if self.close else self.content_end


@dataclass
class Parsed:
    raw: bytes
    tags: list[Tag] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    orphans: list[tuple[int, int]] = field(default_factory=list)
    unclosed: list[Element] = field(default_factory=list)
    texts: list[tuple[int, int, str, bool]] = field(default_factory=list)  # start, end, label, whether it holds entities
    breach: int | None = None

    def at(self) -> dict[int, Element]:
        return {e.start: e for e in self.elements}


def attributes(raw: bytes, start: int, end: int) -> list[tuple[int, int, str, str | None]]:
    """(start, end, name, value) of the attributes of the tag at this place; the first of a name counts for a browser."""
    m = _NAME.match(raw, start + 1)
    at, out = m.end() if m else start + 1, []
    while at < end - 1:
        m = _ATTR.match(raw, at, end - 1 if raw[end - 1 : end] == b">" else end)
        if not m or m.end() == at or m[1] is None:
            at = max(at + 1, m.end() if m else at + 1)
            continue
        value = next((v for v in m.groups()[1:] if v is not None), None)
        out.append((m.start(1), m.end(), m[1].lower().decode("utf-8", "replace"), None if value is None else value.decode("utf-8", "replace")))
        at = m.end()
    return out


def _tag_end(raw: bytes, at: int) -> tuple[int, bool]:
    """Where the tag whose name ends here ends, and whether it is self-closing; -1 if it never does."""
    quote = re.compile(rb"=[\t\n\f\r ]*([\"'])|>")
    while m := quote.search(raw, at):
        if m[0] == b">":
            return m.end(), raw[m.start() - 1 : m.start()] == b"/"
        at = raw.find(m[1], m.end())
        if at < 0:
            return -1, False
        at += 1
    return -1, False


class _Tree:
    """The stack of open elements and the standard's rules for it."""

    def __init__(self, out: Parsed) -> None:
        self.out, self.stack, self.child = out, [], []

    def mode(self) -> str:
        return self.child[-1] if self.child else "html"

    def pop(self, n: int, at: int, close: tuple[int, int] | None = None) -> None:
        for i in range(n):
            e = self.stack.pop()
            self.child.pop()
            e.content_end = at
            if close and i == n - 1:
                e.close = close

    def find(self, names: Sequence[str], scope: str, upto: int | None = None) -> int | None:
        """Place of the innermost of these in scope; None if not there; -1 if something shuts the scope."""
        for i in range((len(self.stack) if upto is None else upto) - 1, -1, -1):
            e = self.stack[i]
            if e.own == "html" and e.name in names:
                return i
            if (e.own == "html" and e.name in SCOPE[scope]) or (scope != "table" and ((e.own == "math" and e.name in MATH_TEXT | {"annotation-xml"}) or (e.own == "svg" and e.name in SVG_TEXT))):
                return -1
        return None

    def special(self, e: Element) -> bool:
        return e.name in SPECIAL if e.own == "html" else (e.own == "svg" and e.name in SVG_TEXT) or (e.own == "math" and e.name in MATH_TEXT | {"annotation-xml"})

    def implied(self, name: str) -> int:
        """How many elements the start tag closes."""
        n, top = len(self.stack), len(self.stack)
        if items := ITEMS.get(name):
            for i in range(n - 1, -1, -1):
                e = self.stack[i]
                if e.own == "html" and e.name in items:
                    top = i
                    break
                if self.special(e) and e.name not in ("address", "div", "p"):
                    break
        closes = CLOSES_TOP.get(name, "").split()
        while top and self.stack[top - 1].own == "html" and self.stack[top - 1].name in closes:
            top -= 1
        if name in CLOSES_P and (i := self.find(("p",), "button", top)) is not None and i >= 0:
            top = i
        return n - top

    def start(self, name: str, start: int, end: int, self_closing: bool) -> None:
        if self.mode() != "html":
            outer = name in BREAKOUT or name == "font" and any(a[2] in ("color", "face", "size") for a in attributes(self.out.raw, start, end))
            if outer:
                n = 0
                while n < len(self.child) and self.child[len(self.child) - 1 - n] != "html":
                    n += 1
                self.pop(n, start)
        foreign = self.mode()
        if foreign == "html":
            self.pop(self.implied(name), start)
            own = {"svg": "svg", "math": "math"}.get(name, "html")
        else:
            own = foreign if foreign != "html" else "html"
        if (own == "html" and name in VOID) or (self_closing and own != "html"):
            return
        child = own
        if own == "svg" and name in SVG_TEXT or own == "math" and name in MATH_TEXT:
            child = "html"
        elif own == "math" and name == "annotation-xml" and any(a[2] == "encoding" and (a[3] or "").lower() in ("text/html", "application/xhtml+xml") for a in attributes(self.out.raw, start, end)):
            child = "html"
        if len(self.stack) >= DEEPEST and self.out.breach is None:
            self.out.breach = start
        e = Element(name, len(self.stack), start, end, len(self.out.raw), own=own)
        self.out.elements.append(e)
        self.stack.append(e)
        self.child.append(child)

    def end(self, name: str, start: int, end: int) -> None:
        close = (start, end)
        if self.stack and self.stack[-1].own != "html":
            if name in ("br", "p"):
                n = 0
                while n < len(self.child) and self.child[len(self.child) - 1 - n] != "html":
                    n += 1
                self.pop(n, start)
            else:
                i = len(self.stack) - 1
                while True:
                    if self.stack[i].name == name:
                        return self.pop(len(self.stack) - i, start, close)
                    if i == 0 or self.stack[i - 1].own == "html":
                        break
                    i -= 1
        if name == "template" and any(e.own == "html" and e.name == name for e in self.stack):
            i = max(i for i, e in enumerate(self.stack) if e.own == "html" and e.name == name)
            return self.pop(len(self.stack) - i, start, close)
        if name == "br":
            return None
        names, scope = (HEADINGS, "normal") if name in HEADINGS else ((name,), "button" if name == "p" else "item" if name == "li" else "table" if name in TABLE_PARTS else "normal")
        if name in HEADINGS or name in ("p", "li") or name in TABLE_PARTS or name in BLOCK_ENDS:
            i = self.find(names, scope)
        else:
            i = None
            for k in range(len(self.stack) - 1, -1, -1):
                e = self.stack[k]
                if e.own == "html" and e.name == name:
                    i = k
                    break
                if self.special(e):
                    i = -1
                    break
        if i is not None and i >= 0:
            self.pop(len(self.stack) - i, start, close)
        elif i is None and name != "p":
            self.out.orphans.append(close)
        return None


def _raw_end(raw: bytes, at: int, name: str) -> int:
    """Where the raw text that begins here ends: before its end tag, or at the end."""
    end_tag = re.compile(rb"</" + name.encode() + rb"(?=[\t\n\f\r />])", re.I)
    if name != "script":
        m = end_tag.search(raw, at)
        return m.start() if m else len(raw)
    # script: within <!-- a nested <script hides one </script>
    step = re.compile(rb"<!--|-->|<(/?)script(?=[\t\n\f\r />])", re.I)
    escaped = double = False
    for m in step.finditer(raw, at):
        if m[0] == b"<!--":
            if not escaped:
                escaped = True
        elif m[0] == b"-->":
            escaped = double = False
        elif m[1]:
            if not double:
                return m.start()
            double = False
        elif escaped:
            double = True
    return len(raw)


def parse(text: str | bytes) -> Parsed:
    """Tags, elements and text nodes of a document or fragment."""
    raw = text.encode() if isinstance(text, str) else text
    out = Parsed(raw)
    tree, at, held = _Tree(out), 0, 0

    def flush(upto: int) -> None:
        if upto > held:
            label = next((e.name for e in reversed(tree.stack)), "fragment")
            out.texts.append((held, upto, label, True))

    while (at := raw.find(b"<", at)) >= 0:
        skip = 0
        if raw.startswith(b"<!--", at):
            if raw.startswith((b"<!-->", b"<!--->"), at):
                skip = at + (5 if raw.startswith(b"<!-->", at) else 6)
            else:
                m = re.compile(rb"--!?>").search(raw, at + 4)
                skip = m.end() if m else -1
        elif raw.startswith(b"<![CDATA[", at) and tree.mode() != "html":
            found = raw.find(b"]]>", at)
            skip = found + 3 if found >= 0 else -1
        elif raw.startswith((b"<!", b"<?"), at) or (raw.startswith(b"</", at) and not raw[at + 2 : at + 3].isalpha() and at + 2 < len(raw)):
            found = raw.find(b">", at)
            skip = found + 1 if found >= 0 else -1
        if skip:
            flush(at)
            end = len(raw) if skip < 0 else skip
            out.tags.append(Tag("skip", "", at, end, done=skip > 0))
            at = held = end
            continue
        closing = raw.startswith(b"</", at)
        m = _NAME.match(raw, at + 1 + closing)
        if not m or not m[0][:1].isalpha():
            at += 1
            continue
        end, self_closing = _tag_end(raw, m.end())
        if end < 0:  # an unfinished tag at the end is no tag
            flush(at)
            held = len(raw)
            break
        name = m[0].lower().decode("utf-8", "replace")
        flush(at)
        out.tags.append(Tag("close" if closing else "open", name, at, end, self_closing))
        (tree.end(name, at, end) if closing else tree.start(name, at, end, self_closing))
        at = held = end
        if not closing and name in RAW and tree.stack and tree.stack[-1].start == out.tags[-1].start and tree.stack[-1].own == "html":
            stop = _raw_end(raw, at, name)
            if stop > at and name in ESCAPABLE:
                out.texts.append((at, stop, name, True))
            at = held = stop
    if held < len(raw):
        flush(len(raw))
    out.unclosed = list(tree.stack)
    return out


def inventory(text: str) -> list[str]:
    """Names of the tags in order, `/` before those of end tags."""
    return [("/" if t.kind == "close" else "") + t.name for t in parse(text).tags if t.kind != "skip"]


def kept_texts(p: Parsed) -> list[tuple[int, int, str, str]]:
    """(start, end, decoded text, label) of the text nodes that hold more than white space, outside templates."""
    inert = [(e.open_end, e.content_end) for e in p.elements if e.name == "template" and e.own == "html"]
    out = []
    for start, end, label, _ in p.texts:
        decoded = entities.unescape(p.raw[start:end].decode("utf-8", "replace"))
        if decoded.strip() and not any(a <= start < b for a, b in inert):
            out.append((start, end, decoded, label))
    return out


class TooDeep(ValueError):
    """More than DEEPEST elements are open at once."""


def _shallow(text: str) -> Parsed:
    p = parse(text)
    if p.breach is not None:
        raise TooDeep(f"html nesting too deep at byte {p.breach}")
    return p


def segments(text: str) -> list[tuple[str, str]]:
    """(decoded text, parent's name) of a block's text segments; raises TooDeep."""
    return [(s[2], s[3]) for s in kept_texts(_shallow(text))]


def segments_and_tags(text: str) -> tuple[list[str], list[str]]:
    """Texts of the segments and names of the tags, from one pass; raises TooDeep."""
    p = _shallow(text)
    return [s[2] for s in kept_texts(p)], [("/" if t.kind == "close" else "") + t.name for t in p.tags if t.kind != "skip"]


def splice(text: str, translated: Sequence[str], collapse: bool = False) -> str:
    """The block with its segments replaced, all other bytes as they are; an unchanged segment, and the unchanged ends of a changed one, keep their bytes."""
    p = _shallow(text)
    kept = kept_texts(p)
    if len(kept) != len(translated):
        raise ValueError(f"block has {len(kept)} segments, got {len(translated)}")
    wanted = [collapse_blank_lines(new) if collapse and new != s[2] else new for s, new in zip(kept, translated, strict=True)]
    changed = [(start, end, new) for (start, end, decoded, _), new in zip(kept, wanted, strict=True) if new != decoded]

    def put(write: Callable[[str, str], str]) -> str:
        out, at = [], 0
        for start, end, new in changed:
            out += [p.raw[at:start], write(p.raw[start:end].decode(), new).encode()]
            at = end
        return b"".join([*out, p.raw[at:]]).decode()

    made = put(_respelled)
    # a kept "<" must not begin a tag with what now follows it
    if any(b"<" in p.raw[start:end] for start, end, _ in changed) and segments_and_tags(made) != (wanted, inventory(text)):
        return put(lambda _, new: _escaped(new))
    return made


_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")  # as html.unescape finds them


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _pieces(raw: str) -> list[tuple[str, str]]:
    """(spelling, text) of the references, and of what stands between them."""
    out, at = [], 0
    for m in _REFERENCE.finditer(raw):
        if (text := entities.unescape(m[0])) != m[0]:
            out += [(raw[at : m.start()],) * 2, (m[0], text)]
            at = m.end()
    return [*out, (raw[at:],) * 2]


def _alike(pieces: Sequence[tuple[str, str]], new: str) -> tuple[int, int]:
    """Signs of the spelling, and of new, as far as the texts of the pieces begin it."""
    spelled = at = 0
    for raw, text in pieces:
        if not new.startswith(text, at):
            n = len(os.path.commonprefix([text, new[at : at + len(text)]])) if raw == text else 0
            return spelled + n, at + n
        spelled, at = spelled + len(raw), at + len(text)
    return spelled, at


def _respelled(raw: str, new: str) -> str:
    """new in place of raw: as far as it begins or ends with raw's text it is spelled as there, the longer of both ends first, and escaped between."""
    if not re.search("[&<>]", raw):
        return _escaped(new)
    ends = lambda r, n: (_alike(_pieces(r), n), _alike([(a[::-1], b[::-1]) for a, b in reversed(_pieces(r))], n[::-1]))
    head, tail = ends(raw, new)
    if tail[1] >= head[1]:
        head = ends(raw[: len(raw) - tail[0]], new[: len(new) - tail[1]])[0]
    else:
        tail = ends(raw[head[0] :], new[head[1] :])[1]
    out = raw[: head[0]] + _escaped(new[head[1] : len(new) - tail[1]]) + raw[len(raw) - tail[0] :]
    return out if entities.unescape(out) == new else _escaped(new)  # a kept "&" may read on into what now follows it


def collapse_blank_lines(text: str) -> str:
    """Drops blank lines inside the text, keeping its first and last line and all line ends that stay."""
    lines = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)", text)
    lines.append(text[sum(map(len, lines)) :])
    return "".join(x for i, x in enumerate(lines) if i in (0, len(lines) - 1) or x.strip(" \t\r\n"))


def balance(text: str) -> str:
    """The fragment made safe to embed: orphan end tags dropped, open elements and skips closed."""
    p = parse(text)
    out, at = [], 0
    for start, end in p.orphans:
        part = b"".join(out) + p.raw[at:start]
        # with the end tag gone, a "<" before it and what follows it would be a tag
        weld = re.search(rb"<[/!?]?$", part)
        out, at = [part[: weld.start()] + b"&lt;" + part[weld.start() + 1 :] if weld else part], end
    out.append(p.raw[at:])
    if p.tags and p.tags[-1].kind == "skip" and not p.tags[-1].done:
        out.append(b"-->" if p.raw.startswith(b"<!--", p.tags[-1].start) else b"]]>" if p.raw.startswith(b"<![CDATA[", p.tags[-1].start) else b">")
    out += [f"</{e.name}>".encode() for e in reversed(p.unclosed)]
    return b"".join(out).decode("utf-8", "replace")


def _edit_attributes(text: str, edit: Callable[[str, str | None], str | None]) -> str:
    """Rewrites attributes: edit(name, value) gives the new attribute, "" to drop it, None to keep it."""
    p = parse(text)
    out, at = [], 0
    for t in p.tags:
        if t.kind != "open":
            continue
        for start, end, name, value in attributes(p.raw, t.start, t.end):
            if (new := edit(name, value)) is not None:
                cut = start
                while not new and cut > at and p.raw[cut - 1 : cut] in (b" ", b"\t", b"\n", b"\r", b"\f"):
                    cut -= 1
                out += [p.raw[at:cut], new.encode()]
                at = end
    return b"".join([*out, p.raw[at:]]).decode("utf-8", "replace")


def strip_sync_attributes(text: str) -> str:
    return _edit_attributes(text, lambda name, _: "" if name in SYNC_ATTRIBUTES else None)


def namespace_ids(text: str, prefix: str) -> str:
    """Author ids, and links and references to them inside the fragment, under a prefix."""

    def edit(name: str, value: str | None) -> str | None:
        if not value:
            return None
        if name in ("id", "for"):
            return f'{name}="{escape_attribute(prefix + entities.unescape(value))}"'
        if name == "href" and value.startswith("#") and len(value) > 1:
            return f'{name}="#{escape_attribute(prefix + entities.unescape(value[1:]))}"'
        if name in ("aria-labelledby", "aria-describedby", "headers"):
            return f'{name}="{" ".join(escape_attribute(prefix + v) for v in entities.unescape(value).split())}"'
        return None

    return _edit_attributes(text, edit)


def escape_attribute(text: str) -> str:
    return text.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")
