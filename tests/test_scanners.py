"""HTML and Markdown scanners, hashes and text functions on small inputs worked out by hand."""

import random

import pytest

from leafline.functions import blocks, html, markdown, text

HTML = (
    "<!DOCTYPE html><html><head><meta charset=u><title>T &amp; x</title></head><body><h1>H</h1><ul><li>a<li>b</ul><h2>S</h2><p>x<img src=a>"
    "<img src=b><blockquote><p>q</blockquote><h2>z</h2><table><tr><td>1</table><pre>c</pre><hr><section-x>u</section-x><div>tail text"
)
MARKDOWN = (
    "# Title *x*\n\nPara one\nlazy line\n## Sub\n- a\n  - nested\n- [x] b\n\n  more\n1. one\n2) two\n\n> q1\nlazy\n> - i\n\n| a | b |\n|:--|--:|\n| 1 | 2 |\n\n```py\nx = 1\n```\n\n"
    "    indented\n\n![img](a.png)\n\n<div>\nhtml\n</div>\n\n[ref]: http://x.org \"t\"\n\nSetext\n===\n***\nend\n"
)


def test_html_blocks():
    d = blocks.html_document(HTML)
    assert [b.block_id for b in d.blocks] == "title-0001 h1-0002 li-0003 li-0004 h2-0005 p-0006 q-0007 h2-0008 t-0009 c-0010 hr-0011 html-0012 p-0013".split()
    assert d.blocks[5].section == ["h1-0002", "h2-0005"]
    assert d.blocks[8].section == ["h1-0002", "h2-0008"]
    assert any("li-0003" in w for w in d.warnings)


def test_html_anonymous_runs_and_images():
    d = blocks.html_document("<div>text <b>bold</b><!-- c --></div><div><img src=a></div><div> </div>")
    assert [(b.kind, d.raw[b.start : b.end]) for b in d.blocks] == [("paragraph", b"text <b>bold</b>"), ("image", b"<img src=a>")]


def test_raw_text_is_no_markup():
    assert html.inventory('<script>var t="</p>";</script><p>x') == ["script", "/script", "p"]
    assert html.inventory("<!-- <b> --><textarea><i></textarea>") == ["textarea", "/textarea"]
    assert html.inventory("a <1> b < c") == []


def test_implied_end_tags():
    p = html.parse("<p>a<p>b<ul><li>x<li>y</ul>")
    assert [(e.name, e.depth) for e in p.elements] == [("p", 0), ("p", 0), ("ul", 0), ("li", 1), ("li", 1)]
    assert [e.name for e in html.parse("<table><tr><td>1<td>2<tr><td>3</table>").elements] == ["table", "tr", "td", "td", "tr", "td"]


def test_foreign_content():
    p = html.parse("<svg><title><p>x</p></title><circle/></svg><p>y")
    assert not p.orphans
    assert [e.name for e in p.unclosed] == ["p"]
    assert html.parse("<svg><p>out").elements[1].depth == 0  # p breaks out


def test_segments_and_splice():
    t = '<p class="a">x &amp; y<b>z</b></p><!-- n --><template>no</template>'
    assert html.segments(t) == [("x & y", "p"), ("z", "b")]
    assert html.splice(t, ["x & y", "<w>"]) == '<p class="a">x &amp; y<b>&lt;w&gt;</b></p><!-- n --><template>no</template>'
    with pytest.raises(ValueError):
        html.splice(t, ["one"])


@pytest.mark.parametrize("raw", ["The&a", "x&amp", "b &amp;&am", "&#84;he R&D", "&eacute;t&eacute; > <b>x", "&#1;a &nbsp;"])
def test_unchanged_ends_of_a_segment_keep_their_spelling(raw):
    t = f"<title>{raw}</title>"
    ((text, _),) = html.segments(t)
    assert html.splice(t, ["Titel: " + text]) == f"<title>Titel: {raw}</title>"
    assert html.splice(t, [text + " Ende"]) == f"<title>{raw} Ende</title>"


def test_kept_spelling_never_reads_on():
    assert html.splice("<p>R& x</p>", ["R&lt; y"]) == "<p>R&amp;lt; y</p>"
    assert html.splice("<p>a < c</p>", ["a <b>"]) == "<p>a &lt;b&gt;</p>"
    assert html.splice("<p>one&nbsp;two</p>", ["eins\u00a0zwei"]) == "<p>eins\u00a0zwei</p>"
    rng, parts = random.Random(3), "& &amp; &amp amp; lt; < > b> / a é &#233; &copy ; right title> !-- &#1;".split(" ")
    for _ in range(4000):
        tag, raw = rng.choice(("p", "title")), "".join(rng.choice(parts) for _ in range(rng.randint(1, 7)))
        t = f"<{tag}>{raw}</{tag}><b>k</b>"
        texts = [s for s, _ in html.segments(t)]
        if not texts:  # all of it is within a comment
            continue
        i = rng.randrange(len(texts))
        a, b = sorted(rng.randint(0, len(texts[i])) for _ in range(2))
        texts[i] = texts[i][:a] + rng.choice(parts) + texts[i][b:]
        if texts[i].strip():
            assert html.segments_and_tags(html.splice(t, texts)) == (texts, html.inventory(t))


def test_nesting_ceiling():
    with pytest.raises(html.TooDeep):
        html.segments("<div>" * 600)
    assert html.parse("<p>" * 600).breach is None


def test_generated_html_keeps_its_properties():
    rng = random.Random(7)
    parts = "<p> </p> <div> </div> <ul> <li> </li> <svg> </svg> <title> </title> a &amp; <!-- --> <script> </script> <b_x='1'> </b> <br/> < > é <td> <table> </table>".replace("_", " ").split(" ")
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert html.splice(t, [s for s, _ in html.segments(t)]) == t
        assert not html.parse(html.balance(t)).orphans
        end = 0
        for b in blocks.html_document(t).blocks:
            assert end <= b.start <= b.end
            end = b.end


def test_attributes_edit():
    assert html.strip_sync_attributes('<a data-sync-id="x" href=y>') == "<a href=y>"
    assert html.namespace_ids('<a id="t" href="#t">', "p-") == '<a id="p-t" href="#p-t">'
    assert html.collapse_blank_lines("a\n\n \nb\n") == "a\nb\n"


def test_markdown_blocks():
    d = markdown.document(MARKDOWN)
    assert [b.block_id for b in d.blocks] == "h1-0001 p-0002 h2-0003 li-0004 li-0005 li-0006 li-0007 q-0008 t-0009 c-0010 c-0011 img-0012 html-0013 h1-0014 hr-0015 p-0016".split()
    assert d.raw[d.blocks[7].start : d.blocks[7].end] == b"> q1\nlazy\n> - i"
    assert (d.blocks[3].task, d.blocks[4].task, d.blocks[5].ordered) == (None, True, True)
    assert d.ref_defs == '[ref]: http://x.org "t"'


def test_markdown_places_are_bytes_and_all_line_ends_count():
    d = markdown.document("é\r\n\r\n# h\rx")
    assert [(b.start, b.end) for b in d.blocks] == [(0, 2), (6, 9), (10, 11)]


def test_empty_list_items_warn():
    d = markdown.document("- a\n-\n- b\n")
    assert [b.kind for b in d.blocks] == ["list-item"] * 3 and len(d.warnings) == 1


def test_fragment_facts():
    assert markdown.table_facts("|a|b|\n|-|:-:|\n|1|2|\n") == (2, ["none", "center"], 1)
    assert markdown.quote_children("> # h\n> p\n>\n> - x") == ["heading-1", "paragraph", "bullet-list"]
    assert [(t["depth"], t["task"]) for t in markdown.list_topology("- a\n  1. x\n- [ ] b\n")] == [(0, None), (1, None), (0, False)]
    i = markdown.inline("end [l](u) `c` <b>x</b> [ref] <http://a.b> http://c.d.", {"ref": "R"})
    assert (i.destinations, i.code, i.html) == (["u", "R", "http://a.b", "http://c.d"], ["c"], ["<b>", "</b>"])
    assert markdown.plain_text("a **b** `c*` [l](u) \\*x") == "a b c* l *x"
    assert markdown.fence("a ``` b", "py").startswith("````py")


def test_long_lines_are_linear():
    markdown.document("[" * 20_000)
    html.parse("<" * 50_000 + "a" * 50_000)


def _sip(d):
    m64 = 2**64 - 1
    rot = lambda x, b: ((x << b) | (x >> (64 - b))) & m64
    v = [0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573]

    def turn():
        v[0] = (v[0] + v[1]) & m64
        v[1] = rot(v[1], 13) ^ v[0]
        v[0] = rot(v[0], 32)
        v[2] = (v[2] + v[3]) & m64
        v[3] = rot(v[3], 16) ^ v[2]
        v[0] = (v[0] + v[3]) & m64
        v[3] = rot(v[3], 21) ^ v[0]
        v[2] = (v[2] + v[1]) & m64
        v[1] = rot(v[1], 17) ^ v[2]
        v[2] = rot(v[2], 32)

    b = d + b"\0" * (7 - len(d) % 8) + bytes([len(d) & 255])
    for i in range(0, len(b), 8):
        m = int.from_bytes(b[i : i + 8], "little")
        v[3] ^= m
        turn()
        v[0] ^= m
    v[2] ^= 0xFF
    for _ in range(3):
        turn()
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def test_siphash():
    rng = random.Random(1)
    data = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(40), 100, 7, 0]]
    assert text.siphash13(data).tolist() == [_sip(x) for x in data]
    assert text.siphash13([]).tolist() == []


def test_text_functions():
    assert text.canonical_key(" Straße ") == "strasse"
    assert not text.has_visible_text(" ​­") and text.has_visible_text("a")
    assert text.cut_bytes("éé", 3) == ("é", True)
    assert text.line_starts(b"a\r\nb\rc\n") == [0, 3, 5, 7]
