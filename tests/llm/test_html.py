import itertools
import random

import pytest

from tesserine.llm import html as H

CASES = [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>end", "- one\n- two\n  - in\n- three\n\nend"), ("<ol><li>x</li><li>y</li></ol>", "1. x\n2. y"),
    ("<head><title>t</title><style>p{}</style></head><script>var a='</p>';</script><p>s<!-- c -->een", "seen"),
    ("<p hidden>a</p><p style='display: none'>b</p><span style='visibility:hidden'>c<b style='visibility:visible'>d</b></span><input type=hidden value=x>", "d"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>2<tr><td>fig<td>10</table>", "Name   Qty\napple  2\nfig    10"),
    ("<table><caption>T</caption><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>x", "T\nwide cell  z\na  b  c\n\nx"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("x &amp; &lt;y&gt; &copy; caf&eacute;", "x & <y> © café"), ("<a href='a>b'>link</a> <b>bold</b>text", "link boldtext"),
    ("<p>open <i>never closed", "open never closed"), ("a <!-- unclosed", "a"), ("a < b and c", "a < b and c"), ("<details><summary>s</summary>body</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("<dl><dt>k<dd>v<dt>m<dd>n</dl>", "k\n  v\nm\n  n"), ("<h1>T</h1>\n <p>one\n two</p>\n<div>three</div>", "T\n\none two\n\nthree"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_layout(page, want):
    assert H.page_text(page) == want


TABLES = [
    ("<table><tbody><td>A</td></tbody></table>", "A"), ("<table><td>A<td>B</table>", "A  B"), ("<table><tr>loose text</tr></table>", "loose text"),
    ("<table><tr><td>a</td> stray <td>b</td></tr></table>", "stray\n\na  b"), ("<table><tr><form><td>x</td></form><td>y</td></tr></table>", "x  y"),
    ("<table><tbody>text<tr><td>c</table>", "text\n\nc"), ("<table><tr><b>bold<td>c</td></tr></table>after", "bold\n\nc\n\nafter"), ("<table><colgroup>t<col><tr><td>c</table>", "t\n\nc"),
    ("<table><tr><td>a<table><tr><td>in</table>b<td>c</table>", "a   c\nin\nb"), ("<table><tr><td>a</td><table><tr><td>b</table>", "a\n\nb"), ("<table><thead><th>H<tbody><td>v</table>", "H\nv"),
    ("<table><tr style='visibility:hidden'><td>a<td style='visibility:visible'>b</tr><tbody style='visibility:hidden'><tr><td>c</table>d", "  b\n\nd"),
    ("<table style='visibility:hidden'><tr><td>a<tr style='visibility: visible'><td>b</table>", "b"), ("<table><tr><td style='visibility:hidden'>a<td>b</table>", "  b"),
    ("<svg><title>t</title><defs/><defs><text>no</text></defs><text>one</text><text>two</text></svg>three", "one\ntwo\nthree"), ("x = <math><mi>y</mi><mo>+</mo><mn>1</mn></math>", "x = y+1"), ("<svg><defs><p>out</p>", "out"),
]


@pytest.mark.parametrize("page,want", TABLES)
def test_text_between_cells_and_in_drawings_stays(page, want):
    assert H.page_text(page) == want


MORE = [
    ("a<!-->b<!--->c<!-- x --!>d", "abcd"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c</tr><tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"), ("<table><tr><td colspan=150>w<td>x<tr><td>y</table>", "w  x\ny"),
    ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c</table>", "a b\n  c"), ("<table><tr>stray<td>a</table>", "stray\n\na"), ("<div>" * 200 + "<p hidden>secret</p>", ""), ("<div>" * 3000 + "<p style='display:none'>x</p>y", "y"),
    ("<table>" * 300 + "<tr><td>in" + "</table>" * 300, "in"), ("<ul><li>" * 400 + "x", "- " * 0 + "  " * 399 + "- x"),
]


@pytest.mark.parametrize("page,want", MORE, ids=range(len(MORE)))
def test_spans_comments_and_depth(page, want):
    assert H.page_text(page) == want


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages_show_their_visible_words_in_order(seed):
    rng, words, want = random.Random(seed), itertools.count(), []

    def build(depth, laid, shown, block):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["text", "inline", "block", "list", "table", "hide", "invisible", "comment"] if depth < 6 else ["text"])
            if kind in ("block", "list", "table") and not block:
                kind = "inline"
            if kind == "text":
                w = f"w{next(words)}"
                if laid and shown:
                    want.append(w)
                out.append(w + " ")
            elif kind == "inline":
                tag = rng.choice(["b", "i", "span", "a"])
                out.append(f"<{tag}>{build(depth + 1, laid, shown, False)}</{tag}>")
            elif kind == "block":
                tag = rng.choice(["div", "section", "blockquote", "h2", "article"])
                out.append(f"<{tag}>{build(depth + 1, laid, shown, True)}" + (f"</{tag}>"))
            elif kind == "list":
                out.append("<ul>" + "".join(f"<li>{build(depth + 2, laid, shown, True)}" + rng.choice(["", "</li>"]) for _ in range(rng.randint(1, 3))) + "</ul>")
            elif kind == "table":
                out.append("<table>" + "".join(f"<tr><td>{build(depth + 3, laid, shown, True)}" + rng.choice(["", "</td>", "</td></tr>"]) for _ in range(rng.randint(1, 3))) + "</table>")
            elif kind == "hide":
                out.append(f"<{(t := rng.choice(['div', 'span'])  if block else 'span')} {rng.choice(['hidden', 'style=display:none'])}>{build(depth + 1, False, shown, block)}</{t}>")
            elif kind == "invisible":
                again = rng.random() < 0.5
                inner = f"<span style='visibility:visible'>{build(depth + 2, laid, True, False)}</span>" if again else build(depth + 2, laid, False, False)
                out.append(f"<span style='visibility:hidden'>{inner}</span>")
            else:
                out.append("<!-- <b>no</b> -->")
        return "".join(out)

    page = build(0, True, True, True)
    assert [w for w in H.page_text(page).split() if w != "-"] == want, page


def test_deep_and_long_pages():
    assert H.page_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert H.page_text("<b>" * 5000 + "x") == "x"
    assert H.page_text("<p>word</p>" * 20000).count("word") == 20000
    assert H.page_text("<a href=\"" * 3000) == ""


def test_operator(spark):
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(CASES)] + [(1, "", "")], "page_id long, html string, text string").repartition(3)
    got = H.extracted(df).collect()
    assert len(got) == len(CASES) + 1 and all(r.text == CASES[r.page_id][1] and r.n_chars == len(r.text) for r in got)
    assert H.extracted(df.limit(0)).count() == 0


def test_long_pages_take_linear_time():
    import time

    start = time.process_time()
    rows = "".join("<tr><td rowspan=65534 colspan=1000>x" for _ in range(300))
    for page in ("<b" * 500_000, "<a " + "x" * 1_000_000, "<" + "y" * 1_000_000, "</" + "z" * 1_000_000, "<a '" * 200_000, "<a b=" * 200_000, f"<table>{rows}</table>", "<table><tr>" + "<td rowspan=65534 colspan=1000>x" * 300, "<!--" * 250_000):
        H.page_text(page)
    assert time.process_time() - start < 45


PAGES = [
    ("<ol start=5><li>a<li value=9>b<li>c</ol>", "5. a\n9. b\n10. c"),
    ("<pre>\n\na</pre>", "\na"),
    ("<p>x<plaintext>a<b>c", "x\n\na<b>c"),
    ("<form><input type=submit value=Go> <input type=reset> <input value=no></form>", "Go Reset"),
    ("<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>", "ab"),
    ("<p style='display:none;display:block'>a</p><p style='display: none !important; display:block'>b</p>", "a"),
    ("<textarea>\na\n b</textarea>", "a\n b"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td rowspan=0>a<td rowspan=2>b<td>c<tr><td>d<tr><td>e</table>", "a  b  c\n      d\n   e"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_pages_of_odd_parts(page, text):
    assert H.page_text(page) == text
