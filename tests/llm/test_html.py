"""Rendering: implied heads, spans, visibility, numbers, depth, and a tree walk."""

import random

import pytest

from spanframe.llm import html_text


@pytest.mark.parametrize(
    "source, text",
    [
        ("<html><head><title>t</title><body><p>hi</p></body></html>", "hi"),
        ("<head><meta charset=x><title>t</title><p>hello", "hello"),
        ("<head><style>s</style>bare text", "bare text"),
        ("<head><title>t</title></head><body class=a><body>x", "x"),
        ("<table><tr><form><td>cell<td>2</form></table>", "cell  2"),
        ("<table><tr>lost<td>a</table>", "lost\na"),
        ("<table><tr><td>a</td><b>x</b></tr></table>", "x\na"),
        ("<table><tr><td rowspan=2>r<td>x<tr><td>y</table>", "r  x\n   y"),
        ("<table><tbody><tr><td rowspan=0>r<td>x<tr><td>y<tbody><tr><td>z</table>", "r  x\n   y\nz"),
        ("<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
        ("<div style='display:none'>a<b style='display:block;visibility:visible'>b</b></div>c", "c"),
        ("<table style='visibility:hidden'><tr><td>a<td style='visibility: visible'>b</table>", "b"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
        ("<svg><text>s</text></svg><math><mi>m</mi></math>", "s m"),
    ],
)
def test_render(source, text):
    assert html_text.render(source) == text


def test_depth_hides_nothing_and_shows_nothing_hidden():
    deep = "<div>" * 30_000
    assert html_text.render(deep + "<span hidden>secret</span>open" + "</div>" * 30_000 + "<p>end") == "open\n\nend"
    assert html_text.render("<p><button>" + "<div>" * 30_000 + "x") == "x"
    assert html_text.render("<table><tr><td>" * 3000 + "x") == "x"
    assert html_text.render("<ul><li>" * 2000 + "x").strip(" -") == "x"
    wrapped = "<table><tr>" + "<b>" * 200 + "<td>a" + "</table>"
    assert html_text.render(wrapped) == "a"


def random_page(rng, depth=0, seen=True, boxed=True, row=False):
    """Markup with all end tags, and the words a reader of the tree sees."""
    parts, words = [], []
    for _ in range(rng.randint(1, 4)):
        if depth > 4 or rng.random() < 0.4:
            random_page.n += 1
            word = f"w{random_page.n}"
            parts.append(f"{word} ")
            words += [word] if seen and boxed else []
            continue
        tag = rng.choice("div p span b ul ol table section pre blockquote q script dl a td-row".split())
        style = rng.choice(["", "", "", " hidden", " style='visibility:hidden'", " style='color:red; VISIBILITY: visible'", " style='display:none'"])
        inside_seen = False if "hidden'" in style else True if "visible" in style else seen
        inside_boxed = boxed and style != " hidden" and "display" not in style
        body, found = random_page(rng, depth + 1, inside_seen, inside_boxed)
        if tag == "script":
            body, found = "<p>not text</p>", []
        elif tag in ("ul", "ol"):
            body = f"<li>{body}</li>"
        elif tag == "dl":
            body = f"<dt>t{random_page.n}</dt><dd>{body}</dd>"
            found = ([f"t{random_page.n}"] if inside_seen and inside_boxed else []) + found
        elif tag == "table":
            body = f"<tr><td>{body}</td></tr>"
        elif tag == "td-row":
            other, more = random_page(rng, depth + 1, inside_seen, inside_boxed)
            tag, body, found = "table", f"<thead><tr><td rowspan=2>{body}</td><form><td>{other}</td></form></tr></thead>", found + more
        elif tag == "p":  # blocks would end it
            random_page.n += 1
            body, found = f"v{random_page.n}", [f"v{random_page.n}"] if inside_seen and inside_boxed else []
        parts.append(f"<{tag}{style}>{body}</{tag}>")
        words += found
    return "".join(parts), words


random_page.n = 0


def test_all_visible_text_and_no_other():
    rng = random.Random(3)
    for _ in range(300):
        page, words = random_page(rng)
        got = html_text.render(page).replace('"', " ").split()
        assert sorted(x for x in got if x[0] in "wvt" and x[1:].isdigit()) == sorted(words), page
        assert "text" not in got
