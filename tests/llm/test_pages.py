"""Elements of pages that must not take the text after them along."""

import pytest

from hanmaru.llm import htmltext

ARTICLE = "<article>" + "".join(f"<p>Paragraph {i} of the story, long enough to be read as its text, with a comma and an end.</p>" for i in range(6)) + "</article>"


def text_of(node):
    return " ".join("".join(x if isinstance(x, str) else f" {text_of(x)} " for x in node.items).split())


@pytest.mark.parametrize("icon", ['<svg class="icon" href="#a"/>', "<math/>", "<svg><path d='M0'>", '<object data="x.swf">', "<canvas id=c>", "<audio src=a.mp3>", "<video src=a.mp4>"])
@pytest.mark.parametrize("later", ["", "<svg><path/></svg><video src=b.mp4></video>"])
def test_icon_first_page_keeps_its_article(icon, later):
    found = htmltext.extract([f"<html><body>{icon}{ARTICLE}{later}</body></html>"], htmltext.trained())[0]
    assert all(f"Paragraph {i} of the story" in found for i in range(6))


def test_content_of_closed_elements_stays_out():
    html = "<body>a<svg><svg><text>no</text></svg><title><p>no</p></title><text>no</text></svg>b<video><p>no</video>c<object><div>no</div></object>d<canvas>no</canvas>e</body>"
    assert text_of(htmltext.parse(html)).replace(" ", "") == "abcde"


@pytest.mark.parametrize("n", [399, 400, 1500])
def test_sibling_features_are_exact_on_flat_pages(n):
    html = "<body><header>top</header>" + "<p>one</p>" * (n - 2) + "<footer>end</footer></body>"
    order, parents, x, _ = htmltext.flatten(htmltext.parse(html))
    at = len(htmltext.KINDS)
    place, alike = at + 17, at + 19
    body = next(i for i, node in enumerate(order) if node.tag == "body")
    same = [i for i, p in enumerate(parents) if p == body]
    assert len(same) == n
    for k, i in enumerate(same):
        assert x[i, place] == pytest.approx(k / n) and x[i, alike] == pytest.approx(sum(order[j].tag == order[i].tag for j in same[:2] + same[-1:]) / n if order[i].tag != "p" else (n - 2) / n)


@pytest.mark.parametrize("tag", ["<a title=don't>", "<a title='\"' x=\">\">", '<a href=x/>', "<p/>", "<!-->", "<!x \" y>", "</ >", "<?php '?>", "<a b='c'd=e>", "< b", "<3"])
def test_odd_tags_lose_no_text(tag):
    found = htmltext.extract([f"<html><body><div>{tag}</div>{ARTICLE}</body></html>"], htmltext.trained())[0]
    assert all(f"Paragraph {i} of the story" in found for i in range(6))


def test_slashes_close_void_and_foreign_elements_only():
    root = htmltext.parse("<div/>a<a href=x/>b</a><br/>c<svg/>d")
    assert [x.tag for x in root.items] == ["div"] and text_of(root) == "a b c d"


@pytest.mark.parametrize("piece", ["<a title='", '<a title="', "<div>", "<b>", "<p><b>", "<li>", "<div><p>", "</b>", "<!--", "<td>", "<", "<a href=x ", "<option><div>"])
def test_time_grows_with_the_page(piece):
    import time

    def took(n):
        began = time.perf_counter()
        htmltext.parse(piece * n)
        return time.perf_counter() - began

    took(1000)
    assert took(80_000) < 60 * max(took(5000), 0.002)  # sixteen times the page; a square would be 256


def test_long_pages_are_read_whole():
    html = "<body><article>" + "".join(f"<p>Sentence number {i} of a very long page, which goes on and on.</p>" for i in range(20_000)) + "</article></body>"
    found = htmltext.extract([html], htmltext.trained())[0]
    assert found.count("Sentence number") == 20_000
