import html as entities
import random
import re

import pytest

from emberwatch.llm.html import extract_text, main_ranges, main_text

PARAGRAPH = "Long enough to be a paragraph of an article, with several words in a row and a stop."


def test_articles_of_the_corpus(small):
    for r in extract_text(small["pages"]).join(small["pages"].select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub("</?b>", "", re.sub("</?(p|br|h1)>", " ", article))
        assert r.text == " ".join(entities.unescape(plain).split())
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("around", ["div", "section", "main", "article"])
def test_what_stands_beside_goes(around):
    page = f"""<html><head><title>No</title><style>p {{ x }}</style></head><body>
    <header><h1>Site</h1></header><div class="top-menu"><a href=/>Home</a></div>
    <div id="cookie-notice"><p>{PARAGRAPH} cookies</div><script>var x = "<p>no</p>";</script>
    <{around}><h2>Ti&eacute;tle</h2><p>{PARAGRAPH}<p>Short.<!-- no --><p>a&nbsp;&lt;b&gt;   c {PARAGRAPH}
    <div class="ad">{PARAGRAPH} buy</div><form>Your name <input></form></{around}>
    <aside><p>{PARAGRAPH} aside</aside><div class=comments><p>{PARAGRAPH} me too</div>
    <footer>{PARAGRAPH} copyright</footer></body></html>"""
    assert main_text(page) == f"Tiétle {PARAGRAPH} Short. a <b> c {PARAGRAPH}"


@pytest.mark.parametrize("inner", ["article", "main"])
@pytest.mark.parametrize("wrapper", [
    "form", "div class=widget", "div class='page header'", "div id=search", "div class=share",
    "div class=alert", "div class=overlay", "div class=has-sidebar", "main><form",
])
def test_articles_in_wrappers_are_taken(wrapper, inner):
    page = f"<body><{wrapper}><p>{PARAGRAPH} x<{inner}><h1>Title</h1><p>{PARAGRAPH}</{inner}>"
    assert main_text(page) == f"Title {PARAGRAPH}"


@pytest.mark.parametrize("wrapper", ["div class=comments", "aside", "div class=related", "div hidden", "svg"])
def test_articles_that_are_none_stay_out(wrapper):
    page = f"<main><p>{PARAGRAPH}</p></main><{wrapper}><article><p>{PARAGRAPH} x</article>"
    assert main_text(page) == PARAGRAPH


def test_the_body_after_a_teaser_in_an_article_element():
    page = f"<article><h1>Title</h1><p>Lead.</article><div><p>{PARAGRAPH} 1<p>{PARAGRAPH} 2</div>"
    assert main_text(page) == f"Title Lead. {PARAGRAPH} 1 {PARAGRAPH} 2"


def test_no_part_of_an_article_goes():
    """Lists of links in the middle, a part that stands apart, and short lines at the head."""
    links = "".join(f"<li><a href=/{i}>Source {i}</a>" for i in range(4))
    page = f"""<ul>{links}</ul><h1>Title</h1><p>By A. B.<p>Today<p>Lead.<p>{PARAGRAPH} 1<ul>{links}</ul>
    <p>{PARAGRAPH} 2<p>{PARAGRAPH} 3<ul>{links}</ul><p>Short.<ul>{links}</ul><p>{PARAGRAPH} 4"""
    told = " ".join(f"Source {i}" for i in range(4))
    want = f"Title By A. B. Today Lead. {PARAGRAPH} 1 {told} {PARAGRAPH} 2 {PARAGRAPH} 3 {PARAGRAPH} 4"
    assert main_text(page) == want


@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_titles_and_paragraphs_with_odd_names_stay(element):
    page = f"""<{element}><div class="entry-header" data-id="comments"><h1 class="page-header">Title</h1></div>
    <p title="a hidden gem, style=display:none">{PARAGRAPH} 1</p><p class="alert">{PARAGRAPH} 2</p>
    <p class="social-history" aria-label='role="navigation"'>{PARAGRAPH} 3</p></{element}>"""
    assert main_text(page) == f"Title {PARAGRAPH} 1 {PARAGRAPH} 2 {PARAGRAPH} 3"
    assert main_text(f"<{element}><p class=social-history>{PARAGRAPH}</p></{element}>") == PARAGRAPH


@pytest.mark.parametrize("hidden", ["hidden", "hidden=''", "aria-hidden = TRUE", "style='color:red; display : none'"])
def test_hidden_elements_go(hidden):
    assert main_text(f"<article><p>{PARAGRAPH}</p><div {hidden}><p>{PARAGRAPH} x</div></article>") == PARAGRAPH


@pytest.mark.parametrize("names", ["class=share-buttons", "class='post ad-slot'", "id=cookie-notice", "class=related",
                                   "class=top-menu", "class=newsletter", "id=comments", "class=social-links"])
def test_what_is_none_of_an_article_goes(names):
    assert main_text(f"<article><p>{PARAGRAPH}</p><div {names}><p>{PARAGRAPH} x</div></article>") == PARAGRAPH


@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_lines_beside_an_element_do_not_ride_on_its_windows(element):
    page = f"""<body><p>Skip to content</p><{element}><h1>Title</h1><p>{PARAGRAPH} 1<p>{PARAGRAPH} 2</{element}>
    <p>Copyright 2024 Example Corp</p><p>© 2024 Example. All rights reserved.</p></body>"""
    assert main_text(page) == f"Title {PARAGRAPH} 1 {PARAGRAPH} 2"


@pytest.mark.parametrize("names", ["class=user-responses", "id=discussion", "class=voices"])
def test_comments_beside_an_element_go_whatever_their_names(names):
    body = "".join(f"<p>{PARAGRAPH} {i}" for i in range(4))
    page = f"<main><article>{body}</article><div {names}><p>{PARAGRAPH} me too<p>No.</div></main>"
    assert main_text(page) == " ".join(f"{PARAGRAPH} {i}" for i in range(4))


def brute(lengths, window, surge):
    """Line by line, by the definition: a stretch begins at a surge and goes on until the dive."""
    def total(i):
        return sum(x for k, x in enumerate(lengths) if i <= k < i + window)

    least = max(1, min(surge, max((total(i) for i in range(len(lengths))), default=0)))
    marks, inside = [], False
    for i, own in enumerate(lengths):
        inside = total(i) > 0 if inside else own > 0 and total(i) >= least
        marks.append(inside)
    return marks


def test_distribution_against_brute_force():
    draw = random.Random(5)
    for _ in range(2000):
        lengths = [draw.choice([0, 0, 0, 3, 20, 90]) for _ in range(draw.randrange(30))]
        window, surge = draw.randrange(1, 5), draw.choice([1, 25, 80, 300])
        marks = [False] * len(lengths)
        for first, end in main_ranges(lengths, window, surge):
            marks[first:end] = [True] * (end - first)
        assert marks == brute(lengths, window, surge)


def test_surge_and_dive():
    assert main_ranges([0, 5, 0, 0, 0, 90, 3, 60, 0, 0, 0, 4], 3, 80) == [(5, 8)]
    assert main_ranges([0, 5, 0, 0], 3, 80) == [(1, 2)]
    assert main_ranges([], 3, 80) == main_ranges([0, 0], 3, 80) == []


def test_broken_and_long_pages(spark):
    pages = ["", None, "<p", "just text", "<div>" * 3000, "<b>" * 3000 + "x", "a<br/>b", "<p>x</div></p>y",
             f"<article><p>{PARAGRAPH * 3000}</article>", "<script>never closed <p>x", "&am &#x41; &bogus;"]
    want = ["", "", "", "just text", "", "x", "a b", "x y", PARAGRAPH * 3000, "", "&am A &bogus;"]
    assert [main_text(page) for page in pages] == want
    rows = [(i, None, p, "clash") for i, p in enumerate(pages)] + [(0, "u", "", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(df)
    assert got.count() == len(rows) and got.columns == ["page_id", "url", "text", "n_chars"]
    assert extract_text(df.limit(0)).count() == 0
