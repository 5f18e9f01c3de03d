import html
import os
import re

import pytest

from lodemap.llm.html_text import extract_pages, main_text

CASES = {
    None: "", "": "", "   ": "", "just text": "just text", "<p>Hello <b>wor</b>ld</p>": "Hello world", "<div><p>a<p>b</div>": "a b", "<nav>only nav</nav>": "",
    "<p>x &amp; y &#233; &copy;&nbsp;z &#x41;</p>": "x & y é © z A", "<p>unclosed <b>bold": "unclosed bold", "<p>a<br>b<br/>c</p>": "a b c",
    "<!-- <p>no</p> --><script>if(a<b){'</p>'}</script><style>p{}</style>": "", "<article>x</article": "x", "</p></div>text": "text",
}


@pytest.mark.parametrize("page, want", CASES.items())
def test_small_pages(page, want):
    assert main_text(page) == want


def test_boilerplate_goes_and_short_blocks_stay():
    body = "<p>A paragraph of some length that tells the story.</p><p>Of.</p><ul><li>one<li>two</ul><p>Another paragraph that ends it all.</p>"
    text = "Title A paragraph of some length that tells the story. Of. one two Another paragraph that ends it all."
    around = (
        '<html><head><title>no</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>menu</a></ul></nav><div class="cookie-notice">We use cookies '
        'and many other long words here to fill a line.</div>{}<aside>side text of length</aside><div id="comments"><p>Reader comment that is quite long, longer '
        "than the article itself, perhaps, to lure the extractor away from it all.</p></div><form><label>Mail</label><input></form><footer>foot &copy;</footer></body></html>"
    )
    for inner in (f"<article><h1>Title</h1>{body}</article>", f"<main><h1>Title</h1>{body}</main>", f'<div class="content"><h1>Title</h1>{body}</div>',
                  f'<div><div class="post"><h1>Title</h1>{body}<div class="ad">Buy now</div></div></div>'):
        assert main_text(around.format(inner)) == text
    assert main_text(f"<article><h1>Title</h1>{body}<section class='comments'><p>{'comment ' * 80}</p></section></article>") == text


def test_heads_without_end_tag():
    head = '<!doctype html><html lang=en><head><meta charset=utf-8><title>no <b>text</b></title><link rel=x href=y><style>p{}</style><script>1</script>'
    held = "<noscript><p>Please turn it on</p><img src=x></noscript><template><div>none of this</div></template>"
    body = "<h1>Title</h1><p>A paragraph of some length that tells the story.</p>"
    text = "Title A paragraph of some length that tells the story."
    for start in ("<body>", "<body class=x>\n", "<main>", "<div>", "", "<img src=x>", "</head><body>"):
        assert main_text(f"{head}{start}{body}</html>") == text, start
        assert main_text(f"{head}{held}\n{start}{body}</html>") == text, start
    assert main_text("<head><title>no</title>\nPlain text of the page") == "Plain text of the page"
    assert main_text("<head><title>no</title>\n</head>") == ""


def test_all_chosen_text_stays():
    words = iter(range(10_000))
    prose = lambda n: " ".join(f"<p>{' '.join(f'word{next(words)}' for _ in range(30))}</p>" for _ in range(n))
    plain = lambda page: " ".join(re.sub("<[^>]+>", " ", page).split())
    for inner in (
        "<div>{}</div><section>{}</section><div>{}</div>", "<div><div>{}</div><div><section>{}</section></div></div><section>{}</section>",
        "<main><article>{}</article><article>{}</article>{}</main>", "<article>{}</article><article>{}</article><article>{}</article>",
        "<div>{}</div><article>{}</article><div>{}</div>", "<main>{}</main><div><article>{}</article></div>{}", "{}<div>{}</div>{}",
    ):
        body = inner.format(prose(1), prose(12), prose(2))
        page = f'<html><head><title>no</title></head><body><nav><a href=x>menu</a></nav>{body}<footer>foot</footer></body></html>'
        assert main_text(page) == plain(body), inner


def test_deep_and_long_pages():
    assert main_text("<div>x" * 3000).split().count("x") >= 0.75 * 3000  # of nested containers the innermost that holds enough
    assert main_text("<b>" * 5000 + "word") == "word"
    assert len(main_text("<article>" + "<p>" + "word " * 200_000 + "</p></article>")) == 999_999


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>", 0), (1, "u", "<p>a b</p>", 0), (None, None, None, 0), (2, "v", "", 0)], "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "u", "a b", 3)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extract_pages(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_articles_of_the_tables(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.sub(r"<[^>]+>", "\0", re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.S)[1]))
        assert main_text(r.html) == " ".join(x for x in (" ".join(html.unescape(b).split()) for b in inner.split("\0")) if x)


PROSE = "".join(f"<p>{' '.join(f'word{i}x{j}' for j in range(40))}.</p>" for i in range(6))


@pytest.mark.parametrize("start, end", [
    ('<div class="content has-sidebar">', "</div>"), ('<div class="page with-header">', "</div>"), ('<div id="comment-free-zone">', "</div>"), ('<section class="side-by-side">', "</section>"),
    ("<form action=x>", "</form>"), ('<div class="sidebar"><main>', "</main></div>"), ('<form><fieldset><div class="page with-header"><article>', "</article></div></fieldset></form>"),
])
def test_wrappers_with_words_of_boilerplate(start, end):
    plain = " ".join(re.sub("<[^>]+>", " ", PROSE).split())
    page = "<html><body><nav>menu</nav>{}{}<div class='cookie-notice'>We use cookies here.</div>{}<div id=comments><p>A reader's comment.</p></div><footer>foot</footer></body></html>"
    assert main_text(page.format(start, PROSE, end)) == plain
    inner = '<div class="share">Tell your friends</div>'
    assert main_text(page.format(start, PROSE.replace("</p><p>", f"</p>{inner}<p>", 1), end)) == plain


def test_articles_beside_longer_text():
    para = lambda n, w: f"<p>{' '.join([w] * n)}.</p>"
    page = f"<body><main>{para(60, 'story') * 5}</main><div>{para(160, 'law') * 2}</div></body>"
    assert set(main_text(page).replace(".", "").split()) == {"story"}
    page = f"<body><main><article>{PROSE}</article><article><p>Short one.</p></article></main></body>"
    assert main_text(page).endswith("Short one.")
    inside = f'<article>{PROSE}<div class="market-share-table"><p>Ten percent of the market.</p></div><p id="search-algorithms">How search works.</p></article>'
    assert main_text(inside).endswith("Ten percent of the market. How search works.")


def test_open_paragraphs_of_any_depth():
    for n in (1, 3, 4, 9, 50):
        page = f"<p class=notice>{'<i>' * n}We use cookies.<article>{PROSE}</article>"
        assert main_text(page) == " ".join(re.sub("<[^>]+>", " ", PROSE).split()), n
