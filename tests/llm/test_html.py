import html
import random
import re

import pytest

from tidemark.llm.html_text import extract_pages, main_text

PAGES = "/root/testdata/sf0.001/pages.parquet"

CASES = [
    ("", ""),
    ("no tags at all, text.", "no tags at all, text."),
    ("<article><p>One &lt;b&gt; two<p>Three&nbsp;four", "One <b> two Three four"),
    ("<article><p>x < y and y > z &amp;&#x41;&#66 &unknown; &copy</p></article>", "x < y and y > z &AB &unknown; ©"),
    ("<article><p>a<b>b</b>c<!-- x -->d<script>1<2</script>e</p><table><tr><td>1<td>2<tr><td>3</table></article>", "abcde 1 2 3"),
    ("<article><p>e<wbr>f</p><p>x<br/>y</p><hr>z</article>", "ef x y z"),
    ("<article><p>one</p>loose text<p>two</p></article>", "one loose text two"),
    ("<ARTICLE><P TITLE='a>b'>UPPER</P></ARTICLE>", "UPPER"),
    ("<article><p>unclosed comment <!-- here <p>x", "unclosed comment"),
    ('<article><p>t</p><p class="', "t"),
    ("<p>hello <span class=ad>buy</span> there</p>", "hello there"),
    ("<main><form><input><p>Search</p></form><p>foo</p></main>", "foo"),
    ('<form id="aspnetForm"><div><article><p>the whole page is in a form.</p></article></div></form>', "the whole page is in a form."),
    ("<article><header><h1>Title</h1><span>by me</span></header><p>Text.</p><footer>tags</footer></article>", "Title Text."),
    ("<html><body><header><h1>Site</h1></header><article><h1>A</h1><p>b</p></article></body></html> after", "A b"),
    ("<nav><ul><li><a>x</a><li><a>y</a></ul></nav><article><p>t</p></article><article class=comment><p>A comment, longer than the article. Really, much longer.</p></article>", "t"),
    ("<article><p>Short, it is.</p><article><p>Well said, my friend.</p></article></article>", "Short, it is."),
    ("<div class=ad>Buy<article><p>Text in an ad that was never closed, alas.</p></article>", "Text in an ad that was never closed, alas."),
    ("<article><ul><li><a href=a>one</a><li><a href=b>two</a></ul><p>z</p></article>", "one two z"),
    ("<body class='page-with-sidebar'><div class='wrap has-sidebar'><h1>T</h1><p>Long text, here it goes. And more of it, too.</p><div class='comments'><p>Nice post, friend. I really liked it.</p></div></div></body>", "T Long text, here it goes. And more of it, too."),
    ("<div id=x><a href=1>Home</a> <a href=2>About</a></div><div id=y><p>Real text is here, and it goes on. Yes.</p><p>Short.</p><p>More of the same, with commas, and so on.</p></div><div id=z><a href=1>Terms</a> <a>Privacy</a></div>", "Real text is here, and it goes on. Yes. Short. More of the same, with commas, and so on."),
    ('<div class="story"><h2>Head</h2><div>Para one, it is. Fine.</div><div>Para two, it is. Fine.</div><blockquote>Q</blockquote><pre>a\n  b</pre></div><div class="cookie-banner">We use cookies, you know. Accept them, please.</div>', "Head Para one, it is. Fine. Para two, it is. Fine. Q a b"),
    ("<article><p>a</p><p hidden>b</p><div style='display: none'>c</div><noscript>d</noscript><template>e</template><select><option>f</select><button>g</button></article>", "a"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_small_pages(page, want):
    assert main_text(page) == want


def invented(rng, plain):
    """(page, its main text): an article among everything that is none; plain pages name their parts by elements alone."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(1, 9)))
    said = lambda n: " ".join(word() + rng.choice(["", "", "", ",", ".", " &", "\n"]) for _ in range(n)) + "."
    shown = lambda t: rng.choice([html.escape(t), html.escape(t).replace(" ", "  ", 2), re.sub(r"\b(\w+)", r"<em>\1</em>", html.escape(t), count=0) if "&" not in t and rng.random() < 0.1 else html.escape(t)])
    want, body = [], []

    def say(tag, n):
        text = said(n)
        want.append(" ".join(text.split()))
        body.append(f"<{tag}>{shown(text)}" + rng.choice([f"</{tag}>", f"</{tag}>\n", "" if tag in ("p", "li") else f"</{tag}>"]))

    say("h1", 4)
    for _ in range(rng.randint(2, 8)):
        u = rng.random()
        if u < 0.7:
            say("p", rng.choice([1, 5, 30, 60]))
        elif u < 0.8:
            say("h2", 3)
        elif u < 0.9:
            body.append("<ul>")
            for _ in range(3):
                say("li", 4)
            body.append("</ul>")
        else:
            body.append("<blockquote>")
            say("p", 12)
            body.append("</blockquote>")
        if rng.random() < 0.2:
            body.append(f'<div class="{rng.choice(["ad", "ad-slot", "advertisement", "promo"])}">{said(8)}</div>')
        if rng.random() < 0.1:
            body.append(f"<script>var x = '<p>{said(3)}</p>';</script><style>p {{}}</style>")
    menu = "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(6)) + "</ul>"
    parts = [
        f"<header><a href=/>{word()}</a><p>{said(5)}</p></header>", f"<nav>{menu}</nav>", f'<div id="cookie-notice"><p>{said(25)}</p><button>ok</button></div>' if not plain else f"<dialog open><p>{said(20)}</p></dialog>",
        f"<form><label>{word()}</label><input name=q><button>{word()}</button></form>",
    ]
    rng.shuffle(parts)
    after = [f"<aside><h3>{word()}</h3>{menu}<p>{said(12)}</p></aside>", f'<section class="{rng.choice(["comments", "comment-list", "reader-comments"])}" id="{rng.choice(["comments", "respond"])}">' + "".join(f"<div><p>{said(30)}</p></div>" for _ in range(rng.randint(1, 4))) + "</section>", f"<footer>&copy; {word()} &middot; {said(8)}</footer>"]
    holder = rng.choice(["article", "main"]) if plain else rng.choice(["article", "main", 'div class="post-body"', 'div id="content"', 'div class="entry has-sidebar"'])
    article = f"<{holder}>" + "".join(body) + f"</{holder.split()[0]}>"
    wrapped = rng.choice(["{}", '<div class="wrapper"><div>{}</div></div>', '<div class="layout with-sidebar">{}</div>']).format(article)
    page = "<!DOCTYPE html><html><head><title>" + word() + "</title></head><body>" + "".join(parts) + wrapped + "".join(after) + rng.choice(["</body></html>", ""])
    return page, " ".join(want)


def test_articles_among_everything_else():
    rng = random.Random(4)
    for k in range(600):
        page, want = invented(rng, k % 2 == 0)
        assert main_text(page) == want, page


def test_given_pages(spark):
    pages = spark.read.parquet(PAGES)
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html, re.S)[1].replace("<br>", " ")
        pieces = (" ".join(html.unescape(re.sub("</?b>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article))
        text = " ".join(p for p in pieces if p)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, text, len(text))


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "t", "<" * 500_000, "<b>" * 100_000 + "x" + "</i>" * 100_000, "<p>a" * 50_000, "<ul><li>x" * 30_000, "<a " + "x=1 " * 100_000 + ">t", '<a b="' * 50_000, "<!--" * 50_000, "</div>" * 200_000, "<table><tr><td>" * 20_000 + "x", "<div><i>" * 20_000 + "</i></div>" * 20_000])
def test_time_grows_with_length(page):
    main_text(page)


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x, y.</p>"), (4, "u", "<p>" + "word, " * 300_000), (5, "u", "<article>é ☃ 😀 \x00</article>"), (5, "u", "<article>é ☃ 😀 \x00</article>"), (6, "u", "<nav>only</nav>")]
    schema = "page_id long, url string, html string"
    got = extract_pages(spark.createDataFrame([(*r, "extra", 1) for r in rows], schema + ", text string, n_chars int")).collect()
    assert [(r.page_id, r.url) for r in got] == [r[:2] for r in rows]
    assert [r.text for r in got[:3]] == ["", "", "x, y."] and got[3].n_chars == 6 * 300_000 - 1 and got[4].text == got[5].text == "é ☃ 😀 \x00" and got[6].text == ""
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0
