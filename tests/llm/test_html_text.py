"""HTML extraction from pages assembled from known articles, and from broken ones."""

import html
import math
import random

from marlstone.llm import html_text, registry

WORDS = "lorem ipsum dolor sit amet & < > consectetur é adipiscing “elit” sed 中文 do".split()


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def marked(rng, text):
    """text as markup, with inline elements, references and odd white space."""
    out = []
    for w in text.split(" "):
        w = html.escape(w, quote=False).replace("é", rng.choice(["é", "&eacute;", "&#233;", "&#xE9;"]))
        kind = rng.random()
        out.append(f"<b>{w}</b>" if kind < 0.05 else f"<a href='/x?a>b'>{w}</a>" if kind < 0.08 else f"<span class=q>{w}</span><!-- no > -->" if kind < 0.1 else w)
    return "".join(x + rng.choice([" ", "\n  ", "\t", "<br>", " <br/> "]) for x in out)


def page(rng):
    blocks, parts = [], []
    for tag in ["h1", *rng.choices(["p", "p", "p", "li", "blockquote", "h2", "pre", "div"], k=rng.randint(3, 12))]:
        text = sentence(rng, rng.randint(6, 60))
        blocks.append(text)
        end = "" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>"
        inner = f"<{tag}>{marked(rng, text)}{end}"
        parts.append(f"<ul>{inner}</ul>" if tag == "li" else inner)
        if rng.random() < 0.2:
            parts.append(rng.choice(["<script>var x='</p><p>not text';</script>", "<style>p{}</style>", f"<div class='ad-slot ads'><p>{sentence(rng, 20)}</p></div>", f"<aside><p>{sentence(rng, 30)}</p></aside>", f"<form><label>{sentence(rng, 5)}</label><button>go</button></form>"]))
    box = rng.choice(["article", "main", "div", "div id='story'", "td"])
    body = "".join(parts)
    whole = f"<{box}>{body}</{box.split()[0]}>" if box != "td" else f"<table><tr><td>{body}</td></tr></table>"
    nav = "<nav><ul>" + "".join(f"<li><a href='/{k}'>{html.escape(sentence(rng, 2))}</a>" for k in range(12)) + "</ul></nav>"
    comments = "<section id=comments>" + "".join(f"<div class=comment><p>{html.escape(sentence(rng, 25))}</p></div>" for _ in range(rng.randint(0, 6))) + "</section>"
    notice = f"<div class='cookie-notice'>{sentence(rng, 25)}</div>"
    head = "<!DOCTYPE html><html><head><title>not text</title><meta charset=utf-8></head><body>"
    return head + f"<header><h2>Site</h2>{nav}</header>" + notice + whole + comments + f"<footer>&copy; {sentence(rng, 10)}</footer></body></html>", "\n".join(blocks)


def test_known_articles():
    rng = random.Random(12)
    for _ in range(150):
        source, want = page(rng)
        assert html_text.extract(source) == want, source


def test_article_in_several_containers():
    rng = random.Random(9)
    for sizes in ((3, 3), (10, 10), (4, 4, 4), (10, 3)):
        texts = [[sentence(rng, 50) for _ in range(n)] for n in sizes]
        parts = "".join("<div>" + "".join(f"<p>{html.escape(t)}</p>" for t in part) + "</div>" for part in texts)
        links = "<div>" + "".join(f"<a href='/{k}'>go there {k}</a>" for k in range(20)) + "</div>"
        for source in (f"<body><div class=content>{parts}</div></body>", f"<body>{links}<div class=content>{parts}</div>{links}</body>"):
            assert html_text.extract(source) == "\n".join(t for part in texts for t in part), source


LONG, OTHER = "The river rose by night and the lower fields were under water by the time the bells rang", "Nobody had seen so much rain since the year in which the old bridge was carried away"


def test_names_are_evidence_only():
    """Hand-written pages: what is kept, and what goes, of them."""
    two = f"<p>{LONG}</p><p>{OTHER}</p>"
    want = f"{LONG}\n{OTHER}"
    notes = "".join(f"<div><p>{w} I was there too and saw it all</p></div>" for w in ("Yes", "No", "Maybe"))
    whole = [
        f'<div class="article-with-sidebar">{two}</div>', f'<div class="layout has-sidebar">{two}</div>', f'<div class="no-sidebar">{two}</div>', f'<div id="search-results-page">{two}</div>',
        f'<div class="widget"><article>{two}</article></div>', f'<div class="banner"><main>{two}</main></div>', f'<section id="discussion">{two}</section>', f'<div class="story"><div class="related-work">{two}</div></div>',
        f'<div class="zq-body">{two}</div><div class="userComments">{notes}</div>', f'<div class="zq">{two}</div><section id="commentList">{notes}</section>', f'<div>{two}</div><div class="comments-area">{notes}</div>',
        f'<article>{two}<section class="reader_comments">{notes}</section></article>', f'<article>{two}<div class="AdSlot"><p>Buy two and pay for three of them today</p></div></article>', f'<article>{two}<ins class="adsbygoogle">Buy now</ins></article>',
        f'<article><p>{LONG}<span class="ad">Buy now</span></p><p>{OTHER}</p></article>', f'<article><p>{LONG}<span hidden>secret</span></p><p>{OTHER}</p></article>', f'<article><p>{LONG}<b style="color:red; display: none">secret</b></p><p>{OTHER}</p></article>',
        f'<article>{two}<div style="visibility:hidden"><p>Unseen words that no reader gets to see</p></div></article>', f'<article><header>By A. Writer</header>{two}</article>', f'<article>{two}<footer>Printed on paper</footer></article>',
        f'<div class="pageHeader">The Daily River</div><div class="q">{two}</div><div class="pageFooter">All rights reserved by the river</div>', f'<div class="cookieConsent"><p>We use cookies and you agree to all of them</p></div><div class="q">{two}</div>',
        f'<div class="q">{two}<p class="newsletter-signup">Get our letters every day of the week</p></div>', f'<div class="q">{two}<aside>Beside the point</aside></div>', f'<div class="q">{two}<div role="complementary"><p>Beside the point</p></div></div>',
        f'<body class="has-comments sidebar">{two}</body>', f'<article class="comments-open">{two}</article>', f'<div id="main-nav"><a href=/>Home</a> <a href=/n>News</a></div><div class="x1">{two}</div>',
        f'<div class="q">{two}<form><input><p>Your name please and then your message</p></form></div>', f'<div class="q" data-class="ad" data-style="display:none">{two}</div>', f'<div class="q">{two}</div><div class="sharing-tools"><a href=/f>Share</a></div>',
        f'<table><tr><td class="leftMenu"><a href=/a>One</a><a href=/b>Two</a></td><td>{two}</td></tr></table>',
    ]
    for source in whole:
        assert html_text.extract(source) == want, source
    assert html_text.extract(f"<article><p>{LONG} <span class=ad>never closed <b>x</b></p><p>{OTHER}</p></article>") == want


def test_odd_pages():
    cases = {
        None: "", "": "", "   ": "", "plain  text\n here": "plain text here", "<p>a<p>b": "a\nb", "<p>cut <b>off</b> and a ta<i": "cut off and a ta",
        "<article><p>one <!-- never closed": "one", "<p>1 < 2 &amp;lt; &nbsp;x</p>": "1 < 2 &lt; \xa0x", "<ul><li>a<li>b</ul>": "a\nb", "</p></div>x": "x", "<script>only</script>": "",
        "<p title='a>b'>q</p>": "q", "<P>Up</P>": "Up", "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc", "<nav>menu</nav>": "", "<p>a\x0bb\x0cc</p>": "a b c",
    }
    for source, want in cases.items():
        assert html_text.extract(source) == want, source
    assert html_text.extract("<div>" * 30_000 + "deep") == "deep"
    assert html_text.extract("<p>" + "long text " * 100_000) == ("long text " * 100_000).strip()
    assert html_text.extract('<p a="' * 3000 + "x") is not None


def test_densities_of_a_small_page():
    own = html_text.Page("<body><div><p>abcdefghij</p><p>klmno</p></div><a>link</a></body>")
    density = dict(zip(range(9), own.densities()))
    p = own.tag.index("p")
    share = own.link_chars[0] / (own.chars[0] + 1)
    want = 10 * math.log(10 * 1) / math.log(math.log(10 * share + math.e) + math.e - 1)
    assert abs(density[p] - want) < 1e-9 and own.tag[own.article()] == "div"


def test_tables(spark):
    rows = [(1, "u", "<p>a</p>", 5, 6), (1, "u", "<p>a</p>", 5, 6), (None, None, None, 7, 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long, n_chars long")
    got = sorted(html_text.extract_pages(pages).collect(), key=str)
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "a", 1), (1, "a", 1), (None, "", 0)]
    assert html_text.extract_pages(pages.limit(0)).count() == 0
    whole = registry.op6_html_text(spark, "/root/testdata/sf0.001")
    assert whole.count() == 50 and whole.filter("n_chars <> char_length(text) or n_chars = 0").count() == 0
