from credsweep.llm.html_extract import extract, main_text, smoothed

import numpy as np

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this long notice longer than any paragraph of the page itself. Accept them all, please do.</div>
<div class="ad">Buy things now, they are cheap, they are good, they are yours for a very small price indeed.</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b> paragraph with&nbsp;some
   words &lt;here&gt;.<p>Second one<br>goes on.<ul><li>item one<li>item two</ul>
<aside>Aside text that does not count.</aside><form><input name=x> Subscribe <button>Go</button></form><p>Ti.</p><table><tr><td>a</td><td>b</td></tr></table></article>
<section id="comments"><article class="comment"><p>Reader says: a very long comment, longer than the article, to be left out, on and on and on.</p></article></section>
<aside class="sidebar">Related</aside><footer>&copy; site &middot; all rights reserved</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "Head & line\nFirst bold paragraph with some words <here>.\nSecond one goes on.\nitem one\nitem two\nTi.\na b"


def test_without_article_element():
    page = "<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>About</a></div><div><h2>Title here</h2><div><p>" + "Long text of the page. " * 10 + \
        "</p><p>" + "More text of the page. " * 10 + "</p></div></div><div class='footer-links'>imprint</div></body>"
    lines = main_text(page).split("\n")
    assert lines[0] == "Title here" and len(lines) == 3 and "Home" not in lines[0]


def test_names_only_vote():
    paragraphs = ["Long text of the page. " * 10, "More text of the page. " * 10]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    expected = "\n".join(p.strip() for p in paragraphs)
    for around in ("div id='content-sidebar-wrap'", "div class='layout-sidebar-right'", "div class='post-with-comments'", "form action='/'"):
        tag = around.split()[0]
        assert main_text(f"<body><{around}><div>{body}</div></{tag}><div class='footer-links'>imprint</div></body>") == expected, around
        assert main_text(f"<body><{around}><main>{body}</main></{tag}></body>") == expected, around
        assert main_text(f"<body><{around}><article>{body}</article><div id='comments'><p>Reader says so.</p></div></{tag}></body>") == expected, around
    # what a name rightly drops stays dropped, also if it is longer than the article
    comments = "<p>A reader wrote a long reply. And another one did so, too.</p>" * 40
    assert main_text(f"<body><article>{body}</article><div id='comments'>{comments}</div></body>") == expected
    # names on everything that has text: none of them counts
    halves = f"<div class='sidebar-left'><p>{paragraphs[0]}</p></div><div class='sidebar-right'><p>{paragraphs[0]}</p></div>"
    assert main_text(f"<body>{halves}</body>") == "\n".join([paragraphs[0].strip()] * 2)


def test_unclosed_and_broken():
    assert main_text("<article><p>one<p>two <b>three") == "one\ntwo three"
    assert main_text("plain text") == "plain text"
    assert main_text("<article></article>") == "" and main_text("") == "" and main_text(None) == ""
    assert main_text("<nav>menu</nav>") == ""
    assert main_text("a < b & c &amp; d") == "a < b & c & d"


def test_deep_and_long():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    text = "word " * 200_000
    assert main_text(f"<article><p>{text}</p></article>") == text.strip()


def test_smoothing_keeps_the_mean_of_a_constant():
    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0)


def test_table(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 6), (None, "v", "", 7), (1, "u", PAGE, 5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    out = extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in out) == [(0, 0), (1, len(main_text(PAGE))), (1, len(main_text(PAGE))), (2, 0)]
    assert extract(pages.limit(0)).collect() == [] and extract(pages).columns == ["page_id", "url", "text", "n_chars"]


LONG = ["Long text of the page that goes on for a while. " * 4, "More text of the page, which has something to say. " * 4, "The end of the text comes after all of that. " * 4]
BODY = "".join(f"<p>{p}</p>" for p in LONG)
TEXT = "\n".join(p.strip() for p in LONG)


def test_inline_elements_are_part_of_their_sentence():
    assert main_text('<p>This is <em class="notice">very important</em> text for the reader.</p>') == "This is very important text for the reader."
    assert main_text('<p>This is <span class="ad">an advert</span> and <b id="menu">bold</b>.</p>') == "This is an advert and bold."
    assert main_text('<p>What <span hidden>nobody <span>ever</span> sees</span> is not <i style="display:none">x</i>here.</p><p>Next <b hidden>open<p>one') == "What is not here.\nNext\none"


def test_names_that_mean_something_else():
    for name in ("share-price", "noticeOfRights", "alert-fatigue", "form-of-government", "header-only-library", "social-history"):
        assert main_text(f"<body><article><p>{LONG[0]}</p><div class='{name}'><p>{LONG[1]}</p></div><p>{LONG[2]}</p></article></body>") == TEXT, name
        assert main_text(f"<body><div><p>{LONG[0]}</p><div id='{name}'><p>{LONG[1]}</p></div><p>{LONG[2]}</p></div></body>") == TEXT, name
    # such names with links only, and sure names, still count
    links = "<a href=1>One thing to look at</a> <a href=2>Another thing to look at</a>"
    for part in (f"<div class='share-story'><p>{links}</p></div>", f"<div class='share-buttons'><p>{LONG[1]}</p></div>", f"<div class='google-ads'><p>{LONG[1]}</p></div>"):
        assert main_text(f"<body><article>{BODY}{part}</article></body>") == TEXT, part


def test_blocks_beside_the_article_without_telling_names():
    notice = "<div class='x1'><p>We use cookies to make this long notice as long as any paragraph. Accept them all, please do.</p></div>"
    advert = "<div class='x3'><p>Buy things now, they are cheap, they are good, they are yours for a very small price indeed.</p></div>"
    assert main_text(f"<body>{notice}<div class='x2'>{BODY}</div>{advert}</body>") == TEXT
    assert main_text(f"<body><div>{notice}<div class='x2'><h1>Title</h1>{BODY}</div>{advert}</div></body>") == "Title\n" + TEXT
    # what a heading leads to is part of the article
    assert main_text(f"<body><h1>Title</h1><div><p>A short lead.</p></div><div>{BODY}</div></body>") == "Title\nA short lead.\n" + TEXT


def test_deep_pages_take_linear_time():
    import time

    def seconds(n):
        begun = time.process_time()
        assert main_text("<div>" + "<div>".join("<b>x</b> <b>y</b> <b>z</b> <b>u</b> <b>v</b>" for _ in range(n)))
        return time.process_time() - begun

    seconds(500)
    assert seconds(4000) < 6 * max(seconds(1000), 0.05)
