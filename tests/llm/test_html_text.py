import pytest

from comarca.llm import html_text as H

TREE = H.labelled_tree()
LONG = "This paragraph has enough plain words in a row to be taken for a part of some article."

PAGES = [
    (f"<nav><a href=x>Home</a></nav><article><h1>A title</h1><p>{LONG}</p><p>Yes.</p></article><footer>(c)</footer>",
     f"A title {LONG} Yes."),
    (f'<div id="cookie-notice">{LONG}</div><div class="post"><p>{LONG}<br>More</p><div class="ad">{LONG}</div></div>',
     f"{LONG} More"),
    (f"<article><p>one &amp; t<b>w</b>o&nbsp;&#51; &lt;b&gt;\n  {LONG}<script>if (a < b) x('</p>')</script></article>",
     f"one & two 3 <b> {LONG}"),
    (f"<main><p>{LONG}</p></main><section id=comments><article class=comment><p>{LONG}</p></article></section>", LONG),
    (f"<header><p>{LONG}</p></header><div class='has-sidebar'><main>{LONG}</main><aside>{LONG}</aside></div>", LONG),
    (f"<form><p>{LONG}</p></form><main>{LONG}<style>p {{}}</style><!-- {LONG} --></main>", LONG),
    (f"<article><p><b>Unclosed<p>{LONG}", f"Unclosed {LONG}"),
    (f"<ul><li><a>One</a><li><a>Two</a></ul><div><p>{LONG} {LONG}</p><p>{LONG}</p></div><p><a>Next page</a></p>",
     f"{LONG} {LONG} {LONG}"),
    (f'<div class="social-science"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG} {LONG}"),
    (f"<body><form id=aspnetForm><nav><a>Home</a></nav><article><p>{LONG}</p></article></form></body>", LONG),
    (f"<form><input><div><p>{LONG}</p><p>{LONG}</p></div></form><p><a>Imprint</a></p>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><p><a href=x>{LONG}</a></p><p>{LONG}</p></article>", f"{LONG} {LONG} {LONG}"),
    (f'<article><p>{LONG}</p><div class="news-alert-body"><p>{LONG}</p></div></article>', f"{LONG} {LONG}"),
    ("<div><p>A page with ten plain words in one short paragraph.</p></div>", "A page with ten plain words in one short paragraph."),
    (f'<main><p>{LONG}</p></main><div class="user-comments"><div class="comment-body"><p>{LONG}</p></div></div>', LONG),
    (f'<div class="sponsored-content"><p>{LONG}</p></div><article>{LONG}</article><div id=site-footer>{LONG}</div>', LONG),
    ("<nav><a>only</a></nav>", ""),
    ("<article>cut <a hre", "cut"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_articles(page, text):
    assert H.main_text(page, TREE) == text


NAMES = {
    "social-science": "", "newsAlertBody": "main", "has-sidebar": "", "travel-warning": "", "header-image": "", "x2": "",
    "sidebar-left": "aside", "siteFooter": "aside", "cookie-notice": "aside", "weather-widget": "aside", "ad-slot-3": "aside",
    "sponsored-content": "aside", "post-comments": "comment", "comment-body": "comment", "user-comments": "comment",
    "entry-content": "main", "article": "main", "Nav": "aside",
}


@pytest.mark.parametrize("token, says", NAMES.items())
def test_names(token, says):
    assert H.named(token) == says


def test_the_tree_fits_its_table():
    rows = [(page, row) for page in H.LABELLED for row in page]
    right = 0
    for page in H.LABELLED:
        for x, row in zip(H.features([(w, a / w, h, bool(d)) for w, a, h, d, _ in page]), page, strict=True):
            right += H.answer(TREE, x) == row[4]
    assert right / len(rows) > 0.97


def test_extract(spark):
    pages = spark.createDataFrame(
        [(i, f"u{i}", p, "c", 1) for i, (p, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], "c", 1), (0, "u0", PAGES[0][0], None, 2)],
        "page_id long, url string, html string, text string, n_chars int",
    )
    found = H.extract(pages).collect()
    assert len(found) == len(PAGES) + 2
    for r in found:
        assert r["n_chars"] == len(r["text"]) and r["text"] == PAGES[r["page_id"] or 0][1]
    assert H.extract(pages.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "u", "<article>" + f"<p>{LONG}</p>" * 5000)], "page_id long, url string, html string")
    assert H.extract(long).first()["text"] == " ".join([LONG] * 5000)
