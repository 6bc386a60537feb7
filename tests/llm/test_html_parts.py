"""Parts of articles and what surrounds them: named cases, and precision and recall over labelled pages."""

import re

import pytest
from wardline.llm import html

ONE = "The council met on Monday to hear what the harbour would cost, and who might pay for it in the end."
TWO = "Nobody in the room had expected the answer to be so short, or the applause to last as long as it did."
BODY = f"<h1>Harbour</h1><p>{ONE}</p>"
WANT = ["Harbour", ONE]


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        (f'<section class="menu"><h2>Starters</h2><p>{TWO}</p></section>', ["Starters", TWO]),
        (f'<div class="share price"><p>{TWO}</p></div>', [TWO]),
        (f'<div class="reply-from-minister"><p>{TWO}</p></div>', [TWO]),
        (f'<div id="ads-explained"><p>{TWO}</p></div>', [TWO]),
        ("<p>Press the <button>red</button> button twice, then wait.</p>", ["Press the red button twice, then wait."]),
        ('<div class="header note"><p>It rained.</p></div>', ["It rained."]),
        ('<div class="related-work"><p>See also Smith, 1999.</p></div>', ["See also Smith, 1999."]),
        (f'<aside class="note"><p>{TWO}</p></aside>', []),
        ('<div class="share"><button>Share</button> <button>Save</button></div>', []),
        ("<p><button>Print</button></p>", []),
        ('<div class="related"><a href=x>See that story</a> <a href=y>and that one.</a></div>', []),
        ('<div class="social">Follow us.</div>', []),
        ('<ul class="menu"><li>Home</li><li>News</li><li>Sport</li></ul>', []),
        (f'<section class="comments-list"><p>{TWO}</p></section>', []),
        (f'<div class="ad-box"><p>{TWO}</p></div>', []),
        (f'<div class="cookie-banner"><p>{TWO}</p></div>', []),
    ],
)
def test_parts_of_an_article(part, kept):
    assert html.extract(f"<body><nav><a href=/>Home</a></nav><article>{BODY}{part}</article><footer>Imprint</footer></body>", None).split("\n\n") == WANT + kept


ARTICLE, AROUND = "a", "x"
LINKS = '<ul><li><a href="/a">Politics</a></li><li><a href="/b">Sport today</a></li></ul>'
FRAMES = [
    "<body><header><a href=/>Daily</a></header><nav>{links}</nav><article>{a}</article><footer>Imprint and terms.</footer></body>",
    '<body><div id="header">Daily</div><div id="content"><div class="post-body">{a}</div></div><div id="sidebar">{x}</div><div id="footer">Imprint.</div></body>',
    '<body><main><article>{a}</article><div class="sidebar"><p>{x}</p></div></main></body>',
    '<body><main><div class="article-text">{a}</div><section class="comments"><p>{x}</p><p>{x}</p></section></main></body>',
    '<body><div class="wrapper"><div class="topbar">{x}</div><div class="col main-col">{a}</div><div class="widget">{links}</div></div></body>',
    '<body><table><tr><td class="nav">{links}</td><td>{a}</td></tr></table></body>',
    '<body><div class="cookie-notice"><p>{x}</p><button>Accept</button></div><article>{a}<section class="comments"><p>{x}</p></section></article></body>',
    '<body><article>{a}<div class="ad"><p>{x}</p></div><form><p>{x}</p></form></article><aside>{x}</aside></body>',
]
INSIDE = [
    "<p>{0}</p><p>{1}</p>", '<p>{0}</p><div class="pull quote">{1}</div>', "<p>{0}</p><ul><li>{1}</li><li>{2}</li></ul>", '<h2>{2}</h2><p>{0}</p><section class="menu"><p>{1}</p></section>',
    '<p>{0}</p><div class="share price">{1}</div><p>{2}</p>', "<p>{0}</p><blockquote>{1}</blockquote><table><tr><td>{2}</td></tr></table>", '<div class="section"><p>{0}</p></div><div class="section"><p>{1}</p></div>', '<p>{0} <a href="/s">{1}</a></p><p>{2}</p>',
]


def labelled():
    """Pages with their article's words, marked a0, a1, ...; all other words are not of the article."""
    text = lambda mark, n, k: " ".join(f"{mark}{k}w{i}" for i in range(n)) + "."
    for f, frame in enumerate(FRAMES):
        for i, inner in enumerate(INSIDE):
            parts = [text(ARTICLE, 18 + 7 * j, f"{f}p{i}q{j}") for j in range(3)]
            used = inner.format(*parts)
            yield frame.format(a=used, x=text(AROUND, 15, f"{f}p{i}"), links=LINKS), set(re.findall(rf"\b{ARTICLE}\d+p\d+q\d+w\d+", used))


def test_precision_and_recall_on_labelled_pages():
    right = found = wanted = 0
    for page, words in labelled():
        got = {w.rstrip(".") for w in html.extract(page, None).split()}
        right, found, wanted = right + len(got & words), found + len(got), wanted + len(words)
    print(f"precision {right / found:.4f}, recall {right / wanted:.4f}")
    assert right / found >= 0.97 and right / wanted >= 0.97
