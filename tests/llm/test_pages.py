"""Pages whose markup misleads: names of states and uses, page-wide forms, sections within sections."""

import time

import pytest

from weftline.llm.html_text import main_text

PARAGRAPHS = [f"Paragraph number {i} of the article, with some words, commas, and a sentence that ends here." for i in range(8)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
FRAME = '<html><body><div class="menu"><a href="/">Home</a></div>{}<div class="footer">Copyright 2020</div></body></html>'
NAMES = [
    "overflow-hidden", "hidden-xs", "post hidden-print", "ad-free", "menu-open", "nav-open wrap", "js-nav", "modal-open", "consent-given", "comments-enabled", "page comments-open",
    "single-post comment", "related-content", "story promo",
]


@pytest.mark.parametrize("name", NAMES)
def test_a_container_of_any_name(name):
    text = main_text(FRAME.format(f'<div class="{name}"><h1>Title</h1>{BODY}</div>'))
    assert text.split("\n") == ["Title", *PARAGRAPHS]


def test_a_form_round_the_page():
    page = f'<body><form action="/" method="post"><input type="hidden" value="x"><div class="nav"><a href="/">Home</a></div><div>{BODY}</div></form></body>'
    assert main_text(page).split("\n") == PARAGRAPHS
    small = f"<body><div>{BODY}</div><form><label>Your name</label> <button>Send</button></form></body>"
    assert main_text(small).split("\n") == PARAGRAPHS


@pytest.mark.parametrize("wrap", ["<div><div>{}</div></div>", "<section><div>{}</div></section>", "<div><div><div>{}</div></div></div>"])
def test_sections_within_sections(wrap):
    want = [[f"Part {i}", f"First text of section {i}, which has a few words, and ends.", f"Second text of section {i}, a bit longer than the first one, and ends too."] for i in range(6)]
    parts = "".join(wrap.format(f"<h2>{h}</h2><p>{a}</p><p>{b}</p>") for h, a, b in want)
    assert main_text(FRAME.format(f'<div id="content">{parts}</div>')).split("\n") == [x for w in want for x in w]


def test_a_list_after_the_text():
    page = f"<body><div><div>{BODY}</div><ul><li>one thing</li><li>another</li></ul><ul><li><a href='/a'>elsewhere</a></li></ul></div></body>"
    assert main_text(page).split("\n") == [*PARAGRAPHS, "one thing", "another"]


def test_comments_and_adverts_stay_out():
    reader = "".join(f'<div class="comment"><p>Reader {i} says that this is all wrong, and very long to read, and so on and on, for ever.</p></div>' for i in range(60))
    page = f'<body><div class="post"><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p></div><div id="comments">{reader}</div></body>'
    assert main_text(page).split("\n") == PARAGRAPHS[:2]
    advert = f'<body><article><h1>A</h1></article><div class="ad">{PARAGRAPHS[0]}</div></body>'
    assert main_text(advert) == "A"
    inner = FRAME.format(f'<div class="story promo">{BODY}<div class="ad">Buy now, it is cheap, and good, and will not last for long, so hurry up, all of you.</div></div>')
    assert main_text(inner).split("\n") == PARAGRAPHS


def test_time_grows_with_the_length():
    for page in ("<div>" * 100_000 + "x", "<div><p>a, b.</p>" * 50_000, '<div class="ad"><p>a, b.</p></div>' * 50_000, "<form><p>a, b." * 50_000):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 30
