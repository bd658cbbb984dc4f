"""Main text of pages of known kinds."""

import pytest

from stemma.llm.html_text import main_text

BODY = "This is a sentence of the body, which is long enough to be one. " * 3
TEXT = BODY.strip()


@pytest.mark.parametrize(
    "tag",
    [
        'div style="overflow:hidden"',
        'div title="hidden costs"',
        'div data-id="sidebar"',
        'section id="related-work"',
        'section id="comments"',
        'h2 id="cookies"',
        'p class="share-price"',
        'p class="nav-theory"',
        "p data-x='a' title='class=ad'",
    ],
)
def test_loose_matches_drop_nothing(tag):
    name = tag.split()[0]
    html = f"<article><p>{BODY}</p><{tag}>Kept words.</{name}><p>{BODY}</p></article>"
    assert main_text(html) == f"{TEXT}\nKept words.\n{TEXT}"
    assert main_text(f"<body><{tag}><article><p>{BODY}</p></article></{name}></body>") == TEXT or name != "div"


@pytest.mark.parametrize("tag", ["div hidden", 'div class="ad"', 'div class="x cookie-banner"', 'div id="ad_slot_1"', 'div class="related-posts"', 'div aria-hidden="true"', "div CLASS=Comments", 'section class="newsletter"'])
def test_what_is_apart_stays_out(tag):
    name = tag.split()[0]
    assert main_text(f"<article><p>{BODY}</p><{tag}>Not text.</{name}><p>{BODY}</p></article>") == f"{TEXT}\n{TEXT}"


def test_open_paragraphs_end_at_the_next_block():
    assert main_text(f'<article><p class="ad">Advert.<p>{BODY}<p class="ad">Advert.<h2>Heading</h2><p>{BODY}</article>') == f"{TEXT}\nHeading\n{TEXT}"
    assert main_text('<article><ul><li class="ad">Advert.<li>One<ul><li class="ad">Advert.<li>Two</ul><li>Three</ul></article>') == "One\nTwo\nThree"


MENU = "<nav>" + "".join(f'<div><a href="/{i}">menu {i}</a></div>' for i in range(4)) + "</nav>"


def test_short_stretches_of_pages_without_marks():
    page = f"<body>{MENU}<h1>Heading</h1>{MENU}<div>{BODY}</div><div>{BODY}</div>{MENU}<p>Closing words.</p>{MENU}<p>Far below.</p></body>"
    assert main_text(page) == f"Heading\n{TEXT}\n{TEXT}\nClosing words."


def test_teasers_do_not_hide_the_body():
    teasers = "".join(f"<article><h3>Teaser {i}</h3></article>" for i in range(3))
    page = f"<body><h1>Heading</h1><div>{BODY}</div><div>{BODY}</div>{MENU}{teasers}</body>"
    assert main_text(page) == f"Heading\n{TEXT}\n{TEXT}"


def test_articles_are_whole_and_outweigh_the_rest():
    page = f"<body>{MENU}<h1>Heading</h1><article>{MENU}<p>{BODY}</p>{MENU}<p>One.</p>{MENU}<p>Two.</p></article><p>Closing words.</p>{MENU}<div>Far below.</div></body>"
    assert main_text(page) == f"Heading\n{TEXT}\nOne.\nTwo.\nClosing words."
    assert main_text("") == main_text(None) == main_text("<nav>x</nav>") == ""
