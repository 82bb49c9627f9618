"""Pages with known text: open and odd elements, and each kind of boilerplate."""

import time

import pytest

from prismal.llm import html_text

ARTICLE = "The river rose again on Monday, and the old bridge was closed until the water fell. Nobody in the town was hurt, said the mayor."
SECOND = "Repairs will start next week, the council decided, and they should take a month or so if the weather stays dry."
OPENINGS = {
    "head without an end": "<html><head><title>T</title><body>",
    "head without an end or body": "<html><head><title>T</title><meta charset=utf-8>",
    "title without an end": "<head><title>T</head><body>",
    "closed svg": '<body><svg class="i"/>',
    "open svg": '<body><svg class="i"><path d="M0 0"/>',
    "svg that is closed": "<body><svg><title>icon</title><g></g></svg>",
    "empty comment": "<body><!-->",
    "short comment": "<body><!--->",
    "comment with a bang": "<body><!-- x --!>",
    "open button": "<body><button>",
    "open select": "<body><select><option>en<option>de",
    "open object": "<body><object data=x>",
    "open video": "<body><video src=x>",
    "open noscript": "<body><noscript>",
    "names that only begin alike": "<body><svg-icon></svg-icon><button-bar></button-bar>",
}


def article(opening: str) -> str:
    return f"{opening}<article><h1>The river</h1><p>{ARTICLE}</p><p>{SECOND}</p></article></body></html>"


@pytest.mark.parametrize("name", OPENINGS)
def test_no_opening_takes_the_article_away(spark, name):
    texts = [t for t, _, _ in html_text.blocks(article(OPENINGS[name]))]
    assert texts[-3:] == ["The river", ARTICLE, SECOND] and not {"T", "icon", "en", "de"} & set(texts)


def test_only_the_article_is_left_of_pages_with_every_kind_of_boilerplate(spark):
    around = {
        "menu": ("<nav class=menu><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav>", ""),
        "header": ("<header class='site header'><div class=logo><a href=/>The Daily</a></div></header>", ""),
        "footer": ("", "<footer class='site footer'><p>Copyright 2024, all rights reserved</p><a href=/p>Privacy policy</a></footer>"),
        "sidebar": ("", "<aside class=sidebar><h3>Related</h3><ul><li><a href=/1>More stories</a></li><li><a href=/2>Trending</a></li></ul></aside>"),
        "notice": ("<div class='cookie banner'><p>We use cookies to improve your experience</p><button>Accept all</button></div>", ""),
        "advert": ("<div class='advert'>Sponsored: buy now</div>", ""),
        "form": ("", "<form class=newsletter><label>Subscribe to our newsletter</label><input><button>Sign up</button></form>"),
        "comments": ("", "<div class=comments><div class=comment><p>I like it</p><a href=#>Reply</a></div></div>"),
        "script": ("<script>var a = '<p>no</p>'</script>", "<style>p {color: red}</style>"),
    }
    pages = [(k, f"u{k}", f"<html><head><title>T</title></head><body>{a}<article class=content><h1>The river</h1><p>{ARTICLE}</p><p>{SECOND}</p></article>{z}</body></html>") for k, (a, z) in enumerate(around.values())]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    wrong = {name: found[k] for k, name in enumerate(around) if found[k] != f"The river {ARTICLE} {SECOND}"}
    assert not wrong, wrong


def test_open_elements_are_read_in_linear_time():
    def seconds(n):
        page = "<button>x" * n + "<svg><select><title>" * n + "<!--" * n
        begun = time.perf_counter()
        html_text.blocks(page)
        return time.perf_counter() - begun

    seconds(1000)
    assert seconds(40_000) < 30 * max(seconds(4_000), 0.01)
