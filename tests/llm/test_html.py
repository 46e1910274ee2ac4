"""What lies inside an article and is none of it, captions, and blocks held against the standard library's parser."""

import re
from html.parser import HTMLParser

import pytest

from parlance.llm import html_text

TITLE = "Bridge news"
FIRST = "The council met on Monday to talk about the bridge that was closed last year. Many people came to the hall."
LAST = "After the talk the mayor said that the work would begin in spring and end before winter comes again."
OTHER = "Read how the harbour was built in ten years by a hundred men."


def _article(page):
    own = html_text.blocks(page)
    return [" ".join(b[1]) for b, keep in zip(own, html_text.trained().label([own])[0], strict=True) if keep]


def _page(inner, last=""):
    return f"<html><head><title>{TITLE}</title></head><body><nav><a href='/'>Home</a> <a href='/a'>About</a></nav><article><h1>{TITLE}</h1><p>{FIRST}</p>{inner}<p>{LAST}</p>{last}</article><footer><p>&copy; town paper</p></footer></body></html>"


@pytest.mark.parametrize(
    "inner",
    [
        f"<aside><h3>Also of interest</h3><p>{OTHER}</p></aside>",
        f"<aside><p>{OTHER}</p></aside>",
        f"<div class='sponsored-content'><p>{OTHER}</p></div>",
        f"<div class='content-ad'><p>{OTHER}</p></div>",
        f"<div class='promoted-story'>{OTHER}</div>",
        f"<div class='related-articles'><h3>More</h3><ul><li><a href='/b'>Harbour</a></li><li><a href='/c'>Market</a></li></ul></div>",
        "<form action='/join'><label>Your address</label><button>Sign up</button></form>",
    ],
)
def test_parts_that_are_no_article(inner):
    assert _article(_page(inner)) == [TITLE, FIRST, LAST]


def test_footer_of_the_article():
    assert _article(_page("", "<footer><p>Filed under local matters by the editors of the town paper.</p></footer>")) == [TITLE, FIRST, LAST]


def test_captions_are_article():
    caption = "The old bridge in the morning light."
    assert _article(_page(f"<figure><img src='a.jpg' alt=''><figcaption>{caption}</figcaption></figure>")) == [TITLE, FIRST, caption, LAST]


class _Plain(HTMLParser):
    """Texts between the tags of blocks, and the tags that are open there, of markup without errors."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text, self.found = [], [], []

    def _cut(self):
        words = "".join(self.text).split()
        if words:
            self.found.append((" ".join(words), [t for t in self.open[::-1] if t not in html_text.INLINE]))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        elif tag not in html_text.INLINE:
            self._cut()
        if tag not in html_text.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self._cut()
        self.open.pop()

    def handle_data(self, data):
        if not set(self.open) & html_text.RAW:
            self.text.append(data)


def test_blocks_are_those_of_the_standard_parser():
    seen = 0
    for page, _ in html_text.examples(150, 99):
        plain = _Plain()
        if len(re.findall("<p[ >]", page)) != page.count("</p>") or not page.endswith("</html>"):
            continue  # left open on purpose: the two need not agree
        plain.feed(page)
        plain._cut()
        own = [(" ".join(words), [x for x in _tags(node) if x not in html_text.INLINE]) for node, words, _ in html_text.blocks(page)]
        assert own == plain.found
        seen += 1
    assert seen > 30


def _tags(node):
    out = []
    while node:
        out.append(node[1][0])
        node = node[0]
    return out


def test_names_keep_whole_values():
    assert html_text._names(' class="Sponsored-Content big" id=x-1') == ["sponsored", "content", "sponsored-content", "big", "x"]
    assert html_text._names("") == []
