"""Main text of web pages: a bidirectional LSTM labels every leaf block in the context of its whole page.

A page is cut into leaf blocks (text between block-level tags). A block is described by hashed vectors of its tag path
(names, whole class and id values, their words and the last ones' character n-grams), hashed words, and a few shares; numpy LSTMs read the page's blocks in both directions, and a logistic
unit calls each block article or not. The labeller is trained here, with a fixed seed, on pages made from invented words in
many layouts (semantic tags, class names, tables, broken markup, and asides, footers, adverts and captions inside the article); it
reads no table.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices

#: Elements without an end tag, those whose content is no text, and those inside a line. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg object select math canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CODE = frozenset("script style".split())
_CLOSES_SAME = frozenset("li dt dd tr td th option".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[a-z]+")

PATH, OWN, GRAMS, WORDS, SHARES = 96, 32, 48, 64, 9
INPUT = PATH + OWN + GRAMS + WORDS + SHARES
#: An element: the one around it, its name, class words and whole class values, the buckets that all names down to here fall into (a bit each), the last four names.
Node = tuple["Node | None", tuple[str, ...], int, tuple[str, ...]]
#: Element, words, words inside links.
Block = tuple[Node | None, list[str], int]


@lru_cache(maxsize=20_000)
def _bit(name: str) -> int:
    return 1 << zlib.crc32(name.encode()) % PATH


def _names(attributes: str) -> list[str]:
    """Words of the classes, ids and roles, and each value of several words whole."""
    out = []
    for found in _NAMES.findall(attributes) if attributes else ():
        for value in "".join(found).lower().split():
            words = _PART.findall(value)
            out += words
            if len(words) > 1:
                out.append("-".join(words))
    return out


def path(node: Node | None) -> list[str]:
    """Names and class words from an element outwards."""
    out = []
    while node:
        out += reversed(node[1])
        node = node[0]
    return out


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. An element costs the same however deep it lies, as it holds the one around it and not its path."""
    out: list[Block] = []
    stack: list[tuple[str, Node]] = []
    endless: set[str] = set()  # names without a later end tag
    counts: dict[str, int] = {}
    pieces: list[str] = []
    linked: list[str] = []
    last_end = page.rfind(">")

    def flush() -> None:
        if pieces:
            words = "".join(pieces).split()
            if words:
                out.append((stack[-1][1] if stack else None, words, len("".join(linked).split())))
            pieces.clear()
            linked.clear()

    def pop(name: str) -> None:
        while stack:
            last = stack.pop()[0]
            counts[last] -= 1
            if last == name:
                return

    def add(text: str) -> None:
        text = entities.unescape(text) if "&" in text else text
        pieces.append(text)
        if counts.get("a"):
            linked.append(text)

    at, n = 0, len(page)
    while at < n:
        opened = page.find("<", at)
        if opened < 0:
            add(page[at:])
            break
        if opened > at:
            add(page[at:opened])
        nxt = page[opened + 1 : opened + 2]
        if nxt == "!" or nxt == "?":
            end = page.find("-->", opened + 4) if page.startswith("<!--", opened) else page.find(">", opened)
            at = n if end < 0 else end + (3 if page.startswith("<!--", opened) else 1)
            continue
        m = _TAG.match(page, opened) if opened < last_end else None
        if not m:
            end = page.find(">", opened) if opened < last_end and (nxt.isalpha() or nxt == "/") else -1
            if end < 0:
                add("<")
                at = opened + 1
            else:
                at = end + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name not in INLINE:
                flush()
            if counts.get(name):
                pop(name)
            continue
        if name in RAW:
            if name in ("svg", "math") and m[3].endswith("/"):
                continue
            close = None if name in endless else re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            elif name in _CODE:
                at = n
            else:  # only the tag is skipped
                endless.add(name)
            continue
        if name in INLINE:
            if name == "br":
                add(" ")
        else:
            flush()
            if counts.get("p") and name not in VOID:
                pop("p")
            if name in _CLOSES_SAME and stack and stack[-1][0] == name:
                pop(name)
        if name not in VOID:
            names = (name, *_names(m[3]))
            around = stack[-1][1] if stack else None
            bits, last = around[2:] if around else (0, ())
            for x in names:
                bits |= _bit(x)
            stack.append((name, (around, names, bits, (last + names)[-4:])))
            counts[name] = counts.get(name, 0) + 1
    flush()
    return out


@lru_cache(maxsize=20_000)
def _path_vector(bits: int, last: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH + OWN + GRAMS, np.float32)
    v[[k for k in range(PATH) if bits >> k & 1]] = 1
    for x in last:
        v[PATH + zlib.crc32(b"own" + x.encode()) % OWN] = 1
        for k in range(len(x) - 3):
            v[PATH + OWN + zlib.crc32(x[k : k + 4].encode()) % GRAMS] = 1
    return v


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS
        return value


_BUCKETS = _Buckets()


def vectors(pages: list[list[Block]], first: int = 0, of: int | None = None) -> np.ndarray:
    """A row for each block of the pages, in order; of a stretch of a page, whose first block is number `first` of `of`."""
    flat = [b for page in pages for b in page]
    x = np.zeros((len(flat), INPUT), np.float32)
    if not flat:
        return x
    n = np.fromiter((len(w) for _, w, _ in flat), np.int64, len(flat))
    x[:, : PATH + OWN + GRAMS] = np.stack([_path_vector(*(p[2:] if p else (0, ()))) for p, _, _ in flat])
    ids = np.fromiter((_BUCKETS[w] for _, words, _ in flat for w in words), np.int64, int(n.sum()))
    bag = np.bincount(np.repeat(np.arange(len(flat)), n) * WORDS + ids, minlength=len(flat) * WORDS)
    x[:, PATH + OWN + GRAMS : -SHARES] = bag.reshape(-1, WORDS) / n[:, None] * 2
    share = x[:, -SHARES:]
    share[:, 0] = np.log1p(n) / 4
    share[:, 1] = np.fromiter((k for _, _, k in flat), np.float64, len(flat)) / n
    share[:, 2] = np.fromiter((w[-1][-1] in ".!?\"" for _, w, _ in flat), np.float32, len(flat))
    share[:, 3] = np.fromiter((any(not c.isalnum() for c in w[0][:1]) for _, w, _ in flat), np.float32, len(flat))
    share[:, 4] = np.fromiter((w[0][0] == "©" for _, w, _ in flat), np.float32, len(flat))
    place = np.concatenate([(first + np.arange(len(p))) / max(1, (of or len(p)) - 1) for p in pages if p])
    share[:, 5], share[:, 6] = place, 1 - place
    share[:, 7] = n < 6
    share[:, 8] = n > 20
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs of `hidden` cells and a logistic unit."""

    def __init__(self, hidden: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = h = hidden
        self.weights = {}
        for d in "fb":
            self.weights[f"x{d}"] = rng.normal(0, INPUT**-0.5, (INPUT, 4 * h)).astype(np.float32)
            self.weights[f"h{d}"] = rng.normal(0, h**-0.5, (h, 4 * h)).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1
            self.weights[f"c{d}"] = bias
        self.weights["o"] = rng.normal(0, (2 * h) ** -0.5, 2 * h).astype(np.float32)
        self.weights["p"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None, begin: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Outputs (time, page, cell) of padded pages in one direction, and the last state; keep gets what training needs.

        begin: the state that the stretch before (in this direction) ended in.
        """
        time, pages, _ = x.shape
        h = self.hidden
        z = x @ self.weights[f"x{d}"] + self.weights[f"c{d}"]
        state, cell = begin or (np.zeros((pages, h), np.float32),) * 2
        out = np.zeros((time, pages, h), np.float32)
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            gates = z[t] + state @ self.weights[f"h{d}"]
            i, f, o = (_sigmoid(gates[:, k * h : (k + 1) * h]) for k in range(3))
            g = np.tanh(gates[:, 3 * h :])
            m = mask[t][:, None]
            fresh = f * cell + i * g
            squashed = np.tanh(fresh)
            if keep is not None:
                keep.append((t, i, f, o, g, cell, state, squashed, m))
            cell = np.where(m, fresh, cell)
            state = np.where(m, o * squashed, state)
            out[t] = state
        return out, (state, cell)

    def probabilities(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        steps = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self._run(x, mask, d, own)[0] for d, own in zip("fb", steps, strict=True)], axis=2)
        if keep is not None:
            keep |= {"f": steps[0], "b": steps[1], "both": both}
        return _sigmoid(both @ self.weights["o"] + self.weights["p"][0])

    def long_probabilities(self, page: list[Block], cells: int) -> np.ndarray:
        """Those of one page, by stretches of `cells` blocks that hand on the state: no array grows with the page but one number a block."""
        n, h = len(page), self.hidden
        total = np.full(n, self.weights["p"][0], np.float32)
        for side, d in enumerate("fb"):
            state, cuts = None, range(0, n, cells)
            for a in cuts if d == "f" else reversed(cuts):
                x = vectors([page[a : a + cells]], a, n)[:, None]
                out, state = self._run(x, np.ones((len(x), 1), bool), d, None, state)
                total[a : a + len(x)] += out[:, 0] @ self.weights["o"][side * h : (side + 1) * h]
        return _sigmoid(total)

    def slopes(self, x: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        keep: dict = {}
        p = self.probabilities(x, mask, keep)
        h, n = self.hidden, max(1, mask.sum())
        error = np.where(mask, p - truth, 0).astype(np.float32) / n
        out = {k: np.zeros_like(v) for k, v in self.weights.items()}
        out["o"] = np.einsum("tp,tph->h", error, keep["both"])
        out["p"] = error.sum(keepdims=True).reshape(1)
        for side, d in enumerate("fb"):
            into = error[:, :, None] * self.weights["o"][side * h : (side + 1) * h]
            ds = dc = np.zeros((x.shape[1], h), np.float32)
            for t, i, f, o, g, cell, state, squashed, m in reversed(keep[d]):
                ds = ds + into[t]
                own_s, own_c = np.where(m, ds, 0), np.where(m, dc, 0)
                dcell = own_c + own_s * o * (1 - squashed**2)
                gates = np.concatenate([dcell * g * i * (1 - i), dcell * cell * f * (1 - f), own_s * squashed * o * (1 - o), dcell * i * (1 - g**2)], axis=1)
                out[f"x{d}"] += x[t].T @ gates
                out[f"h{d}"] += state.T @ gates
                out[f"c{d}"] += gates.sum(axis=0)
                ds = gates @ self.weights[f"h{d}"].T + np.where(m, 0, ds)
                dc = dcell * f + np.where(m, 0, dc)
        loss = -np.log(np.clip(np.where(truth, p, 1 - p), 1e-7, 1))[mask].mean()
        return out, float(loss)

    def label(self, pages: list[list[Block]], group: int = 128, cells: int = 8192) -> list[np.ndarray]:
        """For each page, whether each block is article text.

        Pages of like length run together: at most `group`, and at most `cells` places with the padding. Longer pages run alone.
        """
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            k = order[-1]
            if len(pages[k]) > cells:
                out[order.pop()] = self.long_probabilities(pages[k], cells) >= 0.5
                continue
            own = order[-min(group, cells // len(pages[k])) :]
            del order[-len(own) :]
            rows, sizes = vectors([pages[k] for k in own]), [len(pages[k]) for k in own]
            p = self.probabilities(*_padded(np.split(rows, np.cumsum(sizes)[:-1])))
            for at, k in enumerate(own):
                out[k] = p[: sizes[at], at] >= 0.5
        return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    time = max(map(len, rows))
    x, mask = np.zeros((time, len(rows), INPUT), np.float32), np.zeros((time, len(rows)), bool)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, True
    return x, mask


def examples(n: int, seed: int) -> list[tuple[str, list[str]]]:
    """Pages in many layouts, and their article blocks."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    chance = lambda p: rng.random() < p
    sounds = ("ba", "de", "in", "tion", "er", "la", "ou", "st", "re", "an", "é", "sch", "ung", "ción", "th", "he", "mi", "ko")
    word = lambda: "".join(pick(*sounds) for _ in range(rng.integers(1, 4)))

    def prose(low: int, high: int) -> str:
        out, words = [], [word() for _ in range(rng.integers(low, high + 1))]
        while words:
            k = rng.integers(4, 16)
            out.append(" ".join(words[:k]).capitalize() + pick(".", ".", ".", "!", "?"))
            words = words[k:]
        text = " ".join(out)
        text = pick(text, text, text, text.replace(" ", pick(" | ", "*** ", " - ")) if chance(0.4) else text, text.upper() if chance(0.2) else text)
        return " ".join(text.split()[: rng.integers(1, 40)]) if chance(0.15) else text  # cut off without a stop

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{pick(word(), word() + " " + word(), pick("Home", "About", "Contact", "News", "Login", "Next"))}</a></{tag}>' for _ in range(k))

    def mixed(*kinds: str) -> str:
        """A class value of junk, at times joined with a word that articles bear as well."""
        kind, common = pick(*kinds), pick("content", "post", "article", "text", "body", "main", "block", "box", "story", "entry", "section")
        return pick(kind, kind, f"{kind}-{common}", f"{common}-{kind}", f"{kind}_{common}", f"{common} {kind}")

    mixed_class = lambda *kinds: f' class="{mixed(*kinds)}"'

    def junk(kind: str) -> str:
        some = lambda: prose(3, pick(8, 30))
        inside = lambda: pick(some(), f"<p>{some()}</p>", f"<h3>{prose(1, 5)}</h3><p>{some()}</p>", f"<p>{some()}</p><p>{some()}</p>")
        return {
            "nav": lambda: pick(f"<nav><ul>{links(rng.integers(3, 9))}</ul></nav>", f'<div class="{pick("menu", "nav", "navbar", "navigation", "topnav", "post-navigation", "content-menu", "main-nav")}"><ul>{links(rng.integers(3, 9))}</ul></div>', f'<div class="breadcrumb">{links(3, "span")}</div>'),
            "header": lambda: pick(f"<header><h2>{prose(1, 4)}</h2><p>{some()}</p></header>", f'<div id="{pick("header", "masthead", "banner", "topbar")}">{some()}</div>'),
            "ad": lambda: f'<{(t := pick("div", "div", "aside", "section", "p"))} class="{mixed("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promoted", "ad-slot", "banner ad")}">{some() if t == "p" else inside()}</{t}>',
            "side": lambda: f'<{(t := pick("aside", "div"))} class="{mixed("sidebar", "side", "widget", "related", "recommended", "popular", "more")}"><h3>{prose(1, 4)}</h3>{pick(f"<ul>{links(rng.integers(2, 6))}</ul>", f"<p>{some()}</p>")}</{t}>',
            "aside": lambda: f"<aside>{pick(f'<h3>{prose(1, 5)}</h3>', f'<h4>{prose(1, 5)}</h4>', '')}{pick(some(), f'<p>{some()}</p>', f'<p>{some()}</p><p>{some()}</p>', f'<ul>{links(rng.integers(2, 6))}</ul>')}</aside>",
            "end": lambda: f'<footer{pick("", "", "", mixed_class("footer", "foot", "meta"))}>{inside()}</footer>',
            "notice": lambda: f'<div class="{mixed("cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "disclaimer")}"><p>{pick("We use cookies.", "Accept all cookies to go on.", "Subscribe now!", "", "")} {some()}</p>{pick("", "<button>Accept</button>")}</div>',
            "form": lambda: f'<form action="/{word()}" class="{pick("search", "login", "signup", "")}"><label>{some()}</label><input name="q"><button>{pick("Search", "Send", "Sign up", "Log in")}</button></form>',
            "comments": lambda: f'<{(t := pick("section", "div", "ul"))} {pick("class", "id")}="{mixed("comments", "comment-list", "discussion", "responses", "replies")}">{pick("<h3>Comments</h3>", "<h3>3 comments</h3>", "<h3>Responses</h3>", f"<h3>{prose(1, 3)}</h3>", "", "", "")}' + "".join(f'<{(u := pick("div", "li", "article"))} class="{pick("comment", "reply", "comment-body", "comment-content")}"><p>{prose(3, 40)}</p></{u}>' for _ in range(rng.integers(1, 6))) + f"</{t}>",
            "share": lambda: f'<div class="{pick("share", "social", "tags", "pagination", "byline meta", "author-bio")}">{pick(links(3, "span"), some())}</div>',
            "footer": lambda: pick(f"<footer>{pick('&copy; ', '', '© ')}{word()}.example.com &middot; {some()}</footer>", f'<div id="footer" class="{pick("footer", "site-footer", "copyright", "bottom")}"><p>{pick("&copy; 2020 ", "")}{some()}</p></div>', f"<footer><ul>{links(4)}</ul><p>{some()}</p></footer>"),
        }[kind]()

    out = []
    for _ in range(n):
        body = []
        for _ in range(pick(1, 2, 3, 5, 8, 12)):
            body.append((pick("p", "p", "p", "p", "p", "h2", "li", "blockquote", "pre", "h3", "figcaption"), prose(1, pick(3, 12, 40, 120))))
        title = prose(1, pick(5, 12))
        inner, truth = "", []
        if chance(0.7):
            inner += f"<h1>{title}</h1>"
            truth.append(title)
        plain = chance(0.15)
        for tag, text in body:
            if plain:
                tag = "div"
            if tag == "li":
                inner += f"<ul><li>{text}</li></ul>"
            elif tag == "figcaption":
                inner += f'<figure{pick("", "", mixed_class("image", "photo", "media"))}>{pick(f'<img src="/{word()}.jpg" alt="">', "")}<figcaption>{text}</figcaption></figure>'
            elif tag == "p" and chance(0.1):
                inner += f'<p class="{pick("lead", "intro", "text", "body-text", "first", "summary")}">{text}</p>'
            elif tag == "p" and chance(0.2):
                inner += pick(f"<p><b>{text}<br>", f"<p>{text}", f"<p><a href='/{word()}'>{text}</a></p>")
            else:
                inner += f"<{tag}>{text}</{tag}>"
            truth.append(text)
            if chance(0.1):
                inner += junk(pick("ad", "ad", "side", "aside", "aside", "share", "notice", "form"))
        inner += junk("end") if chance(0.15) else ""
        wrap = pick("article", "article", "main", "content", "post", "nested", "table", "bare")
        article = {
            "article": lambda: f"<article>{inner}</article>", "main": lambda: f"<main>{inner}</main>", "content": lambda: f'<div class="{pick("content", "entry-content", "article-body", "article-content", "post-content", "main-content", "main", "text", "story")}">{inner}</div>', "post": lambda: f'<div id="{pick("post", "main", "article")}-{rng.integers(9)}" class="post">{inner}</div>',
            "nested": lambda: f'<main><article class="{pick("post", "hentry")}"><div class="body">{inner}</div></article></main>', "table": lambda: f"<table><tr><td>{inner}</td></tr></table>", "bare": lambda: inner,
        }[wrap]
        def deep(part: str) -> str:
            k = pick(0, 0, 0, 0, 0, 1, 3, 8, 20)
            wrap = pick("<div>", "<div>", f'<div class="{word()}">', f'<section id="{word()}">')
            return wrap * k + part + f"</{wrap[1:4] if wrap[1] == 'd' else 'section'}>" * k

        before = [k for k in ("notice", "header", "nav", "form", "ad", "side", "aside") if chance(0.5)] if chance(0.7) else []
        after = [k for k in ("share", "side", "aside", "ad", "comments", "form", "notice") if chance(0.35)] + (["footer"] if chance(0.85) else [])
        body_open, body_close = pick(("", ""), ("", ""), ("", ""), ("<div>" * (k := int(rng.integers(1, 25))), "</div>" * k))
        parts = [f"<title>{pick(title, title[:60], prose(2, 8))}</title>" if chance(0.65) else "", *(deep(junk(k)) for k in before), deep(article()), *(deep(junk(k)) for k in after)]
        out.append(("<!DOCTYPE html><html><head>" + parts[0] + "</head><body>" + body_open + "".join(parts[1:]) + body_close + pick("</body></html>", "</body></html>", ""), truth))
    return out


@lru_cache(maxsize=2)
def trained(n: int = 3000, epochs: int = 9, batch: int = 40, seed: int = 5, rate: float = 0.012) -> Labeller:
    """The labeller after `epochs` passes of Adam over n made pages: a running mean of the weights over the last three."""
    data = []
    for page, truth in examples(n, seed):
        own = blocks(page)
        left = [" ".join(entities.unescape(t).split()) for t in truth]
        label = np.zeros(len(own), bool)
        for k, (_, words, _) in enumerate(own):
            if left and " ".join(words) == left[0] and not (k == 0 and own[k][0] and own[k][0][1] == ("title",)):
                label[k] = True
                left.pop(0)
        data.append((vectors([own]), label))
    model, rng = Labeller(seed=seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step, mean = 0, None
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        alike = [sorted(order[a : a + 8 * batch], key=lambda k: len(data[k][1])) for a in range(0, len(order), 8 * batch)]  # little padding
        groups = [part[a : a + batch] for part in alike for a in range(0, len(part), batch)]
        for g in rng.permutation(len(groups)):
            own = [data[k] for k in groups[g]]
            x, mask = _padded([r for r, _ in own])
            truth = np.zeros(mask.shape, bool)
            for k, (_, label) in enumerate(own):
                truth[: len(label), k] = label
            slopes, _ = model.slopes(x, mask, truth)
            step += 1
            pace = rate * (0.5 if epoch >= epochs - 2 else 1) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, slope in slopes.items():
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                model.weights[k] = model.weights[k] - pace * first[k] / (np.sqrt(second[k]) + 1e-8)
            if epoch >= epochs - 3:
                mean = {k: v + ((mean or model.weights)[k] - v) * 0.99 for k, v in model.weights.items()}
    model.weights = mean or model.weights
    return model


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of pages: page_id, url, text, n_chars, n_blocks, n_kept.

    Article blocks in page order, white space inside each made one space, joined by two line feeds. Null and empty html give an
    empty text. The whole page is read. Repeated rows give equal rows; an empty table gives none; other columns are not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in byte_slices(batches, "html", 4 << 20):
            own = [blocks(x or "") for x in part.column("html").to_pylist()]
            labels = model.label(own)
            texts = ["\n\n".join(" ".join(b[1]) for b, keep in zip(page, label, strict=True) if keep) for page, label in zip(own, labels, strict=True)]
            counts = ([len(t) for t in texts], [len(p) for p in own], [int(x.sum()) for x in labels])
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    source = pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"cast(`{url_col}` as string) as url", f"cast(`{html_col}` as string) as html")
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
