"""Personal data: pattern spans with checks, and a semi-Markov conditional random field for what patterns miss.

The field labels token sequences around digits, at signs and credential words. A candidate segment (up to MAX_TOKENS
tokens) is scored as a whole: its shape, digit count, checksums, character mix, and the words and signs on either side. A
bounded-entity dynamic programme picks boundaries and types together: forward sums in training, Viterbi in extraction. It is
trained here on sentences made from formats and invented words with a fixed seed; no table is read for it.

A kind is only open to segments that its definition admits: an email has one at sign and a dotted domain, a card passes Luhn, an IBAN its
check digits, a secret stands beside a word for credentials or has the form of a known key. URLs, file names, prices,
versions, ISBNs and DOIs admit none, so no weight can make them personal data.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices

#: Order of kinds at equal starts: pattern kinds as the contract lists them, then those that only the field finds.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
BASE = KINDS[:4]
MAX_TOKENS = 16
#: Words before a value that make it a credential or name its kind. Fixed values.
CUES = ("password", "passwd", "pwd", "passwort", "kennwort", "contraseña", "clave", "passe", "token", "secret", "apikey", "api", "key", "tel", "phone", "call", "mobile", "fax", "ssn", "social", "iban", "account", "card", "mail", "ip", "host")
_CREDENTIAL = ("password", "passwd", "pwd", "passwort", "kennwort", "contraseña", "token", "secret", "api_key", "apikey", "api-key")
#: Words that may stand between a name and its value. Fixed values.
_LINKS = ("is", "was", "ist", "lautet", "es", "est")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\W_]+|\s+|[\W_]")
_TRIGGER = re.compile(r"[0-9@]+")
_REST = re.compile(r"[^\W_]*")

_EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
_IBAN = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]){11,30}")
_COUNTRY, _BANK = re.compile(r"[A-Z]{2}\d\d"), re.compile(r"[A-Z]{1,4}")
_NATIONAL = re.compile(r"\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}")
_NUMBER = re.compile(r"[+(]?\d[\d ().-]*\d")
_CALL = ("tel", "phone", "call", "mobile", "fax")
#: Keys of widespread services by their form. Fixed values.
_KNOWN_KEY = re.compile(r"A(?:KIA|SIA)[A-Z0-9]{12,}|sk-[A-Za-z0-9-]{16,}|gh[opsu]_[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}")
_NAMED = r"(?:pass(?:word|wd|wort)|pwd|kennwort|contraseña|clave|mot de passe|token|secret|api[ _-]?key|key)"
_ASSIGNED = re.compile(rf"(?i){_NAMED}[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?$")
_SAID = re.compile(rf"(?i){_NAMED}\s(?:(?:{'|'.join(_LINKS)})\s)?[\"']?$")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether ASCII digits pass the Luhn sum."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def iban_checks(value: str) -> bool:
    """Whether an account number's check digits hold: letters are numbers from 10, and the whole, its first four signs last, is 1 modulo 97."""
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def admitted(text: str, a: int, b: int, cue: str) -> list[bool]:
    """For each of KINDS whether text[a:b] can be one by definition. cue: the word before it."""
    s, before = text[a:b], text[max(0, a - 40) : a]
    digits = _DIGIT.findall(s)
    # a number goes on over a separator: a part of a longer one is none
    part = re.search(r"\d[.,:/-]$", before) or re.match(r"[.,:/-]\d", text[b : b + 2]) or before.endswith(("/", "="))
    plain = bool(_NUMBER.fullmatch(s)) and not part
    number = "".join(digits)
    isbn = cue == "isbn" or (len(digits) == 13 and number[:3] in ("978", "979") and "-" in s)
    known = bool(_KNOWN_KEY.fullmatch(s))
    tight = not re.search(r"[\s\"'<>]|://", s) and "@" not in s
    mixed = bool(digits) and any(c.isalpha() for c in s)
    return [
        bool(_EMAIL.fullmatch(s)),
        bool((m := _IP.fullmatch(s)) and all(len(g) <= 3 and int(g) <= 255 for g in m.groups())),
        bool(_CARD.fullmatch(s)) and not part and not isbn and 12 <= len(digits) <= 19 and luhn(number),
        plain and not isbn and 7 <= len(digits) <= 15 and (s[0] == "+" or bool(_NATIONAL.fullmatch(s)) or cue in _CALL),
        known or (tight and len(s) >= 6 and ((mixed or len(s) >= 8) and bool(_ASSIGNED.search(before)) or mixed and bool(_SAID.search(before)))),
        plain and bool(re.fullmatch(r"\d{3}-\d{2}-\d{4}", s)),
        bool(_IBAN.fullmatch(s)) and 15 <= len(s.replace(" ", "")) <= 34 and iban_checks(s),
    ]


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        run = text[last:at]
        start = at - (len(run) - len(run.rstrip(_LOCAL)))
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            yield "email", start, found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each pattern kind that pass its check, by start and kind."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x) <= 255 for x in (g.lstrip("0") or "0" for g in m.groups())):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _kind(c: str) -> str:
    return "0" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c if c in "=:\"'+-.()@/#$%," else "^"


def windows(text: str, reach: int = 48) -> Iterator[tuple[int, int]]:
    """Stretches around digits, at signs and credential words, out to the ends of the tokens they would cut; those that meet are one."""
    marks = [m.span() for m in _TRIGGER.finditer(text)]
    low = text.replace("\u0130", "_").lower()  # the one letter whose lower case is longer
    for cue in _CREDENTIAL:
        at = low.find(cue)
        while at >= 0:
            marks.append((at, at + len(cue)))
            at = low.find(cue, at + 1)
    marks.sort()
    near: list[list[int]] = []
    for a, b in marks:
        if near and a - reach <= near[-1][1]:
            near[-1][1] = max(near[-1][1], b + reach)
        else:
            near.append([max(0, a - reach), b + reach])
    start = end = 0
    for a, b in near:
        b = min(b, len(text))
        while a > end and _inside(text, a):  # end: no further back than the last stretch
            a -= 1
        if b < len(text) and _inside(text, b):
            b = _REST.match(text, b).end()
        if a > end:
            if end:
                yield start, end
            start = a
        end = max(end, b)
    if end:
        yield start, end


def _inside(text: str, at: int) -> bool:
    """Whether a place lies inside a token of letters and digits."""
    return text[at - 1].isalnum() and text[at].isalnum()


class Lattice:
    """Tokens of a stretch of text, the candidate segments, and their features."""

    def __init__(self, text: str):
        self.text = text
        self.at = [m.span() for m in _TOKEN.finditer(text)]
        self.segments: list[tuple[int, int]] = []
        self.features: list[list[str]] = []
        self.admitted: list[list[bool]] = []
        tokens = [text[a:b] for a, b in self.at]
        digit = [bool(_DIGIT.search(t)) for t in tokens]
        for i, first in enumerate(tokens):
            if not (first[0].isalnum() or first in "+("):
                continue
            if i and self._glued(tokens[i - 1]):
                continue
            marked = spaced = False
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                t = tokens[j]
                if t[0].isspace():
                    if "\n" in t or len(t) > 2 or not (digit[i] or first in "+("):
                        break
                    spaced = True
                    continue
                if spaced and t[0].isalpha() and not digit[j] and not (_COUNTRY.fullmatch(first) and _BANK.fullmatch(t)):
                    break
                marked |= digit[j] or t == "@"
                if not t[-1].isalnum() or (j + 1 < len(tokens) and self._glued(tokens[j + 1])):
                    continue
                cue = self._cue(self.at[i][0])
                if marked or (j == i and cue in CUES and len(t) > 5):
                    kinds = admitted(text, self.at[i][0], self.at[j][1], cue)
                    if any(kinds):
                        self.segments.append((i, j + 1))
                        self.admitted.append(kinds)
                        self.features.append(self._describe(self.at[i][0], self.at[j][1], j + 1 - i, cue))

    @staticmethod
    def _glued(token: str) -> bool:
        return token in "_@" or token[0].isalnum()

    def _cue(self, a: int) -> str:
        found = [w for w in re.findall(r"[^\W\d_]+", self.text[max(0, a - 24) : a].lower()) if w not in _LINKS]
        return found[-1] if found else ""

    def _describe(self, a: int, b: int, n: int, cue: str) -> list[str]:
        s = self.text[a:b]
        kinds = "".join(map(_kind, s))
        shape = re.sub(r"(.)\1+", r"\1", kinds)[:24]
        digits = _DIGIT.findall(s)
        nd = len(digits)
        sign = self.text[max(0, a - 3) : a].strip(" \"'")[-1:]
        named = cue if cue in CUES else "-"
        mixed = "0" in kinds and "a" in kinds and len(shape) > 5 and not re.search(r"[^a0]", kinds)
        exact = re.sub(r"\d", "0", s) if nd == len(s.replace("-", "")) and nd <= 11 else ""
        before = _kind(self.text[a - 1]) if a else "<"
        after = _kind(self.text[b]) if b < len(self.text) else ">"
        out = ["bias", f"shape={shape}", f"nd={min(nd, 24)}", f"n={n}", f"cue={named}", f"sign={sign}", f"cs={named}{sign}", f"before={before}", f"after={after}", f"long={min(len(s) // 4, 10)}"]
        out += [f"cue={named} shape={shape}"]
        out += ["luhn"] if 12 <= nd <= 19 and luhn("".join(digits)) else []
        out += [f"mixed {min(len(s) // 6, 5)}", f"mixed sign={sign}"] if mixed else []
        out += [f"exact={exact}"] if exact else []
        out += ["email"] if _EMAIL.fullmatch(s) else []
        out += ["iban"] if _IBAN.fullmatch(s) else []
        out += ["known key"] if _KNOWN_KEY.fullmatch(s) else []
        return out


class Field:
    """Weights of features for each kind; scores, sums and best paths over lattices."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))

    def rows(self, lattice: Lattice, grow: bool = False) -> list[list[int]]:
        out = []
        for names in lattice.features:
            if grow:
                for x in names:
                    self.number.setdefault(x, len(self.number))
            out.append([self.number[x] for x in names if x in self.number])
        return out

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[r].sum(axis=0) for r in rows]).reshape(-1, len(KINDS))

    def closed(self, lattice: Lattice) -> np.ndarray:
        """Minus infinity for each segment and kind that the definitions rule out, else 0."""
        return np.where(np.array(lattice.admitted, bool).reshape(-1, len(KINDS)), 0.0, -np.inf)

    def expected(self, lattice: Lattice, score: np.ndarray) -> np.ndarray:
        """Probability of each segment and kind."""
        n = len(lattice.at)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(lattice.segments):
            ends[j].append(k)
        forward, backward = np.zeros(n + 1), np.full(n + 1, -np.inf)
        total = np.logaddexp.reduce(score, axis=1) if len(score) else np.zeros(0)
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[lattice.segments[k][0]] + total[k] for k in ends[j])])
        backward[n] = 0
        for j in range(n, 0, -1):
            backward[j - 1] = np.logaddexp(backward[j - 1], backward[j])
            for k in ends[j]:
                i = lattice.segments[k][0]
                backward[i] = np.logaddexp(backward[i], backward[j] + total[k])
        outer = np.array([forward[i] + backward[j] - forward[n] for i, j in lattice.segments])
        return np.exp(outer[:, None] + score)

    def best(self, lattice: Lattice) -> list[Span]:
        """The best segmentation's entities, with offsets in the lattice's text."""
        if not lattice.segments:
            return []
        score = self.scores(self.rows(lattice)) + self.closed(lattice)
        top, kind = score.max(axis=1), score.argmax(axis=1)
        n = len(lattice.at)
        value, came = [0.0] * (n + 1), [-1] * (n + 1)
        k, order = 0, sorted(range(len(lattice.segments)), key=lambda k: lattice.segments[k][1])
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            while k < len(order) and lattice.segments[order[k]][1] == j:
                own = order[k]
                got = value[lattice.segments[own][0]] + top[own]
                if got > value[j]:
                    value[j], came[j] = got, own
                k += 1
        found, j = [], n
        while j:
            if came[j] < 0:
                j -= 1
            else:
                i = lattice.segments[came[j]][0]
                found.append((KINDS[kind[came[j]]], lattice.at[i][0], lattice.at[j - 1][1]))
                j = i
        return found[::-1]

    def spans(self, text: str) -> list[Span]:
        """Entities around the triggers of a whole text."""
        return [(k, start + a, start + b) for start, end in windows(text) for k, a, b in self.best(Lattice(text[start:end]))]


def examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Sentences of invented words with marked entities and with numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(*"bcdfghklmnprstvz") + pick("a", "e", "i", "o", "u", "ou", "en", "er") for _ in range(rng.integers(1, 4)))

    def card() -> str:
        body = pick("4", "51", "37", "6011") + digits(pick(9, 11, 13))
        body = body[:15]
        whole = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return pick(whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)), "-".join(whole[i : i + 4] for i in range(0, len(whole), 4)))

    def account() -> str:
        country, bank = pick("DE", "FR", "ES", "GB"), pick("", "", "NWBK", "ABCD") + digits(pick(12, 14, 16, 18))
        whole = next(f"{country}{k:02d}{bank}" for k in range(2, 99) if iban_checks(f"{country}{k:02d}{bank}"))
        return pick(whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)))

    mixed = lambda k, letters="abcdef": "".join(pick(*letters, *"0123456789") for _ in range(k)) + pick("7a", "b3", "0c")
    made = {
        "email": lambda: f"{word()}{pick('.', '_', '', '.' + digits(2))}{word()}@{word()}{pick('', digits(1))}.{pick('com', 'org', 'example.com', 'net')}",
        "ip": lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)),
        "card": card,
        "phone": lambda: pick(f"+{rng.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{rng.integers(1, 99)} {digits(3)} {digits(3)} {digits(3)}", f"{digits(3)}.{digits(3)}.{digits(4)}"),
        "secret": lambda: pick(mixed(rng.integers(12, 40)), mixed(rng.integers(14, 40), "abcdefghkmnpqrstXYZQ"), "sk-" + mixed(24), word().capitalize() + digits(4) + pick("", "x"), "AKIA" + "".join(pick(*"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": account,
    }
    lead = {"email": ("mail ", "", ""), "ip": ("host ", "", ""), "card": ("card ", "", ""), "phone": ("tel. ", "call ", "phone: ", "", ""), "ssn": ("ssn ", "social security number ", ""), "iban": ("iban ", "account ", "")}
    none = (
        lambda: str(rng.integers(1500, 2100)), lambda: digits(pick(1, 2, 3, 4, 5, 6, 8)), lambda: f"{rng.integers(1, 13)}:{digits(2)}", lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
        lambda: f"{pick('$', '')}{rng.integers(1, 999)}{pick(',', '.')}{digits(3)}", lambda: f"v{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 9)}", lambda: word() + digits(pick(1, 2, 3)), lambda: f"#{digits(pick(4, 6))}", lambda: f"{digits(2)}%",
        lambda: " ".join(digits(pick(1, 2, 3)) for _ in range(5)), lambda: f"http://{word()}.com/{word()}/{digits(3)}", lambda: f"@{word()}", lambda: f"{rng.integers(1, 5)}. {word()}", lambda: f"{digits(2)} - {digits(2)}", lambda: f"token {word()}", lambda: f"{pick('key', 'secret', 'password', 'the token')} {word()}", lambda: f"id={digits(5)}", lambda: f"{word()}={digits(2)}", lambda: digits(12), lambda: f"{digits(3)}-{digits(3)}", lambda: f"{rng.integers(1, 29)}.{rng.integers(1, 12)}.{rng.integers(1990, 2030)}", lambda: f"{digits(4)} {digits(3)}", lambda: f"https://www.{word()}.{pick('com', 'org')}/{word()}{digits(2)}?{word()}={digits(4)}", lambda: f"{word()}_v{digits(1)}_{word()}{digits(1)}.{pick('tar.gz', 'pdf', 'py')}", lambda: f"{digits(1)},{digits(3)},{digits(3)}.{digits(2)}", lambda: f"ISBN 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"10.{digits(4)}/{word()}.{digits(6)}", lambda: mixed(38), lambda: f"{pick('key', 'token', 'secret')} = {digits(2)}", lambda: f"password {word()}",
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(2, 5)):
            text += "".join(word() + pick(" ", " ", " ", ", ", ". ", " | ", "### ", "&&& ", "!! ") for _ in range(rng.integers(1, 6)))
            if rng.random() < 0.55:
                kind = pick(*KINDS, "secret")
                if kind == "secret":
                    quote = pick("", '"', "'")
                    text += pick("password", "token", "secret", "api_key", "pwd", "key", "passwd", "Password", "passwort", "the token") + pick("=", " = ", ": ", "=", " is ", " ") + quote
                else:
                    quote = ""
                    text += pick(*lead[kind])
                value = made[kind]()
                if value.startswith("AKIA") and not quote and rng.random() < 0.7:  # keys of known forms stand anywhere
                    text = text[: text.rindex(" ") + 1] if " " in text else ""
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + quote + pick(" ", " ", ". ", ", ", "### ", "\n")
            else:
                text += pick(*none)() + pick(" ", ", ", ". ")
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def trained(n: int = 900, epochs: int = 6, seed: int = 11, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """The field, by adaptive gradient ascent on the conditional log likelihood of whole segmentations."""
    field, data = Field(), []
    for text, spans in examples(n, seed):
        lattice = Lattice(text)
        truth = np.zeros((len(lattice.segments), len(KINDS)))
        where = {(lattice.at[i][0], lattice.at[j - 1][1]): k for k, (i, j) in enumerate(lattice.segments)}
        for kind, a, b in spans:
            if (a, b) in where:
                truth[where[a, b], KINDS.index(kind)] = 1
        if lattice.segments:
            data.append((lattice, field.rows(lattice, grow=True), truth))
    field.weights = np.zeros((len(field.number), len(KINDS)))
    seen = np.full(field.weights.shape, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            lattice, rows, truth = data[k]
            gap = truth - field.expected(lattice, field.scores(rows) + field.closed(lattice))
            slope: dict[int, np.ndarray] = {}
            for r, g in zip(rows, gap, strict=True):
                for x in r:
                    slope[x] = slope.get(x, 0) + g
            at = np.fromiter(slope, np.int64, len(slope))
            step = np.array(list(slope.values())) - decay * field.weights[at]
            seen[at] += step * step
            field.weights[at] += rate * step / np.sqrt(seen[at])
    return field


def all_spans(text: str, field: Field) -> list[Span]:
    """Pattern spans, and the field's that touch none of them."""
    base = base_spans(text)
    ordered = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in ordered], list(accumulate((b for _, b in ordered), max))
    out = list(base)
    for kind, a, b in field.spans(text):
        before = bisect_left(starts, b)  # pattern spans that begin before this one's end
        if not before or ends[before - 1] <= a:
            out.append((kind, a, b))
    return sorted(out, key=_order)


def masked(text: str, spans: list[Span]) -> str:
    """The text with <KIND> for each stretch that spans cover (overlapping ones are one, named by the first)."""
    out, last = [], 0
    for kind, a, b in spans:
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def _shipped(df: DataFrame):
    return df.sparkSession.sparkContext.broadcast(trained())


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: counts of pattern kinds, a digest of the pattern spans, all spans as text.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A null text is empty and has none. Repeated
    rows give equal rows; an empty table gives none; other columns are not read.
    """
    sent = _shipped(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for part in byte_slices(batches, "text", 8 << 20):
            rows = []
            for text in part.column("text").to_pylist():
                base = base_spans(text or "")
                spans = all_spans(text or "", field)
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
            a = list(zip(*rows, strict=True))
            yield pa.record_batch([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in a[:4]), pa.array(a[4], pa.string()), pa.array(a[5], pa.string()), pa.array(a[6], pa.int64())], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, COLUMNS)


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind; all columns and rows stay, a null text stays null, an empty one empty.

    Repeated rows stay and are masked alike; an empty table gives none.
    """
    sent = _shipped(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for part in byte_slices(batches, text_col, 8 << 20):
            texts = [None if t is None else masked(t, all_spans(t, field)) for t in part.column(text_col).to_pylist()]
            at = part.schema.get_field_index(text_col)
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
