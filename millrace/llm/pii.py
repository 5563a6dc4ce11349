"""Personal data: base patterns, and further spans that boosted trees choose among overlapping candidates.

Base spans follow fixed patterns and stay whatever the trees say. High-recall generators propose further spans of the same
kinds in looser formats (spelled-out or bracketed addresses, dotted quads in brackets, numbers grouped by dots or tabs,
telephone numbers without a plus sign). In a row of numbers every stretch of whole digit groups is proposed whose count of
digits fits a kind, so that a neighbour hides nothing, however long the row is and however wide its gaps are. Gradient-boosted
trees score each by its format, its neighbours, the row's length and the words around it; a span is added when its probability
reaches its kind's threshold. Of overlapping additions of a kind the likelier stays, and none overlaps a base span. Texts of many
numbers or very wide gaps are scored in windows of digit groups as arrays, with the same features.

The trees are trained here, from examples made by ``examples`` with a fixed seed: spans and look-alikes (order numbers,
versions, dates, book numbers, sums) in matching and misleading contexts. Half of the contexts are made up, half are cut out of the
documents: ``SNIPPETS`` pieces of at most ``MAX_TEXTS`` different texts chosen by hash. The thresholds are calibrated on as many
other examples, in other contexts, for a wanted precision where true spans have ``LOOK_ALIKES`` look-alikes each.

Defined results: a null text counts as empty; offsets are code points, ends exclusive; repeated rows are treated alike; an
empty table gives an empty result; texts are handled one at a time whatever their length; other columns are kept by
``pii_stage`` and not read otherwise.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The wanted precision, and the look-alikes that a true span is taken to have in running text.
PRECISION, LOOK_ALIKES = 0.98, 10
#: Texts that contexts are cut from at most, pieces of each, and their length.
MAX_TEXTS, SNIPPETS, SNIPPET = 2000, 3, 120
ROUNDS, DEPTH, PACE, BINS = 40, 3, 0.25, 16
#: Wrong candidates that an example teaches at most, so that rows of numbers don't outweigh the rest.
NEGATIVES = 12

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Candidates: digits with loose separators, and addresses with the sign or the dot spelled out.
_GAP = re.compile(r"[ .\t()/\[\]-]++")
MOST_DIGITS = 19
#: What the short list of ``candidates`` holds: digit groups of a number at most, digits for each at least, and digit groups of a row at most.
MOST_GROUPS, FULL, ROW = 6, 1.5, 8
#: Characters between two digit groups in the lists of ``candidates`` that aren't whole.
SMALL_GAP = 3
#: Candidates, or digit groups, that are scored at once; with more than ``FEW`` digit groups, or as many characters between two, a text is
#: scored as arrays.
SLICE, FEW = 4096, 64
#: From this length on rows of digit groups count as equally long, and from this value on all features as equally large.
LONG_ROW, LARGE = 64, 255
#: Last parts of addresses; others are open to doubt.
_ENDINGS = frozenset(("com", "org", "net", "edu", "gov", "info", "io", "co", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "eu", "us", "ca", "au", "jp", "cn", "in", "br", "ru", "example", "test"))
_SPELLED = re.compile(r"[ (\[{]dot[)\]} ]", re.I)
_MY = re.compile(r"\bmy\Z", re.I)
_AT = re.compile(r"(?<=[ (\[{])at(?=[)\]} ])", re.I)
_CLOSING = re.compile(r"[)\]} ]++")
_RIGHT = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|[ (\[{]++dot[)\]} ]++)[A-Za-z0-9-]++)+", re.I)
_WORDS = {
    "phone": re.compile(r"\b(?:tel|phone|call|fax|mobile|cell|whatsapp|dial|ring|my number)", re.I),
    "card": re.compile(r"\b(?:card|visa|amex|mastercard|credit|debit|payment|cc)\b", re.I),
    "email": re.compile(r"\b(?:mail|e-mail|email|contact|write|reach|address)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|client|address|addr|ping|node)\b", re.I),
    "other": re.compile(r"\b(?:order|invoice|isbn|version|ref|sku|page|id|art|total|sum|date|serial|build|release|pages|vol)\b|[$€£#]\s?$", re.I),
}
CONTEXT = 32
#: The digits beside a candidate, and what stands between.
_NEAR_LEFT = re.compile(r"([0-9]+)([ .\t()/\[\]-]+)\Z")
_NEAR_RIGHT = re.compile(r"([ .\t()/\[\]-]+)([0-9]+)")
_FOLLOWING = re.compile(r"[ .\t()/\[\]-]++[0-9]++")
_WIDE = re.compile(rf"(?<=[0-9])[ .\t()/\[\]-]{{{FEW},}}+(?=[0-9])")
_BETWEEN, _FIGURES, _MONEY = " .\t()/[]-", frozenset("0123456789"), "$€£#.,-"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = (ord(c) - 48) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base patterns, leftmost and non-overlapping for each kind, by start and then kind."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for chain in _CHAIN.finditer(text):
        parts = list(_PART.finditer(text, chain.start(), chain.end()))
        for k in range(0, len(parts) - 3, 4):
            if all(_small(p[0]) for p in parts[k : k + 4]):
                out.append(("ip", parts[k].start(), parts[k + 3].end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, pruned: bool = False, whole: bool = False) -> list[tuple[str, int, int]]:
    """Overlapping spans in looser formats, with up to ``SMALL_GAP`` characters between digit groups.

    Whole, as ``proposed`` takes them, with any number of them, and quads with any zeros before their parts. Pruned, a short list: digits in
    few groups that are not part of a long row of numbers, and only the formats of ``proposed``, whose list is whole.
    """
    out = []
    groups = [m.span() for m in _PART.finditer(text)]
    joined = [bool(_GAP.fullmatch(text, e, s)) and (whole or s - e <= SMALL_GAP) for (_, e), (s, _) in zip(groups, groups[1:])]
    row = [0] * len(groups)  # where the row of joined groups ends
    for i in range(len(groups) - 1, -1, -1):
        row[i] = row[i + 1] if i < len(joined) and joined[i] else i + 1
    small = [whole and _small(text[s:e]) for s, e in groups]
    begin = 0
    for i, (first, _) in enumerate(groups):
        begin = i if i and not joined[i - 1] else begin
        if pruned and row[i] - begin > ROW:
            continue
        start, digits = first - (first > 0 and text[first - 1] in "(+"), 0
        for j in range(i, min(i + MOST_GROUPS, row[i]) if pruned else row[i]):
            digits += groups[j][1] - groups[j][0]
            if digits > MOST_DIGITS and not (j - i < 4 and all(small[i : j + 1])):
                break
            end, full = groups[j][1], not pruned or digits >= FULL * (j - i + 1)
            if 12 <= digits <= MOST_DIGITS and full:
                out.append(("card", start, end))
            if 7 <= digits <= 15 and full:
                out.append(("phone", start, end))
            if j - i == 3 and (digits <= 12 or all(small[i : j + 1])) and (not pruned or all("." in text[groups[k][1] : groups[k + 1][0]] for k in range(i, j))):
                out.append(("ip", start, end))
    return out + addresses(text, pruned)


def addresses(text: str, strict: bool = True) -> list[tuple[str, int, int]]:
    """Addresses with the sign spelled out; strictly only with a bracketed sign or a spelled dot, too, as "at" alone is a plain word."""
    out = []
    for m in _AT.finditer(text):
        left, end = m.start(), _CLOSING.match(text, m.end()).end()
        while left and text[left - 1] in " ([{":
            left -= 1
        start, right = left, _RIGHT.match(text, end)
        while start and text[start - 1] in _LOCAL:
            start -= 1
        if start < left and right and (not strict or text[left:end].strip(" ") != m[0] or _SPELLED.search(right[0])):
            out.append(("email", start, right.end()))
    return out


def proposed(text: str) -> list[tuple[str, int, int]]:
    """All spans that the trees judge: every stretch of digit groups, those of four numbers with a dot between each two, strict addresses."""
    dotted = lambda s, e: all("." in gap for gap in re.split("[0-9]+", text[s:e])[1:-1])
    return [c for c in candidates(text, whole=True) if c[0] in ("card", "phone") or (c[0] == "ip" and dotted(*c[1:]))] + addresses(text)


def outside(text: str, spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Those of the spans that overlap no base span."""
    covered = _merged(base_spans(text) if base is None else base)
    return [c for c in spans if _free(covered, c[1], c[2]) is not None]


def _merged(base: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover."""
    merged: list[list[int]] = []
    for _, start, end in base:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [m[0] for m in merged], [m[1] for m in merged]


def _row(text: str, start: int, end: int) -> int:
    """Digit groups of the row that the digits at ``start`` to ``end`` stand in, ``LONG_ROW`` at most."""
    n = len(_PART.findall(text, start, end))
    at = start + (text[start] in "(+")
    while n < LONG_ROW:
        last = at
        while last and text[last - 1] in _BETWEEN:
            last -= 1
        if last == at or not last or text[last - 1] not in _FIGURES:
            break
        n, at = n + 1, last - 1
        while at and text[at - 1] in _FIGURES:
            at -= 1
    while n < LONG_ROW and (m := _FOLLOWING.match(text, end)):
        n, end = n + 1, m.end()
    return n


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits, groups = _digits(span), [len(g) for g in _PART.findall(span)] or [0]
    around = before + " " + after
    inner, left, right = {text[m.start()] for m in _GAP.finditer(text, start, end)} - {text[start]}, _NEAR_LEFT.search(before), _NEAR_RIGHT.match(after)
    found = [
        float(KINDS.index(kind)),
        len(digits),
        len(span),
        len(groups),
        groups[0],
        groups[-1],
        max(groups),
        min(groups),
        float(bool(digits) and luhn(digits)),
        float(span[0] == "+"),
        float(span[0] == "("),
        span.count("."),
        span.count("-"),
        span.count(" ") + span.count("\t"),
        span.count("[") + span.count("("),
        span.count("/"),
        float(all(_small(p) for p in _PART.findall(span))),
        int(digits[0]) if digits else -1.0,
        len(set(digits)),
        float("dot" in span.lower()),
        float(re.split(r"[^a-z0-9]+", span.lower())[-1] in _ENDINGS),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in "$€£#.,-" and before[-1:] != ""),
        len(inner),
        groups[1] if len(groups) > 1 else 0,
        len(left[1]) if left else 0,
        len(right[2]) if right else 0,
        float(bool(left) and left[2][-1:] in inner),
        float(bool(right) and right[1][:1] in inner),
        float(bool(left) and " " not in left[2]),
        float(bool(right) and " " not in right[1]),
        float(bool(_WORDS[kind].search(around))),
        *[float(bool(_WORDS[w].search(before))) for w in _WORDS],
        float(_row(text, start, end)) if kind != "email" else 0.0,
        max(map(len, re.split("[0-9]+", span)[1:-1]), default=0) if kind != "email" else 0.0,
    ]
    return [min(x, LARGE) for x in found]


def examples(n: int, seed: int, contexts: Sequence[str] = ()) -> Iterator[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): spans of each kind in looser formats, and look-alikes; half in the given contexts.

    They come from n texts, and from a quarter as many with wider gaps.
    """
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    long = lambda: word() + "".join(rng.choice("bcdfgklmprst") for _ in range(4))
    prose = lambda k: " ".join(word() for _ in range(k))
    hints = {
        "phone": ["Tel", "phone", "call me on", "fax", "mobile", "dial", "cell", "my number is"],
        "card": ["card", "visa", "credit card", "paid by card", "mastercard", "debit", "cc"],
        "email": ["mail", "contact", "write to", "email", "reach me"],
        "ip": ["ip", "host", "server", "client", "from address"],
        "other": ["order", "invoice", "isbn", "version", "ref", "sku", "page", "id", "total", "serial", "build", "vol"],
    }

    def card(valid: bool) -> str:
        first = rng.choice("3456") + digits(14)
        last = next(c for c in "0123456789" if luhn(first + c))
        number = first + (last if valid else str((int(last) + rng.randint(1, 9)) % 10))
        sep = rng.choice([".", "\t", " - ", "/", ""])
        return sep.join(number[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits(2)} {a} {b}{c}", f"0{digits(3)} {digits(6)}", f"0{digits(2)}/{digits(7)}"])

    def address() -> str:
        a, d = rng.choice([("(at)", "(dot)"), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."), ("[at]", ".")])
        return f"{rng.choice([word() + '.' + digits(2), word() + '.' + word(), word()])}{a}{word()}{d}{rng.choice(['com', 'org', 'net', 'de', 'co', 'example'])}"

    def quad() -> str:
        dot = rng.choice(["[.]", "(.)", " . ", "[.]"])
        return dot.join(str(rng.randint(1, 254)) for _ in range(4))

    def wider(span: str) -> str:
        """The span with wider gaps between its digit groups, or around its spelled-out signs."""
        pad = rng.choice([" " * rng.randint(2, 8), "\t" * rng.randint(2, 4)])
        wide = lambda m: m[0].replace(" ", pad) if " " in m[0] else pad + m[0] + pad
        span = re.sub(r"(?<=[0-9])[ .\t()/\[\]-]+(?=[0-9])", wide, span)
        return re.sub(r"[ (\[]+(at|dot)[)\] ]+", lambda m: f" {m[0].strip()[0]} {m[1]} {m[0].strip()[-1]} " if m[0].strip() != m[1] else f"  {m[1]}  ", span)

    right = {"phone": phone, "card": lambda: card(rng.random() < 0.9), "email": address, "ip": quad}
    wrong = {
        "phone": [lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: digits(rng.randint(7, 15)), lambda: f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(2)}", lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"{digits(2)}.{digits(2)}.20{digits(2)}", lambda: " ".join(digits(2) for _ in range(rng.randint(4, 6))), lambda: f"{digits(2)} {digits(3)} {digits(4)}"],
        "card": [lambda: digits(16), lambda: digits(rng.randint(12, 19)), lambda: card(False), lambda: f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}", lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}"],
        "email": [lambda: f"{word()} at {word()} dot {long()}", lambda: f"{word()}.{digits(2)} at {word()} dot {long()}", lambda: f"{word()} (at) {word()}.{long()}", lambda: f"{word()} [at] {word()}.{long().title()}", lambda: f"{word()} (at) {digits(2)}.{digits(2)}"],
        "ip": [lambda: f"{digits(1)}.{digits(1)}.{digits(2)}.{digits(2)} {digits(1)}", lambda: " . ".join(digits(3) for _ in range(4)), lambda: ". ".join(digits(rng.randint(1, 3)) for _ in range(4)), lambda: f"{digits(2)}.{digits(2)}.20{digits(2)}. {digits(2)}"],
    }

    def beside(kind: str, good: bool) -> tuple[str, bool]:
        """A number beside a span, and whether it is one of the span's kind."""
        if good and rng.random() < 0.5:
            return right[kind](), True
        return rng.choice([digits(rng.randint(1, 4)), f"{digits(2)}/{digits(2)}", f"{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", quad().replace(" ", "").translate(plain)]), False

    plain = str.maketrans("", "", "[]()")
    for wide in [False] * n + [True] * (n // 4):
        kind, good = rng.choice(KINDS), rng.random() < 0.5
        if good:
            hint = rng.choice(hints[kind]) + rng.choice([": ", " "]) if rng.random() < 0.85 or kind in ("card", "phone") else ""
            span = right[kind]()
        else:
            hint = rng.choice(hints["other"]) + rng.choice([": ", " ", " no "]) if rng.random() < 0.4 else ""
            if not hint and rng.random() < 0.5:  # hint words occur beside look-alikes, too
                hint = rng.choice(hints[kind]) + " "
            span = rng.choice(wrong[kind])()
        span = wider(span) if wide else span
        before, after = f"{prose(rng.randint(0, 4))} ", f"{rng.choice(['', '.', ',', ' '])} {prose(rng.randint(1, 5))}"
        if contexts and rng.random() < 0.5:
            piece = rng.choice(contexts)
            cut = rng.choice([0, *(m.end() for m in re.finditer(r"\s", piece))])
            before, after = piece[:cut], f"{rng.choice(['', '.', ','])} {piece[cut:]}"
        head = before + hint
        true = {(kind, len(head), len(head) + len(span))} if good else set()
        body = head + span
        if kind != "email" and rng.random() < 0.4:
            other, label = beside(kind, good)
            if rng.random() < 0.5:
                body += " " * rng.randint(2, 12) if wide else rng.choice([" ", " ", "\t"])
                true |= {(kind, len(body), len(body) + len(other))} if label else set()
                body += other
            else:
                other += " " * rng.randint(2, 12) if wide else " "
                true = {(k, s + len(other), e + len(other)) for k, s, e in true} | ({(kind, len(head), len(head) + len(other.rstrip()))} if label else set())
                body = head + other + span
        if kind in ("phone", "card") and rng.random() < 0.15:  # long rows, of true spans or of plain numbers
            if good:
                for _ in range(rng.randint(2, 5)):
                    body += " " * rng.randint(2, 12) if wide else rng.choice([" ", "\t"])
                    span = right[kind]()
                    true.add((kind, len(body), len(body) + len(span)))
                    body += span
            else:
                body, width, gap = head, rng.randint(0, 5), rng.choice([" ", " ", " ", "\t", ".", "-", "/"])
                gap = rng.choice([" " * rng.randint(2, 12), " " + "." * rng.randint(2, 20) + " ", "\t" * rng.randint(2, 4)]) if wide else gap
                body += gap.join(digits(width or rng.randint(1, 5)) for _ in range(rng.randint(4, 24)))
        text = body + after
        wrong_ones = 0
        for k, s, e in sorted(outside(text, proposed(text)), key=lambda c: (c not in true, rng.random())):
            if s < len(body) and e > len(head) and (k == kind or kind != "email"):
                wrong_ones += (k, s, e) not in true
                if wrong_ones <= NEGATIVES:
                    yield text, k, s, e, int((k, s, e) in true)


@dataclass
class Trees:
    """Boosted trees of one depth over binned features, and the threshold of each kind."""

    edges: list[np.ndarray]
    split: np.ndarray  # rounds x inner nodes: the feature
    at: np.ndarray  # rounds x inner nodes: the last bin that goes left
    leaf: np.ndarray  # rounds x leaves
    start: float
    threshold: dict[str, float]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        b, rows, total = self.bins(x), np.arange(len(x)), np.full(len(x), self.start)
        for split, at, leaf in zip(self.split, self.at, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, split[node]] > at[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


    def table(self, most: int = LARGE) -> np.ndarray:
        """The bins of the whole numbers from -1 to ``most``, a row for each feature."""
        return np.stack([np.searchsorted(e, np.arange(-1, most + 1), "left") for e in self.edges]).astype(np.uint8)

    def probability_of_bins(self, b: list[np.ndarray]) -> np.ndarray:
        """The probabilities for binned features, given as one array each."""
        total = np.full(len(b[0]), self.start)
        for split, at, leaf in zip(self.split, self.at, self.leaf, strict=True):
            right = [b[f] > a for f, a in zip(split, at, strict=True)]
            node = np.zeros(len(total), np.uint8)
            for level in range(DEPTH):
                first = 2**level - 1
                # Bit by bit: among a level's nodes the one that was reached.
                now = right[first]
                for k in range(1, 2**level):
                    now = np.where(node == k, right[first + k], now)
                node = 2 * node + now
            total += leaf[node]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the log loss with histogram splits."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    mean = y.mean()
    model = Trees(edges, np.zeros((0, 2**DEPTH - 1), int), np.zeros((0, 2**DEPTH - 1), int), np.zeros((0, 2**DEPTH)), float(np.log(mean / (1 - mean))), {})
    b, total, width = model.bins(x), np.full(len(x), model.start), x.shape[1]
    splits, ats, leaves = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        split, at, node = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS), np.zeros(len(x), int)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            slot = (((node - first)[:, None] * width + np.arange(width)) * BINS + b).ravel()
            sums = [np.bincount(slot, weights=np.repeat(v, width), minlength=count * width * BINS).reshape(count, width, BINS).cumsum(axis=2) for v in (g, h)]
            (lg, lh), (tg, th) = sums, (sums[0][:, :, -1:], sums[1][:, :, -1:])
            gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
            best = gain.reshape(count, -1).argmax(axis=1)
            split[first : first + count], at[first : first + count] = best // BINS, best % BINS
            node = 2 * node + 1 + (b[np.arange(len(x)), split[node]] > at[node])
        own = node - (2**DEPTH - 1)
        leaf = PACE * np.bincount(own, weights=g, minlength=2**DEPTH) / (np.bincount(own, weights=h, minlength=2**DEPTH) + 1)
        total += leaf[own]
        splits.append(split)
        ats.append(at)
        leaves.append(leaf)
    model.split, model.at, model.leaf = np.array(splits), np.array(ats), np.array(leaves)
    return model


@lru_cache(maxsize=4)
def trained(contexts: tuple[str, ...] = (), n: int = 4000, seed: int = 11, precision: float = PRECISION) -> Trees:
    """The trees, fitted on n examples in one half of the contexts; thresholds give ``precision`` on n others in the other half."""
    made = list(examples(n, seed, contexts[::2]))
    model = boost(np.array([features(*e[:4]) for e in made], float), np.array([e[4] for e in made], float))
    held = list(examples(n, seed + 1, contexts[1::2]))
    p, y, kind = model.probability(np.array([features(*e[:4]) for e in held], float)), np.array([e[4] for e in held]), np.array([e[1] for e in held])
    for k in KINDS:
        order = np.argsort(-p[kind == k], kind="stable")
        true = y[kind == k][order]
        # Look-alikes weigh as much as if there were LOOK_ALIKES for each true span.
        weight = LOOK_ALIKES * max(true.sum(), 1) / max((1 - true).sum(), 1)
        hits = np.cumsum(true) / np.maximum(np.cumsum(true) + weight * np.cumsum(1 - true), 1)
        ordered = p[kind == k][order]
        whole = np.append(ordered[1:] < ordered[:-1], True)  # equal probabilities are taken together
        good = np.flatnonzero((hits >= precision) & whole)
        model.threshold[k] = float(ordered[good[-1]]) if len(good) else 2.0
    return model


def contexts_of(docs: DataFrame, text_col: str = "text", max_texts: int = MAX_TEXTS) -> tuple[str, ...]:
    """Pieces of running text from at most about ``max_texts`` different texts, chosen by a hash."""
    texts = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    rows = docs.count()
    if not rows:
        return ()
    placed = texts.select(F.pmod(F.xxhash64(F.lit(53), "text"), F.lit(1 << 40)).alias("place"), "text")
    once = placed.filter(F.col("place") < min(1.0, max_texts / rows) * (1 << 40)).groupBy("place").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rng = random.Random(place)
                for k in range(SNIPPETS):
                    at = rng.randrange(max(1, len(text) - SNIPPET))
                    out.append((place, k, text[at : at + SNIPPET]))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["place", "k", "piece"])

    return tuple(r["piece"] for r in sorted(once.mapInArrow(cut, "place long, k int, piece string").collect()))


def train(docs: DataFrame, text_col: str = "text") -> Trees:
    return trained(contexts_of(docs, text_col))


def all_spans(text: str, model: Trees) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and these with the trees' additions."""
    base = base_spans(text)
    few = sum(1 for _ in islice(_PART.finditer(text), FEW + 1)) <= FEW and not _WIDE.search(text)
    found, good = outside(text, proposed(text) if few else addresses(text), base), []
    for first in range(0, len(found), SLICE):
        some = found[first : first + SLICE]
        p = model.probability(np.array([features(text, *c) for c in some], float))
        good += [(-p[k], start, end, kind) for k, (kind, start, end) in enumerate(some) if p[k] >= model.threshold[kind]]
    if not few:
        good += _likely_stretches(text, model, _merged(base))
    if not good:
        return base, base
    out, taken = list(base), {k: ([], []) for k in KINDS}
    for _, start, end, kind in sorted(good):
        if (at := _free(taken[kind], start, end)) is not None:
            taken[kind][0].insert(at, start)
            taken[kind][1].insert(at, end)
            out.append((kind, start, end))
    return base, sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _windows(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(starts, ends, first, last): digit groups in windows; those from first to last are the window's own, the others its margins."""
    groups, kept, first = _PART.finditer(text), [], 0
    while True:
        kept += [m.span() for m in islice(groups, first + SLICE + LONG_ROW - len(kept))]
        last = min(first + SLICE, len(kept))
        if first >= last:
            return
        both = np.array(kept, np.int64)
        yield both[:, 0], both[:, 1], first, last
        drop = max(last - LONG_ROW, 0)
        kept, first = kept[drop:], last - drop


def stretches(text: str) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(kind, starts, ends, features as one array each) of every stretch of digit groups in ``proposed``, window by window."""
    for starts, ends, first, last in _windows(text):
        base = max(int(starts[0]) - CONTEXT - 1, 0)
        piece = text[base : int(ends[-1]) + CONTEXT]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.concatenate([codes, np.zeros(4, np.uint32)])
        s, e, n = starts - base, ends - base, len(starts)
        length = e - s
        is_ = lambda chars, at: np.isin(c[at], [ord(x) for x in chars])
        # What stands between a group and the next.
        places = {x: np.flatnonzero(np.isin(codes, [ord(y) for y in x])) for x in (".", "-", " \t", "[(", "/", " ", _BETWEEN)}
        within = lambda chars, lo, hi: np.searchsorted(places[chars], hi) - np.searchsorted(places[chars], lo)
        beyond = np.append(s[1:], len(codes))
        gap = beyond - e
        joined = (within(_BETWEEN, e, beyond) == gap) & (np.arange(n) < n - 1)
        counts = [np.concatenate([[0], np.cumsum(within(x, e, beyond) * joined)]) for x in (".", "-", " \t", "[(", "/")]
        dotted, spaced = [within(x, e, beyond) > 0 for x in ". "]
        bit = {ord(x): 1 << k for k, x in enumerate(_BETWEEN)}
        bits = lambda x: np.select([x == y for y in bit], list(bit.values()), 0)
        gap_bit = bits(c[e])
        # Rows.
        index = np.arange(n)
        row_first = np.maximum.accumulate(np.where(np.concatenate([[True], ~joined[:-1]]), index, 0))
        ending = np.where(joined, n, index)
        row_last = np.minimum.accumulate(ending[::-1])[::-1]
        row = np.minimum(np.minimum(row_last, n - 1) - row_first + 1, LONG_ROW)
        # Digits.
        figures = c[: len(codes)][(codes >= 48) & (codes <= 57) & (np.arange(len(codes)) >= s[0]) & (np.arange(len(codes)) < e[-1])].astype(np.int64) - 48
        d = np.concatenate([[0], np.cumsum(length)])
        held = np.bitwise_or.reduceat(1 << figures, d[:-1])
        double, place = np.array([0, 2, 4, 6, 8, 1, 3, 5, 7, 9])[figures], np.arange(len(figures)) % 2
        sums = [np.concatenate([[0], np.cumsum(np.where(place == k, figures, double))]) for k in (0, 1)]
        nonzero = np.concatenate([[0], np.cumsum(figures > 0)])
        tail = figures[d[1:] - 1] + 10 * figures[np.maximum(d[1:] - 2, 0)] * (length > 1) + 100 * figures[np.maximum(d[1:] - 3, 0)] * (length > 2)
        small = (tail <= 255) & ((length <= 3) | (nonzero[np.maximum(d[1:] - 3, 0)] == nonzero[d[:-1]]))
        # Before a stretch that starts with a group, and after one that ends with it.
        prior = np.where(s > 0, c[s - 1], 0)
        plus, bracket = prior == ord("+"), prior == ord("(")
        at = s - (plus | bracket)
        past = np.concatenate([[0], e[:-1]])
        far = at - past
        left = (index > 0) & (far > 0) & (far < CONTEXT) & (within(_BETWEEN, past, at) == far)
        left_n = np.where(left, np.minimum(np.concatenate([[0], length[:-1]]), CONTEXT - far), 0)
        left_bit, left_tight = np.where(left, bits(c[np.maximum(at - 1, 0)]), 0), left & (within(" ", past, at) == 0)
        right = joined & (gap < CONTEXT)
        right_n = np.where(right, np.minimum(np.append(length[1:], 0), CONTEXT - gap), 0)
        right_bit, right_tight = np.where(right, gap_bit, 0), right & ~spaced
        ahead = np.where(at > 0, c[np.maximum(at - 1, 0)], 0)
        letter = {x: chr(x).isalnum() for x in set(ahead.tolist()) | set(c[e].tolist())}
        ahead_letter, next_letter = [np.array([letter[x] for x in y.tolist()]) for y in (ahead, c[e])]
        money = np.isin(ahead, [ord(x) for x in _MONEY])
        # Words within reach; where only figures and what separates them stand there are none.
        odd = np.concatenate([[0], np.cumsum(~np.isin(c, [ord(x) for x in "0123456789,\n" + _BETWEEN]))])
        words_before, words_after = np.zeros((n, len(_WORDS)), bool), np.zeros((n, len(_WORDS)), bool)
        mine = np.zeros(n, bool)
        my, number = mine.copy(), mine.copy()
        for i in np.flatnonzero(odd[at] > odd[np.maximum(at - CONTEXT, 0)]):
            before = piece[max(0, at[i] - CONTEXT) : at[i]]
            words_before[i], my[i] = [bool(w.search(before)) for w in _WORDS.values()], bool(_MY.search(before))
        for j in np.flatnonzero(odd[np.minimum(e + CONTEXT, len(codes))] > odd[e]):
            after = piece[e[j] : e[j] + CONTEXT]
            words_after[j], number[j] = [bool(w.search(" " + after)) for w in _WORDS.values()], after[:6].lower() == "number"
        names = list(_WORDS)
        most, least, digits_held, gaps_held, all_small, all_dotted = length.copy(), length.copy(), held.copy(), np.zeros(n, np.int64), small.copy(), np.ones(n, bool)
        widest = np.zeros(n, np.int64)
        i = np.arange(first, last)
        for k in range(MOST_DIGITS):
            if k:
                i = i[(i + k < n) & joined[np.minimum(i + k - 1, n - 1)]]
                j = i + k
                most[i], least[i] = np.maximum(most[i], length[j]), np.minimum(least[i], length[j])
                digits_held[i] |= held[j]
                gaps_held[i] |= gap_bit[j - 1]
                all_small[i] &= small[j]
                all_dotted[i] &= dotted[j - 1]
                widest[i] = np.maximum(widest[i], gap[j - 1])
            i = i[(d[i + k + 1] - d[i] <= MOST_DIGITS) | (all_small[i] & (k < 4))]
            if not len(i):
                break
            total = d[i + k + 1] - d[i]
            for kind, fits in (("card", (total >= 12) & (total <= MOST_DIGITS)), ("phone", (total >= 7) & (total <= 15)), ("ip", ((total <= 12) | all_small[i]) & all_dotted[i] & (k == 3))):
                a = i[fits]
                if not len(a):
                    continue
                j, m = a + k, total[fits]
                inner = gaps_held[a] & ~np.where(bracket[a], bit[ord("(")], 0)
                end_odd = (d[j + 1] - 1) % 2 == 1
                luhns = np.where(end_odd, sums[1][d[j + 1]] - sums[1][d[a]], sums[0][d[j + 1]] - sums[0][d[a]])
                between = [x[j] - x[a] for x in counts]
                word = names.index(kind)
                around = words_before[a, word] | words_after[j, word] | (my[a] & number[j] & (kind == "phone"))
                same = np.full(len(a), KINDS.index(kind))
                none = np.zeros(len(a), np.int64)
                values = [
                    same, m, e[j] - at[a], none + k + 1, length[a], length[j], most[a], least[a], luhns % 10 == 0, plus[a], bracket[a],
                    between[0], between[1], between[2], between[3] + bracket[a], between[4], all_small[a], figures[d[a]], np.bitwise_count(digits_held[a]), none, none,
                    ahead_letter[a], next_letter[j], money[a], np.bitwise_count(inner), length[np.minimum(a + 1, n - 1)] * (k > 0), left_n[a], right_n[j],
                    (left_bit[a] & inner) > 0, (right_bit[j] & inner) > 0, left_tight[a], right_tight[j], around, *words_before[a].T, row[a], widest[a],
                ]
                yield kind, at[a] + base, e[j] + base, [np.minimum(x, LARGE) for x in values]


def _likely_stretches(text: str, model: Trees, covered: tuple[list[int], list[int]]) -> list[tuple[float, int, int, str]]:
    """(-probability, start, end, kind) of the stretches beside what is covered that reach their kind's threshold."""
    table, good = model.table(), []
    starts, ends = np.array(covered[0], np.int64), np.array([-1, *covered[1]], np.int64)
    for kind, s, e, x in stretches(text):
        free = ends[np.searchsorted(starts, e, "left")] <= s
        p = model.probability_of_bins([table[f][v[free].astype(np.int64) + 1] for f, v in enumerate(x)])
        likely = np.flatnonzero(p >= model.threshold[kind])
        good += zip((-p[likely]).tolist(), s[free][likely].tolist(), e[free][likely].tolist(), repeat(kind))
    return good


def _free(taken: tuple[list[int], list[int]], start: int, end: int) -> int | None:
    """The place of a span among sorted ones that don't overlap; None if it overlaps one of them."""
    starts, ends = taken
    at = bisect.bisect_left(starts, end)
    return at if at == 0 or ends[at - 1] <= start else None


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, model: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``base`` and ``spans`` (arrays of kind, start, end) and the ``redacted`` text of every row of ``docs``."""
    model = model or train(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(1).to_pylist()
                both = [all_spans(t or "", model) for t in texts]
                rows = [[[{"kind": s[0], "start": s[1], "end": s[2]} for s in b[i]] for b in both] for i in (0, 1)]
                clean = [t and redact(t, b[1]) for t, b in zip(texts, both, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows[0], span), pa.array(rows[1], span), pa.array(clean, pa.string())], [id_col, "base", "spans", "redacted"])

    spans = "array<struct<kind string, start long, end long>>"
    return docs.select(id_col, text_col).mapInArrow(find, f"`{id_col}` {kind}, base {spans}, spans {spans}, redacted string")


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind))
    counts = [of(kind).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with personal data redacted in the texts, and ``n_chars`` to match."""
    model = train(docs)
    names = docs.columns
    at = names.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and redact(t, all_spans(t, model)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    done = docs.mapInArrow(clean, docs.schema)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else done
