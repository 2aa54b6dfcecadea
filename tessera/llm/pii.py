"""Personal data: plain patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole candidate spans by features of the span as a unit (its shape, digit groups, check sums, marks,
what stands beside it, words before it) and picks boundaries and types of a whole text together by dynamic
programming over segments. It is trained here, by exact gradients, on sentences built from templates.

Entities are bounded by what they are: numbers hold up to ``DIGITS`` digits in groups that a few marks join, addresses
of machines eight groups, account numbers ``ACCOUNT`` letters and digits with a right check sum, mail addresses 64
characters before the at sign and 255 behind it. Candidates are all spans of these forms, of any text; a token outside
entities adds nothing, so only candidates enter the decoding, which is exact over the whole text. A candidate that
scores less than its tokens would outside of entities, whatever stands beside it, is in no best segmentation and is
left out before.

Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows are searched each for
itself, and other columns are kept. Base spans always stay; what the field finds there of the same type isn't listed
again. Spans of different kinds may overlap.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructField, StructType

from .arrow import map_columns
from .secrets import SPAN, span_rows

BASE = ("email", "ip", "card", "phone")
TYPES = ("email", "ip", "card", "phone", "iban", "national_id")
#: Kinds in the order in which they are listed; what the field adds is named apart from the base kinds.
KINDS = (*BASE, "email_span", "ip_span", "card_span", "phone_span", "iban", "national_id")
ADDED = dict(zip(TYPES, KINDS[len(BASE) :], strict=True))

IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


#: A doubled digit's digits summed.
DOUBLED = {str(d): 2 * d - 9 * (d > 4) for d in range(10)}


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(map(DOUBLED.__getitem__, digits[-2::-2]))) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part is all that stands before the at sign, back to the last match's end."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    return found + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]


# The field.

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\d|[^\w\s]|_|\n")
TRIGGER = re.compile(r"[0-9@]")
#: Digits of a number, letters and digits of an account, and characters of a mail address on either side, at most.
DIGITS, ACCOUNT, LOCAL_MOST, DOMAIN_MOST = 19, 34, 64, 255
OUTSIDE = len(TYPES)
#: Which types a candidate of each form may be.
FORMS = {"number": ("ip", "card", "phone", "national_id"), "groups": ("ip",), "account": ("iban",), "address": ("email",)}

CUES = {
    "tel": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "card": "card", "visa": "card", "credit": "card", "mail": "email", "email": "email",
    "contact": "email", "ip": "ip", "host": "ip", "server": "ip", "iban": "iban", "account": "iban", "ssn": "id", "social": "id", "security": "id", "order": "number", "total": "number", "price": "number",
    "version": "number", "date": "number", "page": "number", "ref": "number",
}

LETTER = re.compile(r"[^\W\d_]")
GROUP = re.compile(r"[0-9]+")
#: What may join the groups of a number.
JOINS = frozenset(" .()/+-")
HEX_GROUPS = re.compile(r"(?<![^\W_])(?<!:)(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![^\W_])")
ACCOUNT_START = re.compile(r"(?<![^\W_])[A-Za-z]{2}[0-9]{2}(?=[ -]?[A-Za-z0-9])")
ACCOUNT_GROUP = re.compile(r"[ -]?([A-Za-z0-9]+)")
LABELS = re.compile(r"[^\W_](?:[\w-]*[^\W_])?")
NINES = str.maketrans("0123456789", "9" * 10)


def shape(s: str) -> str:
    """Digits by their count, letters by case, other characters as they are; long repeats are shortened."""
    out = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 7)}", s)
    out = re.sub(r"[^\W\d_a-z]+", "A", re.sub(r"[a-zà-ÿ]+", "a", out))
    return re.sub(r"\s", "_", out)


def iban_ok(s: str) -> bool:
    c = re.sub(r"[ -]", "", s).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", c, re.A):
        return False
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


Candidate = tuple[int, int, str]


def number_candidates(text: str) -> Iterator[Candidate]:
    """By end: groups of digits that up to three marks join, of seven digits or more, or four groups joined by dots."""
    before: deque[tuple[int, int]] = deque()
    for m in GROUP.finditer(text):
        a, b = m.span()
        if before and not (0 < a - before[-1][1] <= 3 and JOINS.issuperset(text[before[-1][1] : a])):
            before.clear()
        before.append((a, b))
        digits = 0
        for k in range(len(before) - 1, -1, -1):
            start, end = before[k]
            digits += end - start
            if digits > DIGITS:
                # Nothing that ends later reaches this group either.
                for _ in range(k + 1):
                    before.popleft()
                break
            if digits >= 7 or len(before) - k == 4 and text.count(".", start, b) == 3 and b - start == digits + 3:
                yield start, b, "number"
                if start and text[start - 1] in "(+":
                    yield start - 1, b, "number"
                    if start > 1 and text[start - 2 : start] == "+(":
                        yield start - 2, b, "number"


def other_candidates(text: str) -> Iterator[Candidate]:
    if ":" in text:
        for m in HEX_GROUPS.finditer(text):
            if any("0" <= c <= "9" for c in m[0]):
                yield m.start(), m.end(), "groups"
    for m in ACCOUNT_START.finditer(text):
        end, n = m.end(), 4
        while g := ACCOUNT_GROUP.match(text, end):
            n, end = n + len(g[1]), g.end()
            if n > ACCOUNT:
                break
            if n >= 15 and not text[end : end + 1].isalnum() and iban_ok(text[m.start() : end]):
                yield m.start(), end, "account"
    at = text.find("@")
    while at >= 0:
        yield from address_candidates(text, at)
        at = text.find("@", at + 1)


def address_candidates(text: str, at: int) -> Iterator[Candidate]:
    """Spans around an at sign, which a space may set apart on either side; they begin and end with words."""
    end = at - 1 if at and text[at - 1] == " " else at
    first = end
    while first and end - first < LOCAL_MOST and (text[first - 1].isalnum() or text[first - 1] in "._%+-'"):
        first -= 1
    starts = [i for i in range(first, end) if text[i].isalnum() and not (i and text[i - 1].isalnum())]
    label = LABELS.match(text, at + 2 if text[at + 1 : at + 2] == " " else at + 1)
    ends: list[int] = []
    while starts and label and label.end() - at <= DOMAIN_MOST:
        if ends or text[label.start() - 1] == ".":
            ends.append(label.end())
        label = LABELS.match(text, label.end() + 1) if text[label.end() : label.end() + 1] == "." else None
    yield from ((i, j, "address") for i in starts for j in ends if text[j - 1].isalpha())


def side(near: str, far: str) -> str:
    """What stands beside a span: a mark is told apart by whether a word goes on behind it."""
    if not near or near.isspace():
        return "_"
    return "#" if near.isalnum() else f"{near}{'#' if far.isalnum() else ''}"


def cues_before(text: str, a: int) -> set[str]:
    """The cues among the three tokens before a place."""
    first = max(0, a - 64)
    if not LETTER.search(text, first, a):
        return set()
    last = TOKEN.findall(text, first, a)[-3:]
    if len(last) == 3 and text[first:a].startswith(last[0]) and first and text[first - 1].isalnum():
        last = last[1:]  # the end of a longer word
    return {cue for t in last if (cue := CUES.get(t.lower()))}


NOT_NINE = re.compile(r"[^9]+")
DIAL = re.compile(r"(\+9{1,3}[ .-]?)?\(?9{2,4}\)?[ .-]9{3,4}[ .-]9{3,4}")


def number_features(nines: str) -> list[str]:
    """Features of a number whose digits are all read as nines."""
    lengths, between = [len(x) for x in NOT_NINE.split(nines)], NOT_NINE.findall(nines)
    kind = "".join(f"9{min(n, 7)}{mark}" if n else mark for n, mark in zip(lengths, [*between, ""], strict=True)).replace(" ", "_")
    digits, marks = nines.count("9"), "".join(sorted(set(nines) - {"9", " "}))
    out = ["form=number", f"shape={kind}" if len(kind) < 24 else "shape=long", f"marks=number{marks}", f"first=number{kind[:2]}", f"last=number{kind[-2:]}", f"digits={digits}", f"groups={len(lengths) - (lengths[0] == 0)}"]
    if nines == "999-99-9999":
        out.append("id_shape")
    if DIAL.fullmatch(nines):
        out.append("dial")
    return out


def number_tests(s: str, nines: str, sums: bool | None = None) -> tuple[str, ...]:
    """Check sums (given, if known) and ranges, where a number's shape lets them apply; which do, the shape tells."""
    out = ()
    if 13 <= nines.count("9") <= 19 and "(" not in nines and "/" not in nines and "+" not in nines:
        out = (f"luhn={luhn(digits_of(s)) if sums is None else sums}",)
    if nines.count(".") == 3 and len(nines) == nines.count("9") + 3 and ".." not in nines:
        out += (f"quad={all(int(g[-4:]) < 256 for g in s.split('.'))}",)
    return out


def own_features(s: str, form: str) -> list[str]:
    """Features of a span by itself."""
    if form == "number":
        nines = s.translate(NINES)
        return [*number_features(nines), *number_tests(s, nines)]
    kind = shape(s)
    marks = "".join(sorted({c for c in s if not c.isalnum() and not c.isspace()}))
    out = [f"form={form}", f"shape={kind}" if len(kind) < 24 else "shape=long", f"marks={form}{marks}", f"first={form}{kind[:2]}", f"last={form}{kind[-2:]}"]
    if form == "groups":
        parts = s.split(":")
        short = "::" in s
        out.append(f"colons={s.count('::') <= 1 and not s.endswith('::') * (len(parts) < 4) and (len(parts) == 8 or short and 3 <= len(parts) <= 8)}")
        out.append(f"groups={form}{len(parts)}")
    elif form == "address":
        out += [f"apart={' ' in s}", f"address={bool(re.fullmatch(r'[^\s@]+ ?@ ?[^\s@]+[.][^\W0-9_]{2,}', s))}"]
    return out


def left_features(text: str, a: int) -> tuple[str]:
    return ("left=" + side(text[a - 1 : a] if a else "", text[a - 2 : a - 1] if a > 1 else ""),)


def right_feature(text: str, b: int) -> str:
    return "right=" + side(text[b : b + 1], text[b + 1 : b + 2])


def context_features(text: str, a: int, b: int) -> list[str]:
    return [*left_features(text, a), right_feature(text, b), *sorted(f"cue={c}" for c in cues_before(text, a))]


#: Shapes of numbers whose scores are remembered; beyond, the memory starts anew.
REMEMBERED = 100_000


class Field:
    """Weights of (feature, type) and of (type, type) steps. An outside token is a segment of its own that scores 0, and so does a step from one to the next."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.w = np.zeros((0, OUTSIDE))
        self.step = np.zeros((OUTSIDE + 1, OUTSIDE + 1))
        self.able = {form: np.array([0.0 if t in types else -np.inf for t in TYPES]) for form, types in FORMS.items()}
        #: Scores of features that stand beside a span, and of shapes of numbers, as they are met.
        self.known: dict[tuple[str, ...], list[float]] = {}
        self.shapes: dict[str, list[tuple[int, float, float]]] = {}
        self.bounds: tuple[list[float], list[float]] | None = None
        self.rows: dict[str, list[float]] = {}
        self.number_types = [TYPES.index(t) for t in FORMS["number"]]

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "shapes": {}}

    def ids(self, features: list[str], grow: bool = False) -> list[int]:
        if grow:
            for f in features:
                self.names.setdefault(f, len(self.names))
        return [self.names[f] for f in features if f in self.names]

    def least(self) -> np.ndarray:
        """By type, the score below which a span is in no best segmentation: tokens outside do better beside whatever stands there."""
        o = OUTSIDE
        before = self.step[:, [o]] - self.step[:, :o]
        after = np.concatenate([self.step[o, :][None] - self.step[:o, :], np.zeros((1, o)).T], 1)
        return before.min(0) + after.min(1)

    def prepared(self) -> tuple[list[float], list[float]]:
        """The least scores, and what the surroundings may add at most."""
        if self.bounds is None:
            most = np.zeros(OUTSIDE)
            for kind, n in (("left=", 1), ("right=", 1), ("cue=", 3)):
                rows = self.w[[i for f, i in self.names.items() if f.startswith(kind)]]
                most += np.sort(np.maximum(rows, 0), axis=0)[-n:].sum(0)
            self.bounds = self.least().tolist(), most.tolist()
            self.rows = {f: self.w[i].tolist() for f, i in self.names.items()}
        return self.bounds

    def scores(self, features: tuple[str, ...]) -> list[float]:
        """By type, what some features add."""
        if (got := self.known.get(features)) is None:
            got = self.known[features] = self.w[self.ids(features)].sum(0).tolist()
        return got

    def number_shape(self, nines: str) -> list[tuple[int, float, float]]:
        """(type, score without tests, with their best outcome) for numbers of a shape, where that may do."""
        least, most = self.prepared()
        rows = [r for f in number_features(nines) if (r := self.rows.get(f)) is not None]
        # Which tests apply is told by any digits.
        tests = [[self.scores((f"{t.partition('=')[0]}={x}",)) for x in (True, False)] for t in number_tests(nines, nines)]
        out = []
        for y in self.number_types:
            plain = sum([r[y] for r in rows])
            best = plain + sum([max(a[y], b[y]) for a, b in tests])
            if best + most[y] >= least[y]:
                out.append((y, plain, best))
        return out

    def numbers(self, text: str, found: list[tuple[int, int, int, float]]) -> None:
        """Adds the numbers that may be in a best segmentation. One whose shape, or whose best outcome of tests, doesn't do isn't looked at further."""
        least, _ = self.prepared()
        shapes, nines = self.shapes, text.translate(NINES)
        #: Of each group that a number may begin with: where it lies, the starts with what stands on their left (once asked for),
        #: the digits of the chain before it, and their sums where every other digit is doubled, from the first or from the second on.
        before: deque[tuple[int, int, list[tuple[int, list[float]]], int, tuple[int, int]]] = deque()
        end, n, sums = -9, 0, (0, 0)
        for m in GROUP.finditer(text):
            a, b = m.span()
            if before and not (0 < a - end <= 3 and JOINS.issuperset(text[end:a])):
                before.clear()
            if not before:
                n, sums = 0, (0, 0)
            end = b
            before.append((a, b, [], n, sums))
            if b - a > DIGITS:
                before.clear()
                continue
            group = m[0]
            odd, even = sum(map(int, group[::2])) + sum(map(DOUBLED.__getitem__, group[1::2])), sum(map(int, group[1::2])) + sum(map(DOUBLED.__getitem__, group[::2]))
            sums = (sums[0] + odd, sums[1] + even) if n % 2 == 0 else (sums[0] + even, sums[1] + odd)
            n += b - a
            right = self.scores((right_feature(text, b),))
            for k in range(len(before) - 1, -1, -1):
                first, _, ways, skipped, less = before[k]
                digits = n - skipped
                if digits > DIGITS:
                    # Nothing that ends later reaches this group either.
                    for _ in range(k + 1):
                        before.popleft()
                    break
                if digits < 7 and not (len(before) - k == 4 and nines.count(".", first, b) == 3 and b - first == digits + 3):
                    continue
                if not ways:
                    starts = [i for i in (first, first - 1, first - 2) if i >= 0 and text[i:first] in ("", "(", "+", "+(")]
                    ways += [(i, self.scores((*left_features(text, i), *sorted(f"cue={c}" for c in cues_before(text, i))))) for i in starts]
                for i, left in ways:
                    key = nines[i:b]
                    if (able := shapes.get(key)) is None:
                        if len(shapes) >= REMEMBERED:
                            shapes.clear()
                        able = shapes[key] = self.number_shape(key)
                    tests = None
                    for y, plain, best in able:
                        beside = left[y] + right[y]
                        if best + beside >= least[y]:
                            if tests is None:
                                side_of = (n - 1) % 2  # the last digit isn't doubled
                                tests = self.scores(number_tests(text[i:b], key, (sums[side_of] - less[side_of]) % 10 == 0))
                            if plain + tests[y] + beside >= least[y]:
                                found.append((i, b, y, plain + tests[y] + beside))

    def segments(self, text: str) -> list[tuple[int, int, int, float]]:
        """(start, end, type, score) of all candidates that may be in a best segmentation, by end."""
        least, _ = self.prepared()
        out: list[tuple[int, int, int, float]] = []
        self.numbers(text, out)
        for a, b, form in other_candidates(text):
            own, beside = self.w[self.ids(own_features(text[a:b], form))].sum(0).tolist(), self.scores(tuple(context_features(text, a, b)))
            for t in FORMS[form]:
                y = TYPES.index(t)
                if own[y] + beside[y] >= least[y]:
                    out.append((a, b, y, own[y] + beside[y]))
        return sorted(out, key=lambda x: (x[1], x[0], x[2]))

    def decode(self, text: str, segments: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities. Segments come by end; between two of them lie outside tokens or blanks only."""
        step, o = self.step.tolist(), OUTSIDE
        ends: list[int] = []
        values: list[float] = []
        back: list[int] = []
        #: The best way, so far, to be outside: its score and last segment.
        outside: list[tuple[float, int]] = []
        for k, (a, b, y, score) in enumerate(segments):
            edge = a
            while edge and text[edge - 1].isspace() and text[edge - 1] != "\n":
                edge -= 1
            at = bisect_left(ends, edge)
            value, last = outside[at - 1] if at else (0.0, -1)
            value += step[o][y]
            while at < len(ends) and ends[at] == edge:
                if (side_by_side := values[at] + step[segments[at][2]][y]) > value:
                    value, last = side_by_side, at
                at += 1
            ends.append(b)
            values.append(value + score)
            back.append(last)
            left = values[k] + step[y][o]
            outside.append(max(outside[-1], (left, k), key=lambda x: x[0]) if outside else max((0.0, -1), (left, k), key=lambda x: x[0]))
        edge = len(text)
        while edge and text[edge - 1].isspace() and text[edge - 1] != "\n":
            edge -= 1
        at = bisect_left(ends, edge)
        value, k = outside[at - 1] if at else (0.0, -1)
        for i in range(at, len(ends)):
            if values[i] > value:
                value, k = values[i], i
        out = []
        while k >= 0:
            out.append(segments[k][:3])
            k = back[k]
        return out[::-1]

    # Training, over all tokens of a sentence.

    def lattice(self, text: str, tokens: list[tuple[str, int, int]], grow: bool = False) -> list[tuple[int, int, list[int], np.ndarray]]:
        """(first token, token behind, features, which types it may be) of all candidates."""
        first, last = {t[1]: k for k, t in enumerate(tokens)}, {t[2]: k + 1 for k, t in enumerate(tokens)}
        found = [*number_candidates(text), *other_candidates(text)]
        return [(first[a], last[b], self.ids(own_features(text[a:b], form) + context_features(text, a, b), grow), self.able[form]) for a, b, form in found]

    def gradient(self, n: int, segments: list, gold: dict[tuple[int, int], int], rate: float, decay: float) -> float:
        """One step up the log-likelihood of a sentence; returns that."""
        outside = np.full(OUTSIDE + 1, -np.inf)
        outside[OUTSIDE] = 0
        ends: list[list[tuple[int, np.ndarray, int]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            ends[j].append((j - 1, outside, -1))
        for k, (i, j, f, able) in enumerate(segments):
            ends[j].append((i, np.append(self.w[f].sum(0) + able, -np.inf), k))
        forward = np.full((n + 1, OUTSIDE + 1), -np.inf)
        backward = np.full((n + 1, OUTSIDE + 1), -np.inf)
        forward[0, OUTSIDE], backward[n] = 0, 0
        lse = np.logaddexp.reduce
        came = [lse(forward[0][:, None] + self.step, axis=0)] + [None] * n
        for j in range(1, n + 1):
            forward[j] = lse(np.stack([came[i] + s for i, s, _ in ends[j]]), axis=0)
            came[j] = lse(forward[j][:, None] + self.step, axis=0)
        starts: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i, s, _ in ends[j]:
                starts[i].append((j, s))
        for i in range(n - 1, -1, -1):
            after = lse(np.stack([s + backward[j] for j, s in starts[i]]), axis=0)
            backward[i] = lse(self.step + after[None, :], axis=1)
        z = lse(forward[n])
        step = np.zeros_like(self.step)
        likelihood = -z
        for j in range(1, n + 1):
            for i, s, k in ends[j]:
                p = np.exp(forward[i][:, None] + self.step + (s + backward[j])[None, :] - z)
                step -= p
                if k >= 0:
                    g = -p.sum(0)[:OUTSIDE]
                    y = gold.get(segments[k][:2])
                    if y is not None:
                        g[y] += 1
                        likelihood += s[y]
                    self.w[segments[k][2]] += rate * g
        covered = {k for i, j in gold for k in range(i, j)}
        path = sorted([(i, y) for (i, _), y in gold.items()] + [(k, OUTSIDE) for k in range(n) if k not in covered])
        before = OUTSIDE
        for _, y in path:
            step[before, y] += 1
            likelihood += self.step[before, y]
            before = y
        step[OUTSIDE, OUTSIDE] = 0
        self.step += rate * step
        self.w *= 1 - rate * decay
        return float(likelihood)


def sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up sentence with its entities as (start, end, type)."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeinorstlmdéü") for _ in range(rng.randint(2, 8)))

    def card(sep: str) -> str:
        body = number(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def iban() -> str:
        country, body = rng.choice(("DE", "FR", "ES", "GB", "NL")), number(rng.randint(14, 20))
        check = 98 - int("".join(str(int(x, 36)) for x in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    def six() -> str:
        parts = [f"{rng.randrange(65536):x}" for _ in range(8)]
        if rng.random() < 0.5:
            return ":".join(parts)
        k = rng.randint(1, 4)
        return f"{':'.join(parts[:k])}::{':'.join(parts[k : k + rng.randint(1, 7 - k)])}"

    def mail() -> str:
        name = rng.choice((".", "_", "-", "")).join(word() for _ in range(rng.randint(1, 4))) + rng.choice(("", number(2)))
        host = ".".join([*(word() for _ in range(rng.randint(1, 4))), rng.choice(("com", "org", "net", "de", "example.com", "co.uk"))])
        return f"{name}{rng.choice(('@', '@', ' @ ', '@ '))}{host}"

    entities = (
        (mail, 0, "mail"),
        (mail, 0, "contact"),
        (lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), 1, "server"),
        (six, 1, "ip"),
        (lambda: card(rng.choice(("", " ", "-", "."))), 2, "card"),
        (lambda: f"+{rng.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}", 3, "call"),
        (lambda: rng.choice((f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"{number(3)} {number(3)} {number(4)}")), 3, "phone"),
        (iban, 4, "iban"),
        (lambda: f"{number(3)}-{number(2)}-{number(4)}", 5, "ssn"),
    )
    others = (
        (lambda: f"{rng.randint(1, 999)},{number(3)}.{number(2)}", "total"),
        (lambda: f"20{number(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", "date"),
        (lambda: f"{rng.randint(1, 23)}:{rng.randint(10, 59)}", "page"),
        (lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", "version"),
        (lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), "version"),
        (lambda: number(rng.randint(1, 8)), "order"),
        (lambda: next(n for n in iter(lambda: number(16), None) if not luhn(n)), "ref"),
        (lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), "ref"),
        (lambda: f"{word()}{number(2)}", "page"),
        (lambda: f"@{word()}", "page"),
        (lambda: f"{rng.choice('ABCEL')}{number(2)}X{number(2)}T{number(2)}", "ref"),
        (lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", "date"),
        (lambda: f"{number(3)}-{rng.randint(0, 9)}-{number(3)}-{number(5)}-{rng.randint(0, 9)}", "ref"),
        (lambda: " ".join(number(rng.randint(1, 5)) for _ in range(rng.randint(2, 6))), "page"),
        (lambda: rng.choice((" ", " ", ".", "-", "/")).join(number(rng.randint(1, 2)) for _ in range(rng.randint(6, 20))), "page"),
        (lambda: rng.choice((" ", "-", " (")).join(number(rng.choice((1, 2, 3, 5, 6, 8))) for _ in range(rng.randint(3, 9))), "total"),
        (lambda: f"{number(rng.randint(7, 12))}", "ref"),
        (lambda: f"{number(2)}{rng.choice('%$#')}", "price"),
    )
    text, gold = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice((" ", ", ", ". ", ": "))
        if rng.random() < 0.6:
            make, kind, cue = rng.choice(entities)
            text += f"{cue}{rng.choice((' ', ': '))}" if rng.random() < 0.5 else ""
            s = make()
            gold.append((len(text), len(text) + len(s), kind))
        else:
            make, cue = rng.choice(others)
            text += f"{cue} " if rng.random() < 0.5 else ""
            s = make()
        text += s + rng.choice((" ", ", ", ". ", "\n"))
    return text + word(), gold


#: Sentences, passes over them, and the seed of the training set.
SENTENCES, PASSES, SEED = 500, 4, 5


@lru_cache(maxsize=1)
def trained(sentences: int = SENTENCES, passes: int = PASSES, seed: int = SEED) -> Field:
    rng, field, data = random.Random(seed), Field(), []
    for _ in range(sentences):
        text, gold = sentence(rng)
        tokens = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
        first, last = {t[1]: k for k, t in enumerate(tokens)}, {t[2]: k + 1 for k, t in enumerate(tokens)}
        segments = field.lattice(text, tokens, grow=True)
        marks = {(first[a], last[b]): y for a, b, y in gold}
        known = {(i, j) for i, j, _, able in segments for y in np.flatnonzero(able == 0) if marks.get((i, j)) == y}
        if len(known) == len(marks):
            data.append((len(tokens), segments, marks))
    field.w = np.zeros((len(field.names), OUTSIDE))
    for form in FORMS:
        field.w[field.names[f"form={form}"]] = -3
    for k in range(passes):
        rng.shuffle(data)
        for n, segments, marks in data:
            field.gradient(n, segments, marks, 0.25 / (1 + k), 1e-4)
    return field


def field_spans(text: str, field: Field) -> list[tuple[str, int, int]]:
    """The entities of the best segmentation of a whole text."""
    return [(TYPES[y], a, b) for a, b, y in field.decode(text, field.segments(text))]


def personal_spans(text: str | None, field: Field) -> list[tuple[str, int, int]]:
    """All spans by kind, then start."""
    if not text or not TRIGGER.search(text):
        return []
    base, added = base_spans(text), []
    taken = {k: sorted((a, b) for x, a, b in base if x == k) for k in BASE}
    for k, a, b in field_spans(text, field):
        # Base spans of one kind don't overlap, so only the last one that begins before the end can reach in.
        at = bisect_left(taken.get(k, ()), (b, 0))
        if not (at and taken[k][at - 1][1] > a):
            added.append((ADDED[k], a, b))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(base + added, key=lambda x: (order[x[0]], x[1], x[2]))


def find_personal(df: DataFrame, text: str = "text", out: str = "personal", field: Field | None = None) -> DataFrame:
    """Adds an array of (kind, start, end). The field is a few thousand weights, whatever the input."""
    field = field or trained()
    return map_columns(df, [text], StructType([StructField(out, ArrayType(SPAN))]), lambda _, texts: [(span_rows(personal_spans(x, field)),) for x in texts])
