"""Personal data by a semi-Markov conditional random field.

A text is cut into tokens (letters, digits, white space, single marks). A segmentation is a row of segments:
free tokens, one each, and entities of up to MAX_TOKENS tokens. Every stretch of tokens that can_be_entity
allows is a candidate of every type, so candidates overlap on purpose. An entity is scored by features of its
whole span (digits, groups, separators, checks such as Luhn, what stands before and after) with weights for
each type, and by its type after the type before it. Dynamic programming over (end, length, type) chooses
boundaries and types jointly. As an entity holds a digit, an @ or an "at" with a dot, only the text within
REACH characters of these is cut into tokens; the rest is free for certain. What the marks leave out can't be
found: numbers of fewer than four digits near one another, and keys of under 16 characters or over 64.

Weights maximise the likelihood of whole segmentations: expected features by the forward and backward sums
over all segmentations of a window, gradient steps in numpy. Windows are gathered from every text around the
spans of the base rules and around plain numbers, grouped by shape and counted by Spark; the SHAPES most
frequent shapes of each sort are the training set, each as found and rewritten (disguised marks and
separators, other cues, one digit wrong), and numbers that are nobody's put in their place: dates and times,
ISBN, hashes, versions, thousands. A fifth type, secret, learns from key-like strings after a cue.

Base kinds, found leftmost and without overlap per kind, failing matches dropped: email, ip (parts up to
255), card (16 to 19 digits, Luhn), phone (a + and 8 to 15 digits). Offsets are code points. Spans by the
base rules always stay; the field adds spans that none of those overlaps.

Edge cases: null and empty texts have no spans; equal spans of two kinds are both kept; repeated rows are
judged each; very long texts are read whole, in stretches of tokens and in time that grows with their length; without any base span in the table the
field is empty and adds nothing; an empty table gives an empty one; only the id and text columns are read by
find; other columns pass redact unless its length_col names one of them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrade.llm.common import blocks, raw_texts, written

KINDS = ("email", "ip", "card", "phone")
NOTHING = hashlib.sha256(b"").hexdigest()
TYPES = (*KINDS, "secret")
FREE = len(TYPES)
#: Tokens and characters of an entity at most, characters around a mark that are cut into tokens, tokens that one step of the search holds.
MAX_TOKENS, MAX_CHARS, REACH, STRETCH = 28, 72, 72, 4096
#: Shapes that training takes of each sort, steps and step size, and weight decay.
SHAPES, EPOCHS, STEP, DECAY = 24, 35, 0.8, 1e-3
#: Numbers that are nobody's, drawn anew for each shape.
NOBODYS = 3

# The look-behind of ip only saves time: a match ends with its digits, so another can't start among them.
_email = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_host = regex.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_ip = regex.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = regex.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
#: What an entity must hold: a digit run with others near, a key of letters and digits, an @, or an "at" with a dot after it.
_mark = regex.compile(r"[0-9](?:[^0-9\n]{0,8}[0-9]){3,}|(?<![A-Za-z0-9])(?=[A-Za-z]{1,63}[0-9]|[0-9]{1,63}[A-Za-z])[A-Za-z0-9]{16,64}(?![A-Za-z0-9])|@|(?<![A-Za-z])at(?![A-Za-z])[^\n]{1,24}?(?:(?<![A-Za-z])dot(?![A-Za-z])|\.[A-Za-z])", regex.I)
_token = regex.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,64}(?![A-Za-z0-9])|[^\W\d_]+|[0-9]+|\s+|.", regex.S)
#: Texts in which neither of these is found hold no mark.
_plain_mark, _dotted = re.compile(r"[0-9@]"), re.compile(r"\.[A-Za-z]|(?<![A-Za-z])[dD][oO][tT](?![A-Za-z])")
# Words before a number or key that say what follows.
PHONE_CUES = frozenset(("call", "cell", "fax", "mobile", "phone", "ring", "tel", "telephone", "whatsapp"))
SECRET_CUES = frozenset(("apikey", "key", "passwd", "password", "pwd", "secret", "token"))
NUMBER_CUES = frozenset(("build", "checksum", "commit", "hash", "invoice", "isbn", "issn", "md", "order", "population", "ref", "release", "revision", "serial", "sha", "ticket", "total", "version"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def isbn(digits: str) -> bool:
    """Whether ten or thirteen digits have the check digit of a book number."""
    if len(digits) == 10:
        return sum((10 - i) * int(c) for i, c in enumerate(digits)) % 11 == 0
    return digits[:3] in ("978", "979") and sum(int(c) * (1 + 2 * (i % 2)) for i, c in enumerate(digits)) % 10 == 0


LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, from each @ outwards: what stands before an @ is looked at once."""
    low, at = 0, text.find("@")
    while at >= 0:
        name = text[low:at]
        start = low + len(name.rstrip(LOCAL))
        m = _host.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the base rules, by kind and then start."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in email_spans(text)]
    if not _digit.search(text):
        return out
    out += [("ip", *m.span()) for m in _ip.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split("."))]
    for m in _card.finditer(text):
        d = only_digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _phone.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Merged stretches of the text within REACH characters of a mark."""
    out: list[tuple[int, int]] = []
    if not _plain_mark.search(text) and not _dotted.search(text):
        return out
    for m in _mark.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


LETTERS, DIGITS, SPACE, MARK = range(4)


class Tokens:
    """A window's tokens: where they begin and end, and running sums of what the features count."""

    def __init__(self, text: str):
        self.text = text
        found = [(m.start(), m.end()) for m in _token.finditer(text)]
        self.start, self.end = np.array(found, np.int64).reshape(-1, 2).T
        words = self.words = [text[a:b] for a, b in found]
        self.n = n = len(words)
        keys = np.array([len(w) > 15 and w.isalnum() and not w.isalpha() and not w.isdecimal() for w in words], bool)
        self.kind = np.array([LETTERS if key or w.isalpha() else DIGITS if "0" <= w[0] <= "9" else SPACE if w.isspace() else MARK for w, key in zip(words, keys, strict=True)], np.int8)
        low = [w.lower() for w in words]
        near = lambda i: words[i] if 0 <= i < n else ""
        at = np.array([w == "at" for w in low], bool)
        sealed = np.array([near(i - 1) in "[({<" and near(i + 1) in "])}>" and near(i - 1) != "" and near(i + 1) != "" for i in range(n)], bool)
        dot_word = np.array([w == "dot" for w in low], bool)
        is_ = lambda c: np.array([w == c for w in words], bool)
        dots = is_(".")
        hinge = at | dot_word
        plain_word = (self.kind == LETTERS) & ~hinge
        beside = lambda v, k: np.concatenate((v[k:], np.zeros(k, bool))) if k > 0 else np.concatenate((np.zeros(-k, bool), v[:k]))
        inner_dot = dots & np.array([near(i + 1)[:1].isalnum() and near(i - 1)[-1:].isalnum() or bool(sealed[i]) for i in range(n)], bool)
        self.columns = {
            "keys": keys, "hinges": hinge, "dot_words": dot_word, "loose": (self.kind == SPACE) & beside(plain_word, -1)[:n] & beside(plain_word, 1)[:n], "dated": self.dates(), "digits": np.where(self.kind == DIGITS, self.end - self.start, np.array([len(only_digits(w)) if key else 0 for w, key in zip(words, keys, strict=True)], np.int64)), "groups": self.kind == DIGITS, "letters": self.kind == LETTERS, "spaces": self.kind == SPACE,
            "strong_at": is_("@") | at & sealed, "weak_at": at & ~sealed, "dots": dots | dot_word, "inner_dots": inner_dot | dot_word, "dashes": is_("-"), "pluses": is_("+"),
            "brackets": is_("(") | is_(")"), "seals": np.array([w in "[]{}<>" for w in words], bool), "odd": np.array([k == MARK and w not in ".@-+()[]{}<>_%" for k, w in zip(self.kind, words, strict=True)], bool),
            "breaks": np.array(["\n" in w for w in words], bool), "capitals": np.array([w.isupper() for w in words], bool), "wide": np.array([k == SPACE and len(w) > 1 for k, w in zip(self.kind, words, strict=True)], bool),
        }
        self.sums = {k: np.concatenate(([0], np.cumsum(v))) for k, v in self.columns.items()}
        cue = lambda names: np.array([any(x in names for x in low[max(0, i - 5) : i]) for i in range(n)], bool)
        self.phone_cue, self.secret_cue, self.number_cue = cue(PHONE_CUES), cue(SECRET_CUES), cue(NUMBER_CUES)
        self.headless = np.array([w in "([{" and near(i + 1) in ("at", "dot", "AT", "DOT", "At", "Dot") for i, w in enumerate(words)], bool)
        self.capital = np.array([w[0].isupper() and not w.isupper() for w in words], bool)
        self.zero = np.array([w[0] == "0" for w in words], bool)
        self.tail = np.array([k == LETTERS and 2 <= len(w) <= 6 for k, w in zip(self.kind, words, strict=True)], bool)
        self.hex = np.concatenate(([0], np.cumsum([k in (LETTERS, DIGITS) and any(c not in "0123456789abcdefABCDEF" for c in w) for k, w in zip(self.kind, words, strict=True)])))

    def dates(self) -> np.ndarray:
        """Which tokens lie in a date of three numbers: a year of this or the last century first or last, one separator."""
        inside, words = np.zeros(self.n, bool), self.words
        for k in range(self.n - 4):
            if self.kind[k] == DIGITS and words[k + 1] in ("-", "/", ".") and words[k + 3] == words[k + 1] and self.kind[k + 2] == DIGITS and self.kind[k + 4] == DIGITS:
                a, b, c = words[k], words[k + 2], words[k + 4]
                if len(b) <= 2 and (len(a) == 4 and a[:2] in ("19", "20") and len(c) <= 2 or len(c) == 4 and c[:2] in ("19", "20") and len(a) <= 2):
                    inside[k : k + 5] = True
        return inside

    def count(self, name: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.sums[name][j] - self.sums[name][i]


def candidates(t: Tokens, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Token ranges [i, j) with low < j <= high that may be an entity."""
    j = np.repeat(np.arange(low + 1, high + 1), MAX_TOKENS)
    i = j - np.tile(np.arange(1, MAX_TOKENS + 1), high - low)
    keep = i >= 0
    i, j = i[keep], j[keep]
    return i[ok := can_be_entity(t, i, j)], j[ok]


def can_be_entity(t: Tokens, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Entities start with a letter, a digit, + or (, end with a letter, a digit or ), both no lone at or dot (nor its bracket), stay on a line, have no space between two plain words, and hold seven digits, four groups of digits, or an at and a dot."""
    first, last = t.kind[i], t.kind[j - 1]
    opens = (first == LETTERS) | (first == DIGITS) | (t.columns["pluses"][i] | t.columns["brackets"][i]) & (first == MARK)
    closes = (last == LETTERS) | (last == DIGITS) | t.columns["brackets"][j - 1]
    digits, at = t.count("digits", i, j), t.count("strong_at", i, j) + t.count("weak_at", i, j)
    holds = (digits >= 7) | (t.count("groups", i, j) >= 4) | (t.count("keys", i, j) > 0) | (at > 0) & (t.count("inner_dots", i, j) > 0)
    hinged = t.columns["hinges"][i] | t.columns["hinges"][j - 1] | t.headless[i]
    return opens & closes & ~hinged & holds & (t.count("loose", i, j) == 0) & (t.count("breaks", i, j) == 0) & (t.count("wide", i, j) == 0) & (t.end[j - 1] - t.start[i] <= MAX_CHARS)


NAMES = (
    "bias", "digits_8_15", "digits_16_19", "digits_over_19", "luhn", "one_group", "two_groups", "four_groups", "five_groups", "four_parts", "plus_first", "plus_inside", "bracket", "zero_first", "spaced", "dashed", "dotted", "mixed_separators",
    "letters", "no_letters", "many_letters", "strong_at", "weak_at", "two_ats", "dot_after", "name_last", "odd_mark", "seals", "glued_left", "glued_right", "phone_cue", "secret_cue", "key_like", "hex", "capitals", "after_equals", "long", "digit_left", "digit_right",
    "dated", "isbn", "number_cue", "hash", "at_and_dot_words", "capital_last",
)


def features(t: Tokens, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A row of NAMES for each token range."""
    digits, groups, spaces, dashes, dots = (t.count(k, i, j) for k in ("digits", "groups", "spaces", "dashes", "dots"))
    letters, odd, pluses = (t.count(k, i, j) for k in ("letters", "odd", "pluses"))
    strong, weak = t.count("strong_at", i, j), t.count("weak_at", i, j)
    plain = letters == 0
    luhns, parts = np.zeros(len(i), bool), np.zeros(len(i), bool)
    for k in np.flatnonzero((digits >= 16) & (digits <= 19) & plain):
        luhns[k] = luhn(only_digits(t.text[t.start[i[k]] : t.end[j[k] - 1]]))
    for k in np.flatnonzero((groups == 4) & (dots == 3) & (odd == 0) & (dashes + pluses == 0)):
        found = [w for w in t.words[i[k] : j[k]] if w[0].isdigit()]
        parts[k] = all(len(w) < 4 and int(w) <= 255 for w in found)
    books = np.zeros(len(i), bool)
    for k in np.flatnonzero(((digits == 10) & (groups == 4) | (digits == 13)) & plain & (pluses == 0)):
        books[k] = isbn(only_digits(t.text[t.start[i[k]] : t.end[j[k] - 1]]))
    before, after = np.maximum(i - 1, 0), np.minimum(j, t.n - 1)
    has_before, has_after = i > 0, j < t.n
    word = (t.kind == LETTERS) | (t.kind == DIGITS)
    glued_mark = np.array([w in "@_+-./" for w in t.words], bool)
    beyond = np.minimum(j + 1, t.n - 1)
    left = has_before & (word[before] | glued_mark[before])
    right = has_after & (word[after] | glued_mark[after] & (j + 1 < t.n) & word[beyond])
    size = t.end[j - 1] - t.start[i]
    mixed_key = (size >= 16) & (t.count("keys", i, j) > 0) & (j - i == 1)
    equals = np.array([w in "=:\"'" for w in t.words], bool)
    return np.column_stack([
        np.ones(len(i)), (digits >= 8) & (digits <= 15), (digits >= 16) & (digits <= 19), digits > 19, luhns, groups == 1, groups == 2, groups == 4, groups >= 5, parts,
        t.columns["pluses"][i], pluses > t.columns["pluses"][i], t.count("brackets", i, j) > 0, t.zero[i], spaces > 0, dashes > 0, dots > 0, (spaces > 0).astype(int) + (dashes > 0) + (dots > 0) > 1,
        letters > 0, plain, letters > 8, strong > 0, weak > 0, strong + weak > 1, t.count("inner_dots", i, j) > 0, t.tail[j - 1] & (letters > 1), odd > 0, t.count("seals", i, j) > 0, left, right,
        t.phone_cue[i], t.secret_cue[i], mixed_key, mixed_key & (t.hex[j] == t.hex[i]), mixed_key & (t.count("capitals", i, j) == letters), has_before & equals[before], j - i > 12,
        has_before & (t.kind[before] == SPACE) & (i > 1) & (t.kind[np.maximum(i - 2, 0)] == DIGITS), has_after & (t.kind[after] == SPACE) & (t.kind[beyond] == DIGITS) & (j + 1 < t.n),
        t.count("dated", i, j) > 0, books, t.number_cue[i], mixed_key & (t.hex[j] == t.hex[i]) & np.isin(size, (32, 40, 56, 64)), (weak > 0) & (t.count("dot_words", i, j) > 0), t.capital[j - 1],
    ]).astype(float)


class Field:
    """weights: a row for each type over NAMES; follows: the score of a type (or FREE, last) after another."""

    def __init__(self, weights: np.ndarray | None = None, follows: np.ndarray | None = None):
        self.empty = weights is None
        self.weights = np.zeros((len(TYPES), len(NAMES))) if weights is None else weights
        self.follows = np.zeros((FREE + 1, FREE + 1)) if follows is None else follows

    def segments(self, t: Tokens, low: int, high: int, blocked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates that end in (low, high] and hold no blocked token, and their score for each type."""
        i, j = candidates(t, low, high)
        free = blocked[j] == blocked[i]
        i, j = i[free], j[free]
        return i, j, features(t, i, j) @ self.weights.T if len(i) else np.zeros((0, FREE))

    def best(self, t: Tokens, blocked: np.ndarray) -> list[tuple[int, int, int]]:
        """(type, i, j) of the entities in the best segmentation of all tokens; blocked: running counts of tokens that must be free."""
        k, n = FREE + 1, t.n
        ring = np.full((MAX_TOKENS + 1, k), -np.inf)  # best score of the last ends, as it enters each type
        entered = np.zeros((MAX_TOKENS + 1, k), np.int8)
        ring[0] = self.follows[FREE]
        entered[0] = FREE
        back_length, back_type = np.ones((n + 1, k), np.int8), np.zeros((n + 1, k), np.int8)
        final = np.full(k, -np.inf)
        final[FREE] = 0.0
        for low in range(0, n, STRETCH):
            high = min(n, low + STRETCH)
            i, j, scores = self.segments(t, low, high, blocked)
            cut = np.searchsorted(j, np.arange(low + 1, high + 2))
            for e in range(low + 1, high + 1):
                final = np.full(k, -np.inf)
                last = (e - 1) % (MAX_TOKENS + 1)
                final[FREE] = ring[last, FREE]
                back_type[e, FREE] = entered[last, FREE]
                a, b = cut[e - low - 1], cut[e - low]
                if b > a:
                    at = i[a:b] % (MAX_TOKENS + 1)
                    total = ring[at, :FREE] + scores[a:b]
                    pick = total.argmax(0)
                    final[:FREE] = total[pick, np.arange(FREE)]
                    back_length[e, :FREE] = e - i[a:b][pick]
                    back_type[e, :FREE] = entered[at[pick], np.arange(FREE)]
                into = final[:, None] + self.follows
                here = e % (MAX_TOKENS + 1)
                entered[here] = into.argmax(0)
                ring[here] = into.max(0)
        out, y, e = [], int(final.argmax()), n
        while e > 0:
            size = int(back_length[e, y]) if y != FREE else 1
            if y != FREE:
                out.append((y, e - size, e))
            y, e = int(back_type[e, y]), e - size
        return out[::-1]

    def decode(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """The best segmentation's entities where no taken span lies."""
        out = []
        if self.empty:
            return out
        begins, ends = np.array([(x, y) for _, x, y in taken], np.int64).reshape(-1, 2).T
        for a, b in windows(text):
            t = Tokens(text[a:b])
            steps = np.zeros(t.n + 1, np.int64)
            near = (begins < b) & (ends > a)
            np.add.at(steps, np.searchsorted(t.end + a, begins[near], "right"), 1)
            np.add.at(steps, np.searchsorted(t.start + a, ends[near], "left"), -1)
            blocked = np.concatenate(([0], np.cumsum(np.cumsum(steps[:-1]) > 0)))
            out += [(TYPES[y], a + int(t.start[i]), a + int(t.end[j - 1])) for y, i, j in self.best(t, blocked)]
        return out

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all spans by kind and start."""
        base = base_spans(text)
        more = self.decode(text, base)
        return base, sorted(base + more, key=lambda s: (TYPES.index(s[0]), s[1], s[2])) if more else base


# Training


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Lattice:
    """The candidates of many windows, aligned by end, for the sums over all segmentations."""

    def __init__(self, items: list[tuple[Tokens, list[tuple[int, int, int]]]]):
        self.tokens = np.array([t.n for t, _ in items])
        self.n = int(self.tokens.max())
        w, i, j, rows, gold = [], [], [], [], []
        self.pairs = np.zeros((FREE + 1, FREE + 1))
        self.pair_of = []
        for b, (t, entities) in enumerate(items):
            p, q = candidates(t, 0, t.n)
            w.append(np.full(len(p), b))
            i.append(p)
            j.append(q)
            rows.append(features(t, p, q))
            named = {(x, y): k for k, x, y in entities}
            gold.append(np.array([named.get((x, y), -1) for x, y in zip(p.tolist(), q.tolist(), strict=True)], np.int64))
            order, at = [FREE], 0
            for k, x, y in sorted(entities, key=lambda s: s[1]):
                order += [FREE] * (x - at) + [k]
                at = y
            order += [FREE] * (t.n - at)
            m = np.zeros((FREE + 1, FREE + 1))
            np.add.at(m, (order[:-1], order[1:]), 1)
            self.pair_of.append(m)
        self.w, self.i, self.j, self.rows, self.gold = (np.concatenate(x) for x in (w, i, j, rows, gold))

    def expected(self, weights: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window the log of the sum over segmentations; each candidate's probability as each type; the expected number of each type after another, by window."""
        size, k, n = len(self.tokens), FREE + 1, self.n
        score = np.full((size, n + 1, MAX_TOKENS + 1, FREE), -np.inf)
        score[self.w, self.j, self.j - self.i] = self.rows @ weights.T
        ahead = np.full((size, n + 1, k), -np.inf)
        ahead[:, 0, FREE] = 0.0
        into = np.full((size, n + 1, k), -np.inf)
        into[:, 0] = follows[FREE]
        for e in range(1, n + 1):
            ahead[:, e, FREE] = into[:, e - 1, FREE]
            longest = min(e, MAX_TOKENS)
            ahead[:, e, :FREE] = lse(into[:, e - longest : e, :FREE] + score[:, e, longest:0:-1], 1)
            into[:, e] = lse(ahead[:, e, :, None] + follows, 1)
        each = np.arange(size)
        total = lse(ahead[each, self.tokens], 1)
        # behind[e, y]: all that can follow a segment of type y that ends at e; start[e, y]: all from a segment of type y that starts at e.
        behind = np.full((size, n + 1, k), -np.inf)
        behind[each, self.tokens] = 0.0
        start = np.full((size, n + 2, k), -np.inf)
        for e in range(n, -1, -1):
            if e < n:
                start[:, e, FREE] = behind[:, e + 1, FREE]
                longest = min(n - e, MAX_TOKENS)
                ends = np.arange(e + 1, e + longest + 1)
                start[:, e, :FREE] = lse(behind[:, e + 1 : e + longest + 1, :FREE] + score[:, ends, ends - e], 1)
                here = lse(start[:, e, None, :] + follows, 2)
                behind[:, e] = np.where((self.tokens == e)[:, None], 0.0, here)
        chance = np.exp(into[self.w, self.i, :FREE] + score[self.w, self.j, self.j - self.i] + behind[self.w, self.j, :FREE] - total[self.w, None])
        pairs = np.exp(ahead[:, :n, :, None] + follows + start[:, :n, None, :] - total[:, None, None, None]).sum(1)
        return total, chance, pairs


def learn(items: list[tuple[Tokens, list[tuple[int, int, int]]]], times: np.ndarray, epochs: int = EPOCHS) -> Field:
    """Weights of the greatest likelihood of the given segmentations, by adaptive gradient steps. times: how much each window weighs."""
    if not items:
        return Field()
    lattice = Lattice(items)
    weights, follows = np.zeros((len(TYPES), len(NAMES))), np.zeros((FREE + 1, FREE + 1))
    named = lattice.gold >= 0
    seen = np.zeros((len(named), FREE))
    seen[np.flatnonzero(named), lattice.gold[named]] = 1.0
    times = times / times.sum()
    seen_pairs = (np.array(lattice.pair_of) * times[:, None, None]).sum(0)
    square_w, square_f = np.full_like(weights, 1e-6), np.full_like(follows, 1e-6)
    for step in range(epochs):
        _, chance, pairs = lattice.expected(weights, follows)
        up = ((seen - chance) * times[lattice.w, None]).T @ lattice.rows - DECAY * weights
        up_f = seen_pairs - (pairs * times[:, None, None]).sum(0) - DECAY * follows
        square_w += up * up
        square_f += up_f * up_f
        rate = STEP * (1 - step / (2 * epochs))
        weights += rate * up / np.sqrt(square_w)
        follows += rate * up_f / np.sqrt(square_f)
    return Field(weights, follows)


_plain = regex.compile(r"[^\W\d_]+")


def shape(text: str) -> str:
    """The text with its digits as 9 and its words as one letter, but for those that the features know."""
    known = PHONE_CUES | SECRET_CUES | NUMBER_CUES | {"at", "dot"}
    short = _plain.sub(lambda m: m.group() if m.group().lower() in known else "A" if m.group().isupper() else "a", text)
    return regex.sub(r"(?:a[ ,.]*)*a(?=\W|$)", "a", regex.sub(r"[0-9]", "9", short)).strip()


_key = regex.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,64}(?![A-Za-z0-9_-])")


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Key-like strings (16 to 64 characters, letters and digits) after a cue word or of capitals and digits only: what the type secret learns from."""
    out = []
    for m in _key.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            before = text[max(0, m.start() - 24) : m.start()].lower()
            if s.upper() == s or any(w in SECRET_CUES for w in _plain.findall(before)[-2:]):
                out.append(("secret", *m.span()))
    return out


def examples(text: str) -> list[tuple[str, str, str]]:
    """(sort, shape, window with its spans as kind:start:end) around each base span, secret and number of a text."""
    gold = sorted(base_spans(text) + secret_spans(text), key=lambda s: s[1])
    starts = [s[1] for s in gold]
    out = []
    for a, b in windows(text):
        inside = [(k, x, y) for k, x, y in gold[bisect_left(starts, a) : bisect_left(starts, b)] if y <= b]
        for kind, x, y in inside or [("none", a + REACH, min(b, a + REACH + 24))]:
            p, q = max(0, x - 24), min(len(text), y + 24)
            here = [(k, u - p, v - p) for k, u, v in gold[bisect_left(starts, p) : bisect_left(starts, q)] if v <= q]
            if not any(u < y2 and x2 < v for n, (_, u, v) in enumerate(here) for _, x2, y2 in here[n + 1 :]):
                out.append((kind, shape(text[p:q]), text[p:q] + "\n\n" + ",".join(f"{k}:{u}:{v}" for k, u, v in here)))
    return out


def rewritten(kind: str, span: str, rng: np.random.Generator) -> list[tuple[str, str, bool]]:
    """(text before, span, whether it still is an entity) of ways to write the span's kind otherwise."""
    pick = lambda *x: x[rng.integers(len(x))]
    if kind == "email":
        out = []
        bare = regex.sub(r"[0-9]+", "", span)
        for s in (span, bare if _email.fullmatch(bare) else span, bare.split(".", bare.count(".") - 1)[-1] if bare.partition("@")[2].count(".") > 1 else bare):
            name, _, host = s.rpartition("@")
            name = name or "jo"
            at, dot = pick(" [at] ", " (at) ", "[at]", "(at)", " {at} "), pick(" [dot] ", " dot ", ".", " (dot) ", " DOT ")
            out += [("", name + at + host.replace(".", dot), True), ("", name + "@" + host, True), ("", name + pick(" at ", " AT ") + host.replace(".", pick(" dot ", " DOT ")), True)]
        return [*out, ("", name.strip(".") + " at noon." + host.partition(".")[0].capitalize(), False), ("", name.strip(".") + " at " + host.partition(".")[0] + "." + pick("then", "and", "so", "it"), False)]
    d = only_digits(span)
    if kind == "ip":
        return [("", span.replace(".", pick("[.]", " dot ", "(.)", " . ")), True), ("", ".".join(["9" + p for p in span.split(".")]) if len(d) > 9 else span + "0000", False)]
    if kind == "card":
        ends = np.cumsum(pick([4, 4, 4], [4, 6], [4, 4]))
        parts = [d[a:b] for a, b in zip([0, *ends], [*ends, len(d)], strict=True)]
        wrong = d[:-1] + str((int(d[-1]) + 1) % 10)
        return [("", pick(".", "/", " - ").join(parts), True), ("", wrong, False), ("", " ".join(wrong[k : k + 4] for k in range(0, len(wrong), 4)), False)]
    if kind == "phone":
        d = d[-int(rng.integers(8, 12)) :]
        sep = pick(" ", "-", ".", " ")
        cut = pick([3, 3], [4, 3], [3, 4], [2, 4], [2, 2, 2])
        ends = np.cumsum(cut)
        parts = [x for x in (d[a:b] for a, b in zip([0, *ends], [*ends, len(d)], strict=True)) if x]
        local = sep.join(parts)
        cue = pick("call ", "phone ", "tel: ", "mobile ", "ring ", "fax ")
        return [(cue, local, True), (cue, d[-10:-7] + "-" + d[-7:-4] + "-" + d[-4:], True), (cue, "(" + parts[0] + ") " + sep.join(parts[1:]), True), (cue, d, True), ("", "00" + sep + local, True), ("", d, False), ("", local.replace(sep, pick(",", "/")), False)]
    if kind == "secret":
        small, mixed = (key_of(rng, 16, 40, letters) for letters in ("abcdefghijklmnopqrstuvwxyz", LOCAL[:52]))
        return [(pick("key: ", "token ", "api key = "), small, True), (pick("password: ", "secret=", "my key "), mixed, True)]
    return []


def key_of(rng: np.random.Generator, low: int, high: int, letters: str) -> str:
    """A key of letters with some digits inside."""
    out = [letters[k] for k in rng.integers(0, len(letters), int(rng.integers(low, high)))]
    for k in rng.integers(1, len(out), int(rng.integers(1, 6))):
        out[k] = str(rng.integers(0, 10))
    return "".join(out)


def nobodys(rng: np.random.Generator) -> list[tuple[str, str]]:
    """(text before, number): one of each sort of numbers and keys that name nobody."""
    n = lambda a, b: int(rng.integers(a, b))
    year, month, day = n(1950, 2035), n(1, 13), n(1, 29)
    sep = "-/."[n(0, 3)]
    first = f"{year}{sep}{month:02}{sep}{day:02}"
    turned = f"{month:02}{sep}{day:02}{sep}{year}"
    time = f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}"
    ten = [n(0, 10) for _ in range(9)]
    check = next((d for d in range(10) if isbn("".join(map(str, [*ten, d])))), None)
    book = f"{ten[0]}-{''.join(map(str, ten[1:4]))}-{''.join(map(str, ten[4:]))}-{'X' if check is None else check}"
    long_ = f"978-{ten[0]}-{ten[1]}{ten[2]}-{''.join(map(str, ten[3:9]))}-"
    long_ += next(str(d) for d in range(10) if isbn(only_digits(long_) + str(d)))
    key = "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, (32, 40, 64)[n(0, 3)]))
    return [
        ("", f"{first} {time}"), ("on ", first), ("from ", f"{turned} to {turned[:-1]}{n(0, 10)}"), ("", f"{first}T{time}Z"), (("ISBN ", "")[n(0, 2)], long_), (("isbn ", "")[n(0, 2)], book),
        (("commit ", "sha ", "", "hash ")[n(0, 4)], key), (("", "file ", "id ")[n(0, 3)], key_of(rng, 16, 40, LOCAL[26 * n(0, 2) : 52])), ("version ", f"{n(1, 20)}.{n(0, 9)}.{n(1000, 30000)}.{n(1, 4000)}"), ("", f"{n(1, 999)} {n(100, 999)} {n(100, 999)}"), ("total ", f"{n(1, 99)},{n(100, 999)},{n(100, 999)}.{n(10, 99)}"),
    ]


def training_set(rows: list[tuple[str, str, int]], seed: int = 5) -> tuple[list[tuple[Tokens, list[tuple[int, int, int]]]], np.ndarray]:
    """Windows with their entities, as found and rewritten, and how much each weighs. rows: (sort, example, times seen)."""
    rng = np.random.default_rng(seed)
    items, times = [], []

    def add(text: str, spans: list[tuple[str, int, int]], n: float) -> None:
        t = Tokens(text)
        begins, ends = {int(a): i for i, a in enumerate(t.start)}, {int(b): i + 1 for i, b in enumerate(t.end)}
        entities = [(TYPES.index(k), begins.get(a, -1), ends.get(b, -1)) for k, a, b in spans]
        i, j = (np.array([e[x] for e in entities], np.int64) for x in (1, 2))
        if 0 < t.n <= 72 and all(e[1] >= 0 and 0 < e[2] - e[1] <= MAX_TOKENS for e in entities) and (not len(i) or can_be_entity(t, i, j).all()):
            items.append((t, entities))
            times.append(n)

    for kind, example, n in rows:
        text, _, listed = example.rpartition("\n\n")
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in listed.split(",") if s)]
        weight = 1 + np.log(n)
        add(text, spans, weight)
        drawn = nobodys(rng) if kind != "email" else []
        for cue, number in [drawn[k] for k in rng.permutation(len(drawn))[:NOBODYS]]:
            # Words around the example, without its own span or cues.
            head = "" if not spans else " ".join(w for w in text[: spans[0][1]].split() if not (set(_plain.findall(w.lower())) & (PHONE_CUES | SECRET_CUES) or _digit.search(w)))
            tail = "" if not spans else text[spans[-1][2] :][:24]
            if not _digit.search(tail) and "@" not in head + tail:
                add(f"{head} {cue}{number}{tail}", [], weight / 4)
        first = next(((k, a, b) for k, a, b in spans if k == kind), None)
        if first and len(spans) == 1:
            _, a, b = first
            for before, other, still in rewritten(kind, text[a:b], rng):
                tail = str(rng.choice(["", ".", ",", " "])) + " " if b == len(text) or text[b].isspace() else ""
                head = text[:a] + before
                new = head + other + tail + text[b:]
                add(new, [(kind, len(head), len(head) + len(other))] if still else [], weight / 4)
    return items, np.array(times)


def fit(docs: DataFrame, text_col: str = "text", shapes: int = SHAPES) -> Field:
    """Weights from the windows of all texts, grouped by shape; the driver gets `shapes` of each sort at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            got = [e for t in raw_texts(batch, text_col) for e in examples(t.decode())]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*got, strict=True)], names=["sort", "shape", "example"])

    # The filter is what every window holds; it runs before the texts leave the JVM.
    marked = docs.select(text_col).where(F.col(text_col).rlike(r"@|[0-9]|(?i)\bat\b.{1,24}?(\bdot\b|\.[a-z])"))
    counted = marked.mapInArrow(run, "sort string, shape string, example string").groupBy("sort", "shape").agg(F.count("*").alias("n"), F.min("example").alias("example"))
    counted = written(counted, "pii-shapes")
    rows = [(sort, r["example"], r["n"]) for sort in (*TYPES, "none") for r in counted.where(F.col("sort") == sort).orderBy(F.desc("n"), "shape").limit(shapes).collect()]
    return learn(*training_set(rows)) if any(r[0] in KINDS for r in rows) else Field()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, a count of base spans for each kind, base_sha256 and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            got = [field.spans(t.decode()) for t in raw_texts(batch, text_col)]
            counts = [pa.array([sum(s[0] == k for s in g[0]) for g in got], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(joined(g[0]).encode()).hexdigest() if g[0] else NOTHING for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *counts, digests, pa.array([joined(g[1]) for g in got], pa.string())], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by <KIND> of the first."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of docs with spans masked; length_col names an integer column that holds the text's length and is set anew in changed rows, all other columns stay."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            new = [t if not t else masked(t, field.spans(t)[1]) for t in texts]
            cols = list(batch.columns)
            cols[names.index(text_col)] = pa.array(new, cols[names.index(text_col)].type)
            if length_col is not None:
                old = cols[names.index(length_col)].to_pylist()
                cols[names.index(length_col)] = pa.array([o if n == t else len(n) for o, n, t in zip(old, new, texts, strict=True)], cols[names.index(length_col)].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
