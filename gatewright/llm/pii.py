"""Personal data: four exact patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments (runs of up to LONGEST tokens around a seed, such as
a digit or an @) by features of the span: its shape, its digits, its check sum, the words
before it. A dynamic programme over at most LONGEST tokens a segment chooses boundaries and
types together. Its weights are trained here, by gradient ascent on the exact likelihood (the
forward and backward sums over segmentations) of generated lines. Exact spans always stay;
spans of the field that touch none of them are added.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import rows
from gatewright.session import in_arrow

#: Kinds in the order that breaks ties of start; the last is the field's alone.
KINDS = ("email", "ip", "card", "phone", "secret")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str, out: list[Span]) -> None:
    """Leftmost non-overlapping matches: each begins where the run of local characters before an @ does."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            out.append((start, 0, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str, out: list[Span], at: int) -> None:
    """Four parts at a time of each maximal run of dotted numbers, which is how leftmost matches fall."""
    for run in DOTTED.finditer(text, at):
        parts = run.group().split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = start + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                out.append((start, 1, end))
            start = end + 1


def base_spans(text: str) -> list[Span]:
    """The exact spans, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        _emails(text, out)
    first = DIGIT.search(text)
    if first:
        _addresses(text, out, first.start())
        for m in CARD.finditer(text, first.start()):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# The field.

TOKEN = re.compile(r"\S+")
#: A token that may lie in an entity, and so starts a region.
SEED = re.compile(r"[0-9@]|[(\[]at[)\]]")
#: Tokens in a segment, and tokens of context around a seed.
LONGEST, AROUND = 6, 3
CUES = {
    "email": ("mail", "email", "e-mail", "write", "contact"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit"),
    "phone": ("tel", "phone", "call", "fax", "mobile"), "secret": ("token", "key", "secret", "password", "apikey", "api_key"),
}
CUE = {w: k for k, words in CUES.items() for w in words}
PUNCT = "\"'.,;:!?=|()[]<>*#$%&"
FEATURES = 48


def _bare(token: str) -> str:
    return token.strip(PUNCT)


def segment_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Features of the segment of tokens i..j (inclusive): numbers below FEATURES."""
    span = text[tokens[i][0] : tokens[j][1]].strip(PUNCT)
    digits = [c for c in span if "0" <= c <= "9"]
    n, size = len(digits), j - i + 1
    letters = sum(c.isalpha() for c in span)
    got = [0, min(size, 6), 7 + min(n // 3, 7)]
    if "@" in span:
        got.append(15)
    if re.search(r"[(\[]at[)\]]", span):
        got.append(16)
    if re.search(r"[(\[]dot[)\]]", span) or (size > 2 and " dot " in span):
        got.append(17)
    if letters == 0:
        got.append(18)
    if n and letters and size == 1 and re.fullmatch(r"[0-9a-fA-F]{16,}", span):
        got.append(19)
    if n and letters and size == 1 and re.fullmatch(r"[A-Za-z0-9_\-+/]{20,}", span):
        got.append(20)
    if letters == 0 and 13 <= n <= 19:
        got += [21, 22 if luhn("".join(digits)) else 23]
    if letters == 0 and re.fullmatch(r"[0-9]{4}(?:[ .-]?[0-9]{4}){2,3}", span):
        got.append(24)
    if letters == 0 and re.fullmatch(r"\(?[0-9]{2,4}\)?(?:[ .\-/][0-9]{2,4}){2,4}", span):
        got.append(25)
    if letters == 0 and re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", span):
        got.append(26)
    if re.fullmatch(r"(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}", span):
        got.append(27)
    if span.startswith("+"):
        got.append(28)
    if size > 1 and not any(SEED.search(text, *tokens[k]) for k in (i, j)):
        got.append(29)
    if not all(any(c.isalnum() or c in "@" for c in text[a:b]) for a, b in tokens[i : j + 1]):
        got.append(30)
    for back in (1, 2):
        if i >= back:
            word = _bare(text[slice(*tokens[i - back])]).lower()
            if word in CUE:
                got.append(31 + KINDS.index(CUE[word]))
                break
    if letters and letters > n and size > 1 and 15 not in got and 16 not in got:
        got.append(36)
    if any(text[b - 1] in ".;!?|" for _, b in tokens[i:j]):
        got.append(37)
    if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", span):
        got.append(38)
    return got


def _possible(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> bool:
    """Segments that a type may have: at least six digits, an @, or a spelled-out one; or one long token."""
    span = text[tokens[i][0] : tokens[j][1]]
    return "@" in span or "(at)" in span or "[at]" in span or i == j and len(span) >= 20 or sum("0" <= c <= "9" for c in span) >= 6


class Lattice:
    """Candidate segments of a run of tokens: for each end, (start, features); a token alone may be outside all."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.n = len(tokens)
        seeded = [SEED.search(text, *t) is not None for t in tokens]
        self.ending: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(self.n + 1)]
        for i in range(self.n):
            for j in range(i, min(self.n, i + LONGEST)):
                if any(seeded[i : j + 1]) and _possible(text, tokens, i, j):
                    self.ending[j + 1].append((i, np.array(segment_features(text, tokens, i, j))))

    def scores(self, w: np.ndarray):
        return [[(i, f, w[:, f].sum(1)) for i, f in own] for own in self.ending]

    def best(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """The best segmentation: (first token, end token, kind) of its entities."""
        value, back = [0.0] * (self.n + 1), [None] * (self.n + 1)
        for end, own in enumerate(self.scores(w)):
            if end:
                value[end] = value[end - 1]
            for i, _, s in own:
                k = int(s.argmax())
                if value[i] + s[k] > value[end]:
                    value[end], back[end] = value[i] + s[k], (i, end, k)
        out, end = [], self.n
        while end:
            if back[end]:
                out.append(back[end])
                end = back[end][0]
            else:
                end -= 1
        return out[::-1]

    def gradient(self, w: np.ndarray, truth: list[tuple[int, int, int]], into: np.ndarray) -> None:
        """Add the gradient of the log likelihood of truth."""
        scored = self.scores(w)
        ahead, behind = np.full(self.n + 1, -np.inf), np.full(self.n + 1, -np.inf)
        ahead[0] = behind[self.n] = 0
        for end in range(1, self.n + 1):
            ahead[end] = np.logaddexp.reduce([ahead[end - 1], *(ahead[i] + x for i, _, s in scored[end] for x in s)])
        for end in range(self.n, 0, -1):
            behind[end - 1] = np.logaddexp(behind[end - 1], behind[end])
            for i, _, s in scored[end]:
                behind[i] = np.logaddexp.reduce([behind[i], *(behind[end] + s)])
        for end in range(1, self.n + 1):
            for i, f, s in scored[end]:
                chance = np.exp(ahead[i] + s + behind[end] - ahead[self.n])
                for t in truth:
                    if t[:2] == (i, end):
                        into[t[2], f] += 1
                into[:, f] -= chance[:, None]


def training_line(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated line: filler words, entities with or without a cue, and decoys. Returns text and (first token, end token, kind)."""
    word = lambda: "".join(r.choice("aeioustrnlmdhg") for _ in range(r.randint(2, 8)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    code = lambda n, c="0123456789abcdef": "".join(r.choice(c) for _ in range(n))

    def checked(n: int, good: bool) -> str:
        d = "4" + num(n - 2)
        last = next(c for c in "0123456789" if luhn(d + c))
        return d + (last if good else str((int(last) + r.randint(1, 9)) % 10))

    sep = r.choice(["-", ".", " "])
    entity = {
        0: lambda: r.choice([f"{word()}.{num(2)}@{word()}.example.com", f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}[dot]org", f"{word()}(at){word()}.net"]),
        1: lambda: r.choice([".".join(str(r.randint(0, 255)) for _ in range(4)), ":".join(code(4) for _ in range(8))]),
        2: lambda: r.choice([checked(16, True), sep.join(re.findall("....", checked(16, True)))]),
        3: lambda: r.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", sep.join((num(3), num(3), num(4))), f"+{num(2)} {num(3)} {num(6)}"]),
        4: lambda: r.choice([code(40), code(32), code(r.randint(24, 44), "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789")]),
    }
    decoy = [
        lambda: num(r.randint(1, 9)), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}.{num(1)}.{num(3)}", lambda: f"${num(3)},{num(3)}.{num(2)}", lambda: f"{num(2)}:{num(2)}:{num(2)}",
        lambda: f"{word()}{num(6)}", lambda: f"{num(1)} {num(3)} {num(3)}", lambda: checked(16, False), lambda: "@" + word(), lambda: f"{num(4)}/{num(4)}", lambda: num(r.randint(10, 24)), lambda: f"{num(5)} {num(5)} {num(5)}",
    ]
    tokens: list[str] = []
    truth = []
    for _ in range(r.randint(1, 3)):
        tokens += [word() for _ in range(r.randint(0, 3))]
        if r.random() < 0.55:
            kind = r.randrange(5)
            if r.random() < 0.4 or kind == 4 and r.random() < 0.8:
                tokens += [r.choice(CUES[KINDS[kind]]) + r.choice(["", ":"])] + ["="] * (kind == 4 and r.random() < 0.7)
            own = entity[kind]().split(" ")
            truth.append((len(tokens), len(tokens) + len(own), kind))
            if kind == 4 and r.random() < 0.5:
                own = ['"' + own[0] + '"']
            own[-1] += r.choice(["", "", "", ".", ","])
            tokens += own
        else:
            tokens += r.choice(decoy)().split(" ")
    tokens += [word() for _ in range(r.randint(0, 3))]
    return " ".join(tokens), truth


#: What train_field() gives, to three places: one row a kind, feature:weight. A test trains again and compares.
TRAINED = (
    "0:-3.868 1:2.228 2:-1.736 3:-1.747 4:-1.704 5:0.303 6:-2.324 7:1.546 8:-0.111 9:-2.096 10:-0.743 11:-0.504 12:-1.147 13:-0.474 14:-0.941 15:-1.536 16:2.663 17:2.819 18:-1.636 19:-0.079 20:-0.218 21:-0.312 22:-0.027 23:-0.283 24:-0.261 25:-0.192 26:-0.045 27:-0.29 28:-0.017 29:-0.575 30:-0.151 31:1.65 32:-0.071 33:-0.054 34:-0.06 35:-0.158 36:-1.371 37:-0.667 38:2.956",
    "0:-3.521 1:1.934 2:-1.623 3:-1.618 4:-1.52 5:-1.31 6:-1.117 7:-0.999 8:-0.055 9:-2.292 10:0.513 11:0.076 12:-0.529 13:0.898 14:0.328 15:-0.943 16:-0.217 17:-0.017 18:-0.968 19:-0.221 20:-0.378 21:-0.646 22:-0.089 23:-0.54 24:-0.525 25:1.677 26:3.138 27:3.117 28:-0.044 29:-0.876 30:-0.089 31:-0.046 32:1.723 33:-0.1 34:-0.061 35:-0.24 36:-1.06 37:-0.218 38:-0.084",
    "0:-4.516 1:0.268 2:-1.219 3:-1.531 4:-0.357 5:-0.824 6:-0.653 7:-0.496 8:-0.015 9:-1.857 10:-0.867 11:-0.606 12:0.663 13:-0.271 14:-0.667 15:-0.457 16:-0.109 17:-0.013 18:0.679 19:-0.011 20:-0.027 21:1.536 22:2.222 23:-3.019 24:1.711 25:1.272 26:-0.105 27:-0.053 28:-0.014 29:-0.877 30:-0.059 31:-0.018 32:-0.077 33:1.075 34:-0.038 35:-0.043 36:-0.876 37:-0.122 38:-0.017",
    "0:-4.381 1:-1.027 2:-1.667 3:0.207 4:-1.454 5:-1.093 6:-0.69 7:-0.537 8:-0.012 9:-2.513 10:1.497 11:-1.026 12:-1.207 13:-0.42 14:-0.883 15:-0.525 16:-0.12 17:-0.012 18:2.244 19:-0.003 20:-0.013 21:-0.648 22:-0.116 23:-0.529 24:-0.752 25:3.033 26:-1.488 27:-0.009 28:3.217 29:-0.807 30:-0.131 31:0.108 32:-0.199 33:-0.197 34:1.621 35:-0.043 36:-1.199 37:-0.535 38:-0.005",
    "0:-3.452 1:1.62 2:-1.481 3:-1.419 4:-1.321 5:-1.092 6:-0.899 7:-0.977 8:0.699 9:-1.169 10:-0.41 11:-0.47 12:-1.069 13:0.027 14:-0.146 15:-0.923 16:-0.201 17:-0.019 18:-2.028 19:1.644 20:2.731 21:-0.244 22:-0.02 23:-0.216 24:-0.194 25:-0.222 26:-0.036 27:-0.408 28:-0.021 29:-0.886 30:-0.156 31:-0.045 32:-0.101 33:-0.058 34:-0.027 35:2.221 36:-1.176 37:-0.179 38:-0.07",
)


def field_weights() -> np.ndarray:
    w = np.zeros((len(KINDS), FEATURES))
    for kind, row in enumerate(TRAINED):
        for cell in row.split():
            feature, weight = cell.split(":")
            w[kind, int(feature)] = float(weight)
    return w


@lru_cache(2)
def train_field(lines: int = 500, rounds: int = 60, rate: float = 0.5, decay: float = 2e-3, seed: int = 7) -> np.ndarray:
    """Weights (kind, feature) that maximise the penalised likelihood of generated lines, by adaptive gradient ascent."""
    r = random.Random(seed)
    data = []
    for _ in range(lines):
        text, truth = training_line(r)
        data.append((Lattice(text, [m.span() for m in TOKEN.finditer(text)]), truth))
    w = np.zeros((len(KINDS), FEATURES))
    w[:, 0] = -2.0
    squares = np.full_like(w, 1e-6)
    for _ in range(rounds):
        g = np.zeros_like(w)
        for lattice, truth in data:
            lattice.gradient(w, truth, g)
        g = g / lines - decay * w
        squares += g * g
        w = w + rate * g / np.sqrt(squares)
    return w


def field_spans(text: str, w: np.ndarray) -> list[Span]:
    """Spans of the field: seeds are widened by AROUND tokens to regions, each decoded on its own."""
    if not SEED.search(text):
        return []
    out: list[Span] = []
    for region in _regions(text):
        lattice = Lattice(text, region)
        for i, end, kind in lattice.best(w):
            a, b = region[i][0], region[end - 1][1]
            while a < b and text[a] in PUNCT and text[a] != "(":
                a += 1
            while a < b and text[b - 1] in PUNCT and text[b - 1] != ")":
                b -= 1
            out.append((a, kind, b))
    return out


def _regions(text: str):
    """Runs of tokens around seeds, left to right; only the neighbourhood of a seed is split into tokens."""
    at, size, last = 0, len(text), -1
    region: list[tuple[int, int]] = []
    while True:
        m = SEED.search(text, at)
        if not m:
            break
        start = m.start()
        while start > max(at, 0) and not text[start - 1].isspace():
            start -= 1
        before: list[tuple[int, int]] = []
        pos = start
        for _ in range(AROUND):
            end = pos
            while end > last + 1 and end > 0 and text[end - 1].isspace():
                end -= 1
            begin = end
            while begin > last + 1 and begin > 0 and not text[begin - 1].isspace():
                begin -= 1
            if begin >= end or begin <= last:
                break
            before.append((begin, end))
            pos = begin
        if region and (pos > last + 1 and before and len(before) == AROUND and text[last + 1 : before[-1][0]].strip()):
            yield region
            region = []
        region += before[::-1]
        token = TOKEN.match(text, start)
        region.append(token.span())
        last = at = token.end()
        spare = 0
        while spare < AROUND:
            token = TOKEN.search(text, at)
            if not token:
                at = size
                break
            region.append(token.span())
            last = at = token.end()
            spare = 0 if SEED.search(text, *token.span()) else spare + 1
    if region:
        yield region


def all_spans(text: str, w: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Exact spans, and all spans: those and the field's that touch none of them; both by start, then kind."""
    base = base_spans(text)
    starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    added = []
    for s in field_spans(text, w):
        before = bisect_left(starts, s[2])  # exact spans that start before this one ends
        if not before or reach[before - 1] <= s[0]:
            added.append(s)
    return base, sorted(base + added)


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, done = [], 0
    for i, (a, k, b) in enumerate(spans):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _pii(batches, w: np.ndarray, with_text: bool):
    for batch in batches:
        for part, texts in rows(batch):
            base, every, clean = [], [], []
            for raw in texts:
                text = raw.decode()
                b, e = all_spans(text, w)
                base.append(b)
                every.append(e)
                if with_text:
                    clean.append(redacted(text, e) if e else text)
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(4)]
            arrays = [part.column(0), *counts, pa.array([_written(b) for b in base]), pa.array([_written(e) for e in every])]
            names = ["row", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(clean, pa.string())] * with_text, names + ["clean"] * with_text)


def find_pii(docs: DataFrame, names: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """row (a struct of the named columns of docs), counts of exact spans by kind, base, spans and clean.

    base has the exact spans as kind:start:end, joined by commas; spans has those and the
    field's. Offsets are code points, ends exclusive. clean is the text with all spans
    replaced. A null text counts as empty; repeated rows are rows of their own; other columns
    are kept in row and not looked at.
    """
    w = field_weights()
    row = F.struct(*[F.col(f"`{c}`") for c in names or docs.columns])
    given = docs.select(row.alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = given.schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    return in_arrow(given, lambda it: _pii(it, w, with_text), schema + ", clean string" * with_text)
