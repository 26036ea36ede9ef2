"""Personal data by a semi-Markov conditional random field.

Four kinds (email, ip, card, phone) have an exact base definition; the field adds spans
that it does not reach, such as numbers without a plus sign or addresses written with
"[at]". Around each place with a digit or an at-sign a text is cut into tokens; every run
of at most MAX_TOKENS tokens that could be of a kind is a candidate segment, described by
features of the whole span (checksum, octets, digit groups, marks, neighbours, cue words,
base form). Dynamic programming over bounded segments chooses boundaries and kinds
together. The weights are trained here by conditional likelihood (forward-backward over
segments) on generated examples, in about a second, once in the driver.

The dynamic programme runs over a window of tokens: as no segment is longer than MAX_TOKENS, it keeps the best scores of
so many places, and of each only the chain of segments chosen so far. Time is in proportion to a text's length and memory
to the text and its spans, also for a table of numbers of any length.

Texts are scanned where they lie, without a shuffle. Base spans always stay; a span of
the field counts as added where it overlaps no base span.

Results for unusual input: null and empty texts have no spans; rows that are there twice
give two rows; an empty table gives an empty result; other columns are ignored. One word of a million digits is a text
like any other.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
#: Longest candidate segment; base spans may be longer.
MAX_TOKENS = 24

# A run is taken as a whole, with or without what makes it a match, so no start is tried twice. Possessive, as nothing
# follows a repetition: the matcher keeps no place to go back to.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++)?")
_IP = re.compile(r"[0-9]+((?:\.[0-9]+){3})?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]|[\[(]at[\])]")
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[\[(]at[\])]|.", re.S)
_CUES = {
    "email": {"email", "e-mail", "mail", "contact", "write"},
    "ip": {"ip", "host", "server", "addr", "address", "from"},
    "card": {"card", "visa", "mastercard", "amex", "cc", "credit", "pay"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "cell", "telephone"},
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The exact base definition: leftmost non-overlapping matches of each kind that pass its check."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text) if m[1]]
    for m in _IP.finditer(text):
        if m[1] and all(map(_octet, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 38:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring words with a digit or an at-sign; a lone "[at]" takes its neighbours in."""
    last = before = None
    take_next = False
    for m in _WORD.finditer(text):
        s, e = m.span()
        anchor = _ANCHOR.search(text, s, e)
        lone = anchor is not None and text[s:e] in ("[at]", "(at)")
        if anchor is not None or take_next:
            if lone and before:
                s = before[0]
            if last and s <= last[1] + 1:
                last = (last[0], e)
            else:
                if last:
                    yield last
                last = (s, e)
            take_next = lone
        before = m.span()
    if last:
        yield last


_DIGITS = frozenset("0123456789")
_MARKS = frozenset(("@", "[at]", "(at)"))
_IN_NUMBERS = frozenset(" ().-+")
_IN_CARDS = frozenset(" -.")


class Window:
    """Tokens of an island and what is known about each: enough to list the segments that start there.

    number: digits of a token (0: no number); upto: digits before a token; stop: the first place at or behind a token
    where neither a card nor a phone number goes on; mark: the first at-sign at or behind a token.
    """

    def __init__(self, tokens: list[str]):
        self.tokens, self.n = tokens, len(tokens)
        self.number = [len(t) if t[0] in _DIGITS else 0 for t in tokens]
        self.upto = [0, *accumulate(self.number)]
        self.stop, self.mark = [self.n] * (self.n + 1), [self.n] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            t = tokens[i]
            self.stop[i] = self.stop[i + 1] if self.number[i] or t in _IN_NUMBERS else i
            self.mark[i] = i if t in _MARKS else self.mark[i + 1]

    def segments(self, i: int) -> list[tuple[int, int]]:
        """(end, place of its kind in KINDS) of the candidate segments from token i, by end and kind."""
        tokens, number = self.tokens, self.number
        first, limit = tokens[i], min(self.n, i + MAX_TOKENS)
        out = []
        if self.mark[i] < limit and (number[i] or (first.isascii() and first.isalpha())):
            marks = 0
            for j in range(i, limit):
                t = tokens[j]
                marks += t in _MARKS
                if marks > 1 or not t.isascii():
                    break
                if not (t.isalnum() or t in "._%+-@" or t[1:3] == "at" or (t == " " and "at" in "".join(tokens[max(0, j - 1) : j + 2]))):
                    break
                if marks and (number[j] or t[0].isalpha()):
                    out.append((j + 1, 0))
        if number[i] and i + 6 < limit and tokens[i + 1] == tokens[i + 3] == tokens[i + 5] == "." and number[i + 2] and number[i + 4] and number[i + 6]:
            out.append((i + 7, 1))
        if number[i] or first in ("+", "("):
            # Only where the digits before the run's end are enough.
            stop = min(limit, self.stop[i])
            if self.upto[stop] - self.upto[i] >= 9:
                card, phone, count = bool(number[i]), True, 0
                for j in range(i, stop):
                    if number[j]:
                        count += number[j]
                        card = card and count <= 19
                        phone = phone and count <= 15
                        if not (card or phone):
                            break
                        if card and count >= 12:
                            out.append((j + 1, 2))
                        if phone and count >= 9:
                            out.append((j + 1, 3))
                    else:
                        t = tokens[j]
                        card = card and t in _IN_CARDS
                        phone = phone and (t != "+" or j == i)
                        if not (card or phone):
                            break
        if len(out) > 1:
            out.sort()
        return out


def _cue(text: str, start: int) -> set[str]:
    """The two words before an island."""
    return {w.strip(":;,.#").lower() for w in text[max(0, start - 30) : start].split()[-2:]}


class Lattice:
    """The candidate segments of a short island, for training: (first token, end token, kind, features)."""

    def __init__(self, text: str, start: int, end: int, base: set[tuple[int, int, str]]):
        self.at = [m.start() for m in _TOKEN.finditer(text, start, end)]
        self.at.append(end)
        window = Window([text[a:b] for a, b in zip(self.at, self.at[1:], strict=False)])
        self.n, cue = window.n, _cue(text, start)
        self.segments: list[tuple[int, int, str, list[str]]] = []
        for i in range(self.n):
            for j, k in window.segments(i):
                a, b = self.at[i], self.at[j]
                self.segments.append((i, j, KINDS[k], _features(text, a, b, KINDS[k], (a, b, KINDS[k]) in base, bool(cue & _CUES[KINDS[k]]))))


def _features(text: str, a: int, b: int, kind: str, is_base: bool, cued: bool) -> list[str]:
    """What describes the whole span: its characters, one before and two behind it, and two facts."""
    span = text[a:b]
    left, right = text[a - 1 : a] if a else "", text[b : b + 1]
    out = ["bias"]
    if is_base:
        out.append("base")
    if left.isalnum() or (left and left in "@._%+-"):
        out.append("cut_left")
    if right.isalnum() or (right in "@-%_" and right != "") or (right == "." and text[b + 1 : b + 2].isalnum()):
        out.append("cut_right")
    if cued:
        out.append("cue")
    groups = re.findall("[0-9]+", span)
    sizes = [len(g) for g in groups]
    if kind == "email":
        local, _, domain = span.partition("@") if "@" in span else re.split(r"( ?[\[(]at[\])] ?)", span, maxsplit=1)
        out.append("marked" if "@" in span else "spelled")
        if not local or local[0] in ".-%+" or " " in local:
            out.append("bad_local")
        out.append("dotted" if "." in domain.strip(".") else "undotted")
        out.append("tld" if re.search(r"\.[A-Za-z]{2,}\Z", domain) else "no_tld")
        if not re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*", domain):
            out.append("bad_domain")
    elif kind == "ip":
        out.append("octets" if all(map(_octet, groups)) else "big_octet")
        if any(len(g) > 1 and g[0] == "0" for g in groups):
            out.append("leading_zero")
    elif kind == "card":
        digits = "".join(groups)
        out.append("luhn" if luhn(digits) else "no_luhn")
        out.append("len16" if len(digits) == 16 else "len15" if len(digits) == 15 else "len_other")
        if len(set(digits)) < 3:
            out.append("flat")
        out.append("whole" if len(groups) == 1 else "fours" if set(sizes[:-1]) == {4} else "ragged")
        if len({c for c in span if c in " -."}) > 1:
            out.append("mixed")
        if "." in span:
            out.append("dots")
    else:
        out.append("plus" if span[0] == "+" else "no_plus")
        if re.search(r"\([0-9]{2,5}\)", span):
            out.append("area")
        if span.count("(") != span.count(")"):
            out.append("unbalanced")
        out.append("whole" if len(groups) == 1 else "local" if sizes[-2:] == [3, 4] else "grouped" if min(sizes[1:]) >= 2 else "ragged")
        out.append("ten" if sum(sizes) in (10, 11) else "other_len")
        if "." in span:
            out.append("dots")
    return out


Weights = dict[tuple[str, str], float]


def _scored(lattice: Lattice, w: Weights) -> list[tuple[int, int, str, float, list[str]]]:
    return [(i, j, k, sum(w.get((k, f), 0.0) for f in fs), fs) for i, j, k, fs in lattice.segments]


class Scorer:
    """Scores of segments; those of recent spans are remembered, up to a bound."""

    MOST = 20_000

    def __init__(self, w: Weights):
        self.by_kind = {k: {f: v for (kind, f), v in w.items() if kind == k} for k in KINDS}
        self.known: dict[tuple, float] = {}

    def __call__(self, text: str, a: int, b: int, kind: str, is_base: bool, cued: bool) -> float:
        key = (kind, cued, text[a - 1 : a] if a else "", text[a:b], text[b : b + 2])
        score = self.known.get(key)
        w = self.by_kind[kind]
        if score is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            score = self.known[key] = sum(w.get(f, 0.0) for f in _features(text, a, b, kind, False, cued))
        return score + w.get("base", 0.0) if is_base else score


#: Tokens that are taken into a window at a time.
STEP = 4096


def decode(text: str, start: int, end: int, base: set[tuple[int, int, str]], scorer: Scorer) -> list[tuple[int, int, str]]:
    """The best segmentation of an island. For each place that segments may still end at, the best score and the chain
    (segment, chain before) that reaches it."""
    cue = _cue(text, start)
    cued = [bool(cue & _CUES[k]) for k in KINDS]
    places = map(lambda m: m.start(), _TOKEN.finditer(text, start, end))
    at: list[int] = []
    best, chain, open_ = 0.0, None, {}  # open_: by place, the best segment that ends there
    more = True
    while more:
        new = list(islice(places, STEP))
        more = len(new) == STEP
        at += new
        bounds = at if more else [*at, end]
        window = Window([text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
        # Segments and the marks beside them look ahead; without more tokens to come all are there.
        ready = window.n if not more else max(0, window.n - MAX_TOKENS - 1)
        for i in range(ready):
            a = bounds[i]
            if (found := open_.pop(a, None)) is not None and found[0] > best:
                best, chain = found
            for j, k in window.segments(i):
                b = bounds[j]
                score = scorer(text, a, b, KINDS[k], (a, b, KINDS[k]) in base, cued[k])
                if score > 0 and (b not in open_ or best + score > open_[b][0]):
                    open_[b] = (best + score, ((a, b, KINDS[k]), chain))
        at = at[ready:]
    if (found := open_.pop(end, None)) is not None and found[0] > best:
        best, chain = found
    out = []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def _expected(lattice: Lattice, w: Weights, gold: set) -> dict[tuple[str, str], float]:
    """Gradient of the log-likelihood of the gold segments."""
    scored = _scored(lattice, w)
    starting, ending = {}, {}
    for s in scored:
        starting.setdefault(s[0], []).append(s)
        ending.setdefault(s[1], []).append(s)
    n = lattice.n

    def logsum(values):
        m = max(values)
        return m + math.log(sum(math.exp(v - m) for v in values))

    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = logsum([ahead[j - 1], *(ahead[s[0]] + s[3] for s in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        behind[i] = logsum([behind[i + 1], *(behind[s[1]] + s[3] for s in starting.get(i, ()))])
    grad: dict[tuple[str, str], float] = {}
    for i, j, kind, score, fs in scored:
        p = math.exp(ahead[i] + score + behind[j] - ahead[n])
        p = ((lattice.at[i], lattice.at[j], kind) in gold) - p
        for f in fs:
            grad[kind, f] = grad.get((kind, f), 0.0) + p
    return grad


def examples(n: int, seed: int = 7) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Generated texts and their gold spans: base forms, other written forms, and numbers that are neither."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8)))

    def card(valid: bool, groups: str) -> str:
        while True:
            d = r.choice("3456") + num(15)
            if luhn(d) is valid:
                return groups.join([d[:4], d[4:8], d[8:12], d[12:]])

    def one() -> tuple[str, str | None]:
        area = f"{r.randint(200, 999)}"
        return r.choice(
            [
                lambda: (f"{word()}.{word()}{num(r.randint(0, 2))}@{word()}{num(r.randint(0, 1))}.{r.choice(['example.com', 'net', 'org', 'de'])}", "email"),
                lambda: (f"{word()}{r.choice([' [at] ', '[at]', ' (at) ', '(at)'])}{word()}.{r.choice(['com', 'org', 'fr'])}", "email"),
                lambda: (".".join(str(r.randint(0, 255)) for _ in range(4)), "ip"),
                lambda: (card(True, r.choice(["", "", " ", "-"])), "card"),
                lambda: (card(True, "."), "card"),
                lambda: (f"+{r.randint(1, 99)} ({area}) {num(3)}-{num(4)}", "phone"),
                lambda: (f"+{r.randint(1, 99)}{r.choice([' ', '-', ''])}{area}{r.choice([' ', '-'])}{num(3)} {num(4)}", "phone"),
                lambda: (f"({area}) {num(3)}-{num(4)}", "phone"),
                lambda: (f"{area}-{num(3)}-{num(4)}", "phone"),
                lambda: (card(False, r.choice(["", " ", "-"])), None),
                lambda: (f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(256, 9999)}.{r.randint(300, 999)}", None),
                lambda: (f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", None),
                lambda: (f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)}", None),
                lambda: (f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)} 1{num(1)}:{num(2)}:{num(2)}", None),
                lambda: (num(r.randint(1, 14)), None),
                lambda: (num(r.randint(20, 40)), None),
                lambda: (" ".join(num(r.randint(1, 3)) for _ in range(r.randint(3, 9))), None),
                lambda: (f"@{word()}", None),
                lambda: (f"{num(2)}:{num(2)}", None),
                lambda: (f"{num(3)},{num(3)}.{num(2)}", None),
                lambda: (f"{word()}{num(3)}", None),
                lambda: (f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", None),
                lambda: ("-".join("".join(r.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)), None),
                lambda: ("".join(r.choice("0123456789abcdef") for _ in range(40)), None),
            ]
        )()

    out = []
    for _ in range(n):
        text, gold = word(), set()
        for _ in range(r.randint(1, 2)):
            item, kind = one()
            if r.random() < 0.15:
                text += " " + r.choice(sorted(_CUES[kind or "phone"]))
            text += r.choice([" ", " ", ": ", ".\n"])
            if kind:
                gold.add((len(text), len(text) + len(item), kind))
            text += item + r.choice([" ", ". ", ", ", "\n"]) + word()
        out.append((text, gold))
    return out


@lru_cache(1)
def train(n: int = 500, rounds: int = 40) -> Weights:
    """Weights by gradient steps (each scaled by its own past gradients) on generated examples."""
    lattices = []
    for text, gold in examples(n):
        base = set(base_spans(text))
        for s, e in islands(text):
            lattices.append((Lattice(text, s, e, base), gold))
    w: Weights = {}
    squares: Weights = {}
    for _ in range(rounds):
        total: dict[tuple[str, str], float] = {}
        for lattice, gold in lattices:
            for k, v in _expected(lattice, w, gold).items():
                total[k] = total.get(k, 0.0) + v
        for k, v in total.items():
            v -= 0.05 * w.get(k, 0.0)
            squares[k] = squares.get(k, 0.0) + v * v
            w[k] = w.get(k, 0.0) + 0.8 * v / (math.sqrt(squares[k]) + 1e-9)
    return w


def find_pii(text: str, w: Weights | Scorer) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, whether it is a base span) by start and then by kind as listed."""
    if not _ANCHOR.search(text):
        return []
    scorer = w if isinstance(w, Scorer) else Scorer(w)
    base = base_spans(text)
    known = set(base)
    chosen = [x for s, e in islands(text) for x in decode(text, s, e, known, scorer)]
    at, n, added = 0, len(base), []
    reach = [0] * (n + 1)  # the furthest end of the first base spans
    for i, (_, e, _) in enumerate(base):
        reach[i + 1] = max(reach[i], e)
    for s, e, kind in chosen:
        while at < n and base[at][0] < e:
            at += 1
        if reach[at] <= s:
            added.append((s, e, kind, False))
    return sorted([*((s, e, k, True) for s, e, k in base), *added], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, weights: Weights | None = None) -> DataFrame:
    """One row per row of docs: id_col, carried columns, spans (code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights or train())  # some 50 numbers

    def rows(texts):
        scorer = Scorer(shared.value)
        for i, data in enumerate(texts):
            found = find_pii(data.decode("utf-8", "replace"), scorer) if data else []
            yield i, [{"kind": k, "start": s, "end": e, "base": b} for s, e, k, b in found]

    return map_texts(docs, id_col, text_col, [("spans", SPANS)], rows, carry)
