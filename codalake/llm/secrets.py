"""Secret scanning with one combined automaton for all rules.

Three base kinds keep their exact definition (assign, access, hex); further rules for
well-known token formats add spans. Each text is read once, byte by byte, by the combined
automaton; what it finds is checked exactly (lengths) before it counts. Texts are scanned
where they lie, without a shuffle.

Results for unusual input: null and empty texts have no spans; rows that are there twice
give two rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .automaton import CombinedScanner
from .common import map_texts

# Rule name, pattern, letters in either case, least length.
# assign is matched as a whole and then judged by its value; the others by their length.
# hex asks the automaton for 6 characters only (a longest match is the same run), which keeps it small.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", True, 0),
    ("access", r"AKIA[A-Z0-9]+", False, 20),
    ("hex", r"[0-9a-f]{6,}", False, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40),
    ("slack", r"xox[abeprs]-[A-Za-z0-9\-]+", False, 24),
    ("google", r"AIza[A-Za-z0-9_\-]+", False, 39),
    ("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", False, 40),
    ("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", False, 0),
]
KINDS = [r[0] for r in RULES]
BASE = 3
_VALUE = re.compile(rb"[A-Za-z0-9+/_.=-]+\Z")
_KEY = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", re.I)
_SCANNER: list[CombinedScanner] = []


def scanner() -> CombinedScanner:
    """The compiled rules, made once."""
    if not _SCANNER:
        _SCANNER.append(CombinedScanner([(p, fold) for _, p, fold, _ in RULES]))
    return _SCANNER[0]


def holds(rule: int, match: bytes) -> bool:
    """The exact check of a match."""
    if KINDS[rule] == "assign":
        return len(match) - _KEY.match(match).end() >= 6
    return len(match) >= RULES[rule][3]


def find_secrets(data: bytes | None, search: CombinedScanner | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by kind as listed."""
    if not data:
        return []
    found = sorted((s, r, e) for s, e, r in (search or scanner()).scan(data) if holds(r, data[s:e]))
    ascii_only = not found or data.isascii()
    out, at, chars = [], 0, 0
    for s, r, e in found:
        if ascii_only:
            out.append((s, e, KINDS[r]))
            continue
        chars += len(data[at:s].decode("utf-8", "replace"))
        at = s
        out.append((chars, chars + e - s, KINDS[r]))  # matches are ASCII
    return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def as_structs(spans: list[tuple[int, int, str]]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for s, e, k in spans]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id_col, carried columns, spans."""

    shared = docs.sparkSession.sparkContext.broadcast(scanner())  # of a fixed size, some 10 MB

    def rows(texts):
        search = shared.value
        for i, data in enumerate(texts):
            yield i, as_structs(find_secrets(data, search))

    return map_texts(docs, id_col, text_col, [("spans", SPANS)], rows, carry)
