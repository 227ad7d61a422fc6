"""Secret scans: known shapes, and sliding-window entropy of candidate strings.

Every candidate string of the whole text is read by a window that moves one
character at a time. The window keeps counts of its characters and the sum of
``c log2 c`` over them, updated by the two counts that a step changes, so its
Shannon entropy costs a step no more than two table look-ups. Each character
class has its own threshold. Windows over the threshold that overlap or touch
make one span. Candidates of 16 to 19 characters and strings of letters only have
a shorter window; letters are random only if few of them are vowels. Base spans
and the allow-list cut candidates, and what they leave is scanned: the list names
identifiers in UUID form, dates, placeholders (by the part between ``= / _ -``),
and paths of words.

Defined results: null text counts as empty; a text without spans has zero
counts and empty strings. Rows are scanned one by one, so repeated rows get the
same result each, and null ids are kept. An empty table gives no rows, and
columns beyond id and text are not read. Very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.registry import query
from cellweave.llm.text import map_texts, table

KINDS = ("assign", "access", "hex", "entropy")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
#: A run ends where no character fits, so the least length in the pattern drops whole runs only.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIN_VALUE = 12


@dataclass(frozen=True)
class CharClass:
    """Strings of certain characters, and the entropy in bits from which a window of them is a secret."""

    name: str
    pattern: re.Pattern
    window: int
    bits: float


#: The first class that a candidate fits is its class. Strings of digits only are numbers: no class holds them.
CLASSES = (
    CharClass("hex", re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]+|(?=.*[0-9])(?=.*[A-F])[0-9A-F]+"), 20, 2.9),
    CharClass("alnum", re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+"), 20, 3.5),
    CharClass("base64", re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+"), 20, 3.7),
)
#: Classes of candidates shorter than the windows above.
SHORT_CLASSES = tuple(CharClass(c.name, c.pattern, 16, b) for c, b in zip(CLASSES, (2.7, 3.4, 3.6)))
#: Strings of letters only. A window of them has few vowels, or hardly more and many changes of case; words in
#: camel case have more vowels or fewer changes.
LETTERS = CharClass("letters", re.compile(r"[A-Za-z]{16,}"), 16, 3.4)
MOST_VOWELS = 3
CASE_CHANGES = 7
#: Parts of candidates that are not secrets. Placeholders are told by the part between separators that holds them.
PLACEHOLDER = r"example|sample|placeholder|changeme|dummy|redacted|x{6}|0{8}|1234567"
ALLOWED_PARTS = re.compile(
    r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])"
    r"|(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"
    r"|(?<![^=/_-])[^=/_-]++"
)
HELD = re.compile(f"(?i:{PLACEHOLDER})")
#: Nothing is given back once matched, so a part is read once.
WORDS = re.compile(r"(?:[A-Za-z]++[/_=-]++)*+[A-Za-z]*+[/_=-]*+[0-9]{0,4}+[/_=-]*+")


def window_entropies(s: str, window: int) -> list[float]:
    """Shannon entropy in bits of each window of a string, by incremental counts."""
    if len(s) < window:
        return []
    weigh = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts = Counter(s[:window])
    total = sum(weigh[c] for c in counts.values())
    base = math.log2(window)
    out = [base - total / window]
    for old, new in zip(s, s[window:]):
        if old != new:
            a, b = counts[old], counts[new]
            total += weigh[a - 1] - weigh[a] + weigh[b + 1] - weigh[b]
            counts[old], counts[new] = a - 1, b + 1
        out.append(base - total / window)
    return out


def _left(start: int, end: int, cuts) -> list[tuple[int, int]]:
    """What cuts, in order of start, leave of a range."""
    out = []
    for a, b in cuts:
        if a > start:
            out.append((start, min(a, end)))
        start = max(start, b)
    if start < end:
        out.append((start, end))
    return out


def _allowed(s: str) -> list[tuple[int, int]]:
    """The parts of a candidate that the allow-list names."""
    found = ((m.start(), m.end(), m[0]) for m in ALLOWED_PARTS.finditer(s))
    return [(a, b) for a, b, part in found if part[4:5] == "-" or part[8:9] == "-" or HELD.search(part)]


def _windows(s: str, kind: CharClass) -> list[tuple[int, int]]:
    return [(i, i + kind.window) for i, bits in enumerate(window_entropies(s, kind.window)) if bits >= kind.bits]


def _letters(s: str) -> list[tuple[int, int]]:
    """Windows of letters that look random."""
    out = []
    for m in LETTERS.pattern.finditer(s):
        vowels = [0, *accumulate(c in "aeiouAEIOU" for c in m[0])]
        changes = [0, *accumulate(c.isupper() != d.isupper() for c, d in zip(m[0], m[0][1:]))]
        for a, b in _windows(m[0], LETTERS):
            most = MOST_VOWELS + (changes[b - 1] - changes[a] >= CASE_CHANGES)
            if vowels[b] - vowels[a] <= most:
                out.append((m.start() + a, m.start() + b))
    return out


def random_parts(s: str) -> list[tuple[int, int]]:
    """The parts of a candidate whose windows are over the threshold of their class."""
    windows = []
    for start, end in _left(0, len(s), _allowed(s)):
        part = s[start:end]
        classes = CLASSES if len(part) >= CLASSES[0].window else SHORT_CLASSES
        kind = None if WORDS.fullmatch(part) else next((c for c in classes if c.pattern.fullmatch(part)), None)
        found = _windows(part, kind) if kind else []
        windows += [(start + a, start + b) for a, b in found + _letters(part)]
    parts: list[list[int]] = []
    for a, b in sorted(windows):
        if parts and a <= parts[-1][1]:
            parts[-1][1] = max(parts[-1][1], b)
        else:
            parts.append([a, b])
    return [(a, b) for a, b in parts]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the known shapes, by start, then kind."""
    spans = []
    lower = text.lower()
    if any(n in lower for n in NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def entropy_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans by entropy, outside those taken already."""
    out, at, busy = [], 0, sorted((s, e) for s, _, e in taken)
    for m in CANDIDATE.finditer(text):
        while at < len(busy) and busy[at][1] <= m.start():
            at += 1
        near = at
        while near < len(busy) and busy[near][0] < m.end():
            near += 1
        for start, end in _left(m.start(), m.end(), busy[at:near]):
            out += [(start + a, 3, start + b) for a, b in random_parts(text[start:end])]
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_text(text: str | None) -> dict:
    """All that a scan says of one text."""
    base = base_spans(text or "")
    more = entropy_spans(text or "", base)
    counts = Counter(k for _, k, _ in base)
    return {f"n_{name}": counts[i] for i, name in enumerate(KINDS[:3])} | {
        "base_sha256": hashlib.sha256(_written(base).encode()).hexdigest(),
        "spans": _written(sorted(base + more)),
        "n_entropy": len(more),
    }


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by counts and spans of secrets."""
    names = [x.split()[0] for x in SCHEMA.split(",")]
    kept = docs.drop(*[n for n in names if n != text])
    return map_texts(kept, lambda texts: map(scan_text, texts), SCHEMA, text)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by a mask; null stays null."""

    def clean(t: str | None) -> dict:
        if t is None:
            return {text: None}
        base = base_spans(t)
        out, at = [], 0
        for a, _, b in sorted(base + entropy_spans(t, base)):
            if a >= at:
                out += [t[at:a], mask]
            at = max(at, b)
        return {text: "".join([*out, t[at:]])}

    return map_texts(docs, lambda texts: map(clean, texts), f"{text} string", text).select(*docs.columns)


@query("op7_secret_scans")
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    return scan_secrets(docs)
