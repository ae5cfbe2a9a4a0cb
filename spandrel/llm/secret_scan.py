"""Secret scans: fixed patterns, and the entropy of sliding windows over candidate strings.

Defined results: a null text is an empty one; offsets are code points, ends exclusive; overlapping spans of different fixed
kinds all stay; an entropy span that lies within a fixed one is dropped, one that reaches beyond it stays; equal spans sort by kind as in KINDS; redaction replaces the
union of all spans; very long texts are searched whole; repeated rows, of equal doc_id too, are rows of their own; scan() reads no other columns, whatever their names, and redacted()
keeps them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spandrel.llm.lineage import small_batches

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Strings that look random but are no secrets, as a whole: numbers, plain words, UUIDs, paths of words, and what consists of placeholders alone.
ALLOWED = re.compile(
    r"[0-9_=-]+|[A-Za-z]+|(?:[A-Za-z]+[/_+=-])+[A-Za-z]*|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|(?>EXAMPLE|example|KEY|key|X{3,}+|x{3,}+|0{3,}+|0?123456(?:7(?:8(?:90?)?)?)?|abcd[a-z]*+|ABCD[A-Z]*+|[/_+=-])++"
)
WINDOW = 20
#: Bits a character that a window of WINDOW must reach, by the class of its characters.
THRESHOLDS = {"hex": 3.0, "alphanumeric": 3.6, "base64": 3.7}
REDACTED = "[REDACTED]"
_N_LOG_N = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 2))]


#: Marks of a character, one bit each, whose numbers in a window give its class.
DIGIT, UPPER, LOWER, NOT_LOWER_HEX, NOT_UPPER_HEX, MARK = range(6)
MARKS = {
    c: [k for k, has in enumerate((c.isdigit(), c.isupper(), c.islower(), c not in "0123456789abcdef", c not in "0123456789ABCDEF", not c.isalnum())) if has]
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
}


def character_class(window: str) -> str | None:
    """Class of a window; None if it lacks the mixture of characters that generated keys have."""
    return class_of([sum(k in MARKS[c] for c in window) for k in range(6)])


def class_of(marks: list[int]) -> str | None:
    """The same from the numbers of the characters' marks."""
    cases = (marks[UPPER] > 0) + (marks[LOWER] > 0)
    if not marks[DIGIT] or not cases:
        return None
    if not marks[NOT_LOWER_HEX] or not marks[NOT_UPPER_HEX]:
        return "hex"
    if cases < 2 and marks[DIGIT] < 3:
        return None
    return "base64" if marks[MARK] else "alphanumeric"


def is_random(candidate: str, window: int = WINDOW) -> bool:
    """Whether some window reaches its class's threshold. All counts are updated by the character that enters and the one that leaves."""
    counts: dict[str, int] = {}
    marks = [0] * 6
    total = 0.0  # of n * log2(n) over the window's characters
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _N_LOG_N[n + 1] - _N_LOG_N[n]
        for k in MARKS[c]:
            marks[k] += 1
        if i >= window:
            gone = candidate[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += _N_LOG_N[n - 1] - _N_LOG_N[n]
            for k in MARKS[gone]:
                marks[k] -= 1
        if i >= window - 1:
            bits = math.log2(window) - total / window + 1e-9  # sums of steps may end just below
            if bits >= min(THRESHOLDS.values()) and (kind := class_of(marks)) and bits >= THRESHOLDS[kind]:
                return True
    return False


def find_secrets(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Spans (start, kind, end) of the fixed patterns, and those that entropy adds."""
    base = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    base += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    base.sort(key=order)
    more, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        # Both stand in order: of the fixed spans that begin by here, the furthest end tells whether one holds the candidate.
        while k < len(base) and base[k][0] <= m.start():
            reach, k = max(reach, base[k][2]), k + 1
        if reach < m.end() and not ALLOWED.fullmatch(m[0]) and is_random(m[0]):
            more.append((m.start(), "entropy", m.end()))
    return base, more


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """``text`` with each maximal run of spans replaced."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document; a map without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, more = find_secrets(text or "")
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns with secrets replaced in text, and n_chars, where it exists, counted anew for the changed ones."""
    at, sizes = docs.columns.index("text"), [i for i, c in enumerate(docs.columns) if c == "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts, changed = columns[at].to_pylist(), {}
            for i, text in enumerate(texts):
                if text and (spans := [s for found in find_secrets(text) for s in found]):
                    texts[i] = redact(text, spans)
                    changed[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            for k in sizes:
                columns[k] = pa.array([changed.get(i, n) for i, n in enumerate(columns[k].to_pylist())], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
