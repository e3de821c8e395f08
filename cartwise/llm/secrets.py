"""Secrets in texts: fixed patterns, and strings whose characters look random.

Candidate strings are maximal runs of the characters of tokens and keys. In each, for every
character class, a window of fixed length slides over the runs of that class, and the Shannon
entropy of the characters in it is kept up to date by the counts of the one character that
enters and the one that leaves. Windows at or above the entropy of their class are merged to
spans. A span is added if its characters are mixed as in a key, if no rule of the allow list
knows it for something else, and if it meets no span of the patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import slices, text_of

KINDS = ("assign", "access", "hex", "entropy")

#: The patterns of the first three kinds. A run of at least so many characters is
#: the same as a run that is then long enough, except for ``assign``, whose short matches use
#: up their text.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)


@dataclass(frozen=True)
class CharacterClass:
    """Characters of one kind of key, and from which entropy (bits per character) a window of them counts."""

    name: str
    run: str
    window: int
    bits: float


#: Random keys lie above these values, words and numbers below (window of 20: at most 4.32 bits).
CLASSES = (
    CharacterClass("hexadecimal", r"[0-9a-fA-F]+", 20, 2.9),
    CharacterClass("one case", r"[0-9a-z]+|[0-9A-Z]+", 20, 3.4),
    CharacterClass("two cases", r"[0-9A-Za-z]+", 20, 3.6),
    CharacterClass("base 64", r"[0-9A-Za-z+/_=-]+", 24, 3.9),
)
CANDIDATE = r"[0-9A-Za-z+/_=-]{20,}"

#: Strings that look random and are none: matched against a whole candidate or span.
ALLOWED = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",  # UUID
    r"sha(?:1|224|256|384|512)[-=:].*",  # named digest
    r"(?i:.*(?:example|sample|changeme|placeholder|dummy|redacted|your[-_]).*)",
    r"(?:[A-Za-z]+|[0-9]+)(?:[-_/+=]+(?:[A-Za-z]+|[0-9]+))*[-_/+=]*",  # words and numbers: names, paths, dates
)


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, sorted; leftmost and without overlap for each kind."""
    found = []
    if _WORD.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def entropies(run: str, window: int) -> Iterator[float]:
    """Shannon entropy, in bits per character, of every window of ``run``, from the left.

    ``H = log2(w) - sum(n * log2(n)) / w`` over the counts ``n``; a step changes two counts.
    """
    term = [0.0] + [n * log2(n) for n in range(1, window + 1)]
    count: dict[str, int] = {}
    total = 0.0
    for at, entering in enumerate(run):
        if at >= window:
            leaving = run[at - window]
            n = count[leaving]
            total += term[n - 1] - term[n]
            count[leaving] = n - 1
        n = count.get(entering, 0)
        total += term[n + 1] - term[n]
        count[entering] = n + 1
        if at >= window - 1:
            yield log2(window) - total / window


def _mixed(text: str) -> bool:
    """Digits and letters, at least three and two of them, and no long stretch of letters or
    digits in sequence (``abcdefgh``, ``12345678``)."""
    digits, letters = sum(c.isdigit() for c in text), sum(c.isalpha() for c in text)
    steps = sum(ord(b) - ord(a) in (0, 1) for a, b in zip(text, text[1:]))
    return digits >= 3 and letters >= 2 and 2 * steps < len(text)


class Scanner:
    """Finds spans by entropy; ``allowed`` are patterns of harmless strings."""

    def __init__(self, classes: Iterable[CharacterClass] = CLASSES, allowed: Iterable[str] = ALLOWED):
        self.classes = [(c, re.compile(c.run)) for c in classes]
        self.candidate = re.compile(CANDIDATE)
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed) or r"(?!)")

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the spans, sorted, without overlap."""
        found: list[tuple[int, int]] = []
        for m in self.candidate.finditer(text):
            if not self.allowed.fullmatch(m.group()) and not self._named(text, m.start()):
                found += self._windows(m.group(), m.start())
        return found

    def _named(self, text: str, start: int) -> bool:
        """A digest whose name stands in front, as in ``sha256:``."""
        return bool(re.search(r"(?i)\b(?:sha-?(?:1|224|256|384|512)|md5)[:=]$", text[max(0, start - 8) : start]))

    def _windows(self, candidate: str, offset: int) -> list[tuple[int, int]]:
        stretches: list[tuple[int, int]] = []
        for kind, pattern in self.classes:
            for run in pattern.finditer(candidate):
                if run.end() - run.start() < kind.window:
                    continue
                own: list[tuple[int, int]] = []
                for at, bits in enumerate(entropies(run.group(), kind.window), run.start()):
                    if bits >= kind.bits:
                        if own and at <= own[-1][1]:
                            own[-1] = own[-1][0], at + kind.window
                        else:
                            own.append((at, at + kind.window))
                if own:  # a rest that is shorter than a window cannot be judged by itself
                    if own[0][0] - run.start() < kind.window:
                        own[0] = run.start(), own[0][1]
                    if run.end() - own[-1][1] < kind.window:
                        own[-1] = own[-1][0], run.end()
                stretches += own
        merged: list[tuple[int, int]] = []
        for start, end in sorted(stretches):
            if merged and start <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(end, merged[-1][1])
            else:
                merged.append((start, end))
        kept = [(s, e) for s, e in merged if _mixed(candidate[s:e]) and not self.allowed.fullmatch(candidate[s:e])]
        return [(s + offset, e + offset) for s, e in kept]


def secret_spans(text: str, scanner: Scanner) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all spans, sorted. Patterns' spans are base and always stay."""
    base = pattern_spans(text)
    added, at = [], 0
    ends = sorted((s, e) for s, _, e in base)
    for start, end in scanner(text):
        while at < len(ends) and ends[at][1] <= start:
            at += 1
        if not any(s < end and e > start for s, e in _near(ends, at, end)):
            added.append((start, 3, end, False))
    return sorted([(s, k, e, True) for s, k, e in base] + added)


def _near(spans: list[tuple[int, int]], at: int, end: int) -> Iterator[tuple[int, int]]:
    while at < len(spans) and spans[at][0] < end:
        yield spans[at]
        at += 1


def _joined(spans: Iterable[tuple[int, int, int, bool]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def secret_report(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added`` for every row of ``docs``.

    Whole texts are read, places are code points. ``spans`` joins ``kind:start:end`` by start, then
    kind; ``base_sha256`` is the digest of that for the patterns' spans alone. A null or empty
    text has none; repeated rows give repeated rows; other columns are not read.
    """
    scan = scanner or Scanner()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                spans = secret_spans(text.as_py(), scan)
                base = [s for s in spans if s[3]]
                counts = [sum(k == kind for _, k, _, _ in base) for kind in range(3)]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                out.append((doc_id.as_py(), *counts, digest, _joined(spans), len(spans) - len(base)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        report, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"
    )


def redacted(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``docs`` with every span of a secret replaced by its kind, as in ``<HEX>``; spans that overlap go
    together under the kind of the first. All rows and columns stay; null texts stay null."""
    scan, at = scanner or Scanner(), docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else _cut(t, secret_spans(t, scan)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)


def _cut(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    out, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]
