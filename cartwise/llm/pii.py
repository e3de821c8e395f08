"""Personal data: fixed patterns, and a character-level tagger for what they miss.

The tagger is a bidirectional LSTM with CRF transitions, trained on the driver from a bounded
sample of labelled windows. Its spans are those of the patterns, as they stand and written in
other ways, which the patterns miss (``altered``: without ``+``, dotted or spaced groups,
bracketed dots, ``[at]``), among decoys of digits that are no personal data. A text is covered
by overlapping windows; their scores are added up, weighted towards the middle of each window,
and each stretch of windows is decoded as one sequence, so no span is cut at a window's edge.
Every form has a digit, an ``@`` or a bracketed ``at`` or dot, so windows without any need no
scores: they cannot hold a span. A tagged span is added if it has the outward form of its kind
(number of digits, check digit, parts) and meets no span of the patterns.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm import bilstm
from cartwise.llm.common import slices, text_batches, text_of

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
MAX_WINDOWS = 6000  # training windows
VARIANTS = 3  # altered copies of a text with spans
LONG, SHARED, GROUP = 512, 16, 4096  # windows: of a stretch, of two that meet, scored at once
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
SPANS = "array<struct<kind:int,start:int,end:int,base:boolean>>"

#: The patterns of the four kinds. Possessive runs and the look-behind only save time.
_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A bracketed ``at`` or dot.
_AT, _DOT = r"[\[(]\x20?at\x20?[\])]", r"[\[(]\x20?(?:dot|\.)\x20?[\])]"
_MARK = re.compile(f"{_AT}|{_DOT}", re.IGNORECASE)
_HINT = re.compile(f"[0-9@]|{_AT}|{_DOT}", re.IGNORECASE)
#: The outward forms of tagged spans.
_FORMS = [
    re.compile(rf"[A-Za-z0-9._%+-]+\x20?(?:@|{_AT})\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|{_DOT})\x20?[A-Za-z0-9-]+)+", re.IGNORECASE),
    re.compile(rf"[0-9]{{1,3}}(?:\x20?(?:\.|{_DOT})\x20?[0-9]{{1,3}}){{3}}", re.IGNORECASE),
    re.compile(r"[0-9](?:[\x20./-]{0,3}[0-9])+"),
    re.compile(r"[+(]?[0-9](?:[\x20().-]{0,3}[0-9])+"),
]
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-.\x20](?:0[1-9]|1[0-2])[-.\x20][0-3][0-9]")

_CLASSES = 24
_NAMED = {c: 10 + k for k, c in enumerate("@.-+() \n_=:/[")}
_MARKED = 23  # the characters of a bracketed ``at`` or dot


def _class_of(code: int) -> int:
    c = chr(code)
    if c in _NAMED:
        return _NAMED[c]
    return 1 if c.isdigit() else 2 if c.islower() else 3 if c.isupper() else 4 if c.isspace() else 5


_ASCII = np.array([_class_of(k) for k in range(128)] + [6], np.int64)  # 6: beyond ASCII; 0: beyond the text


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, sorted; leftmost and without overlap for each
    kind, matches that fail their check dropped."""
    found = []
    if "@" in text:
        last = 0
        for tail in _TAIL.finditer(text):
            start = at = tail.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, 0, tail.end()))
                last = tail.end()
    if _HINT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = _ASCII[np.minimum(codes, 128)]
    for mark in _MARK.finditer(text):
        classes[mark.start() : mark.end()] = _MARKED
    return classes


def _windows(classes: np.ndarray) -> np.ndarray:
    """Overlapping windows of the whole text, padded by 0; row k starts at (k - 1) * STRIDE."""
    count = -(-len(classes) // STRIDE) + 1
    padded = np.zeros((count + 1) * STRIDE, np.int64)
    padded[STRIDE : STRIDE + len(classes)] = classes
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _active(windows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(((windows == 1) | (windows == _NAMED["@"]) | (windows == _MARKED)).any(1))


def _plausible(kind: int, text: str, start: int, end: int) -> bool:
    """Has the span the outward form of its kind, and is it no part of a longer word or number?"""
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return False
    span = text[start:end]
    if not _FORMS[kind].fullmatch(span):
        return False
    numbers = re.findall("[0-9]+", span)
    digits = "".join(numbers)
    if kind == 1:
        return all(int(n) <= 255 for n in numbers)
    if kind == 2:
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return kind == 0 or (9 <= len(digits) <= 15 and len(numbers) > 1 and not _DATE.match(span))


#: Weight of a window's score at each place: a character near its middle counts most.
_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)) / (WINDOW / 2 + 1)


def _stretches(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, int, int]]:
    """Text, first character, windows and the characters at which spans may start, for each run of
    windows to score. Runs of more than ``LONG`` windows are cut where two pieces share ``SHARED``."""
    for k, text in enumerate(texts):
        if not _HINT.search(text):
            continue
        windows = _windows(_classes(text))
        active = _active(windows)
        for run in np.split(active, np.flatnonzero(np.diff(active) > 1) + 1):
            for at in range(0, max(1, len(run) - SHARED), LONG - SHARED):
                piece, last = run[at : at + LONG], at + LONG >= len(run)
                first = (int(piece[0]) - 1) * STRIDE
                low = first + (SHARED // 2 * STRIDE if at else 0)
                high = len(text) if last else first + (len(piece) - SHARED // 2) * STRIDE
                yield k, first, windows[piece[0] : piece[-1] + 1], low, high


def _decode(model: dict, pieces: list[np.ndarray]) -> list[np.ndarray]:
    """Best tags of each stretch, from the weighted scores of its windows."""
    every = np.concatenate(pieces)
    scores = np.concatenate([bilstm.emissions(model, every[i : i + 512]) for i in range(0, len(every), 512)])
    scores *= _WEIGHT[None, :, None]
    totals, at = [], 0
    for piece in pieces:
        total = np.zeros(((len(piece) + 1) * STRIDE, TAGS))
        weight = np.zeros((len(total), 1))
        for j in range(len(piece)):
            total[j * STRIDE : j * STRIDE + WINDOW] += scores[at + j]
            weight[j * STRIDE : j * STRIDE + WINDOW, 0] += _WEIGHT
        totals.append(total / weight)
        at += len(piece)
    by_size: dict[int, list[int]] = {}
    for k, total in enumerate(totals):
        by_size.setdefault(len(total), []).append(k)
    paths: list[np.ndarray] = [None] * len(totals)
    for members in by_size.values():
        for k, path in zip(members, bilstm.viterbi(model, np.stack([totals[k] for k in members])), strict=True):
            paths[k] = path
    return paths


def tagged_spans(texts: list[str], model: dict) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the tagger finds in each text, of plausible form. Scores are held for
    about ``GROUP`` windows at once, however long the texts are."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def settle(group: list) -> None:
        for (k, first, _, low, high), path in zip(group, _decode(model, [g[2] for g in group]), strict=True):
            text = texts[k]
            for start, kind, end in _spans_of(path):
                start, end = max(0, start + first), min(len(text), end + first)
                while start < end and not (text[start].isalnum() or text[start] in "+("):
                    start += 1
                while start < end and not text[end - 1].isalnum():
                    end -= 1
                if start < end and low <= start < high and _plausible(kind, text, start, end):
                    found[k].append((start, kind, end))

    group, held = [], 0
    for stretch in _stretches(texts):
        group.append(stretch)
        held += len(stretch[2])
        if held >= GROUP:
            settle(group)
            group, held = [], 0
    if group:
        settle(group)
    return found


def _spans_of(path: np.ndarray) -> list[tuple[int, int, int]]:
    out, start, kind = [], None, 0
    for k in np.append(np.flatnonzero(path), len(path)).tolist():
        tag = int(path[k]) if k < len(path) else 0
        if start is not None and (k != last + 1 or tag != 2 * kind + 2):
            out.append((start, kind, last + 1))
            start = None
        if start is None and tag:
            start, kind = k, (tag - 1) // 2
        last = k
    return out


def _other_form(kind: int, span: str, dice: np.random.Generator) -> str:
    """The span written in a way that the patterns miss."""
    pick = lambda *options: options[dice.integers(len(options))]
    numbers = re.findall("[0-9]+", span)
    digits = "".join(numbers)
    if kind == 0:
        name, host = span.split("@", 1)
        at = pick("[at]", "(at)", " [at] ", " (at) ", " @ ", " [ at ] ")
        return name + at + host.replace(".", pick("[dot]", " [dot] ", " (dot) ", "[.]") if dice.random() < 0.6 else ".")
    if kind == 1:
        return pick("[.]", " . ", "(.)", "[dot]", " [dot] ").join(numbers)
    if kind == 2:
        size = pick(4, 4, 4, 6)
        return pick(".", "  ", " - ", "/", " . ").join(digits[k : k + size] for k in range(0, len(digits), size))
    own = digits[-10:]
    a, b, c = own[:3], own[3:6], own[6:]
    code = digits[:-10]
    rest = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"({a}){b}-{c}")
    return f"{code}{pick(' ', '-', '.')}{rest}" if code and dice.random() < 0.4 else rest


def _decoy(dice: np.random.Generator) -> str:
    """Digits that are no personal data: dates, versions, amounts, ranges, codes."""
    n = lambda low, high: int(dice.integers(low, high))
    date = f"{n(1950, 2050)}-{n(1, 13):02}-{n(1, 29):02}"
    return (
        date, f"{date} {n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}",
        f"{n(1, 999)},{n(100, 999)},{n(100, 999)}.{n(10, 99)}", f"{n(1900, 2030)}-{n(1900, 2030)}", str(n(0, 10**9)),
        f"{n(0, 2**40):010x}", f"{n(1, 99)}.{n(1, 99)}.{n(1950, 2050)}", f"#{n(0, 10**6)}-{n(0, 99)}", f"{n(0, 9)}.{n(0, 10**6)}e-{n(1, 20)}",
        f"{n(1, 200)} . {n(1, 200)}", f"({n(1, 99)})", f"{n(1, 20)} @ {n(1, 99)}.{n(10, 99)}",
    )[n(0, 13)]


def altered(text: str, variant: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans written in other ways, and (start, kind, end) of the result. Some spans
    are left as they are, some give way to decoys, which are no spans. Of spans that overlap the
    first is taken; equal texts and variants give equal results."""
    dice = np.random.default_rng([zlib.crc32(text.encode("utf-8", "surrogatepass")), variant])
    out, spans, at, length = [], [], 0, 0
    for start, kind, end in base_spans(text):
        if start < at:
            continue
        chance = dice.random()
        span = text[start:end] if chance < 0.15 else _decoy(dice) if chance < 0.35 else _other_form(kind, text[start:end], dice)
        out += [text[at:start], span]
        length += start - at
        if not 0.15 <= chance < 0.35:
            spans.append((length, kind, length + len(span)))
        length += len(span)
        at = end
    return "".join(out) + text[at:], spans


def _meets(span: tuple[int, int, int], starts: list[int], ends: list[int]) -> bool:
    """Does the span overlap any of those with these ``starts`` (sorted) and largest ``ends`` so far?"""
    before = bisect_right(starts, span[2] - 1)
    return before > 0 and ends[before - 1] > span[0]


def _labelled(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[list[int], list[int]]]:
    """Training windows of a text: those that are scored when spans are sought."""
    tags = np.zeros(len(text) + 2 * WINDOW, np.int64)
    for start, kind, end in reversed(spans):
        tags[STRIDE + start : STRIDE + end] = 2 * kind + 2
        tags[STRIDE + start] = 2 * kind + 1
    windows = _windows(_classes(text))
    return [(windows[w].tolist(), tags[w * STRIDE : w * STRIDE + WINDOW].tolist()) for w in _active(windows)]


def training_windows(text: str) -> list[tuple[list[int], list[int]]]:
    """Labelled windows of a text as it stands and of its altered copies."""
    if not _HINT.search(text):
        return []
    spans = base_spans(text)
    made = _labelled(text, spans)
    for variant in range(VARIANTS if spans else 0):
        made += _labelled(*altered(text, variant))
    return made


def fit(docs: DataFrame, max_windows: int = MAX_WINDOWS, steps: int = 700) -> dict:
    """The tagger, from at most ``max_windows`` labelled windows, those with the smallest hash of
    their content. Without any the untrained tagger is returned, whose spans rarely have a
    plausible form."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = []
            for text in batch.column(0).to_pylist():
                made += training_windows(text)
            x, y = zip(*made, strict=True) if made else ((), ())
            yield pa.record_batch([pa.array(x, pa.list_(pa.int64())), pa.array(y, pa.list_(pa.int64()))], ["x", "y"])

    rows = (
        docs.select(text_of().alias("text")).mapInArrow(label, "x array<long>, y array<long>")
        .distinct().orderBy(F.xxhash64("x", "y"), "x", "y").limit(max_windows).toArrow()
    )
    x = np.array(rows["x"].to_pylist(), np.int64).reshape(-1, WINDOW)
    y = np.array(rows["y"].to_pylist(), np.int64).reshape(-1, WINDOW)
    return bilstm.train(x, y, _CLASSES, TAGS, steps)


def find_spans(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``pii``, the spans by start, then kind: ``kind`` (number in ``KINDS``), ``start``, ``end``
    (characters, end exclusive) and ``base`` (found by a pattern). A null or empty text has none; a
    column ``pii`` of ``docs`` is replaced."""
    text_batches(docs.sparkSession)
    docs = docs.drop("pii")
    at = docs.columns.index("text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            out = []
            for text, tagged in zip(texts, tagged_spans(texts, model), strict=True):
                base = base_spans(text)
                starts, ends = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
                more = [s for s in tagged if not _meets(s, starts, ends)]
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                out.append([{"kind": k, "start": s, "end": e, "base": b} for s, k, e, b in spans])
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "pii"])

    return docs.mapInArrow(find, docs.withColumn("pii", F.lit(None).cast(SPANS)).schema)


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``; counts are those of the patterns."""
    lean = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    found = find_spans(lean, fit(lean))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", "pii", base.alias("base")).select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        (F.size("pii") - F.size("base")).cast("long").alias("n_added"),
    )


def masked(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind, as in ``<EMAIL>``; spans that overlap
    are replaced together under the kind of the first. Other texts stay as they are."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, own = batch.schema.names.index("text"), batch.column(batch.schema.names.index("pii")).to_pylist()
            texts = [_masked(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), own, strict=True)]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(texts, pa.string())}
            del columns["pii"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return find_spans(docs, model).mapInArrow(clean, docs.drop("pii").schema)


def _masked(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]
