"""Toxicity: gradient-boosted trees over a few dense features, calibrated by isotonic regression.

Features of a text: density of a learned lexicon (words and word beginnings that mark the
toxic class), its hits near a second-person pronoun, capitals, punctuation and signs of
obfuscation. The rows of a fold get their training features from a lexicon of the other folds,
and the calibration uses a fold that no tree has seen. The labelled sample is bounded (``max_labelled``
rows, those with the smallest hash of their id), therefore the numpy training on the driver
is bounded too; scoring runs in the tasks that read the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import slices, stored, text_batches, text_of

MAX_LABELLED = 20_000
MAX_LEXICON = 4_000
FOLDS = 5
#: Second-person pronouns of the four languages, without marks.
SECOND_PERSON = frozenset(
    w.encode() for w in "you your yours yourself u ur du dich dir dein deine deiner tu te ti tus usted ustedes vous votre vos toi".split()
)
NEAR = 3  # words
FEATURES = (
    "words_log", "hits", "hit_density", "weight_density", "weight_max", "near_second_person",
    "second_person", "capitals", "shouted_words", "exclamations", "punctuation", "repeated_marks",
    "obfuscated", "digits",
)

#: Letters in lower case, other ASCII as blanks; bytes of other letters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Usual stand-ins for letters, undone before the lexicon is asked a second time.
_LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_KIND[ord("!")] = 5
_KIND[128:] = 6


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def stems_of(word: bytes) -> tuple[bytes, ...]:
    """The word and its beginnings of four and five bytes, marked as such."""
    return (word, word[:4] + b"-", word[:5] + b"-") if len(word) > 5 else (word, word[:4] + b"-") if len(word) > 4 else (word,)


def features(text: str, lexicon: _Lexicon) -> list[float]:
    """``FEATURES`` of a text; the empty text gives zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_FOLD).split()
    n = len(words)
    if not raw:
        return [0.0] * len(FEATURES)
    kinds = _KIND[np.frombuffer(raw, np.uint8)]
    count = np.bincount(kinds, minlength=7)
    letters = max(1, count[1] + count[2] + count[6] // 2)
    weights = list(map(lexicon.__getitem__, words))
    hits = [i for i, w in enumerate(weights) if w is not None]
    total = sum(weights[i] for i in hits)
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    inner = (kinds[1:-1] >= 3) & (kinds[1:-1] <= 5) & _letter(kinds[:-2]) & _letter(kinds[2:])
    obfuscated = 0
    if inner.any():
        for token in raw.split():
            if not token.isalpha() and len(token) > 3:
                plain = token.translate(_LEET).translate(_FOLD).replace(b" ", b"")
                obfuscated += plain != token.lower() and lexicon[plain] is not None
    marks = (kinds[1:] >= 4) & (kinds[1:] <= 5) & (kinds[1:] == kinds[:-1])
    upper = (kinds == 1)
    return [
        math.log1p(n), float(len(hits)), len(hits) / max(1, n), total / max(1, n),
        max((weights[i] for i in hits), default=0.0), float(near),
        sum(map(SECOND_PERSON.__contains__, words)) / max(1, n) if n else 0.0,
        count[1] / letters, float((upper[1:] & upper[:-1]).sum()) / max(1, len(raw)),
        count[5] / max(1, n), (count[4] + count[5]) / len(raw), float(marks.sum()) / max(1, n),
        float(obfuscated) + float(inner.sum()) / max(1, n), count[3] / len(raw),
    ]


def _letter(kinds: np.ndarray) -> np.ndarray:
    return (kinds == 1) | (kinds == 2) | (kinds == 6)


# The lexicon


class _Lexicon(dict):
    """Weight of a word: the largest of its own and those of its beginnings, or None. Words
    once looked up are kept, ``room`` of them at most."""

    def __init__(self, weights: dict[bytes, float], room: int = 50_000):
        super().__init__()
        self.weights, self.room = weights, room

    def __missing__(self, word: bytes) -> float | None:
        found = max((w for w in map(self.weights.get, stems_of(word)) if w is not None), default=None)
        if len(self) >= self.room:
            self.clear()
        self[word] = found
        return found


def learn_lexicons(sample: DataFrame, least: int = 3) -> list[dict[bytes, float]]:
    """Words and beginnings that mark the toxic rows of ``sample`` (``text``, ``toxic``, ``fold``).

    The first lexicon uses all rows; the k-th of the others leaves out fold k, for features of
    the rows of that fold. Document frequencies are counted in Spark; at most ``MAX_LEXICON``
    entries come to the driver. An entry needs ``least`` toxic documents and log odds of 1.5
    above the base rate.
    """

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list({s for w in set(words_of(text)) for s in stems_of(w)})
                yield pa.record_batch(
                    [pa.array(found, pa.binary()), pa.array([toxic] * len(found), pa.int64()), pa.array([fold] * len(found), pa.int64())],
                    ["stem", "toxic", "fold"],
                )

    folds = range(1, FOLDS)
    sums = [F.sum(F.when(F.col("fold") == k, F.col("toxic")).otherwise(0)).alias(f"toxic_{k}") for k in folds]
    rows = [F.count(F.when(F.col("fold") == k, 1)).alias(f"rows_{k}") for k in folds]
    each = sample.agg(*sums, *rows).first()
    toxic, total = (np.array([each[f"{what}_{k}"] or 0 for k in folds], float) for what in ("toxic", "rows"))
    counted = (
        sample.select("text", "toxic", "fold")
        .mapInArrow(stems, "stem binary, toxic long, fold long")
        .groupBy("stem")
        .agg(*sums, *rows)
        .withColumn("toxic", sum((F.col(f"toxic_{k}") for k in folds), F.lit(0)))
        .where(F.col("toxic") >= least)
        .where(F.col("toxic") * total.sum() >= 2.0 * toxic.sum() * sum((F.col(f"rows_{k}") for k in folds), F.lit(0)))
        .orderBy(F.desc("toxic"), "stem")
        .limit(MAX_LEXICON)
        .collect()
    )
    found = []
    for left_out in (0, *folds):
        kept = np.array([k != left_out for k in folds])
        n, positive = total[kept].sum(), toxic[kept].sum()
        base = math.log((positive + 0.5) / (n - positive + 0.5))
        lexicon = {}
        for row in counted:
            t = sum(row[f"toxic_{k}"] for k in folds if k != left_out)
            m = sum(row[f"rows_{k}"] for k in folds if k != left_out)
            odds = math.log((t + 0.5) / (m - t + 0.5)) - base
            if t >= least and odds >= 1.5:
                lexicon[bytes(row.stem)] = odds
        found.append(lexicon)
    return found


# Trees


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64):
    """Newton boosting of the log loss on binned features. Returns (base, trees); a tree is
    a list of (feature, threshold) by heap position and the values of its leaves."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    rate0 = min(max(y.mean(), 1e-4), 1 - 1e-4)
    base = math.log(rate0 / (1 - rate0))
    margin, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), int)
        splits: list[tuple[int, float]] = []
        for level in range(depth):
            for k in range(2**level):
                own = np.flatnonzero(node == k)
                splits.append(_best_split(binned[own], grad[own], hess[own], edges))
            first = 2**level - 1
            chosen = [splits[first + k] for k in range(2**level)]
            feature = np.array([c[0] for c in chosen])[node]
            limit = np.array([c[1] for c in chosen])[node]
            node = 2 * node + (x[np.arange(len(y)), feature] > limit)
        g = np.bincount(node, grad, 2**depth)
        h = np.bincount(node, hess, 2**depth)
        leaves = rate * g / (h + 1.0)
        margin += leaves[node]
        trees.append((splits, leaves))
    return base, trees


def _best_split(binned, grad, hess, edges) -> tuple[int, float]:
    best, found = 1e-9, (0, math.inf)
    total_g, total_h = grad.sum(), hess.sum()
    for f, edge in enumerate(edges):
        if not len(edge) or not len(binned):
            continue
        g = np.cumsum(np.bincount(binned[:, f], grad, len(edge) + 1))[:-1]
        h = np.cumsum(np.bincount(binned[:, f], hess, len(edge) + 1))[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = float(gain[k]), (f, float(edge[k]))
    return found


def margins(x: np.ndarray, model) -> np.ndarray:
    base, trees = model
    out = np.full(len(x), base)
    rows = np.arange(len(x))
    for splits, leaves in trees:
        node = np.zeros(len(x), int)
        feature, limit = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        depth = (len(leaves)).bit_length() - 1
        for level in range(depth):
            at = 2**level - 1 + node
            node = 2 * node + (x[rows, feature[at]] > limit[at])
        out += leaves[node]
    return out


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, rate) of the pooled-adjacent-violators fit; two pseudo rows, one of each
    class, keep every block off 0 and 1."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of margins
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    prior = (y.sum() + 1) / (len(y) + 2)
    knots = [b[2] / b[1] for b in blocks]
    rates = [(b[0] + prior) / (b[1] + 1) for b in blocks]
    return np.array(knots), np.maximum.accumulate(np.array(rates))


def calibrated(margin: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Linear between the blocks; a thousandth of the plain logistic value keeps the order within a block."""
    plain = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
    fitted = np.interp(margin, *knots) if len(knots[0]) else plain
    return 0.999 * fitted + 0.001 * plain


# The operator


def fold_of(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null counts as held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """The model from at most ``max_labelled`` labelled rows with fold 1 to 4.

    Rows without id or label are left out, of a repeated id the largest label counts. With no
    labelled row, or with one class only, every text gets the base rate.
    """
    text_batches(docs.sparkSession)
    labelled = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
        .withColumn("fold", fold_of().cast("long"))
        .where("fold > 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(labelled), "doc_id")
    sample = stored(sample, "toxicity-sample")
    lexicons = learn_lexicons(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_Lexicon(x) for x in lexicons]
        for batch in slices(batches):
            ids, texts, toxic, fold = (c.to_pylist() for c in batch.columns)
            x = [features(t, known[k]) for t, k in zip(texts, fold, strict=True)]
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(toxic, pa.int64()), pa.array(fold, pa.int64()), pa.array(x, pa.list_(pa.float64()))],
                ["doc_id", "toxic", "fold", "x"],
            )

    made = (
        sample.select("doc_id", "text", "toxic", "fold")
        .mapInArrow(rows, "doc_id long, toxic long, fold long, x array<double>").toArrow()
    )
    order = np.argsort(made["doc_id"].to_numpy(), kind="stable")
    y, fold = made["toxic"].to_numpy()[order].astype(float), made["fold"].to_numpy()[order]
    x = np.array(made["x"].to_pylist(), float).reshape(-1, len(FEATURES))[order]
    train, hold = fold < FOLDS - 1, fold == FOLDS - 1
    if train.sum() < 2 or len(set(y[train])) < 2:
        rate = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
        trees = (math.log(rate / (1 - rate)), [])
    else:
        trees = fit_trees(x[train], y[train])
    enough = hold.sum() >= 20 and len(set(y[hold])) == 2
    knots = fit_isotonic(margins(x[hold], trees), y[hold]) if enough else (np.array([]), np.array([]))
    return {"lexicon": lexicons[0], "trees": trees, "knots": knots}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5). Only ``text`` is looked at.

    A null text is scored as empty. Columns of ``docs`` with these names are replaced.
    """
    text_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    kept = docs.columns
    at = kept.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Lexicon(model["lexicon"])
        for batch in slices(batches):
            x = np.array([features(t or "", known) for t in batch.column(at).to_pylist()], float)
            value = np.clip(calibrated(margins(x, model["trees"]), model["knots"]), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"]
            )

    return docs.mapInArrow(scored, docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def scored_with_holdout(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; empty ``docs`` give no rows."""
    model = fit(docs, labels, max_labelled)
    lean = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return score(lean, model).select("doc_id", (fold_of() == 0).alias("held_out"), "score", "predicted")
