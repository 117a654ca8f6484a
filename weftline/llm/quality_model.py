"""A quality classifier: histogram gradient-boosted trees over statistics of documents.

1. ``statistics`` measures every whole text once, in a narrow pass, and writes a small row for each document.
2. ``fit`` joins these rows to labels and learns from a bounded sample of them: at most ``most`` labelled rows, those with the
   smallest hashes of their ids, reach the driver.  Values fall into up to BINS bins of about equal weight; each tree grows level by
   level, and a node's split comes from histograms of the loss's first and second derivatives, one for each feature, all nodes
   and features of a level in one pass of bincount.
3. Trees are complete and flattened into arrays: feature and threshold of each inner node, value of each leaf.  ``scored``
   walks all documents of a batch through all trees at once, a step a level, with numpy.

Defined cases: a null text is measured and scored like an empty one, which has a score, too.  Labels of one id are averaged
before the join, so repeated labels multiply nothing; null labels and ids without a document teach nothing.  Without labels
every score is 0.5, and with labels of one kind it is near that one.  Repeated rows get equal scores; very long texts are measured
whole; an empty table gives none.  Only the text is an input of a score.  Kept columns that are named like a new one give way to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import written
from weftline.llm.words import WordHashes, windows

BINS, DEPTH, TREES, RATE, RIDGE, LEAST_ROWS = 64, 5, 60, 0.2, 1.0, 20.0

_CLASSES = {
    "digits": range(0x30, 0x3A),
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "spaces": b" \t\n\x0b\f\r",
    "stops": b".!?",
    "commas": b",;:",
    "bangs": b"!",
    "bars": b"|",
    "symbols": b"#*$%&|<>",
    "brackets": b"()[]{}<>",
    "signs": b"=_/\\@^~`+",
    "quotes": b"\"'-",
    "control": [*range(9), *range(14, 32), 127],
    "beyond": range(128, 256),
}
_OF_BYTE = np.array([[b in own for own in map(set, _CLASSES.values())] for b in range(256)], np.float64)
FEATURES = (
    *(f"share_{c}" for c in _CLASSES),
    *("log_bytes", "log_words", "word_bytes", "longest_word", "short_words", "capitalised", "entropy", "different_words", "once", "top_word", "same_as_before", "repeated_threes"),
    *("log_lines", "line_words", "repeated_lines", "sentence_words"),
)


def measured(text: bytes, hashes: WordHashes) -> list[float]:
    """The values of FEATURES for a text in UTF-8."""
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    by_class = histogram @ _OF_BYTE
    share = histogram[histogram > 0] / size
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    own = hashes.of(words)
    threes = windows(own, 3)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    stops = by_class[4]
    return [
        *(by_class / size),
        np.log1p(len(text)),
        np.log1p(len(words)),
        lengths.sum() / n,
        float(np.log1p(lengths.max(initial=0))),
        float((lengths <= 3).sum()) / n,
        sum(w[:1].isupper() for w in words) / n,
        float(-(share * np.log2(share)).sum()),
        len(counts) / n,
        sum(c == 1 for c in counts.values()) / n,
        max(counts.values(), default=0) / n,
        float((own[1:] == own[:-1]).sum()) / n,
        1.0 - len(np.unique(threes)) / max(1, len(threes)) if len(threes) else 0.0,
        np.log1p(len(lines)),
        len(words) / max(1, len(lines)),
        1.0 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        len(words) / (stops + 1.0),
    ]


def statistics(docs: DataFrame, text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """(row: the kept columns, all by default; features) of every document, as a table in the shared folder."""
    kept = keep or [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(f"`{text}`").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            values = np.array([measured(t.as_py() or b"", hashes) for t in batch.column("t")], np.float32).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))], names=["row", "features"])

    return written(rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, features array<float>"), "statistics")


def sample(table: DataFrame, labels: DataFrame, id_col: str, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels from 0 to 1) of at most ``most`` labelled rows: those with the smallest hashes of their ids."""
    known = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("k")).agg(F.avg(F.col(f"`{label}`").cast("double")).alias("y"))
    draw = F.pmod(F.xxhash64("k", F.lit(12)), F.lit(1 << 40))
    met = written(table.join(known, F.col("row").getField(id_col) == F.col("k")).select("features", "y", draw.alias("draw")), "labelled")
    n = met.count()
    near = met if n <= most else met.where(F.col("draw") < int((1 << 40) * min(1.0, 1.1 * most / n)))
    part = near.orderBy("draw", "features", "y").limit(most).toArrow()
    x = part["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return x, part["y"].to_numpy()


@dataclass(frozen=True)
class Trees:
    """Complete trees as arrays: (tree, inner node) feature and threshold, (tree, leaf) value, and the value that all begin
    with.  A value above its node's threshold goes right."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds: each row walks through every tree, all together."""
        n, trees = len(x), len(self.feature)
        if not trees:
            return np.full(n, self.start)
        row, tree = np.arange(n)[:, None], np.arange(trees)[None, :]
        node = np.zeros((n, trees), np.int64)
        inner = self.feature.shape[1]
        while inner > 0:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            inner >>= 1
        return self.start + self.value[tree, node - self.feature.shape[1]].sum(1)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Borders of bins of each feature: values at about equal weight, each the greatest of its bin."""
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(column, at, method="lower"))[: BINS - 1] for column in x.T]


def grown(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees for labels y (0 to 1) by the logistic loss."""
    n_features, inner = x.shape[1], (1 << depth) - 1
    none = np.empty((0, inner))
    if not len(y):
        return Trees(none.astype(np.int64), none, np.empty((0, inner + 1)), 0.0)
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    start = float(np.log(mean / (1 - mean)))
    edges = _edges(x)
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)  # bin b has values up to edge b
    cell = code + np.arange(n_features) * BINS
    # a split after the last bin of a feature parts nothing
    allowed = np.arange(BINS)[None, :] < np.array([len(e) for e in edges])[:, None]
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    raw = np.full(len(y), start)
    gain_of = lambda g, h: g * g / (h + RIDGE)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        first, second = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            wide = 1 << level
            key = (node[:, None] * (n_features * BINS) + cell).ravel()
            shape = (wide, n_features, BINS)
            g, h, n = (np.bincount(key, None if w is None else np.repeat(w, n_features), wide * n_features * BINS).reshape(shape).cumsum(2) for w in (first, second, None))
            whole_g, whole_h, whole_n = g[:, :, -1:], h[:, :, -1:], n[:, :, -1:]
            gain = gain_of(g, h) + gain_of(whole_g - g, whole_h - h) - gain_of(whole_g, whole_h)
            gain = np.where(allowed & (n >= LEAST_ROWS) & (whole_n - n >= LEAST_ROWS), gain, 0.0).reshape(wide, -1)
            best = gain.argmax(1)
            parts = gain[np.arange(wide), best] > 1e-9
            f, b = np.divmod(best, BINS)
            at = wide - 1 + np.arange(wide)
            feature[t, at] = f
            threshold[t, at] = [edges[i][j] if ok else np.inf for i, j, ok in zip(f, b, parts, strict=True)]
            right = parts[node] & (code[np.arange(len(y)), f[node]] > b[node])
            node = 2 * node + right
        g, h = (np.bincount(node, w, inner + 1) for w in (first, second))
        value[t] = -rate * g / (h + RIDGE)
        raw += value[t, node]
    return Trees(feature, threshold, value, start)


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", most: int = 30_000) -> Trees:
    """Trees learned from the labelled rows of a table of statistics, of which at most ``most`` are used."""
    return grown(*sample(table, labels, id_col, label, most))


def scored(table: DataFrame, model: Trees) -> DataFrame:
    """The kept columns of a table of statistics with score (the chance of label 1) and predicted (1 from 0.5 on).  A narrow
    pass."""
    sent = table.sparkSession.sparkContext.broadcast(model)  # trees * 2 ** depth numbers
    row = table.schema["row"].dataType
    names = [c for c in row.names if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = np.concatenate([sent.value.chance(x[at : at + 2048]) for at in range(0, len(x), 2048)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    out = table.mapInArrow(run, f"row {row.simpleString()}, score double, predicted int")
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "score", "predicted")
