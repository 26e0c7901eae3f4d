"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on each feature, and then on chosen pairs of features; as a tree on one
feature is a step function of its bins, the sum of all trees is one lookup table for each feature and pair.
A document's score is the logistic of the sum of its tables' entries.

Features come from the text alone: classes of bytes as shares, words, repetition and lines.

Defined results: a null text is an empty one, and gets a score like any other; null labels teach nothing;
with one class or none the score is constant; very long texts are counted whole; repeated rows, equal and
null ids each get a row; an empty table gives an empty result; other columns, of any name, are ignored.
"""

from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces, prepare, release, texts
from .language import sample

CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>@^~_=+{}[]\\/", "bar": b"|", "bang": b"!?", "stop": b".,;:", "space": b" \t", "line": b"\n\r", "quote": b"\"'()-", "high": bytes(range(128, 256))}
FEATURES = (*CLASSES, "log_bytes", "log_words", "word_bytes", "kinds", "again", "line_kinds", "line_words")
_TABLE = np.zeros((256, len(CLASSES)))
for _i, _class in enumerate(CLASSES.values()):
    _TABLE[list(_class), _i] = 1


def features(strings: list[str]) -> np.ndarray:
    """One row of FEATURES for each text."""
    counts, rest = np.zeros((len(strings), 256)), np.zeros((len(strings), len(FEATURES) - len(CLASSES)))
    for i, text in enumerate(strings):
        raw = text.encode()
        counts[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
        n = max(len(words), 1)
        rest[i] = np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / max(len(lines), 1), np.log1p(len(words) / max(len(lines), 1))
    return np.hstack([counts @ _TABLE / np.maximum(counts.sum(axis=1, keepdims=True), 1), rest])


class Model:
    """edges: bin limits of each feature; tables: of each feature; pairs: of pairs of features, over coarser bins."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray], coarse: int):
        self.base, self.edges, self.tables, self.pairs, self.coarse = base, edges, tables, pairs, coarse

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for table, own in zip(self.tables, bins):
            total += table[own]
        for (i, j), table in self.pairs.items():
            total += table[bins[i] // self.coarse, bins[j] // self.coarse]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """A tree on one feature's bins, split where the gain is greatest: the step for each bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + penalty)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best, gain = None, 1e-9
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gains = worth(a, at) + worth(at, b) - worth(a, b)
                if gains.max() > gain:
                    best, gain = int(at[gains.argmax()]), gains.max()
        if best is None:
            break
        cuts = sorted([*cuts, best])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + penalty)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """The tree with one cut of each of two features that gains most: the step for each pair of bins, and the gain."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    a, b = cg[1:-1, 1:-1], ch[1:-1, 1:-1]
    right, below, whole = (cg[1:-1, -1:], ch[1:-1, -1:]), (cg[-1:, 1:-1], ch[-1:, 1:-1]), (cg[-1, -1], ch[-1, -1])
    parts = [(a, b), (right[0] - a, right[1] - b), (below[0] - a, below[1] - b), (whole[0] - right[0] - below[0] + a, whole[1] - right[1] - below[1] + b)]
    gain = sum(x * x / (y + penalty) for x, y in parts) - whole[0] ** 2 / (whole[1] + penalty)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.zeros(g.shape)
    for (x, y), rows, columns in zip(parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None))):
        step[rows, columns] = x[i, j] / (y[i, j] + penalty)
    return step, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 4, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.1, leaves: int = 3, penalty: float = 5.0) -> Model:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], {}, coarse)
    if len(np.unique(y)) < 2:
        return model
    own = model.bins(x)
    total = np.full(len(x), model.base)

    def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            step = rate * _tree(*sums(own[j], len(table)), leaves, penalty)
            table += step
            total += step[own[j]]
    wide = -(-(bins + 1) // coarse)
    cells = {(i, j): own[i] // coarse * wide + own[j] // coarse for i, j in combinations(range(x.shape[1]), 2)}
    grid = lambda at: (v.reshape(wide, wide) for v in sums(at, wide * wide))
    gains = {k: _quarters(*grid(at), penalty)[1] for k, at in cells.items()}
    for k in sorted(gains, key=gains.get, reverse=True)[:n_pairs]:
        model.pairs[k] = np.zeros((wide, wide))
    for _ in range(pair_rounds):
        for k, table in model.pairs.items():
            step = rate * _quarters(*grid(cells[k]), penalty)[0]
            table += step
            total += step.ravel()[cells[k]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 10_000) -> Model:
    """Fits on at most ``per_class`` labelled documents of each class that are not held out; their features, a few numbers each, go to the driver.

    Of several labels of one id the highest counts; documents that share an id have that label each, and equal ones teach once.
    """
    prepare(docs.sparkSession)
    given = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y is not null").where(~F.coalesce(held_out(), F.lit(True)))
    given = given.groupBy("doc_id").agg(F.max("y").alias("y"))
    # Rows are chosen by id and a hash of the text, so no text is dealt out for it.
    body = F.xxhash64(F.col("text").cast("string"))
    narrow = docs.select("doc_id", body.alias("body")).join(given, "doc_id")
    chosen = sample(narrow, "y", per_class, "doc_id", "body")
    rows = docs.select("doc_id", "text", body.alias("body")).join(F.broadcast(chosen), ["doc_id", "body"]).dropDuplicates(["doc_id", "body"]).select("y", "text")

    def run(batches):
        for batch in pieces(batches):
            x = features(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, x.T)], names=["y", *FEATURES])

    found = rows.mapInArrow(run, "y int, " + ", ".join(f"{c} double" for c in FEATURES)).toArrow()
    x = np.stack([found.column(c).to_numpy() for c in FEATURES], axis=1) if len(found) else np.zeros((0, len(FEATURES)))
    order = np.lexsort([*x.T, found.column("y").to_numpy()])  # the fit does not depend on the order of rows
    return fit(x[order], found.column("y").to_numpy().astype(float)[order])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every document."""
    prepare(docs.sparkSession)

    def run(batches):
        release()
        for batch in pieces(batches):
            scores = model.score(features(texts(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 10_000) -> DataFrame:
    scored = score(docs, train(docs, labels, per_class=per_class))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "score", "predicted")
