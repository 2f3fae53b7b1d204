"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Cyclic boosting visits the
features in turn, round by round: a shallow tree over one feature's bins is
fitted to the logistic gradients and added, shrunk, to that feature's lookup
table. Then the pairs whose joint cells still explain most residual get tables of
their own in the same way, from trees of one cut on each axis. A score is the
logistic of an intercept and one table entry per feature and pair: vectorised
bin additions.

The fit uses a bounded sample of the labelled rows that are not held out:
about ``TRAIN_ROWS`` rows, chosen by a hash of the id, whole texts. Its size, not the
corpus's, bounds what the driver holds. Scoring reads the text and nothing else.

Defined results: null texts are scored as empty ones; rows with a null id or
label are never learned from, and a null id is not held out; without any label,
or with one class only, scores are the constant the labels give (0.5 without
any); repeated rows are scored one by one; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packtables.llm.common import sample_hash, sample_threshold, texts_of

TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 150, 60, 0.1, 4, 2.0
KEEP = 0.7

FEATURES = ["log_words", "word_length", "symbols", "exclamations", "capitals", "digits", "stops", "commas", "distinct_words",
            "repeated_lines", "words_per_line", "short_words", "ended_lines", "beyond_ascii", "longest_word"]


def _bytes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


SYMBOLS, DIGITS = _bytes("#*$%&|<>=_~^\\{}[]"), _bytes("0123456789")
CAPITALS, LETTERS = np.arange(65, 91), np.concatenate([np.arange(65, 91), np.arange(97, 123), np.arange(128, 256)])


def features_of(text: str | None) -> np.ndarray:
    """The measurements of one whole text."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    out = np.zeros(len(FEATURES))
    if not words:
        return out
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, letters = sum(map(len, words)), max(1, n[LETTERS].sum())
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
    out[:] = (np.log1p(len(words)), size / len(words), n[SYMBOLS].sum() / size, n[33] / size, n[CAPITALS].sum() / letters,
              n[DIGITS].sum() / size, n[46] / len(words), n[44] / len(words), len(set(words)) / len(words) ** 0.9,
              1 - len(set(lines)) / len(lines), len(words) / len(lines), (lengths <= 3).mean(),
              sum(x.endswith((b".", b"?", b"!")) for x in lines) / len(lines), n[128:].sum() / size, np.log(lengths.max()))
    return out


@dataclass
class Gam:
    edges: list[np.ndarray]                 # of each feature's bins
    tables: list[np.ndarray]                # log odds by bin
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]    # features, their coarse edges, table
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, f], "right")]
        for a, b, ea, eb, table in self.pairs:
            z += table[np.searchsorted(ea, x[:, a], "right"), np.searchsorted(eb, x[:, b], "right")]
        return 1 / (1 + np.exp(-z))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between distinct values, at most ``bins`` - 1."""
    q = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))
    return q[q > x.min()] if len(x) else q


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Step values by bin of a tree of at most ``leaves`` leaves, grown by the best cut."""
    spans = [(0, len(g))]
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for s, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            lg, lh, rg, rh = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[k], ch[b] - ch[k]
            gain = _gain(lg, lh) + _gain(rg, rh) - _gain(cg[b] - cg[a], ch[b] - ch[a])
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], s, int(k[i]))
        if best[1] is None:
            break
        a, b = spans[best[1]]
        spans[best[1]:best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Step values of the best tree with one cut on each axis, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best = (0.0, None)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            parts = [(m[i, j], m[i, -1] - m[i, j], m[-1, j] - m[i, j], m[-1, -1] - m[i, -1] - m[-1, j] + m[i, j]) for m in (cg, ch)]
            gain = sum(_gain(a, b) for a, b in zip(*parts)) - _gain(cg[-1, -1], ch[-1, -1])
            if gain > best[0]:
                best = (gain, (i, j, [a / (b + RIDGE) for a, b in zip(*parts)]))
    out = np.zeros(g.shape)
    if best[1]:
        i, j, (nw, ne, sw, se) = best[1]
        out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = nw, ne, sw, se
    return out, best[0]


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting over the features, then over the strongest pairs."""
    n_features = len(FEATURES)
    if not len(y) or y.min() == y.max():
        odds = 0.0 if not len(y) else 4.0 * (2 * y[0] - 1)
        return Gam([np.zeros(0)] * n_features, [np.zeros(1)] * n_features, [], float(odds))
    share = y.mean()
    intercept = float(np.log(share / (1 - share)))
    edges = [quantile_edges(x[:, f], BINS) for f in range(n_features)]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), intercept)

    def sums(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(cells, y - p, n), np.bincount(cells, p * (1 - p), n)

    for _ in range(ROUNDS):
        for f in range(n_features):
            step = RATE * shallow_tree(*sums(bins[f], len(tables[f])))
            tables[f] += step
            z += step[bins[f]]
    coarse = [quantile_edges(x[:, f], PAIR_BINS) for f in range(n_features)]
    cbins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    ranked = []
    for a in range(n_features):
        for b in range(a):
            shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            g, h = sums(cbins[a] * shape[1] + cbins[b], shape[0] * shape[1])
            ranked.append((pair_tree(g.reshape(shape), h.reshape(shape))[1], a, b))
    chosen = [(a, b) for gain, a, b in sorted(ranked, reverse=True)[:PAIRS] if gain > 0]
    grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    for _ in range(PAIR_ROUNDS):
        for (a, b), grid in zip(chosen, grids):
            g, h = sums(cbins[a] * grid.shape[1] + cbins[b], grid.size)
            step = RATE * pair_tree(g.reshape(grid.shape), h.reshape(grid.shape))[0]
            grid += step
            z += step[cbins[a], cbins[b]]
    return Gam(edges, tables, [(a, b, coarse[a], coarse[b], grid) for (a, b), grid in zip(chosen, grids)], intercept)


def held_out_column(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Gam:
    """Fits the labelled rows that are not held out, or a sample of about ``train_rows`` of them."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")) \
        .filter("doc_id is not null and quality in (0, 1)").filter(~held_out_column())
    below = sample_threshold(train_rows, usable.count())
    some = usable.filter(sample_hash(F.col("doc_id"), F.lit("quality sample")) <= F.lit(below))
    some = some.select(F.col("doc_id").alias("id"), "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features_of(t).tolist() for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float64()))], ["id", "quality", "x"])

    slim = docs.select("doc_id", "text")
    # the sample is bounded by train_rows and hash luck, so it may be broadcast
    joined = slim.join(F.broadcast(some), slim["doc_id"] == some["id"]).select("id", "quality", "text")
    kind = joined.schema["id"].dataType.simpleString()
    rows = joined.mapInArrow(run, f"id {kind}, quality int, x array<double>").collect()
    rows.sort(key=lambda r: (r.id, r.quality, r.x))
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.quality for r in rows], float))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of each text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)       # bins x features, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features_of(t) for t in texts_of(b)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shipped.value.score(x))], ["doc_id", "score"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
