"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are ordered grades. One weight vector over hashed text features is shared
by all thresholds: P(grade <= k) = sigmoid(threshold_k - score). From the ordered
thresholds follow the tail probabilities P(grade >= k) and the expected grade.

The model is fitted on the driver on a bounded hash sample of rated documents
(``MAX_RATED``); what reaches the driver are those documents' hashed features. The
model is a weight table of fixed size, so scoring is one narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices

#: Rated documents that the model is fitted on, at most (expected; drawn by hash of the id).
MAX_RATED = 6000
BITS = 18
#: Sampled documents that must share a feature before it gets a weight.
MIN_DOCUMENTS = 16
#: Pull of the weights towards 0: only features that tell grades apart keep a weight.
LASSO = 3e-4
#: Probability of the top grade from which a document is selected.
SELECT = 0.75
EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
MEMO_ENTRIES = 100_000

_MASK = (1 << BITS) - 1


def _slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) & _MASK


def _level(share: float) -> int:
    """A share between 0 and 1 as one of seven steps, finer near 0."""
    return int(np.searchsorted((0.002, 0.01, 0.03, 0.1, 0.3, 0.6), share))


class Features:
    """Hashed features of a whole text: its words, their stems and edges, and its shape."""

    def __init__(self):
        self.memo: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        known = self.memo.get(word)
        if known is None:
            core = EDGE.sub("", word).lower()
            edge = "".join(sorted(set(EDGE.findall(word))))
            made = [_slot("w:" + core), _slot("4:" + core[:4]), _slot("5:" + core[:5])] if core else []
            if edge:
                made.append(_slot("e:" + edge))
            known = tuple(made)
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[word] = known
        return known

    def text(self, text: str | None) -> np.ndarray:
        """Distinct slots of a text, ascending; a text without words has the slot of that."""
        words = (text or "").split()
        if not words:
            return np.array([_slot("empty")], np.int32)
        distinct = set(words)
        found: set[int] = set()
        for w in distinct:
            found.update(self.word(w))
        n = len(words)
        shape = {
            "repeat": sum(a == b for a, b in pairwise(words)) / n,
            "same": 1 - len(distinct) / n,
            "shout": sum(map(str.isupper, words)) / n,
        }
        length = min(7, n.bit_length() // 2)
        for k, v in shape.items():
            found.add(_slot(f"{k}:{_level(v)}"))
        found.add(_slot(f"same:{_level(shape['same'])}:{length}"))
        found.add(_slot(f"length:{length}"))
        return np.array(sorted(found), np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """Shared weights and ascending thresholds; ``grades`` are 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, slots: np.ndarray) -> float:
        return float(self.weights[slots].sum(dtype=np.float64))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K, a column each."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = 200, rate: float = 0.05, lasso: float = LASSO, bits: int = BITS) -> OrdinalModel:
    """Fit by Adam on the mean log-likelihood with a lasso; thresholds stay ordered.

    The k-th threshold is the one below it plus the exponential of a free step. No
    rows give a model without weights that finds the top grade certain: it selects every text.
    """
    top = int(grades.max()) if len(grades) else 1
    top = max(1, top)
    if not len(rows):
        return OrdinalModel(np.zeros(1 << bits, np.float32), np.arange(-top, 0, dtype=np.float64) - 40)
    sizes = np.array([len(r) for r in rows])
    cols, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    used = np.bincount(cols, minlength=1 << bits)
    keep = used[cols] >= min(MIN_DOCUMENTS, max(2, len(rows) // 50))
    cols, owner = cols[keep], owner[keep]
    ids, cols = np.unique(cols, return_inverse=True)
    share = np.array([max((grades >= k).mean(), 1e-3) for k in range(1, top + 1)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    base = np.sort(np.log((1 - share) / share))
    p = {"w": np.zeros(len(ids)), "b": base[:1].copy(), "g": np.log(np.maximum(np.diff(base), 1e-2))}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    g, n = grades.astype(int), len(rows)
    for t in range(1, steps + 1):
        cut = np.concatenate([p["b"], p["b"] + np.cumsum(np.exp(p["g"]))])
        s = np.bincount(owner, p["w"][cols], minlength=n)
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        low, high = _sigmoid(edge[g] - s), _sigmoid(edge[g + 1] - s)
        low[g == 0], high[g == top] = 0.0, 1.0
        like = np.maximum(high - low, 1e-9)
        dl, dh = low * (1 - low) / like, high * (1 - high) / like  # d log-likelihood: +dh at the upper threshold, -dl at the lower
        ds = (dh - dl) / n  # gradient of the loss by the score
        dcut = np.array([(-dh[g == k].sum() + dl[g == k + 1].sum()) / n for k in range(top)])
        grad = {"w": np.bincount(cols, ds[owner], minlength=len(ids)) , "b": np.array([dcut.sum()]), "g": np.array([dcut[k:].sum() for k in range(1, top)]) * np.exp(p["g"])}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            pace = rate / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            p[k] -= pace * m[k] / (1 - 0.9**t)
            if k == "w":
                p[k] = np.sign(p[k]) * np.maximum(np.abs(p[k]) - pace * lasso, 0)
    weights = np.zeros(1 << bits, np.float32)
    weights[ids] = p["w"]
    return OrdinalModel(weights, np.concatenate([p["b"], p["b"] + np.cumsum(np.exp(p["g"]))]))


def rated_sample(docs: DataFrame, rated: DataFrame, id_col: str, text_col: str, grade_col: str, cap: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed features and grades of about ``cap`` rated documents, drawn by hash of the id."""
    rated = rated.select(F.col(id_col).alias("k"), F.col(grade_col).cast("int").alias("grade")).where("k is not null and grade is not null")
    rated = rated.groupBy("k").agg(F.min("grade").alias("grade"))
    n = rated.count()
    picked = rated if n <= cap else rated.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * cap / n))
    # At most about cap ids: their number is bounded by the parameter, so they are broadcast.
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(picked), "k")

    def run(batches):
        made = Features()
        for rows in slices(batches):
            found = pa.array([made.text(t).tobytes() for t in rows.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), found, rows.column(2)], names=["k", "slots", "grade"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.select("k", "t", "grade").mapInArrow(run, f"k {kind}, slots binary, grade int").toArrow().sort_by("k")
    return [np.frombuffer(b, np.int32) for b in got["slots"].to_pylist()], np.array(got["grade"].to_pylist(), dtype=int)


def grades_from_labels(labels: DataFrame) -> DataFrame:
    """Ordered grades from the two labels: 0 poor, 1 well written but toxic, 2 good."""
    poor, toxic = F.col("quality") <= 0, F.coalesce(F.col("toxic"), F.lit(0)) > 0
    return labels.where("quality is not null").withColumn("grade", F.when(poor, 0).when(toxic, 1).otherwise(2))


def train(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", cap: int = MAX_RATED) -> OrdinalModel:
    """Fit the model on at most about ``cap`` of the rated documents; one that is rated twice has its lower grade."""
    return fit(*rated_sample(docs, rated, id_col, text_col, grade_col, cap))


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep_cols: bool = False, threshold: float = SELECT) -> DataFrame:
    """Score every whole text.

    Returns ``id_col`` (or with ``keep_cols`` all columns of ``docs``, clashing names
    replaced), expected_grade, tail_1 .. tail_K with tail_k = P(grade >= k), and
    selected: the highest tail is at least ``threshold``. A null or empty text is
    scored as a text without words; repeated rows get the same scores; an empty
    table gives an empty table.
    """
    k = len(model.thresholds)
    names = ["expected_grade", *(f"tail_{i}" for i in range(1, k + 1)), "selected"]
    kept = [c for c in (docs.columns if keep_cols else [id_col]) if c not in names]
    src = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        made = Features()
        for rows in slices(batches):
            tails = model.tails(np.array([model.score(made.text(t)) for t in rows.column(len(kept)).to_pylist()]))
            arrays = [pa.array(tails.sum(axis=1)), *(pa.array(np.ascontiguousarray(tails[:, i])) for i in range(k)), pa.array(tails[:, -1] >= threshold)]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *arrays], names=[*rows.schema.names[: len(kept)], *names])

    made = [T.StructField(c, T.BooleanType() if c == "selected" else T.DoubleType()) for c in names]
    return src.mapInArrow(run, T.StructType([*src.schema.fields[: len(kept)], *made]))
