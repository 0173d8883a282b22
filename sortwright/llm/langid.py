"""Language identification: a byte convolutional network in numpy.

Text is lower-cased, encoded and cut into windows of a fixed number of bytes; the
last window of a text is padded. Filters of several widths slide over a window's
bytes, each keeps its maximum, and a softmax over these maxima gives the language
of the window. A text's probabilities are the mean over all its windows, so whole
texts are read and long ones take no more memory than short ones.

A filter over one-hot bytes is a sum of table rows, so a convolution is a few
lookups and additions of fixed-size blocks of windows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled texts a language that the network is fitted on, at most (expected), and windows of each.
TEXTS_PER_LANGUAGE = 400
WINDOWS_PER_TEXT = 4
#: Windows that are convolved at once: bounds the memory of a worker.
BLOCK = 128
UNKNOWN = "und"


def to_windows(text: str, window: int = WINDOW) -> np.ndarray:
    """All windows of a text's lower-cased bytes; the last one is padded with 0."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    n = max(1, -(-len(raw) // window))
    out = np.zeros(n * window, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, window)


@dataclass
class ByteCNN:
    """Lookup tables a width (width x 256 x filters), biases, and the softmax layer."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    window: int = WINDOW
    fast: list[np.ndarray] = field(default_factory=list, repr=False)

    def freeze(self) -> "ByteCNN":
        self.fast = [t.astype(np.float32) for t in self.tables]
        return self

    def pool(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maximum of each filter over each window, and with ``where`` its position."""
        tops, at = [], []
        for t in self.fast or self.tables:
            w = len(t)
            p = x.shape[1] - w + 1
            s = np.take(t[0], x[:, :p], axis=0)
            for j in range(1, w):
                s += np.take(t[j], x[:, j : j + p], axis=0)
            if where:
                a = s.argmax(axis=1)
                at.append(a)
                tops.append(np.take_along_axis(s, a[:, None, :], 1)[:, 0])
            else:
                tops.append(s.max(axis=1))
        return np.concatenate(tops, axis=1), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)))
        for i in range(0, len(x), BLOCK):
            top, _ = self.pool(x[i : i + BLOCK])
            out[i : i + BLOCK] = softmax(np.maximum(top + self.bias, 0) @ self.dense + self.offset)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
    """Train by Adam; gradients reach a filter only at the place of its maximum."""
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    units = FILTERS * len(WIDTHS)
    net = ByteCNN(languages, tables, np.zeros(units, np.float32), rng.normal(0, 0.2, (units, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32), x.shape[1] if len(x) else WINDOW)
    params = [*net.tables, net.bias, net.dense, net.offset]
    m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
    target = np.eye(len(languages), dtype=np.float32)[y]
    share = np.bincount(y, minlength=len(languages))
    weight = (len(y) / (len(languages) * np.maximum(share, 1)))[y].astype(np.float32)
    step, lanes = 0, np.arange(FILTERS)[None, :]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            xb = x[pick]
            top, at = net.pool(xb, where=True)
            h = np.maximum(top + net.bias, 0)
            d = (softmax(h @ net.dense + net.offset) - target[pick]) * weight[pick, None] / len(pick)
            dh = (d @ net.dense.T) * (h > 0)
            grads = []
            for k, t in enumerate(net.tables):
                g, dk, rows = np.zeros_like(t), dh[:, k * FILTERS : (k + 1) * FILTERS], np.arange(len(pick))[:, None]
                for j in range(len(t)):
                    np.add.at(g[j], (xb[rows, at[k] + j], np.broadcast_to(lanes, dk.shape)), dk)
                grads.append(g)
            grads += [dh.sum(0), h.T @ d, d.sum(0)]
            step += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
    return net.freeze()


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, cap: int, window: int) -> tuple[list[str], list[str]]:
    """Pieces and languages of about ``cap`` texts a language, drawn by hash of the id."""
    src = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
    sizes = src.groupBy("lang").count()
    limit = F.broadcast(sizes.withColumn("bar", (F.lit(float(1 << 30)) * cap / F.col("count")).cast("long")).select("lang", "bar"))
    texts = src.join(limit, "lang").where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.col("bar")).where(F.col("t").rlike(r"\p{L}"))
    span = F.greatest(F.char_length("t") - window, F.lit(1))
    pieces = texts.select("k", "lang", F.explode(F.array(*[F.substring("t", (F.lit(1) + F.pmod(F.xxhash64("k", F.lit(i)), span)).cast("int"), F.lit(window)) for i in range(WINDOWS_PER_TEXT)])).alias("piece"))
    got = pieces.distinct().toArrow().sort_by([("k", "ascending"), ("piece", "ascending")])
    return got["piece"].to_pylist(), got["lang"].to_pylist()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cap: int = TEXTS_PER_LANGUAGE, window: int = WINDOW) -> ByteCNN:
    """Fit the network on at most about ``cap`` texts of each language.

    Rows without a language are left out, and so are texts without a letter. With no
    rows left the network knows no language and every text is ``und``.
    """
    pieces, langs = training_windows(docs, id_col, text_col, lang_col, cap, window)
    languages = sorted(set(langs))
    if not languages:
        return ByteCNN([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), window)
    x = np.concatenate([to_windows(p, window)[:1] for p in pieces])
    return fit(x, np.array([languages.index(v) for v in langs]), languages)


def held_out(id_column) -> F.Column:
    """Whether an id belongs to the fold that is never learned from; a null id doesn't."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def predict_texts(net: ByteCNN, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lang, score, blocks, owner = [UNKNOWN] * len(texts), [0.0] * len(texts), [], []
    for i, t in enumerate(texts):
        if t and net.languages and any(map(str.isalpha, t)):
            blocks.append(to_windows(t, net.window))
            owner.append(i)
    if blocks:
        sizes = np.array([len(b) for b in blocks])
        p = np.add.reduceat(net.probabilities(np.concatenate(blocks)), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        for i, row in zip(owner, p, strict=True):
            best = int(row.argmax())
            lang[i], score[i] = net.languages[best], min(1.0, float(row[best]))
    return lang, score


def predict(docs: DataFrame, net: ByteCNN, id_col: str = "doc_id", text_col: str = "text", keep_cols: bool = False) -> DataFrame:
    """Predict the language of every whole text, from the text alone.

    Returns ``id_col`` (or with ``keep_cols`` all columns of ``docs``, clashing names
    replaced), lang_pred and score, the mean probability. A text that is null or has
    no letter is ``und`` with score 0; a null id is kept; repeated rows get equal results; an empty
    table gives an empty table. The network has a fixed size and travels with the
    task; one narrow pass, no shuffle.
    """
    names = ["lang_pred", "score"]
    kept = [c for c in (docs.columns if keep_cols else [id_col]) if c not in names]
    src = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        for rows in slices(batches):
            lang, score = predict_texts(net, rows.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*rows.schema.names[: len(kept)], *names])

    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return src.mapInArrow(run, T.StructType([*src.schema.fields[: len(kept)], *made]))
