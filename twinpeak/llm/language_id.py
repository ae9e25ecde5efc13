"""Language ID by a byte convolutional network.

Filters of several widths slide over fixed-length byte windows; each filter's maximum over a
window feeds a softmax. Training is numpy on a bounded sample of labelled windows; inference runs
over every window of every text, in Arrow batches, and averages window probabilities by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored

WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bytes of a window; the last one of a text is filled up with zeros.
SPAN = 128
#: Bounds of the training sample, per language: documents, and windows of each.
DOCS_PER_LANG, WINDOWS_PER_DOC = 400, 6
EPOCHS, BATCH, RATE = 8, 128, 0.02
#: Windows worked on at once.
SLICE = 64


@dataclass
class Network:
    """Filters as (width, 256, FILTERS) tables by byte, and the output layer."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filters of each window, and where each maximum lies."""
        best, at = [], []
        for table in self.tables:
            width = len(table)
            span = windows.shape[1] - width + 1
            z = table[0][windows[:, :span]]
            for j in range(1, width):
                z = z + table[j][windows[:, j : j + span]]
            at.append(z.argmax(1))
            best.append(np.take_along_axis(z, at[-1][:, None], 1)[:, 0])
        return np.concatenate(best, 1) + self.bias, np.stack(at, 1)

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = np.maximum(features, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 3, epochs: int = EPOCHS) -> Network:
    """Cross-entropy by Adam, seeded. windows: (n, SPAN) bytes; labels: places in langs."""
    rng = np.random.default_rng(seed)
    n_features = FILTERS * len(WIDTHS)
    net = Network(
        langs,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_features, np.float32),
        rng.normal(0, 0.3, (n_features, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
    )
    params = [*net.tables, net.bias, net.out, net.out_bias]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    step = 0
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            x, y = windows[pick], labels[pick]
            feats, at = net.features(x)
            grad = net.probabilities(feats)
            grad[np.arange(len(y)), y] -= 1
            grad /= len(y)
            back = (grad @ net.out.T) * (feats > 0)
            grads = []
            for k, table in enumerate(net.tables):
                g, own = np.zeros_like(table), back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(table)):
                    np.add.at(g[j], (np.take_along_axis(x, at[:, k] + j, 1), np.arange(FILTERS)), own)
                grads.append(g)
            grads += [back.sum(0), np.maximum(feats, 0).T @ grad, grad.sum(0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Scorer:
    """Inference by tables over byte pairs: each filter costs at most two lookups a place."""

    def __init__(self, net: Network):
        self.net = net
        pair = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(65536, FILTERS))
        self.parts = [
            [(j, pair(t[j], t[j + 1]), True) if j + 1 < len(t) else (j, t[j], False) for j in range(0, len(t), 2)] for t in net.tables
        ]

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Class probabilities of (n, SPAN) byte windows."""
        found = np.empty((len(data), len(self.net.langs)), np.float32)
        for i in range(0, len(data), SLICE):
            x = data[i : i + SLICE]
            pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            best = []
            for parts in self.parts:
                width = len(self.net.tables[len(best)])
                span = SPAN - width + 1
                z = None
                for j, table, wide in parts:
                    add = table.take((pairs if wide else x)[:, j : j + span], axis=0)
                    z = add if z is None else np.add(z, add, out=z)
                best.append(z.max(1))
            found[i : i + SLICE] = self.net.probabilities(np.concatenate(best, 1) + self.net.bias)
        return found

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Mean class probabilities of whole texts, windows weighed by their bytes."""
        counts = np.array([max(1, -(-len(t) // SPAN)) for t in texts])
        data = np.zeros(counts.sum() * SPAN, np.uint8)
        weight = np.full(counts.sum(), SPAN, np.float64)
        starts = np.concatenate([[0], counts.cumsum()[:-1]])
        for t, s, c in zip(texts, starts, counts, strict=True):
            data[s * SPAN : s * SPAN + len(t)] = np.frombuffer(t, np.uint8)
            weight[s + c - 1] = max(1, len(t) - (c - 1) * SPAN)
        p = self.windows(data.reshape(-1, SPAN)) * weight[:, None]
        return np.add.reduceat(p, starts) / np.add.reduceat(weight, starts)[:, None]


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def sample_windows(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, window) rows for training: at most DOCS_PER_LANG * WINDOWS_PER_DOC per label.

    Documents are the first by a hash of their id, windows lie anywhere in the text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    rows = rows.filter(~held_out(F.col("id")) & F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    first = Window.partitionBy("label").orderBy("_h", "id")
    ids = rows.select("id", "label", F.xxhash64("id", F.lit(1)).alias("_h")).withColumn("_n", F.row_number().over(first))
    ids = stored(ids.filter(F.col("_n") <= DOCS_PER_LANG).select("id").distinct())
    size = F.octet_length("text")
    spot = lambda j: F.pmod(F.xxhash64("id", j), F.greatest(size - SPAN + 1, F.lit(1))).cast("int")
    windows = F.transform(
        F.sequence(F.lit(1), F.lit(WINDOWS_PER_DOC)), lambda j: F.substring(F.encode("text", "utf-8"), spot(j) + 1, F.lit(SPAN))
    )
    # at most DOCS_PER_LANG ids a label; rows that repeat an id bring the same windows
    return rows.join(ids, "id", "left_semi").select("label", "id", F.explode(windows).alias("window"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Network | None:
    """A network trained on the bounded sample; None if no labelled row may be used."""
    rows = sorted((r.label, r.id, bytes(r.window)) for r in sample_windows(docs, id_col, text_col, label_col).collect())
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    data = np.zeros((len(rows), SPAN), np.uint8)
    for row, (_, _, w) in zip(data, rows, strict=True):
        row[: len(w)] = np.frombuffer(w, np.uint8)
    return train(data, np.array([langs.index(r[0]) for r in rows]), langs)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    Null texts, texts without a letter, and all texts when nothing was learned are `und` with
    score 0. Ties go to the first language by name. Extra columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            texts = [None if t is None else t.encode() for t in batch.column(1).to_pylist()]
            known = [i for i, t in enumerate(texts) if t is not None]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            part: list[int] = []
            size = 0
            for n, i in enumerate(known):
                part.append(i)
                size += len(texts[i])
                if size >= 1 << 20 or n == len(known) - 1:
                    p = scorer.texts([texts[k] for k in part])
                    for k, row in zip(part, p, strict=True):
                        langs[k], scores[k] = net.langs[int(row.argmax())], round(float(min(1.0, row.max())), 6)
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def op10(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = predict(docs, fit(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
