"""Quality classifier: a linear support-vector model on naive-Bayes-scaled n-grams.

Every text becomes a set of indicators (words, word pairs and triples of word
shapes, hashed into ``2**BITS`` cells).  Indicator j is scaled by the log ratio
r_j of its smoothed frequencies in good and bad labelled texts, rows are scaled
to unit length, and a linear model is fitted to the hinge loss by dual
coordinate descent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _text as tx

BITS = 18
#: Labelled texts used for fitting at most.  This bounds the model fit only;
#: scoring covers every text.
MAX_FIT_ROWS = 6000


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, cell) of the distinct indicators of each text, sorted."""
    start, end, doc = tx.tokens(data, offsets, tx.MIXED)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = tx.hashes(tx.FOLD[data], start, end)
    n = len(data)
    up = np.zeros(n + 1, np.int32)
    low = np.zeros(n + 1, np.int32)
    dig = np.zeros(n + 1, np.int32)
    np.cumsum((data >= 65) & (data <= 90), out=up[1:])
    np.cumsum((data >= 97) & (data <= 122) | (data >= 128), out=low[1:])
    np.cumsum((data >= 48) & (data <= 57), out=dig[1:])
    ups, lows, digs = up[end] - up[start], low[end] - low[start], dig[end] - dig[start]
    shape = np.where(ups > 0, np.where(lows > 0, 1, 2), 0) + 3 * (digs > 0)
    punct = tx.MIXED[data[start]] == 2
    shape = np.where(punct, 16 + (data[start] & 15) + 16 * (end - start > 1), shape).astype(np.uint64)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    shape += np.uint64(64) * again
    pair = doc[1:] == doc[:-1]
    triple = doc[2:] == doc[:-2]
    two = tx.mix(h[:-1] * np.uint64(3) + h[1:] + np.uint64(11))
    three = tx.mix((shape[:-2] << np.uint64(16)) + (shape[1:-1] << np.uint64(8)) + shape[2:] + np.uint64(0xA5A5000000))
    cells = np.concatenate([h, two[pair], three[triple]]) >> np.uint64(64 - BITS)
    docs = np.concatenate([doc, doc[:-1][pair], doc[:-2][triple]])
    key = np.sort((docs.astype(np.uint64) << np.uint64(BITS)) | cells)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    """Fitted weights: ``ratio`` per cell, ``weight`` per cell, bias and decision threshold."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    threshold: float = 0.0

    def scores(self, column: pa.Array) -> np.ndarray:
        """Decision value of each text; texts without any indicator get NaN."""
        data, off = tx.flat(column)
        out = np.full(len(off) - 1, np.nan)
        v = (self.weight * self.ratio).astype(np.float64)
        r2 = (self.ratio * self.ratio).astype(np.float64)
        for lo, hi in tx.pieces(off):
            doc, cell = indicators(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            n = hi - lo
            dot = np.bincount(doc, v[cell], n)
            norm = np.sqrt(np.bincount(doc, r2[cell], n))
            seen = np.bincount(doc, minlength=n) > 0
            out[lo:hi] = np.where(seen, dot / np.maximum(norm, 1e-12) + self.bias, np.nan)
        return out


def _rows(cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ptr = np.zeros(len(cells) + 1, np.int64)
    np.cumsum([len(c) for c in cells], out=ptr[1:])
    return ptr, np.concatenate(cells) if cells else np.zeros(0, np.int64)


def fit_cells(cells: list[np.ndarray], y: np.ndarray, cost: float = 1.0, alpha: float = 1.0, epochs: int = 12, tol: float = 1e-3, seed: int = 7, keep_rate: float = 0.995) -> Model:
    """Fit on lists of active cells and labels of +1 and -1.

    With fewer than two classes the model accepts everything.  ``keep_rate``
    is the share of good fitting texts, scored by models that did not see
    them, that the threshold must keep (it never lies above 0).
    """
    size = 1 << BITS
    y = np.asarray(y, np.float64)
    if not len(y) or (y > 0).all() or (y < 0).all():
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), -1.0 if len(y) and (y < 0).all() else 1.0)
    model = _fit(cells, y, cost, alpha, epochs, tol, seed)
    fold = np.random.default_rng(seed).permutation(len(y)) % 3
    held = np.zeros(len(y))
    for k in range(3):
        own = np.flatnonzero(fold != k)
        if (y[own] > 0).all() or (y[own] < 0).all():
            return model
        part = _fit([cells[i] for i in own], y[own], cost, alpha, epochs, tol, seed)
        for i in np.flatnonzero(fold == k):
            c = cells[i]
            r = part.ratio[c]
            held[i] = float(part.weight[c] @ r) / max(float(np.sqrt(r @ r)), 1e-12) + part.bias
    good = held[y > 0]
    model.threshold = min(0.0, float(np.quantile(good, 1 - keep_rate)))
    return model


def _fit(cells: list[np.ndarray], y: np.ndarray, cost: float, alpha: float, epochs: int, tol: float, seed: int) -> Model:
    size = 1 << BITS
    ptr, idx = _rows(cells)
    row = np.repeat(np.arange(len(y)), np.diff(ptr))
    p = alpha + np.bincount(idx[y[row] > 0], minlength=size)
    q = alpha + np.bincount(idx[y[row] < 0], minlength=size)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(p == alpha) & (q == alpha)] = 0
    x = ratio[idx]
    norm = np.sqrt(np.bincount(row, x * x, len(y)))
    x = x / np.maximum(norm, 1e-12)[row]
    # the bias is one more coordinate of value 1, so each row has length sqrt(2)
    w, b = np.zeros(size), 0.0
    a = np.zeros(len(y))
    # hinge costs weighted so that both classes weigh the same
    c = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            s, e = ptr[i], ptr[i + 1]
            j, v = idx[s:e], x[s:e]
            g = y[i] * (w[j] @ v + b) - 1
            pg = min(g, 0) if a[i] <= 0 else max(g, 0) if a[i] >= c[i] else g
            if abs(pg) > 1e-12:
                worst = max(worst, abs(pg))
                new = min(max(a[i] - g / (1 + (norm[i] > 0)), 0), c[i])
                d = (new - a[i]) * y[i]
                a[i] = new
                w[j] += d * v
                b += d
        if worst < tol:
            break
    return Model(ratio.astype(np.float32), w.astype(np.float32), float(b))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Model:
    """Fit on the labelled texts of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    The ``max_rows`` labelled ids of smallest hash are taken (the same at
    every run).  Ids with a null id or label are left out; an id labelled more
    than once counts as bad if any label says so; null texts and texts without
    any indicator are left out, very long ones are used whole, and repeated ids
    are used once per row.  Without labelled texts of both kinds the model
    accepts all (rejects all if only bad ones are known).
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # ties in the hash are broken by the id, so the sample is a function of the table
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # at most max_rows rows of two numbers: bounded whatever the input
    sample = texts.join(F.broadcast(chosen), "doc_id")

    def cells(batches):
        for b in batches:
            data, off = tx.flat(b.column("text"))
            out = []
            for lo, hi in tx.pieces(off):
                doc, cell = indicators(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                cell = cell.astype(np.int32)
                out += [cell[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(out, pa.binary())], ["doc_id", "quality", "cells"])

    rows = sample.mapInArrow(cells, "doc_id long, quality int, cells binary").toArrow().sort_by("doc_id")
    # repeated ids could exceed the bound: the first rows in id order fill it
    rows = rows.slice(0, max_rows)
    lists = [np.frombuffer(c, np.int32).astype(np.int64) for c in rows.column("cells").to_pylist()]
    some = [i for i, c in enumerate(lists) if len(c)]
    y = np.array([1 if q > 0 else -1 for q in rows.column("quality").to_pylist()])
    return fit_cells([lists[i] for i in some], y[some] if len(some) else np.zeros(0))


def score(docs: DataFrame, model: Model, keep_columns: bool = False) -> DataFrame:
    """Score every row of ``docs``.

    Returns doc_id, score, quality (1 keep, 0 reject), one row per input row;
    with ``keep_columns`` the rows of ``docs`` that the model keeps instead.
    Null, empty and wordless texts have a null score and quality 0; a score
    equal to the threshold keeps; an empty table gives none.  Extra
    columns pass through untouched under ``keep_columns`` and are never read
    otherwise; repeated rows are scored alike.
    """
    spark = docs.sparkSession
    handle = spark.sparkContext.broadcast(model)  # 2 MB, set by BITS alone

    if keep_columns:

        def run(batches):
            m = handle.value
            for b in batches:
                s = m.scores(b.column("text"))
                yield b.filter(pa.array(np.nan_to_num(s, nan=-np.inf) >= m.threshold))

        return docs.mapInArrow(run, docs.schema)

    def run(batches):
        m = handle.value
        for b in batches:
            s = m.scores(b.column("text"))
            q = (np.nan_to_num(s, nan=-np.inf) >= m.threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64(), mask=np.isnan(s)), pa.array(q)], ["doc_id", "score", "quality"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, quality int")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, score, quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
