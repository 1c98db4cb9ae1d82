"""The first k documents of many queries, scored document by document.

Queries are few beside documents.  Their tokens go to the executors as
matrices of token by query; a task multiplies its documents with them and
keeps k documents a query, so no row is made for a pair of query and document.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Up to this many pairs of query and token are sent to executors; more are joined.
BROADCAST_PAIRS = 2_000_000
#: Queries and tokens of a matrix, and cells of a block of documents by tokens.
QUERIES, TOKENS, CELLS = 256, 4096, 4 << 20


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: halves of the shortest decimal form go away from zero."""
    y = x * 10.0**digits
    out = np.floor(y + 0.5) / 10.0**digits
    for j in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-3):
        out[j] = float(Decimal(repr(float(x[j]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class Firsts:
    """The ``k`` first (d, id) of each of ``n`` queries among those offered."""

    def __init__(self, n: int, k: int):
        self.k, self.last = k, np.full(n, np.inf)
        self.r, self.d, self.ids = np.zeros(0, int), np.zeros(0), None

    def offer(self, r: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """``d`` of query ``r`` and document ``ids``."""
        if not len(r):
            return
        r, d = np.concatenate((self.r, r)), np.concatenate((self.d, d))
        ids = ids if self.ids is None else np.concatenate((self.ids, ids))
        if ids.dtype == object:
            codes = {v: i for i, v in enumerate(sorted(set(ids.tolist()), key=lambda v: (v is not None, v)))}
            place = np.array([codes[v] for v in ids.tolist()])
        else:
            place = ids
        order = np.lexsort((place, d, r))
        r, d, ids = r[order], d[order], ids[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        kth = rank == self.k - 1
        self.last[r[kth]] = d[kth]
        on = rank < self.k
        self.r, self.d, self.ids = r[on], d[on], ids[on]


def _matrices(pairs: list[tuple[int, int, float]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, token numbers, weights of token by query) of sorted (query, token, weight)."""
    out, own, tokens = [], [], set()

    def close():
        qs, ts = sorted({p[0] for p in own}), sorted(tokens)
        m = np.zeros((len(ts), len(qs)))
        at, col = {t: i for i, t in enumerate(ts)}, {q: i for i, q in enumerate(qs)}
        for q, t, w in own:
            m[at[t], col[q]] += w
        out.append((np.array(qs), np.array(ts), m))

    start = 0
    for end in range(1, len(pairs) + 1):
        if end < len(pairs) and pairs[end][0] == pairs[start][0]:
            continue
        group = pairs[start:end]
        more = tokens | {p[1] for p in group}
        if own and (len(more) > TOKENS or len({p[0] for p in own}) >= QUERIES):
            close()
            own, more = [], {p[1] for p in group}
        own, tokens, start = own + group, more, end
    if own:
        close()
    return out


def by_document(postings: DataFrame, words: DataFrame, x: Column, extra: Column | None = None) -> DataFrame:
    """(doc_id, tokens, x, extra) of postings (doc_id, token, ...), with ``words`` (token) only; ``extra`` sums up all of them."""
    known = F.broadcast(words.select("token").distinct().withColumn("__known", F.lit(True)))
    own = postings.join(known, "token", "inner" if extra is None else "left")
    some = lambda c: F.collect_list(F.when(F.col("__known"), F.struct("token", c.alias("x"))))
    out = own.groupBy("doc_id").agg(some(x).alias("__t"), (F.lit(0.0) if extra is None else extra.cast("double")).alias("extra"))
    return out.select("doc_id", F.col("__t.token").alias("tokens"), F.col("__t.x").alias("x"), "extra")


def first_documents(docs: DataFrame, queries: list[tuple], k: int, t: int, digits: int, distance: Callable, kind: str = "long") -> DataFrame:
    """(query_id, rank, doc_id, dist) of documents (doc_id, tokens, x, extra) and queries (query_id, token, weight).

    ``distance(dots, hits, extra, query numbers)`` of a block of documents by
    queries: sums of x times weight, numbers of tokens in common, the
    documents' column; smaller is better.  At least ``t`` tokens in common.
    """
    names = list(dict.fromkeys(q for q, _, _ in queries))
    words = list(dict.fromkeys(w for _, w, _ in queries))
    qn, wn = {q: i for i, q in enumerate(names)}, {w: i for i, w in enumerate(words)}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, _matrices(sorted((qn[q], wn[w], float(x)) for q, w, x in queries))))
    n = len(names)

    def score(batches):
        words, blocks = shared.value
        known = pa.array(words, pa.string())
        columns = []
        for _, ts, _ in blocks:
            c = np.full(len(words) + 1, -1)
            c[ts] = np.arange(len(ts))
            columns.append(c)
        best = Firsts(n, k)
        kind = None
        for b in batches:
            tokens, kind = b.column("tokens"), b.schema.field("doc_id").type
            token = pc.index_in(tokens.flatten(), value_set=known).fill_null(len(words)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False))
            x = b.column("x").flatten().to_numpy(zero_copy_only=False)
            ids = np.array(b.column("doc_id").to_pylist(), object) if b.column("doc_id").null_count or not pa.types.is_integer(kind) else b.column("doc_id").to_numpy()
            if best.ids is not None and best.ids.dtype != ids.dtype:
                best.ids, ids = best.ids.astype(object), ids.astype(object)
            extra = b.column("extra").to_numpy(zero_copy_only=False)
            for (qs, ts, m), column in zip(blocks, columns):
                at = column[token]
                own = at >= 0
                r, c, v = row[own], at[own], x[own]
                there = (m != 0).astype(np.float32)
                size = max(1, CELLS // len(ts))
                for lo in range(0, b.num_rows, size):
                    i, j = np.searchsorted(r, [lo, lo + size])
                    if i == j:
                        continue
                    rows = min(size, b.num_rows - lo)
                    cell = (r[i:j] - lo) * len(ts) + c[i:j]
                    hits = np.bincount(cell, minlength=rows * len(ts)).reshape(rows, -1).astype(np.float32) @ there
                    dots = np.bincount(cell, v[i:j], rows * len(ts)).reshape(rows, -1) @ m
                    with np.errstate(invalid="ignore", divide="ignore"):
                        d = distance(dots, hits, extra[lo : lo + rows, None], qs)
                    e, f = np.nonzero((hits >= max(t, 1)) & ~(d > best.last[qs] + 10.0**-digits))
                    best.offer(qs[f], rounded(d[e, f], digits), ids[lo + e])
        if kind is not None and best.ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best.r, pa.int32()), pa.array(best.ids.tolist(), kind), pa.array(best.d)], ["__q", "doc_id", "dist"])

    kinds = dict(docs.dtypes)
    found = docs.mapInArrow(score, f"__q int, doc_id {kinds['doc_id']}, dist double")
    w = W.partitionBy("__q").orderBy("dist", "doc_id")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(names)), f"__q int, query_id {kind}")
    return top.join(F.broadcast(named), "__q").select("query_id", "rank", "doc_id", "dist")
