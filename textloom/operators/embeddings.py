"""Dense embeddings: latent semantic indexing, random indexing, sketches, quantization and synonyms."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.config import TextConfig
from textloom.operators.vocabulary import Terms, vocabulary
from textloom.operators.weighting import VectorModel, vector_model, vectorize, vectorize_terms

#: Up to this smaller dimension the Gram matrix is decomposed on the driver.
FULL_SVD = 3072
#: Up to this many tokens synonyms are found by comparing all pairs.
EXACT_SYNONYMS = 4096
#: Bytes of a projection matrix that are sent to executors whole.
BROADCAST_MATRIX = 256 << 20


@dataclass(frozen=True)
class DenseModel:
    """A projection a token: ``rows`` (token, emb array<double>), with what was asked for."""

    model: VectorModel
    rows: DataFrame
    dim: int
    singular_values: np.ndarray | None = None

    def project(self, vec: DataFrame, normalize: bool = True, key: str = "doc_id") -> DataFrame:
        """(key, emb) of sparse vectors (key, token, w); keys without known tokens are absent."""
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        # whole vectors are summed, partially before the shuffle: a row a document and task, not one a component
        hit = vec.join(self.rows, "token").select(key, array_to_vector(F.transform("emb", lambda x: x * F.col("w"))).alias("__v"))
        out = hit.groupBy(key).agg(Summarizer.sum(F.col("__v")).alias("__v")).select(key, vector_to_array("__v").alias("emb"))
        return unit_rows(out) if normalize else out

    def vectorize_terms(self, terms: Terms, docs: DataFrame, normalize: bool = True) -> DataFrame:
        """(doc_id, emb) of documents (doc_id) whose terms are stored."""
        dense = self.project(vectorize_terms(self.model, terms), normalize)
        zero = F.array_repeat(F.lit(0.0), self.dim)
        return docs.select("doc_id").join(dense, "doc_id", "left").select("doc_id", F.coalesce("emb", zero).alias("emb"))

    def vectorize(self, docs: DataFrame, text: str = "text", normalize: bool = True, **how) -> DataFrame:
        """(doc_id, emb) of all documents; those without a known token get zeros."""
        vec = vectorize(self.model, docs, text, **how)
        dense = self.project(vec, normalize)
        zero = F.array_repeat(F.lit(0.0), self.dim)
        return docs.select("doc_id").join(dense, "doc_id", "left").select("doc_id", F.coalesce("emb", zero).alias("emb"))

    def wordvectors(self, normalize: bool = False) -> DataFrame:
        return unit_rows(self.rows) if normalize else self.rows


def unit_rows(df: DataFrame, column: str = "emb") -> DataFrame:
    """Rows scaled to unit length; zero rows stay."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x))
    return df.withColumn("__norm", norm).withColumn(column, F.when(F.col("__norm") > 0, F.transform(column, lambda x: x / F.col("__norm"))).otherwise(F.col(column))).drop("__norm")


def lsi(model: VectorModel, docs: DataFrame, maxoutdim: int = 128, scaling: str = "none", factorization: str = "auto", text: str = "text", **how) -> DenseModel:
    """Truncated singular value decomposition of the token-by-document matrix.

    "full" decomposes the Gram matrix of the smaller side on the driver;
    "lanczos" is MLlib's distributed iteration over document rows; "auto" is
    the former up to FULL_SVD.  ``scaling`` multiplies columns by "none",
    "inverse" or "singular" values.
    """
    if factorization not in ("auto", "full", "lanczos"):
        raise ValueError(f"unknown factorization {factorization!r}")
    if scaling not in ("none", "inverse", "singular"):
        raise ValueError(f"unknown scaling {scaling!r}")
    spark = docs.sparkSession
    ids = model.voc.with_ids().join(model.weights.select("token"), "token").select("token", (F.row_number().over(W.orderBy("token_id")) - 1).alias("i"))
    m = ids.count()
    if not m:
        raise ValueError("the vocabulary is empty")
    vec = vectorize(model, docs, text, **how).join(ids, "token").select("doc_id", "i", "w")
    n = docs.count()
    k = min(maxoutdim, m, n)
    full = factorization == "full" or factorization == "auto" and min(m, n) <= FULL_SVD
    if full and n < m:
        # Gram matrix of documents; word vectors are the sums of their documents' right vectors
        a = vec.select("doc_id", "i", "w")
        pairs = a.join(a.select(F.col("doc_id").alias("other"), "i", F.col("w").alias("v")), "i").where("doc_id <= other").groupBy("doc_id", "other").agg(F.sum(F.col("w") * F.col("v")).alias("g"))
        t = pairs.toArrow()
        own = sorted(set(t.column("doc_id").to_pylist()))
        at = {x: j for j, x in enumerate(own)}
        g = np.zeros((len(own), len(own)))
        i, j = (np.array([at[x] for x in t.column(c).to_pylist()], int) for c in ("doc_id", "other"))
        g[i, j] = g[j, i] = t.column("g").to_numpy()
        val, vecs = np.linalg.eigh(g)
        order = np.argsort(-val)[:k]
        s, v = np.sqrt(np.maximum(val[order], 0)), vecs[:, order]
        v = v * np.where(s > 1e-9, 1 / np.maximum(s, 1e-300), 0)
        if scaling != "none":
            v = v * (np.where(s > 1e-9, 1 / np.maximum(s, 1e-300), 0) if scaling == "inverse" else s)
        right = spark.createDataFrame(list(zip(own, v.tolist())), f"token {dict(docs.dtypes)['doc_id']}, emb array<double>")
        named = vec.join(ids, "i").select(F.col("token").alias("name"), F.col("doc_id").alias("token"), "w")
        words = DenseModel(model, right, len(s)).project(named, False, "name").withColumnRenamed("name", "token")
        words = ids.select("token").join(words, "token", "left").select("token", F.coalesce("emb", F.array_repeat(F.lit(0.0), len(s))).alias("emb"))
        return DenseModel(model, words, len(s), s)
    if full or k >= m:
        # Gram matrix of tokens, as sums of products within documents; its size is bounded by the switch
        a = vec.select("doc_id", "i", "w")
        pairs = a.join(a.select("doc_id", F.col("i").alias("j"), F.col("w").alias("v")), "doc_id").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("v")).alias("g"))
        t = pairs.toArrow()
        g = np.zeros((m, m))
        i, j, x = (t.column(c).to_numpy() for c in ("i", "j", "g"))
        g[i, j] = x
        g[j, i] = x
        val, vecs = np.linalg.eigh(g)
        order = np.argsort(-val)[:k]
        s, p = np.sqrt(np.maximum(val[order], 0)), vecs[:, order]
    else:
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.linalg.distributed import RowMatrix

        rows = vec.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("v")).select("v").rdd.map(lambda r: Vectors.sparse(m, [(x["i"], x["w"]) for x in r["v"]]))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # read once an iteration
        svd = RowMatrix(rows, numCols=m).computeSVD(min(k, m - 1))
        s, p = svd.s.toArray(), svd.V.toArray()
        rows.unpersist()
    if scaling != "none":
        p = p * (np.where(s > 0, 1 / np.maximum(s, 1e-300), 0) if scaling == "inverse" else s)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(p).ravel()))
    table = spark.createDataFrame(pa.table({"i": pa.array(np.arange(len(p)), pa.int32()), "emb": flat}))
    return DenseModel(model, ids.join(table, "i").select("token", "emb"), p.shape[1], s)


def lsi_of_corpus(cfg: TextConfig, docs: DataFrame, maxoutdim: int = 128, global_weighting: str = "idf", local_weighting: str = "tf", text: str = "text", **how) -> DenseModel:
    """``lsi`` of a corpus under a config: vocabulary and weights are those of the documents."""
    return lsi(vector_model(vocabulary(docs, cfg, text), global_weighting, local_weighting), docs, maxoutdim, text=text, **how)


def _ternary_rows(keys: DataFrame, k: int, seed: int) -> DataFrame:
    """(token, emb) with s = max(2, round(sqrt(k))) entries of +-1/sqrt(s), one in each of s nearly equal runs of components.

    Place and sign of an entry come from the MD5 of seed, entry and token, so
    any engine can draw them again.
    """
    s = min(k, max(2, round(k**0.5)))
    digest = lambda j: F.md5(F.concat(F.lit(f"{seed}:"), j.cast("string"), F.lit(":"), F.col("token")))
    number = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long")

    def block(j):
        lo, hi = F.floor(j * k / s), F.floor((j + 1) * k / s)
        at, zero = (number(digest(j)) % (hi - lo)).cast("int"), F.lit(0.0)
        sign = F.when(F.conv(F.substring(digest(j), 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0) / s**0.5
        return F.concat(F.array_repeat(zero, at), F.array(sign), F.array_repeat(zero, (hi - lo - 1).cast("int") - at))

    return keys.select("token", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(s - 1)), block)).alias("emb"))


def _random_rows(keys: DataFrame, k: int, method: str, seed: int) -> DataFrame:
    """(token, emb): a random vector a distinct ``token``, drawn from its hash and the seed."""
    if method in ("ternary", "sparse_random"):
        return _ternary_rows(keys, k, seed)
    tokens = keys.select("token", F.xxhash64("token", F.lit(seed)).alias("h"))

    def draw(batches):
        for b in batches:
            rows = []
            for h in b.column("h").to_pylist():
                rng = np.random.default_rng(h & (1 << 63) - 1)
                rows.append(rng.standard_normal(k) / k**0.5)
            yield pa.RecordBatch.from_arrays([b.column("token"), pa.array(rows, pa.list_(pa.float64()))], ["token", "emb"])

    return tokens.mapInArrow(draw, "token string, emb array<double>")


def document_indexing(model: VectorModel, docs: DataFrame, maxoutdim: int = 1024, method: str = "gaussian", seed: int = 0, text: str = "text", **how) -> DenseModel:
    """Random vectors of the documents, summed over the documents of each token by its weight there.

    Tokens of the same documents get near vectors; those without a weighted
    occurrence get zeros.
    """
    named = vectorize(model, docs, text, **how).where(F.col("doc_id").isNotNull()).select(F.col("token").alias("name"), F.col("doc_id").cast("string").alias("token"), "w")
    own = _random_rows(docs.select(F.col("doc_id").cast("string").alias("token")).where("token is not null").distinct(), maxoutdim, method, seed)
    words = DenseModel(model, own, maxoutdim).project(named, False, "name").withColumnRenamed("name", "token")
    words = model.weights.select("token").join(words, "token", "left").select("token", F.coalesce("emb", F.array_repeat(F.lit(0.0), maxoutdim)).alias("emb"))
    return DenseModel(model, words, maxoutdim)


def random_indexing(model: VectorModel, maxoutdim: int = 1024, method: str = "gaussian", seed: int = 0) -> DenseModel:
    """A random projection a token, drawn from the hash of the token and the seed.

    "gaussian" entries have variance 1/k; "ternary" (or "sparse_random") has
    s = max(2, round(sqrt(k))) entries of +-1/sqrt(s), one in each run of k / s
    components; "qr" makes the columns orthonormal
    and is decomposed on the driver, so it needs a small vocabulary.
    """
    k = maxoutdim
    if method not in ("gaussian", "qr", "ternary", "sparse_random"):
        raise ValueError(f"unknown method {method!r}")
    table = _random_rows(model.weights, k, method, seed)
    if method == "qr":
        t = table.orderBy("token").toPandas()
        q, r = np.linalg.qr(np.stack(t["emb"])) if len(t) else (np.zeros((0, k)), np.zeros(0))
        if len(t) and len(t) < k:
            raise ValueError("qr needs at least as many tokens as dimensions")
        rows = list(zip(t["token"].tolist(), (q * np.sign(np.diag(r))).tolist())) if len(t) else []
        table = model.weights.sparkSession.createDataFrame(rows, "token string, emb array<double>")
    return DenseModel(model, table, k)


def external(model: VectorModel, vectors: DataFrame, dim: int) -> tuple[DenseModel, int]:
    """Projections given as (token, emb); tokens without one get zeros, and are counted."""
    rows = model.weights.select("token").join(vectors.select("token", "emb"), "token", "left")
    missing = rows.where(F.col("emb").isNull()).count()
    return DenseModel(model, rows.select("token", F.coalesce("emb", F.array_repeat(F.lit(0.0), dim)).alias("emb")), dim), missing


def bit_sketch(dense: DataFrame, column: str = "emb") -> DataFrame:
    """``sketch``: the signs of a vector packed into 64-bit words (bit i of word i // 64 is set above 0)."""
    words = F.transform(F.sequence(F.lit(0), F.ceil(F.size(column) / 64).cast("int") - 1), lambda w: F.slice(column, w * 64 + 1, F.lit(64)))
    pack = lambda part: F.aggregate(F.transform(part, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * 1), F.struct(F.expr("0L").alias("v"), F.lit(0).alias("i")), lambda s, x: F.struct(s["v"].bitwiseOR(F.call_function("shiftleft", x, s["i"])).alias("v"), (s["i"] + 1).alias("i")))["v"]
    return dense.withColumn("sketch", F.transform(words, pack))


def hamming(a: str, b: str):
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def quantize(dense: DataFrame, column: str = "emb", key: str = "doc_id") -> DataFrame:
    """(key, lo, step, codes): each vector in 256 levels between its own least and greatest component."""
    lo, hi = F.array_min(column), F.array_max(column)
    step = F.when(hi > lo, (hi - lo) / 255).otherwise(F.lit(1.0))
    out = dense.select(key, column, lo.cast("double").alias("lo"), step.cast("double").alias("step"))
    return out.select(key, "lo", "step", F.transform(column, lambda x: F.floor((x - F.col("lo")) / F.col("step") + 0.5).cast("int")).alias("codes"))


def exact_quantiles(values: DataFrame, quant: tuple[float, ...]) -> tuple[float, ...] | None:
    """The values of ``x`` at ranks ceil(n q), from 1, or None without values.

    Approximate quantiles bracket each rank; counts say whether they do, and
    only the values within the brackets are ranked.
    """
    x, share = F.col("x"), 2e-5
    values = values.where(x.isNotNull())
    n = values.count()
    if not n:
        return None
    ranks = [max(1, math.ceil(n * Fraction(str(q)))) for q in quant]
    while True:
        ends = sorted({min(1.0, max(0.0, r / n + s)) for r in ranks for s in (-share, share)})
        at = dict(zip(ends, values.agg(F.percentile_approx("x", ends, 100_000)).first()[0]))
        out = []
        for r in ranks:
            lo, hi = (at[min(1.0, max(0.0, r / n + s))] for s in (-share, share))
            below = values.where(x < lo).count() if r / n > share else 0
            inside = values.where(x <= hi) if r / n <= share else values.where((x >= lo) & (x <= hi))
            # the values of 4e-5 of the ranks or so, equal ones once
            for v, c in sorted(tuple(row) for row in inside.groupBy("x").count().collect()):
                if below < r <= below + c:
                    out.append(v)
                below += c
        if len(out) == len(ranks):
            return tuple(out)
        share *= 4


def quantize_global(dense: DataFrame, column: str = "emb", key: str = "doc_id", minmax: tuple[float, float] | None = None, quant: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """(key, codes): 256 levels between two bounds for all vectors, given or taken as quantiles of all components."""
    if minmax is None:
        minmax = exact_quantiles(dense.select(F.explode(column).alias("x")).select(F.col("x").cast("double")), quant) or (0.0, 1.0)
    lo, hi = minmax
    step = (hi - lo) / 255 if hi > lo else 1.0
    code = lambda x: F.floor((F.greatest(F.lit(lo), F.least(F.lit(hi), x.cast("double"))) - lo) / step + 0.5).cast("int")
    return dense.select(key, F.transform(column, code).alias("codes"))


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: halves of the shortest decimal form go away from zero."""
    y = x * 10.0**digits
    out = np.floor(y + 0.5) / 10.0**digits
    for j in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-3):
        out[j] = float(Decimal(repr(float(x[j]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class _Best:
    """The ``k`` nearest items of a block of queries among the blocks of items met so far, by (dist, id).

    Dist is half the squared distance: for unit vectors 1 less the cosine.
    Products are taken in single precision; what may be among the first k by
    its error is measured again in double.  ``bins`` of queries and items: only
    pairs with a bin in common count.
    """

    ROWS = 512

    def __init__(self, ids, q: np.ndarray, k: int, digits: int | None, bins: np.ndarray | None = None, reach: float = np.inf):
        self.ids, self.q, self.k, self.digits, self.bins, self.reach = ids, q, k, digits, bins, reach
        self.q32, self.half = q.astype(np.float32), (q * q).sum(1) / 2
        self.least = np.full(len(q), -np.inf)  # product of the kth
        self.slack = 4 * q.shape[1] * 2.0**-24 + (10.0**-digits if digits is not None else 0)
        self.r, self.d, self.found = np.zeros(0, int), np.zeros(0), ids[:0]

    def add(self, ids, x: np.ndarray, bins: np.ndarray | None = None) -> None:
        x32, half = x.astype(np.float32).T, (x * x).sum(1) / 2
        bias = (0.5 - half).astype(np.float32)
        same = np.isin(self.ids, ids)
        for lo in range(0, len(self.q), self.ROWS):
            s = self.q32[lo : lo + self.ROWS] @ x32 + bias
            for j in np.flatnonzero(same[lo : lo + self.ROWS]):
                s[j, ids == self.ids[lo + j]] = -np.inf
            least = self.least[lo : lo + self.ROWS]
            if (fresh := np.isinf(least)).any():
                if bins is not None:
                    s[fresh] = np.where((self.bins[lo : lo + self.ROWS][fresh][:, None, :] == bins[None]).any(2), s[fresh], -np.inf)
                if s.shape[1] > self.k:
                    least = np.where(fresh, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k], least)
            i, j = np.nonzero((s >= (least - self.slack).astype(np.float32)[:, None]) & (s > -np.inf))
            if bins is not None:
                own = (self.bins[lo + i] == bins[j]).any(1)
                i, j = i[own], j[own]
            # equal items could be as many as there are: no more than the first k of each query stay
            r, d, f = lo + i, ((self.q[lo + i] - x[j]) ** 2).sum(1) / 2, ids[j]
            near = np.sqrt(2 * d) < self.reach
            self._keep(lo, lo + self.ROWS, r[near], d[near], f[near])

    def _keep(self, lo: int, hi: int, r, d, ids) -> None:
        if not len(r):
            return
        if self.digits is not None:
            d = _rounded(d, self.digits)
        a, b = np.searchsorted(self.r, [lo, hi])
        r, d, ids = (np.concatenate(x) for x in ((self.r[a:b], r), (self.d[a:b], d), (self.found[a:b], ids)))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], d, r))
        r, d, ids = r[order], d[order], ids[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        kth = place == self.k - 1
        self.least[r[kth]] = 0.5 + self.half[r[kth]] - d[kth]
        on = place < self.k
        self.r, self.d, self.found = (np.concatenate((old[:a], new[on], old[b:])) for old, new in ((self.r, r), (self.d, d), (self.found, ids)))


def _nearest_of_blocks(items: DataFrame, queries: DataFrame, k: int, digits: int | None, block: int, cosine: bool, planes: np.ndarray | None = None, width: float = 1.0, reach: float = np.inf) -> DataFrame:
    """(query_id, rank, id, dist) of items and queries (id, v): vectors are packed into blocks, each pair of blocks is one matrix product.

    A task takes one block of queries through several blocks of items and
    keeps the first k only.
    """
    kind = dict(items.dtypes)["id"]

    def blocks(df: DataFrame, pre: str) -> tuple[DataFrame, int]:
        slim = df.where(F.col("id").isNotNull() & F.col("v").isNotNull())
        n = max(1, -(-slim.count() // block))

        def pack(batches):
            parts = [b for b in batches if b.num_rows]
            if parts:
                t = pa.Table.from_batches(parts)
                x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
                ids = t.column("id").combine_chunks()
                if cosine:  # those without direction are near to nothing
                    with np.errstate(invalid="ignore", divide="ignore"):
                        x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    ok = np.isfinite(x).all(1)
                    x, ids = x[ok], ids.filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([x.tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32())], [pre + "i", pre + "v", pre + "d"])

        return slim.select("id", "v").repartition(n, "id").mapInArrow(pack, f"{pre}i array<{kind}>, {pre}v binary, {pre}d int").withColumn(pre + "at", F.spark_partition_id()), n

    def search(batches):
        at, best = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(best.ids[best.r].tolist(), types), pa.array(best.found.tolist(), types), pa.array(best.d)], ["query_id", "id", "dist"])

        for b in batches:
            types = b.schema.field("qi").type.value_type
            for j in range(b.num_rows):
                get = lambda c: b.column(c)[j]  # noqa: B023, E731
                side = lambda p: (get(p + "i").values.to_numpy(zero_copy_only=False), np.frombuffer(get(p + "v").as_buffer(), np.float64).reshape(-1, get(p + "d").as_py()))  # noqa: B023, E731
                bins = lambda x: None if planes is None else np.floor(x @ planes.T / width)
                if get("qat").as_py() != at:
                    if best is not None:
                        yield out()
                    at, (ids, q) = get("qat").as_py(), side("q")
                    best = _Best(ids, q, k, digits, bins(q), reach)
                ids, x = side("x")
                if len(ids) and len(best.ids):
                    best.add(ids, x, bins(x))
        if best is not None:
            yield out()

    (q, nq), (x, nx) = blocks(queries, "q"), blocks(items, "x")
    cores = items.sparkSession.sparkContext.defaultParallelism
    groups = min(nx, max(-(-4 * cores // nq), -(-nx // 16)))  # a task holds 16 blocks of items at most
    q, x = q.repartitionById(nq, "qat"), x.repartitionById(groups, (F.col("xat") % groups).cast("int"))
    found = q.crossJoin(x.drop("xat")).mapInArrow(search, f"query_id {kind}, id {kind}, dist double")
    w = W.partitionBy("query_id").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def nearest(items: DataFrame, queries: DataFrame, k: int, column: str = "emb", key: str = "id", block: int = 4096) -> DataFrame:
    """(query_id, rank, id, dist): exact cosine nearest neighbours, excluding equal ids and vectors without direction."""
    x, q = (df.select(F.col(key).alias("id"), F.col(column).alias("v")) for df in (items, queries))
    return _nearest_of_blocks(x, q, k, 6, block, True)


def nearest_approx(items: DataFrame, k: int, column: str = "emb", key: str = "id", tables: int = 6, width: float = 0.5, seed: int = 7, queries: DataFrame | None = None, reach: float = 2.0, block: int = 4096) -> DataFrame:
    """As ``nearest`` of ``queries`` (all items by default) in ``items``, over bucketed random projections of unit vectors.

    Some neighbours are missed, and so are those farther than ``reach``, a
    distance of unit vectors (2 is the largest).  Buckets are compared within
    pairs of blocks: unit vectors fall into a few wide buckets, which would
    send most items to every query in each table.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    x, q = (unit_rows(df.where(F.col(column).isNotNull()), column).select(F.col(key).alias("id"), F.col(column).alias("v")) for df in (items, items if queries is None else queries))
    fitted = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(x.select(array_to_vector("v").alias("features")))
    planes = np.array([list(v.toArray()) for v in fitted._java_obj.randUnitVectors()])
    return _nearest_of_blocks(x, q, k, None, block, False, planes, width, reach)


def synonyms(wordvectors: DataFrame, k: int = 8, approx: bool | None = None) -> DataFrame:
    """(token, rank, neighbor, distance): nearest word vectors by cosine, approximate above EXACT_SYNONYMS tokens unless told otherwise."""
    if approx is None:
        approx = wordvectors.count() > EXACT_SYNONYMS
    found = nearest_approx(wordvectors, k, key="token") if approx else nearest(wordvectors, wordvectors, k, key="token")
    return found.select(F.col("query_id").alias("token"), "rank", F.col("id").alias("neighbor"), F.col("dist").alias("distance"))
