"""Lemma maps (token, lemma) from surface similarity, split by embeddings.

Blocks of a common prefix are independent, so each is one group of a grouped
map; inside a block the leader pass is sequential by nature.
"""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SELECTORS = {
    "shortest": lambda t, n: (len(t), t),
    "most_frequent": lambda t, n: (-n, t),
    "shortest_then_most_frequent": lambda t, n: (len(t), -n, t),
}
#: From so many tokens of a block on, arrays are faster than pairs.
VECTORIZE = 16
_SCHEMA = "token string, lemma string"


def qgrams(token: str, q: int) -> frozenset[str]:
    """Character q-grams; a shorter token stands for itself."""
    return frozenset(token[i : i + q] for i in range(len(token) - q + 1)) if len(token) >= q else frozenset([token])


def levenshtein(a: str, b: str, limit: float = float("inf")) -> int:
    """Edit distance; beyond ``limit`` some number that is greater than it and not above the distance."""
    if abs(len(a) - len(b)) > limit:
        return abs(len(a) - len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > limit:
            return min(row)
    return row[-1]


def _metric(morphology: str, q: int, threshold: float = 1.0):
    """(what is compared of a token, distance); distances over ``threshold`` need not be exact."""
    if morphology == "jaccard":
        return (lambda t: qgrams(t, q)), (lambda a, b: 1 - len(a & b) / len(a | b))
    if morphology == "levenshtein":
        return (lambda t: t), (lambda a, b: levenshtein(a, b, threshold * max(len(a), len(b))) / max(len(a), len(b), 1))
    raise ValueError(f"unknown morphology {morphology!r}")


def _near_jaccard(tokens: list[str], threshold: float, q: int):
    """Of a token's number, the numbers of all within reach.

    Sets of a similarity of s have one of their rarest n - ceil(s n) + 1 of n
    members in common; only tokens that share such a q-gram are compared.
    """
    sets = [qgrams(t, q) for t in tokens]
    seen: dict[str, int] = {}
    for s in sets:
        for g in s:
            seen[g] = seen.get(g, 0) + 1
    rank = {g: i for i, g in enumerate(sorted(seen, key=lambda g: (seen[g], g)))}
    size = np.array([len(s) for s in sets])
    flat = np.full((len(sets), int(size.max())), -1)
    for i, s in enumerate(sets):
        flat[i, : len(s)] = sorted(rank[g] for g in s)
    few = np.minimum(size, size - np.ceil((1 - threshold) * size - 1e-9).astype(int) + 1)
    rows, cols = np.nonzero(np.arange(flat.shape[1])[None] < few[:, None])
    grams = flat[rows, cols]
    order = np.argsort(grams, kind="stable")
    rows, ends = rows[order], np.searchsorted(grams[order], np.arange(len(rank) + 1))

    def near(i: int, free: np.ndarray) -> np.ndarray:
        c = np.unique(np.concatenate([rows[ends[g] : ends[g + 1]] for g in flat[i, : few[i]]]))
        c = c[free[c] & (np.minimum(size[c], size[i]) >= (1 - threshold) * np.maximum(size[c], size[i]) - 1e-9)]
        inter = np.isin(flat[c], flat[i, : size[i]]).sum(1)
        return c[1 - inter / (size[c] + size[i] - inter) <= threshold]

    return near


def _near_levenshtein(tokens: list[str], threshold: float):
    """The same by edit distance: a token is measured against all of a like length at once."""
    skip = len(commonprefix(tokens))
    size = np.array([len(t) for t in tokens])
    width = int(size.max()) - skip
    chars = np.zeros((width, len(tokens)), np.int32)
    for i, t in enumerate(tokens):
        chars[: len(t) - skip, i] = [ord(c) for c in t[skip:]]

    def near(i: int, free: np.ndarray) -> np.ndarray:
        most = np.maximum(size, size[i])
        c = np.flatnonzero(free & (np.abs(size - size[i]) <= threshold * most + 1e-9))
        own, length = chars[: size[i] - skip, i], size[c] - skip
        other = chars[: int(length.max()), :][:, c]
        row = np.repeat(np.arange(len(other) + 1, dtype=np.int16)[:, None], len(c), 1)
        for a, x in enumerate(own, 1):
            last, step = row, row.copy()
            step[0] = a
            differ = (other != x).astype(np.int16)
            np.minimum(last[1:] + 1, last[:-1] + differ, out=step[1:])
            for j in range(1, len(step)):
                np.minimum(step[j], step[j - 1] + 1, out=step[j])
            row = step
        return c[row[length, np.arange(len(c))] / np.maximum(most[c], 1) <= threshold]

    return near


def leader_groups(tokens: list[str], counts: list[int], selector: str, morphology: str, threshold: float, q: int) -> list[list[int]]:
    """Groups around seeds: in selector order the first free token takes all free tokens within reach of it."""
    prepare, dist = _metric(morphology, q, threshold)
    free = sorted(range(len(tokens)), key=lambda i: SELECTORS[selector](tokens[i], counts[i]))
    out = []
    if len(tokens) >= VECTORIZE and (morphology == "levenshtein" or threshold < 1):
        near = _near_jaccard(tokens, threshold, q) if morphology == "jaccard" else _near_levenshtein(tokens, threshold)
        place = np.empty(len(free), int)
        place[free] = np.arange(len(free))
        left = np.ones(len(free), bool)
        for seed in free:
            if left[seed]:
                # a token is within reach of itself, whatever the threshold
                group = sorted({seed, *near(seed, left).tolist()}, key=place.__getitem__)
                left[group] = False
                out.append(group)
        return out
    reps = [prepare(t) for t in tokens]
    while free:
        seed, rest, group = free[0], [], []
        for i in free:
            (group if i == seed or dist(reps[seed], reps[i]) <= threshold else rest).append(i)
        out.append(group)
        free = rest
    return out


def link_groups(vectors: list, threshold: float) -> list[list[int]]:
    """Single linkage by cosine distance; vectors without direction link to nothing."""
    n = len(vectors)
    x = np.array([np.asarray(v, float) for v in vectors])
    norm = np.linalg.norm(x, axis=1)
    ok = norm > 0
    u = np.where(ok[:, None], x / np.where(ok, norm, 1)[:, None], 0)
    near = (1 - u @ u.T <= threshold + 1e-12) & ok[:, None] & ok[None, :]
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(1))
        if (new == label).all():
            break
        label = new
    return [np.flatnonzero(label == r).tolist() for r in np.unique(label)]


def _check(selector: str, morphology: str, order: str = "morphology_first") -> None:
    if selector not in SELECTORS:
        raise ValueError(f"unknown selector {selector!r}")
    if order not in ("morphology_first", "semantic_first"):
        raise ValueError(f"unknown order {order!r}")
    if morphology == "none":
        if order == "morphology_first":
            raise ValueError("morphology_first needs a morphology")
    else:
        _metric(morphology, 2)


def prefix_blocks(table: DataFrame, prefix: int) -> DataFrame:
    """``table`` with block: the first ``prefix`` characters of the token, or one block for 0."""
    return table.withColumn("block", F.substring("token", 1, prefix) if prefix > 0 else F.lit(""))


def _elect(tokens, counts, selector: str) -> list[tuple[str, str]]:
    best = min(range(len(tokens)), key=lambda i: SELECTORS[selector](tokens[i], counts[i]))
    return [(t, tokens[best]) for i, t in enumerate(tokens) if i != best]


def lemma_clusters(
    vocab: DataFrame, wordvectors: DataFrame, selector: str = "most_frequent", morphology: str = "jaccard", morphology_threshold: float = 0.3, qgram: int = 2, min_common_prefix: int = 3,
    order: str = "morphology_first", semantic_threshold: float = 1.0, algorithm: str = "fft", num_clusters: int = 0, seed: int = 0,
) -> DataFrame:
    """(token, lemma) of tokens that are not their own lemma.

    "morphology_first" groups by surface within prefix blocks, then splits by
    embeddings; "semantic_first" clusters embeddings first ("fft": farthest
    first on the driver; "dnet", "randsel", "multirandsel": k-means) and groups
    by surface within clusters.
    """
    _check(selector, morphology, order)
    table = prefix_blocks(vocab.select("token", "occs"), min_common_prefix).join(wordvectors.select("token", "emb"), "token", "left")
    if order == "semantic_first":
        table = table.join(_clusters(wordvectors, algorithm, num_clusters, seed), "token").withColumn("block", F.when(F.lit(morphology == "none"), F.lit("")).otherwise(F.col("block")))
        keys = ["cluster", "block"]
    else:
        keys = ["block"]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token", ignore_index=True)
        tokens, counts = pdf["token"].tolist(), pdf["occs"].tolist()
        if morphology == "none":
            families = [list(range(len(tokens)))]
        else:
            families = leader_groups(tokens, counts, selector, morphology, morphology_threshold, qgram)
        out: list[tuple[str, str]] = []
        for f in families:
            if len(f) < 2:
                continue
            parts = [list(range(len(f)))]
            if order == "morphology_first":
                have = [i for i in range(len(f)) if pdf["emb"][f[i]] is not None]
                parts = [[have[i] for i in p] for p in link_groups([pdf["emb"][f[i]] for i in have], semantic_threshold)] if have else []
            for p in parts:
                if len(p) > 1:
                    out += _elect([tokens[f[i]] for i in p], [counts[f[i]] for i in p], selector)
        return pd.DataFrame(out, columns=["token", "lemma"])

    return table.groupBy(*keys).applyInPandas(group, _SCHEMA)


def _clusters(wordvectors: DataFrame, algorithm: str, k: int, seed: int) -> DataFrame:
    """(token, cluster) by embeddings."""
    if algorithm not in ("fft", "dnet", "randsel", "multirandsel"):
        raise ValueError(f"unknown clustering {algorithm!r}")
    spark = wordvectors.sparkSession
    m = wordvectors.count()
    k = k if k > 0 else max(1, int(np.ceil(np.sqrt(m))))
    if algorithm == "fft":
        t = wordvectors.orderBy("token").toPandas()
        x = np.stack([np.asarray(v, float) for v in t["emb"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        best, label, at = np.full(m, np.inf), np.zeros(m, int), 0
        for c in range(min(k, m)):
            d = 1 - x @ x[at]
            label[d < best] = c
            best = np.minimum(best, d)
            at = int(best.argmax())
        return spark.createDataFrame(pd.DataFrame({"token": t["token"], "cluster": label}), "token string, cluster int")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = wordvectors.select("token", array_to_vector("emb").alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("token", F.col("prediction").alias("cluster"))


def extend_lemmas(vocab: DataFrame, lemmas: DataFrame, candidates: DataFrame | None = None, selector: str = "most_frequent", morphology: str = "jaccard", morphology_threshold: float = 0.3, qgram: int = 2, min_common_prefix: int = 3) -> DataFrame:
    """Further (token, lemma) pairs by surface alone, for tokens without a lemma.

    With ``candidates`` (token) only they may be mapped, and only blocks that
    hold one are looked at.
    """
    _check(selector, morphology)
    table = prefix_blocks(vocab.select("token", "occs").join(lemmas.select("token"), "token", "left_anti"), min_common_prefix)
    if candidates is None:
        table = table.withColumn("wanted", F.lit(True))
    else:
        mark = candidates.select("token").distinct().withColumn("wanted", F.lit(True))
        table = table.join(mark, "token", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
        table = table.join(table.where("wanted").select("block").distinct(), "block", "left_semi")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token", ignore_index=True)
        tokens, counts, wanted = pdf["token"].tolist(), pdf["occs"].tolist(), set(pdf["token"][pdf["wanted"]])
        out: list[tuple[str, str]] = []
        for f in leader_groups(tokens, counts, selector, morphology, morphology_threshold, qgram):
            if len(f) > 1:
                out += [e for e in _elect([tokens[i] for i in f], [counts[i] for i in f], selector) if e[0] in wanted]
        return pd.DataFrame(out, columns=["token", "lemma"])

    return table.groupBy("block").applyInPandas(group, _SCHEMA)
