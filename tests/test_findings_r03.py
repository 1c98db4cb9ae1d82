"""Findings of round 3."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import embeddings as em
from textloom.plans import queries


def test_csv_keeps_blanks_empty_texts_and_nulls(spark, tmp_path):
    odd = [None, "", " a", "a ", "\ta\t", "a\r\nb\n", "\n", '"', 'a", "b', '"\n', "\\", "a\x00b", "   ", "null"]
    df = spark.createDataFrame([(i, "en" if i % 3 else None, t) for i, t in enumerate(odd)], "doc_id long, lang string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.QUERIES["read_csv"](spark, str(tmp_path)).collect()}
    assert got == {tuple(r) for r in df.select("doc_id", "lang", F.md5("text").alias("text")).collect()}


@pytest.mark.parametrize("kind", ["many", "equal", "few"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    x = {"many": rng.standard_normal(300_000), "equal": np.repeat([1.5, -2.0, 1.5], 50), "few": rng.standard_normal(7)}[kind]
    df = spark.createDataFrame([(x[i::50].tolist(),) for i in range(min(50, len(x)))], "emb array<double>").select(F.explode("emb").alias("x"))
    s = np.sort(x)
    q = (0.0, 0.025, 0.3337, 0.975, 1.0)
    assert em.exact_quantiles(df, q) == tuple(s[max(1, int(np.ceil(round(len(s) * v, 6)))) - 1] for v in q)


def _brute(x, q, k, same):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = np.round(((u[q][:, None, :] - u[None]) ** 2).sum(2) / 2, 6)
    d[np.arange(len(q)), q] = np.inf
    d[~same[q]] = np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d))[:, :k]
    return {(int(a), r + 1, int(b), float(d[i, b])) for i, a in enumerate(q) for r, b in enumerate(order[i]) if np.isfinite(d[i, b])}


@pytest.mark.parametrize("approx", [False, True])
def test_nearest_settles_ties_by_id_and_keeps_k_of_a_block(spark, approx):
    """Many equal vectors: each query's block gives its k first only, whatever the order of rows."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.repeat(rng.standard_normal((3, 8)), 30, axis=0), rng.standard_normal((90, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<double>")
    q = np.arange(0, 180, 5)
    asked = df.where("id % 5 = 0")
    if approx:
        from pyspark.ml.feature import BucketedRandomProjectionLSH
        from pyspark.ml.functions import array_to_vector

        vecs = em.unit_rows(df).select("id", array_to_vector("emb").alias("features"))
        hashes = [[v[0] for v in r["hashes"]] for r in BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.1, numHashTables=2, seed=7).fit(vecs).transform(vecs).orderBy("id").collect()]
        same = (np.array(hashes)[:, None] == np.array(hashes)[None]).any(2)
        got = em.nearest_approx(df, 4, queries=asked, tables=2, width=0.1, block=50).collect()
    else:
        same = np.ones((180, 180), bool)
        got = em.nearest(df, asked, 4, block=50).collect()
    rows = {(r["query_id"], r["rank"], r["id"], round(r["dist"], 6)) for r in got}
    assert rows == _brute(x, q, 4, same)


def test_java_pattern_is_the_full_pattern(spark):
    import random

    from textloom.functions import charsets as cs
    from textloom.functions import tokenize as tk

    fast = {chr(i) for a, b in ((48, 57), (65, 90), (97, 122), (0xC0, 0x24F)) for i in range(a, b + 1)}
    classes = "".join(cs.punctuation())
    draw = random.Random(5)
    some = [*"ab9éß×  #@_.!-\n", *"¡§«·…‘”—、〔", *"🙂©™👾", "\u0301", "漢", "\U0001F3FB", "€"]
    texts = ["".join(draw.choice(some) for _ in range(draw.randrange(1, 30))) for _ in range(3000)] + sorted(fast)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(*(F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (tk.full_pattern(), tk.java_pattern()))).collect()
    assert all(a == b for a, b in both) and any(a for a, _ in both)
    plain = spark.createDataFrame([("".join(draw.choice([chr(i) for i in range(128)] + [*" #@_ab-."] * 5) for _ in range(40)),) for _ in range(500)], "t string")
    assert all(a == b for a, b in plain.select(F.regexp_extract_all("t", F.lit(tk.ASCII), F.lit(0)), tk.split_tokens("t")).collect())
    assert not df.where(F.length("t") == 1).where(F.col("t").isin(sorted(fast))).where(F.col("t").rlike(f"[{classes}{cs.char_class(cs.emojis())}]")).count()
    marks = spark.createDataFrame([("a🙂b©1…",), ("plain",)], "t string").select(queries.normalize_col(queries.NormalizationConfig(group_emo=True), "t")).collect()
    assert [r[0] for r in marks] == ["a👾b👾0 ...", "plain"]


@pytest.mark.parametrize("morphology, threshold", [("jaccard", 0.3), ("jaccard", 0.5), ("jaccard", 0.0), ("levenshtein", 0.25), ("levenshtein", 0.5), ("levenshtein", 0.0)])
def test_leader_groups_of_arrays(monkeypatch, morphology, threshold):
    from textloom.operators import lemmas

    rng = np.random.default_rng(4)
    tokens = sorted({"ab" + "".join(rng.choice(list("abcé"), rng.integers(0, 9))) for _ in range(400)} | {"a", "b", ""})
    counts = rng.integers(1, 5, len(tokens)).tolist()
    many = [lemmas.leader_groups(tokens, counts, s, morphology, threshold, 2) for s in lemmas.SELECTORS]
    monkeypatch.setattr(lemmas, "VECTORIZE", 1 << 30)
    assert many == [lemmas.leader_groups(tokens, counts, s, morphology, threshold, 2) for s in lemmas.SELECTORS]
    assert threshold == 0 or max(map(len, many[0])) > 1


@pytest.mark.parametrize("name", ["lsi_wordvectors", "synonyms", "lemma_clusters"])
def test_rare_tokens_take_part(spark, tmp_path, name):
    texts = ["comet orbit planet", "flour oven yeast", "flour comets flours"] * 2 + ["comet rarely"]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    got = {r["token"] for r in rows}
    assert got == {"comets", "flours"} if name == "lemma_clusters" else got == {w for t in texts for w in t.split()}
