"""Golden results of the retrieval engine on small corpora."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.config import NormalizationConfig, TextConfig, TokenizationConfig
from textloom.functions import tokenize as tk
from textloom.functions.normalize import normalize_col, normalize_text
from textloom.functions.transforms import ChainTransformation, IgnoreStopwords, LemmaTransformation
from textloom.operators import embeddings as em
from textloom.operators import index, lemmas, profile, vectors
from textloom.operators import vocabulary as vb
from textloom.operators import weighting as wt
from textloom.operators.tokens import tokenize
from textloom.sources import profiles as store
from textloom.sources.records import read_records
from textloom.streaming import incremental

GARDEN = ["la casa roja", "la casa verde", "la casa azul", "la manzana roja", "la pera verde esta rica", "la manzana verde esta rica", "la hoja verde"]
FEELINGS = [("me gusta", "pos"), ("me encanta", "pos"), ("lo lo odio", "neg"), ("odio esto", "neg"), ("me encanta esto LOL!", "pos")]


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id int, text string")


def tokens_of(spark, text, **cfg):
    norm = NormalizationConfig(**{k: v for k, v in cfg.items() if k in NormalizationConfig.__dataclass_fields__})
    tok = TokenizationConfig(**{k: v for k, v in cfg.items() if k in TokenizationConfig.__dataclass_fields__})
    df = spark.createDataFrame([(text,)], "text string" if isinstance(text, str) else "text array<string>")
    return tokenize(df, TextConfig(norm, tok)).first()["tokens"]


@pytest.mark.parametrize(
    "text, cfg, want",
    [
        ("@user;) #jello.world", {}, ["@user", ";)", "#jello", ".", "world"]),
        ("@user;) #jello.world", {"nlist": [2]}, ["@user ;)\tn", ";) #jello\tn", "#jello .\tn", ". world\tn"]),
        ("hello world!! @user;) #jello.world :)", {}, "hello world !! @user ;) #jello . world :)".split()),
        ("a ab __b @@c ..!d ''e \"!\"f +10 -20 30 40.00 .50 6.0 7.. ======= !()[]{}", {"group_usr": True}, "a ab __b @_usr ..! d '' e \"!\" f 0 0 0 0 0 0 0 . ======= !() []{ }".split()),
        (["hello ;)", "#jello world."], {"nlist": [1, 2]}, ["hello", ";)", "hello ;)\tn", "#jello", "world", ".", "#jello world\tn", "world .\tn"]),
        ("", {}, []),
        ("Café 🙂ok", {}, ["cafe", "🙂", "ok"]),
    ],
)
def test_tokens(spark, text, cfg, want):
    assert tokens_of(spark, text, **cfg) == want


def test_normalize(spark):
    texts = ["Café!!", "ÑANDÚ  ﬁn½", None, "see http://x.y/z?q 12.5\t ok", "aaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for cfg in (NormalizationConfig(), NormalizationConfig(del_punc=True, del_dup=True), NormalizationConfig(lc=False, del_diac=False)):
        fast = [r[0] for r in df.select(normalize_col(cfg, "text")).collect()]
        full = [r[0] for r in df.select(normalize_col(cfg.replace(unicode="full"), "text")).collect()]
        assert fast == full == [None if t is None else normalize_text(cfg, t) for t in texts]


def test_sentences(spark):
    df = spark.createDataFrame([("One here. Two!\n\nSecond paragraph here.\r\n\r\n\r\nThird",)], "text string")
    assert len(df.select(tk.paragraphs_col("text")).first()[0]) == 3
    assert df.select(tk.sentences_col("text")).first()[0] == ["One here.", "Two!", "Second paragraph here.", "Third"]


def test_transformations(spark):
    df = spark.createDataFrame([("las casas rojas",)], "text string")
    cfg = TextConfig(transformation=ChainTransformation([LemmaTransformation({"las": "la", "casas": "casa", "rojas": "roja"}), IgnoreStopwords({"la"})]))
    assert tokenize(df, cfg).first()["tokens"] == ["casa", "roja"]
    big = LemmaTransformation({f"x{i}": "y" for i in range(300)} | {"casas": "casa"})
    assert tokenize(df, TextConfig(transformation=big)).first()["tokens"] == ["las", "casa", "rojas"]


def test_vocabulary(spark):
    voc = vb.vocabulary(corpus(spark, ["hello world", "hello there", "the cat sat", None, ""]), TextConfig())
    assert {r["token"]: (r["occs"], r["ndocs"]) for r in voc.table.collect()} == {"hello": (2, 2), **{t: (1, 1) for t in ("world", "there", "the", "cat", "sat")}}
    assert (voc.trainsize, voc.numtokens) == (5, 7) and voc.get("none")["occs"] == 0
    with pytest.raises(ValueError):
        vb.stopword_candidates(voc, 0)
    assert vb.empty(spark, TextConfig()).vocsize == 0


@pytest.mark.parametrize("gw, lw, want", [("binary", "freq", 0.3162), ("idf", "binary", 0.3668), ("idf", "tf", 0.2053), ("entropy", "tf", 0.44456), ("entropy", "binary", 0.7029)])
def test_weighting(spark, gw, lw, want):
    docs = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(FEELINGS, 1)], "doc_id int, text string, label string")
    voc = vb.vocabulary(docs, TextConfig(NormalizationConfig(group_usr=True)))
    model = wt.entropy_model(voc, docs, "label", lw, mindocs=1, smooth=0) if gw == "entropy" else wt.vector_model(voc, gw, lw)
    vec = wt.vectorize(model, docs)
    d = vectors.dots(vec.where("doc_id = 3"), vec.where("doc_id = 4")).first()
    assert d["dot"] == pytest.approx(want, abs=1e-3)


def test_bm25(spark):
    docs = corpus(spark, GARDEN)
    voc = vb.vocabulary(docs, TextConfig()).filter("ndocs > 1 and ndocs < 5")
    q = spark.createDataFrame([(1, "la casa de la manzana verde")], "query_id int, text string")
    got = index.BM25Index(voc).append(docs).search(q, 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [6, 2, 4]
    assert [r["dist"] for r in got] == pytest.approx([-3.3956785, -3.1118512, -2.5816276], abs=1e-5)


def test_cosine_and_sets(spark):
    docs = corpus(spark, GARDEN)
    model = wt.vector_model(vb.vocabulary(docs, TextConfig()))
    q = spark.createDataFrame([(1, "la casa roja")], "query_id int, text string")
    got = index.TextIndex(model).append(docs).search(q, 4).orderBy("rank").collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4} and got[0]["doc_id"] == 1
    q2 = spark.createDataFrame([(1, "la casa verde")], "query_id int, text string")
    assert index.TextIndex(model, "jaccard").append(docs).search(q2, 1).first()["doc_id"] == 2
    with pytest.raises(ValueError):
        index.TextIndex(model, "nonsense")


def test_profiles(spark, tmp_path):
    docs = corpus(spark, GARDEN)
    parts = [profile.Profile(wt.vector_model(vb.vocabulary(docs.where(w), TextConfig()))) for w in ("doc_id < 4", "doc_id >= 4")]
    merged = profile.merge_profiles(parts)
    whole = wt.vector_model(vb.vocabulary(docs, TextConfig()))
    key = lambda m: sorted((r["token"], r["occs"], r["ndocs"], round(r["weight"], 9)) for r in m.weights.collect())
    assert key(merged.model) == key(whole) and merged.lineage_summary() == "merge"
    store.save_profile(str(tmp_path / "p"), merged)
    store.zip_profile(str(tmp_path / "p"), str(tmp_path / "p.zip"))
    again = store.load_profile(spark, str(tmp_path / "p.zip"))
    assert key(again.model) == key(whole) and again.stopwords == merged.stopwords and again.cfg == merged.cfg
    refit = profile.refit_profile(merged, corpus(spark, ["el perro come", "el perro duerme"]))
    assert refit.istuned and refit.model.voc.trainsize == 4


def test_synonym_fusion(spark):
    mk = lambda rows: spark.createDataFrame(rows, profile.SYNONYMS)
    a = mk([("casa", 1, "jardin", 0.1), ("casa", 2, "roja", 0.3)])
    b = mk([("casa", 1, "pera", 0.2), ("casa", 2, "jardin", 0.3)])
    got = profile.fuse_synonyms([a, b]).orderBy("rank").collect()
    assert [r["neighbor"] for r in got] == ["jardin", "pera"] and got[0]["distance"] == pytest.approx(0.2)


def test_lemmas(spark):
    rows = [("cat", 9, [1.0, 0.0]), ("cats", 3, [1.0, 0.1]), ("dog", 8, [0.0, 1.0]), ("dogs", 2, [0.1, 1.0]), ("fish", 5, [0.7, 0.7])]
    df = spark.createDataFrame(rows, "token string, occs long, emb array<double>")
    got = {r["token"]: r["lemma"] for r in lemmas.lemma_clusters(df, df, morphology_threshold=0.5).collect()}
    assert got == {"cats": "cat", "dogs": "dog"}
    with pytest.raises(ValueError):
        lemmas.lemma_clusters(df, df, selector="nonsense")


def test_embeddings(spark):
    docs = corpus(spark, GARDEN)
    model = wt.vector_model(vb.vocabulary(docs, TextConfig()))
    full = em.lsi(model, docs, 4, factorization="full")
    lanczos = em.lsi(model, docs, 4, factorization="lanczos")
    assert full.singular_values == pytest.approx(lanczos.singular_values, rel=1e-5)
    unknown = spark.createDataFrame([(1, "zzz")], "doc_id int, text string")
    assert full.vectorize(unknown).first()["emb"] == [0.0] * 4
    dense = em.random_indexing(model, 64, "ternary").vectorize(docs)
    assert em.bit_sketch(dense).select(F.size("sketch")).first()[0] == 1


def test_sources_and_stream(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text("\n".join(json.dumps({"doc_id": i, "text": t}) for i, t in enumerate(GARDEN)))
    assert read_records(spark, "jsonl", str(p)).count() == 7
    with pytest.raises(ValueError):
        read_records(spark, "xml", str(p))
    stream = spark.readStream.schema("doc_id int, text string").json(str(tmp_path / "*.jsonl"))
    incremental.start(stream, incremental.vocabulary_sink(str(tmp_path / "out"), TextConfig()), str(tmp_path / "ck"), once=True).awaitTermination()
    voc = incremental.read_vocabulary(spark, str(tmp_path / "out"), TextConfig())
    assert voc.trainsize == 7 and voc.get("la")["ndocs"] == 7


def test_synonyms_and_lemma_clusters_read_the_corpus(spark, tmp_path, monkeypatch):
    from textloom.plans import queries

    topics = [["comet", "orbit", "planet"], ["flour", "oven", "yeast"], ["anchor", "harbor", "sail"], ["violin", "cello", "chord"]]
    texts = [" ".join(topics[i % 4]) for i in range(40)]
    corpus(spark, texts).selectExpr("cast(doc_id as long) doc_id", "text", "'en' lang", "'web' source", "cast(length(text) as long) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    near = {(r["token"], r["neighbor"]) for r in queries.QUERIES["synonyms"](spark, str(tmp_path)).where("rank <= 2").collect()}
    assert near == {(a, b) for t in topics for a in t for b in t if a != b}
    given = []
    monkeypatch.setattr(queries.lemmas, "lemma_clusters", lambda voc, words: given.append(words) or voc)
    queries.QUERIES["lemma_clusters"](spark, str(tmp_path))
    v = {r["token"]: r["emb"] for r in em.unit_rows(given[0]).collect()}
    assert sum(a * b for a, b in zip(v["comet"], v["orbit"])) > 0.99


def test_empty_vocabulary_is_refused(spark):
    for voc in (vb.empty(spark, TextConfig()), vb.terms(corpus(spark, ["", None]), TextConfig()).vocabulary()):
        with pytest.raises(ValueError):
            wt.vector_model(voc)


def test_stored_terms_count_rows(spark):
    """Rows that share an id, or have none, are documents of their own, as in a vocabulary of the texts."""
    docs = spark.createDataFrame([(1, "a b a"), (1, "a c"), (None, "b"), (2, None), (3, "")], "doc_id int, text string")
    stored, plain = vb.terms(docs, TextConfig()).vocabulary(), vb.vocabulary(docs, TextConfig())
    rows = lambda v: sorted(map(tuple, v.table.select("token", "occs", "ndocs").collect()))
    assert rows(stored) == rows(plain) == [("a", 3, 2), ("b", 2, 2), ("c", 1, 1)]
    assert (stored.trainsize, stored.numtokens) == (plain.trainsize, plain.numtokens) == (5, 5)


def test_ids_follow_frequency_and_token(spark):
    rows = [(f"{a}{b}", (i + j) % 3, 1) for i, a in enumerate("abcxyz") for j, b in enumerate(["", "b", "bc", "é"])]
    voc = vb.push_tokens(vb.empty(spark, TextConfig()), spark.createDataFrame(rows, vb.VOCAB))
    got = [r["token"] for r in voc.with_ids().orderBy("token_id").collect()]
    assert got == [t for t, n, _ in sorted(rows, key=lambda r: (-r[1], r[0].encode()))]


def test_fit_and_given_clusters(spark):
    from textloom.pipeline import FitConfig, fit_profile

    p = fit_profile(corpus(spark, GARDEN), FitConfig(outdim=3, doc_freq_threshold=0.9, apply_lemmas=True, morphology_threshold=0.6))
    assert p.stopwords == {"la"} and p.synonyms.where("token = 'casa'").count() > 0 and p.model.voc.get("la")["occs"] == 0
