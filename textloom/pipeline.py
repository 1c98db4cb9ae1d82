"""Fitting a profile from a corpus: stopwords, vocabulary, weights, encoder, synonyms, lemmas."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.config import NormalizationConfig, TextConfig, TokenizationConfig
from textloom.operators import embeddings, vocabulary as vb
from textloom.operators.lemmas import lemma_clusters
from textloom.operators.profile import Applied, Profile, Step, materialize, synonyms_to_lemmas
from textloom.operators.tokens import batches
from textloom.operators.weighting import vector_model


@dataclass(frozen=True)
class FitConfig:
    """Settings of a fit, as read from TOML."""

    policy: TextConfig = field(default_factory=TextConfig)
    global_weighting: str = "idf"
    local_weighting: str = "tf"
    min_ndocs: int = 1
    doc_freq_threshold: float = 0.5
    apply_stopwords: bool = True
    encoder: str = "lsi"
    outdim: int = 128
    synonyms_k: int = 8
    morphology: str = "jaccard"
    morphology_threshold: float = 0.3
    min_common_prefix: int = 3
    selector: str = "most_frequent"
    lemmas: bool = True
    apply_lemmas: bool = False
    batch_size: int = 0

    def __post_init__(self):
        if self.encoder not in ("lsi", "random", "none"):
            raise ValueError(f"unknown encoder {self.encoder!r}")


def load_config(path: str) -> FitConfig:
    """Settings of a TOML file; tables normalization and tokenization form the policy, [fit] the rest."""
    with open(path, "rb") as f:
        d = tomllib.load(f)
    known = {x.name for x in fields(FitConfig)} - {"policy"}
    fit = d.get("fit", {})
    if unknown := set(fit) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return FitConfig(TextConfig(NormalizationConfig(**d.get("normalization", {})), TokenizationConfig(**d.get("tokenization", {}))), **fit)


def fit_profile(docs: DataFrame, cfg: FitConfig, text: str = "text") -> Profile:
    """Profile of one corpus (doc_id and a text column).

    When lemmas are applied, vocabulary, weights and synonyms are rebuilt from
    the text read under the lemma map, so counts are exact.
    """
    raw = vb.terms(docs, cfg.policy, text).vocabulary()
    stop = frozenset(r["token"] for r in vb.stopword_candidates(raw, cfg.doc_freq_threshold).collect())
    read = materialize(cfg.policy, {}, stop if cfg.apply_stopwords else ())
    # the stored terms serve again where no stopword changes how the text is read
    own = vb.terms(docs, read, text) if stop and cfg.apply_stopwords else raw.terms
    voc = own.vocabulary(cfg.min_ndocs)
    model = vector_model(voc, cfg.global_weighting, cfg.local_weighting)
    syn, lemmas = None, {}
    if cfg.encoder != "none":
        dense = embeddings.lsi(model, docs, cfg.outdim, text=text) if cfg.encoder == "lsi" else embeddings.random_indexing(model, cfg.outdim)
        words = dense.wordvectors()
        syn = embeddings.synonyms(words, cfg.synonyms_k) if cfg.synonyms_k else None
        if cfg.lemmas:
            lemmas = {r["token"]: r["lemma"] for r in lemma_clusters(voc.table, words, cfg.selector, cfg.morphology, cfg.morphology_threshold, min_common_prefix=cfg.min_common_prefix).collect()}
    if lemmas and cfg.apply_lemmas:
        voc = vb.terms(docs, materialize(cfg.policy, lemmas, stop if cfg.apply_stopwords else ()), text).vocabulary(cfg.min_ndocs)
        model = vector_model(voc, cfg.global_weighting, cfg.local_weighting)
        syn = synonyms_to_lemmas(syn, lemmas) if syn is not None else None
    return Profile(model, stop, lemmas, syn, Applied(cfg.apply_stopwords, cfg.apply_lemmas and bool(lemmas), False), (Step("fit", {"encoder": cfg.encoder}),))


def fit_batches(docs: DataFrame, cfg: FitConfig, text: str = "text", skip=lambda k: False):
    """(batch number, profile) of each batch of documents in id order, one at a time; batches that ``skip`` names are not fitted."""
    if cfg.batch_size <= 0:
        if not skip(0):
            yield 0, fit_profile(docs, cfg, text)
        return
    cut = batches(docs, cfg.batch_size)
    n = docs.count()
    for k in range(-(-n // cfg.batch_size)):
        if not skip(k):
            yield k, fit_profile(cut.where(F.col("batch_id") == k).drop("batch_id"), cfg, text)
