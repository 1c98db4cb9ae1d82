"""Token transformations: functions on arrays of unigrams."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.config import TextConfig

#: Lemmas kept as a literal map; larger sets are joined (operators.tokens).
LITERAL_LEMMAS = 256


class Identity:
    """Leaves unigrams as they are."""

    def apply(self, unigrams: Column) -> Column:
        return unigrams


@dataclass(frozen=True)
class IgnoreStopwords:
    """Drops unigrams of a set."""

    stopwords: frozenset[str]

    def __init__(self, stopwords):
        object.__setattr__(self, "stopwords", frozenset(stopwords))

    def apply(self, unigrams: Column) -> Column:
        if not self.stopwords:
            return unigrams
        words = sorted(self.stopwords)
        return F.filter(unigrams, lambda t: ~t.isin(words))


@dataclass(frozen=True)
class LemmaTransformation:
    """Rewrites unigrams by a map; others stay."""

    lemmas: tuple[tuple[str, str], ...]

    def __init__(self, lemmas: Mapping[str, str]):
        object.__setattr__(self, "lemmas", tuple(sorted(dict(lemmas).items())))

    @property
    def map(self) -> dict[str, str]:
        return dict(self.lemmas)

    def apply(self, unigrams: Column) -> Column:
        if not self.lemmas:
            return unigrams
        table = F.create_map(*[F.lit(x) for kv in self.lemmas for x in kv])
        return F.transform(unigrams, lambda t: F.coalesce(F.try_element_at(table, t), t))


@dataclass(frozen=True)
class ChainTransformation:
    """Applies transformations in order; what one drops the next never sees."""

    steps: tuple

    def __init__(self, steps):
        object.__setattr__(self, "steps", tuple(steps))

    def apply(self, unigrams: Column) -> Column:
        for s in self.steps:
            unigrams = s.apply(unigrams)
        return unigrams


@dataclass(frozen=True)
class ColumnTransformation:
    """Any function from an array column to one, e.g. giving several tokens for one."""

    fn: object

    def apply(self, unigrams: Column) -> Column:
        return self.fn(unigrams)


def steps(t) -> list:
    """A transformation as a flat list of steps."""
    if t is None or isinstance(t, Identity):
        return []
    return [s for x in t.steps for s in steps(x)] if isinstance(t, ChainTransformation) else [t]


def has_lemma_transformation(cfg: TextConfig) -> bool:
    return any(isinstance(s, LemmaTransformation) for s in steps(cfg.transformation))


def without_lemma_transformation(cfg: TextConfig) -> TextConfig:
    rest = [s for s in steps(cfg.transformation) if not isinstance(s, LemmaTransformation)]
    return cfg.replace(transformation=None if not rest else rest[0] if len(rest) == 1 else ChainTransformation(rest))


def with_lemma_transformation(cfg: TextConfig, lemmas: Mapping[str, str]) -> TextConfig:
    """Lemmas first, in place of any already there: stopwords are given as lemmas."""
    rest = steps(without_lemma_transformation(cfg).transformation)
    own = LemmaTransformation(lemmas)
    return cfg.replace(transformation=ChainTransformation([own, *rest]) if rest else own)
