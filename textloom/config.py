"""Text policies: frozen settings that compile to Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import Column

#: Java patterns; blanks are Unicode-aware on purpose.
RE_URL = r"(?:http|ftp|https)://[^\s\p{Z}]+"
RE_USER = r"@[^;:,.@#&\\\-\"'/*()\[\]¿?¡!{}~<>|\s\p{Z}]+"
RE_NUM = r"[-+]?\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+"


@dataclass(frozen=True)
class NormalizationConfig:
    """How text is normalized before it is tokenized.

    ``unicode`` is "fast" (built-in functions: exact for every character that
    maps to one character and for the usual Latin expansions) or "full" (an
    Arrow UDF with complete compatibility normalization).
    """

    del_diac: bool = True
    del_dup: bool = False
    del_punc: bool = False
    group_num: bool = True
    group_url: bool = True
    group_usr: bool = False
    group_emo: bool = False
    lc: bool = True
    re_user: str = RE_USER
    re_url: str = RE_URL
    re_num: str = RE_NUM
    emojis: frozenset[str] | None = None
    unicode: str = "fast"

    def __post_init__(self):
        if self.unicode not in ("fast", "full"):
            raise ValueError(f"unicode must be 'fast' or 'full', not {self.unicode!r}")

    def replace(self, **changes: Any) -> NormalizationConfig:
        return replace(self, **changes)


class TokenGenerator(Protocol):
    """A further source of tokens: ``generate(unigrams, normalized)`` returns an array column.

    ``tag`` marks its tokens when the config marks token types; generators with
    ``needs_unigrams`` false come before the unigrams.
    """

    needs_unigrams: bool
    tag: str | None

    def generate(self, unigrams: Column, normalized: Column) -> Column: ...


@dataclass(frozen=True)
class TokenizationConfig:
    """Which word n-grams and other tokens are made; no request means unigrams."""

    nlist: Sequence[int] = ()
    mark_token_type: bool = True
    generators: tuple[TokenGenerator, ...] = ()

    def __post_init__(self):
        ns = tuple(sorted(self.nlist))
        if any(n < 1 for n in ns):
            raise ValueError("n-gram sizes must be at least 1")
        object.__setattr__(self, "nlist", ns or (() if self.generators else (1,)))

    def replace(self, **changes: Any) -> TokenizationConfig:
        return replace(self, **changes)


@dataclass(frozen=True)
class TextConfig:
    """Normalization, tokenization and token transformation."""

    normalization: NormalizationConfig = field(default_factory=NormalizationConfig)
    tokenization: TokenizationConfig = field(default_factory=TokenizationConfig)
    transformation: Any = None

    def replace(self, **changes: Any) -> TextConfig:
        return replace(self, **changes)


ColumnFn = Callable[[Column], Column]
