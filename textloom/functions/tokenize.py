"""Tokenization as Column expressions."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.config import TextConfig
from textloom.functions import charsets as cs
from textloom.functions.normalize import normalize_col

_P = r"!-#%-*,-/:;?@\[-\]_{}~$+<>^|"
#: Tokens of normalized ASCII text (Java and RE2).
ASCII = f"[{_P}]{{0,2}}[#@_][^ {_P}]+|[{_P}]{{1,3}}|[^ {_P}]+"




def _listed(points) -> str:
    """Body of a bracket expression of characters below 256 one by one: Java looks these up in a table, ranges it compares in turn."""
    return "".join(f"\\x{{{i:X}}}" for i in points)


#: ``ASCII`` in this form.
_JAVA_ASCII = ASCII.replace(_P, _listed(i for i in range(128) if re.match(f"[{_P}]", chr(i))))
#: Letters and digits that are common and part of words: neither punctuation nor emojis.
_FAST = f"[{_listed(i for i in range(256) if i < 128 and chr(i).isalnum() or i >= 0xC0)}][\\x{{100}}-\\x{{24F}}]"


@lru_cache
def full_pattern() -> str:
    """Tokens of any normalized text: punctuation runs of at most 3 bytes or so, emojis alone, words."""
    e = cs.char_class(cs.emojis())
    one, two, three = cs.punctuation()
    w = f"[^ {e}{one}{two}{three}]"
    return (
        f"[{e}]|(?:[{one}]{{0,2}}[#@_]|[{two}][#@_]){w}+|[{three}]|[{two}][{one}{two}{three}]?"
        f"|[{one}](?:[{one}][{one}{two}{three}]?|[{two}{three}])?|{w}+"
    )


@lru_cache
def java_pattern() -> str:
    """``full_pattern`` for Java, which tries the ranges of a class one by one: common characters are told first."""
    e = cs.char_class(cs.emojis())
    one, two, three = cs.punctuation()
    one = _listed(i for i in range(128) if re.match("[" + one.replace("{", "").replace("}", "") + "]", chr(i)))
    far = r"(?=[^\x00-\x7F])"
    w = f"[[{_FAST}][[^ {one}]&&[^{e}{two}{three}]]]"
    mark = f"[[{one}][[^\\x00-\\x7F]&&[{two}{three}]]]"
    return (
        f"(?! )(?:[{_FAST}]{w}*|{far}[{e}]|(?:[{one}]{{0,2}}[#@_]|{far}[{two}][#@_]){w}+|{far}[{three}]|{far}[{two}]{mark}?"
        f"|[{one}](?:[{one}]{mark}?|{far}[{two}{three}])?|{w}+)"
    )


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_tokens(normalized: Column | str) -> Column:
    """Unigrams of normalized text."""
    n = _col(normalized)
    plain = F.regexp_extract_all(n, F.lit(_JAVA_ASCII), F.lit(0))
    return F.when(n.rlike(r"[^\x00-\x7F]"), F.regexp_extract_all(n, F.lit(java_pattern()), F.lit(0))).otherwise(plain)


def ngrams(unigrams: Column, q: int) -> Column:
    """Word q-grams joined by blanks."""
    n = F.size(unigrams) - q + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(unigrams, i, q), " "))).otherwise(F.array().cast("array<string>"))


def assemble(cfg: TextConfig, unigrams: Column, normalized: Column) -> Column:
    """All tokens in order: generators without unigrams, unigrams, n-grams by size, other generators."""
    t = cfg.tokenization

    def marked(tokens: Column, tag: str | None) -> Column:
        tokens = F.filter(tokens, lambda x: x != "")
        return F.transform(tokens, lambda x: F.concat(x, F.lit("\t" + tag))) if t.mark_token_type and tag else tokens

    parts = [marked(g.generate(unigrams, normalized), g.tag) for g in t.generators if not g.needs_unigrams]
    parts += [unigrams if n == 1 else marked(ngrams(unigrams, n), "n") for n in t.nlist]
    parts += [marked(g.generate(unigrams, normalized), g.tag) for g in t.generators if g.needs_unigrams]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def tokens_col(cfg: TextConfig, text: Column | str, isnormalized: bool = False) -> Column:
    """Tokens of a text column."""
    norm = normalize_col(cfg.normalization, _col(text), isnormalized)
    uni = split_tokens(norm)
    return assemble(cfg, cfg.transformation.apply(uni) if cfg.transformation else uni, norm)


def field_tokens_col(cfg: TextConfig, fields: Column | str, isnormalized: bool = False) -> Column:
    """Tokens of an array of texts that form one document; no n-gram crosses a field."""
    return F.flatten(F.transform(_col(fields), lambda x: tokens_col(cfg, x, isnormalized)))


def _split(text: Column, pattern: str, cfg: TextConfig | None) -> Column:
    blank = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    trim = lambda x: F.regexp_replace(x, blank, "")
    parts = F.filter(F.transform(F.split(text, pattern), trim), lambda x: x != "")
    if cfg is None:
        return parts
    return F.filter(F.transform(parts, lambda x: trim(normalize_col(cfg.normalization, x))), lambda x: x != "")


def paragraphs_col(text: Column | str, cfg: TextConfig | None = None) -> Column:
    """Paragraphs (separated by blank lines), trimmed, empty ones dropped, normalized if ``cfg`` is given."""
    return _split(_col(text), r"(?:\r?\n){2,}", cfg)


def sentences_col(text: Column | str, cfg: TextConfig | None = None) -> Column:
    """Sentences (ended by .!? and a blank, or by a line), trimmed, empty ones dropped, normalized if ``cfg`` is given."""
    return _split(_col(text), r"(?<=[.!?])\s+|[\r\n]+", cfg)
