"""Normalization as a Column expression."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.config import NormalizationConfig
from textloom.functions import charsets as cs

_EMOJI_MARK = "👾"


def _literal(text: str) -> str:
    """``text`` as a regexp_replace replacement."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _far(chars) -> str:
    """A class of characters beyond ASCII: Java tries ranges one by one, so ASCII is ruled out first."""
    return f"[[^\\x00-\\x7F]&&[{cs.char_class(chars)}]]"


def _fast_unicode(cfg: NormalizationConfig, col: Column) -> Column:
    src, dst, expansions = cs.translation(cfg.lc, cfg.del_diac)
    out = col
    for chars, to in expansions:
        out = F.regexp_replace(out, f"[{cs.char_class(chars)}]", _literal(to))
    # most texts have none of those that become several characters
    out = F.when(col.rlike(_far("".join(chars for chars, _ in expansions))), out).otherwise(col)
    out = F.translate(out, src, dst)
    # only texts with other than ASCII pay for the table
    return F.when(col.rlike(r"[^\x00-\x7F]"), out).otherwise(col)


def _full_unicode(cfg: NormalizationConfig) -> object:
    lc, diac = cfg.lc, cfg.del_diac

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        from textloom.functions.charsets import fold

        return texts.map(lambda t: t if t is None else fold(t, lc, diac))

    return run


def normalize_col(cfg: NormalizationConfig, col: Column | str, isnormalized: bool = False, limits: bool = False) -> Column:
    """Normalized text: case, links, mentions, numbers, Unicode, blanks, punctuation, emojis, repeats, in this order.

    ``isnormalized`` passes the text through; ``limits`` pads both ends with a
    blank.  A null text stays null.
    """
    out = F.col(col) if isinstance(col, str) else col
    if not isnormalized:
        if cfg.lc:
            out = F.lower(out)
        if cfg.group_url:
            out = F.regexp_replace(out, cfg.re_url, "_url ")
        if cfg.group_usr:
            out = F.regexp_replace(out, cfg.re_user, "_usr ")
        if cfg.group_num:
            out = F.regexp_replace(out, cfg.re_num, "0 ")
        out = _full_unicode(cfg)(out) if cfg.unicode == "full" else _fast_unicode(cfg, out)
        out = F.regexp_replace(out, r"[[^\x20-\x7E]&&[\s\x{85}\p{Zs}]]", " ")
        out = F.regexp_replace(out, r"[[^\x20-\x7E]&&\p{Cc}]", "")
        if cfg.del_punc:
            out = F.regexp_replace(out, r"[\p{P}&&[^@#_]]", " ")
        if cfg.group_emo:
            marks = cfg.emojis or cs.emojis()
            out = F.regexp_replace(out, f"[{cs.char_class(marks)}]" if min(marks) < "\x80" else _far(marks), _EMOJI_MARK)
    if limits:
        out = F.concat(F.lit(" "), out, F.lit(" "))
    if cfg.del_dup and not isnormalized:
        out = F.regexp_replace(out, r"(.)\1{2,}", "$1$1")
    return out


def is_emoji(col: Column | str, emojis: frozenset[str] | None = None) -> Column:
    """Whether a one-character string is an emoji."""
    out = F.col(col) if isinstance(col, str) else col
    return out.rlike(f"^[{cs.char_class(emojis or cs.emojis())}]$")


def normalize_text(cfg: NormalizationConfig, text: str, isnormalized: bool = False) -> str:
    """The same for one string, in Python and for the full Unicode range."""
    if isnormalized:
        return text
    import regex

    out = text.lower() if cfg.lc else text
    for on, pattern, to in ((cfg.group_url, cfg.re_url, "_url "), (cfg.group_usr, cfg.re_user, "_usr "), (cfg.group_num, cfg.re_num, "0 ")):
        if on:
            out = regex.sub(pattern, to, out)
    out = cs.fold(out, cfg.lc, cfg.del_diac)
    out = regex.sub(r"[\s\p{Zs}]", " ", out)
    if cfg.del_punc:
        out = regex.sub(r"[^\P{P}@#_]", " ", out)
    if cfg.group_emo:
        marks = cfg.emojis or cs.emojis()
        out = "".join(_EMOJI_MARK if c in marks else c for c in out)
    return re.sub(r"(.)\1{2,}", r"\1\1", out, flags=re.S) if cfg.del_dup else out
