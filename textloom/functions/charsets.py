"""Character classes and folding tables, derived from Unicode data at import."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

#: Emoji characters as hexadecimal ranges.
_EMOJI = (
    "a9,ae,200d,203c,2049,20e3,2122,2139,2194:6,21a9:2,231a:2,2328,2388,23cf,23e9:11,23f8:3,24c2,25aa:2,25b6,25c0,25fb:4,2600:6,2607:12,2614:114,2690:118,2708:11,2714,2716,271d,2721,"
    "2728,2733:2,2744,2747,274c,274e,2753:3,2757,2763:5,2795:3,27a1,27b0,27bf,2934:2,2b05:3,2b1b:2,2b50,2b55,3030,303d,3297,3299,fe0f,1f000:256,1f10d:3,1f12f,1f16c:6,1f17e:2,1f18e,"
    "1f191:10,1f1ad:83,1f201:15,1f21a,1f22f,1f232:9,1f23c:4,1f249:245,1f546:266,1f680:128,1f774:12,1f7d5:43,1f80c:4,1f848:8,1f85a:6,1f888:8,1f8ae:82,1f90c:47,1f93c:10,1f947:1719,e0020:96"
)
#: Symbols treated as punctuation by the tokenizer besides category P.
EXTRA_PUNCT = "~+^$|<>"
#: Punctuation that may begin a word.
META = "#@_"
_EXPANDED = "ßẞ…‥ﬀﬁﬂﬃﬄﬅﬆĳĲŉ½¼¾™№‼⁇⁈⁉ǆǅǄǉǈǇǌǋǊǳǲǱ"


@lru_cache
def emojis() -> frozenset[str]:
    out = []
    for part in _EMOJI.split(","):
        at, _, n = part.partition(":")
        out += range(int(at, 16), int(at, 16) + int(n or 1))
    return frozenset(map(chr, out))


def char_class(chars) -> str:
    """Body of a bracket expression (Java and RE2) holding exactly ``chars``."""
    points = sorted(map(ord, chars))
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:X}}}" + (f"-\\x{{{points[j]:X}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


@lru_cache
def punctuation() -> tuple[str, str, str]:
    """Classes of punctuation whose UTF-8 form takes 1, 2 and 3 or more bytes, without emojis."""
    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    punct = {c for c in every if unicodedata.category(c)[0] == "P"} | set(EXTRA_PUNCT)
    punct -= emojis()
    sized: tuple[list, list, list] = ([], [], [])
    for c in punct:
        sized[min(len(c.encode()), 3) - 1].append(c)
    one, two, three = map(char_class, sized)
    return one, two, three


def fold(text: str, casefold: bool, stripmark: bool) -> str:
    """Compatibility normalization with optional case folding and mark removal; controls dropped or blanked."""
    t = unicodedata.normalize("NFKD", text)
    if casefold:
        t = unicodedata.normalize("NFKD", t.casefold())
    if stripmark:
        t = "".join(c for c in t if unicodedata.category(c)[0] != "M")
    t = unicodedata.normalize("NFKC", t)
    return "".join(" " if c in "\t\n\v\f\r\x85" else "" if unicodedata.category(c) == "Cc" else c for c in t)


@lru_cache
def translation(casefold: bool, stripmark: bool) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, expansions) of characters that fold to another one; those that vanish come last in ``from``."""
    src, dst, gone = [], [], []
    for i in range(0x80, 0x20000):
        if 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7B0:
            continue
        c = chr(i)
        f = fold(c, casefold, stripmark)
        if f == c:
            continue
        if len(f) == 1:
            src.append(c)
            dst.append(f)
        elif not f:
            gone.append(c)
    groups: dict[str, str] = {}
    for c in _EXPANDED:
        f = fold(c, casefold, stripmark)
        if len(f) > 1:
            groups[f] = groups.get(f, "") + c
    return "".join(src + gone), "".join(dst), tuple((cs, f) for f, cs in groups.items())
