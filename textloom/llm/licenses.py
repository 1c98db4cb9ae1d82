"""License scan: a trained paragraph classifier, confirmed against templates.

Lines without a blank line between them are one paragraph.  Each line, and each
of the overlapping word windows of a paragraph (of WINDOWS words, moved by half),
is a bag of word 1-, 2- and 3-grams hashed into 2**BITS cells, scaled to unit
length.  A softmax regression over the licence families
and an unknown class is fitted to varied excerpts of templates and to ordinary
lines; a temperature fitted on held-out examples calibrates its probabilities,
and a threshold keeps ordinary held-out lines in the unknown class.  What it
names must also share enough word pairs with a template of that family; then its
extent is fitted to the words that match, and of overlapping finds the one with
most of them stays.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _text as tx
from textloom.llm.license_texts import OTHERS, TEMPLATES

BITS = 18
#: Documents whose lines serve as ordinary examples at most; bounds the fit only.
MAX_FIT_ROWS = 400
#: Least share of word pairs in common with a template.
CONFIRM = 0.6
#: Rarity of word pairs that an excerpt is taken to have at least.
LEAST = 3.0
#: Words a window.
WINDOWS = (8, 12, 24, 48)
#: Words around a find that its extent may take in, more than any template has.
MARGIN = 80
_WORD = re.compile(r"[^\W_]+")


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of all lines, first line of each text); empty texts are one empty line."""
    cut = np.flatnonzero(data == 10) + 1
    every = np.sort(np.concatenate([off[:-1], cut, off[-1:]]), kind="stable")
    # a cut at the end of a text coincides with the start of the next: an empty last line
    inside = np.searchsorted(cut, off[:-1], "right")
    return every, np.arange(len(off) - 1) + inside


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end) of each word, and the cells of the 1-, 2- and 3-grams that begin there."""
    start, end, _ = tx.tokens(data, off, tx.ALNUM)
    h = tx.hashes(tx.FOLD[data], start, end) if len(start) else np.zeros(0, np.uint64)
    two = tx.mix(h[:-1] * np.uint64(5) + h[1:])
    three = tx.mix(two[:-1] * np.uint64(7) + h[2:])
    return start, end, tuple((x >> np.uint64(64 - BITS)).astype(np.int64) for x in (h, two, three))


def spread(cells: tuple, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, cell) of all n-grams that lie in one group; ``group`` ascends by word."""
    one, two, three = cells
    same, same3 = group[1:] == group[:-1], group[2:] == group[:-2]
    return np.concatenate([group, group[:-1][same], group[:-2][same3]]), np.concatenate([one, two[same], three[same3]])


def grams(data: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, cell) of all word n-grams in order of line, and n-grams a line."""
    start, _, cells = words(data, every)
    at, cell = spread(cells, np.searchsorted(every, start, "right") - 1)
    return at, cell, np.bincount(at, minlength=len(every) - 1)


def paragraphs(line: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First word of the paragraph of each word, by the lines of the words and the first line of each text."""
    text = np.searchsorted(first, line, "right")
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(line) > 1) | (np.diff(text) > 0)])) if len(line) else np.zeros(0, np.int64)
    return np.repeat(begin, np.diff(np.append(begin, len(line))))


@dataclass
class Model:
    """Fitted classes, weights of the cells in use, biases, temperature and threshold."""

    families: list[str]
    slot: np.ndarray  # row of ``weight`` for a cell; 0 is the row of zeros
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def probabilities(self, slots: tuple, group: np.ndarray, n: int) -> np.ndarray:
        """Calibrated class probabilities of each of ``n`` groups of words, the unknown class last."""
        at, slot = spread(slots, group)
        count, c = np.bincount(at, minlength=n), len(self.bias)
        used = slot > 0
        at, slot = at[used], slot[used]
        z = np.zeros((n, c))
        if len(at):
            order = np.argsort(at, kind="stable")
            at, slot = at[order], slot[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            z[at[first]] = np.add.reduceat(self.weight[slot], first, axis=0)
        z = (z / np.sqrt(np.maximum(count, 1))[:, None] + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)


def pairs(text: str) -> set[tuple[str, str]]:
    """Word pairs of a text, small letters; a single word pairs with nothing."""
    w = _WORD.findall(text.lower())
    return set(zip(w, w[1:]))


_PAIRS = {f: [pairs(t) for t in ts] for f, ts in TEMPLATES.items()}
_FAMILIES = Counter(p for ts in _PAIRS.values() for p in set().union(*ts))


def rarity(some: set[tuple[str, str]]) -> float:
    """Weight of word pairs: each counts one over the number of families whose templates have it."""
    return sum(1 / _FAMILIES.get(p, 1) for p in some)


def similarity(text: str, family: str) -> float:
    """Greatest share of word pairs in common with a template of the family, pairs weighted by rarity.

    The share is of the paragraph's pairs (an excerpt) or of the template's (a
    notice inside a longer paragraph), whichever is less, but of no less than
    LEAST where the template has that much: a few common words confirm nothing.
    """
    p, best = pairs(text), 0.0
    own = rarity(p)
    for t in _PAIRS[family]:
        shared, whole = p & t, rarity(t)
        if len(shared) >= 2:
            best = max(best, rarity(shared) / max(min(own, whole), min(whole, LEAST)))
    return best


def extent(own: list[str], lo: int, hi: int, family: str) -> tuple[int, int, int]:
    """(first, past last, score): the stretch of ``own`` that best matches a template and meets words lo to hi.

    Word pairs of the template score 1 and others -1.
    """
    out = (lo, hi, 0)
    for t in _PAIRS[family]:
        run = np.concatenate([[0], np.cumsum([1 if p in t else -1 for p in zip(own, own[1:])])]).astype(int)
        inner = run[lo:hi]
        b = lo + int(np.argmax(inner - np.minimum.accumulate(inner)))
        a = b - int(np.argmin(run[lo : b + 1][::-1]))
        b += int(np.argmax(run[b:]))
        a -= int(np.argmin(run[: a + 1][::-1]))
        if run[b] - run[a] > out[2]:
            out = (a, b + 1, int(run[b] - run[a]))
    return out


def find(model: Model, data: np.ndarray, every: np.ndarray, first: np.ndarray) -> list[tuple[int, str, float, float]]:
    """(line where it begins, family, probability, similarity) of the licence notices of texts cut into lines."""
    start, end, cells = words(data, every)
    if not len(start):
        return []
    line = np.searchsorted(every, start, "right") - 1
    begin = paragraphs(line, first)
    rank = np.arange(len(start)) - begin
    slots = tuple(model.slot[c] for c in cells)
    heads = [np.concatenate([[True], line[1:] != line[:-1]])]
    heads += [(rank == 0) | (rank % size == shift) for size in WINDOWS for shift in (0, size // 2)]
    found, seen = [], set()
    for head in heads:
        at = np.flatnonzero(head)
        past = np.append(at[1:], len(start))
        p = model.probabilities(slots, np.cumsum(head) - 1, len(at))
        best = p[:, :-1].argmax(1)
        top = p[np.arange(len(p)), best]
        for i in np.flatnonzero(top >= model.threshold):
            lo, hi, f = int(at[i]), int(past[i]), model.families[best[i]]
            if (lo, hi) in seen:
                continue
            seen.add((lo, hi))
            if similarity(data[start[lo] : end[hi - 1]].tobytes().decode("utf-8", "replace"), f) < CONFIRM:
                continue
            a, b = max(int(begin[lo]), lo - MARGIN), min(hi + MARGIN, len(start))
            b = a + int(np.searchsorted(begin[a:b], begin[lo], "right"))
            own = ["".join(_WORD.findall(data[start[w] : end[w]].tobytes().decode("utf-8", "replace").lower())) for w in range(a, b)]
            x, y, score = extent(own, lo - a, hi - a, f)
            found.append((-score, -round(float(top[i]), 6), a + x, a + y, f, round(similarity(" ".join(own[x:y]), f), 6)))
    taken, out = np.zeros(len(start), bool), {}
    for _, p, a, b, f, s in sorted(found):
        if not taken[a:b].any():
            taken[a:b] = True
            out.setdefault((int(line[a]), f), (-p, s))
    return sorted((*k, *v) for k, v in out.items())


def _examples(ordinary: list[str], rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    families = list(TEMPLATES)
    texts, y = [], []
    filler = [w for t in ordinary for w in t.split()] or ["x"]
    for f, ts in enumerate(TEMPLATES.values()):
        for t in ts:
            w = t.split()
            for k in range(24):
                own = list(w)
                if k % 3 == 1 and len(own) > 8:  # an excerpt, every other time a short one
                    n = int(rng.integers(len(own) * 6 // 10, len(own) + 1)) if k % 2 else int(rng.integers(6, len(own) + 1))
                    a = int(rng.integers(0, len(own) - n + 1))
                    own = own[a : a + n]
                if k % 3 == 2:  # surroundings
                    n = int(rng.integers(1, 7 if k % 2 else max(8, len(own) + 1)))  # every other time as much as a window may have
                    extra = [filler[i] for i in rng.integers(0, len(filler), n)]
                    cut = int(rng.integers(0, n + 1)) if k % 2 == 0 else n if rng.random() < 0.5 else 0
                    own = extra[:cut] + own + extra[cut:]
                if k % 4 == 3 and len(own) > 12:  # a slip
                    own[int(rng.integers(len(own)))] = filler[int(rng.integers(len(filler)))]
                texts.append(" ".join(own) if k % 5 else " ".join(own).upper())
                y.append(f)
    words = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    unknown = len(families)
    for t in OTHERS * 6 + [" ".join(words[i] for i in rng.integers(0, len(words), int(rng.integers(3, 25)))) for _ in range(300)] + ordinary:
        texts.append(t)
        y.append(unknown)
    return texts, np.array(y)


def _flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return tx.flat(pa.array([t.replace("\n", " ") for t in texts], pa.string()))


def fit_lines(ordinary: list[str], seed: int = 5, steps: int = 120, decay: float = 1e-4) -> Model:
    """Fit on templates and on lines taken as unknown; those that match a template are left out."""
    rng = np.random.default_rng(seed)
    plain = [t for t in ordinary if t.strip() and max(similarity(t, f) for f in TEMPLATES) < CONFIRM]
    texts, y = _examples(plain, rng)
    data, off = _flatten(texts)
    at, cell, count = grams(data, off)
    n, c = len(texts), len(TEMPLATES) + 1
    # cells that templates use, or several ordinary lines do; others keep weight 0
    often = np.bincount(cell, minlength=1 << BITS) >= 4
    often[cell[y[at] < c - 1]] = True
    at, cell = at[often[cell]], cell[often[cell]]
    cells, col = np.unique(cell, return_inverse=True)
    value = 1 / np.sqrt(np.maximum(count, 1))[at]
    held = rng.random(n) < 0.25
    share = np.bincount(y, minlength=c)
    size = np.where(held, 0, 1 / np.sqrt(share[y]))
    size /= size.sum()
    order = np.argsort(at, kind="stable")
    row_at, row_col, row_val = at[order], col[order], value[order]
    row_first = np.flatnonzero(np.concatenate([[True], row_at[1:] != row_at[:-1]]))
    by_col = np.argsort(col, kind="stable")
    col_first = np.flatnonzero(np.concatenate([[True], np.diff(col[by_col]) > 0]))
    w, b = np.zeros((len(cells), c)), np.zeros(c)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(c), np.zeros(c)

    def logits() -> np.ndarray:
        z = np.tile(b, (n, 1))
        z[row_at[row_first]] += np.add.reduceat(w[row_col] * row_val[:, None], row_first, axis=0)
        return z

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for step in range(1, steps + 1):
        g = soft(logits())
        g[np.arange(n), y] -= 1
        g *= size[:, None]
        gw = np.add.reduceat(g[at[by_col]] * value[by_col][:, None], col_first, axis=0) + decay * w
        gb = g.sum(0)
        for p, m, v, d in ((w, mw, vw, gw), (b, mb, vb, gb)):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z = logits()[held]
    t = min(np.geomspace(0.1, 10, 60), key=lambda t: -np.log(np.maximum(soft(z / t)[np.arange(len(z)), y[held]], 1e-12)).sum())
    strange = soft(z / t)[y[held] == c - 1, :-1].max(1)
    threshold = max(0.5, float(np.quantile(strange, 0.999))) if len(strange) else 0.5
    slot = np.zeros(1 << BITS, np.int32)
    slot[cells] = np.arange(1, len(cells) + 1)
    return Model(list(TEMPLATES), slot, np.concatenate([np.zeros((1, c)), w]).astype(np.float32), b, float(t), min(threshold, 0.9))


def fit(docs: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Model:
    """Fit with the lines of the ``max_rows`` documents whose ids hash lowest as ordinary examples."""
    chosen = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # ids alone, no more than the documented bound
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.split("text", "\n").alias("lines")).toArrow().sort_by("doc_id")
    return fit_lines([t for r in rows.column("lines").to_pylist()[:max_rows] for t in r])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Licence paragraphs of all of ``docs``.

    Returns doc_id, paragraph (number from 0 of the line where the notice
    begins), family, probability and similarity (rounded to 6 digits), one row
    per line and family.  Notices may lie inside a longer line or run over
    several.  Of finds that overlap the one that matches most words stays, of
    equal ones the more probable, then the earlier, then the family first in
    the alphabet.  Null and empty texts have none, very long ones are read
    whole; a null id stays null; repeated rows are reported once each; an
    empty table gives none.  Other columns are not read.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)  # some MB, set by the templates and the sample bound

    def run(batches):
        m = handle.value
        for b in batches:
            ids = b.column("doc_id")
            data, off = tx.flat(b.column("text"))
            take, number, family, prob, sim = [], [], [], [], []
            for lo, hi in tx.pieces(off):
                part = data[off[lo] : off[hi]]
                every, first = lines(part, off[lo : hi + 1] - off[lo])
                for i, f, p, s in find(m, part, every, first):
                    d = int(np.searchsorted(first, i, "right")) - 1
                    take.append(lo + d)
                    number.append(i - first[d])
                    family.append(f)
                    prob.append(p)
                    sim.append(s)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), pa.array(number, pa.int32()), pa.array(family, pa.string()), pa.array(prob, pa.float64()), pa.array(sim, pa.float64())], ["doc_id", "paragraph", "family", "probability", "similarity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, paragraph int, family string, probability double, similarity double")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, fit(docs))
