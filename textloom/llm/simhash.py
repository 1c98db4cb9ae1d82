"""SimHash near-dedup over nodes of equal shingle bins and a Gray-order hierarchical index.

A text's fingerprint is 64 signed sums over its distinct words; a sketch of its
three-word shingles (the least shingle of each of BINS bins, one byte each) goes
along and confirms pairs by their share of equal bins, so texts that only use
the same words stay apart.  A pair that is confirmed has two equal bins in one
run of bins (``runs``), so each choice of two bins of a run, with their bytes, is
a node and tells which task holds it; ``keys`` has the case of texts of a few
shingles.  The fingerprints of a node are compared each with each up to LIMIT.

A node beyond that is split: two fingerprints within ``RADIUS`` bits agree on at
least ``AGREE`` of ``BLOCKS`` bit blocks, whichever they are, and for each choice
the fingerprints that agree are sorted by Gray rank and grouped by FANOUT, level
by level; an inner node keeps the mask of bits its members share and their
pattern.  Pairs of nodes are pruned as soon as the differences on commonly
masked bits exceed the radius, or when all their members are known to be one
group; surviving leaves are compared in full.  The search is exact.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _text as tx
from textloom.llm._shared import Scratch, partitions

RADIUS = 10
BLOCKS = 12
AGREE = 2
#: Bins of the shingle sketch, and the least share of bins (of those either text fills) that near copies have in common.
BINS = 24
SHARE = 0.25
#: Rows of the index a task.
ROWS = 1_500_000
#: Rows of a node that are compared each with each, and rows that are compared at once.
LIMIT = 8192
SPAN = 1 << 15
FANOUT = 8
#: Ids of dropped documents that are sent to all executors (16 MB) rather than shuffled to.
BROADCAST_IDS = 2_000_000

assert BLOCKS - RADIUS >= AGREE
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, sketch, has words) of each text: sign sums over distinct folded words, and bins of shingles."""
    n = len(offsets) - 1
    start, end, doc = tx.tokens(data, offsets, tx.ALNUM)
    out = np.zeros((n, 64), np.int32)
    has = np.zeros(n, bool)
    bins = np.zeros((n, BINS), np.uint8)
    if len(start):
        h = tx.hashes(tx.FOLD[data], start, end)
        bins = sketches(h, doc, n)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        last = np.append(first[1:], len(doc))
        wide = h[:, None].view(np.uint8)
        # texts of many words are summed in slices
        for a in range(0, len(first), 64):
            lo, hi = first[a], last[min(a + 64, len(first)) - 1]
            bits = np.unpackbits(wide[lo:hi], axis=1, bitorder="little")
            out[doc[first[a : a + 64]]] = np.add.reduceat(bits, first[a : a + 64] - lo, axis=0, dtype=np.int32)
        count = np.zeros(n, np.int64)
        count[doc[first]] = last - first
        has = count > 0
        out = 2 * out > count[:, None]
    return np.packbits(out > 0, axis=1, bitorder="little").view(np.uint64)[:, 0], bins, has


def sketches(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """One byte a bin and text: of the least shingle in it, 0 where there is none.  ``doc`` ascends by word.

    A shingle is three words, or all words of a text that has fewer.
    """
    many = np.bincount(doc, minlength=n)
    three = doc[2:] == doc[:-2]
    shingle, own = tx.windows(h, 3)[three], doc[:-2][three]
    begin = np.cumsum(many) - many
    for k in (1, 2):
        few = np.flatnonzero(many == k)
        x = h[begin[few]] if k == 1 else tx.mix(h[begin[few]] * np.uint64(3) + h[begin[few] + 1])
        shingle, own = np.concatenate([shingle, x]), np.concatenate([own, few])
    place = own * BINS + ((shingle >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    least = np.full(n * BINS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    value = tx.mix(shingle + np.uint64(0x5EED)) >> np.uint64(1)
    np.minimum.at(least, place, value)
    return np.where(least == np.uint64(0xFFFFFFFFFFFFFFFF), 0, 1 + least % np.uint64(255)).astype(np.uint8).reshape(n, BINS)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sketches in the rows of ``x`` and ``y`` share enough of their filled bins."""
    same = ((x == y) & (x > 0)).sum(1)
    return same >= SHARE * ((x | y) > 0).sum(1)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit value in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def runs(share: int) -> list[list[int]]:
    """The bins in ``share`` - 1 runs (one at least): of ``share`` bins, two are in one run.  Fewer runs are unions of more."""
    most = ceil(SHARE * BINS) - 1
    out = [list(range(BINS * i // most, BINS * (i + 1) // most)) for i in range(most)]
    while len(out) > max(1, share - 1):
        x, y, *rest = sorted(out, key=len)
        out = [*rest, x + y]
    return out


def bin_pairs() -> list[tuple[int, int, int]]:
    """(bin, bin, most bins that a text may have to share for the two to be a key), those of most first."""
    most = {}
    for share in range(2, ceil(SHARE * BINS) + 1):
        for own in runs(share):
            most |= {c: share for c in combinations(sorted(own), 2)}
    return sorted(((x, y, share) for (x, y), share in most.items()), key=lambda c: -c[2])


def keys(a: np.ndarray, sketch: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) for fingerprints and sketches: rows that are ``alike`` within ``radius`` bits have a node in common.

    Alike rows share SHARE of the bins that the fuller one fills, thus two bins
    of one of its ``runs``; the other row has that pair among its keys as well,
    since its runs are the same or longer.  Rows that need not share more than
    one bin are keyed by each of theirs too, along with a block of bits: of one
    block more than the bits that may differ, one is equal.
    """
    need = np.ceil(SHARE * (sketch > 0).sum(1)).astype(np.int64)
    order = np.argsort(need, kind="stable")
    until = np.searchsorted(need[order], np.arange(BINS + 1), "right")
    column = sketch[order].T.astype(np.int64)
    rows, out = [], []
    for i, (x, y, share) in enumerate(bin_pairs()):
        b, c = column[x, : until[share]], column[y, : until[share]]
        at = np.flatnonzero((b > 0) & (c > 0))
        rows.append(order[at])
        out.append(i << 16 | b[at] << 8 | c[at])
    few = order[: until[1]]
    for x in range(BINS) if len(few) else ():
        own = few[sketch[few, x] > 0]
        for k, mask in enumerate(block_masks(radius + 1)):
            bits = (a[own] & np.uint64(mask)) // np.uint64(mask & -mask)
            rows.append(own)
            # nodes that fall together by chance only add comparisons
            out.append(tx.mix(bits + np.uint64((x << 8 | k) << 40) + (sketch[own, x].astype(np.uint64) << np.uint64(32)) + np.uint64(1 << 56)).view(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def block_masks(blocks: int = BLOCKS) -> list[int]:
    """Bit masks of ``blocks`` nearly equal runs of the 64 bits."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:])]


def upper_masks(blocks: int = BLOCKS, agree: int = AGREE) -> np.ndarray:
    """Masks of the upper nodes: every choice of ``agree`` blocks."""
    return np.array([sum(c) for c in combinations(block_masks(blocks), agree)], np.uint64)


class Forest:
    """Connected groups of the rows of one task (minimum label wins)."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root(a), self.root(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if len(a):
                np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))

    def root(self, x: np.ndarray) -> np.ndarray:
        p = self.parent[x]
        while True:
            up = self.parent[p]
            if (up == p).all():
                self.parent[x] = p
                return p
            p = up


def _levels(f: np.ndarray, group: np.ndarray):
    """Node levels from the leaves up: (first row or child, last, group, mask, pattern)."""

    def fold(first, last, grp, mask, pattern, unit):
        # nodes of FANOUT neighbours that never span two groups
        begin = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
        rank = np.arange(len(grp)) - np.repeat(begin, np.diff(np.append(begin, len(grp))))
        at = np.flatnonzero(rank % FANOUT == 0)
        ones = np.bitwise_and.reduceat(pattern, at)
        zeros = np.bitwise_and.reduceat(~pattern & mask, at)
        ones &= np.bitwise_and.reduceat(mask, at)
        return at, np.append(at[1:], len(grp)), grp[at], ones | zeros, ones

    first, last = np.arange(len(f)), np.arange(1, len(f) + 1)
    level = (first, last, group, np.full(len(f), _ONES), f)
    out = []
    while True:
        nxt = fold(*level, None)
        out.append(nxt)
        if len(nxt[0]) == len(np.unique(nxt[2])):
            return out
        level = nxt


def node_pairs(f: np.ndarray, size: np.ndarray, radius: int = RADIUS):
    """Yield (i, j) arrays, i < j, of rows of one node within ``radius`` bits.

    Nodes of ``size`` rows follow each other, the largest first; each row is
    compared with the k-th after it, for all k at once over SPAN rows.
    """
    end = np.cumsum(size)
    g = 0
    while g < len(size) and size[g] > 1:
        base = end[g] - size[g]
        h = max(g + 1, int(np.searchsorted(end, base + SPAN, "right")))
        own, last = f[base : end[h - 1]], np.repeat(end[g:h] - base, size[g:h])
        # nodes of more than k rows come first
        more = np.searchsorted(-size[g:h], -np.arange(size[g]))
        for k in range(1, size[g]):
            n = end[g + more[k] - 1] - base
            x = np.flatnonzero(np.bitwise_count(own[: n - k] ^ own[k:n]) <= radius)
            x = x[x + k < last[x]]
            if len(x):
                yield base + x, base + x + k
        g = h


def near_pairs(f: np.ndarray, group: np.ndarray, label: np.ndarray, radius: int = RADIUS, budget: int = 1 << 20):
    """Yield (i, j) arrays, i < j, of rows of one group and two labels within ``radius`` bits.

    Rows must be sorted by group and Gray rank.  ``budget`` bounds the pairs
    held at once, not those found.
    """
    if len(f) < 2:
        return
    levels = _levels(f, group)
    top = len(levels) - 1
    low, high = [label], [label]
    for at, *_ in levels:
        low.append(np.minimum.reduceat(low[-1], at))
        high.append(np.maximum.reduceat(high[-1], at))
    roots = np.arange(len(levels[top][0]))
    stack = [(top, roots, roots)]
    while stack:
        at, a, b = stack.pop()
        if len(a) > budget // (FANOUT * FANOUT) and len(a) > 1:
            half = len(a) // 2
            stack += [(at, a[:half], b[:half]), (at, a[half:], b[half:])]
            continue
        first, last, _, _, _ = levels[at]
        na, nb = last[a] - first[a], last[b] - first[b]
        total = na * nb
        rep = np.repeat(np.arange(len(a)), total)
        k = np.arange(len(rep)) - np.repeat(np.cumsum(total) - total, total)
        x = first[a][rep] + k // nb[rep]
        y = first[b][rep] + k % nb[rep]
        inner = x <= y if at else x < y
        x, y = x[inner], y[inner]
        apart = np.minimum(low[at][x], low[at][y]) != np.maximum(high[at][x], high[at][y])
        x, y = x[apart], y[apart]
        if at:
            mask, pattern = levels[at - 1][3], levels[at - 1][4]
            # accumulated differences on the bits that both nodes share
            near = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= radius
            x, y = x[near], y[near]
            if len(x):
                stack.append((at - 1, x, y))
        else:
            near = np.bitwise_count(f[x] ^ f[y]) <= radius
            if near.any():
                yield x[near], y[near]


_SKETCH = [f"s{i}" for i in range(BINS // 8)]
_PRINT = ", ".join(f"{c} long" for c in ("a", *_SKETCH))


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, a, s0, ...): fingerprint and sketch of every text with an id and a word."""

    def run(batches):
        for batch in batches:
            data, off = tx.flat(batch.column("text"))
            n = len(off) - 1
            a, s, has = np.zeros(n, np.uint64), np.zeros((n, BINS), np.uint8), np.zeros(n, bool)
            for lo, hi in tx.pieces(off):
                a[lo:hi], s[lo:hi], has[lo:hi] = fingerprints(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            words = np.ascontiguousarray(s).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a.view(np.int64)), *(pa.array(words[:, i]) for i in range(len(_SKETCH)))], ["doc_id", "a", *_SKETCH]).filter(pa.array(has))

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInArrow(run, f"doc_id long, {_PRINT}")


def node_links(node: np.ndarray, rep: np.ndarray, a: np.ndarray, sketch: np.ndarray, radius: int = RADIUS, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) of a spanning forest of the near pairs in all nodes."""
    order = np.argsort(node)
    begin = np.flatnonzero(np.diff(node[order], prepend=node[order[:1]] - 1))
    size = np.diff(begin, append=len(node))
    # largest first, without nodes of one row
    by = np.argsort(-size, kind="stable")[: (size > 1).sum()]
    size = size[by]
    order = order[np.arange(size.sum()) + np.repeat(begin[by] - np.cumsum(size) + size, size)]
    a, sketch = a[order], sketch[order]
    ids, local = np.unique(rep[order], return_inverse=True)
    forest = Forest(len(ids))

    def link(x, y):
        # a pair whose ends are connected already needs no look at its texts
        apart = forest.root(local[x]) != forest.root(local[y])
        x, y = x[apart], y[apart]
        good = alike(sketch[x], sketch[y])
        forest.join(local[x[good]], local[y[good]])

    large = int((size > limit).sum())
    split = int(size[:large].sum())
    owner = np.repeat(np.arange(large), size[:large])
    for mask in upper_masks() if large else ():
        part = a[:split] & mask
        at = np.lexsort((gray_rank(a[:split]), part, owner))
        own, new = a[at], np.ones(split, bool)
        new[1:] = (part[at[1:]] != part[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
        group = np.cumsum(new)
        # neighbours first: what they connect is skipped below
        for k in (1, 2, 4, 8):
            x = np.flatnonzero((group[k:] == group[:-k]) & (np.bitwise_count(own[k:] ^ own[:-k]) <= radius))
            link(at[x], at[x + k])
        for x, y in near_pairs(own, group, forest.root(local[at]), radius):
            link(at[x], at[y])
    for x, y in node_pairs(a[split:], size[large:], radius):
        link(split + x, split + y)
    root = forest.root(np.arange(len(ids)))
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(src, dst) edges that connect the same groups as all near pairs of ``nodes`` (rep, a, s0, ...).

    Each task replaces its pairs by a spanning forest, so a group of n costs n
    rows a task, not n squared.  The number of tasks follows the rows.
    """

    def columns(t):
        a = t.column("a").to_numpy().view(np.uint64)
        return a, np.stack([t.column(c).to_numpy() for c in _SKETCH], 1).view(np.uint8)

    def scatter(batches):
        for batch in batches:
            # many keys: a few thousand rows at a time keep the batch small
            for lo in range(0, batch.num_rows, 2048):
                own = batch.slice(lo, 2048)
                row, node = keys(*columns(own), radius)
                yield pa.RecordBatch.from_arrays([pa.array(node), *own.take(pa.array(row)).columns], ["node", *own.schema.names])

    def search(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        src, dst = node_links(t.column("node").to_numpy(), t.column("rep").to_numpy(), *columns(t), radius, limit)
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    assert BLOCKS - radius >= AGREE
    spread = nodes.select("rep", "a", *_SKETCH).mapInArrow(scatter, f"node long, rep long, {_PRINT}")
    # full sketches have as many keys; others have fewer but for a few
    each = sum(share == ceil(SHARE * BINS) for *_, share in bin_pairs())
    tasks = partitions(nodes.sparkSession, nodes.count() * each, ROWS)
    return spread.repartition(tasks, "node").mapInArrow(search, "src long, dst long").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges`` (src, dst): alternating large and small stars until nothing moves."""
    step = 0
    now = scratch.write(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges0")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        # larger neighbours point to the least of the neighbourhood
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("low"))
        # smaller neighbours and the node itself do so too
        small = large.join(least, "src").select(F.explode(F.array("dst", "src")).alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        step += 1
        now = scratch.write(small, f"edges{step}")
        scratch.drop(f"edges{step - 1}")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        before = state


def groups(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Near copies: doc_id, keep_id, one row per document that is not kept.

    Documents whose fingerprints differ in at most RADIUS bits and whose
    shingle sketches share at least SHARE of their filled bins are linked;
    ``keep_id`` is the least id of the connected group.  Ids are documents:
    rows that share an id are one document, linked through each of its texts.
    Rows with a null id or text, and texts without a word, belong to no group;
    texts are read whole, however long.  An empty table gives none.  Other
    columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    each = scratch.write(prints(docs), "prints")
    nodes = scratch.write(each.groupBy("a", *_SKETCH).agg(F.min("doc_id").alias("rep")), "nodes")
    near = links(nodes)
    copies = each.join(nodes, ["a", *_SKETCH]).where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    members = components(near.unionByName(copies), scratch)
    scratch.drop("prints", "nodes")
    return members.select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"))


def drop_near(docs: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` without the documents that ``groups`` doesn't keep, all columns and rows otherwise as given.

    Rows with a null id or text, and texts without a word, stay; so do all rows
    of a kept id.  An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    gone = scratch.write(groups(docs, scratch).select(F.col("doc_id").alias("__gone")), "gone")
    few = gone.count() <= broadcast_ids
    row = docs.select(F.col("doc_id").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return row.join(F.broadcast(gone) if few else gone, F.col("__id") == F.col("__gone"), "left_anti").select("__row.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Near copies among all documents."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
