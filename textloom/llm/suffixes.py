"""Repeated passages found by sorting the suffixes of all texts.

A suffix is a word position; its key is the LENGTH words that follow: their
first eight bytes as they are written (words a blank apart), which order
suffixes by their leading tokens, then three hashes of 16, 17 and 17 words,
which tell equal ones from others.

1. Anchors: positions whose 10-word hash is least within some stretch of
   LENGTH - 9 positions.  Every passage of LENGTH words holds one, chosen by its
   own words only, so a passage can repeat only if its anchors do.  Sorting the
   anchors (one suffix in twenty) rules out most of the corpus, exactly.
   Anchors that a task meets several times send one row on to be compared, so a
   passage that very many texts share never gathers in one place.
2. Splitters sampled from the repeated anchors range-partition the remaining
   suffixes by their leading tokens.  Each bucket is sorted by multikey
   quicksort: three-way partition by one letter, the equal part goes on to the
   next letter, small parts are finished by a plain sort.
3. A suffix so frequent that it fills buckets has equal splitters and is spread
   over the buckets between them; such groups are compared across buckets.
4. Positions of suffixes that occur at two or more places return to their
   documents and merge into spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _text as tx
from textloom.llm._shared import Scratch, partitions

#: Words of the shortest passage reported.
LENGTH = 50
#: Words of an anchor's hash, and of the hashes of a suffix.
_LEAD = 10
_LETTERS = (16, 17, 17)
_STRETCH = LENGTH - _LEAD + 1
#: Positions of repeated anchors sent to all executors, in bytes; above it documents are joined by shuffle.
BROADCAST_BYTES = 48 << 20
_SPLITTERS_A_BUCKET = 64
#: Documents a group of anchors, and bytes of suffixes a bucket, about.
_DOCS = 50_000
_BUCKET_BYTES = 16 << 20
#: Parts of a bucket up to this size are sorted plainly.
_SMALL = 4096

PACK = "bucket int, payload binary"
_U32 = np.uint64(32)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(data: np.ndarray, off: np.ndarray):
    """(hash of each word, index of its text, first word of the next text, start and end of each word)."""
    start, end, doc = tx.tokens(data, off, tx.SPACES)
    h = tx.hashes(data, start, end)
    stop = np.searchsorted(doc, doc, "right")
    return h, doc, stop, start, end


def _openings(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First eight bytes of the words from each of ``at`` on, a blank after each word, as numbers that sort alike."""
    size = end - start + 1
    own = np.cumsum(size) - size
    flat = np.full(int(size.sum()) + 8, 32, np.uint8)
    inner = size - 1
    to = np.repeat(own - np.cumsum(inner) + inner, inner) + np.arange(int(inner.sum()))
    flat[to] = data[np.repeat(start - np.cumsum(inner) + inner, inner) + np.arange(int(inner.sum()))]
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | flat[own[at] + k].astype(np.uint64)
    return out


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, padded to the length of ``h``."""
    out = np.zeros(len(h), np.uint64)
    w = tx.windows(h, k)
    out[: len(w)] = w
    return out


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each w consecutive values (len - w + 1 of them)."""
    size, done = 1, x
    while size * 2 <= w:
        done = pick(done[: len(done) - size], done[size:])
        size *= 2
    rest = w - size
    return pick(done[: len(done) - rest], done[rest:]) if rest else done


def leads(h: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the leading words at each position, the greatest number where the text ends before."""
    return np.where(np.arange(len(h)) + _LEAD <= stop, _windows(h, _LEAD), _TOP)


def anchors(h: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes of the leading words) of the anchors."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lead = leads(h, stop)
    # stretches that reach over the ends of a text only add anchors
    rim = np.full(_STRETCH - 1, _TOP)
    least = _slide(np.concatenate([rim, lead, rim]), _STRETCH, np.minimum)
    at = np.flatnonzero((_slide(least, _STRETCH, np.maximum) == lead) & (lead != _TOP))
    return at, lead[at]


def letters(h: np.ndarray) -> list[np.ndarray]:
    """The three hashes of the suffix at each position (meaningless within LENGTH of the end)."""
    out, at, known = [], 0, {}
    for k in _LETTERS:
        if k not in known:
            known[k] = (_windows(h, k) >> _U32).astype(np.uint32)
        w = known[k]
        out.append(np.concatenate([w[at:], np.zeros(min(at, len(w)), np.uint32)]))
        at += k
    return out


def multikey_sort(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of strings given letter by letter; equal strings share a group number.

    Multikey quicksort: a part is split into less, equal and greater by a pivot
    letter (a median of nine); the equal part is compared by the next letter
    only.  Parts of up to _SMALL strings are sorted plainly.
    """
    n, depth = len(columns[0]), len(columns)
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, d = todo.pop()
        own = order[lo:hi]
        if hi - lo <= _SMALL:
            order[lo:hi] = own[np.lexsort([c[own] for c in reversed(columns[d:])])]
            continue
        x = columns[d][own]
        pivot = np.sort(x[:: max(1, len(x) // 9)][:9])[4]
        less, same = x < pivot, x == pivot
        parts = own[less], own[same], own[~(less | same)]
        order[lo:hi] = np.concatenate(parts)
        a, b = lo + len(parts[0]), hi - len(parts[2])
        todo += [(i, j, k) for i, j, k in ((lo, a, d), (a, b, d + 1), (b, hi, d)) if j - i > 1 and k < depth]
    new = np.zeros(n, bool)
    for c in columns:
        y = c[order]
        new[1:] |= y[1:] != y[:-1]
    return order, np.cumsum(new)


def _pack(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row a bucket holding its part of the columns, end to end."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(bucket))
    columns = [c[order] for c in columns]
    rows = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(first, last)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "payload"])


def _unpack(column, *kinds) -> list[np.ndarray]:
    """The columns of packed rows, concatenated."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for row in column.to_pylist():
        n, at = len(row) // width, 0
        for out, k in zip(parts, kinds):
            out.append(np.frombuffer(row, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


def _firsts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)


def _again(group: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group, document and position: (start of each group, whether it has two places)."""
    first = _firsts(group)
    last = np.append(first[1:], len(group)) - 1 if len(first) else first
    return first, (doc[first] != doc[last]) | (pos[first] != pos[last])


def _collected(packs, *kinds, limit=1 << 19):
    """Join small results of several pieces, so that packed rows stay large."""
    held, n = [], 0
    for p in packs:
        held.append(p)
        n += len(p[0])
        if n >= limit:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def repeats(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Passages of LENGTH words or more that occur at two or more places, in one document or several.

    Returns doc_id, start_word, end_word (exclusive, words counted from 0) and
    role: spans of ``copy`` repeat a passage that stands earlier (in order of
    id and position) and can be cut, spans of ``first`` are the occurrences to
    keep.  Words are separated by ASCII white space and control characters.
    Spans are unions of all repeated stretches of LENGTH words of one role that
    overlap or touch.  Rows with a null id or text are ignored; rows sharing an
    id are one document, and the same position of it counts once.  Texts under
    LENGTH words have no spans, longer ones are read whole; an empty table
    gives none.  No other column is read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    parts = partitions(spark, docs.count(), _DOCS)
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    def home(doc: np.ndarray) -> np.ndarray:
        return (tx.mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int32)

    anchor = (np.uint64, np.int64, np.int32, np.uint64, np.uint32)

    def scan(batches):
        def each():
            for b in batches:
                ids = b.column("doc_id").to_numpy()
                data, off = tx.flat(b.column("text"))
                for lo, hi in tx.pieces(off):
                    own = data[off[lo] : off[hi]]
                    h, doc, stop, start, end = _words(own, off[lo : hi + 1] - off[lo])
                    at, key = anchors(h, stop)
                    if len(at):
                        begin = np.searchsorted(doc, doc[at], "left")
                        yield key, ids[lo:hi][doc[at]], (at - begin).astype(np.int32), _openings(own, start, end, at), letters(h)[0][at]

        for key, doc, pos, opening, letter in _collected(each()):
            # what repeats here already goes on to its documents; one row of it tells the others
            order = np.lexsort((pos, doc, key))
            key, doc, pos, opening, letter = key[order], doc[order], pos[order], opening[order], letter[order]
            first, again = _again(key, doc, pos)
            size = np.diff(np.append(first, len(key)))
            some = np.repeat(again, size)
            yield _pack(parts + home(doc[some]), key[some], doc[some], pos[some], opening[some], letter[some])
            one = first
            told = np.where(again, -1, pos[one]).astype(np.int32)
            yield _pack((key[one] % np.uint64(parts)).astype(np.int32), key[one], doc[one], told, opening[one], letter[one])

    def twice(t: pa.Table) -> pa.Table:
        key, doc, pos, opening, letter = _unpack(t.column("payload"), *anchor)
        if t.column("bucket")[0].as_py() < parts:
            order = np.lexsort((pos, doc, key))
            key, doc, pos, opening, letter = key[order], doc[order], pos[order], opening[order], letter[order]
            first, again = _again(key, doc, pos)
            if len(first):
                again |= np.minimum.reduceat(pos, first) < 0
            keep = np.repeat(again, np.diff(np.append(first, len(key)))) & (pos >= 0)
            doc, pos, opening, letter = doc[keep], pos[keep], opening[keep], letter[keep]
        return pa.Table.from_batches([_pack(home(doc), doc, pos, opening, letter)])

    def by_doc(t: pa.Table) -> pa.Table:
        doc, pos, opening, letter = _unpack(t.column("payload"), *anchor[1:])
        order = np.lexsort((pos, doc))
        doc, pos, opening, letter = doc[order], pos[order], opening[order], letter[order]
        first = _firsts(doc)
        cut = list(zip(first.tolist(), np.append(first[1:], len(doc)).tolist()))
        return pa.table({"doc_id": doc[first], **{n: pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for n, x in (("at", pos), ("opening", opening), ("letter", letter))}})

    flags = texts.mapInArrow(scan, PACK).groupBy("bucket").applyInArrow(twice, PACK).groupBy("bucket").applyInArrow(by_doc, "doc_id long, at binary, opening binary, letter binary")
    flags = scratch.write(flags, "flags")
    size = flags.agg(F.sum(F.octet_length("at") + 24).alias("b"), F.sum(F.octet_length("at") / 4).alias("n")).first()
    n = int(size["n"] or 0)
    # one anchor stands for about half a stretch of suffixes of 32 bytes
    buckets = partitions(spark, n * _STRETCH / 2 * 32, _BUCKET_BYTES)
    cut_opening, cut_letter = _splitters(flags, n, buckets)
    hot = (cut_opening[1:] == cut_opening[:-1]) & (cut_letter[1:] == cut_letter[:-1])
    hot = np.unique(np.stack([cut_opening[1:][hot], cut_letter[1:][hot].astype(np.uint64)], 1), axis=0)
    marked = flags.select("doc_id", "at")
    candidates = texts.join(F.broadcast(marked) if (size["b"] or 0) <= broadcast_bytes else marked, "doc_id")
    suffix = (np.uint64, np.uint32, np.uint32, np.uint32, np.int64, np.int32)

    def suffixes(batches):
        def each():
            for b in batches:
                ids = b.column("doc_id").to_numpy()
                spots = b.column("at").to_pylist()
                data, off = tx.flat(b.column("text"))
                for lo, hi in tx.pieces(off):
                    own = data[off[lo] : off[hi]]
                    h, doc, stop, start, end = _words(own, off[lo : hi + 1] - off[lo])
                    if not len(h):
                        continue
                    begin = np.searchsorted(doc, np.arange(hi - lo))
                    lead = leads(h, stop)
                    good = np.zeros(len(h), bool)
                    for i in range(lo, hi):
                        p = np.frombuffer(spots[i], np.int32) + begin[i - lo]
                        # rows that share an id share their flags: some may lie beyond this text
                        good[p[p < len(h)]] = True
                    at = np.flatnonzero(np.arange(len(h)) + LENGTH <= stop)
                    if not len(at):
                        continue
                    # a passage can repeat if the anchor that its own words choose does
                    least = _slide(lead, _STRETCH, np.minimum)[at]
                    at = at[_slide(np.where(good, lead, _TOP), _STRETCH, np.minimum)[at] == least]
                    if len(at):
                        yield _openings(own, start, end, at), *(x[at] for x in letters(h)), ids[lo:hi][doc[at]], (at - begin[doc[at]]).astype(np.int32)

        for opening, *rest, doc, pos in _collected(each()):
            left, right = _between(opening, rest[0], cut_opening, cut_letter)
            # between equal splitters: a frequent suffix is spread by document
            spread = (tx.mix(doc.view(np.uint64)) % (right - left + 1).astype(np.uint64)).astype(np.int64)
            yield _pack((left + np.where(right - left > 1, spread, 0)).astype(np.int32), opening, *rest, doc, pos)

    fields = [("home", pa.int32()), ("payload", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())]

    def bucket(t: pa.Table) -> pa.Table:
        opening, x, y, z, doc, pos = _unpack(t.column("payload"), *suffix)
        order, group = multikey_sort([opening, x, y, z])
        opening, x, y, z, doc, pos = (c[order] for c in (opening, x, y, z, doc, pos))
        edge = np.zeros(len(opening), bool)
        for o, w in hot:
            edge |= (opening == o) & (x == w.astype(np.uint32))
        inner = np.flatnonzero(~edge)
        out = []
        if len(inner):
            g, d, p = group[inner], doc[inner], pos[inner]
            again = np.lexsort((p, d, g))
            g, d, p = g[again], d[again], p[again]
            first, twofold = _again(g, d, p)
            size = np.diff(np.append(first, len(g)))
            role = np.ones(len(g), np.int8)
            role[first] = 0
            role[(d == np.repeat(d[first], size)) & (p == np.repeat(p[first], size))] = 0
            keep = np.repeat(twofold, size)
            rows = _pack(home(d[keep]), d[keep], p[keep], role[keep])
            out.append(pa.table({"home": rows.column(0), "payload": rows.column(1), **{n: pa.nulls(rows.num_rows, k) for n, k in fields[2:]}}))
        at = np.flatnonzero(edge)
        if len(at):
            b, c = (x[at].astype(np.uint64) << _U32) | y[at], z[at].astype(np.int64)
            out.append(pa.table({"home": pa.nulls(len(at), pa.int32()), "payload": pa.nulls(len(at), pa.binary()), "a": opening[at].view(np.int64), "b": b.view(np.int64), "c": c, "doc_id": doc[at], "pos": pos[at]}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], k) for n, k in fields})

    found = candidates.mapInArrow(suffixes, PACK).groupBy("bucket").applyInArrow(bucket, "home int, payload binary, a long, b long, c long, doc_id long, pos int")
    found = scratch.write(found, "found")
    scratch.drop("flags")
    inner = found.where(F.col("home").isNotNull()).select(F.col("home").alias("bucket"), "payload")
    # across boundaries: groups between equal splitters, wherever their members were sorted
    edges = found.where(F.col("home").isNull()).select("a", "b", "c", "doc_id", "pos")
    place = F.struct("doc_id", "pos")
    heads = edges.groupBy("a", "b", "c").agg(F.min(place).alias("head"), F.max(place).alias("tail")).where("head <> tail").drop("tail")
    crossing = edges.join(heads, ["a", "b", "c"]).select("doc_id", "pos", F.when(place == F.col("head"), 0).otherwise(1).cast("byte").alias("role"))

    def repack(batches):
        for b in batches:
            if b.num_rows:
                d = b.column("doc_id").to_numpy()
                yield _pack(home(d), d, b.column("pos").to_numpy(), b.column("role").to_numpy())

    def spans(t: pa.Table) -> pa.Table:
        doc, pos, role = _unpack(t.column("payload"), np.int64, np.int32, np.int8)
        order = np.lexsort((pos, role, doc))
        doc, pos, role = doc[order], pos[order], role[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (role[1:] != role[:-1]) | (pos[1:] > pos[:-1] + LENGTH)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1 if len(first) else first
        names = np.array(["first", "copy"], object)
        return pa.table({"doc_id": doc[first], "start_word": pos[first], "end_word": (pos[last] + LENGTH).astype(np.int32), "role": pa.array(names[role[first]], pa.string())})

    packed = inner.unionByName(crossing.mapInArrow(repack, PACK))
    return packed.groupBy("bucket").applyInArrow(spans, "doc_id long, start_word int, end_word int, role string")


def _between(opening: np.ndarray, letter: np.ndarray, cut_opening: np.ndarray, cut_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of splitters (pairs in ascending order) less than, and not greater than, each pair."""
    left, right = np.searchsorted(cut_opening, opening, "left"), np.searchsorted(cut_opening, opening, "right")
    at = np.flatnonzero(left < right)
    lo, hi = left[at].copy(), left[at].copy()
    x = letter[at]
    for o in np.unique(cut_opening):
        own = np.flatnonzero(opening[at] == o)
        a, b = np.searchsorted(cut_opening, o, "left"), np.searchsorted(cut_opening, o, "right")
        lo[own] = a + np.searchsorted(cut_letter[a:b], x[own], "left")
        hi[own] = a + np.searchsorted(cut_letter[a:b], x[own], "right")
    left[at], right[at] = lo, hi
    return left, right


def _splitters(flags: DataFrame, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(openings, first letters) that cut the repeated suffixes into about ``buckets`` equal parts.

    A sample of at most about _SPLITTERS_A_BUCKET * buckets repeated anchors
    comes to the driver; a suffix frequent enough to fill buckets appears repeatedly.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    if not n:
        return none
    step = max(1, n // (_SPLITTERS_A_BUCKET * buckets))

    def sample(batches):
        for b in batches:
            out = []
            for doc, opening, letter in zip(*(b.column(c).to_pylist() for c in ("doc_id", "opening", "letter"))):
                x, y = np.frombuffer(opening, np.uint64), np.frombuffer(letter, np.uint32)
                some = (tx.mix(np.arange(len(x), dtype=np.uint64) + np.uint64(doc & (1 << 63) - 1)) % np.uint64(step)) == 0
                out.append((x[some], y[some]))
            x, y = (np.concatenate(c) for c in zip(*out)) if out else none
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.astype(np.int64))], ["opening", "letter"])

    t = flags.select("doc_id", "opening", "letter").mapInArrow(sample, "opening long, letter long").toArrow()
    if not t.num_rows:
        return none
    x, y = t.column("opening").to_numpy().view(np.uint64), t.column("letter").to_numpy().astype(np.uint32)
    order = np.lexsort((y, x))
    at = order[np.linspace(0, len(order), buckets + 1)[1:-1].astype(np.int64)]
    return x[at], y[at]


def cut_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of ``copy`` spans that no ``first`` span holds (remaining words of changed texts joined by blanks).

    Spans are those of ``repeats(docs)``.  Where an id stands for two or more
    different texts, positions don't say which of them is meant, and all its
    rows stay whole; rows that repeat an id and its text are cut alike.  Rows
    with a null id or text, and all columns but text, stay as they are; no
    column name clashes, and an empty table stays empty.
    """
    span = F.struct("start_word", "end_word")
    cuts = spans.groupBy(F.col("doc_id").alias("__id")).agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "copy", span))).alias("__cuts"), F.sort_array(F.collect_list(F.when(F.col("role") == "first", span))).alias("__keep")
    ).where(F.size("__cuts") > 0)
    row = docs.select(F.col("doc_id").alias("__at"), F.col("text").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    key = F.xxhash64("__text")
    one = row.where(F.col("__text").isNotNull()).join(cuts, F.col("__at") == F.col("__id"), "left_semi").groupBy("__at").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a = b").select(F.col("__at").alias("__id"))
    words = F.regexp_extract_all("__text", F.lit(r"([^\x00-\x20]+)"), 1)
    inside = lambda spans, i: F.exists(spans, lambda c: (c["start_word"] <= i) & (i < c["end_word"]))
    kept = F.filter(words, lambda w, i: ~inside("__cuts", i) | inside("__keep", i))
    joined = row.join(cuts.join(one, "__id"), F.col("__at") == F.col("__id"), "left")
    text = F.when(F.col("__cuts").isNull(), F.col("__text")).otherwise(F.array_join(kept, " "))
    return joined.select(*[(text if c == "text" else F.col("__row").getField(c)).alias(c) for c in docs.columns])


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x20]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, words, unnest(range(len(words) - 49)) AS pos FROM w WHERE len(words) >= 50),
k AS (SELECT doc_id, pos, md5(array_to_string(list_slice(words, pos + 1, pos + 50), ' ')) AS key FROM p),
g AS (SELECT key, min((doc_id, pos)) AS head, max((doc_id, pos)) AS tail FROM k GROUP BY key),
r AS (SELECT k.doc_id, k.pos, CASE WHEN (k.doc_id, k.pos) = g.head THEN 'first' ELSE 'copy' END AS role FROM k JOIN g USING (key) WHERE head <> tail),
n AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id, role ORDER BY pos) + 50 THEN 1 ELSE 0 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, role ORDER BY pos) AS island FROM n)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) + 50 AS INTEGER) AS end_word, role FROM i GROUP BY doc_id, role, island
"""
