"""Main text of web pages by differencing each page with its nearest URL.

Pages are ordered by host and URL path.  The nearest other path of a host is
always next to it in that order (it shares the longest prefix), so after one
range partitioning by (host, path) every page meets its partner in the same
task; the first and last path of a range are sent to the neighbouring range
too, and a path with very many pages is spread over tasks of its own.  Text lines are aligned by longest common subsequence, and the shared
lines, navigation and footers for the most part, are deleted.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of pages a task at most, but for one page that is longer.
TARGET = 32 << 20

_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option",
    "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Elements whose content is not text.
_SILENT = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "svg"}
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*)")
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in _SILENT}
_STOP = re.compile(r"[>\"']")
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)"


class _Tags:
    """Ends of the tags of one page, each part of which is read a bounded number of times however broken it is."""

    def __init__(self, text: str):
        self.text = text
        self.dead: set[int] = set()  # quotes from which no tag end was reached
        self.missing: dict[str, int] = {}  # a character is absent from here on
        self.stop = (0, -1)  # no quote or > from the first place up to the second

    def find(self, c: str, at: int) -> int:
        if at >= self.missing.get(c, len(self.text) + 1):
            return -1
        k = self.text.find(c, at)
        if k < 0:
            self.missing[c] = at
        return k

    def end(self, at: int) -> int:
        """Place after the > that ends the tag whose attributes begin at ``at``, quotes taken into account; -1 if none."""
        path = []
        while True:
            if not self.stop[0] <= at <= self.stop[1]:
                m = _STOP.search(self.text, at)
                self.stop = (at, m.start() if m else len(self.text))
            k = self.stop[1]
            if k >= len(self.text) or k in self.dead:
                break
            if self.text[k] == ">":
                return k + 1
            path.append(k)
            k = self.find(self.text[k], k + 1)
            if k < 0:
                break
            at = k + 1
        self.dead.update(path)
        return -1


def strip_tags(text: str) -> str:
    """``text`` without tags, comments and silent elements; tags of blocks become line feeds."""
    tags, out, at, n = _Tags(text), [], 0, len(text)
    keep = 0
    while True:
        k = text.find("<", at)
        if k < 0:
            break
        to, put = -1, ""
        c = text[k + 1 : k + 2]
        if text.startswith("<!--", k):
            to = tags.find("-->", k + 4)
            to = n if to < 0 else to + 3
        elif c and (c.isascii() and c.isalpha() or c == "/"):
            m = _NAME.match(text, k + 1)
            if m:
                to = tags.end(m.end())
                name = m.group(2).lower()
                if to >= 0:
                    if name in _BLOCK:
                        put = "\n"
                    if name in _SILENT and not m.group(1):
                        put = ""
                        if tags.missing.get("</" + name, n + 1) <= to:
                            close = None
                        else:
                            close = _CLOSE[name].search(text, to)
                            if close is None:
                                tags.missing["</" + name] = to
                        to = close.end() if close else n
            if to < 0:
                to = tags.find(">", k + 1) + 1 or -1
        elif c in ("!", "?"):
            to = tags.find(">", k + 1) + 1 or -1
        if to < 0:
            at = k + 1
            continue
        out.append(text[keep:k])
        out.append(put)
        keep = at = to
    out.append(text[keep:])
    return "".join(out)


def text_lines(html: str) -> list[str]:
    """Visible text of a page by block: one string a line, white space collapsed, blank lines dropped.

    Never fails: unclosed tags, comments and entities are read as browsers do,
    unknown tags are inline, and a ``<`` that begins no tag is text.
    """
    # the line breaks of the source are blanks
    text = strip_tags(html.replace("\r", " ").replace("\n", " "))
    if "&" in text:
        # a character reference may stand for a line break: a blank, too
        return [x for x in (" ".join(unescape(t).split()) for t in text.split("\n")) if x]
    return [x for x in (" ".join(t.split()) for t in text.split("\n")) if x]


def _codes(y: list[str]) -> dict[str, int]:
    """Bits of the positions of each line."""
    spots: dict[str, list[int]] = {}
    for j, t in enumerate(y):
        spots.setdefault(t, []).append(j)
    out = {}
    for t, js in spots.items():
        b = bytearray(len(y) // 8 + 1)
        for j in js:
            b[j >> 3] |= 1 << (j & 7)
        out[t] = int.from_bytes(b, "little")
    return out


def _lengths(x: list[str], y: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``x`` with the first j lines of ``y``, for each j."""
    at, full, v = _codes(y), (1 << len(y)) - 1, (1 << len(y)) - 1
    for t in x:
        u = v & at.get(t, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common_lines(a: list[str], b: list[str], bits: int = 1 << 27) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of lines with ``b``.

    Bit-parallel over the lines that occur in both (others can't be in it).
    While the table has at most ``bits`` bits it is held whole, and of several
    longest ones it is the one that matches latest lines of ``a`` first when
    read from the end; a larger one is halved along ``a`` first, where the sum
    of the lengths before and after is greatest (at the first such place of
    ``b``), so memory grows with the lines and not with their product.
    """
    here, there = set(a), set(b)
    x = [(i, t) for i, t in enumerate(a) if t in there]
    y = [t for t in b if t in here]
    out: set[int] = set()
    todo = [(x, y)]
    while todo:
        x, y = todo.pop()
        if not x or not y:
            continue
        if len(x) * len(y) > bits and len(x) > 1:
            mid = len(x) // 2
            before = _lengths([t for _, t in x[:mid]], y)
            after = _lengths([t for _, t in reversed(x[mid:])], y[::-1])[::-1]
            k = int(np.argmax(before + after))
            todo += [(x[:mid], y[:k]), (x[mid:], y[k:])]
        else:
            out |= _aligned(x, y)
    return out


def _aligned(x: list[tuple[int, str]], y: list[str]) -> set[int]:
    at, full = _codes(y), (1 << len(y)) - 1
    rows, v = [], full
    for _, t in x:
        u = v & at.get(t, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # walk back: row i holds 0 where the length grows
    out, i, j = set(), len(x) - 1, len(y)
    while i >= 0:
        mask = (1 << j) - 1
        above = rows[i - 1] if i else full
        k = j - (rows[i] & mask).bit_count()
        if not k:
            break
        if j - (above & mask).bit_count() == k:
            i -= 1
            continue
        # line i is used: it ends at the last position whose length first reaches k
        j = (~rows[i] & mask).bit_length() - 1
        out.add(x[i][0])
        i -= 1
    return out


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def by_nearness(path: str, before: str | None, after: str | None) -> list[int]:
    """The neighbours in path order (-1 before, 1 after) that exist, nearest first: longest common prefix, ties to the one before."""
    if before is None or after is None:
        return [] if before is after else [1] if before is None else [-1]
    return [-1, 1] if _shared(path, before) >= _shared(path, after) else [1, -1]


_KEY = ("host", "path", "rep")


def _edges(keys: DataFrame, ranges: int, hot: int) -> tuple[list[tuple], list[tuple]]:
    """Ranges of the sorted (host, path, rep, bytes), and the paths of more than ``hot`` bytes.

    A range is (first key, last key, bytes), a hot path (key, bytes, key before,
    key after); keys are (host, path, rep).  The driver gets a row a range, and
    no more hot paths than their bytes allow.
    """
    fields = [pa.field(f"{p}_{c}", pa.int64() if c == "rep" else pa.string()) for p in ("a", "b", "c") for c in _KEY] + [pa.field("bytes", pa.int64()), pa.field("hot", pa.bool_())]

    def ends(batches):
        first = last = None
        total, out, held = 0, [], None  # held: a hot path that waits for the key after it
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in (*_KEY, "bytes"))):
                key, size = r[:3], r[3]
                if held:
                    out.append((held[0], held[1], key, held[2]))
                    held = None
                if size > hot:
                    held = (last, key, size)
                first, last = first or key, key
                total += size
        if held:
            out.append((held[0], held[1], None, held[2]))
        if first:
            rows = [(*first, *last, None, None, None, total, False)]
            rows += [(*(p or (None,) * 3), *k, *(q or (None,) * 3), size, True) for p, k, q, size in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields))

    sorted_ = keys.repartitionByRange(ranges, "host", "path").sortWithinPartitions("host", "path")
    schema = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long' if f.type == pa.int64() else 'boolean'}" for f in fields)
    rows = [tuple(r) for r in sorted_.mapInArrow(ends, schema).collect()]
    cut = sorted((r[:3], r[3:6], r[9]) for r in rows if not r[10])
    firsts, hots = [c[0] for c in cut], []
    for r in sorted((r for r in rows if r[10]), key=lambda r: r[3:6]):
        k = bisect_right(firsts, r[3:6]) - 1
        before = r[:3] if r[0] is not None else cut[k - 1][1] if k else None
        after = r[6:9] if r[6] is not None else cut[k + 1][0] if k + 1 < len(cut) else None
        hots.append((r[3:6], r[9], before, after))
    return cut, hots


def extract(pages: DataFrame, target: int = TARGET) -> DataFrame:
    """Text of each page without the lines it shares with the page of nearest URL.

    Returns page_id, partner_id, n_lines, n_shared and text (lines joined by
    line feeds), one row per input row.  The first page of a path is the one of
    least id.  A page's partner is the first of these whose lines aren't all
    equal to its own: the first page of its own path (URLs that differ in their
    query only), that of the nearest neighbouring path of the host, that of the
    other neighbour.  Where there is none (alone on its host, no host because
    the URL is null or relative, a null id, or equal pages only) it keeps all
    lines and has a null partner.  Rows that repeat an id are pages of their
    own.  Null and empty pages have an empty text and no lines, very long ones
    are read whole, an empty table gives none.  Other columns are not read.

    Tasks are cut by bytes, ``target`` each; a path of more is spread over
    tasks that get the first pages it is compared with.
    """
    spark = pages.sparkSession
    src = pages.select("page_id", "html", F.lower(F.regexp_extract("url", _URL, 1)).alias("host"), F.regexp_extract("url", _URL, 2).alias("path"))
    paired = F.col("page_id").isNotNull() & (F.col("host") != "")
    keys = src.where(paired).groupBy("host", "path").agg(F.min("page_id").alias("rep"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 64).cast("long").alias("bytes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges, hots = _edges(keys, 4 * parts, target)
    cuts = [e[0][:2] for e in edges]
    # ranges in order fill tasks; hot paths have tasks of their own
    total = sum(e[2] for e in edges) - sum(h[1] for h in hots)
    tasks = max(parts, -(-total // target))
    task_of, done, j = [], 0, 0
    for first, last, size in edges:
        while j < len(hots) and hots[j][0] <= last:
            size -= hots[j][1]
            j += 1
        task_of.append(min(tasks - 1, (done + size // 2) * tasks // max(1, total)))
        done += size
    salts, halo, n = {}, {}, tasks
    for key, size, before, after in hots:
        salts[key[:2]] = (n, -(-size // target), key[2])
        for k in (before, key, after):
            if k is not None and k[0] == key[0]:
                halo.setdefault(k, []).append(key[:2])
        n += salts[key[:2]][1]

    def parse(batches):
        least: dict[tuple, list] = {}  # of the first pages that are sent on; rows may repeat their ids
        row = 0
        for b in batches:
            out = []
            for page, html, host, path in zip(*(b.column(c).to_pylist() for c in ("page_id", "html", "host", "path"))):
                row += 1
                lines = text_lines(html) if html else []
                if page is None or not host or not cuts:
                    out.append((row % tasks, -1, "", "", page, 0, lines))  # no pairing
                    continue
                k = bisect_right(cuts, (host, path)) - 1
                key, hot = (host, path, page), salts.get((host, path))
                out.append((hot[0] + row % hot[1], -2, host, path, page, 0, lines) if hot else (task_of[k], k, host, path, page, 0, lines))
                first, last, _ = edges[k]
                to = [(task_of[k], k)] if hot and page == hot[2] else []
                to += [(salts[h][0] + i, -2) for h in halo.get(key, ()) for i in range(salts[h][1])]
                if key == first and k and edges[k - 1][1][0] == host:
                    to.append((task_of[k - 1], k - 1))
                if key == last and k + 1 < len(edges) and edges[k + 1][0][0] == host:
                    to.append((task_of[k + 1], k + 1))
                if to and not lines >= least.get(key, lines + [""]):
                    least[key] = lines
                    out += [(*t, host, path, page, 1, lines) for t in to]
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())))], ["task", "range", "host", "path", "page_id", "halo", "lines"])

    def pair(batches):
        out: list[tuple] = []

        def close(before, run, after):
            """Emit the pages of one path between its neighbours (path, id, lines)."""
            path = run[0][0]
            others = [(run[0][1], run[0][3])] + [(before if side < 0 else after)[1:] for side in by_nearness(path, before and before[0], after and after[0])]
            for _, page, copy, lines in run:
                if copy:
                    continue
                other = next((o for o in others if o[1] != lines), None)
                cut = common_lines(lines, other[1]) if other else set()
                kept = [t for i, t in enumerate(lines) if i not in cut] if cut else lines
                out.append((page, other[0] if other else None, len(lines), len(cut), "\n".join(kept)))

        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("range", "host", "path", "page_id", "halo", "lines")))

        def flush():
            cols = list(zip(*out)) if out else [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["page_id", "partner_id", "n_lines", "n_shared", "text"])

        before, run, place = None, [], None
        for rng, host, path, page, copy, lines in rows():
            if rng == -1:
                out.append((page, None, len(lines), 0, "\n".join(lines)))
            else:
                if place != (rng, host):
                    if run:
                        close(before, run, None)
                    before, run, place = None, [], (rng, host)
                elif run and run[0][0] != path:
                    close(before, run, (path, page, lines))
                    # ids ascend within a path, so its first page is its least
                    before, run = (run[0][0], run[0][1], run[0][3]), []
                run.append((path, page, copy, lines))
            if len(out) >= 512:
                yield flush()
        if run:
            close(before, run, None)
        yield flush()

    lined = src.mapInArrow(parse, "task int, range int, host string, path string, page_id long, halo int, lines array<string>")
    sorted_ = lined.repartitionById(n, F.col("task")).sortWithinPartitions("range", "host", "path", "page_id", "lines", "halo")
    return sorted_.mapInArrow(pair, "page_id long, partner_id long, n_lines int, n_shared int, text string")


def op2_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
