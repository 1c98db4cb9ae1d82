"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its odd inputs."""

import re
import time
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import _text as tx
from textloom.llm import exact, html, license_texts, licenses, mixing, pieces, quality, ring, simhash, suffixes, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __k string, `key` string, __row string, rep long"


def rows_of(texts, start=1):
    return [(i, t, "en", "web", 0, "k", "x", "r", 1) for i, t in enumerate(texts, start)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and blank texts, a very long text, repeated rows, clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = rows_of(["same text here", "same text here", "", "", " \n\t", None, long, long + " tail"])
    rows += [rows[0], (None, "same text here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (9, "other", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def passages(rows):
    """Spans by brute force over every stretch of LENGTH words."""
    at = {}
    for d, t in sorted((d, t) for d, t in rows if d is not None and t is not None):
        w = t.split()
        for p in range(len(w) - suffixes.LENGTH + 1):
            at.setdefault(tuple(w[p : p + suffixes.LENGTH]), set()).add((d, p))
    marks = {}
    for found in at.values():
        if len(found) > 1:
            for x in found:
                marks.setdefault((x[0], "first" if x == min(found) else "copy"), set()).add(x[1])
    out = set()
    for (d, role), ps in marks.items():
        ps = sorted(ps)
        a = ps[0]
        for p, q in zip(ps, [*ps[1:], None]):
            if q is None or q > p + suffixes.LENGTH:
                out.add((d, a, p + suffixes.LENGTH, role))
                a = q
    return out


@pytest.fixture(scope="module")
def passages_df(spark):
    """One passage in a third of the documents, a text that repeats within itself, one of a single word, an id of two texts."""
    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in range(400)]
    hot = " ".join(rng.choice(words, 80))
    rows = [(i, " ".join(rng.choice(words, 60)) + (f"  {hot}\t" if i % 3 == 0 else " ") + " ".join(rng.choice(words, 20)), "en", "web", 0, "k", "x", "r", 1) for i in range(300)]
    own = " ".join(rng.choice(words, 70))
    rows += rows_of([f"{own} gap {own}", "w " * 300, own, "w " * 49], 1000) + [(1000, "another text", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows + rows[:5], DOCS)


def test_suffix_spans(spark, docs, odd, none, passages_df, monkeypatch):
    for df in (docs, odd, passages_df):
        want = passages({(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()})
        assert {tuple(r) for r in suffixes.repeats(df).select("doc_id", "start_word", "end_word", "role").collect()} == want
    # documents joined by shuffle, and buckets so small that the frequent passage fills several
    monkeypatch.setattr(suffixes, "_BUCKET_BYTES", 1 << 14)
    got = suffixes.repeats(passages_df, broadcast_bytes=0)
    assert {tuple(r) for r in got.select("doc_id", "start_word", "end_word", "role").collect()} == want
    assert suffixes.repeats(none).count() == 0


@pytest.mark.parametrize("n, small", [(500, 4096), (3000, 16), (0, 4096), (1, 4096)])
def test_multikey_sort(n, small, monkeypatch):
    monkeypatch.setattr(suffixes, "_SMALL", small)
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, n).astype(np.uint64), *(rng.integers(0, 5, n).astype(np.uint32) for _ in range(3))]
    order, group = suffixes.multikey_sort(columns)
    keys = [tuple(int(x[i]) for x in columns) for i in order]
    assert keys == sorted(keys)
    assert [a == b for a, b in zip(keys, keys[1:])] == (group[1:] == group[:-1]).tolist()


def test_cut_repeats(spark, passages_df, none):
    p = " ".join(f"p{i}" for i in range(60))
    q = " ".join(f"q{i}" for i in range(80))
    df = spark.createDataFrame([(1, f"a {p} b"), (2, f"c {p} d"), (3, "short")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in suffixes.cut_repeats(df, suffixes.repeats(df)).collect()}
    assert out == {1: f"a {p} b", 2: "c d", 3: "short"}
    # an id of two texts stays whole, as do null rows; names clash with nothing
    rows = [(1, p, 1), (2, p, 2), (2, q, 3), (3, p, 4), (3, p, 5), (None, p, 6), (4, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __cuts int")
    out = suffixes.cut_repeats(df, suffixes.repeats(df))
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == [(1, p, 1), (2, p, 2), (2, q, 3), (3, "", 4), (3, "", 5), (None, p, 6), (4, None, 7)]
    # what repeats within one text keeps its first occurrence
    kept = {r["doc_id"]: r["text"] for r in suffixes.cut_repeats(passages_df, suffixes.repeats(passages_df)).where("doc_id = 1001").collect()}
    assert kept == {1001: " ".join(["w"] * 50)}
    assert suffixes.cut_repeats(none, suffixes.repeats(none)).count() == 0


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def is_subsequence(a, b):
    rest = iter(b)
    return all(x in rest for x in a)


@pytest.mark.parametrize("bits", [1 << 27, 8])
def test_common_lines(bits):
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (list(map(str, rng.integers(0, 5, rng.integers(0, 14)))) for _ in range(2))
        cut = html.common_lines(a, b, bits)
        assert len(cut) == lcs(a, b) and is_subsequence([a[i] for i in sorted(cut)], b)


#: Tags as one regular expression, slow on broken pages.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|title|iframe|svg)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"""
    r"""|</?([a-zA-Z][a-zA-Z0-9]*)(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>""",
    re.S | re.I,
)


def test_strip_tags():
    rng = np.random.default_rng(5)
    parts = ["<", "<a ", "<p>", "</p>", ">", '"', "'", "<!--", "-->", "<script", "</script", "</script >", "<title x=", "x", "y z", "<br/>", "<?", "<!d", "</", "<1", "<SVG>", "</svg>", "<b", "/>"]
    for _ in range(5000):
        t = "".join(rng.choice(parts, rng.integers(0, 14)))
        assert html.strip_tags(t) == TAG.sub(lambda m: "\n" if m.group(2) and m.group(2).lower() in html._BLOCK else "", t)


@pytest.mark.parametrize("page", ["<script ", '<a ">', "<a '\">\">", "<script>", "</script", "<!--", "<a", "<a b='x' ", "<p>x</p>", "<"])
def test_long_broken_pages(page):
    began = time.process_time()
    html.text_lines(page * ((1 << 20) // len(page)))
    assert time.process_time() - began < 5


def test_html_pairs(spark):
    page = lambda body: f"<html><body><nav>Home</nav><p>{body}</p><footer>(c) us</footer></body></html>"
    rows = [
        (1, "http://a.org/x/1", page("one"), 0), (2, "http://a.org/x/2", page("two &amp; more"), 0), (3, "http://b.org/", page("alone"), 0), (4, None, page("no url"), 0),
        (5, "http://c.org/1", None, 0), (6, "http://c.org/2", "", 0), (None, "http://a.org/x/3", page("no id"), 0), (1, "http://a.org/x/1", page("one"), 0),
        (7, "http://d.org/1", page("same"), 0), (8, "http://d.org/2", page("same"), 0), (9, "http://e.org/i?p=1", page("e one"), 0), (10, "http://e.org/i?p=2", page("e two"), 0),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, range int")
    for target in (html.TARGET, 100):
        out = [(r["page_id"], r["partner_id"], r["text"]) for r in html.extract(df, target).collect()]
        assert sorted(out, key=str) == sorted([
            (1, 2, "one"), (1, 2, "one"), (2, 1, "two & more"), (3, None, "Home\nalone\n(c) us"), (4, None, "Home\nno url\n(c) us"),
            (5, None, ""), (6, None, ""), (None, None, "Home\nno id\n(c) us"), (7, None, "Home\nsame\n(c) us"), (8, None, "Home\nsame\n(c) us"),
            (9, None, "Home\ne one\n(c) us"), (10, 9, "e two"),
        ], key=str)
    assert html.extract(df.limit(0)).count() == 0


def paired(rows):
    """Page id -> (partner, lines) by brute force over all paths of its host."""
    split = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)")
    first = {}
    for k, url, text in sorted(rows):
        m = split.match(url or "")
        if m and m.group(1):
            first.setdefault((m.group(1).lower(), m.group(2)), (k, html.text_lines(text or "")))
    out = {}
    for k, url, text in rows:
        lines, m = html.text_lines(text or ""), split.match(url or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        others = [p for h, p in first if h == host and p != path] if host else []
        shared = lambda p: next((i for i, (x, y) in enumerate(zip(p, path)) if x != y), min(len(p), len(path)))
        around = [max((p for p in others if p.encode() < path.encode()), key=str.encode, default=None), min((p for p in others if p.encode() > path.encode()), key=str.encode, default=None)]
        near = sorted((p for p in around if p is not None), key=lambda p: (-shared(p), p > path))
        if near:
            assert shared(near[0]) == max(map(shared, others))
        some = [first[host, p] for p in ([path] if host else []) + near]
        out[k] = (next((s for s in some if s[1] != lines), (None, None)), lines)
    return out


@pytest.mark.parametrize("target", [html.TARGET, 20_000])
def test_html_brute(spark, target):
    rng = np.random.default_rng(9)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    # one path with a third of all pages, between two others of its host
    for i in range(200):
        body = "".join(f"<p>{w}</p>" for w in rng.integers(0, 30, 40))
        rows.append((10_000 + i, f"http://hot.org/m?id={i}" if i % 4 else f"http://hot.org/{i:03d}", f"<nav>Top</nav>{body}"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.extract(df, target).collect()}
    want = paired(rows)
    assert got.keys() == want.keys()
    for k, (other, lines) in want.items():
        assert got[k]["partner_id"] == other[0], k
        n = lcs(lines, other[1]) if other[1] is not None and len(lines) < 400 else None
        kept = got[k]["text"].split("\n") if got[k]["text"] else []
        assert is_subsequence(kept, lines)
        if other[1] is None:
            assert kept == lines
        elif n is not None:
            assert got[k]["n_shared"] == n and len(kept) == len(lines) - n


def test_licenses(spark, docs, odd, none):
    plain = [t for r in docs.select("text").limit(150).collect() for t in (r[0] or "").split("\n")]
    model = licenses.fit_lines(plain)
    family = {f: ts[0] for f, ts in license_texts.TEMPLATES.items()}
    rows = [(i, f"first line\n{t}\nlast line") for i, t in enumerate(family.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licenses.scan(df, model).collect()}
    right = sum(got.get((i, 1)) == f for i, f in enumerate(family))
    assert right >= 0.9 * len(family) and all(p == 1 for _, p in got)
    for df in (odd, none):
        assert licenses.scan(df, licenses.fit(df)).count() == 0


def test_licenses_inside_long_and_wrapped_paragraphs(docs):
    texts = [t or "" for (t,) in docs.select("text").limit(150).collect()]
    plain = [t for x in texts for t in x.split("\n")]
    model = licenses.fit_lines(plain)
    rng = np.random.default_rng(6)
    filler = [w for t in plain if max(licenses.similarity(t, f) for f in license_texts.TEMPLATES) < 0.2 for w in t.split()]
    every = [(f, t) for f, ts in license_texts.TEMPLATES.items() for t in ts]

    def found(text):
        data, off = tx.flat(pa.array([text], pa.string()))
        return licenses.find(model, data, *licenses.lines(data, off))

    for n in (15, 60, 120):
        extra = [[str(w) for w in rng.choice(filler, n)] for _ in every]
        hits = sum(any(h[:2] == (0, f) for h in found(" ".join([*e[: n // 2], *t.split(), *e[n // 2 :]]))) for (f, t), e in zip(every, extra))
        assert hits >= 0.9 * len(every), (n, hits, len(every))
        assert sum(len(found(" ".join(e))) for e in extra) == 0
    long = [(f, t.split()) for f, t in every if len(t.split()) >= 12]
    wrapped = ["\n".join(["some ordinary words here", "", *(" ".join(w[i : i + 5]) for i in range(0, len(w), 5)), "", "more of them"]) for _, w in long]
    assert sum([h[:2] for h in found(x)] == [(2, f)] for (f, _), x in zip(long, wrapped)) >= 0.9 * len(long)


def test_sentencepiece(spark, docs, odd, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    own = {-1: "a  b   c ", -2: "▁x 漢字 🙂 é́", -3: "  ", -4: " " * 1003 + "the", -5: "   a\n    b\n" * 300, -6: "x ▁ y", -7: "ab" * 3000, -8: "…, “q”—1.5%\tz", -9: " " * 4099 + "w" * 2000}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | own
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in pieces.encode(df).collect():
        assert r["tokens"] == lib.encode(texts[r["doc_id"]])
        assert r["decoded"] == texts[r["doc_id"]].replace("▁", " ")
    out = pieces.encode(odd).collect()
    assert len(out) == odd.count() and all((r["tokens"] is None) == (r["decoded"] is None) for r in out)
    assert sum(r["tokens"] is None for r in out) == 2 and pieces.encode(none).count() == 0


@pytest.fixture(scope="module")
def encoder():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Encoder(pieces.parse(f.read()))


@pytest.mark.parametrize("text", [" ", "a", "qz", "  x", "漢", "<script ", "\n    "])
def test_long_words(encoder, text):
    text = text * ((1 << 20) // len(text))
    began = time.process_time()
    ids, off = encoder.encode(*tx.flat(pa.array([text])))
    assert encoder.codec.decode(ids, off).to_pylist() == [text]
    assert time.process_time() - began < 6


def test_encoder_forgets(encoder, docs, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "REMEMBER", 3000)
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r[0] or "" for r in docs.select("text").collect()]
    encoder._reset()
    for lo in [*range(0, len(texts), 10)] * 2:
        part = texts[lo : lo + 10]
        ids, off = encoder.encode(*tx.flat(pa.array(part, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == lib.encode(part)


def test_decode_invalid_bytes(encoder):
    c = encoder.codec
    ids = np.array([c.bytes[0xE6], c.bytes[0xBC], c.bytes[0xA2], c.bytes[0xE6]])
    assert c.decode(ids, np.array([0, 3, 4])).to_pylist() == ["漢", "\ufffd"]
    assert c.decode(ids[:3], np.array([0, 1, 3])).to_pylist() == ["\ufffd", "\ufffd\ufffd"]


def test_viterbi():
    words = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.5, "▁a": -2.2, "ba": -3.0, "aba": -6.0}
    codec = pieces.Codec(["<unk>", *words], [0.0, *words.values()], {0}, {}, 0, "unigram")

    def best(w):
        options = [[]] if not w else [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in words for rest in best(w[k:])]
        return options

    from itertools import product

    every = sorted("▁" + "".join(p) for n in range(1, 6) for p in product("ab", repeat=n))
    for w, parts in zip(every, codec._viterbi(every)):
        score = lambda x: sum(words[p] for p in x)
        assert "".join(parts) == w and score(parts) == pytest.approx(max(map(score, best(w))))


@pytest.mark.parametrize("limit", [exact.BROADCAST_KEYS, -1])
def test_exact(spark, docs, odd, none, limit):
    hot = spark.createDataFrame(rows_of(["one text"] * 400 + [f"text {i}" for i in range(800)]), DOCS)
    for df in (docs, odd, hot):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        own = [x for x in rows if None not in x]
        groups = {}
        for d, t in own:
            groups.setdefault(t, []).append(d)
        want = sorted((d, min(g), g.count(d) - (d == min(g))) for g in groups.values() for d in set(g) if g.count(d) > (d == min(g)))
        assert sorted(tuple(r) for r in exact.duplicates(df, limit).select("doc_id", "keep_id", "surplus_rows").collect()) == want
        kept = exact.drop_duplicates(df, limit)
        assert kept.columns == df.columns
        got = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
        assert sorted(x for x in got if None not in x) == sorted((min(g), t) for t, g in groups.items())
        assert sum(None in x for x in got) == sum(None in x for x in rows)
    assert exact.duplicates(none, limit).count() == 0 and exact.drop_duplicates(none, limit).count() == 0


def test_exact_lookup(spark, docs, none):
    index = exact.build_index(docs, keys_per_owner=8)
    assert index.select("owner").distinct().count() > 1
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    groups = {}
    for d, t in rows:
        if t is not None:
            groups.setdefault(t, []).append(d)
    more = [(d + 10**6, t) for d, t in rows[::3]] + [(-1, "not there"), (None, rows[0][1]), (-2, None)]
    df = spark.createDataFrame(more, "doc_id long, text string")
    got = {r["doc_id"]: (r["head"], r["n"]) for r in exact.lookup(index, df).collect()}
    assert got == {d: (min(groups[t]), len(groups[t])) for d, t in more if d is not None and t in groups}
    assert exact.lookup(index, none).count() == 0 and exact.lookup(exact.build_index(none), df).count() == 0


def test_exact_directory():
    rng = np.random.default_rng(3)
    keys = [int(k) >> 4 for k in rng.integers(0, 2**63, 3000)] * 2
    d = exact.Directory(4, 16)
    for i, k in enumerate(keys):
        d.insert(k, i)
    chains = {k: chain for _, _, k, chain in d.rows()}
    assert len(d.slots) == 1 << d.depth and max(map(len, d.buckets)) <= 16
    assert chains == {k: [i for i, x in enumerate(keys) if x == k] for k in set(keys)}
    assert all(k in d.buckets[d.slots[d.slot(k)]] for k in keys)


def test_simhash_groups(spark, docs, odd, none):
    rows = docs.select("doc_id", "text").where("text is not null").collect()
    data, off = tx.flat(pa.array([r["text"] for r in rows], pa.string()))
    a, sketch, has = simhash.fingerprints(data, off)
    ids = [r["doc_id"] for r in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(ids)), 2):
        if has[i] and has[j] and (int(a[i]) ^ int(a[j])).bit_count() <= simhash.RADIUS and simhash.alike(sketch[i : i + 1], sketch[j : j + 1])[0]:
            x, y = find(ids[i]), find(ids[j])
            root[max(x, y)] = min(x, y)
    want = sorted((i, find(i)) for i in ids if find(i) != i)
    assert want and sorted(tuple(r) for r in simhash.groups(docs).select("doc_id", "keep_id").collect()) == want
    got = {tuple(r) for r in simhash.groups(odd).select("doc_id", "keep_id").collect()}
    assert got == {(2, 1), (8, 7)}
    for limit in (simhash.BROADCAST_IDS, -1):
        kept = simhash.drop_near(odd, limit)
        assert kept.columns == odd.columns and kept.count() == odd.count() - 2
        assert simhash.drop_near(none, limit).count() == 0
    assert simhash.groups(none).count() == 0


def test_simhash_reads_shingles(spark):
    """Texts of the same words in another order stay apart; texts with a few words changed don't."""
    rng = np.random.default_rng(12)
    words = np.array([f"w{i}" for i in range(120)])
    base = list(rng.choice(words, 300))
    rows = [(i, " ".join(rng.permutation(base))) for i in range(400)]
    changed = list(base)
    for i in rng.integers(0, 300, 6):
        changed[i] = "other"
    rows += [(1000, " ".join(base)), (1001, " ".join(changed)), (1002, " ".join(base) + ".")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in simhash.groups(df).select("doc_id", "keep_id").collect()} == {(1001, 1000), (1002, 1000)}


def near_nodes(n, seed):
    """Fingerprints and sketches of few and many bins, some of them changed copies of others."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, n, np.uint64, endpoint=False)
    s = rng.integers(1, 256, (n, simhash.BINS)).astype(np.uint8)
    s[rng.random((n, simhash.BINS)) < rng.choice([0, 0, 0.3, 0.6, 0.85, 0.95], n)[:, None]] = 0
    copy = rng.random(n) < 0.7
    of = rng.integers(0, n // 10, n)
    a[copy] = a[of[copy]]
    for _ in range(6):
        a[copy] ^= np.uint64(1) << rng.integers(0, 64, copy.sum(), np.uint64)
    other = rng.random((n, simhash.BINS)) < rng.choice([0.2, 0.6, 0.75, 0.9], n)[:, None]
    s[copy] = np.where(other, s * (rng.random(s.shape) < 0.5), s[of])[copy]
    s[np.arange(n), rng.integers(0, simhash.BINS, n)] |= 1
    return a, s


def test_simhash_keys():
    """No near pair is without a node in common, whatever the bins filled, and few other pairs have one."""
    n = 3000
    a, s = near_nodes(n, 21)
    row, node = simhash.keys(a, s)
    nodes = [set() for _ in range(n)]
    for r, k in zip(row.tolist(), node.tolist()):
        nodes[r].add(k)
    found, shares = 0, set()
    for i in range(n - 1):
        j = i + 1 + np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= simhash.RADIUS)
        for k in j[simhash.alike(s[i : i + 1], s[j])].tolist():
            assert nodes[i] & nodes[k], (i, k)
            found += 1
            shares.add(int(((s[i] == s[k]) & (s[i] > 0)).sum()))
    assert found > 500 and shares >= set(range(1, 13))
    # texts apart, fifty thousand: each choice of agreeing blocks of bits would compare 4 % of all pairs
    n = 50_000
    rng = np.random.default_rng(22)
    a, s = rng.integers(0, 2**64, n, np.uint64, endpoint=False), rng.integers(1, 256, (n, simhash.BINS)).astype(np.uint8)
    row, node = simhash.keys(a, s)
    _, many = np.unique(node, return_counts=True)
    assert len(row) <= 50 * n and (many * (many - 1) // 2).sum() < 0.001 * n * (n - 1) / 2


@pytest.mark.parametrize("limit", [simhash.LIMIT, 2])
def test_simhash_large_nodes(spark, limit):
    """Nodes are searched in full, each with each or split by blocks of bits, also one that all rows share."""
    n = 1500
    a, s = near_nodes(n, 23)
    s[n // 2 :, :2] = 7
    want = simhash.Forest(n)
    for i in range(n - 1):
        j = i + 1 + np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= simhash.RADIUS)
        j = j[simhash.alike(s[i : i + 1], s[j])]
        want.join(np.full(len(j), i), j)
    words = s.view(np.int64).tolist()
    nodes = spark.createDataFrame([(i, x, *w) for i, (x, w) in enumerate(zip(a.view(np.int64).tolist(), words))], "rep long, a long, s0 long, s1 long, s2 long")
    got = simhash.Forest(n)
    for src, dst in simhash.links(nodes, limit=limit).collect():
        got.join(np.array([src]), np.array([dst]))
    every = np.arange(n)
    assert (want.root(every) != every).sum() > 100 and (got.root(every) == want.root(every)).all()


def test_sketch_share():
    """The share of equal bins follows the share of shingles in common."""
    rng = np.random.default_rng(13)
    for keep in (0.0, 0.5, 1.0):
        shares = []
        for _ in range(30):
            x = [f"a{i}" for i in rng.integers(0, 10**6, 200)]
            y = x[: int(200 * keep)] + [f"b{i}" for i in rng.integers(0, 10**6, 200 - int(200 * keep))]
            _, s, _ = simhash.fingerprints(*tx.flat(pa.array([" ".join(x), " ".join(y)])))
            shares.append(((s[0] == s[1]) & (s[0] > 0)).sum() / ((s[0] | s[1]) > 0).sum())
        assert np.mean(shares) == pytest.approx(keep / (2 - keep), abs=0.06)


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.where("pmod(hash(doc_id), 3) <> 0")
    held = labels.subtract(fit).select("doc_id", "quality")
    model = quality.fit(docs, fit)
    pairs = quality.score(docs, model).withColumnRenamed("quality", "got").join(held, "doc_id").select("got", "quality").collect()
    for kind in (0, 1):
        own = [r[0] == r[1] for r in pairs if r[1] == kind]
        assert len(own) > 10 and sum(own) >= 0.9 * len(own), kind
    out = quality.score(odd, model).collect()
    assert len(out) == odd.count() and sum(r["score"] is None for r in out) == 5
    kept = quality.score(odd, model, keep_columns=True)
    assert kept.columns == odd.columns
    one = quality.fit(odd, spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, None, 1)], "doc_id long, quality int, toxic int"))
    assert quality.score(none, one).count() == 0
    # the margin itself is kept
    at = [r["score"] for r in quality.score(docs, model).where("score is not null").limit(1).collect()][0]
    model.threshold = at
    assert quality.score(docs, model).where(f"score = {at!r}").first()["quality"] == 1


def test_quality_indicators():
    """The cells of a text, by brute force over its words, pairs and shape triples."""
    text = "Ab cd!! cd cd 12x ÉA"
    toks = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text.encode())
    n = len(toks)
    doc, cell = quality.indicators(*tx.flat(pa.array([text])))
    low = [t.lower() for t in toks]
    pairs = {(a, b) for a, b in zip(low, low[1:])}
    assert (doc == 0).all() and len(cell) == len(set(cell.tolist()))
    assert len(set(low)) + len(pairs) <= len(cell) <= len(set(low)) + len(pairs) + n - 2
    again, _ = quality.indicators(*tx.flat(pa.array(["", text, text])))
    assert np.bincount(again, minlength=3).tolist() == [0, len(cell), len(cell)]


def test_quality_optimum():
    """Ratios by counting, and the fitted model against the best of the same objective found by subgradients."""
    rng = np.random.default_rng(14)
    y = np.array([1] * 30 + [-1] * 20)
    cells = [np.unique(np.concatenate([rng.integers(0, 12, 6), rng.integers(12, 20, 3) if v > 0 else rng.integers(16, 24, 3)])) for v in y]
    m = quality._fit(cells, y, 1.0, 1.0, 4000, 1e-9, 7)
    p, q = np.ones(1 << quality.BITS), np.ones(1 << quality.BITS)
    for c, v in zip(cells, y):
        (p if v > 0 else q)[c] += 1
    for j in range(24):
        assert m.ratio[j] == pytest.approx(np.log((p[j] / p.sum()) / (q[j] / q.sum())), abs=1e-5)
    x = np.zeros((50, 25))
    for i, c in enumerate(cells):
        x[i, c] = m.ratio[c]
        x[i] /= np.linalg.norm(x[i])
        x[i, 24] = 1
    cost = np.where(y > 0, 50 / 60, 50 / 40)
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w, best = np.zeros(25), np.inf
    for step in range(1, 30_000):
        w = w - (w - (cost * y * (y * (x @ w) < 1)) @ x) / (step + 10)
        best = min(best, loss(w))
    assert loss(np.append(m.weight[:24], m.bias)) <= best * 1.001


@pytest.mark.parametrize("dims, blocks", [(64, None), (64, 50), (100, None), (7, 40)])
def test_topk(spark, dims, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(topk, "INDEX_BLOCK", blocks)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, dims))
    x[100:200] = x[0]  # a third of all rows
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(None, x[0].tolist(), 0), (900, None, 0), (5, x[5].tolist(), 0)]
    short = {901: [1.0], 902: [], 903: [None, float("nan"), 2.0]}
    rows += [(i, v, 0) for i, v in short.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int")
    bits = {i: (v > 0).astype(np.int64) for i, v in enumerate(x)} | {i: np.array([1 if v is not None and v > 0 else 0 for v in vs] + [0] * (dims - len(vs))) for i, vs in short.items()}
    ids = sorted(bits)
    dist = np.array([[(bits[i] != bits[j]).sum() for j in ids] for i in ids])
    for ask, own in ((None, ids), ("vec_id % 20 = 0", [i for i in ids if i % 20 == 0])):
        got = {(r["vec_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in topk.nearest(df, 7, ask).collect()}
        assert len(got) == 7 * len(own)
        for i in own:
            want = sorted((int(dist[ids.index(i), j]), k) for j, k in enumerate(ids) if k != i)[:7]
            assert [got[i, r + 1] for r in range(7)] == [(j, d) for d, j in want]
    assert topk.nearest(df.limit(0)).count() == 0
    assert topk.nearest(df.where("vec_id < 3"), 7).count() == 6


def test_sharding(spark, odd, none):
    ids = list(range(500))
    points, owner = ring.ring(5, 16)
    place = {i: ring._place(str(i)) for i in ids}
    room = [ceil(1.05 * len(ids) / 5)] * 5
    want = {}
    arc = {i: int(np.searchsorted(points, place[i])) % len(points) for i in ids}
    for i in sorted(ids, key=lambda i: (arc[i], place[i], i)):
        at = arc[i]
        while room[owner[at]] == 0:
            at = (at + 1) % len(points)
        room[owner[at]] -= 1
        want[i] = int(owner[at])
    df = spark.createDataFrame([(i, 0) for i in ids] + [(7, 1)], "doc_id long, arc int")
    assert {r["doc_id"]: r["shard"] for r in ring.assign(df, 5, 16).collect()} == want
    more = {r["doc_id"]: r["shard"] for r in ring.assign(df, 6, 16).collect()}
    assert sum(more[i] != want[i] for i in ids) < 0.5 * len(ids)
    assert ring.assign(odd).count() == odd.select("doc_id").distinct().count() and ring.assign(none).count() == 0


def test_mixing(spark, odd, none):
    rows = [(i, "a b c d" if i % 3 else "a b", "x" if i % 4 else "y") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    knots = {"x": [(0.0, 0.2), (1.0, 0.8)], "y": [(0.0, 0.8), (1.0, 0.2)]}
    out = mixing.positions(df, schedule=knots).collect()
    own = {"x": sum(4 if i % 3 else 2 for i, _, s in rows if s == "x"), "y": sum(4 if i % 3 else 2 for i, _, s in rows if s == "y")}
    total = min(own.values()) / 0.5
    for s, (w0, w1) in {"x": (0.2, 0.8), "y": (0.8, 0.2)}.items():
        seen = 0
        for r in sorted((r for r in out if r["source"] == s), key=lambda r: r["time"]):
            t = r["time"]
            assert total * (w0 * t + (w1 - w0) * t * t / 2) == pytest.approx(seen, abs=1e-4)
            seen += r["tokens"]
        assert total * 0.5 <= seen < total * 0.5 + 4
    kept = mixing.mix(odd)
    assert kept.columns == odd.columns and all(r["text"].strip() for r in kept.collect())
    assert mixing.mix(none).count() == 0 and mixing.positions(none).count() == 0


def test_mixing_epochs_and_names(spark):
    """Several epochs, null sources and ties; columns that might clash, among them a text called __tok."""
    rows = [(i % 50 if i % 7 else None, "a b", "big" if i < 90 else None, "ten", f"{i}", 0.5) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __tok string, tokens string, time double")
    knots = {"big": [(0.0, 0.5), (1.0, 0.5)], "": [(0.0, 0.5), (1.0, 0.5)]}
    out = mixing.positions(df, schedule=knots, max_epochs=3).collect()
    small = [r for r in out if r["source"] == ""]
    # the source of 10 rows is used 3 times, the other one as much in tokens, so once for 30 of its 90 rows
    assert len(small) == 30 and {r["epoch"] for r in small} == {0, 1, 2} and len(out) == 60
    assert all(r["epoch"] == 0 for r in out if r["source"] == "big")
    assert all(r["row"]["__tok"] == "ten" and r["row"]["time"] == 0.5 for r in out)
    mixed = mixing.mix(df, schedule=knots, max_epochs=3)
    assert mixed.columns == df.columns and mixed.count() == 60
    times = {(r["row"]["tokens"], r["epoch"]): r["time"] for r in out}
    assert len(times) == 60
    with pytest.raises(ValueError):
        mixing.positions(df, max_epochs=0)
    with pytest.raises(ValueError):
        mixing.positions(df, max_epochs=2, whole=True)


@pytest.mark.parametrize("sizes", [{"a": 300, "b": 280, None: 1}, {"hot": 2000, "b": 20, "c": 20}])
def test_pipeline_mix_is_whole(spark, sizes):
    import corpus_pipeline as cp

    rows = [(1000 * k + i, "w " * 9 + "w", s) for k, (s, n) in enumerate(sizes.items(), 1) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in cp.mix_sources(spark, df, SF).collect()) == sorted(r[0] for r in rows)
    placed = mixing.positions(df, whole=True).collect()
    assert len(placed) == len(rows) and all(0 <= r["time"] <= 1 for r in placed)


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    sizes = [len(rows)]
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == list(rows[0].asDict())
        sizes.append(docs.count())
        if name == "exact":
            assert sorted(r[0] for r in docs.select("text").collect()) == sorted({r[0] for r in before.select("text").collect()})
    assert all(a > b for a, b in zip(sizes[:3], sizes[1:4])) and sizes[3] == sizes[4]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = cp.run(spark, SF).collect()
    assert {r["doc_id"]: r["decoded"] for r in out} == texts and len(out) == len(texts)


def test_pipeline_keeps_training_order(spark, tmp_path):
    """Positions of the last stage follow the order of mixing over many files of uneven size."""
    import corpus_pipeline as cp

    rng = np.random.default_rng(15)
    rows = [(int(i), "w " * int(rng.integers(1, 9) * (200 if i % 50 == 0 else 1)), "en", f"s{i % 7 if i % 3 else 0}", 0) for i in rng.permutation(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        cp.mix_sources(spark, df, SF).write.parquet(str(tmp_path / "mixed"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        assert len(list((tmp_path / "mixed").glob("part-*"))) > 2
        out = cp.tokenize(spark, spark.read.parquet(str(tmp_path / "mixed")), SF).select("doc_id", "position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = [r["doc_id"] for r in sorted(mixing.positions(df, whole=True).select("doc_id", "time").collect(), key=lambda r: (r["time"], r["doc_id"]))]
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["position"])] == want and len({r["position"] for r in out}) == 3000


def test_pipeline_stages_take_odd_tables(spark, odd, none, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = {"exact": odd.count() - 3, "near": odd.count() - 2}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns
        n = out.count()
        assert n == sizes.get(name, n) and n <= odd.count()
        assert stage(spark, none, str(tmp_path)).count() == 0
    out = cp.tokenize(spark, odd, str(tmp_path))
    assert out.count() == odd.count() and cp.tokenize(spark, none, str(tmp_path)).count() == 0


def test_shared_folder(spark, tmp_path):
    from textloom.llm import _shared

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://x:7077", "getConf": staticmethod(lambda: type("G", (), {"get": staticmethod(lambda k: None)}))})

    with pytest.raises(RuntimeError):
        _shared.shared_root(Cluster())
    s = _shared.Scratch(spark, "test")
    t = s.write(spark.range(5), "t")
    assert t.count() == 5
    s.drop("t")
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(f"{s.path}/t").count()
