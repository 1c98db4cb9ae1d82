"""Queries of the retrieval engine over whole tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import RE_USER, NormalizationConfig, TextConfig, TokenizationConfig
from textloom.functions import tokenize as tk
from textloom.functions import charsets as cs
from textloom.functions.normalize import is_emoji, normalize_col
from textloom.functions.transforms import ChainTransformation, ColumnTransformation, Identity, IgnoreStopwords, LemmaTransformation, with_lemma_transformation, without_lemma_transformation
from textloom.operators import embeddings as em
from textloom.operators import expansion, index, lemmas, profile, vectors
from textloom.operators import vocabulary as vb
from textloom.operators import weighting as wt
from textloom.operators.tokens import batches, term_frequencies, tokenize
from textloom.pipeline import FitConfig, fit_profile
from textloom.scratch import Scratch, list_files, write_bytes
from textloom.sources import profiles as store
from textloom.sources.records import FORMATS, read_embeddings, read_records, select_text, write_csv, write_jsonl
from textloom.streaming import incremental

CFG = TextConfig()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STOP = ("the", "of", "and", "a")
LEMMAS = {"houses": "house", "systems": "system", "results": "result", "years": "year"}
#: A small thesaurus: token, rank, neighbor, distance.
SYNONYMS = [("the", 1, "of", 0.1), ("the", 2, "and", 0.4), ("and", 1, "a", None), ("a", 1, "the", 0.2), ("of", 1, "no such token", 0.3)]
OTHER_SYNONYMS = [("the", 1, "and", 0.2), ("the", 2, "a", 0.3), ("and", 1, "a", 0.5), ("in", 1, "of", 0.25)]


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as a query set."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# -- SQL parts: the default policy on text that is ASCII once accents are gone --------------
_URL = (r"(?:http|ftp|https)://[^\s\p{Z}]+", "_url ")
_USR = (RE_USER.replace("'", "''"), "_usr ")
_NUM = (r"[-+]?\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+", "0 ")


def _norm(col: str, rules=(_URL, _NUM)) -> str:
    out = f"lower({col})"
    for pattern, to in rules:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    out = f"strip_accents(replace({out}, 'ß', 'ss'))"
    return rf"regexp_replace(regexp_replace({out}, '[\s\x{{85}}\p{{Zs}}]', ' ', 'g'), '\p{{Cc}}', '', 'g')"


def _tokens(col: str) -> str:
    return f"regexp_extract_all({_norm(col)}, '{tk.ASCII}')"


_T = f"t AS MATERIALIZED (SELECT doc_id, {_tokens('text')} AS tokens FROM documents)"
_TF = _T + ", tf AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS token FROM t) GROUP BY doc_id, token)"
_VOC = _TF + ", voc AS MATERIALIZED (SELECT token, CAST(sum(tf) AS BIGINT) AS occs, count(*) AS ndocs FROM tf GROUP BY token), st AS (SELECT (SELECT count(*) FROM documents) AS trainsize, (SELECT count(*) FROM tf) AS numtokens)"
_IDF = _VOC + ", wt AS (SELECT token, log2((0.5 + trainsize) / (0.5 + ndocs)) AS weight FROM voc, st)"
_VEC = _IDF + """, raw AS (SELECT doc_id, token, tf / max(tf) OVER (PARTITION BY doc_id) * weight AS w FROM tf JOIN wt USING (token)),
vec AS MATERIALIZED (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw WHERE w >= 1e-6)"""
_Q = f""", qt AS (SELECT item_id AS query_id, token, count(*) AS tf FROM (SELECT item_id, unnest({_tokens('text')}) AS token FROM benchmark) JOIN voc USING (token) GROUP BY item_id, token)"""


_BTF = f"bt AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({_tokens('text')}) AS token FROM benchmark) GROUP BY item_id, token), bv AS (SELECT token, CAST(sum(tf) AS BIGINT) AS occs, count(*) AS ndocs FROM bt GROUP BY token)"


# -- normalization and tokenization -----------------------------------------------------------
@query(f"SELECT doc_id, {_norm('text')} AS norm FROM documents")
def normalize(spark, d):
    """Default normalization of every document."""
    return docs_of(spark, d).select("doc_id", normalize_col(CFG.normalization, "text").alias("norm"))


_PUNCT = r"""[!"%&''()*,./:;?\[\]{}\\-]"""


@query(f"""SELECT doc_id, regexp_replace({_norm("replace(text, ' a', ' see http://a.b/@c @some_one! a')", (_URL, _USR, _NUM))}, '{_PUNCT}', ' ', 'g') AS norm FROM documents""")
def normalize_grouped(spark, d):
    """Links, then mentions grouped, punctuation dropped; links with an at sign and mentions are put into the texts."""
    cfg = NormalizationConfig(group_usr=True, group_url=True, del_punc=True)
    docs = docs_of(spark, d).withColumn("text", F.replace("text", F.lit(" a"), F.lit(" see http://a.b/@c @some_one! a")))
    return docs.select("doc_id", normalize_col(cfg, "text").alias("norm"))


_EMOJI = f"[{cs.char_class(cs.emojis())}]"
_MARKED = "replace(text, ' th', ' 🙂😡😡😡😡 sooo!!!! th')"


@query(f"""WITH n AS (SELECT doc_id, string_split(' ' || regexp_replace({_norm(_MARKED)}, '{_EMOJI}', '👾', 'g') || ' ', '') AS c FROM documents)
SELECT doc_id, list_aggregate(list_filter(c, lambda x, i: NOT (i > 2 AND x = c[i - 1] AND x = c[i - 2])), 'string_agg', '') AS norm FROM n""")
def normalize_repeats(spark, d):
    """Runs of a character cut to two, emojis grouped, both ends padded; emojis and long runs are put into the texts."""
    cfg = NormalizationConfig(del_dup=True, group_emo=True)
    docs = docs_of(spark, d).withColumn("text", F.replace("text", F.lit(" th"), F.lit(" 🙂😡😡😡😡 sooo!!!! th")))
    return docs.select("doc_id", normalize_col(cfg, "text", limits=True).alias("norm"))


@query(f"""SELECT doc_id, {_norm('text', (('[aeiou]+', '0 '),))} AS norm FROM documents""")
def normalize_custom(spark, d):
    """Other expressions in place of the default ones: runs of vowels as numbers, no links grouped."""
    cfg = NormalizationConfig(re_num="[aeiou]+").replace(group_url=False)
    return docs_of(spark, d).select("doc_id", normalize_col(cfg, "text").alias("norm"))


@query(f"SELECT doc_id, regexp_extract_all(text, '{tk.full_pattern()}') AS tokens FROM documents")
def tokens_of_normalized(spark, d):
    """Tokens of texts that are taken as normalized already."""
    return tokenize(docs_of(spark, d), CFG, isnormalized=True).select("doc_id", "tokens")


@query(f"WITH c AS (SELECT doc_id, unnest(string_split({_MARKED}, '')) AS c FROM documents) SELECT doc_id, count(*) AS emojis FROM c WHERE regexp_full_match(c, '{_EMOJI}') GROUP BY doc_id")
def emojis(spark, d):
    """Emoji characters of every document that has some (a few are put into the texts)."""
    text = F.replace("text", F.lit(" th"), F.lit(" 🙂😡😡😡😡 sooo!!!! th"))
    return docs_of(spark, d).select("doc_id", F.size(F.filter(F.split(text, ""), lambda c: is_emoji(c))).cast("long").alias("emojis")).where("emojis > 0")


@query(f"SELECT doc_id, {_norm('text')} AS norm FROM documents")
def normalize_full_unicode(spark, d):
    """Default normalization by complete compatibility mapping."""
    return docs_of(spark, d).select("doc_id", normalize_col(CFG.normalization.replace(unicode="full"), "text").alias("norm"))


@query(f"WITH {_T} SELECT doc_id, tokens FROM t")
def tokens(spark, d):
    """Unigrams of every document."""
    return tokenize(docs_of(spark, d), CFG).select("doc_id", "tokens")


@query(
    f"WITH {_T} SELECT doc_id, list_concat(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1] || chr(9) || 'n')), "
    "list_transform(range(1, len(tokens) - 1), lambda i: tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2] || chr(9) || 'n')) AS tokens FROM t"
)
def token_ngrams(spark, d):
    """Unigrams, bigrams and trigrams, n-grams marked."""
    return tokenize(docs_of(spark, d), TextConfig(tokenization=TokenizationConfig((1, 2, 3)))).select("doc_id", "tokens")


@query(f"WITH c AS (SELECT conv_id, list({_tokens('text')} ORDER BY turn) AS parts FROM conversations GROUP BY conv_id) SELECT conv_id, flatten(parts) AS tokens FROM c")
def field_tokens(spark, d):
    """Conversations as documents of several fields."""
    fields = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("fields"))
    return tokenize(fields, CFG, "fields").select("conv_id", "tokens")


_TRIM = r"list_filter(list_transform({0}, lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> '')"


@query("WITH p AS (SELECT doc_id, " + _TRIM.format(r"regexp_split_to_array(text, '(?:\r?\n){2,}')") + " AS p FROM documents) SELECT doc_id, generate_subscripts(p, 1) - 1 AS number, unnest(p) AS paragraph FROM p")
def paragraphs(spark, d):
    """Paragraphs of every document."""
    return docs_of(spark, d).select("doc_id", F.posexplode(tk.paragraphs_col("text")).alias("number", "paragraph")).withColumn("number", F.col("number").cast("long"))


@query("WITH p AS (SELECT doc_id, " + _TRIM.format(r"regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '[\r\n]+')") + " AS p FROM documents) SELECT doc_id, generate_subscripts(p, 1) - 1 AS number, unnest(p) AS sentence FROM p")
def sentences(spark, d):
    """Sentences of every document."""
    return docs_of(spark, d).select("doc_id", F.posexplode(tk.sentences_col("text")).alias("number", "sentence")).withColumn("number", F.col("number").cast("long"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
_LEMMA_SQL = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEMMAS.items()) + " ELSE x END"


@query(f"WITH {_T} SELECT doc_id, list_filter(list_transform(tokens, lambda x: {_LEMMA_SQL}), lambda x: x NOT IN ({_STOP_SQL})) AS tokens FROM t")
def transformed_tokens(spark, d):
    """Lemmas applied, then stopwords dropped."""
    cfg = CFG.replace(transformation=ChainTransformation([LemmaTransformation(LEMMAS), IgnoreStopwords(STOP)]))
    return tokenize(docs_of(spark, d), cfg).select("doc_id", "tokens")


@query("SELECT lang, text FROM documents WHERE text IS NOT NULL AND len(text) >= 100")
def convert_records(spark, d):
    """Corpus conversion: texts of 100 characters or more with their language."""
    return select_text(docs_of(spark, d), "text", 100, ("lang",)).select("lang", "text")


@query(f"WITH {_T} SELECT doc_id, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]) AS tokens FROM t")
def token_bigrams(spark, d):
    """Bigrams without the unigrams they are made of, unmarked."""
    return tokenize(docs_of(spark, d), TextConfig(tokenization=TokenizationConfig((2,), mark_token_type=False))).select("doc_id", "tokens")


class Beginnings:
    """The first three characters of every unigram."""

    needs_unigrams, tag = True, "p"

    def generate(self, unigrams, normalized):
        return F.transform(unigrams, lambda x: F.substring(x, 1, 3))


class Size:
    """The number of characters of the text."""

    needs_unigrams, tag = False, None

    def generate(self, unigrams, normalized):
        return F.array(F.length(normalized).cast("string"))


@query(f"WITH {_T} SELECT t.doc_id, list_concat([CAST(length({_norm('text')}) AS VARCHAR)], list_concat(tokens, list_transform(tokens, lambda x: substring(x, 1, 3) || chr(9) || 'p'))) AS tokens FROM t JOIN documents USING (doc_id)")
def token_generators(spark, d):
    """Tokens of generators of one's own beside the unigrams."""
    cfg = TextConfig(tokenization=TokenizationConfig((1,), generators=(Beginnings(), Size())))
    return tokenize(docs_of(spark, d), cfg).select("doc_id", "tokens")


@query(f"WITH {_T}, x AS (SELECT doc_id, unnest(tokens) AS token FROM t) SELECT token, count(*) AS occs, count(DISTINCT doc_id) AS ndocs FROM x GROUP BY token")
def vocabulary_pretokenized(spark, d):
    """Vocabulary of documents that come as arrays of tokens."""
    made = tokenize(docs_of(spark, d), CFG).select("doc_id", F.col("tokens").alias("text"))
    return vb.vocabulary(made, CFG, pretokenized=True).table


@query(f"WITH {_T} SELECT doc_id, flatten(list_transform(tokens, lambda x: CASE WHEN length(x) > 8 THEN [substring(x, 1, 8), substring(x, 9)] WHEN length(x) < 2 THEN [] ELSE [x] END)) AS tokens FROM t")
def tokens_split(spark, d):
    """A transformation that gives several tokens for one, or none."""
    parts = lambda x: F.when(F.length(x) > 8, F.array(F.substring(x, 1, 8), F.substr(x, F.lit(9)))).when(F.length(x) < 2, F.array().cast("array<string>")).otherwise(F.array(x))
    cfg = CFG.replace(transformation=ChainTransformation([Identity(), ColumnTransformation(lambda u: F.flatten(F.transform(u, parts)))]))
    return tokenize(docs_of(spark, d), cfg).select("doc_id", "tokens")


@query(f"WITH {_T} SELECT doc_id, list_filter(list_transform(tokens, lambda x: {_LEMMA_SQL}), lambda x: x NOT IN ({_STOP_SQL})) AS tokens FROM t")
def lemmas_replaced(spark, d):
    """Lemmas put first in a chain in place of others that were there."""
    old = CFG.replace(transformation=ChainTransformation([IgnoreStopwords(STOP), LemmaTransformation({"house": "the", "year": "no"})]))
    cfg = with_lemma_transformation(without_lemma_transformation(old), LEMMAS)
    return tokenize(docs_of(spark, d), cfg).select("doc_id", "tokens")


@query(f"WITH {_T} SELECT doc_id, list_filter(list_transform(tokens, lambda x: {_LEMMA_SQL}), lambda x: x NOT IN ({_STOP_SQL})) AS tokens FROM t")
def transformed_by_join(spark, d):
    """The same lemmas and stopwords among so many others that they are joined."""
    more = LEMMAS | {f"\x01{i}": "none" for i in range(300)}
    cfg = CFG.replace(transformation=ChainTransformation([LemmaTransformation(more), IgnoreStopwords({*STOP, *(f"\x02{i}" for i in range(10_001))})]))
    return tokenize(docs_of(spark, d), cfg).select("doc_id", F.when(F.col("text").isNotNull(), F.col("tokens")).alias("tokens"))


# -- sources and sinks -----------------------------------------------------------------------------
def _stored(spark, d, fmt: str) -> str:
    """Documents (doc_id, lang, text) written in one of the corpus formats."""
    path = f"{Scratch(spark, 'records').path}/{fmt}"
    docs = docs_of(spark, d).select("doc_id", "lang", "text")
    if fmt == "jsonl":
        docs.write.json(path)
    elif fmt == "csv":
        write_csv(docs, path)
    elif fmt == "parquet":
        docs.write.parquet(path)
    elif fmt == "plaintext":
        docs.select(F.concat("text", F.lit("\n\n"))).write.text(path)
    else:
        # one array a file: a file a task, joined from its rows
        one = docs.select(F.to_json(F.struct("*")).alias("j"), F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("part"))
        rows = one.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value"))
        rows.repartitionById(8, F.col("part").cast("int")).select("value").write.text(path)
    return path


def _records(fmt: str):
    def run(spark, d):
        df = read_records(spark, fmt, _stored(spark, d, fmt))
        return df.select(F.col("doc_id").cast("long"), "lang", F.md5("text").alias("text"))

    return run


for _name in FORMATS:
    if _name != "plaintext":
        QUERIES[f"read_{_name}"] = _records(_name)
        SQL[f"read_{_name}"] = "SELECT doc_id, lang, md5(text) AS text FROM documents"


@query("WITH p AS (SELECT " + _TRIM.format(r"regexp_split_to_array(text, '(?:\r?\n){2,}')") + " AS p FROM documents), q AS (SELECT unnest(p) AS paragraph FROM p) SELECT md5(paragraph) AS paragraph, count(*) AS n FROM q GROUP BY ALL")
def read_plaintext(spark, d):
    """Paragraphs of plain text files, with their number of occurrences."""
    df = read_records(spark, "plaintext", _stored(spark, d, "plaintext"))
    return df.groupBy(F.md5("text").alias("paragraph")).count().withColumnRenamed("count", "n")


@query("""SELECT '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}' AS line FROM documents""")
def written_jsonl(spark, d):
    """Lines of the JSONL sink."""
    path = f"{Scratch(spark, 'jsonl').path}/out"
    write_jsonl(docs_of(spark, d).select("doc_id", "lang", "n_chars"), path, order="doc_id")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 150 AS BIGINT) AS batch_id FROM documents")
def document_batches(spark, d):
    """Batches of 150 documents in order of id."""
    return batches(docs_of(spark, d), 150).select("doc_id", "batch_id")


# -- vocabularies and bags ---------------------------------------------------------------------
def _terms(spark, d) -> vb.Terms:
    """Documents tokenized once; all of a query derives from the stored table."""
    return vb.terms(docs_of(spark, d), CFG)


def _voc(spark, d) -> vb.Vocabulary:
    return _terms(spark, d).vocabulary()


@query(f"WITH {_VOC} SELECT token, occs, ndocs FROM voc")
def vocabulary(spark, d):
    """Occurrences and document counts of every token."""
    return _voc(spark, d).table


@query(f"WITH {_VOC} SELECT trainsize, numtokens, round(numtokens / trainsize, 9) AS avgdoclen FROM st")
def vocabulary_stats(spark, d):
    """Number of documents, of distinct tokens summed over them, and their mean."""
    return _voc(spark, d).stats.select("trainsize", "numtokens", F.round(F.col("numtokens") / F.col("trainsize"), 9).alias("avgdoclen"))


@query(f"WITH {_VOC} SELECT token, occs, ndocs FROM voc WHERE ndocs >= 5")
def vocabulary_pruned(spark, d):
    """Tokens of five documents or more."""
    return _terms(spark, d).vocabulary(5).table


@query(f"WITH {_VOC} SELECT token, occs, ndocs, trainsize, numtokens FROM voc, st")
def vocabulary_merged(spark, d):
    """Vocabularies of the English and of all other documents, merged with their statistics."""
    docs = docs_of(spark, d)
    en = F.coalesce(F.col("lang") == "en", F.lit(False))
    return vb.merge(vb.terms(docs.where(en), CFG).vocabulary(), vb.terms(docs.where(~en), CFG).vocabulary()).with_stats()


@query(f"WITH {_VOC} SELECT token, occs, ndocs, trainsize, numtokens FROM voc, st")
def vocabulary_from_stream(spark, d):
    """Counters of a stream of documents, folded into stored tables batch by batch."""
    root = Scratch(spark, "stream").path
    docs = docs_of(spark, d).select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    incremental.start(stream, incremental.vocabulary_sink(f"{root}/out", CFG), f"{root}/checkpoint", once=True).awaitTermination()
    return incremental.read_vocabulary(spark, f"{root}/out", CFG).with_stats()


@query("SELECT lower(n_name) AS token, CAST(2 AS BIGINT) AS occs, CAST(1 AS BIGINT) AS ndocs, CAST(0 AS BIGINT) AS trainsize, CAST(0 AS BIGINT) AS numtokens FROM nation")
def vocabulary_empty_pushed(spark, d):
    """An empty vocabulary with counters pushed into it."""
    rows = table(spark, d, "nation").select(F.lower("n_name").alias("token"), F.lit(2).cast("long").alias("occs"), F.lit(1).cast("long").alias("ndocs"))
    return vb.push_tokens(vb.empty(spark, CFG), rows).with_stats()


@query(f"WITH {_VOC}, {_BTF} SELECT 'bag' AS by, token, occs, ndocs FROM voc WHERE token IN (SELECT token FROM bt) UNION ALL SELECT 'list', token, occs, ndocs FROM voc WHERE token IN ('the', 'of') UNION ALL SELECT 'ids', token, occs, ndocs FROM (SELECT *, row_number() OVER (ORDER BY occs DESC, token) AS n FROM voc) WHERE n IN (1, 3, 5)")
def vocabulary_rows(spark, d):
    """Rows of a vocabulary by a bag, by a list of tokens and by ids."""
    voc = _voc(spark, d)
    bag = term_frequencies(tokenize(table(spark, d, "benchmark"), CFG), keys=("item_id",))
    parts = [("bag", voc.select(bag)), ("list", voc.select(["the", "of", "no such token"])), ("ids", voc.select_ids([0, 1, 3, 5]))]
    out = [p.select(F.lit(n).alias("by"), "token", "occs", "ndocs") for n, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {_TF} SELECT doc_id, list_transform(list_sort(list((token, tf))), lambda x: x[1] || ' ' || x[2]) AS bow FROM tf GROUP BY doc_id")
def packed_bags(spark, d):
    """One map a document, written out in order of its tokens."""
    packed = vb.pack(_terms(spark, d).bags)
    return packed.select("doc_id", F.transform(F.array_sort(F.map_entries("bow")), lambda x: F.concat(x["key"], F.lit(" "), x["value"].cast("string"))).alias("bow"))




@query(f"WITH {_VOC}, {_BTF} SELECT token, CAST(sum(occs) AS BIGINT) AS occs, CAST(sum(ndocs) AS BIGINT) AS ndocs FROM (SELECT * FROM voc UNION ALL SELECT * FROM bv WHERE ndocs >= 2) GROUP BY token")
def vocabulary_updated(spark, d):
    """Counters of the benchmark's tokens of two items or more added."""
    other = vb.vocabulary(table(spark, d, "benchmark"), CFG)
    return vb.update(_voc(spark, d), other, "ndocs >= 2").table


@query(f"WITH {_VOC}, {_BTF} SELECT token, CAST(sum(occs) AS BIGINT) AS occs, CAST(sum(ndocs) AS BIGINT) AS ndocs, (SELECT trainsize FROM st) AS trainsize, (SELECT numtokens FROM st) + (SELECT count(*) FROM bt) AS numtokens FROM (SELECT * FROM voc UNION ALL SELECT * FROM bv) GROUP BY token")
def vocabulary_appended(spark, d):
    """Benchmark items appended to the vocabulary of the documents."""
    return vb.append(_voc(spark, d), table(spark, d, "benchmark")).with_stats()


@query("SELECT lower(n_name) AS token, CAST(1 AS BIGINT) AS occs, CAST(1 AS BIGINT) AS ndocs FROM nation")
def vocabulary_thesaurus(spark, d):
    """A vocabulary of listed tokens: the nations (25 rows by nature)."""
    names = [r[0] for r in table(spark, d, "nation").select(F.lower("n_name")).collect()]
    return vb.from_thesaurus(spark, CFG, names).table


@query(f"WITH {_VOC} SELECT token, round(ndocs / trainsize, 9) AS ratio FROM voc, st WHERE ndocs / trainsize > 0.2")
def stopword_candidates(spark, d):
    """Tokens in more than a fifth of the documents."""
    return vb.stopword_candidates(_voc(spark, d), 0.2).select("token", F.round("ratio", 9).alias("ratio"))


@query(f"WITH {_VOC} SELECT row_number() OVER (ORDER BY occs DESC, token) AS token_id, token FROM voc WHERE ndocs >= 5")
def token_ids(spark, d):
    """Ids of a pruned vocabulary."""
    return _terms(spark, d).vocabulary(5).with_ids().select(F.col("token_id").cast("long"), "token")


@query(f"WITH {_VOC}, {_BTF} SELECT token, sum(tf) AS tf FROM bt JOIN voc USING (token) GROUP BY token")
def encode_decode(spark, d):
    """The benchmark's bag keyed by id and back; what the vocabulary lacks is gone."""
    voc = _voc(spark, d)
    bag = term_frequencies(tokenize(table(spark, d, "benchmark"), CFG), keys=("item_id",)).select("token", F.col("tf").alias("value"))
    return vb.decode(vb.encode(bag, voc).where("token_id > 0"), voc).select("token", F.col("value").cast("decimal(38,0)").alias("tf"))


@query(f"WITH {_VOC} SELECT doc_id, token, tf FROM tf JOIN voc USING (token) WHERE ndocs >= 5")
def bag_of_words(spark, d):
    """Bags of all documents over a pruned vocabulary."""
    t = _terms(spark, d)
    return vb.keep_known(t.bags.select("doc_id", "token", "tf"), t.vocabulary(5))


# -- weighting and vectors ----------------------------------------------------------------------
def _model(spark, d, gw="idf", lw="tf") -> wt.VectorModel:
    return wt.vector_model(_voc(spark, d), gw, lw)


@query(f"WITH {_IDF} SELECT token, round(weight, 9) AS weight FROM wt")
def weights_idf(spark, d):
    """Inverse document frequencies."""
    return _model(spark, d).weights.select("token", F.round("weight", 9).alias("weight"))


def _vector_sql(local: str, weight: str) -> str:
    return f"""WITH {_IDF}, raw AS (SELECT doc_id, token, {local} * {weight} AS w FROM tf JOIN wt USING (token))
SELECT doc_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 7) AS w FROM raw WHERE w >= 1e-6"""


def _vectors(spark, d, gw, lw) -> DataFrame:
    t = _terms(spark, d)
    return wt.vectorize_terms(wt.vector_model(t.vocabulary(), gw, lw), t).select("doc_id", "token", F.round("w", 7).alias("w"))


@query(_vector_sql("tf / max(tf) OVER (PARTITION BY doc_id)", "weight"))
def vectors_idf_tf(spark, d):
    """Unit vectors: relative frequency times inverse document frequency."""
    return _vectors(spark, d, "idf", "tf")


@query(_vector_sql("tf / sum(tf) OVER (PARTITION BY doc_id)", "weight"))
def vectors_idf_tp(spark, d):
    """Unit vectors: term probability times inverse document frequency."""
    return _vectors(spark, d, "idf", "tp")


@query(_vector_sql("CAST(tf AS DOUBLE)", "1.0"))
def vectors_binary_freq(spark, d):
    """Unit vectors of frequencies."""
    return _vectors(spark, d, "binary", "freq")


@query(_vector_sql("CAST(1 AS DOUBLE)", "weight"))
def vectors_idf_binary(spark, d):
    """Unit vectors: presence times inverse document frequency."""
    return _vectors(spark, d, "idf", "binary")


_ENT = f"""WITH {_VOC}, cls AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL),
n AS (SELECT token, lang, count(*) AS n FROM tf JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE lang IS NOT NULL GROUP BY token, lang),
g AS (SELECT token, ndocs, lang, coalesce(n, 0) + 3.0 AS c FROM voc CROSS JOIN cls LEFT JOIN n USING (token, lang)),
r AS (SELECT lang, sum(c) AS s FROM g GROUP BY lang), x AS (SELECT token, ndocs, CAST(c AS DOUBLE) * (SELECT sum(s) FROM r) / s AS c FROM g JOIN r USING (lang)),
h AS (SELECT token, ndocs, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h, log2(count(*)) AS hmax FROM x GROUP BY token, ndocs)
"""


def _entropy(comb: str, weights="balance"):
    def run(spark, d):
        t = _terms(spark, d)
        own = docs_of(spark, d).where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("__class"))
        seen = t.bags.join(own, "doc_id").groupBy("token", "__class").agg(F.count(F.lit(1)).alias("__n"))
        out = wt.entropy_of_counts(t.vocabulary(), seen, own.select("__class").distinct(), weights=weights, comb=comb)
        return out.select("token", F.round("weight", 7).alias("weight"))

    return run


for _name, _expr in (("normalized", "1 - h / hmax"), ("sigmoid", "(1 - h / hmax) * (1 - 1 / (1 + log2(ndocs)))"), ("penalize", "(hmax - h) * log2(ndocs)")):
    QUERIES[f"entropy_{_name}"] = _entropy(_name)
    SQL[f"entropy_{_name}"] = _ENT + f"SELECT token, round(CASE WHEN ndocs < 3 THEN 0.0 ELSE {_expr} END, 7) AS weight FROM h"
_CLASSES = {"en": 0.5, "fr": 1.0, "de": 2.0, "es": 3.0}
for _name, _given, _scale in (("unweighted", "none", "1.0"), ("class_weights", _CLASSES, "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CLASSES.items()) + " END")):
    QUERIES[f"entropy_{_name}"] = _entropy("normalized", _given)
    SQL[f"entropy_{_name}"] = _ENT.replace("CAST(c AS DOUBLE) * (SELECT sum(s) FROM r) / s AS c FROM g JOIN r USING (lang)", f"CAST(c AS DOUBLE) * {_scale} AS c FROM g") + "SELECT token, round(CASE WHEN ndocs < 3 THEN 0.0 ELSE 1 - h / hmax END, 7) AS weight FROM h"


@query(f"WITH {_IDF} SELECT token, occs, ndocs, round(weight, 9) AS weight FROM voc JOIN wt USING (token) WHERE weight > 3 AND occs > ndocs")
def model_filtered(spark, d):
    """A model reduced by a predicate that sees the weights."""
    return _model(spark, d).filter("weight > 3 AND occs > ndocs").weights.withColumn("weight", F.round("weight", 9))


@query(f"WITH {_VOC}, raw AS (SELECT doc_id, token, tf / max(tf) OVER (PARTITION BY doc_id) * (1.0 / ndocs) AS w FROM tf JOIN voc USING (token)) SELECT doc_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 7) AS w FROM raw WHERE w >= 1e-6")
def vectors_given_weights(spark, d):
    """Unit vectors under weights given by the caller."""
    t = _terms(spark, d)
    voc = t.vocabulary()
    given = voc.table.select("token", (1.0 / F.col("ndocs")).alias("weight"))
    return wt.vectorize_terms(wt.vector_model(voc, weights=given), t).select("doc_id", "token", F.round("w", 7).alias("w"))


@query(f"WITH {_VEC}, s AS (SELECT source, token, sum(w) AS w FROM vec JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source, token) SELECT source, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY source)), 7) AS w FROM s")
def centroids(spark, d):
    """Centroid of each source's vectors."""
    t = _terms(spark, d)
    vec = wt.vectorize_terms(wt.vector_model(t.vocabulary()), t).join(docs_of(spark, d).select("doc_id", "source"), "doc_id")
    return vectors.centroid(vec, "source").select("source", "token", F.round("w", 7).alias("w"))


def _item_vectors(spark, d, normalize: bool = False) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return wt.vectorize(_model(spark, d), items, normalize=normalize)


_BVEC = _IDF + _Q + ", bvec AS (SELECT query_id, token, tf / max(tf) OVER (PARTITION BY query_id) * weight AS w FROM qt JOIN wt USING (token)), bn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM bvec WHERE w >= 1e-6 GROUP BY query_id), cos AS (SELECT a.query_id AS a, b.query_id AS b, sum(a.w * b.w) AS dot FROM bvec a JOIN bvec b USING (token) WHERE a.w >= 1e-6 AND b.w >= 1e-6 GROUP BY ALL), cs AS (SELECT a, b, dot / (x.n * y.n) AS c FROM cos JOIN bn x ON a = x.query_id JOIN bn y ON b = y.query_id)"


@query(f"WITH {_BVEC} SELECT a, b, abs(round(1 - c, 6)) AS dist FROM cs")
def cosine_distances(spark, d):
    """Cosine distances between benchmark items that share a token."""
    v = _item_vectors(spark, d)
    return vectors.distances(v, v, "cosine").select("a", "b", F.abs(F.round("dist", 6)).alias("dist"))


@query(f"WITH {_BVEC} SELECT a, b, round(acos(greatest(-1, least(1, c))), 5) AS dist FROM cs WHERE a <> b")
def angle_distances(spark, d):
    """Angles between different benchmark items that share a token."""
    v = _item_vectors(spark, d)
    return vectors.distances(v, v, "angle").where("a <> b").select("a", "b", F.round("dist", 5).alias("dist"))


def _norm_distances(kind: str, digits: int):
    def run(spark, d):
        v = _item_vectors(spark, d, True)
        return vectors.distances(v, v, kind).where("a <> b").select("a", "b", F.round("dist", digits).alias("dist"))

    return run


QUERIES["normcosine_distances"] = _norm_distances("normcosine", 6)
SQL["normcosine_distances"] = f"WITH {_BVEC} SELECT a, b, round(1 - c, 6) AS dist FROM cs WHERE a <> b"
QUERIES["normangle_distances"] = _norm_distances("normangle", 5)
SQL["normangle_distances"] = f"WITH {_BVEC} SELECT a, b, round(acos(greatest(-1, least(1, c))), 5) AS dist FROM cs WHERE a <> b"
_BU = ", bu AS (SELECT query_id, token, w / n AS w FROM bvec JOIN bn USING (query_id) WHERE w >= 1e-6)"


@query(f"WITH {_BVEC}{_BU}, x AS (SELECT query_id // 2 AS pair, token, sum(CASE WHEN query_id % 2 = 0 THEN 2 * w ELSE -w END) AS w FROM bu GROUP BY ALL) SELECT pair, token, round(w, 7) AS w FROM x WHERE abs(w) > 1e-9")
def vector_sums(spark, d):
    """Twice the vector of each even benchmark item less that of the next."""
    v = _item_vectors(spark, d, True)
    pair = (F.col("doc_id") / 2).cast("long").alias("doc_id")
    even, odd = (v.where(F.col("doc_id") % 2 == k).select(pair, "token", "w") for k in (0, 1))
    out = vectors.add(vectors.scale(even, 2.0), odd, sign=-1.0)
    return out.where("abs(w) > 1e-9").select(F.col("doc_id").alias("pair"), "token", F.round("w", 7).alias("w"))


@query(f"WITH {_BVEC}{_BU} SELECT query_id AS doc_id, round(sqrt(sum(w * w)), 7) AS norm, round(sum(w), 6) AS total, count(*) AS n FROM bu GROUP BY query_id")
def vector_maps(spark, d):
    """Norms and sums of vectors that went through maps and back."""
    v = vectors.from_maps(vectors.to_maps(_item_vectors(spark, d, True)))
    sums = v.groupBy("doc_id").agg(F.round(F.sum("w"), 6).alias("total"), F.count(F.lit(1)).alias("n"))
    return vectors.norms(v).withColumn("norm", F.round("norm", 7)).join(sums, "doc_id")


@query(f"WITH {_BVEC}{_BU}, i AS (SELECT token, row_number() OVER (ORDER BY occs DESC, token) AS token_id FROM voc) SELECT CAST(token_id AS BIGINT) AS token_id, query_id AS doc_id, round(w, 7) AS w FROM bu JOIN i USING (token) WHERE w >= 0.05")
def vector_triplets(spark, d):
    """Coordinate triplets of vectors, small weights dropped."""
    voc = _voc(spark, d)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    v = wt.vectorize(wt.vector_model(voc), items)
    return vectors.coo(v, voc.with_ids(), minweight=0.05).select(F.col("token_id").cast("long"), "doc_id", F.round("w", 7).alias("w"))


@query(f"WITH {_BVEC}{_BU} SELECT query_id AS doc_id, rank, token FROM (SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, token) AS rank FROM bu) WHERE rank <= 3")
def heaviest_terms(spark, d):
    """The three heaviest tokens of every benchmark item."""
    v = _item_vectors(spark, d, True)
    return index.top_k(v.withColumn("w", F.round("w", 9)), 3, F.desc("w"), query="doc_id", doc="token").select("doc_id", "rank", "token")


# -- search ---------------------------------------------------------------------------------------
_BM25 = _VOC + _Q + """, dl AS (SELECT doc_id, sum(tf) AS doclen FROM tf GROUP BY doc_id),
s AS (SELECT query_id, doc_id, count(*) AS hits, round(sum(ln(1 + (trainsize - ndocs + 0.5) / (ndocs + 0.5)) * (tf.tf * 2.2 / (tf.tf + 1.2 * 0.25 + doclen * 1.2 * 0.75 / (numtokens / trainsize)) + 1)), 6) AS score
    FROM qt JOIN voc USING (token) JOIN tf USING (token) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY query_id, doc_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE hits >= {t})
SELECT query_id, rank, doc_id, score, -score AS dist FROM r WHERE rank <= 10"""


def _bm25(spark, d, t=1) -> DataFrame:
    terms = _terms(spark, d)
    return index.BM25Index(terms.vocabulary()).append_terms(terms).search(items_of(spark, d), 10, t)


@query(f"WITH {_BM25.replace('{t}', '1')}")
def search_bm25(spark, d):
    """Ten best documents of every benchmark item by BM25+."""
    return _bm25(spark, d)


@query(f"WITH {_BM25.replace('{t}', '5')}")
def search_bm25_threshold(spark, d):
    """The same among documents that share five tokens with the item."""
    return _bm25(spark, d, 5)


@query(f"WITH {_BM25.replace('{t}', '1')}")
def search_bm25_caught_up(spark, d):
    """The same by an index that held half of the documents and caught up with the rest; a second time changes nothing."""
    terms = _terms(spark, d)
    bags = terms.bags.select("doc_id", "token", "tf")
    middle = docs_of(spark, d).agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    half = index.BM25Index(terms.vocabulary()).append_bags(bags.where(F.col("doc_id") <= middle))
    whole = half.catch_up(bags)
    return whole.catch_up(bags).search(items_of(spark, d), 10)


@query(f"WITH {_BM25.replace('{t}', '1')}")
def search_bm25_stored(spark, d):
    """The same by an index stored in parts, of which only those of the queries' tokens are read."""
    root = f"{Scratch(spark, 'index').path}/index"
    docs = docs_of(spark, d)
    incremental.index_sink(root, CFG)(docs.select("doc_id", "text"), 0)
    asked = term_frequencies(tokenize(items_of(spark, d), CFG), keys=("query_id",))
    own = incremental.read_index(spark, root, _voc(spark, d), asked)
    return replace(own, prune=True).search(items_of(spark, d), 10)


_ONE = _BM25.split(", s AS (SELECT query_id, doc_id, count(*)")[0]


@query(f"""WITH {_VOC}, dl AS (SELECT doc_id, sum(tf) AS doclen FROM tf GROUP BY doc_id)
SELECT doc_id, round(sum(ln(1 + (trainsize - ndocs + 0.5) / (ndocs + 0.5)) * (tf.tf * 2.2 / (tf.tf + 1.2 * 0.25 + doclen * 1.2 * 0.75 / (numtokens / trainsize)) + 1)), 6) AS score
FROM voc JOIN tf USING (token) JOIN dl USING (doc_id) CROSS JOIN st WHERE token IN ('the', 'of', 'system') GROUP BY doc_id""")
def bm25_scores(spark, d):
    """BM25+ scores of one query over all documents it touches."""
    terms = _terms(spark, d)
    own = index.bm25_score(index.BM25Index(terms.vocabulary()).append_terms(terms), "the system of the system")
    return own.select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_TF}, {_BTF}, bs AS (SELECT (SELECT count(*) FROM benchmark) AS trainsize, (SELECT count(*) FROM bt) AS numtokens),
p AS (SELECT 1 AS doc_id, 'the' AS token, 2 AS tf, 4 AS doclen UNION ALL SELECT 1, 'of', 1, 4 UNION ALL SELECT 1, 'and', 1, 4 UNION ALL SELECT 2, 'the', 1, 1)
SELECT CAST(doc_id AS BIGINT) AS doc_id, round(sum(ln(1 + (trainsize - ndocs + 0.5) / (ndocs + 0.5)) * (tf * 2.2 / (tf + 1.2 * 0.25 + doclen * 1.2 * 0.75 / (numtokens / trainsize)) + 1)), 6) AS score
FROM p JOIN bv USING (token) CROSS JOIN bs WHERE token IN ('the', 'of') AND 'the' IN (SELECT token FROM bv) GROUP BY doc_id""")
def bm25_pushed(spark, d):
    """Two documents pushed one by one into an index over the benchmark's vocabulary."""
    voc = vb.terms(table(spark, d, "benchmark").select("item_id", "text"), CFG, key="item_id").vocabulary()
    own = index.BM25Index(voc).push("The of the and zzzzzzz").push("the")
    assert own.events == ["add", "add"]
    return index.bm25_score(own, "of the").select("doc_id", F.round("score", 6).alias("score"))


_COS = _VEC + _Q + """, qv AS (SELECT query_id, token, tf / max(tf) OVER (PARTITION BY query_id) * weight AS w FROM qt JOIN wt USING (token)),
qu AS (SELECT query_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qv WHERE w >= 1e-6),
s AS (SELECT query_id, doc_id, round(1 - sum(qu.w * vec.w), 6) AS dist FROM qu JOIN vec USING (token) GROUP BY query_id, doc_id)"""
_TOP = " SELECT query_id, rank, doc_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS rank FROM s) WHERE rank <= 10"


@query(f"WITH {_COS}{_TOP}")
def search_cosine(spark, d):
    """Ten nearest documents of every benchmark item by cosine."""
    terms = _terms(spark, d)
    return index.TextIndex(wt.vector_model(terms.vocabulary())).append_terms(terms).search(items_of(spark, d), 10)


@query(f"WITH {_COS}{_TOP}")
def search_cosine_of_corpus(spark, d):
    """The same by an index made from config and corpus, the documents then appended as text."""
    docs = docs_of(spark, d)
    return index.index_of_corpus(CFG, docs).append(docs).search(items_of(spark, d), 10)


def _set_search(kind: str):
    def run(spark, d):
        terms = _terms(spark, d)
        return index.index_of_vocabulary(terms.vocabulary(), dist=kind).append_terms(terms).search(items_of(spark, d), 10)

    return run


for _name, _expr in (("jaccard", "i / (a + b - i)"), ("dice", "2 * i / (a + b)"), ("intersection", "i / greatest(a, b)"), ("cosineset", "i / sqrt(a * b)")):
    QUERIES[f"search_{_name}"] = _set_search(_name)
    SQL[f"search_{_name}"] = f"""WITH {_VOC}{_Q}, a AS (SELECT query_id, count(*) AS a FROM qt GROUP BY query_id), b AS (SELECT doc_id, count(*) AS b FROM tf GROUP BY doc_id),
p AS (SELECT query_id, doc_id, count(*) AS i FROM qt JOIN tf USING (token) GROUP BY query_id, doc_id),
s AS (SELECT query_id, doc_id, round(1 - {_expr}, 6) AS dist FROM p JOIN a USING (query_id) JOIN b USING (doc_id)){_TOP}"""


def _synonyms(spark, rows=SYNONYMS) -> DataFrame:
    return spark.createDataFrame(rows, profile.SYNONYMS)


_SYN = ", syn AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {r}, '{b}', {'NULL' if x is None else x})" for a, r, b, x in SYNONYMS) + ") AS v(token, rank, neighbor, distance))"


@query(f"""WITH {_IDF}{_Q}{_SYN}, qv AS (SELECT query_id, token, tf / max(tf) OVER (PARTITION BY query_id) * weight AS w FROM qt JOIN wt USING (token)),
base AS (SELECT * FROM qv WHERE w >= 1e-6), more AS (SELECT query_id, neighbor AS token, w * coalesce(exp(-distance), 1.0 / rank) AS w FROM base JOIN syn USING (token) WHERE neighbor IN (SELECT token FROM voc)),
s AS (SELECT query_id, token, sum(w) AS w FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY ALL)
SELECT query_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY query_id)), 7) AS w FROM s""")
def expand_vectors(spark, d):
    """Benchmark items expanded by synonyms, weighted by distance."""
    voc = _voc(spark, d)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    out = expansion.expand_vectors(wt.vectorize(wt.vector_model(voc), items, normalize=False), voc, _synonyms(spark), use_distances=True)
    return out.select(F.col("doc_id").alias("query_id"), "token", F.round("w", 7).alias("w"))


@query(f"WITH {_VOC}{_Q}{_SYN} SELECT query_id, token, tf FROM qt UNION ALL (SELECT DISTINCT query_id, neighbor, 1 FROM qt JOIN syn USING (token) WHERE neighbor IN (SELECT token FROM voc) AND (query_id, neighbor) NOT IN (SELECT (query_id, token) FROM qt))")
def expand_bags(spark, d):
    """Bags of benchmark items with absent synonyms added once."""
    voc = _voc(spark, d)
    bags = vb.bag_of_words(voc, table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    return expansion.expand_bags(bags, voc, _synonyms(spark)).withColumnRenamed("doc_id", "query_id")


@query(f"WITH {_SYN[2:]}, q AS (SELECT item_id, unnest({_tokens('text')}) AS token FROM benchmark) SELECT DISTINCT item_id, neighbor AS token FROM q JOIN syn USING (token) WHERE rank <= 1 AND (item_id, neighbor) NOT IN (SELECT (item_id, token) FROM q)")
def expand_tokens(spark, d):
    """The first neighbours of each benchmark item's tokens that it doesn't hold already."""
    own = tokenize(table(spark, d, "benchmark"), CFG).select("item_id", F.explode("tokens").alias("token"))
    return expansion.expand_tokens(own, _synonyms(spark), 1, key="item_id")


@query(f"WITH {_T} SELECT doc_id FROM t WHERE len(list_filter(tokens, lambda x: x IN ('the', 'of', 'system'))) >= 5")
def grep(spark, d):
    """Documents with five occurrences or more of some words."""
    return index.grep(tokenize(docs_of(spark, d), CFG), ["the", "of", "system"], 5).select("doc_id")


_LISTS = "a AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity < 3), b AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_discount > 0.08), c AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_tax < 0.01)"


def _lists(spark, d) -> list[DataFrame]:
    li = table(spark, d, "lineitem")
    return [li.where(x).select(F.col("l_suppkey").alias("id")).distinct() for x in ("l_quantity < 3", "l_discount > 0.08", "l_tax < 0.01")]


@query(f"WITH {_T} SELECT doc_id FROM t WHERE len(list_distinct(list_filter(tokens, lambda x: x IN ('the', 'of', 'and', 'der')))) >= 2")
def grep_distinct(spark, d):
    """Documents with two or more of some words."""
    return index.grep(tokenize(docs_of(spark, d), CFG), ["the", "of", "and", "der"], 2, mode="set").select("doc_id")


@query(f"WITH {_LISTS} SELECT id FROM a INTERSECT SELECT id FROM b INTERSECT SELECT id FROM c")
def posting_intersection(spark, d):
    """Ids in all of three lists."""
    return index.intersect(_lists(spark, d))


@query(f"WITH {_LISTS} SELECT id FROM (SELECT id FROM a UNION ALL SELECT id FROM b UNION ALL SELECT id FROM c) GROUP BY id HAVING count(*) >= 2")
def posting_threshold(spark, d):
    """Ids in two of three lists or more."""
    return index.union(_lists(spark, d), t=2)


# -- embeddings -------------------------------------------------------------------------------------
def _embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _asked(e: DataFrame) -> DataFrame:
    """The queries of a search: every row whose id is a multiple of 20."""
    return e.where(F.col("id") % 20 == 0)


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 - list_cosine_similarity(a.x, b.x), 6) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM p) WHERE rank <= 10""")
def dense_knn(spark, d):
    """Ten nearest of all embeddings by cosine, of every embedding whose id is a multiple of 20."""
    e = _embeddings(spark, d)
    return em.nearest(e, _asked(e), 10, "embedding")


@query()
def dense_knn_approx(spark, d):
    """The same over bucketed random projections."""
    e = _embeddings(spark, d)
    return em.nearest_approx(e, 10, "embedding", queries=_asked(e))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.x, b.x), 6) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rank FROM p)
SELECT a AS token, rank, b AS neighbor, dist AS distance FROM r WHERE rank <= 8""")
def synonyms_of_vectors(spark, d):
    """Eight nearest tokens of every token under given word vectors (embeddings under their numbers), by comparing all."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("token"), F.col("embedding").alias("emb"))
    return em.synonyms(e, 8, approx=False)


_LO = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT vec_id, x, list_min(x) AS lo, CASE WHEN list_max(x) > list_min(x) THEN (list_max(x) - list_min(x)) / 255 ELSE 1 END AS step FROM e)"


@query(_LO + " SELECT vec_id, round(lo, 7) AS lo, round(step, 9) AS step, list_transform(x, lambda v: CAST(floor((v - lo) / step + 0.5) AS INTEGER)) AS codes FROM s")
def quantize(spark, d):
    """Embeddings in 256 levels of their own."""
    e = _embeddings(spark, d).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return em.quantize(e, "embedding", "id").select(F.col("id").alias("vec_id"), F.round("lo", 7).alias("lo"), F.round("step", 9).alias("step"), "codes")


@query("SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: CAST(floor((greatest(-0.3, least(0.3, v)) + 0.3) / (0.6 / 255) + 0.5) AS INTEGER)) AS codes FROM embeddings")
def quantize_global(spark, d):
    """Embeddings in 256 common levels."""
    return em.quantize_global(_embeddings(spark, d), "embedding", "id", (-0.3, 0.3)).select(F.col("id").alias("vec_id"), "codes")


@query("SELECT vec_id, list_aggregate(list_transform(list_reverse(embedding), lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM embeddings")
def bit_sketch_words(spark, d):
    """Sign sketches of every embedding written out, the highest bit first."""
    s = em.bit_sketch(_embeddings(spark, d), "embedding")
    return s.select(F.col("id").alias("vec_id"), F.array_join(F.reverse(F.transform("sketch", lambda x: F.lpad(F.bin(x), 64, "0"))), "").alias("bits"))


@query("WITH x AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), q AS (SELECT quantile_disc(x, 0.025) AS lo, quantile_disc(x, 0.975) AS hi FROM x) SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: CAST(floor((greatest(lo, least(hi, v)) - lo) / ((hi - lo) / 255) + 0.5) AS INTEGER)) AS codes FROM embeddings, q")
def quantize_quantiles(spark, d):
    """Embeddings in 256 common levels between two quantiles of all components."""
    return em.quantize_global(_embeddings(spark, d), "embedding", "id").select(F.col("id").alias("vec_id"), "codes")


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END)) AS ones FROM embeddings")
def bit_sketch(spark, d):
    """Bits set in the sign sketch of every embedding: its Hamming distance from zero."""
    s = em.bit_sketch(_embeddings(spark, d), "embedding")
    ones = em.hamming(F.col("sketch"), F.transform("sketch", lambda x: x.bitwiseXOR(x)))
    return s.select(F.col("id").alias("vec_id"), ones.cast("decimal(38,0)").alias("ones"))


_EMB = ", emb AS (SELECT token, CASE WHEN ndocs >= 50 THEN [CAST(length(token) AS DOUBLE), CAST(ndocs AS DOUBLE), 1.0] ELSE [0.0, 0.0, 0.0] END AS emb FROM voc)"


def _given_vectors(spark, d, t: vb.Terms) -> tuple[em.DenseModel, int]:
    """Word vectors read from a JSON file that has those of the frequent tokens only, and of one unknown."""
    model = wt.vector_model(t.vocabulary())
    frequent = model.weights.where("ndocs >= 50").select("token", F.array(F.length("token").cast("double"), F.col("ndocs").cast("double"), F.lit(1.0)).alias("emb"))
    path = f"{Scratch(spark, 'vectors').path}/vectors.json"
    rows = {r["token"]: r["emb"] for r in frequent.collect()} | {"no such token": [1.0, 2.0, 3.0]}  # a file of the frequent tokens
    write_bytes(spark, path, json.dumps(rows).encode())
    return em.external(model, read_embeddings(spark, path), 3)


@query(f"WITH {_VOC}{_EMB}, m AS (SELECT count(*) AS missing FROM voc WHERE ndocs < 50) SELECT token, emb, missing FROM emb, m")
def external_vectors(spark, d):
    """Given word vectors of all tokens, zeros for those without, which are counted."""
    dense, missing = _given_vectors(spark, d, _terms(spark, d))
    return dense.wordvectors().withColumn("missing", F.lit(missing).cast("long"))


@query(f"""WITH {_VEC}{_EMB}, c AS (SELECT doc_id, sum(w * emb[1]) AS x, sum(w * emb[2]) AS y, sum(w * emb[3]) AS z FROM vec JOIN emb USING (token) GROUP BY doc_id), n AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM c)
SELECT d.doc_id, CASE WHEN n > 0 THEN [round(x / n, 6), round(y / n, 6), round(z / n, 6)] ELSE [0.0, 0.0, 0.0] END AS emb FROM documents d LEFT JOIN n USING (doc_id)""")
def projected_documents(spark, d):
    """Documents under given word vectors, unit length, zeros without known tokens."""
    t = _terms(spark, d)
    dense, _ = _given_vectors(spark, d, t)
    return dense.vectorize_terms(t, docs_of(spark, d)).select("doc_id", F.transform("emb", lambda x: F.round(x, 6)).alias("emb"))


@query(f"""WITH {_VOC}, d AS (SELECT token, j, md5('7:' || j || ':' || token) AS h FROM voc CROSS JOIN (SELECT unnest(range(4)) AS j)),
e AS (SELECT token, j * 4 + CAST('0x' || substr(h, 1, 8) AS BIGINT) % 4 AS pl, CASE WHEN CAST('0x' || substr(h, 9, 1) AS BIGINT) % 2 = 0 THEN 0.5 ELSE -0.5 END AS v FROM d)
SELECT token, list_transform(range(16), lambda i: coalesce(CAST(map_extract(map_from_entries(list((pl, v))), i)[1] AS DOUBLE), 0.0)) AS emb FROM e GROUP BY token""")
def random_vectors(spark, d):
    """Ternary random projection of every token to 16 dimensions."""
    return em.random_indexing(wt.vector_model(_voc(spark, d)), 16, "ternary", seed=7).wordvectors()


@query(f"""WITH {_VEC}, d AS (SELECT token, j, md5('0:' || j || ':' || token) AS h FROM voc CROSS JOIN (SELECT unnest(range(8)) AS j)),
e AS (SELECT token, j * 8 + CAST('0x' || substr(h, 1, 8) AS BIGINT) % 8 AS pl, CASE WHEN CAST('0x' || substr(h, 9, 1) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS v FROM d),
c AS (SELECT doc_id, pl, sum(w * v) AS x FROM vec JOIN e USING (token) GROUP BY doc_id, pl), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n, map_from_entries(list((pl, x))) AS m FROM c GROUP BY doc_id)
SELECT d.doc_id, list_transform(range(64), lambda i: CASE WHEN n > 0 THEN coalesce(round(map_extract(m, i)[1] / n, 5), 0.0) + 0.0 ELSE 0.0 END) AS emb FROM documents d LEFT JOIN n USING (doc_id)""")
def random_indexing(spark, d):
    """Documents under a ternary random projection to 64 dimensions."""
    t = _terms(spark, d)
    dense = em.random_indexing(wt.vector_model(t.vocabulary()), 64, "ternary").vectorize_terms(t, docs_of(spark, d))
    return dense.select("doc_id", F.transform("emb", lambda x: F.round(x, 5) + F.lit(0.0)).alias("emb"))


@query()
def lsi_wordvectors(spark, d):
    """Word vectors of 16 latent dimensions."""
    return em.lsi(_model(spark, d), docs_of(spark, d), 16).wordvectors(True)


@query()
def synonyms(spark, d):
    """Eight nearest tokens of every token by word vectors that sum random vectors of their documents."""
    words = em.document_indexing(_model(spark, d), docs_of(spark, d), 64).wordvectors()
    return em.synonyms(words, 8, approx=False)


@query()
def lemma_clusters(spark, d):
    """Lemmas by surface, split by word vectors."""
    m = _model(spark, d)
    return lemmas.lemma_clusters(m.voc.table, em.document_indexing(m, docs_of(spark, d), 32).wordvectors())


_GRAMS = "(CASE WHEN length({0}) < 2 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, i, 2))) END)"
_JACCARD = "1 - len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))"
_MOST = "v AS MATERIALIZED (SELECT token, occs, substring(token, 1, {n}) AS block, row_number() OVER (PARTITION BY substring(token, 1, {n}) ORDER BY {order}) AS pl FROM voc WHERE token NOT IN ({known}) AND {where})"
_KNOWN = ", ".join(f"'{a}'" for a in LEMMAS)


def _leaders(reps: str, dist: str, threshold: float, elect: str, **how) -> str:
    """Lemmas by leader groups: in each block the first free token in order takes all free ones within reach, step by step."""
    return f"""WITH RECURSIVE {_VOC}, {_MOST.format(**how)}, f AS (SELECT block, list(struct_pack(token := token, occs := occs, r := {reps.format('token')}) ORDER BY pl) AS free FROM v GROUP BY block),
s AS (SELECT block, 0 AS step, free, CAST(NULL AS STRUCT(token VARCHAR, occs BIGINT, r {how['kind']})[]) AS took FROM f
    UNION ALL SELECT block, step + 1, list_filter(free, lambda x: x.token <> free[1].token AND {dist.format('free[1].r', 'x.r')} > {threshold}), list_filter(free, lambda x: x.token = free[1].token OR {dist.format('free[1].r', 'x.r')} <= {threshold}) FROM s WHERE len(free) > 0),
g AS (SELECT block, step, unnest(took) AS m FROM s WHERE len(took) > 1), e AS (SELECT block, step, arg_min(m.token, ({elect})) AS lemma FROM g GROUP BY block, step)
SELECT m.token AS token, lemma FROM g JOIN e USING (block, step) WHERE m.token <> lemma"""


@query(_leaders(_GRAMS, _JACCARD, 0.3, "(-m.occs, m.token)", n=3, order="occs DESC, token", known=_KNOWN, kind="VARCHAR[]", where="true"))
def extend_lemmas(spark, d):
    """Further lemmas by surface alone, of all tokens."""
    known = spark.createDataFrame(list(LEMMAS.items()), profile.LEMMAS)
    return lemmas.extend_lemmas(_voc(spark, d).table, known)


_LEVENSHTEIN = "levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1)"


@query(_leaders("{0}", _LEVENSHTEIN, 0.25, "(length(m.token), -m.occs, m.token)", n=4, order="length(token), occs DESC, token", known=_KNOWN, kind="VARCHAR", where="true"))
def extend_lemmas_levenshtein(spark, d):
    """The same by edit distance within four common characters, shortest token first."""
    known = spark.createDataFrame(list(LEMMAS.items()), profile.LEMMAS)
    return lemmas.extend_lemmas(_voc(spark, d).table, known, selector="shortest_then_most_frequent", morphology="levenshtein", morphology_threshold=0.25, min_common_prefix=4)


@query(_leaders(_GRAMS, _JACCARD, 0.4, "(length(m.token), m.token)", n=3, order="length(token), token", known=_KNOWN, kind="VARCHAR[]", where="true") + " AND m.token IN (SELECT token FROM voc WHERE ndocs = 2)")
def extend_lemmas_candidates(spark, d):
    """Lemmas of the tokens of two documents only, shortest token first."""
    voc = _voc(spark, d)
    known = spark.createDataFrame(list(LEMMAS.items()), profile.LEMMAS)
    return lemmas.extend_lemmas(voc.table, known, voc.table.where("ndocs = 2"), selector="shortest", morphology_threshold=0.4)


# -- profiles -------------------------------------------------------------------------------------------
_SYN2 = _SYN[2:] + ", syn2 AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {r}, '{b}', {x})" for a, r, b, x in OTHER_SYNONYMS) + ") AS v(token, rank, neighbor, distance))"


@query(f"""WITH {_SYN2}, u AS (SELECT *, 0 AS src FROM syn UNION ALL SELECT *, 1 FROM syn2), wide AS (SELECT token, max(n) AS wide FROM (SELECT token, src, count(*) AS n FROM u GROUP BY token, src) GROUP BY token),
f AS (SELECT token, neighbor, round(sum(1.0 / (60 + rank)), 12) AS score, avg(CAST(distance AS DOUBLE)) AS distance FROM u GROUP BY token, neighbor),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, coalesce(distance, 'inf'::DOUBLE), neighbor) AS rank FROM f),
k AS (SELECT r.* FROM r JOIN wide USING (token) WHERE rank <= wide)
SELECT token, rank, neighbor, CASE WHEN count(distance) OVER (PARTITION BY token) = count(*) OVER (PARTITION BY token) THEN round(distance, 9) END AS distance FROM k""")
def fuse_synonyms(spark, d):
    """Two thesauri fused by reciprocal ranks."""
    return profile.fuse_synonyms([_synonyms(spark), _synonyms(spark, OTHER_SYNONYMS)]).withColumn("distance", F.round("distance", 9))


_FOLD = "CASE token " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEMMAS.items()) + " ELSE token END"


@query(f"WITH {_VOC}, m AS (SELECT {_FOLD} AS lemma, occs, ndocs FROM voc) SELECT lemma AS token, CAST(sum(occs) AS BIGINT) AS occs, CAST(least(sum(ndocs), (SELECT trainsize FROM st)) AS BIGINT) AS ndocs FROM m WHERE lemma IN (SELECT token FROM voc) GROUP BY lemma")
def fold_lemmas(spark, d):
    """Counters of inflected tokens summed onto their lemmas."""
    return profile.fold_lemmas(_voc(spark, d), LEMMAS).table


def _part(spark, d, english: bool) -> vb.Vocabulary:
    """Vocabulary of the English documents, or of all others."""
    en = F.coalesce(F.col("lang") == "en", F.lit(False))
    return vb.terms(docs_of(spark, d).where(en if english else ~en), CFG).vocabulary()


def _half(name: str, where: str) -> str:
    return f"{name}t AS MATERIALIZED (SELECT doc_id, {_tokens('text')} AS tokens FROM documents WHERE {where}), {name}f AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS token FROM {name}t) GROUP BY ALL), {name} AS (SELECT token, sum(tf) AS occs, count(*) AS ndocs FROM {name}f GROUP BY token)"


_BLEND = f"""WITH {_half("s", "lang = 'en'")}, {_half("b", "lang <> 'en' OR lang IS NULL")}, z AS (SELECT (SELECT count(*) FROM st) AS ns, (SELECT count(*) FROM bt) AS nb),
j AS (SELECT coalesce(s.token, b.token) AS token, s.occs AS so, s.ndocs AS sn, b.ndocs AS bn, CAST(round_even(ns * coalesce(b.occs / nb, 0.0), 0) AS BIGINT) AS ao, CAST(round_even(ns * coalesce(b.ndocs / nb, 0.0), 0) AS BIGINT) AS an, ns, nb FROM s FULL JOIN b ON s.token = b.token CROSS JOIN z),
o AS (SELECT token, CAST(coalesce(so, 0) + ao AS BIGINT) AS occs, CAST(least(coalesce(sn, 0) + an, 2 * ns) AS BIGINT) AS ndocs FROM j
WHERE (sn IS NOT NULL OR (bn / nb >= 1e-5 AND bn >= 3 AND (an > 0 OR ao > 0))) AND least(coalesce(sn, 0) + an, 2 * ns) >= 1)"""


@query(_BLEND + " SELECT token, occs, ndocs FROM o")
def blend_vocabularies(spark, d):
    """English documents as a sample, blended with as many documents' worth of the others."""
    return profile.blend(_part(spark, d, False), _part(spark, d, True)).table


@query(f"WITH {_VOC}{_SYN} SELECT token, row_number() OVER (PARTITION BY token ORDER BY rank, neighbor) AS rank, neighbor, CAST(distance AS DOUBLE) AS distance FROM syn WHERE token IN (SELECT token FROM voc) AND neighbor IN (SELECT token FROM voc)")
def restrict_synonyms(spark, d):
    """A thesaurus restricted to the vocabulary."""
    return profile.restrict_synonyms(_synonyms(spark), _voc(spark, d).table)


def _profile(voc: vb.Vocabulary) -> profile.Profile:
    return profile.Profile(wt.vector_model(voc))


@query(f"WITH {_VOC} SELECT token, occs, ndocs, round(log2((0.5 + trainsize) / (0.5 + ndocs)), 9) AS weight FROM voc, st")
def merge_profiles(spark, d):
    """Profiles of the English and of all other documents, merged: weights as of the whole."""
    parts = [_profile(_part(spark, d, x)) for x in (True, False)]
    return profile.merge_profiles(parts).model.weights.withColumn("weight", F.round("weight", 9))


@query(_BLEND + """ SELECT token, occs, ndocs, round(log2((0.5 + 2 * (SELECT ns FROM z)) / (0.5 + ndocs)), 9) AS weight FROM o""")
def refit_profile(spark, d):
    """The profile of all other documents refitted to the English ones."""
    base = _profile(_part(spark, d, False))
    english = docs_of(spark, d).where("lang = 'en'").select("doc_id", "text")
    return profile.refit_profile(base, english).model.weights.withColumn("weight", F.round("weight", 9))


@query(_BLEND + """, t AS (SELECT sum(occs) AS blend, (SELECT count(*) FROM sf) AS sample FROM o) SELECT CAST(2 * ns AS BIGINT) AS trainsize, CAST(blend AS BIGINT) AS blended, CAST(round_even(2 * ns * (sample / ns), 0) AS BIGINT) AS sampled, CAST(round_even(2 * ns * 12.5, 0) AS BIGINT) AS given FROM t, z""")
def blended_sizes(spark, d):
    """Number of tokens of a blended vocabulary in its three ways."""
    base, sample = _part(spark, d, False), _part(spark, d, True)
    stats = [profile.blend(base, sample, avgdoclen=x).stats.first() for x in ("blend", "sample", 12.5)]
    row = (stats[0]["trainsize"], *(x["numtokens"] for x in stats))
    return spark.createDataFrame([row], "trainsize long, blended long, sampled long, given long")


@query(f"""WITH {_VOC}, stop AS (SELECT token FROM voc, st WHERE ndocs / trainsize > 0.3) SELECT token, occs, ndocs, round(log2((0.5 + trainsize) / (0.5 + ndocs)), 9) AS weight FROM voc, st WHERE token NOT IN (SELECT token FROM stop) AND ndocs >= 2""")
def fit_profile_weights(spark, d):
    """A profile fitted to all documents: stopwords found and dropped, tokens of two documents weighted."""
    cfg = FitConfig(encoder="none", lemmas=False, doc_freq_threshold=0.3, min_ndocs=2)
    return fit_profile(docs_of(spark, d), cfg).model.weights.withColumn("weight", F.round("weight", 9))


@query(f"""WITH {_VOC}, w AS (SELECT token, occs, ndocs, log2((0.5 + trainsize) / (0.5 + ndocs)) AS weight FROM voc, st) SELECT token, occs, ndocs, round(weight, 9) AS weight FROM w""")
def saved_profile(spark, d):
    """Weights of a profile that was saved, zipped and loaded again."""
    root = Scratch(spark, "profile").path
    p = replace(_profile(_voc(spark, d)), stopwords=frozenset(STOP), lemmas=LEMMAS, synonyms=_synonyms(spark), applied=profile.Applied(True, True, False))
    store.save_profile(f"{root}/p", p)
    with tempfile.TemporaryDirectory() as local:  # the zip alone is the driver's
        store.zip_profile(f"{root}/p", f"{local}/p.zip")
        again = store.load_profile(spark, f"{local}/p.zip")
    assert (again.stopwords, again.lemmas, again.cfg, again.lineage) == (p.stopwords, p.lemmas, p.cfg, p.lineage) and again.synonyms.count() == len(SYNONYMS)
    assert "manifest.json" in list_files(spark, f"{root}/p")
    return again.model.weights.withColumn("weight", F.round("weight", 9))


#: Lemma maps that disagree: a plurality, a tie, a chain, a cycle and an unknown lemma.
VOTES = [{"houses": "house", "years": "year", "a": "of", "of": "the", "in": "on", "to": "no such token"}, {"houses": "house", "years": "the", "on": "in", "a": "and"}, {"houses": "a", "years": "year", "and": "a", "is": "in"}]
_VOTES = ", ".join(f"({i}, '{a}', '{b}')" for i, m in enumerate(VOTES) for a, b in m.items())


@query(f"""WITH RECURSIVE {_VOC}, m AS (SELECT * FROM (VALUES {_VOTES}) AS v(src, token, lemma)),
n AS (SELECT m.token, lemma, count(*) AS n, max(l.occs) AS occs FROM m JOIN voc l ON l.token = lemma WHERE m.token IN (SELECT token FROM voc) GROUP BY ALL),
won AS (SELECT token, lemma FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, occs DESC, length(lemma), lemma) AS k FROM n) WHERE k = 1),
walk AS (SELECT token, [token] AS path, token AS cur FROM won UNION ALL SELECT w.token, list_append(path, lemma), lemma FROM walk w JOIN won ON won.token = w.cur WHERE NOT list_contains(path[:len(path) - 1], w.cur)),
ends AS (SELECT token, arg_max(path, len(path)) AS path FROM walk GROUP BY token),
cyc AS (SELECT token, path, list_position(path, path[len(path)]) AS k FROM ends),
pick AS (SELECT token, CASE WHEN k = len(path) THEN path[len(path)] ELSE (SELECT arg_min(v.token, (-v.occs, length(v.token), v.token)) FROM voc v WHERE list_contains(path[k:], v.token)) END AS lemma FROM cyc)
SELECT token, lemma FROM pick WHERE token <> lemma""")
def vote_lemmas(spark, d):
    """Lemma maps put to the vote, chains followed to their end."""
    voted = profile.vote_lemmas(VOTES, _voc(spark, d).table)
    return spark.createDataFrame(sorted(voted.items()), profile.LEMMAS)


_REMAP = {"the": "a", "of": "a", "and": "in"}
_REMAP_SQL = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _REMAP.items()) + " ELSE {0} END"


@query(f"""WITH {_SYN2}, u AS (SELECT {_REMAP_SQL.format('token')} AS token, {_REMAP_SQL.format('neighbor')} AS neighbor, rank, CAST(distance AS DOUBLE) AS distance FROM (SELECT * FROM syn UNION ALL SELECT * FROM syn2)),
b AS (SELECT token, neighbor, min(rank) AS r, min(distance) AS distance FROM u WHERE token <> neighbor GROUP BY ALL)
SELECT token, row_number() OVER (PARTITION BY token ORDER BY coalesce(distance, CAST(r AS DOUBLE)), neighbor) AS rank, neighbor, distance FROM b""")
def synonyms_of_lemmas(spark, d):
    """Two thesauri rewritten to lemmas."""
    return profile.synonyms_to_lemmas(_synonyms(spark).unionByName(_synonyms(spark, OTHER_SYNONYMS)), _REMAP)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top ten of a fixed query."""
    docs = docs_of(spark, sf_dir)
    queries = spark.createDataFrame([(1, "the system of the world")], "query_id long, text string")
    terms = vb.terms(docs, CFG)
    return index.BM25Index(terms.vocabulary()).append_terms(terms).search(queries, 10)
