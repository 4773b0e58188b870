"""Queries of the library over the given tables, and the same in SQL.

German documents give words, frequencies and a stand-in lexicon; spellings that are too rare for it
play the misspellings. Names begin with the operator's number in the survey.
"""
from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import constants as K
from .functions import scalars as S
from .functions import text as T
from .operators import candidates as C
from .operators import context as X
from .operators import corpus, detect, results, synth
from .operators import lexicon as L
from .operators import ranking as R
from .plans.check import check_text, stand_in_lexicon
from .sharing import cut
from .sources import readers
from .streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- shared inputs ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def german(spark, d) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'de'").select("doc_id", "text")


def words(spark, d, docs: DataFrame | None = None) -> DataFrame:
    docs = german(spark, d) if docs is None else docs
    return docs.select("doc_id", F.explode(T.words_of(F.col("text"))).alias("word"))


def all_words(spark, d) -> DataFrame:
    return words(spark, d, table(spark, d, "documents"))


def lexicon(spark, d) -> DataFrame:
    return stand_in_lexicon(words(spark, d))


def freq(spark, d) -> DataFrame:
    return corpus.word_frequencies(words(spark, d))


def full_freq(spark, d) -> DataFrame:
    return corpus.frequency_table(T.tokenize(german(spark, d)))


def rare(spark, d) -> DataFrame:
    """Spellings that are not in the lexicon."""
    return words(spark, d).groupBy("word").agg(F.count("*").alias("n")).where("n < 3").select("word", F.lit(False).alias("is_first"))


def typos(spark, d) -> DataFrame:
    """A typo table from the corpus: mutated words of the lexicon."""
    made = synth.mutate(lexicon(spark, d).where(F.col("word").rlike(r"^\p{L}{5,}$")))
    return made.groupBy(F.lower("typo").alias("typo")).agg(F.min("word").alias("correction"))


def corpus_typos(spark, d) -> DataFrame:
    """Rare spellings with an ending too many, and what they stand for."""
    lex = lexicon(spark, d).select(F.lower("word").alias("low"), F.col("word").alias("correction"))
    seen = rare(spark, d).select(F.lower("word").alias("typo")).distinct().withColumn("low", F.regexp_replace("typo", "(?:en|er|es|e|n|s)$", ""))
    return seen.join(lex, "low").where("low <> typo").groupBy("typo").agg(F.min("correction").alias("correction"))


def user_words(spark, d) -> DataFrame:
    """Words that a user may have listed: those that occur twice."""
    return words(spark, d).groupBy("word").agg(F.count("*").alias("n")).where("n = 2").select("word")


def scratch_path(spark, name: str) -> str:
    cut(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


TOK = r"""tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}]+(?:[-''‘’][\p{L}\p{M}\d]+)*')) AS word FROM documents WHERE lang = 'de')"""
ALL_TOK = TOK.replace(" WHERE lang = 'de'", "")
LEX = TOK + r""", cnt AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
lex AS (SELECT word, (CASE WHEN regexp_full_match(word, '\p{Lu}\p{Ll}+') THEN 1 ELSE 0 END + CASE WHEN regexp_full_match(word, '\p{Ll}{2,}en') THEN 2 ELSE 0 END)::INT AS flags FROM cnt WHERE n >= 3),
rare AS (SELECT word FROM cnt WHERE n < 3), fr AS (SELECT lower(word) AS word, count(*) AS n FROM tok GROUP BY 1)"""
#: The other engine's edit distance counts bytes: letters beyond ASCII become single signs first.
BYTES = "translate({}, 'äöüßÄÖÜẞéèêëáàâíìîóòôúùûñçÉÈÊÁÀÂÓÚÑÇ', '0123456789!#$%&*+/:;<=>?@[]^_`{{|}}~()')"
#: The typed word's first letter may be in either case.
EDIT = "least(damerau_levenshtein(r.a, l.t), damerau_levenshtein(r.b, l.t))"
KEYED = "rk AS (SELECT word, " + BYTES.format("lower(word[1]) || word[2:]") + " AS a, " + BYTES.format("upper(word[1]) || word[2:]") + " AS b FROM rare), lk AS (SELECT word, " + BYTES.format("word") + " AS t FROM lex)"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def spans_sql(source: str) -> str:
    """Protected spans of source(id, text): tiles of a pattern or one sign, whose starts are sums of lengths."""
    letter, name = r"[\p{L}\p{M}][\p{L}\p{M}\p{N}_]*", r"[\p{N}_]"
    patterns = [p for p in T.PROTECTED if "(?=" not in p]
    one = "SELECT id, {n} AS p, unnest(regexp_extract_all(text, '(?s){p}|.')) AS tile, unnest(range(1, len(regexp_extract_all(text, '(?s){p}|.')) + 1)) AS k FROM {source} WHERE regexp_matches(text, '{p}')"
    # the identifier's lookahead: a name that holds a digit or an underscore
    parts = [one.format(n=n, p=_sql(p), source=source) for n, p in enumerate([*patterns, letter])]
    hits = " OR ".join(f"(p = {n} AND regexp_full_match(tile, '{_sql(p)}'))" for n, p in enumerate(patterns))
    return f"""tiles AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, (sum(length(tile)) OVER (PARTITION BY id, p ORDER BY k ROWS UNBOUNDED PRECEDING) - length(tile))::INT AS s FROM tiles),
spans AS (SELECT DISTINCT id, s, (s + length(tile))::INT AS e FROM placed WHERE {hits} OR (p = {len(patterns)} AND regexp_full_match(tile, '{letter}') AND regexp_matches(tile, '{name}')))"""


def tokens_sql(source: str) -> str:
    """toks(id, text, tok_ix, word, s, e, is_first) of source(id, text); the other engine's patterns know no lookahead."""
    plain = _sql(T.TOKEN.split("(?:[" + T.DASH + "](?=")[0])
    return spans_sql(source) + rf""", pieces AS (SELECT id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS k FROM (SELECT id, regexp_extract_all(text, '(?s){plain}|[^\p{{L}}\p{{M}}\d]+|\d') AS t FROM {source})),
cut_up AS (SELECT *, (sum(length(w)) OVER o - length(w))::INT AS s, lead(w) OVER o AS nxt, lead(w, 2) OVER o AS nxt2 FROM pieces WINDOW o AS (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING)),
raw AS (SELECT id, s, CASE WHEN regexp_matches(nxt, '^[{T.DASH}][\s.,;:!?]') OR (regexp_full_match(nxt, '[{T.DASH}]') AND nxt2 IS NULL) THEN w || nxt[1] ELSE w END AS word FROM cut_up WHERE regexp_matches(w, '[\p{{L}}\p{{M}}]')),
open_toks AS (SELECT id, word, s, (s + length(word))::INT AS e FROM raw r WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.id = r.id AND p.s < r.s + length(r.word) AND p.e > r.s)),
chain AS (SELECT *, lag(e) OVER (PARTITION BY id ORDER BY s) AS before, (row_number() OVER (PARTITION BY id ORDER BY s) - 1)::INT AS tok_ix FROM open_toks),
toks AS (SELECT c.id, d.text, tok_ix, word, s, e, before IS NULL OR regexp_matches(d.text[before + 1:s], '{_sql(T.SENTENCE_START)}') AS is_first FROM chain c JOIN {source} d ON c.id = d.id)"""


GERMAN_TOKENS = "src AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents WHERE lang = 'de'), " + tokens_sql("src")
ALL_TOKENS = "src AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), " + tokens_sql("src")
#: What T9 says of a token.
CONTEXT_SQL = r"""ctx AS (SELECT *, regexp_extract(text[greatest(0, s - 280) + 1:s], '([^.!?…\r\n]*)$', 1) AS lft, regexp_extract(substr(text, e + 1, 280), '^([^.!?…\r\n]*[.!?…\r\n]?)', 1) AS rgt FROM toks),
local AS (SELECT *, lft || word || rgt AS context, length(lft)::INT AS "at" FROM ctx)"""


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def listed(values) -> str:
    return ", ".join(f"('{v}')" for v in values)


# ---- sources and sinks -------------------------------------------------------------------------


@query("s01_word_list", "SELECT DISTINCT trim(p_name) AS word, 'parts' AS source FROM part WHERE trim(p_name) <> '' AND NOT starts_with(trim(p_name), '#')")
def _(spark, d):
    path = scratch_path(spark, "words")
    table(spark, d, "part").select("p_name").distinct().write.text(path)
    return readers.read_word_list(spark, path, "parts")


@query("s02_morph_dictionary", f"WITH {LEX} SELECT word AS form, lower(word) AS lemma, 'NN,SIN' AS tags FROM lex WHERE length(word) > 1")
def _(spark, d):
    path = scratch_path(spark, "morph")
    rows = lexicon(spark, d).where(F.length("word") > 1)
    rows.select(F.concat("word", F.lit("\n"), F.lower("word"), F.lit(" NN,SIN"))).write.text(path)
    return readers.read_morph_dictionary(spark, path).where("lemma is not null").select("form", "lemma", F.array_join("tags", ",").alias("tags"))


@query("s03_frequency_list", f"WITH {LEX} SELECT length(word)::BIGINT AS id, word, n AS freq FROM cnt")
def _(spark, d):
    path = scratch_path(spark, "freq")
    words(spark, d).groupBy("word").agg(F.count("*").alias("n")).select(F.concat_ws("\t", F.length("word").cast("string"), "word", F.col("n").cast("string"))).write.text(path)
    return readers.read_frequency_list(spark, path)


@query("s04_affix_dictionary", f"WITH {LEX} SELECT word AS base, CASE WHEN flags = 1 THEN 'SN' ELSE 'A' END AS flags FROM lex")
def _(spark, d):
    path = scratch_path(spark, "affix")
    lexicon(spark, d).select(F.concat("word", F.lit("/"), F.when(F.col("flags") == 1, "SN").otherwise("A"), F.lit(" # n"))).write.option("encoding", "ISO-8859-1").text(path)
    return readers.read_affix_dictionary(spark, path, encoding="UTF-8")


@query("s05_rule_suggestions", f"WITH {LEX} SELECT word FROM lex WHERE regexp_full_match(word, '\\p{{L}}+') UNION ALL SELECT lower(word) FROM lex WHERE regexp_full_match(word, '\\p{{L}}+')")
def _(spark, d):
    path = scratch_path(spark, "rules")
    rows = lexicon(spark, d).where(F.col("word").rlike(r"^\p{L}+$"))
    rows.select(F.array(F.struct(F.lit("x").alias("_VALUE"), F.lower("word").alias("_correction"))).alias("example"), F.array("word").alias("suggestion")).write.option("rowTag", "rule").option("rootTag", "rules").format("xml").save(path)
    return readers.read_rule_suggestions(spark, path)


@query("s06_language_data", f"WITH {LEX}, w AS (SELECT lower(word) AS word, count(*) AS n, bool_or(word = lower(word)) AS has_lower, bool_or(regexp_full_match(word, '\\p{{Lu}}\\p{{Ll}}*')) AS has_title FROM tok GROUP BY 1) SELECT 'word' AS kind, word AS key, n, has_lower, has_title, NULL AS text FROM w UNION ALL SELECT 'typo', lower(word) || 'x', NULL, NULL, NULL, min(word) FROM lex GROUP BY 2 UNION ALL SELECT 'piece', word, flags, NULL, NULL, NULL FROM lex UNION ALL SELECT 'totals', 'total', sum(n), NULL, NULL, NULL FROM w UNION ALL SELECT 'totals', 'types', count(*), NULL, NULL, NULL FROM w")
def _(spark, d):
    """All four tables of language data that was written in parts, one JSON object for each hash bucket of words."""
    path, w = scratch_path(spark, "language"), F.col("word")
    bucket = F.pmod(F.crc32(F.lower(w).cast("binary")), F.lit(16)).alias("bucket")
    counted = words(spark, d).groupBy(F.lower(w).alias("word")).agg(F.count("*").alias("n"), F.bool_or(w == F.lower(w)).alias("lower"), F.bool_or(w.rlike(r"^\p{Lu}\p{Ll}*$")).alias("title"))
    lex = lexicon(spark, d)
    entries = lambda c, when: F.collect_list(F.when(when, F.col(c)))
    corpus_part = counted.groupBy(bucket).agg(F.struct(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("words"), F.sum("n").alias("totalCount"), entries("word", F.col("lower")).alias("lowercaseWords"), entries("word", F.col("title")).alias("titlecaseWords")).alias("corpus"))
    slips = lex.groupBy(F.concat(F.lower("word"), F.lit("x")).alias("typo")).agg(F.min("word").alias("correction"))
    typo_part = slips.groupBy(F.pmod(F.crc32(F.col("typo").cast("binary")), F.lit(16)).alias("bucket")).agg(F.struct(F.map_from_entries(F.collect_list(F.struct("typo", "correction"))).alias("corrections")).alias("typos"))
    vocab_part = lex.groupBy(bucket).agg(F.map_from_entries(F.collect_list(F.struct("word", "flags"))).alias("vocab"))
    readers.write_language_data(corpus_part.join(typo_part, "bucket", "full").join(vocab_part, "bucket", "full"), path)
    data = readers.read_language_data(spark, path)
    none = lambda kind: F.lit(None).cast(kind)
    out = data["freq"].select(F.lit("word").alias("kind"), F.col("word").alias("key"), "n", "has_lower", "has_title", none("string").alias("text"))
    out = out.union(data["typos"].select(F.lit("typo"), "typo", none("long"), none("boolean"), none("boolean"), "correction"))
    out = out.union(data["vocab"].select(F.lit("piece"), "piece", F.col("id").cast("long"), none("boolean"), none("boolean"), none("string")))
    for column in ("total", "types"):
        out = out.union(data["freq_totals"].select(F.lit("totals"), F.lit(column), column, none("boolean"), none("boolean"), none("string")))
    return out


@query("s07_user_lists", "SELECT DISTINCT p_brand AS word, 'user' AS list_type FROM part UNION ALL SELECT DISTINCT p_type, 'ignored' FROM part")
def _(spark, d):
    path, part = scratch_path(spark, "lists"), table(spark, d, "part")
    readers.write_user_lists(part.select(F.col("p_brand").alias("word"), F.lit("user").alias("list_type")).union(part.select("p_type", F.lit("ignored"))), path)
    return readers.read_user_lists(spark, path)


@query("s08_canonical_list", f"WITH {LEX}, o AS (SELECT word, lead(word) OVER (ORDER BY lower(word), word) AS following FROM lex) SELECT word, following FROM o")
def _(spark, d):
    """Each line of the written list with the line after it, as the files have them: the order is what is checked.

    Lines are numbered within a file and files follow each other by name; no task sees all lines.
    """
    path = scratch_path(spark, "list")
    readers.write_word_list(lexicon(spark, d), path)
    from pyspark.sql import Window

    lines = spark.read.text(path).select(F.col("value").alias("word"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = cut(lines)  # numbers of lines ascend within a file
    inside = Window.partitionBy("file").orderBy("block", "line")
    lines = lines.withColumn("following", F.lead("word").over(inside)).withColumn("first", F.row_number().over(inside) == 1)
    files = lines.where("first").select("file", "word").withColumn("previous", F.lag("file").over(Window.orderBy("file")))  # one row for each file
    nexts = files.where("previous is not null").select(F.col("previous").alias("file"), F.col("word").alias("later"))
    return lines.join(F.broadcast(nexts), "file", "left").select("word", F.coalesce("following", "later").alias("following"))


@query("s09_known_typos", f"WITH {LEX} SELECT word || 'x' AS typo FROM lex")
def _(spark, d):
    path = scratch_path(spark, "typos")
    # files of JSON arrays; some objects have no typo
    rows = lexicon(spark, d).select(F.struct(F.concat("word", F.lit("x")).alias("typo"), F.col("flags").alias("n")).alias("o"), F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(8)).alias("part"))
    rows.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json("o")), ",\n"), F.lit(', {"n": 0}]')).alias("value")).write.partitionBy("part").text(path)  # a file holds one array
    return readers.read_known_typos(spark, path)


@query("s10_typo_corpus", f"WITH {LEX} SELECT word, 'real' AS label, word AS base, 'none' AS kind FROM lex UNION ALL SELECT word, 'typo', NULL, 'rare' FROM rare")
def _(spark, d):
    path = scratch_path(spark, "corpus")
    rows = lexicon(spark, d).select("word", F.lit("real").alias("label"), F.col("word").alias("base"), F.lit("none").alias("kind")).union(rare(spark, d).select("word", F.lit("typo"), F.lit(None).cast("string"), F.lit("rare")))
    readers.write_typo_corpus(rows, path)
    return spark.read.parquet(path).select("word", "label", "base", "kind")


# ---- lexicon -----------------------------------------------------------------------------------

PLAIN_SQL = "[A-Za-zÄÖÜäöüß''-]"


@query("l01_filter_words", f"WITH {LEX} SELECT word FROM cnt WHERE regexp_full_match(word, '{PLAIN_SQL}+') AND length(word) BETWEEN 3 AND 30 AND NOT regexp_matches(word, '^-|-$')")
def _(spark, d):
    return L.filter_words(words(spark, d).select("word").distinct(), min_len=3, max_len=30, inner_hyphen=True)


AFFIX = "CASE WHEN flags = 1 THEN 'SFEN' WHEN flags = 2 THEN 'A' ELSE 'P' END"


def affixes(spark, d) -> DataFrame:
    return lexicon(spark, d).select(F.col("word").alias("base"), F.when(F.col("flags") == 1, "SFEN").when(F.col("flags") == 2, "A").otherwise("P").alias("flags"))


@query("l02_expand_affixes", f"""WITH {LEX}, b AS (SELECT word AS w, {AFFIX} AS f FROM lex WHERE regexp_full_match(word, '{PLAIN_SQL}+') AND length(word) >= 2)
SELECT DISTINCT word FROM (SELECT w AS word FROM b UNION ALL SELECT w || e FROM b, (VALUES ('s'), ('e'), ('n'), ('in'), ('innen')) v(e) WHERE f = 'SFEN'
UNION ALL SELECT w || e FROM b, (VALUES ('r'), ('s'), ('n'), ('m')) v(e) WHERE f IN ('A', 'P') AND ends_with(w, 'e')
UNION ALL SELECT w || e FROM b, (VALUES ('e'), ('er'), ('es'), ('en'), ('em')) v(e) WHERE f IN ('A', 'P') AND NOT ends_with(w, 'e'))""")
def _(spark, d):
    return L.expand_affixes(affixes(spark, d))


@query("l03_expand_affixes_frami", f"""WITH {LEX}, b AS (SELECT word AS w, flags, regexp_matches(word, '^[A-ZÄÖÜ]') AS up FROM lex WHERE regexp_full_match(word, '[A-Za-zÄÖÜäöüß-]+') AND length(word) >= 2
AND NOT (NOT regexp_matches(word, '^[A-ZÄÖÜ]') AND (flags = 1 OR regexp_matches(word, '(?:ung|heit|keit|schaft|tion|tät)$'))))
SELECT DISTINCT word FROM (SELECT w AS word FROM b UNION ALL SELECT w || e FROM b, (VALUES ('s'), ('e'), ('n')) v(e) WHERE flags = 1 UNION ALL SELECT w || e FROM b, (VALUES ('in'), ('innen')) v(e) WHERE flags = 1 AND up)""")
def _(spark, d):
    return L.expand_affixes(affixes(spark, d), profile="frami")


@query("l04_genitive_s", f"WITH {LEX} SELECT DISTINCT word FROM (SELECT word FROM lex UNION ALL SELECT word || 's' FROM lex WHERE regexp_matches(word, '^[A-ZÄÖÜ]') AND NOT regexp_matches(word, '[sß]$'))")
def _(spark, d):
    return L.add_genitive_s(lexicon(spark, d))


@query("l05_swiss_variants", f"WITH {LEX} SELECT word, bit_or(flags)::INT AS flags FROM (SELECT * FROM lex UNION ALL SELECT replace(word, 'ß', 'ss'), flags FROM lex WHERE contains(word, 'ß')) GROUP BY word")
def _(spark, d):
    return L.add_swiss_variants(lexicon(spark, d))


FUNCTION_SQL = f"CASE WHEN lower(word) IN ({quoted(K.FUNCTION_WORDS)}) AND word <> upper(word) THEN lower(word) ELSE word END"


@query("l06_function_words", f"WITH {LEX} SELECT {FUNCTION_SQL} AS word, sum(n)::BIGINT AS n FROM cnt GROUP BY 1")
def _(spark, d):
    return L.normalize_function_words(words(spark, d)).groupBy("word").agg(F.count("*").alias("n"))


@query("l06b_demote_function_words", f"WITH {LEX} SELECT CASE WHEN word IN ({quoted(w.capitalize() for w in K.FUNCTION_WORDS)}) THEN lower(word) ELSE word END AS word, CASE WHEN word IN ({quoted(w.capitalize() for w in K.FUNCTION_WORDS)}) THEN word END AS removed FROM cnt")
def _(spark, d):
    return L.demote_capitalized_function_words(words(spark, d).select("word").distinct())


@query("l07_canonical_casing", "SELECT coalesce(b.brand, p.word) AS word, count(*) AS n FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS word FROM part) p LEFT JOIN (SELECT DISTINCT lower(p_brand) AS key, p_brand AS brand FROM part UNION ALL VALUES ('red', 'Red'), ('blue', 'Blue')) b ON p.word = b.key GROUP BY 1")
def _(spark, d):
    part = table(spark, d, "part")
    brands = part.select(F.lower("p_brand").alias("key"), F.col("p_brand").alias("brand")).distinct().union(spark.createDataFrame([("red", "Red"), ("blue", "Blue")], "key string, brand string"))
    rows = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return L.apply_canonical_casing(rows, brands).groupBy("word").agg(F.count("*").alias("n"))


@query("l08_filter_frequent", f"WITH {LEX} SELECT word FROM cnt WHERE n >= 15 AND length(word) >= 3 AND regexp_full_match(word, '{PLAIN_SQL}+') AND word NOT IN (SELECT word FROM lex WHERE flags = 1)")
def _(spark, d):
    counted = words(spark, d).groupBy("word").agg(F.count("*").alias("freq"))
    return L.filter_frequent(counted, lexicon(spark, d).where("flags = 1"))


@query("l09_harvest_names", f"""WITH p AS (SELECT c_name AS w FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_brand FROM part UNION ALL SELECT unnest(string_split_regex(text, '[\\r\\n]+')) FROM documents),
q AS (SELECT trim(w) AS w FROM p UNION ALL SELECT regexp_replace(unnest(string_split_regex(trim(w), '[ \\t\\n\\r\\f\\v]+')), '^[ ,.;:!?"''()\\[\\]{{}}«»]+|[ ,.;:!?"''()\\[\\]{{}}«»]+$', '', 'g') FROM p)
SELECT DISTINCT w AS word FROM q WHERE regexp_full_match(w, '[A-ZÄÖÜ][A-Za-zÄÖÜäöüß-]{{1,29}}') AND w NOT IN ({quoted(K.LEGAL_WORDS)})""")
def _(spark, d):
    t = partial(table, spark, d)
    labels = t("customer").select(F.col("c_name").alias("label")).union(t("nation").select("n_name")).union(t("supplier").select("s_name")).union(t("part").select("p_brand")).union(t("documents").select(F.explode(F.split("text", r"[\r\n]+"))))
    return L.harvest_names(labels)


@query("l09b_harvest_titles", f"WITH {LEX}, t AS (SELECT DISTINCT word FROM cnt WHERE regexp_full_match(word, '{PLAIN_SQL}+') AND length(word) >= 2) SELECT DISTINCT word FROM (SELECT word FROM t UNION ALL SELECT word || 's' FROM t WHERE regexp_matches(word, '^[A-ZÄÖÜ]') AND NOT regexp_matches(word, '[sß]$'))")
def _(spark, d):
    return L.harvest_titles(words(spark, d).select(F.col("word").alias("title")).distinct())


TAGS_SQL = "CASE WHEN flags = 1 THEN ['NN', 'SIN'] WHEN flags = 2 THEN ['V', 'inf'] WHEN length(word) % 2 = 0 THEN ['ADJ', 'POS'] ELSE ['V', 'imp'] END"
FLAG_SQL = "CASE WHEN t[1] IN ('NN', 'NNP') THEN 1 WHEN t[1] = 'ADJ' THEN 2 WHEN t[1] = 'V' AND list_has_any(t[2:], ['inf', 'ppast', 'ppres', 'zu']) THEN 2 ELSE 0 END"


def morph(spark, d) -> DataFrame:
    tags = F.when(F.col("flags") == 1, F.array(F.lit("NN"), F.lit("SIN"))).when(F.col("flags") == 2, F.array(F.lit("V"), F.lit("inf"))).when(F.length("word") % 2 == 0, F.array(F.lit("ADJ"), F.lit("POS"))).otherwise(F.array(F.lit("V"), F.lit("imp")))
    return lexicon(spark, d).select(F.col("word").alias("form"), F.lower("word").alias("lemma"), tags.alias("tags"))


@query("l10_flags_from_tags", f"WITH {LEX}, m AS (SELECT word, {TAGS_SQL} AS t FROM lex) SELECT word, ({FLAG_SQL})::INT AS flag FROM m")
def _(spark, d):
    return morph(spark, d).select(F.col("form").alias("word"), L.flags_from_tags(F.col("tags")).alias("flag"))


@query("l11_build_lexicon", f"""WITH {LEX}, m AS (SELECT word, {TAGS_SQL} AS t FROM lex), r AS (SELECT word, ({FLAG_SQL})::INT AS f FROM m UNION ALL SELECT lower(word), ({FLAG_SQL})::INT FROM m),
e AS (SELECT {FUNCTION_SQL} AS word FROM (SELECT word FROM cnt WHERE n = 2) WHERE length(word) >= 2), z AS (SELECT DISTINCT word FROM e WHERE lower(word) IN ({quoted(K.FUNCTION_WORDS)})),
x AS (SELECT word, f FROM r UNION ALL SELECT word, CASE WHEN regexp_matches(word, '^\\p{{Lu}}') AND NOT (word = upper(word) AND word <> lower(word)) THEN 1 ELSE 0 END FROM e WHERE lower(word) NOT IN ({quoted(K.FUNCTION_WORDS)})),
g AS (SELECT word, bit_or(f) AS f FROM x WHERE word NOT IN (SELECT word FROM z) GROUP BY word UNION ALL SELECT word, 0 FROM z),
s AS (SELECT word, bit_or(f) AS f FROM (SELECT * FROM g UNION ALL SELECT replace(word, 'ß', 'ss'), f FROM g WHERE contains(word, 'ß')) GROUP BY word)
SELECT word, f::INT AS flags FROM s UNION ALL SELECT word, (CASE WHEN regexp_matches(word, '^\\p{{Lu}}') AND NOT (word = upper(word) AND word <> lower(word)) THEN 1 ELSE 0 END)::INT FROM cnt WHERE n = 1 AND word NOT IN (SELECT word FROM s)""")
def _(spark, d):
    counted = words(spark, d).groupBy("word").agg(F.count("*").alias("n"))
    return L.build_lexicon(morph(spark, d), counted.where("n = 2").select("word"), counted.where("n = 1").select("word"))


@query("l12_lexicon_counts", f"WITH {LEX} SELECT count(DISTINCT word) AS forms, count(DISTINCT lower(word)) AS lemmas, (SELECT count(*) FROM lex) AS vocabulary FROM lex")
def _(spark, d):
    return L.lexicon_counts(morph(spark, d), lexicon(spark, d))


@query("l13_merge_sources", f"WITH {LEX}, s AS (SELECT word, 'nouns' AS source, 0 AS p FROM lex WHERE flags = 1 UNION ALL SELECT word, 'lexicon', 1 FROM lex UNION ALL SELECT word, 'corpus', 2 FROM cnt), f AS (SELECT word, arg_min(source, p) AS source FROM s GROUP BY word) SELECT source, count(*) AS new_words FROM f GROUP BY source")
def _(spark, d):
    lex = lexicon(spark, d)
    named = lambda df, n: df.select("word", F.lit(n).alias("source"))
    return L.merge_sources([named(lex.where("flags = 1"), "nouns"), named(lex, "lexicon"), named(words(spark, d).distinct(), "corpus")])[1]


@query("l14_missing_names", f"WITH {LEX}, a AS (SELECT list(DISTINCT c) AS al FROM (SELECT unnest(string_split(word, '')) AS c FROM lex)) SELECT word FROM rare, a WHERE regexp_full_match(word, '[\\p{{L}}''-]+') AND length(word) BETWEEN 2 AND 60 AND list_has_all(al, string_split(word, ''))")
def _(spark, d):
    return L.missing_names(rare(spark, d), lexicon(spark, d))


@query("l15_verify_lexicon", f"WITH {LEX}, e AS (SELECT word, n >= 2 AS expected FROM cnt) SELECT e.word, e.expected, l.word IS NOT NULL AS present, (l.word IS NOT NULL) = e.expected AS ok FROM e LEFT JOIN lex l USING (word)")
def _(spark, d):
    counted = words(spark, d).groupBy("word").agg(F.count("*").alias("n")).select("word", (F.col("n") >= 2).alias("expected"))
    return L.verify_lexicon(lexicon(spark, d), counted)


@query("l16_adjective_like", f"""WITH {LEX}, stems0 AS (SELECT DISTINCT lower(word) AS w FROM cnt), forms AS (SELECT w AS word FROM stems0 UNION SELECT w || x FROM stems0, (VALUES ('er'), ('es'), ('em')) v(x) WHERE length(w) % 3 = 0 OR (length(w) % 3 = 1 AND x = 'er')),
w AS (SELECT word FROM forms WHERE length(word) >= 3 AND NOT regexp_full_match(word, 'ein|eine|einer|einem|eines|einen|der|die|das|dem|den|des')),
s AS (SELECT DISTINCT word, unnest([word, CASE WHEN ends_with(word, 'e') THEN word[:-2] END, CASE WHEN regexp_matches(word, 'e[lr]$') THEN regexp_replace(word, 'e([lr])$', '\\1') END]) AS stem FROM w),
h AS (SELECT s.word, s.stem, list(DISTINCT e.k) AS k FROM s JOIN (VALUES ('er', 'er'), ('er', 'r'), ('es', 'es'), ('es', 's'), ('em', 'em'), ('em', 'm')) e(k, x) ON true JOIN forms f ON f.word = s.stem || e.x WHERE s.stem IS NOT NULL GROUP BY 1, 2)
SELECT DISTINCT word FROM h WHERE list_contains(k, 'er') AND (list_contains(k, 'es') OR list_contains(k, 'em')) OR list_contains(k, 'es') AND list_contains(k, 'em') UNION SELECT word FROM w WHERE word = 'hoch'""")
def _(spark, d):
    """A lexicon that has inflected forms: some words of the corpus with all endings, some with one."""
    w = words(spark, d).select(F.lower("word").alias("w")).distinct()
    left = F.length("w") % 3
    ends = F.when(left == 0, F.array(*map(F.lit, ("er", "es", "em")))).when(left == 1, F.array(F.lit("er"))).otherwise(F.array().cast("array<string>"))
    forms = w.select("w", F.explode(ends).alias("x")).select(F.concat("w", "x").alias("word")).union(w)
    return L.adjective_like(forms.distinct())


# ---- corpus ------------------------------------------------------------------------------------


@query("c01_word_frequencies", f"WITH {ALL_TOK} SELECT lower(word) AS word, count(*) AS n FROM tok GROUP BY 1")
def _(spark, d):
    return corpus.word_frequencies(all_words(spark, d))


@query("c01_totals", f"WITH {ALL_TOK} SELECT count(*) AS total, count(DISTINCT lower(word)) AS types FROM tok")
def _(spark, d):
    return corpus.totals(corpus.word_frequencies(all_words(spark, d)))


@query("c02_case_evidence", f"WITH {GERMAN_TOKENS} SELECT lower(word) AS word, bool_or(word = lower(word) AND NOT is_first) AS has_lower, bool_or(regexp_matches(word, '^\\p{{Lu}}') AND word[2:] = lower(word[2:]) AND NOT is_first) AS has_title FROM toks GROUP BY 1")
def _(spark, d):
    return corpus.case_evidence(T.tokenize(german(spark, d)))


@query("c03_log_prior", f"WITH {LEX}, t AS (SELECT sum(n) AS total, count(*) AS types FROM fr) SELECT c.word, round(ln(CASE WHEN coalesce(f.n, 0) > 0 THEN f.n::DOUBLE ELSE 0.1 END) - ln(greatest(1.0, total + 0.1 * greatest(1, types + 1))), 6) AS log_prior FROM (SELECT word FROM cnt UNION ALL SELECT word || 'x' FROM lex) c LEFT JOIN fr f ON lower(c.word) = f.word, t")
def _(spark, d):
    rows = words(spark, d).select("word").distinct().union(lexicon(spark, d).select(F.concat("word", F.lit("x"))))
    return corpus.log_prior(rows, freq(spark, d)).select("word", F.round("log_prior", 6).alias("log_prior"))


# ---- text --------------------------------------------------------------------------------------


@query("t01_normalize_word", f"WITH {LEX} SELECT word, translate(nfc_normalize(word), '‘’ʼ‐‑‒–—―−', '''''''-------') AS normal FROM cnt")
def _(spark, d):
    return words(spark, d).select("word").distinct().select("word", T.normalize_word(F.col("word")).alias("normal"))


@query("t02_words", f"WITH {ALL_TOK} SELECT doc_id, count(*) AS n, count(DISTINCT word) AS types FROM tok GROUP BY doc_id")
def _(spark, d):
    return all_words(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("word").alias("types"))


@query("t02_tokens", f'WITH {ALL_TOKENS} SELECT id AS doc_id, tok_ix, word, s AS start, e AS "end", is_first FROM toks')
def _(spark, d):
    return T.tokenize(table(spark, d, "documents"))


@query("t03_protected_ranges", f"""WITH src AS (SELECT page_id AS id, concat_ws(' ', url, html) AS text FROM pages), {spans_sql("src")} SELECT id AS page_id, s AS start, e AS "end" FROM spans""")
def _(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return rows.select("page_id", F.inline(T.protected_ranges(F.col("text"))))


@query("t04_overlapping_tokens", f"""WITH {ALL_TOKENS} SELECT r.id AS doc_id, count(*) AS dropped FROM raw r WHERE EXISTS (SELECT 1 FROM spans p WHERE p.id = r.id AND p.s < r.s + length(r.word) AND p.e > r.s) GROUP BY r.id""")
def _(spark, d):
    """How many words of a document lie in protected spans: all words there are, less those that the tokenizer keeps."""
    docs = table(spark, d, "documents")
    every = docs.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(T.TOKEN)).cast("long").alias("every"))
    kept = T.tokenize(docs).groupBy("doc_id").agg(F.count("*").alias("kept"))
    out = every.join(kept, "doc_id", "left").select("doc_id", (F.col("every") - F.coalesce("kept", F.lit(0))).alias("dropped"))
    return out.where("dropped > 0")


@query("t05_sentence_starts", f"WITH {ALL_TOKENS} SELECT id AS doc_id, count(*) AS tokens, count(*) FILTER (is_first) AS starts FROM toks GROUP BY 1")
def _(spark, d):
    return T.tokenize(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count(F.when(F.col("is_first"), 1)).alias("starts"))


@query("t06_sentences", r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?…\r\n]+(?:[.!?…]+|[\r\n]+|$)')) AS text FROM documents) SELECT doc_id, text, count(*) AS n FROM s WHERE regexp_matches(text, '\p{L}') GROUP BY ALL""")
def _(spark, d):
    return T.sentences(table(spark, d, "documents")).groupBy("doc_id", "text").agg(F.count("*").alias("n"))


@query("t07_foreign_sentences", r"""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^.!?…\r\n]+(?:[.!?…]+|[\r\n]+|$)')) AS text FROM documents) SELECT text, length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 2 AND length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) < length(regexp_replace(text, '[^\p{L}]', '', 'g')) / 2 AS is_foreign FROM s WHERE regexp_matches(text, '\p{L}')""")
def _(spark, d):
    return T.is_foreign(T.sentences(table(spark, d, "documents"))).select("text", F.col("foreign").alias("is_foreign")).distinct()


@query("t08_german_tokens", f"""WITH {ALL_TOKENS}, sp AS (SELECT doc_id AS id, lang, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS k FROM (SELECT doc_id, lang, regexp_extract_all(text, '[^.!?…\\r\\n]+(?:[.!?…]+|[\\r\\n]+|$)|[.!?…\\r\\n]') AS t FROM documents)),
sents AS (SELECT id, lang, w AS txt, (sum(length(w)) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(w))::INT AS s FROM sp),
said AS (SELECT DISTINCT trim(txt) AS key FROM sents WHERE lang <> 'de' AND regexp_matches(txt, '\\p{{L}}')),
abroad AS (SELECT id, s, s + length(txt) AS e FROM sents WHERE regexp_matches(txt, '\\p{{L}}') AND trim(txt) <> '' AND (trim(txt) IN (SELECT key FROM said) OR (length(regexp_replace(txt, '[^\\p{{L}}]', '', 'g')) >= 2 AND length(regexp_replace(txt, '[^\\p{{Latin}}]', '', 'g')) < length(regexp_replace(txt, '[^\\p{{L}}]', '', 'g')) / 2)))
SELECT t.id AS doc_id, count(*) AS tokens FROM toks t WHERE regexp_matches(word, '\\p{{Latin}}') AND NOT EXISTS (SELECT 1 FROM abroad a WHERE a.id = t.id AND t.s >= a.s AND t.s < a.e) GROUP BY 1""")
def _(spark, d):
    said = T.sentences(table(spark, d, "documents").where("lang <> 'de'")).select("text", F.lit("en").alias("language"), F.lit(99.0).alias("percentage"), F.lit(True).alias("reliable"))
    return T.german_tokens(table(spark, d, "documents"), said).groupBy("doc_id").agg(F.count("*").alias("tokens"))


@query("t09_local_context", f'WITH {ALL_TOKENS}, {CONTEXT_SQL} SELECT id AS doc_id, s AS start, e AS "end", word, context, "at" FROM local WHERE is_first')
def _(spark, d):
    rows = T.tokens_in_place(table(spark, d, "documents"), before=False, keep=lambda t: t["is_first"])
    return rows.select("doc_id", "start", "end", "word", F.col("context.text").alias("context"), F.col("context.start").alias("at"))


# ---- detection ---------------------------------------------------------------------------------


@query("d01_ignored", f"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+')) AS w FROM documents) SELECT w AS word, length(w) <= 1 OR regexp_matches(w, '^[\\d.,%€$+\\-]+$') OR regexp_matches(w, '(?i)^(https?://|www\\.)') OR regexp_matches(w, '^[^ @]+@[^ @]+\\.[^ @]+$') OR regexp_matches(w, '[\\\\/_#@<>{{}}\\d]') OR lower(w) IN ({quoted(K.ABBREVIATIONS)}) AS ignored FROM w""")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    return rows.select("word", detect.is_ignored(F.col("word")).alias("ignored"))


@query("d02_matches_list", f"WITH {LEX} SELECT word FROM cnt WHERE lower(word) IN (SELECT lower(word) FROM lex WHERE flags = 1)")
def _(spark, d):
    return detect.matches_list(words(spark, d).select("word").distinct(), lexicon(spark, d).where("flags = 1"))


LOOKUP_SQL = "p.w IN (SELECT word FROM lex) OR (p.f AND p.w[1] = upper(p.w[1]) AND p.w[1] <> lower(p.w[1]) AND lower(p.w[1]) || p.w[2:] IN (SELECT word FROM lex)) OR (p.w = upper(p.w) AND p.w <> lower(p.w) AND (upper(p.w[1]) || lower(p.w[2:]) IN (SELECT word FROM lex) OR lower(p.w) IN (SELECT word FROM lex)))"


@query("d03_unknown_words", f"WITH {LEX} SELECT word, n FROM cnt WHERE length(word) > 1 AND word NOT IN (SELECT word FROM lex) AND NOT (word = upper(word) AND word <> lower(word) AND (upper(word[1]) || lower(word[2:]) IN (SELECT word FROM lex) OR lower(word) IN (SELECT word FROM lex))) AND lower(word) NOT IN ({quoted(K.ABBREVIATIONS)}) AND NOT regexp_matches(word, '\\d')")
def _(spark, d):
    """Which words of the German documents are not in the lexicon, and how often do they occur?"""
    counted = words(spark, d).groupBy("word").agg(F.count("*").alias("n"))
    rows = counted.where(~detect.is_ignored(F.col("word"))).withColumn("is_first", F.lit(False))
    known = detect.lookup_words(rows, counted.where("n >= 3"))
    return rows.join(known, ["word", "is_first"], "left_anti").select("word", "n")


@query("d03_lookup_words", f"WITH {LEX}, p AS (SELECT word AS w, true AS f FROM cnt UNION ALL SELECT upper(replace(word, 'ß', 'ss')), false FROM cnt WHERE n = 2) SELECT DISTINCT w AS word, f AS is_first FROM p WHERE {LOOKUP_SQL}")
def _(spark, d):
    counted = words(spark, d).groupBy("word").agg(F.count("*").alias("n"))
    rows = counted.select("word", F.lit(True).alias("is_first")).union(counted.where("n = 2").select(F.upper(F.replace("word", F.lit("ß"), F.lit("ss"))), F.lit(False)))
    return detect.lookup_words(rows, lexicon(spark, d))


@query("d04_apostrophe", f"WITH {LEX}, p AS (SELECT word AS w, false AS f FROM cnt WHERE length(word) >= 2) SELECT w || '''s' AS word, f AS is_first FROM p WHERE {LOOKUP_SQL}")
def _(spark, d):
    rows = words(spark, d).select(F.concat("word", F.lit("'s")).alias("word"), F.lit(False).alias("is_first")).where(F.length("word") >= 4).distinct()
    return detect.valid_apostrophe(rows, lexicon(spark, d))


PLAINEST = r"regexp_full_match(word, '\p{L}{2,}')"


@query("d05_hyphenated", f"WITH {LEX}, g AS (SELECT word, word IN (SELECT word FROM lex) OR lower(word) IN ({quoted(K.ABBREVIATIONS)}) OR (word = upper(word) AND word <> lower(word) AND (upper(word[1]) || lower(word[2:]) IN (SELECT word FROM lex) OR lower(word) IN (SELECT word FROM lex))) AS ok FROM cnt WHERE {PLAINEST}) SELECT word || '-' || lower(word) || '-2a' AS word, false AS is_first FROM g WHERE (ok OR (word[1] = upper(word[1]) AND lower(word) IN (SELECT word FROM lex WHERE flags > 0))) AND (lower(word) IN (SELECT word FROM lex) OR lower(word) IN ({quoted(K.ABBREVIATIONS)}))")
def _(spark, d):
    rows = words(spark, d).where(F.col("word").rlike(r"^\p{L}{2,}$")).select(F.concat("word", F.lit("-"), F.lower("word"), F.lit("-2a")).alias("word"), F.lit(False).alias("is_first")).distinct()
    return detect.valid_hyphenated(rows, lexicon(spark, d))


@query("d06_trailing_hyphen", f"WITH {LEX}, p AS (SELECT word AS w, false AS f FROM cnt) SELECT w || '-' AS word, f AS is_first FROM p WHERE {LOOKUP_SQL} OR lower(p.w) IN (SELECT word FROM lex)")
def _(spark, d):
    rows = words(spark, d).select(F.concat("word", F.lit("-")).alias("word"), F.lit(False).alias("is_first")).distinct()
    return detect.valid_trailing_hyphen(rows, lexicon(spark, d))


PREFIX_SQL = r"""pre AS (SELECT DISTINCT p FROM (SELECT lower(word) AS p FROM lex WHERE flags > 0 AND (word = lower(word) OR word = upper(word[1]) || lower(word[2:]))
UNION ALL SELECT lower(word[:-2]) FROM lex WHERE flags & 1 <> 0 AND regexp_matches(word, '[^e]e$') UNION ALL SELECT word[:-3] FROM lex WHERE flags & 2 <> 0 AND ends_with(word, 'en') UNION ALL SELECT word[:-2] FROM lex WHERE flags & 2 <> 0 AND ends_with(word, 'n')) WHERE length(p) >= 3)"""
COMPOUND_SQL = PREFIX_SQL + r""", comp(word, rest, cap, lvl) AS (SELECT word, word, word[1] = upper(word[1]) AND word[1] <> lower(word[1]), 0 FROM inp WHERE length(word) >= 6
UNION SELECT word, CASE WHEN cap THEN upper(r[1]) || lower(r[2:]) ELSE lower(r) END, cap, lvl + 1 FROM (
 SELECT c.word, c.cap, c.lvl, c.rest[i + length(l) + 1:] AS r FROM comp c, range(3, 60) t(i), (VALUES (''), ('s'), ('es'), ('en'), ('n')) v(l), pre
 WHERE length(c.rest) >= 6 AND c.lvl < 5 AND i <= length(c.rest) - 3 AND pre.p = lower(c.rest[1:i]) AND starts_with(c.rest[i + 1:], l)
 AND NOT (l = '' AND regexp_matches(lower(c.rest[1:i]), '(?:heit|keit|schaft|tät|ling|ion|ung)$') AND NOT regexp_matches(lower(c.rest[1:i]), '(?:sprung|schwung|dung)$'))) WHERE length(r) >= 3)"""
COMPOUND_OK = "SELECT DISTINCT c.word FROM comp c JOIN lex l ON l.word = c.rest WHERE c.lvl > 0 AND l.flags & (CASE WHEN c.cap THEN 1 ELSE 2 END) <> 0"


@query("d07_compounds", f"WITH RECURSIVE {LEX}, inp AS (SELECT word FROM rare), {COMPOUND_SQL} {COMPOUND_OK}")
def _(spark, d):
    return detect.valid_compounds(rare(spark, d), lexicon(spark, d))


@query("d08_known_typos", f"WITH {LEX}, t AS (SELECT lower(word) || 'x' AS typo FROM lex UNION ALL SELECT lower(word) FROM lex WHERE flags = 1), p AS (SELECT word AS w, false AS f FROM cnt UNION ALL SELECT word || 'x', false FROM cnt) SELECT DISTINCT w AS word, f AS is_first FROM p WHERE lower(w) IN (SELECT typo FROM t) AND NOT ({LOOKUP_SQL})")
def _(spark, d):
    lex = lexicon(spark, d)
    listed = lex.select(F.concat(F.lower("word"), F.lit("x")).alias("typo")).union(lex.where("flags = 1").select(F.lower("word"))).distinct()
    rows = words(spark, d).select("word").distinct()
    rows = rows.union(rows.select(F.concat("word", F.lit("x")))).select("word", F.lit(False).alias("is_first"))
    return detect.known_nonword_typos(rows, listed, lex).distinct()


@query("d09_suspicious_compounds")
def _(spark, d):
    return detect.suspicious_compounds(detect.valid_compounds(rare(spark, d), lexicon(spark, d)), lexicon(spark, d), full_freq(spark, d))


@query("d10_verdicts", f"WITH RECURSIVE {LEX}, inp AS (SELECT word FROM rare UNION SELECT lower(word[1]) || word[2:] FROM rare), {COMPOUND_SQL}, ok AS ({COMPOUND_OK}) SELECT w AS word, f AS is_first, length(w) <= 1 OR lower(w) IN ({quoted(K.ABBREVIATIONS)}) OR regexp_matches(w, '\\d') OR ({LOOKUP_SQL}) OR w IN (SELECT word FROM ok) OR (f AND lower(w[1]) || w[2:] IN (SELECT word FROM ok)) AS correct FROM (SELECT word AS w, true AS f FROM cnt WHERE NOT contains(word, '-') AND NOT contains(word, '''')) p")
def _(spark, d):
    rows = words(spark, d).select("word").distinct().where(~F.col("word").rlike("[-']")).withColumn("is_first", F.lit(True))
    return detect.verdicts(rows, lexicon(spark, d))


@query("d11_must_be_capitalized", f"""WITH RECURSIVE {GERMAN_TOKENS}, {LEX}, ev AS (SELECT lower(word) AS word, bool_or(word = lower(word) AND NOT is_first) AS has_lower FROM toks GROUP BY 1),
dw AS (SELECT DISTINCT word, lower(word) AS low, upper(word[1]) || lower(word[2:]) AS tit FROM cnt), inp AS (SELECT tit AS word FROM dw UNION SELECT low FROM dw), {COMPOUND_SQL}, ok AS ({COMPOUND_OK})
SELECT dw.word, CASE WHEN dw.low IN ({quoted(K.NEVER_NOUNS)}) OR (l.word IS NOT NULL AND coalesce(ev.has_lower, false)) THEN false
 ELSE (coalesce(t.flags & {K.NOUN} <> 0, false) AND coalesce(l.flags & {K.LOWER_COMPOUND} = 0, true)) OR (t.word IS NOT NULL AND l.word IS NULL) OR (dw.tit IN (SELECT word FROM ok) AND dw.low NOT IN (SELECT word FROM ok)) END AS must_cap
FROM dw LEFT JOIN lex t ON t.word = dw.tit LEFT JOIN lex l ON l.word = dw.low LEFT JOIN ev ON ev.word = dw.low""")
def _(spark, d):
    return detect.must_be_capitalized(words(spark, d).select("word").distinct(), lexicon(spark, d), full_freq(spark, d))


@query("d12_check_text")
def _(spark, d):
    """All errors of all German documents, with suggestions."""
    lex = cut(lexicon(spark, d))
    return check_text(german(spark, d), lex, cut(full_freq(spark, d)))


# ---- candidates --------------------------------------------------------------------------------


@query("k01_fuzzy_join_1", f"WITH {LEX}, {KEYED} SELECT r.word, l.word AS cand, {EDIT}::INT AS distance FROM rk r JOIN lk l ON abs(length(r.word) - length(l.word)) <= 1 WHERE {EDIT} <= 1")
def _(spark, d):
    return C.fuzzy_join(rare(spark, d), lexicon(spark, d), 1)


@query("k01_fuzzy_join_2")
def _(spark, d):
    return C.fuzzy_join(rare(spark, d), lexicon(spark, d), 2, 120)


@query("k02_search_forms", f"WITH {LEX} SELECT DISTINCT word, unnest(CASE WHEN length(word) > 1 AND word = upper(word) AND word <> lower(word) OR length(word) <= 20 THEN [word, lower(word), replace(upper(word[1]), 'ẞ', 'SS') || lower(word[2:])] ELSE [word] END) AS form FROM cnt")
def _(spark, d):
    return C.search_forms(words(spark, d))


@query("k03_rewrites")
def _(spark, d):
    return C.rewrite_candidates(rare(spark, d), lexicon(spark, d))


@query("k04_known_corrections", f"WITH {LEX}, t AS (SELECT lower(word) || 'x' AS typo, min(word) AS correction FROM lex GROUP BY 1), p AS (SELECT word || 'x' AS w, true AS f FROM cnt) SELECT w AS word, f AS is_first, CASE WHEN w = upper(w) AND w <> lower(w) THEN replace(upper(correction), 'ẞ', 'SS') ELSE replace(upper(correction[1]), 'ẞ', 'SS') || correction[2:] END AS cand, 0.05::DOUBLE AS cost FROM p JOIN t ON lower(w) = typo WHERE NOT ({LOOKUP_SQL})")
def _(spark, d):
    lex = lexicon(spark, d)
    listed = lex.groupBy(F.concat(F.lower("word"), F.lit("x")).alias("typo")).agg(F.min("word").alias("correction"))
    rows = words(spark, d).select(F.concat("word", F.lit("x")).alias("word")).distinct().withColumn("is_first", F.lit(True))
    return C.known_corrections(rows, listed, lex)


@query("k05_compound_synthesis")
def _(spark, d):
    return C.synthesize_compounds(rare(spark, d), cut(lexicon(spark, d)), cut(full_freq(spark, d)))


@query("k06_fuzzy_join_3")
def _(spark, d):
    rows, lex = cut(rare(spark, d).where(F.length("word").between(6, 16))), cut(lexicon(spark, d))
    near = cut(C.fuzzy_join(rows, lex, 2))
    few = rows.join(near.groupBy("word").agg(F.count("*").alias("n")), "word", "left").where("coalesce(n, 0) < 4").select("word")
    return C.fuzzy_join(few, lex, 3, 120).join(near.select("word", "cand"), ["word", "cand"], "left_anti")


@query("k07_user_list")
def _(spark, d):
    return C.user_list_candidates(rare(spark, d), lexicon(spark, d).where("flags = 1").select("word"))


@query("k08_case_candidates", f"WITH {LEX}, b AS (SELECT DISTINCT word, unnest([upper(word[1]) || word[2:], lower(word)]) AS w, false AS f FROM rare) SELECT word, f AS is_first, w AS cand, 0.2::DOUBLE AS cost FROM b p WHERE {LOOKUP_SQL}")
def _(spark, d):
    return C.case_candidates(rare(spark, d), lexicon(spark, d))


UMLAUT_SQL = "(VALUES ('ae', 'ä'), ('oe', 'ö'), ('ue', 'ü'), ('ss', 'ß'), ('ä', 'ae'), ('ö', 'oe'), ('ü', 'ue'), ('ß', 'ss')) v(a, b)"


@query("k09_umlaut_forms", f"WITH {LEX}, r AS (SELECT word, replace(lower(word), a, b) AS rep FROM rare, {UMLAUT_SQL} WHERE contains(lower(word), a)), b AS (SELECT DISTINCT word, unnest([rep, upper(rep[1]) || rep[2:]]) AS w, false AS f FROM r) SELECT word, f AS is_first, w AS cand, 0.4::DOUBLE AS cost FROM b p WHERE {LOOKUP_SQL}")
def _(spark, d):
    return C.umlaut_candidates(rare(spark, d), lexicon(spark, d))[0]


@query("k10_transpositions", f"WITH {LEX}, b AS (SELECT DISTINCT word, word[1:i - 1] || word[i + 1] || word[i] || word[i + 2:] AS w, false AS f FROM rare, range(1, 60) t(i) WHERE i < length(word)) SELECT word, f AS is_first, w AS cand, 0.5::DOUBLE AS cost FROM b p WHERE {LOOKUP_SQL}")
def _(spark, d):
    return C.transposition_candidates(rare(spark, d), lexicon(spark, d))


@query("k11_short_insertions", f"WITH {LEX}, b AS (SELECT DISTINCT word, lower(word)[1:i] || c || lower(word)[i + 1:] AS ins FROM rare, range(0, 5) t(i), (SELECT unnest(string_split('{K.LETTERS}', '')) AS c) WHERE length(word) <= 4 AND i <= length(word)) SELECT DISTINCT word, cand, 1.0::DOUBLE AS cost FROM (SELECT word, unnest([ins, upper(ins[1]) || ins[2:]]) AS cand FROM b) WHERE cand IN (SELECT word FROM lex)")
def _(spark, d):
    return C.short_insertions(rare(spark, d), lexicon(spark, d))


@query("k12_candidates")
def _(spark, d):
    """With a typo table and a user's list made from the corpus, so that every step has something to do."""
    lex = cut(lexicon(spark, d))
    return C.collect_candidates(rare(spark, d), lex, cut(full_freq(spark, d)), cut(corpus_typos(spark, d)), cut(user_words(spark, d)))


# ---- scalars -----------------------------------------------------------------------------------

KEYS_SQL = "keys AS (SELECT * FROM (VALUES ('1234567890ß', 1.0, 1.0), ('qwertzuiopü', 1.5, 2.0), ('asdfghjklöä', 1.75, 3.0), ('yxcvbnm', 2.25, 4.0)) r(k, x0, y))"


@query("m01_keyboard_distance", f"""WITH {LEX}, {KEYS_SQL}, c AS (SELECT DISTINCT unnest(string_split(word, '')) AS ch FROM cnt), p AS (SELECT c.ch, x0 + instr(k, lower(ch)) - 1 AS x, y FROM c LEFT JOIN keys ON length(lower(ch)) = 1 AND instr(k, lower(ch)) > 0)
SELECT a.ch AS a, b.ch AS b, (CASE WHEN a.ch = b.ch THEN 0 WHEN a.x IS NULL OR b.x IS NULL THEN 1 WHEN sqrt((a.x - b.x)^2 + (a.y - b.y)^2) <= 1.15 THEN 0.35 WHEN sqrt((a.x - b.x)^2 + (a.y - b.y)^2) <= 1.55 THEN 0.65 ELSE 1 END)::DOUBLE AS cost FROM p a, p b""")
def _(spark, d):
    ch = words(spark, d).select(F.explode(F.split("word", "")).alias("a")).distinct()
    return ch.crossJoin(F.broadcast(ch.withColumnRenamed("a", "b"))).select("a", "b", S.keyboard_distance(F.col("a"), F.col("b")).alias("cost"))  # letters of an alphabet


@query("m02_weighted_distance")
def _(spark, d):
    return C.fuzzy_join(rare(spark, d), lexicon(spark, d), 1).select("word", "cand", F.round(S.weighted_distance("word", "cand"), 6).alias("cost"))


@query("m03_osa_distance", f"""WITH RECURSIVE {LEX}, pairs AS (SELECT r.word AS a, l.word AS b FROM rare r JOIN lex l ON lower(r.word[1:2]) = lower(l.word[1:2]) AND r.word[-1] = l.word[-1] AND abs(length(r.word) - length(l.word)) <= 3),
letters AS (SELECT DISTINCT a, b FROM pairs), grid AS (
SELECT a, b, 0 AS i, range(0, length(b) + 1) AS cur, NULL::BIGINT[] AS last FROM letters
UNION ALL SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda acc, jj: list_append(acc, least(acc[-1] + 1, cur[jj[1] + 1] + 1, cur[jj[1]] + CASE WHEN a[i + 1] = b[jj[1]] THEN 0 ELSE 1 END, CASE WHEN i >= 1 AND jj[1] >= 2 AND a[i + 1] = b[jj[1] - 1] AND a[i] = b[jj[1]] THEN last[jj[1] - 1] + 1 ELSE 999 END)), [i + 1]), cur FROM grid WHERE i < length(a))
SELECT a AS word, b AS cand, (CASE WHEN abs(length(a) - length(b)) > 2 THEN 999 ELSE cur[-1] END)::INT AS distance FROM grid WHERE i = length(a)""")
def _(spark, d):
    """Pairs of words that begin and end alike; lengths differ by three at most."""
    key = lambda c: F.concat(F.lower(F.substring(c, 1, 2)), F.lit("|"), F.substring(c, -1, 1)).alias("k")
    pairs = rare(spark, d).select("word", key("word")).join(lexicon(spark, d).select(F.col("word").alias("cand"), key("word")), "k").where(F.abs(F.length("word") - F.length("cand")) <= 3)
    return pairs.select("word", "cand", S.osa_distance(F.col("word"), F.col("cand")).alias("distance"))


@query("m04_cologne_phonetic", rf"""WITH {LEX}, s AS (SELECT word, translate(lower(word), 'äöüß', 'aous') AS s FROM cnt),
c AS (SELECT word, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN instr('aeijouy', s[i]) > 0 THEN '0' WHEN s[i] = 'b' THEN '1' WHEN s[i] = 'p' THEN CASE WHEN s[i + 1] = 'h' THEN '3' ELSE '1' END
 WHEN s[i] IN ('d', 't') THEN CASE WHEN s[i + 1] IN ('c', 's', 'z') THEN '8' ELSE '2' END WHEN s[i] IN ('f', 'v', 'w') THEN '3' WHEN s[i] IN ('g', 'k', 'q') THEN '4'
 WHEN s[i] = 'c' THEN CASE WHEN i = 1 THEN CASE WHEN s[2] <> '' AND instr('ahkloqrux', s[2]) > 0 THEN '4' ELSE '8' END WHEN s[i - 1] IN ('s', 'z') THEN '8' WHEN s[i + 1] <> '' AND instr('ahkoqux', s[i + 1]) > 0 THEN '4' ELSE '8' END
 WHEN s[i] = 'x' THEN '48' WHEN s[i] = 'l' THEN '5' WHEN s[i] IN ('m', 'n') THEN '6' WHEN s[i] = 'r' THEN '7' WHEN s[i] IN ('s', 'z') THEN '8' ELSE '' END), '') AS c FROM s),
r AS (SELECT word, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '0+', '0', 'g'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g'), '7+', '7', 'g'), '8+', '8', 'g') AS r FROM c)
SELECT word, r[1] || replace(r[2:], '0', '') AS code FROM r""")
def _(spark, d):
    return words(spark, d).select("word").distinct().select("word", S.cologne_phonetic(F.col("word")).alias("code"))


@query("m05_inflection_variants", f"WITH {LEX} SELECT a.word AS a, b.word AS b FROM lex a, lex b WHERE a.word <> b.word AND (b.word IN (a.word || 'e', a.word || 'en', a.word || 'er', a.word || 'n', a.word || 's', a.word || 'es') OR a.word IN (b.word || 'e', b.word || 'en', b.word || 'er', b.word || 'n', b.word || 's', b.word || 'es'))")
def _(spark, d):
    w = lexicon(spark, d).select("word")
    stems = w.select(F.col("word").alias("a"), F.explode(F.array(*[F.concat("word", F.lit(e)) for e in K.INFLECTIONS])).alias("b")).join(w.select(F.col("word").alias("b")), "b", "left_semi")
    pairs = stems.select("a", "b").union(stems.select("b", "a"))
    return pairs.where(S.inflection_variants(F.col("a"), F.col("b"))).select("a", "b")


@query("m06_linking_s", f"WITH {LEX} SELECT word, length(word) >= 3 AND (word IN ({quoted(K.LINK_S_STEMS)}) OR (regexp_matches(word, '{K.DERIVED}') AND NOT regexp_matches(word, '{K.NOT_DERIVED}'))) AS wants_s FROM (SELECT DISTINCT lower(word) AS word FROM cnt)")
def _(spark, d):
    return words(spark, d).select(F.lower("word").alias("word")).distinct().select("word", S.prefers_linking_s(F.col("word"), F.lit(4)).alias("wants_s"))


@query("m07_common_lengths", f"WITH {LEX}, p AS (SELECT lower(r.word) AS a, lower(l.word) AS b, r.word, l.word AS cand FROM rare r JOIN lex l ON lower(r.word[1:3]) = lower(l.word[1:3]) AND length(r.word) = length(l.word)) SELECT word, cand, coalesce(list_min(list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])) - 1, length(a))::DOUBLE AS prefix FROM p")
def _(spark, d):
    key = lambda c: F.concat(F.lower(F.substring(c, 1, 3)), F.length(c).cast("string"))
    pairs = rare(spark, d).select("word", F.lower("word").alias("a"), key("word").alias("k")).join(lexicon(spark, d).select(F.col("word").alias("cand"), F.lower("word").alias("b"), key("word").alias("k")), "k")
    pairs = S.with_common_prefix(pairs, "a", "b", "plain")
    return pairs.select("word", "cand", S.common_prefix_len(F.col("a"), F.col("b"), F.col("plain")).alias("prefix"))


@query("m08_key_bounce", f"WITH {LEX}, w AS (SELECT word, list_min(list_filter(range(2, length(word) + 1), lambda i: word[i] = word[i - 1])) AS i FROM rare) SELECT word, word[1:i - 1] || word[i + 1:] AS cand FROM w WHERE i IS NOT NULL AND word[1:i - 1] || word[i + 1:] IN (SELECT word FROM lex)")
def _(spark, d):
    rows = rare(spark, d).where(F.col("word").rlike(r"(.)\1")).select("word", F.regexp_replace("word", r"^(.*?)(.)\2", "$1$2").alias("cand"))
    return rows.join(lexicon(spark, d).select(F.col("word").alias("cand")), "cand", "left_semi").where(S.key_bounce(F.col("word"), F.col("cand"))).select("word", "cand")


@query("m09_match_case", f"WITH {LEX} SELECT word, CASE WHEN word = upper(word) AND word <> lower(word) THEN replace(upper(lower(word) || 'en'), 'ẞ', 'SS') ELSE replace(upper(word[1]), 'ẞ', 'SS') || lower(word[2:]) || 'en' END AS cased FROM cnt")
def _(spark, d):
    rows = words(spark, d).select("word").distinct()
    return rows.select("word", S.match_case(F.concat(F.lower("word"), F.lit("en")), F.col("word"), F.lit(True)).alias("cased"))


# ---- ranking -----------------------------------------------------------------------------------


def ranked(spark, d) -> DataFrame:
    lex, fr = cut(lexicon(spark, d)), cut(full_freq(spark, d))
    rows = cut(rare(spark, d))
    found = C.collect_candidates(rows, lex, fr, cut(corpus_typos(spark, d)), cut(user_words(spark, d)))
    return R.score_candidates(rows.withColumn("noun_signal", F.lit(False)), found, lex, fr)


@query("r01_log_likelihood")
def _(spark, d):
    """Of words within one edit; with the parts that the score is made of."""
    near = C.fuzzy_join(rare(spark, d), lexicon(spark, d), 1).select("word", F.lit(False).alias("is_first"), F.lit(False).alias("noun_signal"), "cand", F.col("distance").cast("double").alias("cost"), F.lit(False).alias("rewritten"), F.lit(False).alias("known"), F.col("cand").rlike(r"^\p{Lu}").alias("must_cap"))
    return R.log_likelihood(near).select("word", "cand", F.round("prefix", 6).alias("prefix"), F.round("log_error", 6).alias("log_error"))


@query("r02_log_posterior")
def _(spark, d):
    return ranked(spark, d).select("word", "cand", F.round("log_error", 6).alias("log_error"), F.round("log_posterior", 6).alias("log_posterior"), "confidence")


@query("r03_ranked_candidates")
def _(spark, d):
    return R.rank_candidates(ranked(spark, d), 5).select("word", "suggestion", "rank")


@query("r04_suggest_in_context")
def _(spark, d):
    """Every unknown word of the German documents where it stands, with sixteen candidates scored in context."""
    lex, fr = cut(lexicon(spark, d)), cut(full_freq(spark, d))
    unknown = T.tokens_in_place(german(spark, d), before=False).join(lex.select("word"), "word", "left_anti")
    signal = X.noun_signal(F.col("context.text"), F.col("context.start"))
    rows = cut(unknown.select(F.concat_ws(":", "doc_id", "tok_ix").alias("occ_id"), "word", "is_first", signal.alias("noun_signal"), F.col("context.text").alias("context"), F.col("context.start").alias("start"), F.col("context.end").alias("end")))
    found = cut(C.collect_candidates(rows, lex, fr, limit=16))
    pairs = rows.join(found.select("word", "is_first", F.explode(F.array("cand", S.upper_first(F.col("cand")))).alias("candidate")), ["word", "is_first"])
    known = pairs.select("context", "start", "candidate").distinct().join(scores(spark, d), F.lower("candidate") == F.col("key")).select("context", "start", "candidate", "log_score")
    return R.suggest_in_context(rows, found, lex, fr, cut(known))


@query("r05_user_list_view", "WITH l AS (SELECT DISTINCT p_type AS word, 'user' AS list_type FROM part UNION ALL SELECT DISTINCT p_brand, 'ignored' FROM part), n AS (SELECT list_type, count(*) AS entries FROM l GROUP BY 1) SELECT l.list_type, l.word, n.entries FROM l JOIN n USING (list_type) WHERE contains(lower(l.word), 'an')")
def _(spark, d):
    part = table(spark, d, "part")
    lists = part.select(F.col("p_type").alias("word"), F.lit("user").alias("list_type")).union(part.select("p_brand", F.lit("ignored"))).distinct()
    return R.user_list_view(lists, "an")


# ---- context -----------------------------------------------------------------------------------


SIGNAL_SQL = f"""cut0 AS (SELECT *, regexp_replace(context[1:"at"], '\\s+$', '') AS bef, regexp_replace(lower(regexp_extract(context["at" + 1:], '^\\s*([^\\s.,;:!?]*)', 1)), '[^\\p{{L}}]', '', 'g') AS target FROM local),
cut1 AS (SELECT *, string_split_regex(bef, '\\s+') AS ws FROM cut0),
cut2 AS (SELECT *, coalesce(ws[-1], '') AS last_raw, regexp_replace(lower(coalesce(ws[-1], '')), '[^\\p{{L}}]', '', 'g') AS last, regexp_replace(lower(coalesce(ws[-2], '')), '[^\\p{{L}}]', '', 'g') AS prev FROM cut1),
signals AS (SELECT *, CASE WHEN last_raw = '' THEN false
 WHEN last = 'zu' AND (prev IN ({quoted(K.BEFORE_ZU)}) OR (target <> '' AND target NOT IN ({quoted(K.AFTER_ZU)}))) THEN false
 WHEN last = 'am' AND regexp_matches(target, '(?:sten|stn|ten|tn)$') AND target NOT IN ({quoted(K.AFTER_AM)}) THEN false
 WHEN last IN ({quoted(K.NOUN_SIGNALS)}) THEN true
 ELSE len(ws) >= 2 AND last_raw[1] = lower(last_raw[1]) AND NOT (last IN ({quoted(K.NO_ADJECTIVES)}) OR (starts_with(last, 'ge') AND regexp_matches(last, '(?:en|t|et)$') AND NOT regexp_matches(last, '(?:enes|enem|ener|ene|enen|etes|etem|eter|ete|eten)$')))
  AND ((prev IN ({quoted(K.DETERMINERS)}) AND regexp_matches(last, '(?:em|en|er|es|e)$')) OR (prev IN ({quoted(K.NOUN_SIGNALS)}) AND (regexp_matches(last, '(?:em|er|es)$') OR (ends_with(last, 'en') AND target <> '' AND NOT regexp_matches(target, '(?:en|eln|ern)$'))))) END AS signal FROM cut2)"""


@query("x01_noun_signal", f"WITH {GERMAN_TOKENS}, {CONTEXT_SQL}, {SIGNAL_SQL} SELECT id AS doc_id, s AS start, word, signal FROM signals")
def _(spark, d):
    rows = T.tokens_in_place(german(spark, d), before=False)
    return rows.select("doc_id", "start", "word", X.noun_signal(F.col("context.text"), F.col("context.start")).alias("signal"))


@query("x02_participle_or_adverb", f"WITH {LEX} SELECT word, word IN ({quoted(K.NO_ADJECTIVES)}) OR (starts_with(word, 'ge') AND regexp_matches(word, '(?:en|t|et)$') AND NOT regexp_matches(word, '(?:enes|enem|ener|ene|enen|etes|etem|eter|ete|eten)$')) AS excluded FROM (SELECT DISTINCT lower(word) AS word FROM cnt)")
def _(spark, d):
    return words(spark, d).select(F.lower("word").alias("word")).distinct().select("word", X.participle_or_adverb(F.col("word")).alias("excluded"))


@query("x03_viable_heads", f"WITH {LEX} SELECT word FROM cnt WHERE length(word) >= 3 AND (lower(word) IN (SELECT word FROM fr WHERE n >= 2) OR regexp_matches(lower(word), '{K.HEADS}') OR (length(word) >= 4 AND ends_with(lower(word), 'er') AND upper(word[1]) || lower(word[2:]) IN (SELECT word FROM lex WHERE flags & 1 <> 0)))")
def _(spark, d):
    seen = freq(spark, d).where("n >= 2").select("word", "n", F.lit(False).alias("has_lower"), F.lit(False).alias("has_title"))
    return X.viable_head(words(spark, d), lexicon(spark, d), seen)


PAIRS_SQL = ", ".join(f"('{w.lower()}', '{a}')" for pair in K.CONFUSION_PAIRS for w in pair for a in pair)


@query("x04_confusion_groups", f"WITH {LEX} SELECT c.word, v.alternative FROM (SELECT word FROM cnt UNION SELECT key FROM (VALUES {PAIRS_SQL}) k(key, alternative)) c JOIN (VALUES {PAIRS_SQL}) v(key, alternative) ON lower(c.word) = v.key")
def _(spark, d):
    own = spark.createDataFrame([(w.lower(),) for pair in K.CONFUSION_PAIRS for w in pair], "word string")
    return X.confusion_group(words(spark, d).select("word").union(own))


def piece_vocabulary(spark, d) -> DataFrame:
    parts = lexicon(spark, d).select(F.explode(F.array(F.substring("word", 1, 2), F.substring("word", 1, 1), F.concat(F.lit("##"), F.substring("word", 2, 1)), F.concat(F.lit("##"), F.substring("word", 3, 2)))).alias("piece")).where("piece <> '##' and piece <> ''").distinct()
    return parts.select("piece", F.conv(F.substring(F.md5("piece"), 1, 7), 16, 10).cast("int").alias("id"))


PIECES_SQL = """voc AS (SELECT DISTINCT piece, ('0x' || substr(md5(piece), 1, 7))::INT AS id FROM (SELECT unnest([word[1:2], word[1], '##' || word[2], '##' || word[3:4]]) AS piece FROM lex) WHERE piece NOT IN ('', '##')),
walk AS (SELECT word, 0 AS at_, []::INT[] AS pieces FROM (SELECT DISTINCT word FROM cnt)
UNION ALL SELECT w.word, CASE WHEN two.id IS NOT NULL THEN at_ + 2 WHEN one.id IS NOT NULL THEN at_ + 1 ELSE 999999 END, CASE WHEN two.id IS NOT NULL THEN list_append(pieces, two.id) WHEN one.id IS NOT NULL THEN list_append(pieces, one.id) ELSE [0] END
FROM walk w LEFT JOIN voc two ON two.piece = CASE WHEN at_ > 0 THEN '##' ELSE '' END || w.word[at_ + 1:at_ + 2] AND at_ + 2 <= length(w.word) LEFT JOIN voc one ON one.piece = CASE WHEN at_ > 0 THEN '##' ELSE '' END || w.word[at_ + 1] WHERE at_ < length(w.word)),
encoded AS (SELECT word, pieces FROM walk WHERE at_ >= length(word))"""


@query("x05_wordpieces", f"WITH RECURSIVE {LEX}, {PIECES_SQL} SELECT word, pieces FROM encoded")
def _(spark, d):
    return X.wordpiece_encode(words(spark, d).select("word").distinct(), piece_vocabulary(spark, d))


@query("x06_masked_inputs", f"""WITH RECURSIVE {LEX}, {PIECES_SQL}, seq AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k, len(w) AS m FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+(?:[-''‘’][\\p{{L}}\\p{{M}}\\d]+)*') AS w FROM documents WHERE lang = 'de') WHERE len(w) >= 3),
sides AS (SELECT doc_id, coalesce(flatten(list(pieces ORDER BY k) FILTER (k <= m // 2)), []) AS a, max(len(pieces)) FILTER (k = m // 2 + 1) AS n, coalesce(flatten(list(pieces ORDER BY k) FILTER (k > m // 2 + 1)), []) AS b FROM seq JOIN encoded USING (word) GROUP BY doc_id),
room AS (SELECT *, least(len(a), greatest((510 - n) // 2, 510 - n - len(b))) AS l FROM sides), cutn AS (SELECT *, least(len(b), 510 - n - l) AS r FROM room)
SELECT doc_id AS occ_id, n::INT AS n, list_concat(list_concat(a[len(a) - l + 1:], list_transform(range(0, n), lambda i: 103)), b[1:r])::INT[] AS input, list_transform(range(0, n), lambda i: i + l)::INT[] AS mask_at FROM cutn""")
def _(spark, d):
    """The middle word of every document is masked; pieces are those of X5."""
    coded = X.wordpiece_encode(words(spark, d).select("word").distinct(), piece_vocabulary(spark, d))
    rows = german(spark, d).select("doc_id", T.words_of(F.col("text")).alias("w")).where(F.size("w") >= 3)
    rows = rows.select("doc_id", F.size("w").alias("m"), F.posexplode("w").alias("k", "word")).join(coded, "word").withColumn("half", (F.col("m") / 2).cast("int"))
    side = lambda when: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("k", "pieces")))), lambda x: x["pieces"]))
    occ = rows.groupBy(F.col("doc_id").alias("occ_id")).agg(side(F.col("k") < F.col("half")).alias("pieces_before"), side(F.col("k") > F.col("half")).alias("pieces_after"), F.max(F.when(F.col("k") == F.col("half"), F.size("pieces"))).alias("n"))
    return X.masked_inputs(occ, 103)


def scores(spark, d) -> DataFrame:
    """A table scorer from the corpus: log frequency of the candidate."""
    return freq(spark, d).select(F.col("word").alias("key"), F.log(F.col("n").cast("double")).alias("log_score"))


def occurrences(spark, d) -> DataFrame:
    """Candidates within one edit; some have no context score, some words none at all, some come from the user."""
    near = C.fuzzy_join(rare(spark, d), lexicon(spark, d), 1)
    rows = near.join(scores(spark, d), F.lower("cand") == F.col("key"), "left")
    heard = (F.length("cand") % 3 > 0) & (F.length("word") % 4 > 0)
    return rows.select(F.col("word").alias("occ_id"), F.col("cand").alias("word"), (1 / (1 + F.col("distance"))).alias("edit_score"), F.when(F.length("cand") % 5 > 0, -2.2 * F.col("distance")).alias("log_posterior"), F.when(heard, F.col("log_score")).alias("log_score"), (F.length("cand") % 7 == 0).alias("from_user"))


@query("x07_score_in_context", f"WITH {LEX} SELECT r.word AS context, 0 AS start, l.word AS candidate, round(ln(f.n::DOUBLE), 6) AS log_score FROM rare r JOIN lex l ON l.word = r.word || 'en' LEFT JOIN fr f ON lower(l.word) = f.word")
def _(spark, d):
    lex = lexicon(spark, d).select(F.col("word").alias("candidate"))
    pairs = rare(spark, d).select(F.col("word").alias("context"), F.lit(0).alias("start"), F.concat("word", F.lit("en")).alias("candidate")).join(lex, "candidate", "left_semi").select("context", "start", "candidate")
    known = pairs.join(scores(spark, d), F.lower("candidate") == F.col("key")).select("context", "start", "candidate", "log_score")
    return X.score_in_context(pairs, known).select("context", "start", "candidate", F.round("log_score", 6).alias("log_score"))


def dense_vocabulary(spark, d) -> DataFrame:
    """Pieces with the numbers that a model's logits have; four special ones first."""
    special = spark.createDataFrame([("[UNK]", 0), ("[MASK]", 1), ("[CLS]", 2), ("[SEP]", 3)], "piece string, id int")
    own = piece_vocabulary(spark, d).select("piece").distinct()  # some thousand rows
    return special.union(own.select("piece", (F.row_number().over(Window.orderBy("piece")) + 3).cast("int").alias("id")))


def piece_pairs(spark, d, vocab: DataFrame) -> DataFrame:
    """How often a word that ends in a piece is followed by one that begins with a piece, and a mask (1) by a piece inside a word."""
    w = german(spark, d).select(T.words_of(F.col("text")).alias("w")).where(F.size("w") >= 2)
    pairs = w.select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    coded = cut(X.wordpiece_encode(words(spark, d).select("word").distinct(), vocab))
    first, last = coded.select(F.col("word").alias("b"), F.get("pieces", F.lit(0)).alias("piece")), coded.select(F.col("word").alias("a"), F.element_at("pieces", -1).alias("before"))
    inner = words(spark, d).groupBy("word").agg(F.count("*").alias("n")).join(coded, "word").select(F.lit(1).alias("before"), F.explode(F.slice("pieces", 2, 1000)).alias("piece"), "n")
    return pairs.join(last, "a").join(first, "b").select("before", "piece", "n").union(inner).groupBy("before", "piece").agg(F.sum("n").alias("n"))


def pair_scorer(spark, d):
    vocab = cut(dense_vocabulary(spark, d))
    return X.by_pieces(vocab, X.pair_model(piece_pairs(spark, d, vocab), vocab.count(), alpha=0.01), f"pairs of {d}")


#: Needs need(word), the basic parts that are encoded; gives enc(word, pieces) and follow(before, piece, n), times(before, n), size(v).
PAIR_SQL = """pv AS (SELECT piece, (row_number() OVER (ORDER BY piece) + 3)::INT AS id FROM (SELECT DISTINCT unnest([word[1:2], word[1], '##' || word[2], '##' || word[3:4]]) AS piece FROM lex) WHERE piece NOT IN ('', '##')),
size AS (SELECT count(*) + 4 AS v FROM pv),
pwalk AS (SELECT word, 0 AS at_, []::INT[] AS pieces FROM need
UNION ALL SELECT w.word, CASE WHEN two.id IS NOT NULL THEN at_ + 2 WHEN one.id IS NOT NULL THEN at_ + 1 ELSE 999999 END, CASE WHEN two.id IS NOT NULL THEN list_append(pieces, two.id) WHEN one.id IS NOT NULL THEN list_append(pieces, one.id) ELSE [0] END
FROM pwalk w LEFT JOIN pv two ON two.piece = CASE WHEN at_ > 0 THEN '##' ELSE '' END || w.word[at_ + 1:at_ + 2] AND at_ + 2 <= length(w.word) LEFT JOIN pv one ON one.piece = CASE WHEN at_ > 0 THEN '##' ELSE '' END || w.word[at_ + 1] WHERE at_ < length(w.word)),
enc AS (SELECT word, pieces FROM pwalk WHERE at_ >= length(word)),
seqs AS (SELECT regexp_extract_all(text, '[\\p{L}\\p{M}]+(?:[-''‘’][\\p{L}\\p{M}\\d]+)*') AS w FROM documents WHERE lang = 'de'),
nexts AS (SELECT unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM seqs WHERE len(w) >= 2),
follow AS (SELECT ea.pieces[-1] AS before, eb.pieces[1] AS piece, count(*) AS n FROM nexts JOIN enc ea ON ea.word = a JOIN enc eb ON eb.word = b GROUP BY 1, 2
UNION ALL SELECT 1, piece, sum(n)::BIGINT FROM (SELECT unnest(pieces[2:]) AS piece, n FROM cnt JOIN enc USING (word)) GROUP BY piece),
times AS (SELECT before, sum(n) AS n FROM follow GROUP BY 1),
parts AS (SELECT candidate, flatten(list(pieces ORDER BY k)) AS pieces FROM (SELECT candidate, unnest(b) AS word, unnest(range(1, len(b) + 1)) AS k FROM (SELECT DISTINCT candidate, regexp_extract_all(candidate, '[\\p{L}\\p{M}\\p{N}]+|[^\\s\\p{Z}\\p{L}\\p{M}\\p{N}]') AS b FROM pairs)) JOIN enc USING (word) GROUP BY candidate),
ends AS (SELECT DISTINCT lft, regexp_extract_all(lft, '[\\p{L}\\p{M}\\p{N}]+|[^\\s\\p{Z}\\p{L}\\p{M}\\p{N}]')[-1] AS word FROM pairs),
inside AS (SELECT candidate, sum(ln((coalesce(f.n, 0) + 0.01::DOUBLE) / (t.n + 0.01::DOUBLE * v))) AS log_p FROM (SELECT candidate, unnest(pieces[2:]) AS inner_piece FROM parts) LEFT JOIN follow f ON f.before = 1 AND f.piece = inner_piece CROSS JOIN size JOIN times t ON t.before = 1 GROUP BY candidate),
scored AS (SELECT p.*, (ln((coalesce(f.n, 0) + 0.01::DOUBLE) / (coalesce(t.n, 0) + 0.01::DOUBLE * size.v)) + coalesce(inside.log_p, 0)) / len(parts.pieces) AS log_score
FROM pairs p LEFT JOIN inside USING (candidate) CROSS JOIN size JOIN parts USING (candidate) JOIN ends ON ends.lft = p.lft LEFT JOIN enc ON enc.word = ends.word LEFT JOIN times t ON t.before = coalesce(enc.pieces[-1], 2) LEFT JOIN follow f ON f.before = coalesce(enc.pieces[-1], 2) AND f.piece = parts.pieces[1])"""
NEED_SQL = """need AS (SELECT word FROM cnt UNION SELECT unnest(regexp_extract_all(candidate, '[\\p{L}\\p{M}\\p{N}]+|[^\\s\\p{Z}\\p{L}\\p{M}\\p{N}]')) FROM pairs UNION SELECT regexp_extract_all(lft, '[\\p{L}\\p{M}\\p{N}]+|[^\\s\\p{Z}\\p{L}\\p{M}\\p{N}]')[-1] FROM pairs)"""


@query("x07_piece_scores", f"""WITH RECURSIVE {LEX}, {KEYED}, {GERMAN_TOKENS}, {CONTEXT_SQL}, near AS MATERIALIZED (SELECT r.word, l.word AS cand FROM rk r JOIN lk l ON abs(length(r.word) - length(l.word)) <= 1 WHERE {EDIT} <= 1),
pairs AS MATERIALIZED (SELECT id AS doc_id, s AS start, word, lft, candidate FROM local JOIN (SELECT word, cand AS candidate FROM near UNION SELECT word, word FROM near) USING (word)), {NEED_SQL}, {PAIR_SQL}
SELECT doc_id, start, candidate, round(log_score, 6) AS log_score FROM scored""")
def _(spark, d):
    """Rare words where they stand, against their neighbours in the lexicon, scored piece by piece."""
    near = C.fuzzy_join(rare(spark, d), lexicon(spark, d), 1).select("word", F.explode(F.array("word", "cand")).alias("candidate")).distinct()
    rows = T.tokens_in_place(german(spark, d), before=False).join(near, "word")
    pairs = rows.select("doc_id", F.col("start").alias("pos"), F.col("context.text").alias("context"), F.col("context.start").alias("start"), F.col("context.end").alias("end"), "candidate")
    return pair_scorer(spark, d)(cut(pairs)).select("doc_id", F.col("pos").alias("start"), "candidate", F.round("log_score", 6).alias("log_score"))


@query("x08_fuse_scores", f"""WITH {LEX}, {KEYED}, p AS (SELECT r.word AS occ_id, l.word AS word, {EDIT} AS dist FROM rk r JOIN lk l ON abs(length(r.word) - length(l.word)) <= 1 WHERE {EDIT} <= 1),
q AS (SELECT p.*, lower(p.word) AS fam, 1.0 / (1 + dist) AS es, CASE WHEN length(p.word) % 5 > 0 THEN -2.2 * dist ELSE -3 * greatest(0.1, 1 / (1.0 / (1 + dist)) - 1) END AS lp, CASE WHEN length(p.word) % 3 > 0 AND length(p.occ_id) % 4 > 0 THEN ln(f.n::DOUBLE) END AS ls, CASE WHEN length(p.word) % 7 = 0 THEN 0.35 ELSE 0 END AS bonus FROM p LEFT JOIN fr f ON lower(p.word) = f.word),
n AS (SELECT *, row_number() OVER (PARTITION BY occ_id ORDER BY lp DESC, word) AS came FROM q),
h AS (SELECT occ_id, max(ls) AS top FROM n GROUP BY 1 HAVING max(ls) IS NOT NULL), z AS (SELECT n.occ_id, sum(exp(ls - top)) AS mass FROM n JOIN h USING (occ_id) GROUP BY 1),
spelled AS (SELECT occ_id, fam, max(lp) AS best, min(came) AS seen FROM n GROUP BY 1, 2),
m AS (SELECT n.*, seen, best + 0.35 * ls + bonus AS own, 0.30 * coalesce(exp(ls - top) / mass, 0) + 0.70 * es + bonus AS ss FROM n JOIN h USING (occ_id) JOIN z USING (occ_id) JOIN spelled USING (occ_id, fam)),
f AS (SELECT occ_id, fam, max(own) AS family_score, max(ss) AS surface_score, min(seen) AS seen FROM m GROUP BY 1, 2),
w AS (SELECT f.*, (SELECT arg_min(m.word, m.came) FROM m WHERE m.occ_id = f.occ_id AND m.fam = f.fam AND m.ss = f.surface_score) AS word FROM f)
SELECT occ_id, word, round(family_score, 6) AS family_score, round(surface_score, 6) AS surface_score, row_number() OVER (PARTITION BY occ_id ORDER BY family_score DESC NULLS LAST, seen)::INT AS rank FROM w
UNION ALL SELECT occ_id, word, round(lp, 6), round(es, 6), came::INT FROM n WHERE occ_id NOT IN (SELECT occ_id FROM h)""")
def _(spark, d):
    return X.fuse_scores(occurrences(spark, d)).select("occ_id", "word", F.round("family_score", 6).alias("family_score"), F.round("surface_score", 6).alias("surface_score"), "rank")


@query("x09_context_errors", f"""WITH RECURSIVE {LEX}, {GERMAN_TOKENS}, {CONTEXT_SQL}, lexlow AS (SELECT lower(word) AS low, word AS correction FROM lex),
typo AS (SELECT lower(r.word) AS typo, min(l.correction) AS correction FROM rare r JOIN lexlow l ON l.low = regexp_replace(lower(r.word), '(?:en|er|es|e|n|s)$', '') WHERE l.low <> lower(r.word) GROUP BY 1),
fixed AS (SELECT DISTINCT c.word, v.alternative FROM cnt c JOIN (VALUES {PAIRS_SQL}) v(key, alternative) ON lower(c.word) = v.key),
more AS (SELECT DISTINCT c.word, t.correction FROM cnt c JOIN typo t ON t.typo = lower(c.word) WHERE c.word NOT IN (SELECT word FROM fixed) AND lower(t.correction) <> t.typo AND replace(lower(t.correction), 'ß', 'ss') <> replace(t.typo, 'ß', 'ss') AND lower(c.word) NOT IN (SELECT word FROM fr WHERE n >= 3)),
rl AS (SELECT word, {BYTES.format("lower(word[1]) || word[2:]")} AS a, {BYTES.format("upper(word[1]) || word[2:]")} AS b FROM lex WHERE flags = 2), lk AS (SELECT word, {BYTES.format("word")} AS t FROM lex),
close AS (SELECT r.word, l.word AS cand FROM rl r JOIN lk l ON abs(length(r.word) - length(l.word)) <= 1 WHERE {EDIT} = 1),
groups AS (SELECT * FROM fixed UNION SELECT word, unnest([word, correction]) FROM more UNION SELECT word, unnest([word, cand]) FROM close),
wrong AS (SELECT id, s FROM toks WHERE word NOT IN (SELECT word FROM lex) AND lower(word) NOT IN (SELECT typo FROM typo)), taken AS (SELECT word FROM cnt WHERE n = 2),
open_ AS (SELECT l.* FROM local l WHERE NOT EXISTS (SELECT 1 FROM wrong x WHERE x.id = l.id AND x.s = l.s) AND l.word NOT IN (SELECT word FROM taken)),
pairs AS MATERIALIZED (SELECT DISTINCT id, s, e, o.word, is_first, lft, CASE WHEN o.word = upper(o.word) AND o.word <> lower(o.word) THEN upper(alternative) WHEN is_first THEN upper(alternative[1]) || alternative[2:] ELSE alternative END AS candidate FROM open_ o JOIN groups g ON g.word = o.word), {NEED_SQL}, {PAIR_SQL},
best AS (SELECT id, s, e, word, is_first, max(log_score) AS top, arg_max(candidate, (log_score, candidate)) AS candidate, max(log_score) FILTER (lower(candidate) = lower(word)) AS own FROM scored GROUP BY id, s, e, word, is_first)
SELECT id AS doc_id, s AS start, e AS "end", word, is_first, 'context' AS kind, candidate AS suggestion, [candidate] AS suggestions FROM best WHERE lower(candidate) <> lower(word) AND top - own >= {K.CONTEXT_MARGIN}""")
def _(spark, d):
    """Groups of X4 with a typo table, and words in -en with their neighbours, scored by pieces. Spelling errors are words that neither lexicon nor typo table has, accepted ones occur twice."""
    typed, lex = cut(corpus_typos(spark, d)), lexicon(spark, d)
    tokens = cut(T.tokens_in_place(german(spark, d), before=False).select("doc_id", "word", "start", "end", "is_first", F.col("context.text").alias("context"), F.col("context.start").alias("at")))
    close = C.fuzzy_join(lex.where("flags = 2"), lex, 1).where("distance = 1").select("word", F.explode(F.array("word", "cand")).alias("alternative"))
    groups = cut(X.confusion_group(tokens, typed, full_freq(spark, d)).union(close).distinct())
    spelling = tokens.join(lex.select("word"), "word", "left_anti").join(typed, F.lower("word") == F.col("typo"), "left_anti")
    return X.check_context(tokens, groups, pair_scorer(spark, d), spelling, X.accepted_words(tokens, user_words(spark, d)))


@query("x10_accepted_words", f"WITH {TOK} SELECT word, count(*) AS n FROM tok WHERE lower(word) IN (SELECT lower(word) FROM tok GROUP BY word HAVING count(*) >= 50) GROUP BY word")
def _(spark, d):
    w = words(spark, d)
    lists = w.groupBy("word").agg(F.count("*").alias("n")).where("n >= 50")
    return X.accepted_words(w, lists, check_case=False).groupBy("word").agg(F.count("*").alias("n"))


# ---- document results --------------------------------------------------------------------------


def errors(spark, d) -> DataFrame:
    """Tokens that are not in the lexicon, with their lower-cased form as the suggestion."""
    lex = lexicon(spark, d).select("word")
    rows = T.tokenize(german(spark, d)).join(lex, "word", "left_anti")
    return rows.select("doc_id", "start", "end", "word", "is_first", F.lit("spelling").alias("kind"), F.upper("word").alias("suggestion"))


ERRORS_SQL = GERMAN_TOKENS + ", " + LEX + ", errs AS (SELECT id, text, s, e, word, is_first, replace(upper(word), 'ẞ', 'SS') AS sug FROM toks WHERE word NOT IN (SELECT word FROM lex))"


@query("w01_merge_errors", f"""WITH {ERRORS_SQL} SELECT id AS doc_id, s AS start, e AS "end", word, is_first, 'spelling' AS kind, sug AS suggestion FROM errs UNION ALL SELECT id, s, e, word, is_first, 'context', lower(word) FROM toks t WHERE is_first AND NOT EXISTS (SELECT 1 FROM errs x WHERE x.id = t.id AND x.s = t.s)""")
def _(spark, d):
    spelling = errors(spark, d)
    context = T.tokenize(german(spark, d)).where("is_first").select("doc_id", "start", "end", "word", "is_first", F.lit("context").alias("kind"), F.lower("word").alias("suggestion"))
    return results.merge_errors(spelling, context)


def still_sql(k: int) -> str:
    edge = r"[\p{L}\p{M}\p{N}_]"
    return f"(text[s + {k} + 1:e + {k}] = word AND NOT regexp_matches(CASE WHEN s + {k} > 0 THEN text[s + {k}] ELSE '' END, '{edge}') AND NOT regexp_matches(substr(text, e + {k} + 1, 1), '{edge}'))"


@query("w02_error_still_matches", f"WITH {ERRORS_SQL} SELECT id AS doc_id, s AS start, word, {still_sql(0)} AS at_0, {still_sql(1)} AS at_1 FROM errs")
def _(spark, d):
    rows = errors(spark, d).join(german(spark, d), "doc_id")
    at = [results.error_still_matches(F.col("text"), F.col("start") + k, F.col("end") + k, F.col("word")).alias(f"at_{k}") for k in (0, 1)]
    return rows.select("doc_id", "start", "word", *at)


@query("w03_apply_corrections", f"WITH {ERRORS_SQL}, o AS (SELECT *, lag(e) OVER (PARTITION BY id ORDER BY s) AS p FROM errs), j AS (SELECT id, string_agg(text[coalesce(p, 0) + 1:s] || sug, '' ORDER BY s) || any_value(text)[max(e) + 1:] AS fixed FROM o GROUP BY id) SELECT src.id AS doc_id, coalesce(fixed, src.text) AS text FROM src LEFT JOIN j ON j.id = src.id")
def _(spark, d):
    return results.apply_corrections(german(spark, d), errors(spark, d))


@query("w04_carry_errors", f"""WITH {ERRORS_SQL}, heads AS (SELECT id, text, coalesce(list_min(list_filter(range(1, 6), lambda i: text[i] <> 'Neu. '[i])) - 1, 5) AS head FROM src WHERE NOT starts_with(text, 'Neu. '))
SELECT e.id AS doc_id, CASE WHEN e.e <= head THEN s ELSE s + 5 END::INT AS start, CASE WHEN e.e <= head THEN e.e ELSE e.e + 5 END::INT AS "end", word, is_first, 'spelling' AS kind, sug AS suggestion FROM errs e JOIN heads h ON h.id = e.id WHERE e.s >= head""")
def _(spark, d):
    old = german(spark, d)
    return results.carry_errors(old, old.select("doc_id", F.concat(F.lit("Neu. "), "text").alias("text")), errors(spark, d))


def list_events(spark, d) -> DataFrame:
    """Turns of conversations as changes of a user's lists."""
    turn = F.col("turn")
    action = F.when(turn % 4 == 0, "add").when(turn % 4 == 1, "remove").when(turn % 4 == 2, "ignore").otherwise("unignore")
    return table(spark, d, "conversations").select((F.col("conv_id") * 100 + turn).alias("seq"), action.alias("action"), "text")


LISTS_SQL = r"""ev AS (SELECT conv_id * 100 + turn AS seq, CASE turn % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'ignore' ELSE 'unignore' END AS action, string_split_regex(text, '[\s,;]+') AS parts FROM conversations),
en AS (SELECT seq, action, regexp_replace(unnest(parts), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}''-]+$', '', 'g') AS word, unnest(range(0, len(parts))) AS k FROM ev),
ch AS (SELECT CASE WHEN action IN ('add', 'remove') THEN 'user' ELSE 'ignored' END AS list_type, word, seq, row_number() OVER (ORDER BY seq, k) AS place, action IN ('add', 'ignore') AS present FROM en WHERE word <> ''),
every AS (SELECT * FROM ch UNION ALL SELECT 'user', p_brand, -1, -1, true FROM (SELECT DISTINCT p_brand FROM part)),
gone AS (SELECT list_type, lower(word) AS low, max(place) FILTER (NOT present) AS gone FROM every GROUP BY 1, 2)
SELECT arg_min(e.word, e.place) AS word, e.list_type FROM every e JOIN gone g ON g.list_type = e.list_type AND g.low = lower(e.word) WHERE e.present AND (gone IS NULL OR place > gone) GROUP BY e.list_type, lower(e.word)"""


@query("w05_update_user_lists", f"WITH {LISTS_SQL}")
def _(spark, d):
    lists = table(spark, d, "part").select(F.col("p_brand").alias("word"), F.lit("user").alias("list_type")).distinct()
    return results.update_user_lists(lists, list_events(spark, d))


@query("w06_clear_word", f"WITH {ERRORS_SQL} SELECT id AS doc_id, s AS start, e AS \"end\", word, is_first, 'spelling' AS kind, sug AS suggestion FROM errs WHERE word NOT IN (SELECT word FROM cnt WHERE n = 2)")
def _(spark, d):
    return results.clear_word(errors(spark, d), words(spark, d).groupBy("word").agg(F.count("*").alias("n")).where("n = 2"))


# ---- typo corpora and measures -----------------------------------------------------------------


def drawn(what: str, n) -> str:
    return f"(('0x' || substr(md5(word || '|42|{what}'), 1, 8))::BIGINT % ({n}))"


def mutate_sql(source: str) -> str:
    """made(word, typo, kind) of source(word)."""
    slips = " ".join(f"WHEN '{k}' THEN '{near}'[{drawn('key', len(near))} + 1]" for k, near in K.SLIPS.items())
    sounds = " ".join(f"WHEN instr(word, '{a}') > 0 THEN word[1:instr(word, '{a}') - 1] || '{b}' || word[instr(word, '{a}') + {len(a)}:]" for a, b in K.SOUND_SWAPS)
    return f"""places AS (SELECT word, length(word) AS n, CASE WHEN length(word) >= 4 THEN 2 + {drawn('swap', 'length(word) - 2')} END AS i, CASE WHEN length(word) >= 4 THEN 2 + {drawn('place', 'length(word) - 1')} END AS j, 1 + {drawn('gap', 'length(word)')} AS g FROM {source}),
chosen AS (SELECT *, CASE WHEN n < 4 THEN 'short' ELSE ['transposition', 'qwertz', 'double_cons', 'omission', 'insertion', 'phonetic'][1 + {drawn('kind', 6)}] END AS kind, list_min(list_filter(range(2, n), lambda p: lower(word[p]) = lower(word[p + 1]) AND regexp_matches(word[p], '\\p{{L}}'))) AS twin, CASE lower(word[j]) {slips} END AS slip FROM places),
free AS (SELECT *, CASE kind WHEN 'transposition' THEN word[1:i - 1] || word[i + 1] || word[i] || word[i + 2:] WHEN 'qwertz' THEN CASE WHEN slip IS NULL THEN word ELSE word[1:j - 1] || CASE WHEN word[j] = upper(word[j]) AND word[j] <> lower(word[j]) THEN upper(slip) ELSE slip END || word[j + 1:] END
 WHEN 'double_cons' THEN word[1:j] || word[j] || word[j + 1:] WHEN 'omission' THEN word[1:j - 1] || word[j + 1:] ELSE word[1:g] || '{K.FREQUENT_LETTERS}'[{drawn('letter', len(K.FREQUENT_LETTERS))} + 1] || word[g + 1:] END AS other FROM chosen),
made AS (SELECT word, kind, CASE WHEN kind = 'short' THEN word || 'x' WHEN kind = 'phonetic' THEN CASE {sounds} ELSE word || 'e' END WHEN kind = 'double_cons' AND twin IS NOT NULL THEN word[1:twin] || word[twin + 2:] WHEN other = word THEN word || 'n' ELSE other END AS typo FROM free)"""


@query("b01_mutate", f"WITH {LEX}, {mutate_sql('lex')} SELECT word, typo, kind FROM made")
def _(spark, d):
    return synth.mutate(lexicon(spark, d))


@query("b02_sample_words", rf"WITH {LEX} SELECT word FROM (SELECT word, row_number() OVER (ORDER BY md5(word || '|42'), word) AS r FROM cnt WHERE regexp_full_match(word, '\p{{L}}{{4,}}')) WHERE r <= 1000")
def _(spark, d):
    return synth.sample_words(words(spark, d), 1000)


@query("b03_typo_corpus", rf"""WITH {LEX}, good AS (SELECT word FROM lex WHERE regexp_full_match(word, '\p{{L}}{{4,}}') ORDER BY md5(word || '|42'), word LIMIT 2000), {mutate_sql('good')},
t AS (SELECT word, NULL AS base, 'known' AS kind, 0 AS turn FROM rare WHERE length(word) > 25 UNION ALL SELECT typo, word, kind, 1 FROM made WHERE typo NOT IN (SELECT word FROM lex))
SELECT word, 'real' AS label, word AS base, 'none' AS kind FROM good UNION ALL (SELECT word, 'typo', base, kind FROM t ORDER BY turn, md5(word || '|42'), word, base NULLS FIRST LIMIT 2000)""")
def _(spark, d):
    lex = lexicon(spark, d)
    known = rare(spark, d).select(F.col("word").alias("typo")).where(F.length("typo") > 25)
    return synth.typo_corpus(lex, lex, known, 2000)


@query("b04_recognition_rate", f"WITH {LEX}, p AS (SELECT word AS w, false AS f FROM cnt), v AS (SELECT {LOOKUP_SQL} AS correct FROM p) SELECT count(*) AS words, count(*) FILTER (correct) AS accepted, round(avg(CASE WHEN correct THEN 1.0 ELSE 0 END), 6) AS rate FROM v")
def _(spark, d):
    rows = words(spark, d).select("word").distinct().withColumn("is_first", F.lit(False))
    known = detect.lookup_words(rows, lexicon(spark, d)).withColumn("correct", F.lit(True))
    return synth.recognition_rate(rows.join(known, ["word", "is_first"], "left").withColumn("correct", F.coalesce("correct", F.lit(False))))


@query("b05_suggestion_hit_rate")
def _(spark, d):
    """All words of the lexicon, mutated: is the intended word among the first five suggestions?"""
    lex, fr = cut(lexicon(spark, d)), cut(full_freq(spark, d))
    made = synth.mutate(lex).join(lex.select(F.col("word").alias("typo")), "typo", "left_anti")
    rows = made.select(F.col("typo").alias("word"), F.lit(False).alias("is_first")).distinct()
    found = R.suggest(rows.withColumn("noun_signal", F.lit(False)), C.collect_candidates(rows, lex, fr, limit=10), lex, fr)
    rank = found.select(F.col("word").alias("typo"), F.lower("suggestion").alias("low"), "rank").groupBy("typo", "low").agg(F.min("rank").alias("rank"))
    return synth.suggestion_hit_rate(made.withColumn("low", F.lower("word")).join(rank, ["typo", "low"], "left"))


@query("b06_expectations", f"""WITH {LEX}, t AS (SELECT lower(word) || 'x' AS typo, min(word) AS correction FROM lex GROUP BY 1), c AS (SELECT word AS w, n >= 3 AS is_correct, NULL AS expected_top1, false AS f FROM cnt UNION ALL SELECT word || 'x', NULL, CASE WHEN flags = 1 THEN word ELSE lower(word) END, false FROM lex),
a AS (SELECT p.*, {LOOKUP_SQL} AS correct, CASE WHEN NOT ({LOOKUP_SQL}) THEN CASE WHEN w = upper(w) AND w <> lower(w) THEN replace(upper(t.correction), 'ẞ', 'SS') ELSE t.correction END END AS top1 FROM c p LEFT JOIN t ON lower(p.w) = t.typo)
SELECT w AS word, is_correct, expected_top1, correct, top1, (is_correct IS NULL OR is_correct = correct) AND (expected_top1 IS NULL OR coalesce(expected_top1 = top1, false)) AS ok FROM a""")
def _(spark, d):
    """Verdicts of all words by the lexicon, and first suggestions for typos with a listed correction."""
    counted, lex = words(spark, d).groupBy("word").agg(F.count("*").alias("n")), lexicon(spark, d)
    verdict = counted.select("word", (F.col("n") >= 3).alias("is_correct"), F.lit(None).cast("string").alias("expected_top1"))
    first = lex.select(F.concat("word", F.lit("x")).alias("word"), F.lit(None).cast("boolean"), F.when(F.col("flags") == 1, F.col("word")).otherwise(F.lower("word")))
    cases = cut(verdict.union(first))
    listed = lex.groupBy(F.concat(F.lower("word"), F.lit("x")).alias("typo")).agg(F.min("word").alias("correction"))
    rows = cases.select("word", F.lit(False).alias("is_first")).distinct()
    known = detect.lookup_words(rows, lex).select("word", F.lit(True).alias("correct"))
    top = C.known_corrections(rows, listed, lex).select("word", F.col("cand").alias("top1"))
    actual = rows.select("word").join(known, "word", "left").join(top, "word", "left").select("word", F.coalesce("correct", F.lit(False)).alias("correct"), "top1")
    return synth.check_expectations(cases, actual)


# ---- streams: bounded replays of the conversations ------------------------------------------------

#: When a turn was written: now and then a pause, otherwise at once after the one before.
TURN_MS = "conv_id * 1000000 + turn * 100 + (turn // 3) * 900"


def revisions(spark, d) -> DataFrame:
    """Turns as revisions of a text."""
    ms = F.col("conv_id") * 1_000_000 + F.col("turn") * 100 + F.floor(F.col("turn") / 3) * 900
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("revision"), F.timestamp_millis(ms).alias("ts"), "text")


def replayed(spark, rows: DataFrame, files: int = 4, last: DataFrame | None = None) -> DataFrame:
    """A stream that reads the rows in batches; `last` comes after all others."""
    path = scratch_path(spark, "stream")
    rows.repartition(files).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
        stream = stream.option("latestFirst", "false")
    return stream.parquet(path)


def drained(writer, path: str | None = None):
    query_ = writer.trigger(availableNow=True).start(path) if path else writer.trigger(availableNow=True).start()
    query_.awaitTermination()


@query("z01_latest_revisions", "SELECT conv_id AS doc_id, max(turn)::INT AS revision, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def _(spark, d):
    """The last revision that was handed on of each text."""
    out = scratch_path(spark, "handed")
    drained(live.latest_revisions(replayed(spark, revisions(spark, d)), "36500 days").writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "log")), out)
    return spark.read.parquet(out).groupBy("doc_id").agg(F.max("revision").alias("revision"), F.max_by("text", "revision").alias("text"))


@query("z02_quiet_revisions", f"""WITH r AS (SELECT conv_id, turn, text, {TURN_MS} AS ms FROM conversations), m AS (SELECT *, CASE WHEN ms - lag(ms) OVER o < 600 THEN 0 ELSE 1 END AS opens FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY ms)), b AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY ms) AS burst FROM m) SELECT conv_id AS doc_id, max(turn)::INT AS revision, arg_max(text, turn) AS text, min(ms)::BIGINT AS from_ms, (max(ms) + 600)::BIGINT AS to_ms FROM b GROUP BY conv_id, burst""")
def _(spark, d):
    """The last text of every burst; events far in the future close the last ones."""
    rows, out = cut(revisions(spark, d)), scratch_path(spark, "quiet")
    path = scratch_path(spark, "stream")
    rows.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    log = scratch_path(spark, "log")
    drained(live.quiet_revisions(stream).writeStream.format("parquet").option("checkpointLocation", log), out)
    late = rows.agg(F.lit(-1).cast("long").alias("doc_id"), F.lit(0).alias("revision"), (F.max("ts") + F.expr("interval 1 day")).alias("ts"), F.lit("").alias("text"))
    for day in range(2):  # the first moves the watermark, the second is read under it
        late.withColumn("ts", F.col("ts") + F.expr(f"interval {day} day")).coalesce(1).write.mode("append").parquet(path)
        drained(live.quiet_revisions(stream).writeStream.format("parquet").option("checkpointLocation", log), out)
    return spark.read.parquet(out).where("doc_id >= 0").select("doc_id", "revision", "text", F.unix_millis("from_ts").alias("from_ms"), F.unix_millis("to_ts").alias("to_ms"))


@query("z03_changed_sentences", r"""WITH s AS (SELECT conv_id AS doc_id, unnest(regexp_extract_all(text, '[^.!?…\r\n]+(?:[.!?…]+|[\r\n]+|$)')) AS sentence FROM conversations) SELECT DISTINCT doc_id, sentence FROM s WHERE regexp_matches(sentence, '\p{L}')""")
def _(spark, d):
    """Sentences that are new to their conversation, over all its turns."""
    said = T.sentences(revisions(spark, d).withColumn("key", F.struct("doc_id", "ts")), id_col="key").select("doc_id.doc_id", F.timestamp_seconds(F.lit(1_000_000_000)).alias("ts"), F.col("text").alias("sentence"))
    out = scratch_path(spark, "changed")
    drained(live.changed_sentences(replayed(spark, said)).writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "log")), out)
    return spark.read.parquet(out).select("doc_id", "sentence")


@query("z04_check_stream", f"""WITH {GERMAN_TOKENS}, {LEX}, p AS (SELECT *, word AS w, is_first AS f FROM toks) SELECT id AS doc_id, tok_ix, word, s AS start, e AS "end", is_first FROM p WHERE NOT (length(w) <= 1 OR regexp_matches(w, '\\d') OR lower(w) IN ({quoted(K.ABBREVIATIONS)})) AND NOT ({LOOKUP_SQL})""")
def _(spark, d):
    docs = german(spark, d).select("doc_id", F.timestamp_seconds(F.lit(1_000_000_000)).alias("ts"), "text")
    out = scratch_path(spark, "errors")
    drained(live.check_stream(replayed(spark, docs), cut(lexicon(spark, d))).writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "log")), out)
    return spark.read.parquet(out)


@query("z05_list_changes", f"WITH {LISTS_SQL}")
def _(spark, d):
    """The lists after all changes, which come in batches in their order; the first adds the brands."""
    brands = table(spark, d, "part").select("p_brand").distinct().agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ";").alias("text"))  # some dozens
    first = brands.select(F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("action"), "text")
    path, out = scratch_path(spark, "changes"), scratch_path(spark, "lists")
    events = list_events(spark, d)
    schema, log = events.schema, scratch_path(spark, "log")
    half = events.agg(F.percentile_approx("seq", 0.5).alias("half")).first().half or 0
    for part in (first, events.where(F.col("seq") <= half), events.where(F.col("seq") > half)):
        part.write.mode("append").parquet(path)
        drained(live.list_changes(spark.readStream.schema(schema).parquet(path)).writeStream.format("parquet").option("checkpointLocation", log), out)
    return live.current_lists(spark.read.schema(live.CHANGE).parquet(out))
