"""Sources and sinks of word lists, dictionaries, corpus data and user lists."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_word_list(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One word per line; blank and comment lines go."""
    word = F.trim("value")
    return spark.read.text(path).select(word.alias("word"), F.lit(source).alias("source")).where((F.length("word") > 0) & ~F.startswith("word", F.lit("#")))


def keepable(col):
    return (F.length(col) > 1) | col.isin(*"abABszSZ")


def read_morph_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Form lines followed by `lemma TAG,TAG` lines -> form, lemma, tags.

    A form line without lemmas gives a row with null lemma. Files are parallel to each other; within
    one, a form is carried down to the lines that describe it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"), F.split(F.trim("value"), " ").alias("part")).where(F.col("part")[0] != "")
    is_form = F.size("part") == 1
    form = F.when(is_form & keepable(F.col("part")[0]), F.col("part")[0])
    carried = lines.withColumn("form", F.last(form, ignorenulls=True).over(Window.partitionBy("file").orderBy("line")))
    lemma = F.when(~is_form & keepable(F.col("part")[0]), F.col("part")[0])
    return carried.select("form", lemma.alias("lemma"), F.when(~is_form, F.split(F.col("part")[1], ",")).alias("tags")).where((is_form & keepable(F.col("part")[0])) | lemma.isNotNull())


def frequency_rows(lines: DataFrame) -> DataFrame:
    part = F.split(F.col("value"), "\t")
    freq = F.get(part, F.lit(2))
    return lines.where(F.size(part) >= 2).select(F.trim(part[0]).try_cast("long").alias("id"), F.trim(part[1]).alias("word"), F.when(freq.rlike("^[0-9]+$"), freq.try_cast("long")).otherwise(1).alias("freq"))


def read_frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """S3: tab-separated id, word, count; a missing or non-numeric count is 1."""
    return frequency_rows(spark.read.text(path))


def affix_rows(lines: DataFrame) -> DataFrame:
    entry = F.trim(F.split_part(F.col("value"), F.lit("#"), F.lit(1)))
    rows = lines.select(entry.alias("entry")).where("entry <> ''")
    return rows.select(F.trim(F.split_part("entry", F.lit("/"), F.lit(1))).alias("base"), F.trim(F.split_part("entry", F.lit("/"), F.lit(2))).alias("flags"))


def read_affix_dictionary(spark: SparkSession, path: str, encoding: str = "UTF-8", skip_header: bool = False) -> DataFrame:
    """`base/FLAGS # comment` lines."""
    lines = spark.read.option("header", skip_header).csv(path, sep="\x01", encoding=encoding, quote="", enforceSchema=True, schema="value string")
    return affix_rows(lines)


def read_rule_suggestions(spark: SparkSession, path: str, row_tag: str = "rule") -> DataFrame:
    """Texts of `suggestion` and the parts of `example@correction` in an XML rule file."""
    schema = "example array<struct<_VALUE:string,_correction:string>>, message struct<_VALUE:string,suggestion:array<string>>, suggestion array<string>"
    rules = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    corrections = F.flatten(F.transform(F.coalesce("example", F.array()), lambda e: F.split(F.coalesce(e["_correction"], F.lit("")), r"\|")))
    words = F.concat(F.coalesce("suggestion", F.array()), F.coalesce("message.suggestion", F.array()), corrections)
    return rules.select(F.explode(words).alias("word")).select(F.trim("word").alias("word")).where("word <> ''")


LANGUAGE_DATA = "corpus struct<words:map<string,bigint>,totalCount:bigint,lowercaseWords:array<string>,titlecaseWords:array<string>>, typos struct<corrections:map<string,string>>, vocab map<string,int>"


def write_language_data(parts: DataFrame, path: str) -> None:
    """parts(bucket, corpus, typos, vocab): files named by bucket, each a JSON array of the bucket's objects."""
    rows = parts.select("bucket", F.to_json(F.struct("corpus", "typos", "vocab")).alias("object"))
    arrays = rows.groupBy("bucket").agg(F.concat(F.lit("["), F.array_join(F.collect_list("object"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("bucket").text(path)


def read_language_data(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables freq(word, n, has_lower, has_title), freq_totals(total, types), typos, vocab.

    One JSON object holds all, or several hold parts (of the words, for instance); totals are summed.
    """
    data = spark.read.schema(LANGUAGE_DATA).json(path, multiLine=True)
    words = data.select(F.explode("corpus.words").alias("word", "n"))
    lower = data.select(F.explode("corpus.lowercaseWords").alias("word")).distinct().withColumn("has_lower", F.lit(True))
    title = data.select(F.explode("corpus.titlecaseWords").alias("word")).distinct().withColumn("has_title", F.lit(True))
    freq = words.join(lower, "word", "full").join(title, "word", "full").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("has_lower", F.lit(False)).alias("has_lower"), F.coalesce("has_title", F.lit(False)).alias("has_title"))
    totals = data.agg(F.sum("corpus.totalCount").alias("total"), F.sum(F.size(F.coalesce("corpus.words", F.create_map().cast("map<string,bigint>")))).cast("long").alias("types"))
    typos = data.select(F.explode("typos.corrections").alias("typo", "correction")).select(F.lower("typo").alias("typo"), "correction")
    return {"freq": freq, "freq_totals": totals, "typos": typos, "vocab": data.select(F.explode("vocab").alias("piece", "id"))}


def read_user_lists(spark: SparkSession, path: str) -> DataFrame:
    """Word, list_type ('user' or 'ignored'), each list under either of two names."""
    data = spark.read.schema("userDictionary array<string>, sc_user_dict array<string>, ignoredWords array<string>, sc_ignored_words array<string>").json(path, multiLine=True)
    user, ignored = F.coalesce("userDictionary", "sc_user_dict", F.array()), F.coalesce("ignoredWords", "sc_ignored_words", F.array())
    pairs = F.concat(F.transform(user, lambda w: F.struct(w.alias("word"), F.lit("user").alias("list_type"))), F.transform(ignored, lambda w: F.struct(w.alias("word"), F.lit("ignored").alias("list_type"))))
    return data.select(F.inline(pairs)).where("word is not null and trim(word) <> ''").distinct()


def write_user_lists(lists: DataFrame, path: str) -> None:
    """The backup file. A user's lists are small: one row."""
    own = lambda kind: F.sort_array(F.collect_set(F.when(F.col("list_type") == kind, F.col("word"))))
    lists.agg(own("user").alias("userDictionary"), own("ignored").alias("ignoredWords")).write.mode("overwrite").json(path)


def canonical_order(words: DataFrame) -> DataFrame:
    return words.select("word").distinct().orderBy(F.lower("word"), "word")


def write_word_list(words: DataFrame, path: str) -> None:
    """Distinct words in canonical order, as text; the sort is by ranges, over all tasks."""
    canonical_order(words).write.mode("overwrite").text(path)


def read_known_typos(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects with a `typo`."""
    return spark.read.schema("typo string").json(path, multiLine=True).select("typo").where("typo is not null")


def write_typo_corpus(corpus: DataFrame, path: str) -> None:
    """Word, label, base, kind, one folder per label."""
    corpus.write.mode("overwrite").partitionBy("label").parquet(path)
