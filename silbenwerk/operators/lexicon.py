"""Building a flagged lexicon from word lists (L1-L16). All of it is built-in DataFrame work."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalars import is_caps, title

# What a word of a list may look like.
PLAIN, APOSTROPHE, EXTENDED = "[A-Za-zÄÖÜäöüß-]", "[A-Za-zÄÖÜäöüß'-]", "[A-Za-zÄÖÜäöüßÀ-ɏ'-]"


def filter_words(df: DataFrame, pattern: str = APOSTROPHE, min_len: int = 2, max_len: int | None = None, inner_hyphen: bool = False) -> DataFrame:
    """L1: words made of the given letters only, of a length, optionally without a hyphen at either end."""
    keep = F.col("word").rlike(f"^{pattern}+$") & (F.length("word") >= min_len)
    if max_len is not None:
        keep = keep & (F.length("word") <= max_len)
    if inner_hyphen:
        keep = keep & ~F.col("word").rlike("^-|-$")
    return df.where(keep)


def _forms(base: Column, rules: Sequence[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(base, *[F.when(condition, F.concat(base, F.lit(ending))) for condition, ending in rules]))


def expand_affixes(df: DataFrame, profile: str = "spelling") -> DataFrame:
    """L2, L3: base, flags -> word, each base with the forms that its flags allow.

    `spelling`: S, E, N, F, adjective endings for A or P, street abbreviations for T.
    `ignore`: S and N. `frami`: S, E, N; F for capitalized bases; entries that are only parts of
    compounds, need an affix or are forbidden (o, h, d) go, and so do lower-case nouns.
    """
    base, has = F.col("base"), lambda *x: F.col("flags").rlike("|".join(x))
    letters = PLAIN if profile != "spelling" else APOSTROPHE
    rows = df.where(base.rlike(f"^{letters}+$") & (F.length(base) >= 2))
    if profile == "ignore":
        forms = _forms(base, [(has("S"), "s"), (has("N"), "n")])
    elif profile == "frami":
        lower = F.substring(base, 1, 1) != F.upper(F.substring(base, 1, 1))
        rows = rows.where(~has("o", "h", "d") & ~(lower & (base.rlike("(?:ung|heit|keit|schaft|tion|tät)$") | has("F"))))
        forms = _forms(base, [(has("S"), "s"), (has("E"), "e"), (has("N"), "n"), (has("F") & ~lower, "in"), (has("F") & ~lower, "innen")])
    else:
        adjective, ends_e = has("A", "P"), F.endswith(base, F.lit("e"))
        rules = [(has("S"), "s"), (has("E"), "e"), (has("N"), "n"), (has("F"), "in"), (has("F"), "innen")]
        rules += [(adjective & ends_e, x) for x in "rsnm"] + [(adjective & ~ends_e, x) for x in ("e", "er", "es", "en", "em")]
        street = F.when(has("T") & F.endswith(base, F.lit("straße")), F.regexp_replace(base, "straße$", "str"))
        forms = F.array_compact(F.concat(_forms(base, rules), F.array(street, F.concat(street, F.lit(".")))))
    return rows.select(F.explode(forms).alias("word")).distinct()


def add_genitive_s(df: DataFrame) -> DataFrame:
    """L4: capitalized words that do not end in s or ß also with s."""
    also = F.when(F.col("word").rlike("^[A-ZÄÖÜ]") & ~F.col("word").rlike("[sß]$"), F.concat("word", F.lit("s")))
    return df.select(F.explode(F.array_compact(F.array("word", also))).alias("word")).distinct()


def add_swiss_variants(df: DataFrame) -> DataFrame:
    """Word, flags; words with ß also with ss, flags combined."""
    swiss = df.where(F.contains("word", F.lit("ß"))).select(F.replace("word", F.lit("ß"), F.lit("ss")).alias("word"), "flags")
    return df.select("word", "flags").unionByName(swiss).groupBy("word").agg(F.bit_or("flags").alias("flags"))


def function_case(word: Column) -> Column:
    return F.when(F.lower(word).isin(K.FUNCTION_WORDS) & (word != F.upper(word)), F.lower(word)).otherwise(word)


def normalize_function_words(df: DataFrame) -> DataFrame:
    """Function words in lower case unless they are all capitals."""
    return df.withColumn("word", function_case(F.col("word")))


def demote_capitalized_function_words(df: DataFrame) -> DataFrame:
    """Only the exact title-case form is lowered; `removed` tells which rows were."""
    removed = F.col("word").isin([w.capitalize() for w in K.FUNCTION_WORDS])
    return df.select(F.when(removed, F.lower("word")).otherwise(F.col("word")).alias("word"), F.when(removed, F.col("word")).alias("removed"))


def apply_canonical_casing(df: DataFrame, brands: DataFrame) -> DataFrame:
    """brands(key, brand): brand spellings by lower-cased key."""
    return df.join(brands, F.lower("word") == F.col("key"), "left").withColumn("word", F.coalesce("brand", "word")).drop("key", "brand")


def filter_frequent(df: DataFrame, known: DataFrame, least: int = 15, min_len: int = 3) -> DataFrame:
    """Frequent words of a list that are not known yet."""
    return filter_words(df.where(F.col("freq") >= least), APOSTROPHE, min_len).select("word").distinct().join(known.select("word"), "word", "left_anti")


def harvest_names(df: DataFrame, col: str = "label") -> DataFrame:
    """Capitalized words of labels, whole or as parts stripped of punctuation."""
    label = F.trim(col)
    parts = F.transform(F.split(label, r"\s+"), lambda p: F.regexp_replace(p, r"^[ ,.;:!?\"'()\[\]{}«»]+|[ ,.;:!?\"'()\[\]{}«»]+$", ""))
    words = df.select(F.explode(F.concat(F.array(label), parts)).alias("word"))
    return words.where(F.col("word").rlike("^[A-ZÄÖÜ][A-Za-zÄÖÜäöüß-]{1,29}$") & ~F.col("word").isin(K.LEGAL_WORDS)).distinct()


def harvest_titles(df: DataFrame, col: str = "title") -> DataFrame:
    """Titles without a colon that are single words, with their genitives."""
    rows = df.select(F.trim(col).alias("word")).where(~F.contains("word", F.lit(":")))
    return add_genitive_s(filter_words(rows, APOSTROPHE, 2))


def flags_from_tags(tags: Column) -> Column:
    """Flag of a morphological reading."""
    verb = F.arrays_overlap(F.slice(tags, 2, 100), F.array(*map(F.lit, ("inf", "ppast", "ppres", "zu"))))
    return F.when(tags[0].isin("NN", "NNP"), K.NOUN).when(tags[0] == "ADJ", K.LOWER_COMPOUND).when((tags[0] == "V") & verb, K.LOWER_COMPOUND).otherwise(0)


def build_lexicon(morph: DataFrame, extra: DataFrame, names: DataFrame) -> DataFrame:
    """Word, flags of forms, lemmas, extra words and names.

    Function words among the extra words are set to 0 whatever they were; names come last and
    never change what is there.
    """
    flag = F.coalesce(flags_from_tags(F.col("tags")), F.lit(0))
    rows = morph.where("form is not null").select(F.col("form").alias("word"), flag.alias("flags")).union(morph.where("lemma is not null").select("lemma", flag))
    extra = extra.where(F.length("word") >= 2).select(function_case(F.col("word")).alias("word"))
    is_function = F.lower("word").isin(K.FUNCTION_WORDS)
    capital = F.col("word").rlike(r"^\p{Lu}") & ~is_caps(F.col("word"))
    zero = extra.where(is_function).select("word").distinct()
    rows = rows.union(extra.where(~is_function).select("word", F.when(capital, K.NOUN).otherwise(0)))
    merged = rows.groupBy("word").agg(F.bit_or("flags").cast("int").alias("flags"))
    merged = merged.join(zero, "word", "left_anti").union(zero.select("word", F.lit(0)))
    merged = add_swiss_variants(merged)
    added = names.select("word", F.when(capital, K.NOUN).otherwise(0).alias("flags")).distinct().join(merged, "word", "left_anti")
    return merged.union(added)


def lexicon_counts(morph: DataFrame, lexicon: DataFrame) -> DataFrame:
    """L12"""
    return morph.agg(F.countDistinct("form").alias("forms"), F.countDistinct("lemma").alias("lemmas")).crossJoin(F.broadcast(lexicon.agg(F.countDistinct("word").alias("vocabulary"))))  # one row each


def merge_sources(sources: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(words(word, source) of the first list that has each, new words per source)."""
    ranked = reduce(DataFrame.unionByName, [s.select("word", "source", F.lit(i).alias("priority")) for i, s in enumerate(sources)])
    merged = ranked.groupBy("word").agg(F.min(F.struct("priority", "source")).alias("first")).select("word", "first.source")
    return merged, merged.groupBy("source").agg(F.count("*").alias("new_words"))


def missing_names(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Single words in the lexicon's letters that it does not have."""
    alphabet = lexicon.select(F.explode(F.split("word", "")).alias("ch")).distinct().agg(F.collect_set("ch").alias("alphabet"))  # bounded by Unicode
    words = filter_words(df, r"[\p{L}'-]", 2, 60).select("word").distinct()
    fits = words.crossJoin(F.broadcast(alphabet)).where(F.forall(F.split("word", ""), lambda c: F.array_contains("alphabet", c))).select("word")
    return fits.join(lexicon, "word", "left_anti")


def verify_lexicon(lexicon: DataFrame, expectations: DataFrame) -> DataFrame:
    """expectations(word, expected) with what is so, and whether it is as expected."""
    have = lexicon.select("word").distinct().withColumn("present", F.lit(True))
    out = expectations.join(have, "word", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    return out.withColumn("ok", F.col("present") == F.col("expected"))


def adjective_like(lexicon: DataFrame) -> DataFrame:
    """Words of which enough inflected forms are in the lexicon, also after dropping e or in -el, -er."""
    w = F.col("word")
    words = lexicon.select("word").where((F.length(w) >= 3) & ~w.rlike("^(?:ein|eine|einer|einem|eines|einen|der|die|das|dem|den|des)$")).distinct()
    stem = F.when(F.endswith(w, F.lit("e")), F.regexp_replace(w, "e$", ""))
    short = F.when(w.rlike("e[lr]$"), F.regexp_replace(w, "e([lr])$", "$1"))
    stems = words.select("word", F.explode(F.array_distinct(F.array_compact(F.array(w, stem, short)))).alias("stem"))
    endings = {"er": ("er", "r"), "es": ("es", "s"), "em": ("em", "m"), "e": ("e",)}
    probes = F.array(*[F.struct(F.lit(kind).alias("kind"), F.concat("stem", F.lit(x)).alias("form")) for kind, xs in endings.items() for x in xs])
    forms = stems.select("word", "stem", F.inline(probes))
    found = forms.join(lexicon.select(F.col("word").alias("form")).distinct(), "form", "left_semi").groupBy("word", "stem").agg(F.collect_set("kind").alias("k"))
    has = lambda x: F.array_contains("k", x)
    good = (has("er") & (has("es") | has("em"))) | (has("es") & has("em"))
    return found.where(good).select("word").union(words.where(w == "hoch")).distinct()
