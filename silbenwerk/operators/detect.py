"""Finding misspelled words (D1-D11). Verdicts are formed on distinct words and joined back."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalars import capitalized, inflection_variants, is_caps, is_title, lower_first, title, upper_first, weighted_distance
from ..sharing import cut


def is_ignored(w: Column) -> Column:
    """What is no word to check."""
    return ((F.length(w) <= 1) | w.rlike(r"^[\d.,%€$+\-]+$") | w.rlike(r"(?i)^(https?://|www\.)") | w.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
            | w.rlike(r"[\\/_#@<>{}\d]") | F.lower(w).isin(K.ABBREVIATIONS))


def matches_list(words: DataFrame, listed: DataFrame) -> DataFrame:
    """Words that are on a list in any case."""
    return words.join(listed.select(F.lower("word").alias("key")).distinct(), F.lower(words["word"]) == F.col("key"), "left_semi")


def probe_forms(w: Column, is_first: Column) -> Column:
    """D3: the spellings under which a word may stand in the lexicon."""
    return F.array_distinct(F.array_compact(F.array(w, F.when(is_first & is_title(w), lower_first(w)), F.when(is_caps(w), title(w)), F.when(is_caps(w), F.lower(w)))))


def lookup_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """D3: words(word, is_first) that the lexicon accepts."""
    forms = words.select("word", "is_first", F.explode(probe_forms(F.col("word"), F.col("is_first"))).alias("form"))
    return forms.join(lexicon.select(F.col("word").alias("form")).distinct(), "form", "left_semi").select("word", "is_first").distinct()


def compound_prefixes(lexicon: DataFrame) -> DataFrame:
    """Lower-cased strings that may begin a compound: flagged words, nouns without e, stems of verbs."""
    w, f = F.col("word"), F.col("flags")
    whole = lexicon.where((f > 0) & ((w == F.lower(w)) | (w == title(w)))).select(F.lower(w).alias("prefix"))
    elided = lexicon.where((f.bitwiseAND(K.NOUN) != 0) & (w == title(w)) & w.rlike("[^e]e$")).select(F.lower(F.regexp_replace(w, "e$", "")).alias("prefix"))
    verbs = lexicon.where((f.bitwiseAND(K.LOWER_COMPOUND) != 0) & (w == F.lower(w)))
    stems = verbs.where(w.rlike("en$")).select(F.regexp_replace(w, "en$", "").alias("prefix")).union(verbs.where(w.rlike("n$")).select(F.regexp_replace(w, "n$", "").alias("prefix")))
    return whole.union(elided).union(stems).where(F.length("prefix") >= 3).distinct()


def valid_compounds(words: DataFrame, lexicon: DataFrame, levels: int = 5) -> DataFrame:
    """words(word) that are compounds.

    One round for each level: all splits of the words still open, an equi-join to the prefixes,
    and one to the heads; what is left of a word after a prefix and a link is the next round's word.
    The frontier holds each (word, rest) once.
    """
    prefixes = cut(compound_prefixes(lexicon))
    flags = lexicon.select(F.col("word").alias("head"), "flags")
    w = F.col("word")
    frontier = words.select("word").distinct().where(F.length(w) >= 6).select("word", w.alias("rest"), is_title(w).alias("cap"))
    accepted = None
    for _ in range(levels):
        at = F.sequence(F.lit(3), F.length("rest") - 3)
        splits = frontier.select("word", "cap", F.explode(F.transform(at, lambda i: F.struct(F.lower(F.substring("rest", F.lit(1), i.cast("int"))).alias("prefix"), F.substring("rest", (i + 1).cast("int"), F.lit(1000)).alias("tail")))).alias("s")).select("word", "cap", "s.prefix", "s.tail")
        splits = splits.join(prefixes, "prefix", "left_semi")
        derived = F.col("prefix").rlike(K.DERIVED) & ~F.col("prefix").rlike(K.NOT_DERIVED)
        links = F.array(*[F.when((F.lit(x) != "") & F.startswith("tail", F.lit(x)), F.substring("tail", len(x) + 1, 1000)) for x in K.LINKS if x], F.when(~derived, F.col("tail")))
        rests = splits.select("word", "cap", F.explode(F.array_compact(links)).alias("rest")).where(F.length("rest") >= 3)
        rests = rests.select("word", "cap", F.when(F.col("cap"), capitalized(F.col("rest"))).otherwise(F.lower("rest")).alias("rest")).distinct()
        rests = cut(rests.join(flags, F.col("rest") == F.col("head"), "left").withColumn("hit", F.coalesce(F.col("flags").bitwiseAND(F.when(F.col("cap"), K.NOUN).otherwise(K.LOWER_COMPOUND)) != 0, F.lit(False))).select("word", "cap", "rest", "hit"))
        new = rests.where("hit").select("word").distinct()
        accepted = cut(new if accepted is None else accepted.union(new).distinct())
        frontier = cut(rests.where(F.length("rest") >= 6).select("word", "rest", "cap").join(accepted, "word", "left_anti"))
        if frontier.isEmpty():
            break
    return accepted


def valid_apostrophe(words: DataFrame, lexicon: DataFrame, compounds: DataFrame | None = None) -> DataFrame:
    """Words whose part before 's or 'n is a word."""
    based = words.select("word", "is_first", F.regexp_extract("word", "(?i)^(.{2,})'(?:s|n)$", 1).alias("base")).where("base <> ''")
    good = lookup_words(based.select(F.col("base").alias("word"), "is_first"), lexicon)
    if compounds is not None:
        good = good.unionByName(based.select(F.col("base").alias("word"), "is_first").join(compounds, "word", "left_semi")).distinct()
    return based.join(good.withColumnRenamed("word", "base"), ["base", "is_first"], "left_semi").select("word", "is_first")


def other_case(w: Column) -> Column:
    first = F.substring(w, 1, 1)
    return F.when(first == F.upper(first), lower_first(w)).otherwise(upper_first(w))


def valid_hyphenated(words: DataFrame, lexicon: DataFrame, compounds: DataFrame | None = None, check_case: bool = True) -> DataFrame:
    """Hyphenated words of which every part is valid."""
    w = F.col("word")
    rows = words.where(F.contains(w, F.lit("-")) & ~w.rlike("^-|-$|--"))
    parts = rows.select("word", "is_first", F.posexplode(F.split(w, "-")).alias("i", "part")).withColumn("start", (F.col("i") == 0) & F.col("is_first"))
    plain = F.col("part").rlike("^[0-9]+[A-Za-z]*$") | is_ignored(F.col("part"))
    probe = parts.select(F.col("part").alias("word"), F.col("start").alias("is_first")).distinct()
    good = lookup_words(probe, lexicon)
    if not check_case:
        rest = F.substring("word", 2, 1000)
        turned = probe.where(rest == F.lower(rest)).select("word", "is_first", other_case(F.col("word")).alias("turn"))
        ok = lookup_words(turned.select(F.col("turn").alias("word"), "is_first"), lexicon).withColumnRenamed("word", "turn")
        good = good.union(turned.join(ok, ["turn", "is_first"], "left_semi").select("word", "is_first")).distinct()
    good = good.select(F.col("word").alias("part"), F.col("is_first").alias("start"), F.lit(True).alias("known"))
    flagged = lexicon.where("flags > 0").select(F.col("word").alias("low")).distinct().withColumn("flagged", F.lit(True))
    joined = parts.join(good, ["part", "start"], "left").withColumn("low", F.lower("part")).join(flagged, "low", "left")
    ok = plain | F.coalesce("known", F.lit(False))
    ok = ok | ((F.col("i") == 0) & (F.substring("word", 1, 1) == F.upper(F.substring("word", 1, 1))) & F.coalesce("flagged", F.lit(False)))
    if compounds is not None:
        joined = joined.join(compounds.select(F.col("word").alias("part")).withColumn("compound", F.lit(True)), "part", "left")
        ok = ok | F.coalesce("compound", F.lit(False))
    return joined.groupBy("word", "is_first").agg(F.bool_and(ok).alias("ok")).where("ok").select("word", "is_first")


def valid_trailing_hyphen(words: DataFrame, lexicon: DataFrame, compounds: DataFrame | None = None) -> DataFrame:
    """Words that end in a hyphen whose base is valid, also in lower case."""
    rows = words.where(F.endswith("word", F.lit("-")) & (F.length("word") >= 2)).withColumn("base", F.expr("substring(word, 1, length(word) - 1)"))
    direct = lookup_words(rows.select(F.col("base").alias("word"), "is_first"), lexicon).withColumnRenamed("word", "base")
    out = rows.join(direct, ["base", "is_first"], "left_semi").select("word", "is_first")
    lower = rows.join(lexicon.select(F.col("word").alias("low")), F.lower("base") == F.col("low"), "left_semi").select("word", "is_first")
    out = out.union(lower)
    if compounds is not None:
        out = out.union(rows.join(compounds.select(F.col("word").alias("base")), "base", "left_semi").select("word", "is_first"))
    return out.distinct()


def known_nonword_typos(words: DataFrame, typos: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Known typos that the lexicon does not accept."""
    listed = words.join(typos.select("typo"), F.lower("word") == F.col("typo"), "left_semi")
    return listed.join(lookup_words(listed, lexicon), ["word", "is_first"], "left_anti")


def suspicious_compounds(words: DataFrame, lexicon: DataFrame, freq: DataFrame) -> DataFrame:
    """Compounds that are more likely a misspelling.

    Glued function words before a word or compound, or a lexicon word within one edit or rewrite and
    a small weighted distance; where corpus evidence is asked for, an attested compound will do too.
    Neighbours come from deletion keys of words and lexicon, not from probing all edits.
    """
    from .candidates import fuzzy_join, rewrite_forms

    w = F.col("word")
    rows = words.select("word").distinct().where(F.length(w).between(6, 48)).withColumn("low", F.lower(w))
    attested = freq.select(F.col("word").alias("low"), "n", "has_title")
    rows = rows.join(attested, "low", "left").where((F.coalesce("n", F.lit(0)) < 3) & ~(w.rlike(r"^\p{Lu}") & F.coalesce("has_title", F.lit(False)))).select("word", "low")
    glued = rows.select("word", F.explode(F.array_compact(F.array(*[F.when(F.startswith("low", F.lit(g)) & (F.length("low") - len(g) >= 3), F.substring("low", len(g) + 1, 1000)) for g in K.GLUED]))).alias("tail"))
    tails = lexicon.select("word").union(valid_compounds(glued.select(F.col("tail").alias("word")), lexicon)).select(F.col("word").alias("tail")).distinct()
    glued = glued.join(tails, "tail", "left_semi").select("word")
    lex = lexicon.select("word").where((w == F.lower(w)) | (w == title(w))).select(F.lower(w).alias("form")).distinct()
    known = freq.select(F.col("word").alias("cand"), F.col("n").alias("cn"))
    near = fuzzy_join(rows.select(F.col("low").alias("word")), lex.select(F.col("form").alias("word")), 1).select(F.col("word").alias("low"), "cand", F.lit(None).cast("boolean").alias("free"))
    # a form that a rewrite makes is judged as such, also where a single edit makes it
    every = cut(rewrite_forms(rows.select(F.col("low").alias("word"))).select(F.col("word").alias("low"), F.col("form").alias("cand"), ((F.col("cost") <= 0.55) & (F.length("form") != F.length("word"))).alias("free")))
    forms = cut(every.where(~inflection_variants(F.col("low"), F.col("cand"))).join(known, "cand", "left").withColumn("cn", F.coalesce("cn", F.lit(0))).where(F.col("free") | (F.col("cn") >= 2)))
    # attested compounds will do where corpus evidence is asked for
    bound = forms.where(~F.col("free")).select("cand").distinct()
    built = valid_compounds(bound.select(F.explode(F.array("cand", title(F.col("cand")))).alias("word")), lexicon).select(F.lower("word").alias("form")).distinct()
    listed = forms.join(lex.withColumnRenamed("form", "cand"), "cand", "left_semi").union(forms.where(~F.col("free")).join(built.withColumnRenamed("form", "cand"), "cand", "left_semi")).distinct()
    single = near.where(~inflection_variants(F.col("low"), F.col("cand"))).join(every.select("low", "cand"), ["low", "cand"], "left_anti").select("low", "cand", F.lit(True).alias("free"), F.lit(0).cast("long").alias("cn"))
    pairs = listed.select("low", "cand", "free", "cn").union(single)
    limit = F.when(~F.col("free") & (F.col("cn") >= 30), 1.20).otherwise(1.05)
    hit = pairs.where(weighted_distance(F.col("low"), F.col("cand")) <= limit).select("low").distinct()
    return glued.union(rows.join(hit, "low", "left_semi").select("word")).distinct()


def verdicts(words: DataFrame, lexicon: DataFrame, freq: DataFrame | None = None, typos: DataFrame | None = None, listed: DataFrame | None = None, check_case: bool = True) -> DataFrame:
    """words(word, is_first), distinct, with `correct`."""
    words = words.select("word", "is_first").distinct()
    w = F.col("word")
    ignored = words.where(is_ignored(w))
    if listed is not None:
        ignored = ignored.union(matches_list(words, listed)).distinct()
    open_ = words.join(ignored, ["word", "is_first"], "left_anti")
    direct = lookup_words(open_, lexicon)
    missed = cut(open_.join(direct, ["word", "is_first"], "left_anti"))
    left = missed if typos is None else cut(missed.join(known_nonword_typos(missed, typos, lexicon), ["word", "is_first"], "left_anti"))
    bases = missed.select(F.explode(F.array_compact(F.array(w, F.when(F.col("is_first"), lower_first(w)), F.when(F.lit(not check_case), other_case(w)), F.regexp_extract(w, "(?i)^(.{2,})'(?:s|n)$", 1), F.regexp_extract(w, "^(.+)-$", 1)))).alias("word"))
    parts = missed.where(F.contains(w, F.lit("-"))).select(F.explode(F.split(w, "-")).alias("word"))
    compounds = valid_compounds(bases.union(parts).where("word <> ''"), lexicon)
    good = valid_apostrophe(left, lexicon, compounds).union(valid_hyphenated(left.where(~F.endswith(w, F.lit("-"))), lexicon, compounds, check_case)).union(valid_trailing_hyphen(left, lexicon, compounds))
    whole = left.where(~F.endswith(w, F.lit("-")))
    by_compound = whole.join(compounds, "word", "left_semi").union(whole.where("is_first").withColumn("low", lower_first(w)).join(compounds.select(F.col("word").alias("low")), "low", "left_semi").select("word", "is_first")).distinct()
    if freq is not None:
        by_compound = by_compound.join(suspicious_compounds(by_compound, lexicon, freq), "word", "left_anti")
    good = good.union(by_compound)
    if not check_case:
        rest = F.substring("word", 2, 1000)
        # also of known typos, but not of words that end in a hyphen
        turned = missed.where((rest == F.lower(rest)) & ~F.endswith(w, F.lit("-"))).withColumn("turn", other_case(w))
        ok = lookup_words(turned.select(F.col("turn").alias("word"), "is_first"), lexicon).select(F.col("word").alias("turn"), "is_first")
        good = good.union(turned.join(ok, ["turn", "is_first"], "left_semi").select("word", "is_first")).union(turned.join(compounds.select(F.col("word").alias("turn")), "turn", "left_semi").select("word", "is_first"))
    correct = ignored.union(direct).union(good).distinct().withColumn("correct", F.lit(True))
    return words.join(correct, ["word", "is_first"], "left").withColumn("correct", F.coalesce("correct", F.lit(False)))


def must_be_capitalized(words: DataFrame, lexicon: DataFrame, freq: DataFrame, compounds: bool = True) -> DataFrame:
    """Distinct words with `must_cap`."""
    rows = words.select("word").distinct().withColumn("low", F.lower("word")).withColumn("tit", capitalized(F.col("word")))
    lex = lexicon.groupBy("word").agg(F.bit_or("flags").alias("flags"))
    rows = rows.join(lex.select(F.col("word").alias("tit"), F.col("flags").alias("tf")), "tit", "left").join(lex.select(F.col("word").alias("low"), F.col("flags").alias("lf")), "low", "left")
    rows = rows.join(freq.select(F.col("word").alias("low"), "has_lower"), "low", "left")
    never = F.col("low").isin(K.NEVER_NOUNS) | (F.col("lf").isNotNull() & F.coalesce("has_lower", F.lit(False)))
    noun = F.coalesce(F.col("tf").bitwiseAND(K.NOUN) != 0, F.lit(False)) & F.coalesce(F.col("lf").bitwiseAND(K.LOWER_COMPOUND) == 0, F.lit(True))
    only = F.col("tf").isNotNull() & F.col("lf").isNull()
    if compounds:
        found = valid_compounds(rows.select(F.explode(F.array("tit", "low")).alias("word")), lexicon)
        rows = rows.join(found.select(F.col("word").alias("tit"), F.lit(True).alias("tc")), "tit", "left").join(found.select(F.col("word").alias("low"), F.lit(True).alias("lc")), "low", "left")
        only = only | (F.coalesce("tc", F.lit(False)) & ~F.coalesce("lc", F.lit(False)))
    return rows.select("word", F.when(never, False).otherwise(noun | only).alias("must_cap"))
