"""Generating corrections (K1-K12): fuzzy joins and expansions over distinct words.

Every generator returns word, cand, cost. `collect_candidates` folds them in order: some keep the
least cost, some overwrite, some only fill gaps.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.near import near_pairs
from ..functions.scalars import capital_first, is_caps, is_title, lower_first, osa_distance, title, upper_first
from ..sharing import cut
from .context import viable_head
from .detect import compound_prefixes, lookup_words, valid_compounds


MOST_TYPED, MOST_MEANT, ROWS = 1 << 14, 1 << 18, 1 << 16


def _nearest_in(batches: Iterator[pa.RecordBatch], d: int, n: int | None, forms: bool) -> Iterator[pa.RecordBatch]:
    """One block: typed rows (word, typed) and meant rows (cand), with the pairs within d.

    forms: each typed form has its pairs; otherwise a word has the least distance over its forms.
    """
    held = pa.Table.from_batches(batches)
    rows, meant = held.filter(pc.is_valid(held["typed"])), held.filter(pc.is_valid(held["cand"]))["cand"].combine_chunks()
    words, number, of_word = rows["word"].combine_chunks(), {}, []
    for t in rows["typed"].to_pylist():
        of_word.append(number.setdefault(t, len(number)))
    typed, names = list(number), words.to_pylist()
    times = Counter(names)
    cands = meant.to_pylist()
    rank, sizes = np.empty(len(cands), np.int64), np.array([len(c) for c in cands], np.int64)
    rank[sorted(range(len(cands)), key=cands.__getitem__)] = np.arange(len(cands))
    lengths = np.array([len(t) for t in typed], np.int64)
    order = np.argsort(of_word, kind="stable")  # the rows of each typed form lie together
    first, many = np.searchsorted(np.array(of_word, np.int64)[order], np.arange(len(typed) + 1)), np.array([times[w] > 1 for w in names], bool)
    typed_of, least, ready, size = pa.array(typed, pa.string()), {}, [], 0

    def batch() -> pa.RecordBatch:
        at, of, c, k = (np.concatenate(x) for x in zip(*ready))
        columns = {"word": words.take(pa.array(at))} | ({"typed": typed_of.take(pa.array(of))} if forms else {}) | {"cand": meant.take(pa.array(c)), "distance": pa.array(k, pa.int32())}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    for r, c, k in near_pairs(typed, cands, d):
        if n is not None:
            by = np.lexsort((rank[c], np.abs(sizes[c] - lengths[r]), k, r))
            r, c, k = r[by], c[by], k[by]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            r, c, k = r[place < n], c[place < n], k[place < n]
        each = first[r + 1] - first[r]
        at = order[np.repeat(first[r] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        r, c, k = np.repeat(r, each), np.repeat(c, each), np.repeat(k, each)
        if not forms and many[at].any():
            for x in np.flatnonzero(many[at]).tolist():
                key = names[at[x]], int(c[x])
                if key not in least or k[x] < least[key][1]:
                    least[key] = int(at[x]), int(k[x])
            one = ~many[at]
            at, r, c, k = at[one], r[one], c[one], k[one]
        ready.append((at, r, c, k))
        size += len(at)
        if size >= ROWS:
            yield batch()
            ready, size = [], 0
    if least:
        at = np.array([a for a, _ in least.values()], np.int64)
        ready.append((at, np.zeros(len(at), np.int64), np.array([c for _, c in least], np.int64), np.array([k for _, k in least.values()], np.int64)))
    if ready:
        yield batch()


def _nearest(rows: DataFrame, cands: DataFrame, d: int, n: int | None = None) -> DataFrame:
    """rows(word, typed), cands(cand) -> word, cand, distance: the least over a word's typed forms, of the n nearest of each form.

    Typed rows are dealt by word into blocks of bounded size, and each block meets the lexicon, or each of its
    parts if it is large; only the pairs that are found leave a block.
    """
    if not 1 <= d <= 3:
        raise ValueError("d is 1, 2 or 3")
    rows, cands = cut(rows.where("typed is not null").distinct()), cut(cands.where("cand is not null").distinct())
    count, size = rows.count(), cands.count()
    across = max(-(-count // MOST_TYPED), min(6 * rows.sparkSession.sparkContext.defaultParallelism, -(-count // 512)), 1)
    down = max(-(-size // MOST_MEANT), 1)
    dealt = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    none = F.lit(None).cast("string")
    left = rows.select("word", "typed", none.alias("cand"), dealt("word", across).alias("x"), each(down).alias("y"))
    right = cands.select(none.alias("word"), none.alias("typed"), "cand", each(across).alias("x"), dealt("cand", down).alias("y"))
    blocks = left.union(right).select("word", "typed", "cand", (F.col("x") * down + F.col("y")).alias("block")).repartition(across * down, "block")
    forms = down > 1 and n is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _nearest_in(batches, d, n, forms)

    found = blocks.groupBy("block").applyInArrow(run, "word string, " + "typed string, " * forms + "cand string, distance int")
    if not forms:
        return found
    rank = F.row_number().over(Window.partitionBy("word", "typed").orderBy("distance", F.abs(F.length("cand") - F.length("typed")), "cand"))
    return found.withColumn("r", rank).where(F.col("r") <= n).groupBy("word", "cand").agg(F.min("distance").alias("distance"))


def fuzzy_join(words: DataFrame, lexicon: DataFrame, d: int, n: int | None = None) -> DataFrame:
    """K1: word, cand, distance: lexicon words within restricted edit distance d (1 to 3), first letter in any case.

    Blocks of words are compared with the lexicon where they lie (see `near_pairs`): bags of letters thin the pairs
    before the exact test. With n, the n nearest of each word, by distance, lengths and code points.
    """
    return _nearest(words.select("word", lower_first(F.col("word")).alias("typed")), lexicon.select(F.col("word").alias("cand")), d, n)


def search_forms(words: DataFrame) -> DataFrame:
    """K2: word, form."""
    w = F.col("word")
    forms = F.when(is_caps(w) & (F.length(w) > 1), F.array(w, title(w), F.lower(w))).when(F.length(w) <= 20, F.array(w, F.lower(w), title(w))).otherwise(F.array(w))
    return words.select("word").distinct().select("word", F.explode(F.array_distinct(forms)).alias("form"))


def _rewritten_once(form: str, cost: float) -> Iterator[tuple[str, float]]:
    for typed, meant, extra in K.REWRITES:
        k = form.find(typed)
        while k >= 0:
            yield form[:k] + meant + form[k + len(typed):], cost + extra
            k = form.find(typed, k + 1)


def rewrites_of(word: str, most: int = 96) -> list[tuple[str, float]]:
    """K3: forms that one or two rewrites make of the lower-cased word, with their least cost.

    One rewrite comes before two, then the order of rules, then of places. The word and its forms are
    `most` at the most: the forms offered first stay, and what is offered after the last new one does
    not make any of them cheaper.
    """
    start = word.lower()
    once = list(_rewritten_once(start, 0.0))
    least: dict[str, float] = {}
    for form, cost in chain(once, (o for made, paid in once for o in _rewritten_once(made, paid))):
        if form != start:
            least[form] = min(cost, least.get(form, cost))
            if len(least) == most - 1:
                break
    return list(least.items())


def _rewrites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            words = batch.column(0).slice(lo, 1024)
            made = [rewrites_of(w or "") for w in words.to_pylist()]
            at = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
            yield pa.RecordBatch.from_arrays([words.take(at), pa.array([f for m in made for f, _ in m], pa.string()), pa.array([round(c, 6) for m in made for _, c in m], pa.float64())], ["word", "form", "cost"])


def rewrite_forms(words: DataFrame) -> DataFrame:
    """K3, the forms: word, form, cost; for words of 3 to 24 letters."""
    return words.select("word").distinct().where(F.length("word").between(3, 24)).mapInArrow(_rewrites, "word string, form string, cost double")


def _in_lexicon(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    either = forms.select("word", "cost", F.explode(F.array("form", upper_first(F.col("form")))).alias("cand"))
    return either.join(lexicon.select(F.col("word").alias("cand")).distinct(), "cand", "left_semi").groupBy("word", "cand").agg(F.min("cost").alias("cost"))


def rewrite_candidates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """K3: rewritten forms, as they are and capitalized, that the lexicon has."""
    return _in_lexicon(rewrite_forms(words), lexicon)


def known_corrections(words: DataFrame, typos: DataFrame, lexicon: DataFrame) -> DataFrame:
    """K4: words(word, is_first) that the lexicon does not accept, with the listed correction."""
    from ..functions.scalars import match_case

    open_ = words.join(lookup_words(words, lexicon), ["word", "is_first"], "left_anti")
    hit = open_.join(typos, F.lower("word") == F.col("typo"))
    return hit.select("word", "is_first", match_case(F.col("correction"), F.col("word"), F.col("is_first")).alias("cand"), F.lit(0.05).alias("cost"))


def synthesize_compounds(words: DataFrame, lexicon: DataFrame, freq: DataFrame, most: int = 5) -> DataFrame:
    """K5: long words with one wrong part: the head or the beginning is looked up within distance 2 and joined anew.

    most: the caller's limit. Beginnings are tried only for words with fewer results than that, from
    the longest beginning down, until three results are found.
    """
    w = F.col("word")
    rows = words.select("word").distinct().where(F.length(w) >= 12).withColumn("cap", is_title(w))
    flags = cut(lexicon.groupBy("word").agg(F.bit_or("flags").alias("flags")))
    at = F.sequence(F.lit(4), F.length(w) - 4)
    splits = cut(rows.select("word", "cap", F.explode(at).alias("i")).select("word", "cap", "i", F.substring(w, F.lit(1), F.col("i")).alias("left"), F.substring(w, F.col("i") + 1, F.lit(1000)).alias("right")))
    nouns = flags.where(F.col("flags").bitwiseAND(K.NOUN) != 0).select("word")
    prefixes = compound_prefixes(flags).withColumnRenamed("prefix", "low")
    flagged = flags.where("flags > 0").select(F.lower("word").alias("low")).distinct()
    known = cut(freq.select(F.col("word").alias("key"), "n"))
    link = F.explode(F.array(*map(F.lit, K.LINKS))).alias("link")
    # wrong head
    good_left = splits.withColumn("low", F.lower("left")).join(prefixes, "low", "left_semi")
    derived = F.col("low").rlike(K.DERIVED) & ~F.col("low").rlike(K.NOT_DERIVED)
    heads = good_left.select("word", "cap", "low", "right", link).where(F.expr("startswith(right, link)") & ~(F.col("link").isin("s", "es") & F.col("low").rlike("[sßzx]$")) & ~(derived & (F.col("link") == "")))
    heads = cut(heads.withColumn("part", title(F.expr("substring(right, length(link) + 1, 1000)"))).where(F.length("part").between(4, 20)))
    found = cut(fuzzy_join(heads.select(F.col("part").alias("word")), flags, 2, 8).join(nouns.select(F.col("word").alias("cand")), "cand", "left_semi"))
    able = viable_head(found.select(F.col("cand").alias("word")), flags, freq, valid_compounds(found.select(F.explode(F.array("cand", F.lower("cand"))).alias("word")), flags))
    found = found.join(able.withColumnRenamed("word", "cand"), "cand", "left_semi").withColumn("low_cand", F.lower("cand")).join(known, F.col("low_cand") == F.col("key"), "left")
    bonus = F.least(F.length("cand") * 0.06, F.lit(0.6)) + F.when(F.col("low_cand").rlike(K.GOOD_HEADS), 0.35).otherwise(0.0) + F.when(F.coalesce("n", F.lit(0)) > 0, 0.4).otherwise(0.0)
    one = heads.join(found.select(F.col("word").alias("part"), "low_cand", bonus.alias("bonus")), "part")
    one = one.select("word", F.concat(F.when(F.col("cap"), title(F.col("low"))).otherwise(F.col("low")), "link", "low_cand").alias("cand"), "bonus", F.lit(0).alias("i"))
    # wrong beginning
    ends = cut(splits.withColumn("tit", title(F.col("right"))))
    noun_ends = ends.join(nouns.select(F.col("word").alias("tit")), "tit", "left_semi").select(F.col("tit").alias("word")).distinct()
    good = viable_head(noun_ends, flags, freq, valid_compounds(noun_ends.select(F.explode(F.array("word", F.lower("word"))).alias("word")), flags))
    good = good.union(valid_compounds(ends.where(F.length("right") >= 6).select(F.col("tit").alias("word")), flags)).distinct()
    good_right = cut(ends.join(good.select(F.col("word").alias("tit")), "tit", "left_semi"))
    starts = good_right.select("word", "cap", "i", "left", F.lower("right").alias("right"), link).where(F.expr("endswith(left, link)"))
    starts = cut(starts.withColumn("part", title(F.expr("substring(left, 1, length(left) - length(link))"))).where(F.length("part").between(3, 18)))
    begun = fuzzy_join(starts.select(F.col("part").alias("word")), flags, 2, 6).withColumn("low", F.lower("cand")).join(flagged, "low", "left_semi").join(known, F.col("low") == F.col("key"), "left")
    bonus = F.least(F.length("part") * 0.05, F.lit(0.4)) + F.when(F.coalesce("n", F.lit(0)) > 0, 0.4).otherwise(0.0)
    two = starts.join(begun.select(F.col("word").alias("part"), "low", "n"), "part")
    two = two.select("word", F.concat(F.when(F.col("cap"), title(F.col("low"))).otherwise(F.col("low")), "link", "right").alias("cand"), bonus.alias("bonus"), "i")
    both = one.withColumn("way", F.lit(1)).union(two.withColumn("way", F.lit(2))).groupBy("word", "cand", "way", "i").agg(F.max("bonus").alias("bonus"))
    both = cut(both.withColumn("dist", osa_distance(F.lower("word"), F.lower("cand"))).where("dist <= 2"))
    whole = valid_compounds(both.select(F.col("cand").alias("word")), flags).union(flags.select("word")).select(F.col("word").alias("cand")).distinct()
    both = cut(both.join(whole, "cand", "left_semi"))
    # how far beginnings are tried
    begins = both.where("way = 2").groupBy("word", "cand").agg(F.max("i").alias("i"))
    headed = both.where("way = 1").select("word", "cand").distinct()
    stop = good_right.groupBy("word").agg(F.max("i").alias("longest")).join(headed.groupBy("word").agg(F.count("*").alias("heads")), "word", "left").withColumn("heads", F.coalesce("heads", F.lit(0)))
    fresh = begins.join(headed, ["word", "cand"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("i"), "cand")))
    third = fresh.join(stop, "word").where(F.col("r") == 3 - F.col("heads")).select("word", F.col("i").alias("third"))
    stop = stop.join(third, "word", "left").select("word", "heads", F.when(F.col("heads") >= 3, F.col("longest")).otherwise(F.coalesce("third", F.lit(0))).alias("stop"))
    both = both.join(stop, "word", "left").where((F.col("way") == 1) | ((F.col("heads") < most) & (F.col("i") >= F.col("stop"))))
    both = both.join(known.select(F.col("key").alias("kc"), F.col("n").alias("kn")), F.lower("cand") == F.col("kc"), "left")
    both = both.withColumn("cost", F.col("dist") - F.col("bonus") - F.when(F.coalesce("kn", F.lit(0)) > 0, 0.5).otherwise(0.0))
    own = Window.partitionBy("word")
    both = both.groupBy("word", "cand").agg(F.min("cost").alias("cost"), F.min("dist").alias("dist"))
    both = both.withColumn("least", F.min("dist").over(own)).where((F.col("least") > 1) | (F.col("dist") <= 1)).withColumn("best", F.min("cost").over(own)).where(F.col("cost") - F.col("best") <= 0.35)
    return both.withColumn("r", F.row_number().over(own.orderBy("cost", "cand"))).where(F.col("r") <= most).select("word", "cand", F.round("cost", 6).alias("cost"))


def user_list_candidates(words: DataFrame, listed: DataFrame) -> DataFrame:
    """K7: words of the user's list: same word in another case 0.1, one edit 0.35, two 1.10.

    The fuzzy join stands for comparing every word with the whole list.
    """
    w = F.col("word")
    entries = listed.select(F.col("word").alias("entry"), F.lower("word").alias("low")).distinct()
    near = fuzzy_join(words.select(F.lower(w).alias("word")), entries.select(F.col("low").alias("word")), 2).withColumnRenamed("word", "q").withColumnRenamed("cand", "low")
    rows = words.select("word").distinct().withColumn("q", F.lower(w)).join(near, "q").join(entries, "low")
    lifted = F.when((F.col("distance") > 0) & is_title(w) & (F.substring("entry", 1, 1) == F.lower(F.substring("entry", 1, 1))), upper_first(F.col("entry"))).otherwise(F.col("entry"))
    cost = F.when(F.col("distance") == 0, 0.1).when(F.col("distance") == 1, 0.35).otherwise(1.10)
    return rows.select("word", lifted.alias("cand"), cost.alias("cost")).groupBy("word", "cand").agg(F.min("cost").alias("cost"))


def valid_forms(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """pairs(word, is_first, cand, ...) whose candidate the lexicon accepts."""
    ok = lookup_words(pairs.select(F.col("cand").alias("word"), "is_first"), lexicon).withColumnRenamed("word", "cand")
    return pairs.join(ok, ["cand", "is_first"], "left_semi")


def case_candidates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """K8"""
    w = F.col("word")
    forms = words.select("word", "is_first", F.explode(F.array_distinct(F.array(capital_first(w), F.lower(w)))).alias("cand"))
    return valid_forms(forms, lexicon).select("word", "is_first", "cand", F.lit(0.2).alias("cost"))


def respelled(words: DataFrame) -> DataFrame:
    low = F.lower("word")
    forms = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(a)), F.replace(low, F.lit(a), F.lit(b))) for a, b in K.SPELLINGS]))
    return words.select("word", "is_first", F.explode(forms).alias("rep"))


def umlaut_candidates(words: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K9: (valid respelled forms at 0.4, their neighbours within one edit at distance + 0.4)."""
    reps = respelled(words)
    forms = reps.select("word", "is_first", F.explode(F.array("rep", capital_first(F.col("rep")))).alias("cand"))
    valid = valid_forms(forms, lexicon).select("word", "is_first", "cand", F.lit(0.4).alias("cost")).distinct()
    near = fuzzy_join(reps.select(F.col("rep").alias("word")), lexicon, 1, 15).withColumnRenamed("word", "rep")
    gaps = reps.join(near, "rep").groupBy("word", "is_first", "cand").agg(F.min(F.col("distance") + 0.4).alias("cost"))
    return valid, gaps


def transposition_candidates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words that arise by swapping two neighbours."""
    w = F.col("word")
    rows = words.where(F.length(w) >= 2)
    swaps = F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.concat(F.substring(w, F.lit(1), (i - 1).cast("int")), F.substring(w, (i + 1).cast("int"), F.lit(1)), F.substring(w, i.cast("int"), F.lit(1)), F.substring(w, (i + 2).cast("int"), F.lit(1000))))
    forms = rows.select("word", "is_first", F.explode(F.array_distinct(swaps)).alias("cand"))
    return valid_forms(forms, lexicon).select("word", "is_first", "cand", F.lit(0.5).alias("cost"))


def short_insertions(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Short words with one letter more, in lower and title form."""
    low = F.lower("word")
    rows = words.select("word").distinct().where(F.length("word") <= 4)
    inserted = F.flatten(F.transform(F.sequence(F.lit(0), F.length(low)), lambda i: F.transform(F.array(*map(F.lit, K.LETTERS)), lambda c: F.concat(F.substring(low, F.lit(1), i.cast("int")), c, F.substring(low, (i + 1).cast("int"), F.lit(1000))))))
    forms = rows.select("word", F.explode(F.array_distinct(inserted)).alias("ins")).select("word", F.explode(F.array("ins", capital_first(F.col("ins")))).alias("cand"))
    return forms.join(lexicon.select(F.col("word").alias("cand")).distinct(), "cand", "left_semi").select("word", "cand", F.lit(1.0).alias("cost")).distinct()


def _searched(words: DataFrame, lexicon: DataFrame, d: int) -> DataFrame:
    forms = search_forms(words).select("word", lower_first(F.col("form")).alias("typed"))
    return _nearest(forms, lexicon.select(F.col("word").alias("cand")), d, 120).select("word", "cand", F.col("distance").cast("double").alias("cost"))


def collect_candidates(words: DataFrame, lexicon: DataFrame, freq: DataFrame, typos: DataFrame | None = None, listed: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """words(word, is_first) -> word, is_first, cand, cost, rewritten, known, from_user.

    freq(word, n, has_lower, has_title); limit: how many the caller wants, a bound for K5. rewritten
    and known hold for a candidate in any case; from_user where the user's list made the offer that won.
    """
    words = cut(words.select("word", "is_first").distinct())
    own = ["word", "is_first"]
    keyed = lambda df: words.join(df, "word").select("word", "is_first", "cand", "cost")
    corrections = None if typos is None else cut(known_corrections(words, typos, lexicon))
    forms = cut(_forms_of_use(words, lexicon, corrections, listed))
    steps = [(0, "least", keyed(_searched(words, lexicon, 2))), (1, "least", keyed(_in_lexicon(forms, lexicon)))]
    if corrections is not None:
        steps.append((2, "set", corrections))
    stage = cut(_stack(steps))
    few = cut(_few(words, stage).where(F.length("word") >= 12))
    same_low = forms.select("word", F.col("form").alias("low"))
    if not few.isEmpty():
        made = cut(few.join(synthesize_compounds(few, lexicon, freq, limit), "word").select(*own, "cand", "cost"))
        # compounds need not be in the lexicon: which of them a rewrite makes as well is found for their words alone
        same_low = same_low.union(rewrite_forms(made.select("word")).select("word", F.col("form").alias("low")).join(made.select("word", F.lower("cand").alias("low")), ["word", "low"], "left_semi"))
        stage = cut(stage.union(_stack([(3, "least", made)])))
    # K6: still few: three edits, only what is new
    few = cut(_few(words, stage).where(F.length("word").between(6, 16)))
    later = []
    if not few.isEmpty():
        later.append((4, "gap", few.join(_searched(few, lexicon, 3), "word").select(*own, "cand", "cost")))
    if listed is not None:
        near = cut(keyed(user_list_candidates(words, listed)))
        later += [(5, "set", near.where("cost = 0.1")), (6, "least", near.where("cost > 0.1"))]
    valid, gaps = umlaut_candidates(words, lexicon)
    later += [(7, "set", case_candidates(words, lexicon)), (8, "set", valid), (9, "gap", gaps), (10, "least", transposition_candidates(words, lexicon)), (11, "gap", keyed(short_insertions(words, lexicon)))]
    rows = stage.union(_stack(later))
    # one fold per pair: the last overwriting step, then what is less after it; gaps only where nothing was before
    offers = rows.groupBy(*own, "cand").agg(F.sort_array(F.collect_list(F.struct("step", "how", "cost"))).alias("offers"))

    def fold(acc, x):
        return F.when(acc.isNull() | (x["how"] == "set"), x["cost"]).when(x["how"] == "least", F.least(acc, x["cost"])).otherwise(acc)

    folded = lambda part: F.aggregate(part, F.lit(None).cast("double"), fold)
    before = folded(F.filter("offers", lambda x: x["step"] < 5))
    same = F.exists("offers", lambda x: x["step"] == 5)
    won = F.exists("offers", lambda x: (x["step"] == 6) & (before.isNull() | (x["cost"] < before)))
    out = offers.select(*own, "cand", folded(F.col("offers")).alias("cost"), (same | won).alias("from_user")).withColumn("low", F.lower("cand"))
    out = out.join(same_low.distinct().withColumn("rewritten", F.lit(True)), ["word", "low"], "left")
    if typos is None:
        out = out.withColumn("known", F.lit(False))
    else:
        out = out.join(corrections.select(*own, F.lower("cand").alias("low"), F.lit(True).alias("known")).distinct(), [*own, "low"], "left")
    return out.select(*own, "cand", "cost", F.coalesce("rewritten", F.lit(False)).alias("rewritten"), F.coalesce("known", F.lit(False)).alias("known"), "from_user")


def _forms_of_use(words: DataFrame, lexicon: DataFrame, corrections: DataFrame | None, listed: DataFrame | None) -> DataFrame:
    """Of all rewritten forms those that any case of a word of the lexicon, a correction or an entry of the list may equal."""
    lows = lexicon.select(F.lower("word").alias("form"))
    if corrections is not None:
        lows = lows.union(corrections.select(F.lower("cand")))
    if listed is not None:
        lows = lows.union(listed.select(F.explode(F.array(F.lower("word"), F.lower(upper_first(F.col("word")))))))
    # of a form whose capital is more than a letter or another letter's, the lexicon may have the capitalized form alone
    odd = F.lower(upper_first(F.col("form"))) != F.col("form")
    marked = rewrite_forms(words).join(lows.distinct().withColumn("known", F.lit(True)), "form", "left")
    return marked.where(F.coalesce("known", F.lit(False)) | odd).select("word", "form", "cost")


def _few(words: DataFrame, stage: DataFrame) -> DataFrame:
    """Words with fewer than four candidates so far."""
    own = ["word", "is_first"]
    enough = stage.select(*own, "cand").distinct().groupBy(*own).agg(F.count("*").alias("n")).where("n >= 4")
    return words.join(enough, own, "left_anti")


def _stack(steps: list[tuple[int, str, DataFrame]]) -> DataFrame:
    out = None
    for step, how, df in steps:
        rows = df.select("word", "is_first", "cand", F.col("cost").cast("double").alias("cost"), F.lit(step).alias("step"), F.lit(how).alias("how"))
        out = rows if out is None else out.union(rows)
    return out
