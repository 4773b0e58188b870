import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from silbenwerk.functions import text as T
from silbenwerk.operators import context as X
from silbenwerk.plans.check import check_text

PIECES = ["[UNK]", "[MASK]", "[CLS]", "[SEP]", "das", "dass", "##s", "er", "haus", "##en", "kommt", "we", "##iß", ",", "ich"]


def test_contexts_and_signals_in_place_equal_the_column_functions(spark):
    rng = random.Random(7)
    pool = ["der", "Die", "zu", "am", "großen", "haus", "(alten", "gehen.", "sehr\n", "  ", "\t", "Eine,", "schönsten", "über-", "123", "…", "\r\n", "dem«", "ge-kauft", "x" * 90]
    texts = ["", " ", "Er wohnt in der\nhaus weiter", "der haus", " der haus", "((((der haus", "ab" * 60 + "der haus"] + [" ".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(120)] + ["".join(rng.choice(pool) for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(10_000, None)], "doc_id long, text string")
    got = T.tokens_in_place(docs).join(docs, "doc_id")
    old = T.local_context(F.col("text"), F.col("start"), F.col("end"))
    same = got.select("text", "start", (X.noun_signal_before(F.col("before")) == X.noun_signal(F.col("text"), F.col("start"))).alias("signal"), (F.col("context") == old).alias("context")).collect()
    assert len(same) > 1000 and [r for r in same if not (r.signal and r.context)] == []
    columns = ["doc_id", "tok_ix", "word", "start", "end", "is_first"]
    assert sorted(T.tokens_in_place(docs, contexts=False, most=3).select(columns).collect()) == sorted(T.tokenize(docs).select(columns).collect())


def test_one_long_text_takes_linear_time():
    took = []
    for n in (20_000, 80_000):
        text = "Der alte mann ging am besten zu hause vorbei, " * (n // 20) + "a,b," * n
        began = time.time()
        T.words_before(text, [t["start"] for t in T.tokens_in(text)])
        took.append(time.time() - began)
    assert took[1] < 10 * took[0]


class Fixed:
    """Logits from a rule: piece p at mask j has logit sin(p + j + sum of the unmasked pieces)."""

    calls: list = []

    def __call__(self, inputs, mask_at):
        assert len({len(p) for p in mask_at}) == 1
        return np.stack([[[math.sin(p + j + sum(x for x in own if x != 1)) for p in range(len(PIECES))] for j in range(len(at))] for own, at in zip(inputs, mask_at)])


def test_piece_scores_equal_plain_loops(spark):
    vocab = spark.createDataFrame([(p, i) for i, p in enumerate(PIECES)], "piece string, id int")
    table = {p: i for i, p in enumerate(PIECES)}
    context = "ich weiß, das er " + "haus " * 400 + "kommt"
    rows = [(context, 10, 13, c) for c in ("das", "dass", "hausen", "xyz", "", None)] + [("das", 0, 3, "das"), ("das", 0, 3, "das"), ("das haus", 4, 8, "hausen"), ("das", -1, 3, "das")]
    got = X.score_pieces(spark.createDataFrame(rows, "context string, start int, end int, candidate string"), vocab, Fixed, "fixed", window=50, batch=2).collect()

    def pieces(text):
        return [p for w in X.BASIC.findall(text) for p in X.pieces_of(w, table, 0)]

    def want(context, start, end, candidate):
        own = pieces(candidate or "")
        if not own or start < 0:
            return None
        before, after, n = pieces(context[:start]), pieces(context[end:]), len(own)
        body, first = before + [1] * n + after, len(before)
        if len(body) > 50:
            low = max(0, min(first - min(first, (50 - n) // 2), len(body) - 50))
            body, first = body[low:low + 50], first - low
        body, first = [2, *body, 3], first + 1
        logits = Fixed()([np.array(body)], np.array([[first + j for j in range(n)]]))[0]
        return sum(logits[j][p] - math.log(sum(math.exp(x) for x in logits[j])) for j, p in enumerate(own)) / n

    assert len(got) == len(rows)
    for r in got:
        w = want(r.context, r.start, r.end, r.candidate)
        assert (r.log_score is None) == (w is None) and (w is None or abs(r.log_score - w) < 1e-9)


def test_pieces_beyond_the_model_have_no_score():
    assert X.mean_log_probabilities(np.zeros((1, 4)), [[9], [3]]) == [None, -math.log(4)]


TOKENS = "doc_id long, word string, start int, end int, is_first boolean, context string, at int"


def test_context_errors_by_hand(spark):
    """Each word has the alternatives of its group; what is said of them decides."""
    cases = {"ahead": ({"das": -4.0, "dass": -2.0}, True), "close": ({"das": -3.0, "dass": -2.0}, False), "unscored": ({"dass": -9.0}, True), "none": ({}, False), "best": ({"das": -1.0, "dass": -5.0}, False), "edge": ({"das": -3.75, "dass": -2.0}, True)}
    tokens = spark.createDataFrame([(i, "das", 4, 7, False, f"{c}, das er", len(c) + 2) for i, c in enumerate(cases)] + [(90, "das", 4, 7, False, "ahead, das er", 7), (91, "das", 4, 7, False, "ahead, das er", 7)], TOKENS)
    said = [(f"{c}, das er", len(c) + 2, w, s) for c, (scores, _) in cases.items() for w, s in scores.items()]
    scorer = spark.createDataFrame(said, "context string, start int, candidate string, log_score double")
    groups = spark.createDataFrame([("das", "das"), ("das", "dass")], "word string, alternative string")
    out = lambda i: spark.createDataFrame([(i, 4)], "doc_id long, start int")
    got = X.check_context(tokens, groups, scorer, out(90), out(91)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.suggestion, r.kind) for r in got) == [(i, 4, 7, "dass", "context") for i, (_, hit) in enumerate(cases.values()) if hit]
    # a word that is not in its own group is no error
    assert X.check_context(tokens, groups.where("alternative = 'dass'"), scorer).count() == 0
    assert X.check_context(tokens.limit(0), groups, scorer).count() == 0


def test_check_text_gives_spelling_and_context_errors(spark):
    words = "ich weiß das dass er kommt wohnt in der haus Haus weiter garten Garten nicht".split()
    lexicon = spark.createDataFrame([(w, 1 if w[0].isupper() else 0) for w in words], "word string, flags int")
    freq = spark.createDataFrame([(w.lower(), 5, w[0].islower(), w[0].isupper()) for w in words], "word string, n long, has_lower boolean, has_title boolean")
    docs = spark.createDataFrame([(1, "Ich weiß, das er kommt. Er wohnt in der\ngarden weiter."), (2, "das das"), (3, ""), (4, None), (5, "Ich weiß das nicht")], "doc_id long, text string")

    def prefers(batch):
        return [-1.0 if c.lower() == ("dass" if "," in x else "das") else -5.0 for c, x in zip(batch["candidate"], batch["context"])]

    import pandas as pd
    listed = spark.createDataFrame([("nichts",)], "word string")
    got = check_text(docs, lexicon, freq, listed=listed, scorer=lambda b: pd.Series(prefers(b))).collect()
    assert {(r.doc_id, r.word, r.kind, r.suggestion) for r in got} == {(1, "das", "context", "dass"), (1, "garden", "spelling", "Garten")}
    plain = check_text(docs, lexicon, freq, listed=listed).collect()
    assert {(r.doc_id, r.word, r.start, r.suggestion) for r in plain} == {(1, "garden", 40, "Garten")}
    # accepted words have no context errors
    assert {r.kind for r in check_text(docs, lexicon, freq, listed=spark.createDataFrame([("Das",)], "word string"), check_case=False, scorer=lambda b: pd.Series(prefers(b))).collect()} == {"spelling"}


def test_many_sentences_and_many_edits_in_one_text(spark):
    from silbenwerk.operators.results import apply_corrections

    text = "Ein Satz hier. Это другое. Ja!\n" * 40_000
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "ab ab", "z")], "doc_id long, text string, `a.b` string")
    assert T.sentences(docs).where("doc_id = 1").count() == 120_000
    tokens = T.german_tokens(docs).where("doc_id = 1")
    assert tokens.count() == 160_000 and tokens.where("word rlike '[а-я]'").count() == 0
    edits = tokens.where("word = 'Satz'").select("doc_id", "start", "end", F.lit("Wort").alias("suggestion"))
    more = spark.createDataFrame([(3, 3, 5, "c"), (3, 0, 2, "d"), (3, 1, 4, "never"), (3, 0, None, "n"), (3, 0, 2, None), (9, 0, 1, "q")], "doc_id long, start int, end int, suggestion string")
    out = {r.doc_id: r for r in apply_corrections(docs, edits.union(more)).collect()}
    assert out[1].text == text.replace("Satz", "Wort") and out[2].text is None and out[3].text == "d c" and out[3]["a.b"] == "z"


def test_what_announces_a_noun(spark):
    single = "aus bei mit nach von im am beim zum zur ohne durch für vor in auf unter über trotz das der die ein eine kein mein dein ihr unser sein euer".split()
    yes = [(f"{w} vergnügen", len(w) + 1) for w in single] + [(f"{a} {b} {c}", len(a) + len(b) + 2) for a, b, c in (
        ("aus", "purem", "zufal"), ("mit", "warmer", "supe"), ("nach", "kurzem", "schlf"), ("ohne", "langen", "umwg"), ("für", "neues", "glük"), ("das", "alte", "haus"), ("ein", "leises", "lachn"))] + [("zu besuch", 3), ("Wir gehen zu tisch", 13)]
    no = [("gut für gekauft haltn", 16), ("als gekocht meldn", 12), ("nur für immer gehn", 14), ("etwas für heute gebn", 16), ("nichts für zusammen spieln", 20), ("sie sollen gehn", 11), ("wir dürfen lesn", 11), ("ich muss gehn", 9), ("er war krnk", 7), ("sie können sehn", 11),
          ("anfang", 0), ("", 0), (None, 5), ("aus vergnügen", -1), ("am schnellsten", 3), ("um zu gehn", 6)]
    cases = spark.createDataFrame([(c, s, True) for c, s in yes] + [(c, s, False) for c, s in no], "c string, s int, want boolean")
    assert [(r.c, r.s) for r in cases.withColumn("got", X.noun_signal(F.col("c"), F.col("s"))).collect() if r.got != r.want] == []


def test_context_and_spelling_weigh_together(spark):
    rows = [(i, w, e, lp, s, False) for i, scores in enumerate(((-16.0, -7.0, -14.0, -3.0, None), (-16.0, -7.0, -14.0, -3.0, -20.0), (None,) * 5)) for (w, e, lp), s in zip((("spiel", 0.71, -1.2), ("spielen", 0.58, -2.1), ("Spielen", 0.56, -2.3), ("spülen", 0.38, -4.9), ("Zaun", 0.1, -27.0)), scores) if not (i == 0 and w == "Zaun")]
    out = X.fuse_scores(spark.createDataFrame(rows, "occ_id int, word string, edit_score double, log_posterior double, log_score double, from_user boolean")).collect()
    order = {i: [r.word for r in sorted((r for r in out if r.occ_id == i), key=lambda r: r["rank"])] for i in range(3)}
    assert order[0][0] == "spielen" and order[1][0] == "spielen" and order[2][0] == "spiel"
    assert sum(w.lower() == "spielen" for w in order[0]) == 1


def test_late_context_errors_are_found_too(spark):
    import pandas as pd
    docs = spark.createDataFrame([(1, "Das ist fein. " * 20 + "Ihr seit da.")], "doc_id long, text string")
    tokens = T.tokens_in_place(docs).select("doc_id", "word", "start", "end", "is_first", F.col("context.text").alias("context"), F.col("context.start").alias("at"))

    def scorer(batch):
        return pd.Series([0.0 if (c == "seid" if "Ihr seit" in x else c.lower() == "das") else -5.0 for c, x in zip(batch["candidate"], batch["context"])])

    got = X.check_context(tokens, X.confusion_group(tokens), scorer).collect()
    assert [(r.word, r.start, r.suggestion) for r in got] == [("seit", 284, "seid")]


def test_suggestions_follow_the_scorer_where_there_is_context(spark):
    from silbenwerk.operators import candidates as C
    from silbenwerk.operators import ranking as R

    names = ["haus", "maus", "raus", "aus"]
    lexicon = spark.createDataFrame([(w, 0) for w in names], "word string, flags int")
    freq = spark.createDataFrame([(w, 5, True, False) for w in names], "word string, n long, has_lower boolean, has_title boolean")
    contexts = {"a": ("das gaus da", 4), "b": ("eine gaus hier", 5), "c": ("gaus", 0), "d": ("12 gaus 3", 3), "e": ("sehr gaus", 5)}
    rows = spark.createDataFrame([(i, "gaus", False, False, c, at, at + 4) for i, (c, at) in contexts.items()], "occ_id string, word string, is_first boolean, noun_signal boolean, context string, start int, end int")
    found = C.collect_candidates(rows, lexicon, freq)
    plain = [r.suggestion for r in R.suggest(rows, found, lexicon, freq).where("not noun_signal").orderBy("rank").collect()]
    assert sorted(plain[:4]) == sorted(names)
    liked = {"a": plain[-1], "b": plain[1]}
    said = [(contexts[i][0], contexts[i][1], w, 0.0 if w == liked[i] else -30.0) for i in liked for w in plain] + [(contexts["c"][0], 0, plain[-1], 0.0)]
    scorer = spark.createDataFrame(said, "context string, start int, candidate string, log_score double")
    got = R.suggest_in_context(rows, found, lexicon, freq, scorer).collect()
    order = {i: [r.suggestion for r in sorted((r for r in got if r.occ_id == i), key=lambda r: r["rank"])] for i in contexts}
    assert order["a"][0] == liked["a"] and order["b"][0] == liked["b"]
    # no letters around the word, or no score at all: the order by spelling stays
    assert order["c"] == order["d"] == order["e"] == plain
