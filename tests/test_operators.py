import itertools
import random

from pyspark.sql import functions as F

from silbenwerk import registry
from silbenwerk.functions import text as T
from silbenwerk.operators import candidates as C
from silbenwerk.operators import context as X
from silbenwerk.operators import detect, results, synth
from silbenwerk.operators import lexicon as L
from silbenwerk.sources import readers

LEX = [("Haus", 1), ("Haustür", 1), ("Tür", 1), ("Schule", 1), ("Hof", 1), ("wohnen", 2), ("Zimmer", 1), ("groß", 2), ("das", 0), ("ich", 0), ("Leitung", 1), ("Rohr", 1), ("komme", 0), ("Raum", 1), ("Zeit", 1), ("gehen", 2)]


def lexicon(spark):
    return spark.createDataFrame(LEX, "word string, flags int")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_readers(spark, tmp_path):
    (tmp_path / "m").write_text("Häuser\nHaus NN,PLU\nx\ngeht\ngehen V,3per\n", encoding="utf-8")
    got = rows(readers.read_morph_dictionary(spark, str(tmp_path / "m")).where("lemma is not null"), "form", "lemma")
    assert got == [("Häuser", "Haus"), ("geht", "gehen")]
    (tmp_path / "w").write_text("# list\nHaus\n\n  Hof \n", encoding="utf-8")
    assert rows(readers.read_word_list(spark, str(tmp_path / "w"), "s"), "word") == [("Haus",), ("Hof",)]
    (tmp_path / "a").write_bytes("3\nTür/EN # x\nHof\n".encode("iso-8859-1"))
    assert rows(readers.read_affix_dictionary(spark, str(tmp_path / "a"), "ISO-8859-1", True), "base", "flags") == [("Hof", ""), ("Tür", "EN")]
    (tmp_path / "f").write_text("1\tdas\t20\n2\tHof\tx\n3\tnur\nbad\n", encoding="utf-8")
    assert rows(readers.read_frequency_list(spark, str(tmp_path / "f")), "word", "freq") == [("Hof", 1), ("das", 20), ("nur", 1)]
    (tmp_path / "u.json").write_text('{"sc_user_dict": ["Ada"], "ignoredWords": ["foo"]}')
    assert rows(readers.read_user_lists(spark, str(tmp_path / "u.json")), "word", "list_type") == [("Ada", "user"), ("foo", "ignored")]
    (tmp_path / "r.xml").write_text('<rules><rule><message>m<suggestion>Haus</suggestion></message><example correction="Hof|Tor">x</example></rule></rules>')
    assert rows(readers.read_rule_suggestions(spark, str(tmp_path / "r.xml")), "word") == [("Haus",), ("Hof",), ("Tor",)]


def test_affixes_and_lexicon(spark):
    df = spark.createDataFrame([("Lehrer", "FS"), ("klein", "A"), ("leise", "A"), ("Hauptstraße", "T"), ("x1", "S")], "base string, flags string")
    got = {r[0] for r in rows(L.expand_affixes(df), "word")}
    assert {"Lehrerin", "Lehrerinnen", "Lehrers", "kleinem", "leiser", "Hauptstr", "Hauptstr."} <= got and "leisee" not in got and "x1" not in got
    frami = spark.createDataFrame([("leitung", "S"), ("Boot", "So"), ("boot", "F"), ("Wirt", "FE")], "base string, flags string")
    assert {r[0] for r in rows(L.expand_affixes(frami, "frami"), "word")} == {"Wirt", "Wirtin", "Wirtinnen", "Wirte"}
    morph = spark.createDataFrame([("Straßen", "Straße", ["NN"]), ("ging", "gehen", ["V", "past"]), ("gehen", "gehen", ["V", "inf"]), ("Der", "der", ["NN"])], "form string, lemma string, tags array<string>")
    extra = spark.createDataFrame([("Der",), ("USA",), ("Neuwort",)], "word string")
    names = spark.createDataFrame([("Ada",), ("gehen",), ("de",)], "word string")
    got = dict(rows(L.build_lexicon(morph, extra, names), "word", "flags"))
    assert got["der"] == 0 and got["USA"] == 0 and got["Neuwort"] == 1 and got["Ada"] == 1 and got["gehen"] == 2 and got["Strassen"] == 1 and got["de"] == 0
    checked = L.verify_lexicon(lexicon(spark), spark.createDataFrame([("Haus", True), ("Hasu", False), ("Hof", False)], "word string, expected boolean"))
    assert rows(checked, "word", "ok") == [("Hasu", True), ("Haus", True), ("Hof", False)]


def test_tokens(spark):
    text = "Das E-Mail-Konto von max@web.de liegt auf www.x.de. Der 3-Zimmer-Plan? »Ja«, sagt foo_bar: Hans' Hof-, und"
    got = [(t["word"], t["is_first"]) for t in T.tokens_in(text)]
    assert got[:2] == [("Das", True), ("E-Mail-Konto", False)]
    assert ("Der", True) in got and ("3-Zimmer-Plan", False) in got and ("Ja", True) in got and ("Hof-", False) in got
    assert not any("web" in w or "foo" in w or "www" in w for w, _ in got)
    assert all(text[t["start"]:t["end"]] == t["word"] for t in T.tokens_in(text))
    docs = spark.createDataFrame([(1, "Ein Satz. Noch einer!\n...\nДа, это так."), (2, None), (3, "")], "doc_id long, text string")
    sents = T.sentences(docs)
    assert rows(sents, "doc_id", "text")[0][1] == " Noch einer!" and sents.where("doc_id > 1").count() == 0
    assert [r.foreign for r in T.is_foreign(sents).orderBy("start").collect()] == [False, False, True]
    local = docs.where("doc_id = 1").select(T.local_context(F.col("text"), F.lit(10), F.lit(14)).alias("c")).first().c
    assert local["text"] == " Noch einer!" and local["text"][local["start"]:local["end"]] == "Noch"


def test_detection(spark):
    lex = lexicon(spark)
    words = spark.createDataFrame([("Haustürhof", False), ("Wohnzimmer", False), ("Schulhof", False), ("Leitungrohr", False), ("Leitungsrohr", False), ("Das", True), ("Das", False), ("HAUS", False), ("Haus-Tür", False), ("Haus-Tyr", False), ("Hof's", False), ("Haus-", False), ("Hasu", False), ("usw", False), ("a1b", False)], "word string, is_first boolean")
    got = {(r.word, r.is_first): r.correct for r in detect.verdicts(words, lex).collect()}
    wrong = {k for k, v in got.items() if not v}
    assert wrong == {("Leitungrohr", False), ("Das", False), ("Haus-Tyr", False), ("Hasu", False)}
    freq = spark.createDataFrame([("das", 9, True, False)], "word string, n long, has_lower boolean, has_title boolean")
    caps = dict(rows(detect.must_be_capitalized(spark.createDataFrame([("haus",), ("gehen",), ("das",), ("schulhof",)], "word string"), lex, freq), "word", "must_cap"))
    assert caps == {"haus": True, "gehen": False, "das": False, "schulhof": True}


def test_fuzzy_join_equals_brute_force(spark):
    words = ["".join(p) for n in (1, 2, 3, 4) for p in itertools.product("abc", repeat=n)][::3] + ["Abca", "bAca"]
    lex = ["".join(p) for n in (2, 3, 5) for p in itertools.product("abc", repeat=n)][::5]
    from tests.test_scalars import osa

    blind = lambda w, c: min(osa(w[0].lower() + w[1:], c), osa(w[0].upper() + w[1:], c))
    for d in (1, 2, 3):
        want = {(w, c) for w in words for c in lex if blind(w, c) <= d}
        got = C.fuzzy_join(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(c,) for c in lex], "word string"), d)
        assert {(r.word, r.cand) for r in got.collect()} == want


def test_fuzzy_join_finds_swaps_across_halves(spark):
    from silbenwerk.functions.scalars import restricted

    draw = random.Random(3)
    words, lex = {"", "ß", "Äab"}, set()
    for _ in range(200):
        w = "".join(draw.choice("abcÄäß") for _ in range(draw.randint(1, 9)))
        words.add(w)
        other = list(w)
        for _ in range(draw.randint(1, 3)):
            i = draw.randrange(len(other) + 1)
            other[i:i + 2] = draw.choice([other[i:i + 2][::-1], other[i + 1:i + 2], ["x", *other[i:i + 2]], ["y"]])
        lex.add("".join(other))
    lex = sorted(lex - {""})
    pairs = list(itertools.product(sorted(words), lex))
    distance = restricted([w for w, _ in pairs], [c for _, c in pairs], blind_first=True)
    for d in (1, 2, 3):
        got = C.fuzzy_join(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(c,) for c in lex], "word string"), d)
        want = sorted((w, c, int(x)) for (w, c), x in zip(pairs, distance) if x <= d)
        assert rows(got, "word", "cand", "distance") == want


def test_pairs_by_bits_equal_the_table():
    from silbenwerk.functions.near import distances, near_pairs
    from silbenwerk.functions.scalars import restricted

    draw = random.Random(5)
    made = lambda k: ["".join(draw.choice("aAbeEßsSäÄİi") for _ in range(draw.randint(0, 9))) for _ in range(k)]
    long_ = [w * 16 for w in made(9)]
    a, b = list(dict.fromkeys(made(150) + long_)), list(dict.fromkeys(made(200) + [w[:-1] + "ab" for w in long_]))
    x, y = [w for w in a for _ in b], b * len(a)
    for blind in (False, True):
        assert (distances(x, y, blind) == restricted(x, y, blind)).all()
    table = distances(x, y, True).reshape(len(a), len(b))
    for d in (1, 2, 3):
        got = [(int(i), int(j), int(k)) for part in near_pairs(a, b, d) for i, j, k in zip(*part)]
        assert sorted(got) == [(i, j, int(table[i, j])) for i in range(len(a)) for j in range(len(b)) if table[i, j] <= d]


def test_fuzzy_join_makes_no_rows_of_common_halves(spark):
    """Words that share a half made a joined row for each pair; now only pairs within the distance leave a task."""
    draw = random.Random(7)
    words, lex = ([half + "".join(draw.choice("bdfgklmnprst") for _ in range(5)) for _ in range(400)] for half in ("unter", "unter"))
    got = C.fuzzy_join(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(c,) for c in lex], "word string"), 2, 3)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    from silbenwerk.functions.scalars import restricted

    pairs = sorted({(w, c) for w in words for c in lex})
    near = sorted((w, int(x), c) for (w, c), x in zip(pairs, restricted([w for w, _ in pairs], [c for _, c in pairs], True)) if x <= 2)
    want = [(w, c, x) for _, group in itertools.groupby(near, lambda r: r[0]) for w, x, c in list(group)[:3]]
    assert rows(got, "word", "cand", "distance") == sorted(want)


def test_fuzzy_join_in_parts_of_the_lexicon(spark, monkeypatch):
    words = spark.createDataFrame([("HAUS",), ("haus",), ("Huas",), (None,), ("",)], "word string")
    lex = spark.createDataFrame([(c,) for c in ("Haus", "haus", "Maus", "aus", "Hauses", "HAUS", None)], "word string")
    whole = [rows(C.fuzzy_join(words, lex, 2, 3), "word", "cand", "distance"), rows(C._searched(words.where("word <> ''"), lex, 2), "word", "cand", "cost")]
    monkeypatch.setattr(C, "MOST_MEANT", 2)
    assert [rows(C.fuzzy_join(words, lex, 2, 3), "word", "cand", "distance"), rows(C._searched(words.where("word <> ''"), lex, 2), "word", "cand", "cost")] == whole
    assert ("HAUS", "HAUS", 0.0) in whole[1] and ("HAUS", "Haus", 0.0) in whole[1]


SHARP = [("ẞlich", 1), ("SSlich", 1), ("ẞahne", 1), ("SSahne", 1), ("Haus", 1), ("SSeite", 1), ("ẞbahn", 1), ("Bach", 1)]


def test_case_candidates_with_a_capital_sharp_s(spark):
    lex = spark.createDataFrame(SHARP, "word string, flags int")
    assert rows(C.case_candidates(spark.createDataFrame([("ßlich", False)], "word string, is_first boolean"), lex), "cand") == [("ẞlich",)]


def test_umlaut_forms_with_a_capital_sharp_s(spark):
    lex = spark.createDataFrame(SHARP, "word string, flags int")
    assert rows(C.umlaut_candidates(spark.createDataFrame([("ssahne", False)], "word string, is_first boolean"), lex)[0], "cand") == [("ẞahne",)]


def test_compounds_with_a_capital_sharp_s(spark):
    lex = spark.createDataFrame(SHARP, "word string, flags int")
    assert rows(detect.valid_compounds(spark.createDataFrame([("Hausßeite",), ("Hausßbahn",)], "word string"), lex), "word") == [("Hausßbahn",)]


def test_verdicts_with_a_capital_sharp_s(spark):
    lex = spark.createDataFrame(SHARP, "word string, flags int")
    got = detect.verdicts(spark.createDataFrame([("Hausßeite", True), ("Hausßbahn", True)], "word string, is_first boolean"), lex)
    assert rows(got, "word", "correct") == [("Hausßbahn", True), ("Hausßeite", False)]


def test_capitalized_with_a_capital_sharp_s(spark):
    lex = spark.createDataFrame(SHARP[1:], "word string, flags int")
    freq = spark.createDataFrame([], "word string, n long, has_lower boolean, has_title boolean")
    got = detect.must_be_capitalized(spark.createDataFrame([("ßlich",), ("ßahne",)], "word string"), lex, freq)
    assert rows(got, "word", "must_cap") == [("ßahne", True), ("ßlich", False)]


def test_only_rewritten_forms_of_use_are_kept(spark):
    words = spark.createDataFrame([("Fater", False), ("ssahne", False), ("thee", True)], "word string, is_first boolean")
    lex = spark.createDataFrame([("Vater",), ("SSahne",)], "word string")
    corrections, listed = (spark.createDataFrame([(w,)], f"{c} string") for w, c in (("Tee", "cand"), ("fATER", "word")))
    got = C._forms_of_use(words, lex, corrections, listed)
    assert rows(got.where("form not like 'ß%'"), "word", "form") == [("Fater", "vater"), ("thee", "tee")]
    assert ("ssahne", "ßahne") in rows(got, "word", "form")  # SSahne is its capitalized form


def test_candidates_and_ranks(spark):
    from silbenwerk.operators import ranking as R

    lex = lexicon(spark)
    freq = spark.createDataFrame([(w.lower(), 10, w.islower(), not w.islower()) for w, _ in LEX], "word string, n long, has_lower boolean, has_title boolean")
    words = spark.createDataFrame([("Huas", False), ("kome", False), ("Zeitrraum", False), ("ic", False), ("tür", False)], "word string, is_first boolean")
    typos = spark.createDataFrame([("huas", "Haus")], "typo string, correction string")
    found = C.collect_candidates(words, lex, freq, typos)
    cost = {(r.word, r.cand): r.cost for r in found.collect()}
    assert cost["Huas", "Haus"] == 0.05 and cost["kome", "komme"] == 1.0 and cost["tür", "Tür"] == 0.2 and ("ic", "ich") in cost
    best = R.suggest(words.withColumn("noun_signal", F.lit(False)), found, lex, freq)
    top = {r.word: r.suggestion for r in best.where("rank = 1").collect()}
    assert top["Huas"] == "Haus" and top["kome"] == "komme" and top["ic"] == "ich" and top["tür"] == "Tür"


def test_noun_signal(spark):
    cases = [("mit haus", 4, True), ("um zu gehen", 6, False), ("zu hause", 3, True), ("am besten", 3, False), ("am abend", 3, True), ("das große haus", 10, True), ("ich habe gern haus", 14, False), ("", 0, False), (None, 1, False), ("mit", -1, False), ("mit gutem essen", 10, True), ("von kleinen haus", 12, True), ("von kleinen leben", 12, False), ("er geht", 3, False)]
    df = spark.createDataFrame(cases, "c string, s int, want boolean").withColumn("got", X.noun_signal(F.col("c"), F.col("s")))
    assert [r.c for r in df.collect() if r.got != r.want] == []


def test_fusion(spark):
    df = spark.createDataFrame([(1, "lernen", 0.58, -2.13183, -6.7420), (1, "leben", 0.38, -4.87211, -2.8542), (1, "lern", 0.7, -1.23275, -15.2794), (2, "a", 0.5, -1.0, None), (2, "b", 0.4, -2.0, None)], "occ_id int, word string, edit_score double, log_posterior double, log_score double").withColumn("from_user", F.lit(False))
    got = X.fuse_scores(df).orderBy("occ_id", "rank").collect()
    assert [r.word for r in got] == ["lernen", "leben", "lern", "a", "b"]
    assert [round(r.family_score, 5) for r in got[:3]] == [-4.49153, -5.87108, -6.58054]


def test_results(spark):
    docs = spark.createDataFrame([(1, "Das Huas und der Hoff"), (2, "gut")], "doc_id long, text string")
    errs = spark.createDataFrame([(1, 4, 8, "Huas", "Haus"), (1, 6, 10, "as u", "x"), (1, 17, 21, "Hoff", "Hof")], "doc_id long, start int, end int, word string, suggestion string").withColumn("kind", F.lit("spelling"))
    assert dict(rows(results.apply_corrections(docs, errs), "doc_id", "text")) == {1: "Das Haus und der Hof", 2: "gut"}
    new = spark.createDataFrame([(1, "Das Huas und auch der Hoff")], "doc_id long, text string")
    assert rows(results.carry_errors(docs, new, errs.where("word <> 'as u'")), "start", "word") == [(4, "Huas"), (22, "Hoff")]
    lists = spark.createDataFrame([("Ada", "user"), ("Bob", "user")], "word string, list_type string")
    changes = spark.createDataFrame([(1, "add", "ada, Cleo; cleo."), (2, "remove", "BOB"), (3, "ignore", "foo")], "seq long, action string, text string")
    assert rows(results.update_user_lists(lists, changes), "list_type", "word") == [("ignored", "foo"), ("user", "Ada"), ("user", "Cleo")]


def test_typos(spark):
    words = spark.createDataFrame([("Haus",), ("der",), ("komme",), ("Schiff",), ("Wasser",), ("Zimmer",)], "word string")
    one, two = synth.mutate(words), synth.mutate(words)
    assert rows(one, "word", "typo") == rows(two, "word", "typo") and all(w != t for w, t in rows(one, "word", "typo"))
    assert dict(rows(one, "word", "typo"))["der"] == "derx"
    hits = synth.suggestion_hit_rate(spark.createDataFrame([("a", 1), ("a", 7), ("b", None)], "kind string, rank int"), 5)
    assert {r.kind: (r.typos, r.hits) for r in hits.collect()} == {"a": (2, 1), "b": (1, 0), None: (3, 1)}


def test_wordpieces_and_masks(spark):
    vocab = spark.createDataFrame([("Haus", 1), ("##tür", 2), ("[UNK]", 0), ("##t", 3)], "piece string, id int")
    got = dict(rows(X.wordpiece_encode(spark.createDataFrame([("Haustür",), ("Hof",)], "word string"), vocab), "word", "pieces"))
    assert got == {"Haustür": [1, 2], "Hof": [0]}
    occ = spark.createDataFrame([(1, list(range(400)), list(range(400, 900)), 2)], "occ_id int, pieces_before array<int>, pieces_after array<int>, n int")
    r = X.masked_inputs(occ, 103).first()
    assert len(r.input) == 510 and [r.input[i] for i in r.mask_at] == [103, 103]


def test_protected_ranges_of_long_pages(spark, tmp_path):
    pages = [(1, "http://a.de/x", "Wort " * 30_000 + "siehe www.beispiel.de/ende und #marke"), (2, "http://b.de", "kurz an x@y.de"), (3, "http://c.de", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = rows(registry.queries()["t03_protected_ranges"](spark, str(tmp_path)), "page_id", "start", "end")
    texts = {k: " ".join(x for x in (url, html) if x is not None) for k, url, html in pages}
    assert found == sorted((k, a, b) for k, t in texts.items() for a, b in T.ranges_in(t))
    named = [texts[k][a:b] for k, a, b in found if a > 100_000]
    assert "www.beispiel.de/ende" in named and "#marke" in named


def test_hit_rate_of_all_lengths(spark, tmp_path):
    words = ["in", "Hof", "Haus", "Zimmer", "Geschwindigkeitsbegrenzung"]
    spark.createDataFrame([(i, " ".join(words) + ".", "de") for i in range(4)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    lex = registry.lexicon(spark, str(tmp_path))
    made = [r for r in synth.mutate(lex).collect() if r.typo not in {w.word for w in lex.collect()}]
    found = {r.kind: r for r in registry.queries()["b05_suggestion_hit_rate"](spark, str(tmp_path)).collect()}
    assert {r.word for r in made} == set(words) and found["short"].typos == 2
    assert found[None].typos == len(made) and 0 < found[None].hits <= len(made)
