from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silbenwerk import constants as K
from silbenwerk.functions import scalars as S
from silbenwerk.functions.distance import weighted_pairs
from silbenwerk.operators.candidates import rewrites_of


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.text("abcä", max_size=6), st.text("abcä", max_size=6)), min_size=1, max_size=8))
def test_restricted_distance(pairs):
    got = S.restricted([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [osa(a, b) for a, b in pairs]


def test_weighted_distance():
    near = lambda a, b: round(float(weighted_pairs([a], [b])[0]), 6)
    assert near("haus", "haus") == 0
    assert near("kome", "komme") == 0.35  # a doubled letter is missing
    assert near("zeitrraum", "zeitraum") == 0.35
    assert near("filosofie", "philosophie") == 0.96
    assert near("fater", "vater") == 0.10
    assert near("hunt", "hund") == 0.20  # hardened at the end
    assert near("lehnrer", "lehrer") == 1.0
    assert near("hasu", "haus") == 0.45
    assert near("gescihtsausdruck", "gesichtsausdruck") == 0.45
    assert near("a", "abcdef") == 999
    assert near("arbeitamt", "arbeitsamt") == 1.0
    assert near("leitungrohr", "leitungsrohr") == 0.45


def plain_weighted(a, b):
    """M2 word by word, from the ends backwards, straight from the rules."""
    from functools import cache

    place = {ch: (x0 + i, y) for y, (row, x0) in enumerate(K.KEY_ROWS) for i, ch in enumerate(row)}

    def key(x, y):
        if x not in place or y not in place:
            return 1.0
        far = ((place[x][0] - place[y][0]) ** 2 + (place[x][1] - place[y][1]) ** 2) ** 0.5
        return 0.35 if far <= 1.15 else 0.65 if far <= 1.55 else 1.0

    def doubled(w, i):
        return w[i] in (w[i - 1:i] or "-", w[i + 1:i + 2] or "-")

    def silent(w, i):
        return w[i] == "h" and 0 < i < len(w) - 1 and w[i - 1] in "aeiouäöü"

    def link(j):
        head, rest = b[:j], len(b) - j - 1
        derived = head.endswith(("heit", "keit", "schaft", "tät", "ling", "ion", "ung")) and not head.endswith(("sprung", "schwung", "dung"))
        return b[j] == "s" and j >= 3 and rest >= 3 and (head in K.LINK_S_STEMS or derived)

    @cache
    def rest(i, j):
        if i == len(a) and j == len(b):
            return 0.0
        ways = []
        if i < len(a):
            ways.append(rest(i + 1, j) + (0.35 if doubled(a, i) else 0.65 if silent(a, i) else 1.0))
        if j < len(b):
            ways.append(rest(i, j + 1) + (0.35 if doubled(b, j) else 0.45 if link(j) else 0.28 if silent(b, j) else 0.30 if b[j - 1:j + 2] == "hen" and j else 1.0))
        if i < len(a) and j < len(b):
            hard = {a[i], b[j]} in ({"b", "p"}, {"d", "t"}, {"g", "k"}) and a[i + 1:] == b[j + 1:] and a[i + 1:] in ("", "s", "e", "en", "er", "es")
            ways.append(rest(i + 1, j + 1) + (0.0 if a[i] == b[j] else 0.20 if hard else key(a[i], b[j])))
            if a[i + 1:i + 2] == b[j] and b[j + 1:j + 2] == a[i]:
                ways.append(rest(i + 2, j + 2) + 0.45)
            ways += [rest(i + len(x), j + len(y)) + cost for x, y, cost in K.REWRITES if a[i:].startswith(x) and b[j:].startswith(y)]
        return min(ways)

    return 999.0 if abs(len(a) - len(b)) > 3 else rest(0, 0)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.text("aehnstdvfiuckzßöl", max_size=7), st.text("aehnstdvfiuckzßöl", max_size=7)), min_size=1, max_size=12), st.sampled_from(["", "amt", "freiheit", "sprung", "beruf"]))
def test_weighted_distance_equals_plain(pairs, stem):
    pairs = [(stem + a, stem + b) for a, b in pairs]
    got = weighted_pairs([a for a, _ in pairs], [b for _, b in pairs])
    assert all(abs(g - plain_weighted(a, b)) < 1e-9 for g, (a, b) in zip(got, pairs))


def test_keys(spark):
    rows = spark.createDataFrame([("v", "b", 0.35), ("g", "z", 0.65), ("a", "p", 1.0), ("é", "e", 1.0), ("ü", "Ü", 0.35)], "a string, b string, want double")
    got = [r.got for r in rows.select(S.keyboard_distance(F.col("a"), F.col("b")).alias("got")).collect()]
    assert got[:4] == [0.35, 0.65, 1.0, 1.0]


def test_phonetics_and_case(spark):
    words = [("Müller", "657"), ("Wikipedia", "3412"), ("Xaver", "4837"), ("Phonetik", "3624"), ("", "")]
    df = spark.createDataFrame(words, "w string, code string").withColumn("got", S.cologne_phonetic(F.col("w")))
    assert all(r.got == r.code for r in df.collect())
    rows = spark.createDataFrame([("wort", "WELT", False, "WORT"), ("wort", "Welt", True, "Wort"), ("wort", "welt", False, "wort")], "c string, o string, f boolean, want string")
    assert all(r.want == r.got for r in rows.withColumn("got", S.match_case(F.col("c"), F.col("o"), F.col("f"))).collect())
    rows = spark.createDataFrame([("zeitrraum", "zeitraum", True), ("hafen", "haffen", False)], "q string, c string, want boolean")
    assert all(r.want == r.got for r in rows.withColumn("got", S.key_bounce(F.col("q"), F.col("c"))).collect())
    rows = spark.createDataFrame([("kanal", "canal", 4.7), ("foto", "photo", 0.0), ("haus", "hand", 2.0), ("", "a", 0.0), ("vater", "fater", 4.7)], "q string, c string, want double")
    assert all(abs(r.want - r.got) < 1e-9 for r in rows.withColumn("got", S.common_prefix_len(F.col("q"), F.col("c"))).collect())


def test_rewrites():
    forms = dict(rewrites_of("Filosofie"))
    assert round(forms["philosophie"], 6) == 0.96 and "filosofie" not in forms
    assert len(rewrites_of("eieieieieieieieieieiei")) <= 96


def test_tokens_come_in_bounded_batches():
    import pyarrow as pa

    from silbenwerk.functions import text as T

    texts = ["Das Haus. Es steht. " * 2000, None, "Ein Wort"]
    batch = pa.RecordBatch.from_arrays([pa.array([3, 5, 7], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = list(T.token_batches(iter([batch]), 1000))
    assert max(b.num_rows for b in out) == 1000 and len(out) == 9
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(i, *t.values()) for i, text in zip((3, 5, 7), texts) for t in T.tokens_in(text or "")]


def test_known_typos_are_read_whole_from_many_tasks(spark):
    from silbenwerk import registry

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = registry.queries()["s09_known_typos"](spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == registry.lexicon(spark, "/root/testdata/sf0.001").count()


def test_common_prefix_by_halving_steps(spark):
    pairs = [("haus", "hausboot"), ("haus", "haus"), ("", "x"), ("äöü", "äöx"), ("kaffee", "caffee"), ("x", "y"), ("a" * 700 + "b", "a" * 700 + "c"), ("a" * 1100 + "b", "a" * 1100 + "c"), ("unterweg", "unterwelt")]
    df = S.with_common_prefix(spark.createDataFrame(pairs, "a string, b string"), "a", "b", "p")
    got = {(r.a, r.b): (r.p, r.m7) for r in df.withColumn("m7", S.common_prefix_len(F.col("a"), F.col("b"), F.col("p"))).collect()}
    import os

    plain = {(a, b): len(os.path.commonprefix([a, b])) for a, b in pairs}
    assert got == {k: (v, 5.7 if k == ("kaffee", "caffee") else float(v)) for k, v in plain.items()}
