"""Operators on small tables against brute force, round trips, and the odd cases of the contracts."""
import collections
import hashlib
import math
import os
import struct
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silbenwerk.llm import induced, jaccard_join, media, mixing, nn_descent, pieces, quality, suffix_dedup, token_counts, toxicity, url_filter
from silbenwerk.llm.induced import suffix_array
from silbenwerk.llm.lattice import DEFAULT_MODEL, CountTrie, vocabulary
from silbenwerk.llm.registry import RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
needs_model = pytest.mark.skipif(not os.path.exists(DEFAULT_MODEL), reason="no vocabulary file")


def words(n, seed=0, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def docs(spark):
    base, passage = words(120, 1), words(60, 9, 10**6)
    near = base.split()
    near[50] = "other"
    rows = [(1, base), (2, " ".join(near)), (3, base), (4, None), (5, ""), (6, " \t\n"), (7, "only three words"), (8, "Only  THREE words"), (9, words(300, 2)), (9, words(300, 2)), (10, words(4000, 3)),
            (11, words(50, 4) + " " + passage + " " + words(40, 5)), (12, words(70, 6) + "\n" + passage), (13, "äöü ▁ß 漢字 \x00 🙂  x"), (None, base), (14, "a" * 900)]
    return spark.createDataFrame([(i, t, "de", None if i == 7 else f"s{(i or 0) % 4}", len(t or "")) for i, t in rows], DOCS)


def rows_of(df):
    return df.collect()


# -- suffix arrays and repeats


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(5)
    for k in (1, 2, 4, 26):
        for n in (1, 2, 30, 300):
            t = rng.integers(97, 97 + k, n).astype(np.uint8)
            t = np.concatenate([t, [255], t[: n // 2]]).astype(np.uint8)
            sa, lcp = suffix_array(t, 200, memory=64)
            b = bytes(t)
            want = sorted(range(len(b)), key=lambda i: b[i:])
            assert sorted(sa.tolist()) == list(range(len(b)))
            pair = [min(255, len(os.path.commonprefix([b[x:], b[y:]]))) for x, y in zip(want, want[1:])]
            if max(pair, default=0) < 200:
                assert sa.tolist() == want and lcp.tolist()[1:] == pair


def peak_bytes(run, *given):
    """The most memory that arrays and objects take while run works, beyond what was there before."""
    tracemalloc.start()
    try:
        run(*given)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_suffix_types_across_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    for block in (1, 2, 7, 1 << 17):
        monkeypatch.setattr(induced, "BLOCK", block)
        for n in (1, 2, 7, 8, 60):
            t = rng.integers(97, 99, n).astype(np.uint8)
            b = bytes(t)
            rises, run = induced.suffix_types(t)
            assert rises.tolist() == [b[i:] < b[i + 1:] for i in range(n - 1)] + [False]
            assert run.tolist() == [len(b[i:]) - len(b[i:].lstrip(b[i:i + 1])) for i in range(n)]


def test_shards_and_windows_take_little_memory():
    """Sorting takes a bounded number of bytes for each character, and windows are hashed some texts at a time."""
    rng = np.random.default_rng(7)
    text = rng.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), 600_000)
    assert peak_bytes(suffix_array, text) < 42 * len(text)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100))] * 3 + [pa.array([rng.choice(text, 10_000).tobytes() for _ in range(100)])], ["f1", "f2", "doc_id", "text"])
    found = {}

    class Docs:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: found.update(run=run)

    suffix_dedup._anchors(Docs(), 16, 200)
    assert peak_bytes(lambda: list(found["run"](iter([batch])))) < 60_000_000


def repeats(texts, span=200):
    count = collections.Counter(b[i:i + span] for b in texts for i in range(len(b) - span + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i:i + span]] > 1:
                gone[i:i + span] = b"\x01" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), len(b) - len(kept), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_remove_repeats(docs):
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = collections.Counter((k, *v) for (k, _), v in zip(texts, repeats([b for _, b in texts])))
    assert collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()) == want
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and all(r.n_chars == len(r.text) for r in kept.collect())
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_hot_anchor_is_dealt(spark, monkeypatch):
    """Contexts of one anchor beyond a shard's size do not meet in one group, and nothing repeated is missed."""
    passage = words(60, 9, 10**6)
    rows = [(i, f"{words(40, 100 + i, 10**6)} {'same edge ' if i % 3 == 0 else ''}{passage} {words(40, 300 + i, 10**6)}") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sort, most = suffix_dedup._sorted_shard, 30

    def guarded(span, memory):
        inner = sort(span, memory)

        def run(group):
            assert len(group) <= most, f"{len(group)} contexts in one group"
            return inner(group)

        return run

    monkeypatch.setattr(suffix_dedup, "_sorted_shard", guarded)
    keyed, spans = suffix_dedup.repeated_spans(table, shard_runs=10)
    got = {r.doc_id: suffix_dedup.joined_spans(np.array([s.lo for s in r.spans or []]), np.array([s.hi for s in r.spans or []])) for r in keyed.join(spans, ["f1", "f2"], "left").collect()}
    for (k, text), (size, gone, parts, _) in zip(rows, repeats([t.encode() for _, t in rows])):
        assert sum(b - a for a, b in got[k]) == gone > 0 and len(got[k]) == parts


# -- n-gram Jaccard join


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicate_classes(docs, spark):
    extra = [(100 + i, " ".join([f"v{j}" if j != 7 * i % 90 else "x" for j in range(150 + i % 5)]), "de", "s", 0) for i in range(40)]
    table = docs.unionByName(spark.createDataFrame(extra, DOCS))
    data = [(r.doc_id, shingles(r.text)) for r in table.collect()]
    link = {i: i for i in range(len(data))}

    def root(i):
        while link[i] != i:
            i = link[i]
        return i

    for i, (_, a) in enumerate(data):
        for j, (_, b) in enumerate(data[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                link[max(x, y)] = min(x, y)
    least = {}
    for i, (k, s) in enumerate(data):
        if k is not None and s:
            least[root(i)] = min(k, least.get(root(i), k))
    want = collections.Counter((k, len(s), least.get(root(i)) if s else k) for i, (k, s) in enumerate(data))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_classes(table).collect())
    assert got == want
    ids = [r.doc_id for r in jaccard_join.one_of_each(table).collect()]
    assert {1, 4, 5, 6, 7, 9, 10} <= set(ids) and not {2, 3, 8} & set(ids) and ids.count(9) == 1 and None not in ids
    assert jaccard_join.near_duplicate_classes(docs.limit(0)).count() == 0


def brute_links(rows):
    """rows(doc_id, text) -> for each row (doc_id, n_shingles, n_links, component_id)."""
    data = [(k, shingles(t)) for k, t in rows]
    near = [[bool(a and b) and i != j and 100 * len(a & b) >= 75 * len(a | b) for j, (_, b) in enumerate(data)] for i, (_, a) in enumerate(data)]
    comp = list(range(len(data)))
    for _ in data:
        comp = [min([comp[i]] + [comp[j] for j in range(len(data)) if near[i][j]]) for i in range(len(data))]
    least = {}
    for i, (k, s) in enumerate(data):
        if k is not None:
            least[comp[i]] = min(k, least.get(comp[i], k))
    return collections.Counter((k, len(s), sum(near[i]), least.get(comp[i]) if s else k) for i, (k, s) in enumerate(data))


def test_order_of_equal_rows(spark):
    """Copies in any order, texts that share a doc_id, rows without doc_id: in one batch and in many."""
    x, z = words(120, 21), words(90, 22)
    near = " ".join("other" if i == 60 else w for i, w in enumerate(x.split()))
    rows = [(5, x), (3, x), (1, near), (7, x), (7, z), (9, z), (None, z), (None, words(30, 23)), (2, words(80, 24)), (12, None), (12, "")]
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: -(r[0] or 0)), rows[4:] + rows[:4]):
        for parts in (1, 5):
            table = spark.createDataFrame(spark.sparkContext.parallelize(order, parts), "doc_id long, text string")
            got = collections.Counter((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in jaccard_join.near_duplicate_classes(table).collect())
            assert got == brute_links(rows), order
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(table).collect())
    assert kept == collections.Counter({(1, near): 1, (7, z): 1, (None, words(30, 23)): 1, (2, words(80, 24)): 1, (12, None): 1, (12, ""): 1})
    case = spark.createDataFrame([(1, x), (7, x), (7, z), (9, z)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in jaccard_join.one_of_each(case).collect()} == {(1, x), (7, z)}
    clash = table.selectExpr("doc_id", "text", "1 AS rows", "2 AS node", "3 AS kept_id", "4 AS n", "null AS whole")
    assert jaccard_join.one_of_each(clash).columns == clash.columns and jaccard_join.near_duplicate_classes(clash).count() == len(rows)


def test_families_in_blocks(spark, monkeypatch):
    """Long lists, large families with guests, and many rounds of families give the links of brute force."""
    for name, value in (("BLOCK_SETS", 7), ("BLOCK_MEMBERS", 1500), ("LONG", 3), ("LIST_BLOCK", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(3):
        base = words(60 + 40 * g, 30 + g, 10**6).split()
        for i in range(30):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(0, 6)):
                own[at] = f"x{rng.integers(0, 9)}"
            if i % 4 == 0:
                own = own[int(rng.integers(0, 20)):] + words(int(rng.integers(1, 20)), 400 + i, 10**6).split()
            rows.append((len(rows), " ".join(own)))
    passage = words(40, 77, 10**6)
    rows += [(len(rows) + i, f"{passage} {words(5 + i % 17, 500 + i, 10**6)}") for i in range(40)]
    rows += rows[:10]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_links(rows)
    assert len({n for _, _, n, _ in want}) > 10
    assert collections.Counter((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in jaccard_join.near_duplicate_classes(table).collect()) == want


def test_near_duplicate_links(docs, spark, monkeypatch):
    """All links of a component count, also where blocks of it are compared with one another."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    extra = [(100 + i, " ".join([f"v{j}" if j not in (7 * i % 90, 90 + i % 41, 140 - i) else "x" for j in range(150 + i % 5)]), "de", "s", 0) for i in range(40)]
    chain = [(200 + i, " ".join(f"c{j}" for j in range(8 * i, 8 * i + 100)), "de", "s", 0) for i in range(6)]
    table = docs.union(spark.createDataFrame(extra + extra[:3] + chain, DOCS))
    rows = [(r.doc_id, shingles(r.text)) for r in table.collect()]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    want = collections.Counter((k, sum(linked(a, b) for i, (_, b) in enumerate(rows) if i != own)) for own, (k, a) in enumerate(rows))
    assert len({n for _, n in want}) > 5  # neither none nor all
    assert collections.Counter((r.doc_id, r.n_links) for r in jaccard_join.near_duplicate_classes(table).collect()) == want


def test_common_members():
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, 30), rng.integers(0, 10**4, 60)])).astype("<u8") for _ in range(30)]
    assert jaccard_join._common(sets[:13], sets[13:]).tolist() == [[len(set(a) & set(b)) for b in sets[13:]] for a in sets[:13]]
    assert jaccard_join._common(sets[:1], sets[:1]).tolist() == [[len(sets[0])]]


def test_blocks_take_little_memory():
    """Two blocks of a family are compared some rows, columns and pairs at a time."""
    rng = np.random.default_rng(4)
    pivot, pool = (np.unique(rng.integers(0, 1 << 62, n)).astype("<u8") for n in (300, 5_000))
    rows = []
    for side in (0, 1):
        for k in range(1_000):
            d = np.unique(np.concatenate([rng.choice(pool[:40], 10), rng.choice(pool, 60)])).astype("<u8")
            rows.append((1, 0, 1, side, 1_000 * side + k, 1, 1 + k % 3, 300 + len(d), 0.2, 0, d.tobytes()))
    rows.append((1, 0, 1, 2, 1, 1, 0, 0, 0.0, 0, pivot.tobytes()))
    group = pd.DataFrame(rows, columns=["host", "i", "j", "side", "node", "fam", "weight", "n", "d", "dropped", "members"])
    assert peak_bytes(jaccard_join._host_block, group) < 45_000_000
    found = jaccard_join._host_block(group).set_index("node")["others"]
    sets = {r[4]: set(np.frombuffer(r[10], "<u8").tolist()) | set(pivot.tolist()) for r in rows[:-1]}
    for node in (0, 127, 128, 999, 1_000, 1_500):
        others = [r for r in rows[:-1] if (r[3] == 0) != (node < 1_000)]
        assert found[node] == sum(r[6] for r in others if 100 * len(sets[node] & sets[r[4]]) >= 75 * len(sets[node] | sets[r[4]]))


# -- tokens and pieces


def best_count(vocab, token):
    best = {0: (0.0, 0)}
    for end in range(1, len(token) + 1):
        offers = []
        for start in range(end):
            hit = vocab.pieces.get(token[start:end])
            if hit:
                offers.append((best[start][0] + hit[1], -best[start][1] - 1))
        if token[end - 1] not in vocab.pieces:
            k = len(token[end - 1].encode())
            offers.append((best[end - 1][0] + k * vocab.byte_logp, -best[end - 1][1] - k))
        s, n = max(offers)
        best[end] = (s, -n)
    return best[len(token)][1]


@needs_model
def test_token_counts(docs):
    vocab = vocabulary(DEFAULT_MODEL)
    for max_nodes in (10, 10**6):
        trie = CountTrie(vocab, max_nodes)
        for w in ("the", "there", "therefore", "unbelievably", "äöß", "漢字", "▁"):
            assert trie.tokens(w.encode())[0] == best_count(vocab, " " + w)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(docs).collect()}
    assert got[4] == got[5] == got[6] == (0, 0) and got[7][0] == 3 and got[10][0] == 4000
    assert got[7][1] == sum(best_count(vocab, " " + w) for w in "only three words".split())
    assert token_counts.token_counts(docs.limit(0)).count() == 0


@needs_model
def test_pieces_are_lossless_and_repeatable(docs):
    one, two = pieces.encode(docs).collect(), pieces.encode(docs.repartition(3)).collect()
    key = lambda rs: sorted((r.doc_id or 0, r.piece_sha256) for r in rs)
    assert key(one) == key(two) and all(r.lossless for r in one)
    texts = collections.Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert collections.Counter((r.doc_id, r.text) for r in pieces.decode(pieces.encode(docs)).collect()) == texts
    assert key(one) != key(pieces.encode(docs, seed=2).collect())


@needs_model
def test_pieces_follow_the_lattice():
    vocab = vocabulary(DEFAULT_MODEL)
    token, n = " theres", 40_000
    ways = collections.defaultdict(float)

    def cuts(at, path, logp):
        if at == len(token):
            ways[tuple(path)] += math.exp(logp)
        for end in range(at + 1, len(token) + 1):
            hit = vocab.pieces.get(token[at:end])
            if hit:
                cuts(end, [*path, hit[0]], logp + hit[1])

    cuts(0, [], 0.0)
    total = sum(ways.values())
    found = pieces.encode_texts([token] * n, list(range(n)), vocab, 1.0, 3)
    seen = collections.Counter(tuple(x.tolist()) for x in found)
    assert set(seen) <= set(ways)
    for path, weight in ways.items():
        p = weight / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


# -- urls


def test_url_filter(spark):
    urls = ["http://example.org/en/1", "http://EXAMPLE.org/en/12?x", "https://a.b.example.org/es/#t", "http://other.org/", "http://other.org", "ftp://x.com/fr/a", "http://com/de/", "http://notexample.org/es/", "x://y.net/p", "no url", None, "", "http://example.org/en/2"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, RULES).collect()}
    assert got[0] == ("example.org", "/en/1", "example.org/en/1", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("a.b.example.org", "/es/", "example.org/es/", "block") and got[3][2:] == ("org/", "allow") and got[4] == ("other.org", "", None, "allow")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block") and got[7][2:] == ("org/", "allow") and got[8][2] is None
    assert got[9] == got[10] == got[11] == ("", "", None, "allow") and got[12][2:] == ("org/", "allow")
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    inside = universe.where("substring(key, 2) % 7 = 0")
    cascade = url_filter.build_cascade(inside, universe, bits_per_key=3, hashes=2)
    assert len(cascade.levels) > 1
    assert universe.where(cascade.contains(F.col("key"))).exceptAll(inside).count() == 0 and inside.where(~cascade.contains(F.col("key"))).count() == 0
    with pytest.raises(ValueError):
        url_filter.build_cascade(inside, universe, max_bits=100)


# -- mixing


def test_targets_equal_rounds_of_clamping(spark):
    for sizes in ([100, 100, 100], [1000, 10, 10, 5], [7], [0, 0], [50, 1, 1, 1, 900, 3]):
        src = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(src).collect()}
        weight = {f"s{i}": i % 3 + 1 for i in range(len(sizes))}
        cap = {f"s{i}": 3 * s for i, s in enumerate(sizes)}
        want, left, open_ = {}, sum(sizes), set(cap)
        while over := [k for k in open_ if left * weight[k] / sum(weight[x] for x in open_) > cap[k]]:
            for k in over:
                want[k] = cap[k]
            left -= sum(cap[k] for k in over)
            open_ -= set(over)
        want |= {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want), sizes


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.repeats for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_keeps_clashing_columns(docs):
    odd = docs.selectExpr("doc_id", "text", "source", "1 AS target", "2 AS limit", "3 AS whole", "4 AS source_size", "5 AS draw", "6 AS repeats", "7 AS copy", "8 AS plan_source", "9 AS size", "null AS `a.b`")
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and {tuple(r)[3:12] for r in out.collect()} == {tuple(range(1, 10))}
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.repeats
    assert collections.Counter(r.doc_id for r in out.collect()) == +want


@needs_model
def test_copies_have_samples_of_their_own(spark):
    text = "the international understanding of remarkable circumstances " * 200
    rows = spark.createDataFrame([(1, text)] * 3 + [(2, text), (None, text), (None, text), (3, None)], "doc_id long, text string")
    out = pieces.encode_copies(rows).collect()
    assert len(out) == 7 and all(r.lossless for r in out) and sorted(r.copy for r in out if r.doc_id == 1) == [0, 1, 2]
    assert len({r.piece_sha256 for r in out if r.doc_id == 1}) == 3
    first = {r.doc_id: r.piece_sha256 for r in pieces.encode(rows).collect()}
    assert all(first[r.doc_id] == r.piece_sha256 for r in out if r.copy == 0)


# -- the pipeline


@needs_model
def test_pipeline_stages(docs, spark, tmp_path):
    """Every stage against what it should keep, judged on its own input; then run() as a whole."""
    import corpus_pipeline

    marks = [(i, int(i % 4 > 0), 0) for i in range(100, 400)]
    more = [(i, (" " if i % 4 else " | ").join(f"wort{x}" for x in np.random.default_rng(i).integers(0, 5000, 60)), "de", f"s{i % 3}", 0) for i in range(100, 400)]
    table = docs.unionByName(spark.createDataFrame(more, DOCS))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage, before = dict(corpus_pipeline.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    for n, (name, step) in enumerate(corpus_pipeline.STAGES):
        after = step(spark, before, str(tmp_path))
        had = rows(before)
        if n < 4:
            assert after.columns == docs.columns, name
            got = rows(after)
        if name == "quality":
            good = {(r.doc_id, r.predicted) for r in quality.score_quality(before, labels).collect()}
            assert got == collections.Counter({k: v for k, v in had.items() if (k[0], 1) in good})
            assert all((i, 1) in good for i, q, _ in marks if q)
        elif name == "near_duplicates":
            comp = {}
            for k, size, _, c in brute_links(list(had.elements())):
                comp.setdefault(k, set()).add((c, size))
            kept = [k for k in got if k[1] and k[1].strip()]
            assert sum(1 for k in got.elements() if not (k[1] or "").strip(" \t\n")) == sum(1 for k in had.elements() if not (k[1] or "").strip(" \t\n"))
            assert not got - had and len({c for c, _ in set().union(*comp.values())}) >= len(kept) > 0
            assert {n for _, _, n, _ in brute_links(list(got.elements()))} == {0}
        elif name == "repeated_passages":
            whole = repeats([(t or "").encode() for _, t in had.elements()])
            assert sum(len((t or "").encode()) for _, t in got.elements()) == sum(a - b for a, b, _, _ in whole)
        elif name == "mixture":
            want = collections.Counter()
            for r in mixing.mix(before).collect():
                want[r.doc_id] += r.repeats
            assert collections.Counter(k for k, _ in got.elements()) == +want
        else:
            out = after.collect()
            assert collections.Counter(r.doc_id for r in out) == collections.Counter(k for k, _ in had.elements()) and all(r.lossless for r in out)
        if n < 4:
            path = str(tmp_path / f"stage{n}")
            after.write.parquet(path)
            before = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out)
    assert stage["pieces"](spark, docs.limit(0), str(tmp_path)).count() == 0


# -- media


def png_samples(stored):
    width, height = struct.unpack(">II", stored[16:24])
    at = stored.index(b"IDAT")
    raw = zlib.decompress(stored[at + 4:at + 4 + struct.unpack(">I", stored[at - 4:at])[0]])
    return b"".join(raw[i * (width + 1) + 1:(i + 1) * (width + 1)] for i in range(height))


def test_media_features(docs, spark):
    more = spark.createDataFrame([(900, "a < b & c\n\n&amp;amp; <p>\n \nlast"), (901, "\n"), (902, "x" * 575), (903, "y" * 576), (904, "z" * 577)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(more)
    got = collections.Counter(tuple(r) for r in media.media_features(rows).collect())
    want = collections.Counter()
    for r in rows.collect():
        b = (r.text or "").encode()
        p = b
        while not p or len(p) % 576:
            p += b"\xff"
        stored = media.to_png(p)
        assert png_samples(stored) == p and media.from_png(stored) == p
        n = collections.Counter(p)
        bits = -sum(c / len(p) * math.log2(c / len(p)) for c in n.values())
        feature = f"576x{len(p) // 576};mean={sum(p) / len(p):.4f};white={n[255] / len(p):.4f};bits={bits:.4f}"
        lines = [bool(x.split()) for x in (r.text or "").split("\n")]
        before = sum(lines[:-(-len(lines) // 2)])
        want[(r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, before, sum(lines) + 1)] += 1
    assert got == want
    clash = more.withColumn("html", F.lit(1)).withColumn("figure", F.lit(2)).withColumn("lines", F.lit(3)).withColumn("digest", F.lit(4))
    assert media.media_features(clash).count() == 5 and media.media_features(clash.limit(0)).count() == 0


def test_sequences(spark):
    page = "<p>One &amp; <b>two</b></p><figure><img src='sha256:ab' alt='old'><figcaption>Cap</figcaption></figure><script>x</script><img src='u'><p>end<br>more"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<<p")], "page_id long, html string")
    seq = {r.page_id: [(x.pos, x.kind, x.text, x.ref) for x in r.sequence] for r in media.interleave(pages).collect()}
    assert seq[1] == [(0, "text", "One & two", None), (1, "media", "Cap", "sha256:ab"), (2, "media", "", "u"), (3, "text", "end", None), (4, "text", "more", None)] and seq[2] == []
    store = spark.createDataFrame([("ab", 5)], "digest string, size int")
    items = {r.pos: (r.caption, r.size) for r in media.resolve(media.interleave(pages), store).collect()}
    assert items == {1: ("Cap", 5), 2: ("", None)}


# -- classifiers


def test_classifiers(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        w = [f"wort{x}" for x in rng.integers(0, 300, rng.integers(20, 90))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            for k in rng.integers(0, len(w), 4):
                w[k] = rng.choice(["zorkig", "blafft"])
        rows.append((i, (" | ".join if bad else " ".join)(w), "de", "s", 0))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows + [(1000, None, "de", "s", 0), (1001, "", "de", "s", 0)], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for got, truth in ((quality.score_quality(docs, marks), {i: q for i, q, _ in labels}), (toxicity.score_toxicity(docs, marks), {i: t for i, _, t in labels})):
        got = got.collect()
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert len(got) == 402 and len(held) > 40 and all(0 <= r.score <= 1 for r in got)
        assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    spans = {r.doc_id: r.spans for r in toxicity.score_toxicity(docs, marks).collect()}
    text = dict((r[0], r[1]) for r in rows)
    assert spans[5] and all(text[5][s.start:s.end] in ("zorkig", "blafft") for s in spans[5])
    none = marks.limit(0)
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5} and {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert quality.keep_good(docs, marks).columns == docs.columns


def test_chain_marginals_equal_enumeration():
    chain = toxicity.Chain()
    chain.trans, chain.start = np.array([[0.2, -0.5], [0.1, 0.7]]), -0.3
    e, sizes = np.array([0.5, -1.0, 2.0, 0.3, -0.2]), np.array([3, 0, 2])
    p, _ = chain.marginals(e, sizes)
    at = 0
    for n in sizes:
        mass, top = np.zeros(n), 0.0
        for code in range(2**n):
            y = [(code >> t) & 1 for t in range(n)]
            s = chain.start * y[0] if n else 0.0
            s += sum(e[at + t] * y[t] for t in range(n)) + sum(chain.trans[y[t - 1], y[t]] for t in range(1, n))
            top += math.exp(s)
            mass += math.exp(s) * np.array(y)
        if n:
            assert np.allclose(p[at:at + n], mass / top)
        at += n


def test_crowds_leave_long_lists(spark, monkeypatch):
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    base, passage = word(200), word(80)
    # near copies, linked with the base but seldom with each other, and texts of their own that share a passage
    texts = [base] + [[w if i % 40 != j % 40 else f"x{j}y{i}" for i, w in enumerate(base)] for j in range(80)]
    texts += [word(60) + passage + word(60) for _ in range(80)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    longest, candidates = [], jaccard_join._candidates

    def spy(entries, family, sets):
        lists = entries.join(family.select("node", "fam"), "node").groupBy("key").agg(F.count_distinct("fam").alias("m"))
        longest.append(lists.agg(F.max("m")).first()[0])
        return candidates(entries, family, sets)

    monkeypatch.setattr(jaccard_join, "_candidates", spy)
    got = {r.doc_id: (r.n_links, r.component_id) for r in jaccard_join.near_duplicate_classes(table).collect()}
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in texts]
    links = [sum(a is not b and 100 * len(a & b) >= 75 * len(a | b) for b in sets) for a in sets]
    assert got == {i: (links[i], 0 if i < 81 else i) for i in range(len(texts))}
    assert longest == [1] or longest[0] <= jaccard_join.LONG


# -- embeddings


def test_near_vector_classes(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    rows += [(200 + i, (base[0] + 0.05 * rng.normal(size=16)).tolist(), 0) for i in range(60)]
    rows += [(280 + i, (base[2] + 0.05 * rng.normal(size=16)).tolist(), 2) for i in range(12)] + [(300, base[1].tolist(), 1), (301, base[1].tolist(), 1), (302, base[1].tolist(), 2)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [None] + [1.0] * 15, 1), (405, base[1].tolist(), None), (None, base[2].tolist(), 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [(k, np.array(v) / np.linalg.norm(v), l) for k, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n = collections.Counter()
    link = {i: {i} for i in range(len(good))}
    for i, (a, x, l) in enumerate(good):
        for j, (b, y, m) in enumerate(good[:i]):
            if l == m and x @ y >= 0.93:
                n[i] += 1
                n[j] += 1
                group = link[i] | link[j]
                for g in group:
                    link[g] = group
    want = {k: (n[i], min(good[g][0] for g in link[i] if good[g][0] is not None)) for i, (k, _, _) in enumerate(good) if k is not None}
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_vector_classes(table, k=8, block=32, widest=32).collect()}
    assert {k: got[k] for k in want} == want
    assert all(got[k] == (0, k) for k in (400, 401, 402, 403, 404, 405))
    assert nn_descent.near_vector_classes(table.limit(0)).count() == 0


def test_local_join_across_batches():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(u, int(n), x[n].tobytes()) for u in range(6) for n in sorted(rng.choice(40, size=(1, 2, 9, 30, 3, 12)[u], replace=False))]

    def batches(size, wide):
        for i in range(0, len(rows), size):
            u, n, b = zip(*rows[i:i + size])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.binary()), pa.array([wide(k) for k in n], pa.int64())], ["u", "node", "unit", "wide"])

    for wide in (lambda n: -1, lambda n: 5 if n % 7 == 0 else 0, lambda n: 0):
        want = []
        for u in range(6):
            ids = [n for c, n, _ in rows if c == u]
            most = max(map(wide, ids))
            for n in ids:
                near = sorted((-float(x[n] @ x[m]), m) for m in ids if m != n)
                want += [(n, m) for _, m in near[:3 if most < 0 else wide(n) and most]]
        for size in (1, 7, 100):
            got = [(r["u"], r["v"]) for b in nn_descent._local_join(6)(batches(size, wide)) for r in b.to_pylist()]
            assert sorted(got) == sorted(want)


def test_local_join_offers_only_what_can_enter():
    rng = np.random.default_rng(9)
    x = np.ones(8) + 0.05 * rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]

    def batch(wide, bound):
        cols = [pa.array(np.full(200, 5)), pa.array(np.arange(200)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.full(200, wide)), pa.array(bound, pa.float64())]
        return iter([pa.RecordBatch.from_arrays(cols, ["u", "node", "unit", "wide", "bound"])])

    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    order = np.argsort(-sim, axis=1)
    bound = np.take_along_axis(sim, order, 1)[:, 1]  # only the two best can enter
    got = {(r["u"], r["v"]) for b in nn_descent._local_join(16)(batch(-1, bound)) for r in b.to_pylist()}
    assert got == {(i, int(j)) for i in range(200) for j in order[i, :2]}
    # a crowd of copies: an enlarged list is offered k links, not as many as it holds
    got = [(r["u"], r["v"]) for b in nn_descent._local_join(16, "<f8", 0.93)(batch(128, bound)) for r in b.to_pylist()]
    assert len(got) == len(set(got)) <= 200 * 16 and all(sim[i, j] >= 0.93 for i, j in got)
    assert min(collections.Counter(i for i, _ in got).values()) >= 1
