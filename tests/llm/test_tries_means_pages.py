"""Centroid clustering, conversation prefixes and page templates against plain versions."""
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from silbenwerk.llm import drift_means, page_template, prefix_trie


def plain_means(rows, k, rounds, dim=64, scale=256, seed=2):
    kept = [(i, tuple(min(max(math.floor(float(x) * scale), -(1 << 27)), 1 << 27) for x in v)) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    cents = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        now = assign()
        for j in range(len(cents)):
            own = [v for (i, v), (_, c, _) in zip(kept, now) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    now = assign()
    total = Counter()
    for _, c, d in now:
        total[c] += d
    return sorted(((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in now), key=str)


MEANS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("dim,k,spread", [(64, 40, 1.0), (2, 5, 0.02), (3, 7, 60000.0)])
def test_clusters_equal_plain_rounds(spark, dim, k, spread):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=dim) * spread + rng.integers(0, 4) * spread, 2)]) for i in range(150)]
    rows += rows[:9] + [(900, None), (901, [1.0] * (dim - 1)), (902, [float("nan")] * dim), (903, [float("inf")] + [0.0] * (dim - 1)), (904, [None] + [0.0] * (dim - 1)), (905, [1e300] * dim), (None, [0.5] * dim), (906, [])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, `a.b` string")
    got = drift_means.cluster_vectors(table, k=k, dim=dim)
    assert got.columns == MEANS
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_means(rows, k, 5, dim)


def test_few_equal_and_no_vectors(spark):
    table = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "vec_id long, embedding array<float>")
    got = [tuple(r)[:4] for r in drift_means.cluster_vectors(table, dim=2).orderBy("vec_id").collect()]
    assert got == [(i, 0, 0, 0) for i in range(6)]  # ties go to the smaller number
    empty = drift_means.cluster_vectors(table.where("false"), dim=2)
    assert empty.columns == MEANS and empty.count() == 0


def test_bounds_are_loosened_enough_and_less_than_the_drift():
    rng = np.random.default_rng(5)
    less = 0
    for _ in range(200):
        old = rng.integers(-50, 50, (6, 3)).astype(np.int64)
        new = old + rng.integers(-9, 10, (6, 3))
        new[0] = old[0]
        radius = rng.uniform(0, 25, 6)
        loose = drift_means.loosening(old, new, radius)
        for i in range(6):
            way = rng.normal(size=(300, 3))
            x = old[i] + way / np.linalg.norm(way, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (300, 1)) ** (1 / 3)
            others = [j for j in range(6) if j != i]
            shrunk = max((np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() for j in others)
            drift = max(np.linalg.norm(new[j] - old[j]) for j in others)
            assert shrunk <= loose[i] + 1e-9 and loose[i] <= drift * (1 + 1e-6)
            less += loose[i] < 0.9 * drift
    assert less > 100


def test_most_vectors_keep_their_cluster_by_bounds():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (10, 16)).astype(np.int64)
    x = (centres[rng.integers(0, 10, 2000)] + rng.integers(-300, 300, (2000, 16))).astype(np.int64)
    cluster, low = drift_means.nearest(x, centres)
    moved = centres + rng.integers(-40, 40, centres.shape)
    radius = np.array([np.sqrt(((x[cluster == j] - centres[j]) ** 2).sum(1).max(initial=0)) for j in range(10)])
    low = low - drift_means.loosening(centres, moved, radius)[cluster]
    kept = drift_means.keeps(x, cluster, low, moved, np.zeros(10))
    assert kept.mean() > 0.9 and (drift_means.nearest(x, moved)[0][kept] == cluster[kept]).all()


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    convs = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if tuple(built[c]) == p))).encode()).hexdigest()) for p, m in list(members.items()))


CONVS = "conv_id long, turn long, role string, text string, key int, `a.b` string"


def trie(spark, rows, **kw):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVS)
    got = prefix_trie.prefix_trie(prefix_trie.rebuild(prefix_trie.slim_turns(table, **kw.pop("slim", {}))), **kw)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2])


def test_trie_equals_plain_prefixes(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "", None, "ö", "bb" * 9])) for c in [*range(60), 203, 1001, 7777] for t in range(rng.randrange(12))]
    rows += [(c, 0, "user", "hello") for c in range(2000, 2300)]  # copies
    rows += [(3, None, "user", "null turn"), (3, 0, "user", "again"), (3, 0, "user", "again"), (None, 0, "user", "no conversation"), (9, 5, None, None)]
    rng.shuffle(rows)
    want = plain_trie(rows)
    assert trie(spark, rows, shard_rows=100, block=16, slim={"span": 3}) == want
    assert trie(spark, rows) == want


def test_trie_of_a_long_conversation_and_of_none(spark):
    rows = [(5, t, "user", str(t % 7)) for t in range(700)] + [(6, t, "user", str(t % 7)) for t in range(650)] + [(10, 0, "user", "x" * 3_000_000)]
    assert trie(spark, rows) == plain_trie(rows)
    table = spark.createDataFrame([], CONVS)
    assert prefix_trie.prefix_trie(prefix_trie.rebuild(prefix_trie.slim_turns(table))).count() == 0


def page(i, body):
    return f'<!DOCTYPE html><html><head><title>t {i}</title><script>var t="</p><article>no";</script><style>p{{}}</style></head><body><nav><ul><li><a href="/a{i}">Menu {i}</a></li></ul></nav>{body}<footer>&copy; Host {i}</footer></body></html>'


PAGES = "page_id long, url string, html string, host string, `a.b` string"


def extracted(spark, rows, **kw):
    table = spark.createDataFrame([(*r, "h", "x") for r in rows], PAGES)
    got = page_template.extract_main_text(table, **kw)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = [tuple(r) for r in got.collect()]
    assert all(len(t) == n for _, _, t, n in out)
    return {(i, u): t for i, u, t, _ in out}, out


def test_articles_without_what_surrounds_them(spark):
    article = ('<article class="post comments-open"><header><h1>A &amp; B &lt;x&gt;</h1></header><p>One&nbsp; two\n\tthree<br>four <b>bold</b>ly<p>unclosed <i>tag'
               '<div class="share">Share</div><ul><li>item<li>next</ul><aside>side</aside><form><label>Name</label><button>Send</button></form>'
               '<!-- hidden --><noscript>off</noscript><pre> a\n b</pre><p>5 < 6 &#228;&#x1F600; &unknown; &amp<div id="cookie-notice">Cookies</div>'
               '<section id="comments"><article>reader</article></section></p></article>')
    text = "A & B <x>\nOne two three four boldly\nunclosed tag\nitem\nnext\na b\n5 < 6 ä😀 &unknown; &"
    rows = [(1, "http://a.example/1", page(1, '<div class="ad">Buy</div>' + article + "<p>outside</p>")), (2, None, page(2, "<main><h1>T</h1><p>m</main>")), (3, "no host", None), (4, "http://b.example", ""), (5, "http://b.example", "just words"),
            (6, "http://A.example?x", "<article><p>open <script>never closed <p>x"), (7, "http://a.example", "<article>t<!-- open"), (8, "http://a.example", '<article title="a>b">q<p'), (1, "http://a.example/1", page(1, article))]
    got, out = extracted(spark, rows)
    assert len(out) == 9 and [t for i, _, t, _ in out if i == 1] == [text, text]
    assert {i: t for (i, _), t in got.items() if i > 1} == {2: "T\nm", 3: "", 4: "", 5: "just words", 6: "open", 7: "t", 8: "q"}
    assert extracted(spark, [])[1] == []


def nameless(i, rng, own):
    """A page without article: the main text lies in a div without a telling name, beside a shorter one; one line is the same everywhere."""
    words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(rng.randrange(50)) for _ in range(60))
    body = f'<div class="x1"><h1>Title {i}</h1><div class="x2"><p>{words}</p><p>{own}</p><p>Every page ends with this remark</p></div></div><div class="x3"><p>teaser {i} <a href="/">more</a></p></div>'
    return page(i, body), f"Title {i}\n{words}\n{own}"


@pytest.mark.parametrize("broadcast", [16_000_000, 0])
def test_templates_find_the_main_slot_and_drop_fixed_text(spark, broadcast):
    rng = random.Random(2)
    made = [nameless(i, rng, f"own line {i} {rng.random()}") for i in range(30)]
    rows = [(i, "https://one.example/x", h) for i, (h, _) in enumerate(made)]
    got, _ = extracted(spark, rows, broadcast_bytes=broadcast)
    assert {i: t for (i, _), t in got.items()} == {i: t for i, (_, t) in enumerate(made)}
    # on a host with few pages, and on one with copies of one page only, nothing is fixed
    few, _ = extracted(spark, [(i, f"https://{'few' if i < 4 else 'copies'}.example/", made[i if i < 4 else 4][0]) for i in range(20)])
    assert [t[-200:] for t in few.values() if not t.endswith("Every page ends with this remark")] == []


def test_classes_equal_exact_occurrence_vectors(spark):
    """The template of every host, from exact vectors in plain dictionaries, gives the same texts."""
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 3}.example/", nameless(i, rng, "same" if i % 5 else f"x {i}")[0] if i % 4 else page(i, f"<article><h1>H {i}</h1><p>text {rng.random()}</article>")) for i in range(60)]
    got, _ = extracted(spark, rows)
    for h in range(3):
        own = [(i, page_template.scan(text)) for i, u, text in rows if u == f"http://h{h}.example/"]
        counts = [Counter((0 if x[2] is None else x[0].path, x[1]) for x in items) for _, items in own]
        classes = defaultdict(list)
        for token in set().union(*counts):
            vector = tuple(c[token] for c in counts)
            if 2 * sum(n > 0 for n in vector) >= len(own):
                classes[token[0], vector].append(token[1])
        flat = []
        for n, ((place, vector), tokens) in enumerate(sorted(classes.items())):
            fixed = place and set(vector) <= {0, 1} and 10 * sum(vector) >= 9 * len(own)
            if len(tokens) >= 3 or place:
                flat.append([len(tokens), 2 if fixed else 1 if place else 0, n, *tokens])
        template = page_template.Template([x for f in flat for x in f])
        orders, faults, sizes = defaultdict(set), Counter(), Counter()
        for _, items in own:
            for c, (order, bad) in page_template.check_nesting([x[1] for x in items if x[1] in template.token], template).items():
                orders[c].add(order)
                faults[c] += bad
            for e, _, text, linked in items:
                if text is not None and not e.aside:
                    sizes[page_template.region_of(e, template).path] += len(text.split()) - 2 * linked
        valid = page_template.Template([x for c, f in enumerate(flat) if len(orders[c]) == 1 and not faults[c] for x in f])
        region = max(sizes, key=lambda p: (sizes[p], p))
        for i, u, text in rows:
            if u == f"http://h{h}.example/":
                assert got[i, u] == page_template.main_text(text, valid, region)


def test_nesting_finds_faults():
    template = page_template.Template([3, 0, 10, 1, 2, 3, 2, 0, 11, 7, 8])
    ok = page_template.check_nesting([1, 7, 8, 2, 7, 8, 3], template)
    assert [f for _, f in ok.values()] == [0, 0]
    crossed = page_template.check_nesting([1, 7, 2, 8, 3], template)
    assert sum(f for _, f in crossed.values()) > 0


def test_a_long_hostile_page_takes_linear_time(spark):
    html = "<article>" + "<p <a " * 200_000 + "<div>" * 20_000 + "word " * 500_000 + "</p>" * 100_000 + "< <" * 100_000
    got, _ = extracted(spark, [(1, "http://x.example", html), (2, "http://x.example", "<article>" + "long " * 1_000_000)])
    assert len(got[2, "http://x.example"]) == 4_999_999


def test_stages_keep_dotted_and_clashing_columns(spark):
    from silbenwerk.llm.jaccard_join import one_of_each
    from silbenwerk.llm.suffix_dedup import without_repeats

    text = " ".join(f"w{i}" for i in range(90))
    rows = [(1, text, "x", 5, [1]), (1, text, "a", 7, None), (2, text + " end", None, 1, [2]), (3, "other words that stand alone", "z", 2, []), (4, None, "n", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, node int, bucket array<int>")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["a.b"]) for r in kept.collect()) == [(1, "a"), (3, "z"), (4, "n")]
    left = without_repeats(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r["a.b"], r.text) for r in left.collect() if r.doc_id != 2) == [(3, "z", "other words that stand alone"), (4, "n", "")]
    from silbenwerk.llm.quality import keep_good

    good = [(10 + i, "clean words in a calm order " * 9, "q", i, None) for i in range(30)] + [(50 + i, "### $$$ %%% *** " * 20, "r", i, None) for i in range(30)]
    table = docs.union(spark.createDataFrame(good, docs.schema))
    labels = spark.createDataFrame([(10 + i, 1) for i in range(30)] + [(50 + i, 0) for i in range(30)], "doc_id long, quality int")
    kept = keep_good(table, labels)
    assert kept.columns == docs.columns and {r["a.b"] for r in kept.where("doc_id >= 10").collect()} == {"q"}
    assert keep_good(table, labels.where("quality = 1")).count() == table.count()
