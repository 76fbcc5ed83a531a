"""Near duplicates, components, decontamination and nearest neighbours against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import ann, decontaminate, minhash
from tallyloom.llm.components import components
from tallyloom.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import LONG, SF
from tests.oracle import compare, connect


def grouped(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (3, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links + [(None, 5)], "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: r for i, r in grouped(nodes, links).items() if i in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120])) for _ in range(12)]
    docs = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i, " ".join(w).title() if i % 3 else "\t".join(w)))
    near = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=k, percent=percent)
    sets = {i: sets_of(t, k) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = grouped(sets, links)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.collect()} == {(i, len(s), root[i], root[i] == i) for i, s in sets.items()}


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd, k=3, percent=85).collect()), key=str)
    assert rows == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 4, 4, True), (5, 1, 5, True), (6, 0, 6, True)], key=str)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicate_query_equals_sql(spark):
    ok, *_, detail = compare("op3_minhash", QUERIES["op3_minhash"](spark, SF), connect(SF), ORACLES["op3_minhash"])
    assert ok, detail


def test_bounds_of_the_filters():
    assert minhash.collisions_needed(64, 0.85, 1e-9) == 34
    assert 50 <= minhash.differences_allowed(64, 0.85, 1e-9) <= 75


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    asked = own[rng.integers(0, 40, 200)]
    for _ in range(23):
        asked = asked ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    for radius in (0, 7, 15, 23):
        who, which, distance = decontaminate.HammingIndex(own, radius).within(asked)
        all_ = np.bitwise_count(asked[:, None] ^ own[None])
        assert set(zip(who.tolist(), which.tolist(), distance.tolist())) == {(i, j, all_[i, j]) for i, j in np.argwhere(all_ <= radius).tolist()}


def brute_matches(docs, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    out = {}
    for d, t in docs:
        w = split(t)
        for i, x in items:
            v = split(x)
            k = min(5, len(v))
            if not v:
                continue
            if not {tuple(v[j:j + k]) for j in range(len(v) - k + 1)} & {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}:
                continue  # nothing in common
            for s in range(len(w) - len(v) + 1):
                a, b = ([tuple(y[j:j + k]) for j in range(len(y) - k + 1)] for y in (w[s:s + len(v)], v))
                both = sum(min(a.count(z), b.count(z)) for z in set(a))
                same = both / (len(a) + len(b) - both)
                if same >= 0.8 and same > out.get((d, i), (0, 0))[0]:
                    out[d, i] = same, s
    return out


def test_passages_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([3, 12, 25, 25, 60, 60])] + [(6, ""), (7, None), (8, "x x x x x x x x x x"), (9, "x x x x x x x x x x")]
    docs = []
    for d in range(40):
        w = rng.choices(words, k=rng.choice([0, 10, 80, 200]))
        for i in rng.sample(range(6), rng.choice([0, 1, 2])):
            part = items[i][1].upper().split()
            if rng.random() < 0.5 and len(part) > 20:
                part[rng.randrange(len(part))] = "CHANGED"
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((d, ", ".join(w)))
    docs += [(90, "x " * 30), (91, None), (92, "")]
    got = decontaminate.contaminated_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_items=4)
    want = brute_matches(docs, items)
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in got.collect()} == {k: (round(v[0], 9), v[1]) for k, v in want.items()}
    marked = spark.createDataFrame(docs, "doc_id long, text string").filter(decontaminate.is_contaminated(F.col("text"), spark.createDataFrame(items, "item_id long, text string"), block_items=4))
    assert {r.doc_id for r in marked.collect()} == {d for d, _ in want}


def brute_short_matches(docs, items):
    """Documents of fewer words than the item, taken whole."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    out = {}
    for d, t in docs:
        for i, x in items:
            w, v = split(t), split(x)
            k = min(5, len(v))
            if len(w) < len(v):
                a, b = ([tuple(y[j:j + k]) for j in range(len(y) - k + 1)] for y in (w, v))
                both = sum(min(a.count(z), b.count(z)) for z in set(a))
                if both and both / (len(a) + len(b) - both) >= 0.8:
                    out[d, i] = round(both / (len(a) + len(b) - both), 9), 0, len(w)
    return out


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices([f"v{j}" for j in range(300)], k=n))) for i, n in enumerate([3, 6, 24, 59, 60])] + [(5, "x " * 40)]
    docs = []
    for i, x in items:
        w = x.split()
        docs += [(100 * i + cut, " ".join(w[cut // 2:len(w) - cut + cut // 2])) for cut in range(1, min(16, len(w)))]
    docs += [(900, " ".join(["other", *items[3][1].split()[2:]])), (901, ""), (902, None)]
    want = brute_short_matches(docs, items)
    assert want[301, 3] == (round(54 / 55, 9), 0, 58) and 310 in {d for d, _ in want} and 315 not in {d for d, _ in want}
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated_passages(docs_df, items_df, block_items=4).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in rows} == want
    assert {r.doc_id for r in docs_df.filter(decontaminate.is_contaminated(F.col("text"), items_df)).collect()} == {d for d, _ in want}


def test_passages_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contaminated_passages(odd, bench).collect()) == [(0, 1), (1, 1), (1, 1)]
    assert decontaminate.contaminated_passages(odd, bench.limit(0)).count() == 0
    assert decontaminate.contaminated_passages(empty, bench).count() == 0
    assert len(LONG) > 500_000


def exact(rows, queries, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for q, v in queries:
        d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
        keep = ids != q
        out[q] = [(int(ids[keep][i]), float(d[keep][i])) for i in np.lexsort((ids[keep], d[keep]))[:k]]
    return out


def test_nearest_of_a_small_table_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(100 + i, [1.0] * 6) for i in range(40)]
    junk = [(500, None), (501, [0.0] * 6), (502, [float("nan")] * 6), (503, [None] * 6), (504, [1.0, 2.0]), (None, [1.0] * 6), rows[5]]
    df = spark.createDataFrame(rows + junk, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-14)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert ann.nearest(few, few, k=10).count() == 12
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall(spark):
    path = "/root/testdata/sf0.1"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = exact(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = {}
    for r in ann.nearest(spark.read.parquet(f"{path}/embeddings.parquet"), spark.read.parquet(f"{path}/embeddings.parquet").filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_reranked_grow_with_the_table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(rng.normal(size=(4000, 32)))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    few, many = ([tuple(r) for r in ann.nearest(df, df.filter("vec_id % 200 = 0"), reranked=n).orderBy("query_id", "rank").collect()] for n in (10, 120))
    assert few == many  # 3 % of 4,000


def test_sketches_of_odd_buckets_bound_the_difference():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 900, n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (0, 1, 5, 60, 60, 400, 400, 5000)]
    at = np.cumsum([0, *map(len, sets)])
    sketches = minhash.odd_buckets(np.concatenate(sets), at)
    sketches = sketches.view(np.uint64).reshape(len(sets), minhash.WORDS)
    assert not sketches[0].any() and np.bitwise_count(sketches[1]).sum() == 1
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = int(np.bitwise_count(sketches[i] ^ sketches[j]).sum())
            apart = len(np.setxor1d(a, b))
            assert bits <= apart and bits % 2 == apart % 2


@pytest.mark.parametrize("k, percent", [(3, 85), (1, 80)])
def test_near_duplicates_about_the_limit_of_small_sets(spark, k, percent):
    """Copies of two texts, whose sets lie on both sides of the size up to which odd buckets are compared."""
    rng = random.Random(percent)
    limit = minhash.odd_limit(percent)
    docs = []
    for size in (limit * 97 // 100, limit * 115 // 100):
        base = [f"v{size}x{j}" for j in range(size + k - 1)]
        for i in range(25):
            w = list(base[rng.choice([0, 0, size // 12]):len(base) - rng.choice([0, size // 20])])
            for p in rng.sample(range(len(w)), len(w) * rng.choice([0, 1, 3, 5, 7]) // (100 * k)):
                w[p] = f"e{len(docs)}x{p}"
            docs.append((len(docs), " ".join(w)))
    sets = {i: sets_of(t, k) for i, t in docs}
    assert min(map(len, sets.values())) < limit < max(map(len, sets.values()))
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = grouped(sets, links)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=k, percent=percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == root


def test_sieve_loses_no_wanted_row(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(-2000, 2000)] + [(None, "none"), (7, "again")], "doc_id long, text string")
    wanted = spark.createDataFrame([(i,) for i in range(-1999, 2000, 7)] + [(None,), (7,)], "doc_id long")
    got = sorted(r.text for r in minhash._sifted(rows, "doc_id", wanted).collect())
    need = {f"t{i}" for i in range(-1999, 2000, 7)} | {"t7", "none", "again"}
    assert need <= set(got) and len(got) == len(set(got)) < len(need) + 40
    assert minhash._sifted(rows, "doc_id", wanted.limit(0)).count() == 0
