"""SimHash, embedding and benchmark operators against brute force."""

import random

import numpy as np
import pytest
import xxhash

from docuforge.llm.common import Scratch
from docuforge.llm.components import connected_components, with_least
from docuforge.llm.decontaminate import contaminated, with_simhash, without_contaminated
from docuforge.llm.embedding_dedup import embedding_groups
from docuforge.llm.near_copies import keep_first, near_copy_groups
from docuforge.llm.simhash_dedup import fingerprints, linked_fingerprints, simhash_groups

from .conftest import docs

R = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def components(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7)]
    wanted = components({x for a, b in links if a != b for x in (a, b)}, [x for x in links if x[0] != x[1]])
    df = spark.createDataFrame([*links, (None, 3), *links[:5]], "a long, b long")
    found = {x.node: x.component for x in connected_components(df, Scratch(spark, "t")).collect()}
    assert found == wanted
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_few_files_for_few_rows(spark):
    """Many shuffle partitions that nothing coalesces: a table of few rows is still one file, and keys stay distinct."""
    from pyspark.sql import functions as F

    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = connected_components(spark.range(400).selectExpr("id a", "id + 1000 * (id % 2) b"), Scratch(spark, "t"))
        assert len(found.inputFiles()) == 1 and {tuple(x) for x in found.collect()} == {(x, i) for i in range(1, 400, 2) for x in (i, i + 1000)}
        keyed = spark.range(1000).groupBy("id").count().withColumn("key", F.monotonically_increasing_id())
        keyed = Scratch(spark, "t").table(keyed, "keyed", 1000)
        assert len(keyed.inputFiles()) == 1 and keyed.select("key").distinct().count() == 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_least_of_giant_and_small_components(spark):
    rows = [(i, 1 if i < 900 else i // 3) for i in range(1000)] + [(5000, None)]
    df = spark.createDataFrame([(i, c, "x") for i, c in rows], "id long, component long, _known string")
    wanted = {c: min(i for i, d in rows if d == c) for _, c in rows if c is not None}
    found = with_least(df.drop("_known"), Scratch(spark, "t"), "id", "top").collect()
    assert len(found) == len(rows) and all(r.top == wanted.get(r.component) for r in found)


def simhash(text, n=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark):
    base = [" ".join(R.choices(WORDS, k=k)) for k in (3, 4, 5, 200, 400, 900)]
    rows = [(10, None), (11, ""), (12, " \n")]
    for i, t in enumerate(base):
        for v in range(6):
            w = t.split(" ")
            for _ in range(v // 2 * len(w) // 200):
                w[R.randrange(len(w))] = R.choice(WORDS)
            rows.append((100 + 10 * i + v, " ".join(w).upper() if v == 1 else " ".join(w)))
    rows += [(100, rows[3][1]), (999, "ÀÉ x\u00a0y")]
    fp = {i: simhash(t) for i, t in rows}
    wanted = components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    found = simhash_groups(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in found} == {i: (fp[i], wanted[i]) for i in fp}
    assert simhash_groups(docs(spark, [])).count() == 0


def test_very_long_texts(spark):
    """Texts of 30,000 words: fingerprints against brute force, near copies, and a benchmark item inside one."""
    long = R.choices(WORDS, k=30_000)
    changed = [*long]
    for i in R.sample(range(30_000), 300):
        changed[i] = "other"
    item = R.choices(WORDS, k=40)
    other = R.choices(WORDS, k=30_000)
    rows = [(1, " ".join(long)), (2, " ".join(changed)), (3, " ".join([*other, *item, *other[:50]])), (4, " ".join(other)), (5, "one" * 30_000), (6, None), (7, "")]
    assert {r.doc_id: r.fp % (1 << 64) for r in simhash_groups(docs(spark, rows)).collect()} == {i: simhash(t) for i, t in rows}
    assert {r.doc_id for r in keep_first(docs(spark, rows)).collect()} >= {1, 3, 5} and {r.doc_id: r.component_id for r in near_copy_groups(docs(spark, rows)).collect()}[2] == 1
    bench = spark.createDataFrame([(9, " ".join(item)), (10, " ".join(R.choices(WORDS, k=2000)))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, round(r.similarity, 9)) for r in contaminated(docs(spark, rows), bench).collect()] == [(3, 9, 1.0)]


def test_links_of_a_crowd(spark):
    """Fingerprints around one centre: a group far above the small size, and pairs at every distance."""
    centre = R.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in R.sample(range(64), R.randrange(8))) for _ in range(600)})
    wanted = components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in linked_fingerprints(df).collect()]
    assert all((a ^ b).bit_count() <= 4 or wanted[a] == wanted[b] for a, b in links)
    assert components(fps, links) == wanted


def test_fingerprints_match_the_seeded_hash_of_spark(spark):
    from pyspark.sql import functions as F

    rows = docs(spark, [(1, "One two"), (2, "a")])
    found = {r.doc_id: r.fp for r in fingerprints(rows).collect()}
    assert found == {r.doc_id: r.h for r in rows.select("doc_id", F.xxhash64(F.lower("text")).alias("h")).collect()}


def test_embeddings(spark):
    g = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = g.normal(size=16)
            for _ in range(8):
                rows.append((n, (centre + g.normal(size=16) * 0.06).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(5)] + [(n + 5, rows[0][1], 1), (n + 6, None, 0), (n + 7, [0.0] * 16, 0), (n + 8, [float("nan")] * 16, 0), (n + 9, [None] * 16, 0), (n + 10, [], 0), (n + 11, [1.0, 2.0], 0), (n + 12, [2.0, 4.0], 0), (n + 13, [float("inf")] * 16, 0)]
    good = [(i, np.array(v, float), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and any(v)]
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and cos(a[1], b[1]) >= 0.98]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r for r in embedding_groups(df, n_pivots=16).collect()}
    wanted = components([r[0] for r in rows], links)
    assert len(links) > 200 and len(found) == len(rows)
    assert sum(r.n_links for r in found.values()) >= 2 * 0.9 * len(links)
    exact = sum(found[i].component_id == wanted[i] for i in wanted)
    assert exact >= 0.9 * len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    assert found[n].n_links >= 5 and found[n + 6].n_links == found[n + 7].n_links == found[n + 8].n_links == 0 and found[n + 12].component_id == n + 11
    assert embedding_groups(df.limit(0)).count() == 0


def test_vectors_of_any_scale_and_many_lengths(spark):
    """Huge and tiny vectors have sound cosines, and every one of 70 lengths finds its links."""
    g = np.random.default_rng(6)
    rows = [(0, [1e200, 2e200], 0), (1, [2e200, 4e200], 0), (2, [1e-200, 2e-200], 0), (3, [1e-200, -2e-200], 0)]
    for d in range(3, 73):
        v = g.normal(size=d)
        rows += [(10 * d, v.tolist(), 0), (10 * d + 1, (v * 3.0).tolist(), 0), (10 * d + 2, (-v).tolist(), 0)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [found[i] for i in range(4)] == [(2, 0), (2, 0), (2, 0), (0, 3)]
    assert all(found[10 * d + k] == ((1, 10 * d), (1, 10 * d), (0, 10 * d + 2))[k] for d in range(3, 73) for k in range(3))


def test_pivots_keep_apart_and_order():
    from docuforge.llm.embedding_dedup import PIVOT_COSINE, _bits, apart, permutations, units

    v = units(np.random.default_rng(1).normal(size=(500, 3)))
    p = apart(v, 40)
    c = p @ p.T
    assert (c[~np.eye(len(p), dtype=bool)] < PIVOT_COSINE).all()
    order = permutations(v, p, 5)
    assert (np.diff(np.take_along_axis(v @ p.T, order, 1), axis=1) <= 0).all()
    assert np.bitwise_count(_bits(order)).sum(1).max() <= 5


def test_long_lists_are_dealt_as_blocks(spark, monkeypatch):
    from docuforge.llm import embedding_dedup

    g = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + g.normal(size=8) * 0.04).tolist(), 0) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    wanted = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(df, n_pivots=4, prefix=4).collect()}
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(df, n_pivots=4, prefix=4).collect()} == wanted
    m = np.array([v for _, v, _ in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert [wanted[i][0] for i in range(120)] == ((m @ m.T >= 0.98).sum(1) - 1).tolist()


def bag_similarity(a, b):
    both = sum(min(a.count(x), b.count(x)) for x in set(a))
    return both / (len(a) + len(b) - both)


def test_benchmark(spark):
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    items = [(i, " ".join(R.choices(WORDS, k=k))) for i, k in enumerate((5, 6, 16, 30, 60))] + [(8, "rep eat " * 12), (9, "too few words"), (10, None), (11, "")]
    items.append((12, items[3][1]))
    rows = [(0, None), (1, ""), (2, "few")]
    for i, (_, t) in enumerate(items[:6]):
        w = t.split()
        changed = [*w]
        changed[len(w) // 2] = "other"
        around = lambda x: " ".join([*R.choices(WORDS, k=20), *x, *R.choices(WORDS, k=15)])
        rows += [(100 + 10 * i, around(w).upper()), (101 + 10 * i, around(changed)), (102 + 10 * i, " ".join(w[:-1])), (103 + 10 * i, around([*w[: len(w) // 2], "new", *w[len(w) // 2 :]])), (104 + 10 * i, around(w[: len(w) // 2]))]
    rows.append((100, rows[3][1]))
    wanted = {}
    for d, t in rows:
        w = (t or "").lower().split()
        for i, x in items:
            s = shingles((x or "").split())
            mine = shingles(w)
            if not s or not mine:
                continue
            k = min(len(s), len(mine))
            best = max(bag_similarity(mine[a : a + k], s) for a in range(len(mine) - k + 1))
            if best >= 0.8:
                wanted[d, i] = round(best, 9)
    df = docs(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in contaminated(df, bench).collect()}
    assert found == wanted and len(wanted) > 10
    assert {r.doc_id for r in without_contaminated(df, bench).collect()} == {d for d, _ in rows} - {d for d, _ in wanted}
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0


def test_simhash_by_bit_planes(spark):
    bags = [[R.getrandbits(63) for _ in range(k)] for k in (1, 2, 3, 10, 33, 63)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bags)], "i int, bag array<bigint>")
    for r in with_simhash(df, "bag", 63, "fp").collect():
        wanted = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in bags[r.i]) > len(bags[r.i]))
        assert r.fp % (1 << 64) == wanted


@pytest.mark.parametrize("crowd", [8, 120])
def test_near_copies(spark, crowd):
    """All pairs of similarity 0.8 or more fall into one group, and no others; crowds above the paired size too."""
    rows, n = [(0, None), (1, ""), (2, "a b"), (3, "A  B"), (4, "a c"), (5, " ")], 6
    for base in ([R.choice(WORDS) for _ in range(k)] for k in (60, 200, 800)):
        for v in range(crowd if len(base) == 200 else 8):
            w = [*base]
            for _ in range(v % 4 * len(base) // 90):
                w[R.randrange(len(w))] = f"new{R.random()}"
            rows.append((n, " ".join(w)))
            n += 1
    rows.append((n, " ".join(R.choice(WORDS) for _ in range(90))))
    rows += [(None, rows[9][1]), (7, rows[7][1])]

    def bag(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    bags = {i: bag(t) for i, t in rows if i is not None}
    links = [(a, b) for a in bags for b in bags if a < b and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b])]
    wanted = components(bags, links)
    found = {r.doc_id: r.component_id for r in near_copy_groups(docs(spark, rows)).collect()}
    assert found.pop(None) == found[9]
    assert all(wanted[i] == wanted[c] for i, c in found.items())
    wrong = [i for i in wanted if found[i] != wanted[i]]
    assert len(wrong) <= 0.05 * len(wanted) and len(links) > 30
    kept = keep_first(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and {r.doc_id for r in kept.collect()} == {None, *found.values()}
    assert near_copy_groups(docs(spark, [])).count() == 0


def test_pairs_in_a_crowd_that_shares_boilerplate(spark):
    """A copy is found though many texts below the threshold lie nearer by fingerprint."""
    r = random.Random(11)
    shared, rows = [f"s{i}" for i in range(400)], []
    for i in range(700):
        own = [f"t{i}x{j}" for j in range(77)]
        rows.append((2 * i, " ".join([*shared, *own])))
        if i % 7 == 0:
            rows.append((2 * i + 1, " ".join([*shared, *own[:35], *(f"u{r.random()}" for _ in range(42))])))
    bags = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    links = [(a, b) for a in bags for b in bags if a < b and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b])]
    wanted = components(bags, links)
    found = {r.doc_id: r.component_id for r in near_copy_groups(docs(spark, rows)).collect()}
    assert all(wanted[i] == wanted[c] for i, c in found.items())
    lost = [(a, b) for a, b in links if found[a] != found[b]]
    assert len(links) == 100 and len(lost) <= 0.05 * len(links)


def test_repeated_passages_do_not_hide_copies(spark):
    """The same shingle set with other repeat counts is a near copy, however often a passage is repeated."""
    r, rows = random.Random(12), []
    for i in range(40):
        w = [f"v{i}x{r.randrange(10**6)}" for _ in range(300)]
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join([*w, *w[-40:] * (2, 3, 5, 10, 20)[i % 5]]))]
    found = {x.doc_id: x.component_id for x in near_copy_groups(docs(spark, rows)).collect()}
    lost = [i for i in found if found[i] != i // 10 * 10]
    assert len(found) == 80 and not lost, f"{len(lost)} of 40 lost"
