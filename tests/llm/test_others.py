"""Mixing, classifier, URL filter, token counts and the pipeline."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docuforge.llm import queries as Q
from docuforge.llm import token_counts as K
from docuforge.llm.mixing import mix, targets
from docuforge.llm.quality_classifier import quality_scores
from docuforge.llm.url_filter import match_rules, mine_rules, url_verdicts


from .conftest import SF, docs

R = random.Random(9)


def filled(sizes, weights, share, cap):
    """Targets by sharing again and again, as the contract words it."""
    open_, left, out = dict(sizes), share * sum(sizes.values()), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = {s: n for s, n in open_.items() if s not in over}
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 900, "d": 40, None: 7}, {"a": 1}, {"a": 0, "b": 10}, {"x": 10, "y": 10, "z": 10, "é": 1000}])
def test_targets(spark, sizes):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in targets(df, (5, 2, 1), 1.5, 2).collect()}
    assert found == pytest.approx(filled(sizes, weights, 1.5, 2))


def test_mix(spark):
    rows = [(i, " ".join(["w"] * R.randrange(60)), R.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)] + [(5000, None, "a"), (5001, "", "b"), (None, "no id here", "c"), (1, "again", "a"), (1, "again", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix(df, keep=["source"]).collect()
    assert len(found) == len(rows) and sorted(map(str, found)) == sorted(map(str, mix(df.repartition(7), keep=["source"]).collect()))
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in found:
        assert r.size == 0 or (r.taken % r.size == 0 and r.taken <= 2 * r.size)
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = (r.target, r.source_size)
    for s, (t, n) in target.items():
        assert size[s] == n and abs(taken[s] - t) <= 30
    assert sum(t for t, _ in target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert mix(df.limit(0)).count() == 0


def test_better_documents_are_taken_first(spark):
    rows = [(i, ("good words here " if i % 2 else "1!| 2$% 3&*# ") * 5, "a") for i in range(2000)] + [(9000, "w " * 60000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, weights=(1, 9), total_share=0.9).where("doc_id < 9000").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("taken").alias("n")).collect()
    n = {r.good: r.n for r in got}
    assert n[1] > 2 * n[0] > 0


def test_key_parts_are_level_at_every_weight(spark):
    from docuforge.llm.mixing import key_part

    for w in (1.0, 0.36, 0.05):
        most = spark.range(300_000).select(key_part(-F.log(F.rand(1)) / w).alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
        assert most <= 3 * 300_000 / 5461
    keys = [r.p for r in spark.range(2000).select(key_part(F.col("id") / 10.0).alias("p")).collect()]
    assert keys == sorted(keys)


def test_selection_against_brute_force(spark):
    """Whole epochs, then rows in key order until the budget is met, as Efraimidis and Spirakis sample."""
    from docuforge.llm.mixing import quality_weight

    r = random.Random(21)
    rows = [(i, " ".join(r.choices(["w", "1!| 2$%", "ok"], k=r.randrange(40))), r.choice("aabc")) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(42)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    key = {x.doc_id: x.k for x in df.select("doc_id", (-F.log(u) / quality_weight(F.col("text"))).alias("k")).collect()}
    found = {x.doc_id: x for x in mix(df, keep=["source"]).collect()}
    for source in "abc":
        mine = sorted((x for x in found.values() if x.source == source), key=lambda x: key[x.doc_id])
        epochs = int(mine[0].target / mine[0].source_size + 1e-9)
        rest, upto = mine[0].target - epochs * mine[0].source_size, 0
        for x in mine:
            upto += x.size
            assert x.taken == x.size * (epochs + (upto - x.size / 2 <= rest))


def test_names_that_clash_in_the_mix(spark):
    rows = spark.createDataFrame([(1, "a b", "s", 7, 8, 9, 10, 11)], "doc_id long, text string, source string, size int, TAKEN int, target int, `a.b` int, source_size int")
    found = mix(rows, keep=[c for c in rows.columns if c != "doc_id"])
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken", "text", "source", "size_", "TAKEN_", "target_", "a.b", "source_size_"]
    assert tuple(found.first())[5:] == ("a b", "s", 7, 8, 9, 10, 11)


def test_nearest_takes_the_first_of_equals():
    import numpy as np

    from docuforge.llm.quality_classifier import nearest

    c = np.random.default_rng(1).integers(0, 4, (60, 30)).astype(np.float32)
    assert (nearest(c, 7) == np.sort(np.argsort(-c, axis=1, kind="stable")[:, :7], 1)).all()


def test_classifier_votes_against_brute_force(spark):
    """Scores are the votes of the nearest labelled vectors, each weighed by its cosine."""
    import numpy as np
    import pyarrow as pa

    from docuforge.llm.common import text_buffers
    from docuforge.llm.quality_classifier import features, fit

    r = random.Random(3)
    texts = {i: " ".join(r.choices(["good", "words", "all", "over"] if i % 3 else ["junk", "junk", "x9x"], k=r.randrange(1, 60))) for i in range(200)}
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 150)], "doc_id long, quality int")
    df = docs(spark, list(texts.items()))
    model = fit(df, labels, k=9, dims=8)
    found = {x.doc_id: x.score for x in quality_scores(df, labels, k=9, dims=8).collect()}
    trained = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5]
    for i, t in texts.items():
        v = (features(*text_buffers(pa.array([t]))) * model.idf) @ model.axes
        cosine = (v / np.linalg.norm(v) @ model.vectors.T)[0]
        best = np.argsort(-cosine, kind="stable")[:9]
        w = np.maximum(cosine[best], 0)
        share = sum(x * (trained[b] % 3 > 0) for b, x in zip(best, w))
        prior = sum(j % 3 > 0 for j in trained) / len(trained)
        assert abs(found[i] - (share + 1e-3 * prior) / (w.sum() + 1e-3)) < 1e-2


def test_classifier_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    found = Q.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = {q: [r.predicted == q for r in found if r.quality == q] for q in (0, 1)}
    assert sum(right[1]) > 0.99 * len(right[1]) and sum(right[0]) > 0.6 * len(right[0])
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)


def test_classifier_on_odd_rows(spark):
    rows = docs(spark, [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "abc")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(rows, none).collect()} == {0.5}
    labels = spark.createDataFrame([(3, 1), (3, 0), (1, None), (None, 1), (77, 1)], "doc_id long, quality int")
    assert quality_scores(rows, labels).count() == 5 and quality_scores(rows.limit(0), labels).count() == 0


def test_classifier_on_very_long_texts(spark):
    good, bad = (" ".join(R.choices([f"{k}{i}" for i in range(50)], k=30_000)) for k in ("good", "bad"))
    rows = [(i, " ".join(R.choices([f"{'good' if i % 2 else 'bad'}{j}" for j in range(50)], k=40))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    found = {r.doc_id: (r.score, r.predicted) for r in quality_scores(docs(spark, [*rows, (900, good), (901, bad), (902, good)]), labels).collect()}
    # Batches of other shapes may differ in the last digits of single-precision products.
    assert found[900][0] == pytest.approx(found[902][0], abs=1e-6)
    assert [found[i][1] for i in (900, 901, 902)] == [1, 0, 1]


def test_mix_with_a_very_long_text(spark):
    rows = docs(spark, [(1, "w " * 100_000), (2, "a b c"), (3, None), (4, "x" * 300_000)])
    assert {r.doc_id: r["size"] for r in mix(rows).collect()} == {1: 100_000, 2: 3, 3: 0, 4: 1}


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Net/x?y", "a.net", "/x", "net/", "block"), ("https://net/", "net", "/", "net/", "block"), ("http://a.net", "a.net", "", None, "allow"), ("http://x.example.net/en/1#f", "x.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://myexample.net/en/1", "myexample.net", "/en/1", "net/", "block"), ("ftp://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("http://example.com/de", "example.com", "/de", None, "allow"), ("x://y.org/fr/#://z", "y.org", "/fr/", "org/fr/", "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://x.net?q=/a", "x.net", "", None, "allow"), ("http://ÀB.net:80/\n/x", "Àb.net:80", "/\n/x", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "h"), (1, url, "h")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in url_verdicts(pages, labels, RULES).collect()] == [(1, host, path, rule, verdict)] * 2


def test_mined_rules(spark):
    urls = [(i, f"http://{'bad' if i % 4 == 0 else 'ok'}{'-pills' if i % 8 == 0 else ''}.example.com/{'x' if i % 3 else 'y'}/{i}") for i in range(400)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(300)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    found = url_verdicts(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), RULES).collect()
    assert all((r.verdict == "block") == (r.page_id % 4 == 0) for r in found)
    assert url_verdicts(pages.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), RULES).count() == 0


def test_rules_are_pruned_and_matched(spark):
    baskets = [(["a", "b"], True)] * 6 + [(["a", "c"], False)] * 4 + [(["d"], True)]
    rules = mine_rules(spark.createDataFrame(baskets, "items array<string>, blocked boolean"), 0.2, 0.6, 3)
    assert [x for x, _, _ in rules] == [("b",), ("a",)]  # ("a", "b") adds nothing to ("b",)
    assert rules[0][1:] == (6 / 11, 1.0)
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, []), (4, None)], "i int, t array<string>")
    assert [r["_mined"] for r in match_rules(rows, [(("a", "b"), 1.0, 1.0)], "t").orderBy("i").collect()] == [True, False, False, False]


def test_rules_of_many_tokens(spark):
    """Four tokens together imply block; no three of them do."""
    steps, pages = ["w", "x", "y", "z"], []
    for n in range(6):
        pages.append((len(pages), "http://h.com/w/x/y/z", 0))
    for out in steps:
        pages += [(len(pages) + n, "http://h.com/" + "/".join(s for s in steps if s != out), 1) for n in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, quality int")
    labels = df.select(F.col("page_id").alias("doc_id"), "quality", F.lit(0).alias("toxic"))
    found = url_verdicts(df.select("page_id", "url"), labels, RULES).collect()
    assert {r.page_id for r in found if r.verdict == "block"} == set(range(6))


def test_mined_rules_against_all_combinations(spark):
    from itertools import combinations

    r = random.Random(8)
    baskets = []
    for _ in range(160):
        bad = r.random() < 0.5
        x = {t for t in "abcdefg" if r.random() < (0.55 if bad else 0.35)} | ({"x", "twin"} if bad and r.random() < 0.6 else set())
        baskets.append((sorted(x), bad))
    least, n = 8, len(baskets)
    counts = {}
    for k in range(1, 8):
        for c in combinations("abcdefgx", k):  # "twin" always comes with "x": they are one item, named "twin"
            c = tuple(sorted("twin" if t == "x" else t for t in c))
            held = [b for x, b in baskets if set(c) <= set(x)]
            if sum(held) >= least and sum(held) / len(held) >= 0.6:
                counts[c] = (sum(held), sum(held) / len(held))
    wanted = {c: (h / n, s) for c, (h, s) in counts.items() if not any(set(d) < set(c) and t >= s for d, (_, t) in counts.items())}
    found = mine_rules(spark.createDataFrame(baskets, "items array<string>, blocked boolean"), 0.05, 0.6, min_count=least)
    assert {x: (pytest.approx(a), pytest.approx(c)) for x, a, c in found} == wanted and len(wanted) > 5


def test_very_long_urls_end(spark):
    long = "/".join(f"s{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200))
    pages = [(i, f"http://h{'x' * (i % 3)}.com/{long}/{'q/' * (i % 2)}" + "/".join(f"v{chr(97 + j)}" for j in range(i % 5, 24))) for i in range(12)] + [(50 + i, f"http://ok.org/{chr(97 + i)}") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 50 else 1, 0) for i, _ in pages], "doc_id long, quality int, toxic int")
    found = {r.page_id: r.verdict for r in url_verdicts(df, labels, RULES).collect()}
    assert all((v == "block") == (i < 50) for i, v in found.items())


def test_rules_of_items_that_alone_are_unsure(spark, monkeypatch):
    """Two tokens together imply block; twenty others of the same URLs are surer alone, and no rules."""
    noise, rows = [f"n{chr(97 + i)}" for i in range(20)], []
    rows += [(["p", "q", *(t for t in noise if r != t)], True) for r in noise]
    rows += [([x, *noise], False) for x in "pq" for _ in range(25)] + [([x], False) for x in "pq" for _ in range(100)]
    rules = mine_rules(spark.createDataFrame(rows, "items array<string>, blocked boolean"), 0.0, 0.5, min_count=10)
    assert rules == [(("p", "q"), 20 / len(rows), 1.0)]
    pages = spark.createDataFrame([(i, "http://h.com/" + "/".join(x), b) for i, (x, b) in enumerate(rows)], "page_id long, url string, b boolean")
    labels = pages.select(F.col("page_id").alias("doc_id"), F.when(F.col("b"), 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    for bound in (10_000, 0):  # rules broadcast, rules joined
        monkeypatch.setattr("docuforge.llm.url_filter.BROADCAST_RULES", bound)
        found = url_verdicts(pages.drop("b"), labels, RULES, min_count=10).collect()
        assert {r.page_id for r in found if r.verdict == "block"} == set(range(20))


def test_all_rules_are_kept(spark):
    labelled = spark.range(50_500).selectExpr("array(concat('t', id % 10100)) items", "true blocked")
    assert len(mine_rules(labelled, 0.0, 0.5)) == 10_100


def test_mined_rules_and_verdicts_of_long_urls_against_all_combinations(spark):
    """Sixteen tokens, about thirteen a URL: every one of the 65,535 combinations is counted."""
    r, least, baskets = random.Random(1), 5, []
    names = [chr(97 + i) for i in range(16)]
    for _ in range(70):
        bad = r.random() < 0.4
        baskets.append(([t for t in names if r.random() < (0.88 if bad else 0.8)], bad))
    masks = [(sum(1 << names.index(t) for t in x), b) for x, b in baskets]
    counts = {}
    for m in range(1, 1 << 16):
        held = [b for x, b in masks if x & m == m]
        if (hits := sum(held)) >= least and hits / len(held) >= 0.6:
            counts[m] = (hits, hits / len(held))
    best = {}
    for m in sorted(counts, key=int.bit_count):
        if not any(d & m == d and s >= counts[m][1] for d, (_, s) in best.items()):
            best[m] = counts[m]
    wanted = {tuple(t for i, t in enumerate(names) if m >> i & 1): (h / len(baskets), s) for m, (h, s) in best.items()}
    df = spark.createDataFrame(baskets, "items array<string>, blocked boolean")
    assert {x: (a, c) for x, a, c in mine_rules(df, 0.0, 0.6)} == wanted and len(wanted) == 47
    pages = spark.createDataFrame([(i, "http://9/" + "/".join(x)) for i, (x, _) in enumerate(baskets)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if b else 1, 0) for i, (_, b) in enumerate(baskets)], "doc_id long, quality int, toxic int")
    found = {r.page_id: r.verdict for r in url_verdicts(pages, labels, RULES, min_support=0.0, min_confidence=0.6).collect()}
    assert all((found[i] == "block") == any(x & m == m for m in best) for i, (x, _) in enumerate(masks))


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


TEXTS = ["", "a", "Hello, WORLD's 123", "e\u0301 \u0301x", "<|endoftext|> a<|startoftext|>b", "x\u00a0y\u2003z\x1cq", "don't  \t stop", "日本語 テキスト", "a" * 3000, "İ ß ǅ", "12 345 6", "'s 't", "\u0085 a"]


def test_token_counts(spark, tokenizer_path):
    t = K.load(tokenizer_path)
    rows = [(i, x) for i, x in enumerate([*TEXTS, " ".join(TEXTS), "w x1 " * 9000, ("né'll? " * 30 + "\n") * 200])]
    found = K.token_counts(docs(spark, [*rows, (99, None)]), tokenizer_path, chunk=700, overlap=60).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in found} == {i: (len(x.encode()), n := len(t.encode(x, add_special_tokens=False)), n > 2048) for i, x in rows} | {99: (0, 0, False)}
    assert K.token_counts(docs(spark, []), tokenizer_path).count() == 0


def test_splicing(tokenizer_path):
    t = K.load(tokenizer_path)
    for x in ["a" * 5000, "a b" * 3000, "e\u0301 " * 3000, "<|endoftext|>" * 700, "x's 12 " * 1500, " " * 5000, "\u00a0".join(["ab"] * 2000), *(" ".join(R.choices(TEXTS[2:8], k=300)) for _ in range(5))]:
        for chunk, overlap in ((300, 16), (1000, 100)):
            assert K.count_huge(t, x, chunk, overlap) == len(t.encode(x, add_special_tokens=False))


def test_splicing_without_white_space(tokenizer_path, monkeypatch):
    """Text without ASCII white space is spliced where kinds of signs change; no call encodes it all."""
    t, calls, plain = K.load(tokenizer_path), [], K._spans
    monkeypatch.setattr(K, "_spans", lambda tok, x, a, b: calls.append(b - a) or plain(tok, x, a, b))
    for x in ["日本語の文章です。" * 600, "abc\u3000def\u00a0" * 600, "1234567890" * 500, "'s!x'll" * 700]:
        assert K.count_huge(t, x, 400, 40) == len(t.encode(x, add_special_tokens=False))
    assert max(calls) < 1000


def test_splicing_of_mixed_signs(tokenizer_path):
    """Marks that compose, special strings, apostrophes and Hangul parts next to any kind of sign."""
    t, r = K.load(tokenizer_path), random.Random(11)
    signs = ["a", "S", "'", "'s", "'ll", "1", "½", "!", "。", "日", "İ", "\u0301", "\u0307", " ", "\u3000", "\u1100", "\u1161", "\u11a8", "가", "<|endoftext|>", "<|", "|>", "endoftext", "😀", "\u200d", "\u0bbe", "\u0bc6"]
    for _ in range(100):
        x = "".join(r.choices(r.sample(signs, r.randint(2, 8)), k=r.randint(50, 300)))
        assert K.count_huge(t, x, 60, 20) == len(t.encode(x, add_special_tokens=False)), x


def test_memo_starts_anew(spark, tokenizer_path, monkeypatch):
    t = K.load(tokenizer_path)
    monkeypatch.setattr(K, "REMEMBERED", 5)
    memo = K._learn(t, {b"old": 9}, {b"a", b"b", b"running"})
    assert memo.keys() == {b"old", b"a", b"b", b"running"}
    memo = K._learn(t, memo, {b"a", b"c", b"d", b"e"})
    assert memo.keys() == {b"a", b"c", b"d", b"e"}


def test_pipeline(spark):
    import corpus_pipeline as P

    from docuforge.llm.decontaminate import contaminated
    from docuforge.llm.near_copies import near_copy_groups
    from docuforge.llm.substring_dedup import substring_dedup

    sf = SF.replace("0.001", "0.01")
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("extra", "_score", "_row", "kept_text", "_leak", "_gone"):  # names that stages use inside
        docs_ = docs_.withColumn(name, F.lit(1))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "mixing sources"]
    kept = [docs_.cache()]
    for _, f in P.STAGES:
        kept.append(f(spark, kept[-1], sf).cache())
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(a > b for a, b in zip(ids, ids[1:]) if a != b) and all(k.columns == docs_.columns for k in kept[:-1])
    assert ids[0] > ids[1] and not ((ids[0] - ids[1]) & {r.doc_id for r in labels.where("quality = 1").collect()})
    assert ids[2] == {r.component_id for r in near_copy_groups(kept[1]).collect()}
    cut = {r.doc_id: r.kept_text for r in substring_dedup(kept[2]).where("n_removed > 0").collect()}
    assert {r.doc_id: r.text for r in kept[3].collect() if r.doc_id in cut} == {i: t for i, t in cut.items() if t}
    assert all(r.n_chars == len(r.text) for r in kept[3].collect())
    assert ids[3] - ids[4] == {r.doc_id for r in contaminated(kept[3], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert all(r.taken > 0 for r in kept[5].collect()) and P.run(spark, sf).count() == len(ids[5])
