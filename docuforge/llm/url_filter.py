"""URL filters: stated host and path rules first, then association rules mined from labelled URLs.

Labelled URLs become token sets; FP-growth, dealt out by item, grows the token combinations that are
frequent among blocked ones from each item's conditional database; those that imply the class "block" with
enough support and confidence, and are no extension of a rule at least as confident, become rules.  An
inverted index from tokens to rules matches them: a rule holds where all of its tokens are found.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuforge.llm.common import Scratch
from docuforge.llm.near_copies import _runs

#: Items up to which they are broadcast (about 60 bytes each).
BROADCAST_ITEMS = 100_000
#: Rules up to which their index is broadcast; more are joined.
BROADCAST_RULES = 10_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host/path) that fits, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: its host labels, its words in host labels and its path segments, digits as 0."""
    plain = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host="), plain(x)))
    words = F.transform(F.split(host, r"[^a-z]+"), lambda x: F.concat(F.lit("word="), x))
    steps = F.transform(F.split(F.lower(path), "/+"), lambda x: F.concat(F.lit("path="), plain(x)))
    return F.array_distinct(F.filter(F.concat(labels, words, steps), lambda x: ~x.isin("host=", "word=", "path=")))


def _grown(least: int, confidence: float, longest: int | None, shortest: bool):
    """Per item, its conditional database grown into rules of two items or more."""

    def longer(x, hit, miss, row, col):
        """Extensions of ``x`` by one item that are worth it, with their URLs: ``hit`` and ``miss`` count them, ``row`` and ``col`` list their later items."""
        items, at = np.unique(col, return_inverse=True)
        hits, misses = np.bincount(at, hit[row], len(items)), np.bincount(at, miss[row], len(items))
        # An item that all misses hold makes neither x nor any extension of x surer.
        useful = (hits >= least) & (misses < miss.sum())
        row, at = row[useful[at]], at[useful[at]]
        for j in np.flatnonzero(useful).tolist():
            held = np.zeros(len(hit), bool)
            held[row[at == j]] = True
            later = held[row] & (at > j)
            yield (*x, items[j]), hit[held], miss[held], (np.cumsum(held) - 1)[row[later]], items[at[later]]

    def grow(*start):
        path = [longer(*start)]
        while path:  # depth first: one database for each item of the set in hand
            found = next(path[-1], None)
            if found is None:
                path.pop()
                continue
            x, hit, miss, row, _ = found
            hits, misses = int(hit.sum()), int(miss.sum())
            rule = hits / (hits + misses) >= confidence
            if rule:
                yield x, hits, hits + misses
            if len(row) and misses and not (rule and shortest) and (longest is None or len(x) < longest):
                path.append(longer(*found))

    def run(batches):
        for item, rest, hit, miss in _runs(batches, 1):
            rest = pa.concat_arrays(rest.chunks)
            row = np.repeat(np.arange(len(rest)), pa.compute.list_value_length(rest).to_numpy(zero_copy_only=False))
            grown = grow((item[0].as_py(),), hit.to_numpy(), miss.to_numpy(), row, rest.flatten().to_numpy(zero_copy_only=False))
            while some := list(islice(grown, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.list_(pa.int64()), pa.int64(), pa.int64()))], names=["x", "hits", "n"])

    return run


def _mined(labelled: DataFrame, min_support: float, min_confidence: float, max_tokens: int | None, min_count: int, shortest: bool) -> tuple[DataFrame, int] | None:
    """(x, rarest, hits, n) of every rule that can be surer than the rules it extends, and the number of labelled URLs; None without rules.

    With ``shortest`` no rule is extended: what an extension holds on, the rule holds on.
    """
    scratch = Scratch(labelled.sparkSession, "rules")
    base = scratch.table(labelled.select(F.monotonically_increasing_id().alias("b"), "items", F.col("blocked").cast("int").alias("blocked")).where("blocked is not null"), "labelled")
    n, n_blocked = base.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    least = max(math.ceil(min_support * n), min_count, 1)
    if n_blocked < least:
        return None
    each = base.select("b", "blocked", F.explode(F.array_distinct("items")).alias("t"))
    prints = [F.bit_xor(F.xxhash64("b", F.lit(k))).alias(f"p{k}") for k in (1, 2)]
    tokens_ = each.groupBy("t").agg(F.count("*").alias("n"), F.sum("blocked").alias("hits"), *prints).where(F.col("hits") >= least)
    items = tokens_.groupBy("n", "hits", "p1", "p2").agg(F.min("t").alias("t")).orderBy("n", "t")
    items = scratch.table(items.select(F.monotonically_increasing_id().alias("i"), "t", "n", "hits", (F.col("hits") / F.col("n")).alias("sure")), "items")
    n_items = items.count()
    if not n_items:
        return None
    single = items.where(F.col("sure") >= min_confidence).select(F.array("i").alias("x"), "hits", "n")
    # Items are numbered from the rarest.  An item's conditional database has the later items of the URLs that hold it,
    # equal ones merged, so that of a frequent item is small.
    grown = items.where(F.col("sure") < min_confidence) if shortest else items
    grown = F.broadcast(grown) if n_items <= BROADCAST_ITEMS else grown.hint("merge")
    baskets = each.join(grown.select("t", "i"), "t").groupBy("b", "blocked").agg(F.sort_array(F.collect_list("i")).alias("x"))
    baskets = baskets.groupBy("x").agg(F.sum("blocked").alias("hit"), F.sum(1 - F.col("blocked")).alias("miss"))
    bases = baskets.select("x", "hit", "miss", F.posexplode("x").alias("at", "i")).select("i", F.slice("x", F.col("at") + 2, F.size("x")).alias("rest"), "hit", "miss")
    bases = bases.groupBy("i", "rest").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss"))
    if max_tokens is None or max_tokens > 1:
        found = bases.repartition("i").sortWithinPartitions("i").mapInArrow(_grown(least, min_confidence, max_tokens, shortest), "x array<bigint>, hits bigint, n bigint")
        single = single.union(found)
    sets = scratch.table(single.withColumn("r", F.monotonically_increasing_id()), "sets")
    named = sets.select("r", "hits", F.col("n").alias("all"), F.explode("x").alias("i")).join(items.select("i", "t"), "i")
    named = named.groupBy("r").agg(F.sort_array(F.collect_list("t")).alias("x"), F.min_by("t", "i").alias("rarest"), F.first("hits").alias("hits"), F.first("all").alias("n"))
    return scratch.table(named.drop("r"), "rules"), n


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, max_tokens: int | None = None, min_count: int = 5) -> list[tuple[tuple[str, ...], float, float]]:
    """(tokens, support, confidence) of the rules "tokens imply block", most confident first.

    ``labelled`` has ``items`` and ``blocked``.  A rule needs ``min_support`` of all labelled URLs and
    ``min_count`` of them, as blocked ones.  Tokens that occur in exactly the same labelled URLs are one
    item, named by the smallest.  All items of all URLs are combined and all rules are returned; rules may have
    any number of tokens, or ``max_tokens`` at most if that is given.  A set is grown as long as enough
    blocked URLs hold it and each item takes URLs that are not blocked away, since nothing else makes a rule surer;
    time and rules grow with the number of such sets.  Without labels there are no rules.
    """
    mined = _mined(labelled, min_support, min_confidence, max_tokens, min_count, False)
    if mined is None:
        return []
    rules, n = mined
    # Pruning: a longer rule stays only if it is surer than every rule it extends.
    index: dict[str, list[int]] = defaultdict(list)
    out: list[tuple[tuple[str, ...], float, float]] = []
    for r in sorted(rules.collect(), key=lambda r: (len(r.x), r.x)):
        sure, seen = r.hits / r.n, Counter(i for t in r.x for i in index[t])
        if not any(k == len(out[i][0]) and out[i][2] >= sure for i, k in seen.items()):
            for t in r.x:
                index[t].append(len(out))
            out.append((tuple(r.x), r.hits / n, sure))
    return sorted(out, key=lambda r: (-r[2], -r[1], r[0]))


def match_rules(rows: DataFrame, rules: list[tuple[tuple[str, ...], float, float]], items_col: str) -> DataFrame:
    """``rows`` with ``_mined``: whether the tokens hold all tokens of a mined rule, by an inverted index."""
    index: dict[str, list[int]] = defaultdict(list)
    for i, (x, _, _) in enumerate(rules):
        for token in x:
            index[token].append(i)
    if not rules:
        return rows.withColumn("_mined", F.lit(False))
    shared, need = rows.sparkSession.sparkContext.broadcast(dict(index)), [len(x) for x, _, _ in rules]
    at = rows.columns.index(items_col)

    def holds(found: list[str] | None) -> bool:
        seen: dict[int, int] = defaultdict(int)
        for token in found or ():
            for i in shared.value.get(token, ()):
                seen[i] += 1
                if seen[i] == need[i]:
                    return True
        return False

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([holds(x) for x in batch.column(at).to_pylist()], pa.bool_())], names=[*batch.schema.names, "_mined"])

    return rows.mapInArrow(run, rows.withColumn("_mined", F.lit(True)).schema)


def _joined_rules(rows: DataFrame, rules: DataFrame, items_col: str) -> DataFrame:
    """As ``match_rules``, for any number of rules: distinct token sets meet a rule by its rarest token."""
    sets = rows.select(F.col(items_col).alias("_set")).distinct()
    met = sets.select("_set", F.explode("_set").alias("rarest")).join(rules.select("x", "rarest").hint("merge"), "rarest").where(F.size(F.array_except("x", "_set")) == 0)
    met = met.select("_set").distinct().withColumn("_mined", F.lit(True)).hint("merge")
    return rows.join(met, rows[items_col] == met["_set"], "left").drop("_set").withColumn("_mined", F.coalesce("_mined", F.lit(False)))


def url_verdicts(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    label_id_col: str = "doc_id",
    blocked: Column | None = None,
    min_support: float = 0.0005,
    min_confidence: float = 0.5,
    max_tokens: int | None = None,
    min_count: int = 5,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    A url that is null or has no ``://`` has empty host and path; no rule fits it and it is
    allowed.  Repeated rows are judged alike.  Labels of ids without a page, and null
    labels, teach nothing; an id labelled twice is blocked if any of its labels says so.  Mined rules are those of
    ``mine_rules``; verdicts need only the shortest of them.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parts = parts.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.select("*", stated_rule(F.col("host"), F.col("path"), rules).alias("rule"), tokens(F.col("host"), F.col("path")).alias("_items"))
    blocked = (F.col("quality") == 0) | (F.col("toxic") == 1) if blocked is None else blocked
    marks = labels.select(F.col(label_id_col).alias("_id"), blocked.alias("blocked")).where("_id is not null and blocked is not null").groupBy("_id").agg(F.max("blocked").alias("blocked"))
    labelled = parts.where(F.size("_items") > 0).join(marks, parts.page_id == marks["_id"]).select(F.col("_items").alias("items"), "blocked")
    mined = _mined(labelled, min_support, min_confidence, max_tokens, min_count, True)
    if mined is not None and mined[0].count() > BROADCAST_RULES:
        judged = _joined_rules(parts, mined[0], "_items")
    else:
        judged = match_rules(parts, [] if mined is None else [(tuple(r.x), r.hits / mined[1], r.hits / r.n) for r in mined[0].collect()], "_items")
    verdict = F.when(F.col("_mined"), F.lit("block")).otherwise(F.lit("allow"))
    for v, rule in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
