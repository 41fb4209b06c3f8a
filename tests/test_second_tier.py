"""Derivations, reuse, reading state, merging, links and leases."""

import random

import pytest
from pyspark.sql import functions as F

from archivolt.operators import documents as d


def test_derivations_and_reuse(spark):
    schema = "id int, text string, summary string, key_points array<string>, topics array<struct<name string, confidence double>>, tags array<struct<name string, confidence double>>, evergreen_score int, citations array<struct<claim string, excerpt string>>"
    rows = [(1, "one two  three", "s", [], [], [], 3, [("c", "two three")]), (2, None, " ", ["x"] * 11, [("a", 2.0)], [], 9, [("c", "no")])]
    got = {(r.id, r.reason) for r in d.derivation_failures(spark.createDataFrame(rows, schema), "id", "text").collect()}
    assert got == {(2, x) for x in ("summary", "key_points", "evergreen_score", "confidence", "excerpt")}
    schema = "id int, source_hash string, kind string, prompt string, policy string, normalised_hash string"
    wanted = spark.createDataFrame([(1, "s", "k", "p", "q", "n"), (2, "s", "k", "p", "q", "m"), (3, "z", "k", "p", "q", "n")], schema)
    derived = spark.createDataFrame([(k, "s", "k", "p", "q", "n") for k in (1, 2, 3)], schema)
    assert {r.id: r.decision for r in d.reuse(wanted, derived, "id").collect()} == {1: "reuse", 2: "stale", 3: "derive"}


def test_state_merge_links(spark):
    marks = spark.createDataFrame([(1, "read", "human", 1), (1, "new", "ai", 9), (2, "new", "ai", 2), (2, "old", "ai", 1)], "id int, state string, origin string, at int")
    assert {r.id: r.state for r in d.reading_state(marks, "id", "at").collect()} == {1: "read", 2: "new"}
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, None, 3)], "id int, v string, at int")
    assert d.merged(rows, "id", "v", "at", "survivor").first().v == "a" and d.merged(rows, "id", "v", "at", "newest_reviewed").first().v == "b"
    with pytest.raises(Exception, match="conflicting"):
        d.merged(rows, "id", "v", "at", "reject").collect()
    page = lambda *names: spark.createDataFrame([(n,) for n in names], "page string")
    links = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z")], "source string, target string")
    assert {r.target: r.state for r in d.broken_links(links, page("x"), page("y")).collect()} == {"y": "creatable", "z": "broken"}
    recall = lambda *r: spark.createDataFrame([("semantic", r[0]), ("lexical", r[1])], "kind string, recall double")
    assert d.adopt(recall(0.5, 0.9), recall(0.7, 0.89)).first().adopt and not d.adopt(recall(0.5, 0.9), recall(0.7, 0.8)).first().adopt
    report = d.index_report(spark.createDataFrame([("created",), ("unchanged",), ("absent",), ("source_changed",)], "change string"), 2).first()
    assert tuple(report) == (5, 3, 1, 1, 1, 1, 0, 2, 2)


def test_leases_and_relations(spark):
    rows = [(1, "2024-01-01 00:00:00", "claim"), (2, "2024-01-01 00:50:00", "claim"), (3, "2024-01-01 00:00:00", "claim"), (3, "2024-01-01 00:01:00", "done"), *[(4, f"2024-01-01 00:0{k}:00", "claim") for k in range(3)]]
    events = spark.createDataFrame(rows, "job int, at string, kind string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.job: r.state for r in d.leases(events, "job", "at", "kind", F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()}
    assert got == {1: "ready", 2: "leased", 3: "done", 4: "dead"}
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id int, t string")
    relations = spark.createDataFrame([(1, 2, "supports", "beta"), (1, 2, "supports", "no"), (1, 1, "supports", "beta"), (1, 2, "odd", "beta")], "a int, b int, kind string, evidence string")
    assert d.valid_relations(relations, docs, "id", "t", ("supports",)).count() == 1


def test_related_by_time_against_all_pairs(spark):
    """The nearest of each row, with many rows in one second, ties, nulls and a bound on both sides."""
    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), rng.choice([7, 7, 7, rng.randint(0, 400)])) for k in range(150)] + [(900, None, 7), (901, "a", None)]
    df = spark.createDataFrame(rows, "k bigint, c string, s bigint")
    got = {tuple(r) for r in d.related_by_time(df.unionByName(df.limit(3)), "k", "c", F.col("s"), 50, 4).collect()}
    want = set()
    for k, c, s in rows:
        near = sorted((abs(s - t), j) for j, e, t in rows if c and c == e and j != k and s is not None and t is not None and abs(s - t) <= 50)
        want |= {(k, j, gap) for gap, j in near[:4]}
    assert got == want
    assert d.related_by_time(df.limit(0), "k", "c", F.col("s"), 50).count() == 0


def test_nearest_in_blocks(spark):
    rng = random.Random(6)
    rows = [(k, [rng.random() - 0.5 for _ in range(5)]) for k in range(60)] + [(60, None), (61, [0.0] * 5), (62, [1.0])]
    df = spark.createDataFrame(rows, "k bigint, v array<double>")
    one = sorted(tuple(r) for r in d.neighbours(df, "k", "v", 3, 2).collect())
    assert one == sorted(tuple(r) for r in d.neighbours(df, "k", "v", 3, 2, 4).collect()) and len(one) == 30 * 3
    assert d.neighbours(df.limit(0), "k", "v", 3).count() == 0


def test_hash_of_many_rows(spark):
    df = spark.range(300_000).select(F.col("id").cast("string").alias("k"))
    assert int(d.logical_hash(df, "k").first().hash) > 1 << 63
    assert tuple(d.logical_hash(df.limit(0), "k").first()) == (0, "0")


def test_review_excludes_and_spreads(spark):
    rows = [(k, "t" if k < 6 else f"u{k}", k % 3, "read" if k % 5 == 0 else None) for k in range(12)]
    df = spark.createDataFrame(rows, "k int, topic string, p int, state string")
    made = d.daily_review(df, "k", "topic", [F.col("p")], "2026-07-12", F.col("state") == "read").orderBy("rank").collect()
    assert len(made) == 5 and [r["rank"] for r in made] == [1, 2, 3, 4, 5] and not any(r.k % 5 == 0 for r in made)
    assert sum(r.topic == "t" for r in made) <= 2 and [r.k % 3 for r in made] == sorted(r.k % 3 for r in made)
    other = d.daily_review(df, "k", "topic", [F.lit(0)], "2026-07-13").collect()
    assert len(other) == 5


def test_ranked_search_and_links(spark):
    docs = spark.createDataFrame([(1, "The Binary trie join", "a"), (2, "a trie", "a"), (3, "trie", "b"), (4, None, "a")], "id int, t string, s string")
    asked = spark.createDataFrame([("TRIE binary",)], "query string")
    got = {r.id: (r.score, r.snippet) for r in d.ranked_search(docs, "id", "t", asked, s="a").collect()}
    assert got == {1: (1.0, "The <mark>Binary</mark> trie join"), 2: (0.5, "a <mark>trie</mark>")}
    pages = spark.createDataFrame([("x", "1"), ("old", "1"), ("c", "2")], "page string, hash string")
    manifest = spark.createDataFrame([("x", "1"), ("gone", "1"), ("c", "1")], "page string, hash string")
    links = spark.createDataFrame([("a", "x"), ("a", "y")], "source string, target string")
    made = d.link_check(links, pages, spark.createDataFrame([("y",)], "page string"), manifest)
    assert {tuple(r) for r in made.collect()} == {("y", "creatable"), ("old", "stale"), ("gone", "missing"), ("c", "changed")}
