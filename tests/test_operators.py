"""Golden cases of the archive's operators on small inputs."""

import hashlib

from pyspark.sql import functions as F

from archivolt.functions import text, urls
from archivolt.operators import archive, documents, records, triage, validation

ARTICLE = {
    "schema_version": "1.0", "id": "web_1", "source": "web", "title": "t", "url": "https://a.example/1", "author": "x", "content": "c",
    "created_at": "2024-01-15T08:30:00Z", "saved_at": "2026-06-30T12:00:00+08:00",
}


def articles(spark, *changes):
    rows = [tuple((ARTICLE | c).get(f) for f in validation.ARTICLE.names) for c in changes]
    return spark.createDataFrame(rows, validation.ARTICLE)


def test_validation_accepts_and_names_first_failure(spark):
    df = articles(spark, {"id": "web_ok"}, {"id": "web_a", "title": None, "url": "ftp://x"}, {"id": "web_b", "created_at": "2024-02-30T00:00:00Z"}, {"id": "no"})
    found = {r.id: (r.field, r.reason) for r in validation.first_failures(df, "id").collect()}
    assert found == {"web_a": ("title", "missing"), "web_b": ("created_at", "date-time"), "no": ("id", "pattern")}
    assert [r.id for r in validation.valid(df).collect()] == ["web_ok"]


def test_validation_of_raw_lines(spark):
    import json

    lines = [json.dumps(ARTICLE), json.dumps(ARTICLE | {"zz": 1, "aa": 2}), json.dumps(ARTICLE | {"title": 5}), json.dumps(ARTICLE | {"images": ["a", 1]}), "{oops", json.dumps({"id": 1})]
    reordered = json.dumps({"created_at": "x", "url": "y"} | {k: v for k, v in ARTICLE.items() if k not in ("created_at", "url")})
    both = json.dumps(ARTICLE | {"created_at": "x", "url": "y"})
    rows = spark.createDataFrame([(reordered,), (both,)], "value string")
    assert {r.value: r.field for r in validation.raw_failures(rows).collect()} == {reordered: "created_at", both: "url"}
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    found = {r.value: (r.field, r.reason) for r in validation.raw_failures(df).collect()}
    assert lines[0] not in found
    assert [found[x] for x in lines[1:]] == [("aa", "extra"), ("title", "string"), ("images", "items"), (None, "json"), ("schema_version", "missing")]


def test_date_times(spark):
    cases = {"2024-01-15T08:30:00Z": True, "2024-01-15T08:30:00.1Z": False, "2024-02-29T24:00:00Z": False, "2023-02-29T00:00:00Z": False, "2024-01-15T08:30:00+23:59": True, "unknown": False}
    df = spark.createDataFrame(list(cases.items()), "v string, want boolean")
    assert df.filter(text.is_date_time(F.col("v")) != F.col("want")).count() == 0


def test_gif_definitions_differ(spark):
    cases = [("https://e.example/x.GIF?y=1", True, True), ("https://e.example/x.gif#f", True, False), ("https://e.example/x.gif;p", True, False), ("https://e.example/.gif", False, True), ("https://e.example/x.gif/", True, False), ("https://e.example/x.png", False, False)]
    df = spark.createDataFrame(cases, "u string, path boolean, query boolean")
    got = df.select("u", urls.is_gif_path(F.col("u")).alias("p"), urls.is_gif_before_query(F.col("u")).alias("q"), "path", "query")
    assert got.filter("p <> path or q <> query").collect() == []


def test_file_name_and_unix_time(spark):
    url = "https://e.example/a"
    row = spark.range(1).select(urls.file_name(F.lit(url), F.lit("image/png")).alias("n"), text.unix_to_iso(F.lit(1705291200)).alias("t")).first()
    assert row.n == hashlib.sha256(url.encode()).hexdigest()[:16] + ".png"
    assert row.t == "2024-01-15T04:00:00Z"


def test_canonical_url_and_platform(spark):
    row = spark.range(1).select(
        urls.canonical(F.lit("HTTPS://A.Example:443/P/?b=2&utm_source=x&a=1#f")).alias("c"),
        urls.platform_key(F.lit("https://q.example/question/1/answer/22")).alias("k"),
        urls.platform_key(F.lit("https://q.example/x")).alias("n"),
    ).first()
    assert (row.c, row.k, row.n) == ("https://a.example/P?a=1&b=2", "answer:22", None)


def test_html_text():
    assert text.parse_html("<p>a</p>tail &x")[0] == "a"
    assert text.parse_html("AT&T")[0] == ""
    assert text.parse_html("<script>x</script><!-- c --> b  c")[0] == "x b c"
    assert text.parse_html('<img src="data:1" data-original="https://a/1"><img data-original="https://a/2"><img src="https://a/2">')[1] == ["https://a/2"]


def test_triage_rules(spark):
    df = articles(
        spark,
        {"id": "web_1", "title": "架构图", "images": ["https://a/x.gif", "", None, "https://a/y.png"]},
        {"id": "web_2", "title": "头像 合集", "content": "流程图", "images": ["https://a/z.png"]},
        {"id": "web_3", "title": "ai notes", "content": "", "images": [f"https://a/{k}" for k in range(11)]},
        {"id": "web_4", "title": "x", "content": None, "images": []},
    )
    made = triage.triage(df, "id").collect()
    assert {(r.id, r.image_url, r.bucket, tuple(r.reasons)) for r in made if r.id != "web_3"} == {
        ("web_1", "https://a/x.gif", "keep_knowledge", ("knowledge_context", "gif_url")),
        ("web_1", "https://a/y.png", "keep_knowledge", ("knowledge_context",)),
        ("web_2", "https://a/z.png", "reject_decorative", ("decorative_title",)),
    }
    assert {r.bucket for r in made if r.id == "web_3"} == {"review_unknown"}
    report = {r.bucket: (r.images, r.articles) for r in triage.bucket_report(triage.triage(df, "id").withColumnRenamed("id", "article_id")).collect()}
    assert report["keep_knowledge"] == (2, 1) and report["reject_game_entertainment"] == (0, 0) and len(report) == 6


def test_first_wins_and_new_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 0, "z"), ("b", 3, None)], "id string, n int, v string")
    assert {tuple(r) for r in archive.first_wins(df, "id", ["n"]).collect()} == {("a", 1, "y"), ("b", 3, None)}
    assert [r.id for r in archive.new_rows(df, df.filter("id = 'a'"), "id", ["n"]).collect()] == ["b"]


def test_audit_and_reconcile(spark):
    items = spark.createDataFrame([("c", 0, "answer"), ("c", 0, "article"), ("c", 1, None)], "collection_id string, page_no bigint, kind string")
    totals = spark.createDataFrame([("c", 0, None), ("c", 1, 5), ("c", 2, 3)], "collection_id string, page_no bigint, total bigint")
    row = archive.audit(items, "collection_id", "page_no", F.col("kind"), totals).first()
    assert (row.reported_total, row.scanned_total, row.page_count, row.warnings) == (5, 3, 3, ["reported_total_mismatch"])
    assert row.type_counts == {"answer": 1, "article": 1, "unknown": 1}
    made = archive.reconcile(spark.createDataFrame([("c", 3), ("c", 3), ("d", 1)], "collection_id string, scanned_total bigint"), items, "collection_id")
    assert sorted(r.status for r in made.collect()) == ["mismatch", "ok", "ok"]


def test_download_log(spark):
    rows = [("a", 0, 404, None), ("a", 1, 200, None), ("b", 0, 200, None), ("b", 1, 429, None), ("b", 2, 200, None), ("c", 0, None, "timeout")]
    df = spark.createDataFrame(rows, "job string, place bigint, status int, error string")
    got = {r.job: tuple(r)[1:] for r in archive.download_log(df, "job", ["place"]).collect()}
    assert got == {"a": (1, 1, 2, None), "b": (1, 0, 1, "http_429"), "c": (0, 0, 0, "timeout")}
    got = {r.job: tuple(r)[1:] for r in archive.download_log(df, "job", ["place"], limit=1).collect()}
    assert got["b"] == (1, 0, 1, None) and got["a"] == (1, 1, 2, None)


def test_image_index(spark):
    schema = "article_id string, article_title string, article_url string, image_url string, bucket string, reasons array<string>, path string"
    manifest = spark.createDataFrame([("1", "T", "U", "u1", "keep_knowledge", [], "p1"), ("", None, None, "u2", None, None, "p2")], schema)
    assert [(r.article_id, r.article_title, r.n_images) for r in archive.index_articles(manifest, ["path"]).collect()] == [("1", "T", 1)]
    items = spark.createDataFrame([("u1", "keep_knowledge", 0), ("u3", "keep_knowledge", 1), ("u3", "keep_knowledge", 2), ("g.gif?x", "keep_knowledge", 3), (None, "keep_knowledge", 4)], "image_url string, bucket string, n int")
    assert [(r.image_url, r.n) for r in archive.missing_candidates(items, manifest, ["n"]).collect()] == [("u3", 1)]


def test_changes_search_and_fusion(spark):
    old = spark.createDataFrame([("a", "s", "n"), ("b", "s", "n"), ("c", "s", "n"), ("d", "s", "n")], "id string, source_hash string, normalised_hash string")
    new = spark.createDataFrame([("a", "s", "n"), ("b", "t", "n"), ("c", "t", "m"), ("e", "s", "n")], "id string, source_hash string, normalised_hash string")
    assert {r.id: r.change for r in documents.changes(old, new, "id").collect()} == {"a": "unchanged", "b": "source_changed", "c": "normalised_changed", "d": "absent", "e": "created"}
    docs = spark.createDataFrame([(1, "binary trie"), (2, "trie"), (3, None), (4, "")], "id bigint, t string")
    hits = documents.search(docs, "id", F.col("t"), spark.createDataFrame([("trie",)], "query string")).collect()
    assert {(r.id, r.score) for r in hits} == {(1, 1.0), (2, 1.0)}
    ranks = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query string, id bigint, rank int")
    assert documents.fuse(ranks, ranks.filter("id = 2"), "query", "id").orderBy(F.desc("score")).first().id == 2
    metrics = documents.search_metrics(ranks.withColumnRenamed("id", "key"), spark.createDataFrame([("q", 2), ("p", 9)], "query string, key bigint")).first()
    assert tuple(metrics) == (2, 0.5, 0.25, None, 1)


def test_logical_hash_ignores_order(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    assert documents.logical_hash(df, "k", "v").first() == documents.logical_hash(df.orderBy(F.desc("k")), "k", "v").first()


def test_empty_tables(spark):
    empty = articles(spark).limit(0)
    assert triage.triage(empty, "id").count() == 0
    assert archive.first_wins(empty, "id", ["saved_at"]).count() == 0
    assert validation.first_failures(empty, "id").count() == 0


def records_of(spark, *contents, details=None):
    import json

    rows = [(k, json.dumps({"content": c})) for k, c in enumerate(contents)]
    made = records.collection_records(spark.createDataFrame(rows, "k int, item string"), ["k"], details, F.lit("2026-06-30T12:00:00Z"))
    return {r.k: r for r in made.collect()}


def test_records_of_items(spark):
    """Golden cases: bodies, a missing body, pins of blocks, thumbnails, and what items without a record lack."""
    import json

    base = {"id": 5, "url": "https://a.example/5", "author": {"name": "x"}, "title": "T"}
    pin = base | {"type": "pin", "created": 1705291200, "content": [{"type": "text", "own_text": "a<br>b"}, {"type": "text", "content": "c"}, "odd", {"type": "image", "original_url": "https://i/1"}, {"type": "image", "original_url": "https://i/1", "url": "https://i/2"}, {"type": "image", "watermark_url": "ftp://i/3"}]}
    video = base | {"type": "zvideo", "created_at": None, "created": 1705291200}
    detail = [("answer", "5", json.dumps(base | {"question": {"title": "Q"}, "content": "<p>x &amp; y</p><img src='https://i/9'>", "created_time": 1705291200})), ("answer", "6", json.dumps(base | {"id": 6, "question": {"title": "Q"}, "created_time": "1705291200", "content": 7}))]
    details = spark.createDataFrame(detail, "kind string, id string, detail string")
    made = records_of(
        spark, {"type": "answer", "id": 5}, {"type": "answer", "id": 6}, pin, pin | {"content": None}, video, video | {"created_at": "1705291200", "thumbnail": "https://i/1", "image_url": "https://i/1", "thumbnail_info": {"url": "https://i/4"}},
        {"type": "course", "id": 1}, {"type": "answer"}, "text", {"type": "answer", "id": 7}, base | {"type": "article", "content": "<i>b</i>", "created": 1705291200.9}, base | {"type": "article", "content": "<br>", "created": 0, "author": "x"}, details=details,
    )
    assert (made[0].id, made[0].title, made[0].content, made[0].images, made[0].created_at) == ("zhihu_answer_5", "Q", "x & y", ["https://i/9"], "2024-01-15T04:00:00Z")
    assert (made[1].content, made[1].images, made[1].saved_at) == ("Q", [], "2026-06-30T12:00:00Z")
    assert (made[2].title, made[2].content, made[2].images) == ("a b c", "a b c", ["https://i/1", "https://i/2"])
    assert (made[3].title, made[3].content) == ("Zhihu pin 5", "")
    assert made[4].error == "created" and made[4].id is None
    assert (made[5].content, made[5].images, made[5].created_at) == ("T", ["https://i/1", "https://i/4"], "2024-01-15T04:00:00Z")
    assert [made[k].error for k in (6, 7, 8, 9, 11)] == ["type", "type", "content", "detail", "author"]
    assert (made[10].content, made[10].created_at, made[10].error) == ("b", "2024-01-15T04:00:00Z", None)
    assert validation.valid(spark.createDataFrame([made[0].asDict()], "k int, error string, " + ", ".join(f"{f} {'array<string>' if f == 'images' else 'string'}" for f in records.FIELDS)).drop("k", "error")).count() == 1


def test_places_are_global(spark):
    df = spark.range(1000).selectExpr("id * 37 % 1000 AS n", "id % 3 AS job")
    assert archive.placed(df, ["n"]).filter("n <> place").count() == 0
    made = archive.resume(df, "job", ["n"], 5, 10).collect()
    assert len(made) == 30 and all(r.place in range(5, 15) for r in made)
