"""Queries of the second tier (identity, search, relations, review, derived records), with SQL of the same result.

Where the tables hold no input of an operator, it is made from their columns by the same
rule in both languages; the docstrings say so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import archive, documents
from archivolt.plans.queries import query
from archivolt.sources.jsonl import line_error
from archivolt.workspace import table

@query(
    r"""SELECT rec_no, CASE WHEN id <> '' THEN 'id:' || id WHEN regexp_matches(url, '/answers?/[0-9]+') THEN 'item:answer:' || regexp_extract(url, '/answers?/([0-9]+)', 1)
    WHEN regexp_matches(url, '(/p/|/articles/)[0-9]+') THEN 'item:article:' || regexp_extract(url, '(/p/|/articles/)([0-9]+)', 2)
    WHEN regexp_matches(url, '/zvideos?/[0-9]+') THEN 'item:zvideo:' || regexp_extract(url, '/zvideos?/([0-9]+)', 1) WHEN regexp_matches(url, '/pins?/[0-9]+') THEN 'item:pin:' || regexp_extract(url, '/pins?/([0-9]+)', 1)
    WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'url' ELSE 'hash:' || sha256(coalesce(content, '')) END AS identity FROM articles"""
)
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What identifies every article: id, platform item, address (its text is checked in canonical_urls) or content."""
    made = documents.identity("id", "url", F.sha2(F.coalesce("content", F.lit("")), 256))
    shown = F.when(made.startswith("url:"), "url").otherwise(made)
    return table(spark, sf_dir, "articles").select("rec_no", shown.alias("identity"))


@query(
    r"""SELECT rec_no, sha256(title_ || chr(31) || author_ || chr(31) || content_ || chr(31) || chr(31) || array_to_string(list_transform(coalesce(images, []), lambda x: coalesce(x, '')), chr(10))) AS normalised,
    sha256('{' || array_to_string(list_filter(['"author":' || CAST(to_json(author) AS VARCHAR), '"title":' || CAST(to_json(title) AS VARCHAR)], lambda x: x IS NOT NULL AND NOT ends_with(x, ':null')), ',') || '}') AS source FROM (SELECT *,
    nfc_normalize(trim(regexp_replace(regexp_replace(coalesce(title, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS title_,
    nfc_normalize(trim(regexp_replace(regexp_replace(coalesce(author, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS author_,
    nfc_normalize(trim(regexp_replace(regexp_replace(coalesce(content, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS content_ FROM articles)"""
)
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised hash of every article, its address left out, and the source hash of its title and author."""
    rows = table(spark, sf_dir, "articles").withColumn("no_url", F.lit(None).cast("string"))
    source = documents.source_hash("title", "author")
    return rows.select("rec_no", documents.normalised_hash("title", "author", "content", "no_url", "images").alias("normalised"), source.alias("source"))


_VERSIONS = "(SELECT id, title, rec_no FROM articles WHERE id IS NOT NULL AND title IS NOT NULL)"


@query(
    f"""SELECT id, any_value(newest) AS title, count(*) AS versions, coalesce(array_to_string(list_sort(list_distinct(list(title) FILTER (WHERE title <> newest))), '|'), '') AS replaced
    FROM (SELECT *, last_value(title) OVER (PARTITION BY id ORDER BY rec_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest FROM {_VERSIONS}) GROUP BY id"""
)
def merged_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest title of every id, its number of versions and the titles it replaced."""
    rows = table(spark, sf_dir, "articles").filter("id IS NOT NULL")
    made = documents.merged(rows, "id", "title", "rec_no", "newest_reviewed")
    return made.select("id", "title", "versions", F.array_join("replaced", "|").alias("replaced"))


_CHANGE = """(WITH r AS (SELECT id, batch_no, rec_no, sha256(coalesce(content, '')) AS n FROM articles WHERE id IS NOT NULL),
    o AS (SELECT id, arg_max(n, rec_no) AS n FROM r WHERE batch_no <= 6 GROUP BY id), w AS (SELECT id, arg_max(n, rec_no) AS n FROM r WHERE batch_no > 6 GROUP BY id)
    SELECT CASE WHEN o.n IS NULL THEN 'created' WHEN w.n IS NULL THEN 'absent' WHEN o.n <> w.n THEN 'updated' ELSE 'unchanged' END AS change FROM o FULL JOIN w ON o.id = w.id)"""


@query(
    f"""SELECT count(*) FILTER (change <> 'absent') + 3 AS discovered, count(*) FILTER (change <> 'absent') AS processed, count(*) FILTER (change = 'created') AS created, count(*) FILTER (change = 'updated') AS updated,
    count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'absent') AS absent, CAST(2 AS BIGINT) AS skipped, CAST(1 AS BIGINT) AS failed, 2 * count(*) FILTER (change IN ('created', 'updated')) AS jobs_queued FROM {_CHANGE}"""
)
def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of indexing the later batches over the earlier ones, two items skipped and one failed, two jobs a document."""
    content = F.sha2(F.coalesce("content", F.lit("")), 256)
    rows = table(spark, sf_dir, "articles").filter("id IS NOT NULL").select("id", "batch_no", "rec_no", content.alias("n"))
    last = lambda part: part.groupBy("id").agg(F.max_by("n", "rec_no").alias("normalised_hash")).withColumn("source_hash", F.col("normalised_hash"))
    return documents.index_report(documents.changes(last(rows.filter("batch_no <= 6")), last(rows.filter("batch_no > 6")), "id"), 1, 2, 2)


_TOKEN_SQL = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '" + documents.TOKEN + "'))"


@query(f"SELECT rec_no, len({_TOKEN_SQL.format('title')}) AS n_tokens, array_to_string(list_sort({_TOKEN_SQL.format('title')}), ' ') AS tokens FROM articles")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every title as they are stored for searching."""
    made = documents.tokens(F.col("title"))
    return table(spark, sf_dir, "articles").select("rec_no", F.size(made).cast("bigint").alias("n_tokens"), F.array_join(F.array_sort(made), " ").alias("tokens"))


@query(
    f"""WITH s AS (SELECT DISTINCT title AS query FROM articles WHERE rec_no % 100 = 0 AND title IS NOT NULL), q AS (SELECT query, len(g) AS n, unnest(g) AS t FROM (SELECT query, {_TOKEN_SQL.format('query')} AS g FROM s)),
    a AS (SELECT rec_no, title FROM articles WHERE source = 'zhihu'), d AS (SELECT rec_no, unnest({_TOKEN_SQL.format('title')}) AS t FROM a),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rec_no) AS rank FROM (SELECT query, rec_no, round(count(*) / n, 6) AS score FROM d JOIN q ON d.t = q.t GROUP BY query, rec_no, n HAVING round(count(*) / n, 6) >= 0.3))
    SELECT query, rec_no, score, CAST(rank AS INTEGER) AS rank, substr(title, greatest(1, p - 30), p - greatest(1, p - 30)) || '<mark>' || substr(title, p, length(t)) || '</mark>' || substr(title, CAST(p + length(t) AS BIGINT), 30) AS snippet FROM (
    SELECT *, instr(lower(title), t) AS p FROM (SELECT r.*, a.title, list_sort(list_transform(list_filter({_TOKEN_SQL.format('query')}, lambda x: contains(lower(a.title), x)), lambda x: struct_pack(n := -length(x), t := x)))[1].t AS t
    FROM r JOIN a USING (rec_no) WHERE rank <= 10))"""
)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best titles of one source for the title of every hundredth article, with marked snippets."""
    rows = table(spark, sf_dir, "articles").select("rec_no", "title", "source")
    asked = rows.filter("rec_no % 100 = 0 AND title IS NOT NULL").select(F.col("title").alias("query")).distinct()
    return documents.ranked_search(rows, "rec_no", "title", asked, source="zhihu")


@query(
    """WITH e AS (SELECT title AS query, rec_no AS key FROM articles WHERE rec_no % 100 = 0 AND title IS NOT NULL), f AS (SELECT title AS query, rec_no AS key, row_number() OVER (PARTITION BY title ORDER BY rec_no DESC) AS rank,
    CAST(length(title) AS DOUBLE) AS ms FROM articles WHERE title IS NOT NULL AND source = 'zhihu'),
    q AS (SELECT e.query, count(f.rank) / count(*) AS recall, coalesce(1.0 / min(f.rank), 0.0) AS rr FROM e LEFT JOIN (SELECT * FROM f WHERE rank <= 10) f ON e.query = f.query AND e.key = f.key GROUP BY e.query)
    SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(quantile_cont(ms, 0.95), 6) AS p95, count(*) FILTER (WHERE ms IS NULL) AS unsupported
    FROM q LEFT JOIN (SELECT query, max(ms) AS ms FROM f GROUP BY query) m ON q.query = m.query"""
)
def search_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a search that finds equal titles of one source, latest first; a title's length stands for the time taken."""
    rows = table(spark, sf_dir, "articles").filter("title IS NOT NULL").select(F.col("title").alias("query"), F.col("rec_no").alias("key"), "source")
    found = documents.top(rows.filter("source = 'zhihu'").withColumn("score", F.col("key")), "query", "score", "key", 10)
    found = found.select("query", "key", "rank", F.length("query").cast("double").alias("ms"))
    return documents.search_metrics(found, rows.filter("key % 100 = 0").select("query", "key"))


@query(
    """SELECT gain, gain >= 0.1 AND loss >= -0.02 AS adopt FROM (SELECT max(CASE WHEN kind = 'semantic' THEN h - l END) AS gain, min(CASE WHEN kind = 'lexical' THEN h - l END) AS loss FROM (
    SELECT CASE WHEN bucket = 'keep_knowledge' THEN 'semantic' ELSE 'lexical' END AS kind, round(count(*) FILTER (WHERE length(article_title) > 10) / count(*), 6) AS l, round(count(*) FILTER (WHERE length(article_title) > 5) / count(*), 6) AS h
    FROM triage_items GROUP BY 1))"""
)
def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second ranking is adopted; shares of titles over two lengths stand for the recalls."""
    rows = table(spark, sf_dir, "triage_items").withColumn("kind", F.when(F.col("bucket") == "keep_knowledge", "semantic").otherwise("lexical"))
    recall = lambda n: rows.groupBy("kind").agg(F.round(F.count_if(F.length("article_title") > n) / F.count("*"), 6).alias("recall"))
    return documents.adopt(recall(10), recall(5))


_DERIVED = """(SELECT rec_no AS k, title, content, rec_no % 7 AS m, trim(regexp_replace(regexp_replace(coalesce(content, ''), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS plain FROM articles)"""


@query(
    f"""SELECT k AS rec_no, unnest(list_filter([CASE WHEN coalesce(trim(title, ' '), '') = '' THEN 'summary' END, CASE WHEN k % 12 > 10 THEN 'key_points' END, CASE WHEN m > 5 THEN 'topics' END, CASE WHEN k % 10 > 8 THEN 'tags' END,
    CASE WHEN k % 8 > 5 THEN 'evergreen_score' END, CASE WHEN k % 11 = 3 AND (m > 0 OR k % 10 > 0) THEN 'confidence' END, CASE WHEN NOT contains(plain, coalesce(substr(coalesce(title, ''), 1, 4), '')) THEN 'excerpt' END,
    CASE WHEN m = 6 THEN 'content_type' END, CASE WHEN k % 9 = 8 THEN 'reading_priority' END, CASE WHEN k % 13 = 0 THEN 'unknown_key' END], lambda x: x IS NOT NULL)) AS reason FROM {_DERIVED.replace("'<[^>]*>'", "'<[^>]*>'")}"""
)
def derivation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with derived records; they are made of the articles by remainders of rec_no, the title's start is the excerpt."""
    k = F.col("rec_no")
    label = lambda n: F.transform(F.slice(F.array(*[F.lit(x) for x in "abcdefghij"]), F.lit(1), (n).cast("int")), lambda x: F.struct(x.alias("name"), F.when(k % 11 == 3, 1.5).otherwise(0.5).alias("confidence")))
    rows = table(spark, sf_dir, "articles").select(
        "rec_no", "content", F.col("title").alias("summary"), F.slice(F.array(*[F.lit(x) for x in "abcdefghijkl"]), F.lit(1), (k % 12).cast("int")).alias("key_points"),
        label(k % 7).alias("topics"), label(k % 10).alias("tags"), (k % 8).cast("int").alias("evergreen_score"), F.when(k % 7 == 6, "poem").otherwise("news").alias("content_type"),
        F.when(k % 9 == 8, 6).otherwise(3).alias("reading_priority"), F.array(F.struct(F.lit("c").alias("claim"), F.concat(F.substring(F.coalesce("title", F.lit("")), 1, 4)).alias("excerpt"))).alias("citations"),
        F.when(k % 13 == 0, '{"summary": "s", "mood": 1}').otherwise('{"summary": "s"}').alias("payload"),
    )
    return documents.derivation_failures(rows, "rec_no", "content")


@query(
    """WITH n AS (SELECT id, arg_max(title, rec_no) AS t, arg_max(content, rec_no) AS c FROM (SELECT id, rec_no, sha256(coalesce(title, '')) AS title, sha256(coalesce(content, '')) AS content FROM articles WHERE id IS NOT NULL AND batch_no > 6) GROUP BY id),
    d AS (SELECT DISTINCT id, sha256(coalesce(title, '')) AS t, sha256(coalesce(content, '')) AS c FROM articles WHERE id IS NOT NULL AND batch_no <= 6)
    SELECT n.id, CASE WHEN NOT EXISTS (SELECT 1 FROM d WHERE d.id = n.id AND d.t = n.t) THEN 'derive' WHEN EXISTS (SELECT 1 FROM d WHERE d.id = n.id AND d.t = n.t AND d.c = n.c) THEN 'reuse' ELSE 'stale' END AS decision FROM n"""
)
def reused_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what was derived from the earlier batches serves the later ones; the title stands for the source, the content for the normalised text."""
    hashed = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    rows = table(spark, sf_dir, "articles").filter("id IS NOT NULL").select("id", "batch_no", "rec_no", hashed("title").alias("source_hash"), hashed("content").alias("normalised_hash"))
    rows = rows.withColumns({"kind": F.lit("summary"), "prompt": F.lit("p1"), "policy": F.lit("v1")})
    wanted = archive.first_wins(rows.filter("batch_no > 6").withColumn("rec_no", -F.col("rec_no")), "id", ["rec_no"])
    return documents.reuse(wanted, rows.filter("batch_no <= 6"), "id")


@query(
    """SELECT user_id AS key, arg_max(struct_pack(s := event_type, o := origin), CASE WHEN origin = 'human' THEN 10000000000 ELSE 0 END + event_id).s AS state, arg_max(origin, CASE WHEN origin = 'human' THEN 10000000000 ELSE 0 END + event_id) AS origin
    FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'human' ELSE 'model' END AS origin FROM events) GROUP BY user_id"""
)
def reading_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each user's reading from the events; every fourth mark is a human one."""
    marks = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("state"), F.when(F.col("event_id") % 4 == 0, "human").otherwise("model").alias("origin"), "event_id")
    return documents.reading_state(marks, "key", "event_id")


_PAIRS = "(SELECT a.rec_no AS a, b.rec_no AS b, CASE WHEN a.rec_no % 6 = 5 THEN 'likes' ELSE 'cites' END AS kind, coalesce(substr(a.title, 1, 3), 'zq') AS evidence, a.content AS ca, b.content AS cb FROM articles a JOIN articles b ON b.rec_no = a.rec_no + 1)"


@query(f"SELECT a, b, kind FROM {_PAIRS} WHERE kind = 'cites' AND (contains(ca, evidence) OR contains(cb, evidence))")
def valid_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of articles to the next one whose evidence, the title's start, stands in one of both; every sixth is of no known kind."""
    rows = table(spark, sf_dir, "articles")
    n = F.col("rec_no")
    known = rows.select(n.alias("b"))
    relations = rows.select(n.alias("a"), (n + 1).alias("b"), F.when(n % 6 == 5, "likes").otherwise("cites").alias("kind"), F.coalesce(F.substring("title", 1, 3), F.lit("zq")).alias("evidence")).join(known, "b", "left_semi")
    return documents.valid_relations(relations, rows, "rec_no", "content", ("supports", "contradicts", "extends", "cites", "duplicates")).select("a", "b", "kind")


@query(
    """WITH p AS (SELECT DISTINCT article_id AS page, arg_min(path, path) OVER (PARTITION BY article_id) AS h FROM image_manifest WHERE article_id <> ''), i AS (SELECT article_id AS page, min(bucket) AS b FROM triage_items WHERE article_id <> '' GROUP BY 1),
    l AS (SELECT DISTINCT article_id AS target FROM triage_items WHERE article_id <> ''), c AS (SELECT DISTINCT id FROM articles WHERE id IS NOT NULL), m AS (SELECT DISTINCT id AS page, 'x' AS h FROM articles WHERE id IS NOT NULL AND rec_no % 10 = 0)
    SELECT target AS name, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.id = target) THEN 'creatable' ELSE 'broken' END AS state FROM l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page = target)
    UNION ALL SELECT coalesce(p.page, m.page), CASE WHEN m.h IS NULL THEN 'stale' WHEN p.h IS NULL THEN 'missing' ELSE 'changed' END FROM p FULL JOIN m ON p.page = m.page"""
)
def link_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from the image report to saved articles; every tenth article is in the manifest, with another hash."""
    pages = table(spark, sf_dir, "image_manifest").filter(F.length("article_id") > 0).groupBy(F.col("article_id").alias("page")).agg(F.coalesce(F.min("path"), F.lit("?")).alias("hash"))
    articles = table(spark, sf_dir, "articles").filter("id IS NOT NULL")
    links = table(spark, sf_dir, "triage_items").filter(F.length("article_id") > 0).select(F.lit("report").alias("source"), F.col("article_id").alias("target")).distinct()
    manifest = articles.filter("rec_no % 10 = 0").select(F.col("id").alias("page"), F.lit("x").alias("hash")).distinct()
    return documents.link_check(links, pages, articles.select(F.col("id").alias("page")), manifest)


_LABELS = """(SELECT 'source' AS kind, source AS label, doc_id AS key FROM documents UNION SELECT 'topic', collection_id, doc_id FROM documents UNION SELECT 'tag', lang, doc_id FROM documents)"""


@query(f"SELECT kind, label, count(*) AS n, array_to_string(list_sort(list(key))[1:20], ' ') AS first FROM {_LABELS} WHERE label <> '' GROUP BY ALL")
def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of sources, topics (collections) and tags (languages) with their first documents."""
    rows = table(spark, sf_dir, "documents")
    labels = [rows.select(F.lit(kind).alias("kind"), F.col(c).alias("label"), F.col("doc_id").alias("key")) for kind, c in (("source", "source"), ("topic", "collection_id"), ("tag", "lang"))]
    made = documents.index_pages(labels[0].unionByName(labels[1]).unionByName(labels[2]))
    return made.select("kind", "label", "n", F.array_join(F.transform("first", lambda k: k.cast("string")), " ").alias("first"))


@query(
    """SELECT key, other, score, array_to_string(list_sort(list_distinct(h)), ',') AS heuristics FROM (SELECT key, other, max(score) AS score, list(heuristic) AS h FROM (
    SELECT key, other, 1.0::DOUBLE AS score, 'label' AS heuristic FROM (SELECT key, unnest(list(key) OVER (PARTITION BY lang, key // 65536 ORDER BY key ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)) AS other FROM (SELECT DISTINCT doc_id AS key, lang FROM documents WHERE lang <> ''))
    UNION ALL SELECT key, other, round(1.0::DOUBLE / (1 + gap), 9), 'time' FROM (SELECT a.doc_id AS key, b.doc_id AS other, abs(epoch(a.captured_at)::BIGINT - epoch(b.captured_at)::BIGINT) AS gap,
    row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(epoch(a.captured_at)::BIGINT - epoch(b.captured_at)::BIGINT), b.doc_id) AS k FROM documents a JOIN documents b ON a.collection_id = b.collection_id AND a.doc_id <> b.doc_id
    AND abs(epoch(a.captured_at)::BIGINT - epoch(b.captured_at)::BIGINT) <= 86400) WHERE k <= 50) WHERE key <> other GROUP BY key, other)
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, other) <= 50"""
)
def related_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to fifty related documents of each by language (as a tag) and time, with the heuristics that found them."""
    rows = table(spark, sf_dir, "documents")
    labels = documents.shared_labels(rows.select(F.col("doc_id").alias("key"), F.col("lang").alias("label")))
    times = documents.related_by_time(rows, "doc_id", "collection_id", F.col("captured_at").cast("timestamp").cast("bigint"), 86400)
    times = times.select(F.col("doc_id").alias("key"), "other", F.round(1.0 / (1 + F.col("gap")), 9).alias("score"), F.lit("time").alias("heuristic"))
    made = documents.related(labels.unionByName(times))
    return made.select("key", "other", "score", F.array_join("heuristics", ",").alias("heuristics"))


@query(
    """SELECT DISTINCT id AS key, 'm1' AS model FROM (SELECT id, sha256(coalesce(content, '')) AS h FROM articles WHERE id IS NOT NULL AND batch_no > 6) n
    WHERE NOT EXISTS (SELECT 1 FROM articles o WHERE o.batch_no <= 6 AND o.id = n.id AND sha256(coalesce(o.content, '')) = n.h)"""
)
def stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the later batches whose content no embedding of the earlier ones was made from."""
    rows = table(spark, sf_dir, "articles").filter("id IS NOT NULL").select(F.col("id").alias("key"), "batch_no", F.sha2(F.coalesce("content", F.lit("")), 256).alias("normalised_hash"), F.lit("m1").alias("model"))
    return documents.stale_embeddings(rows.filter("batch_no > 6"), rows.filter("batch_no <= 6"), "key").distinct()


_LOG = """SELECT job, count(*) FILTER (WHERE ok AND reached) AS downloaded, count(*) FILTER (WHERE NOT ok AND reached) AS skipped, any_value(CASE WHEN stop IS NOT NULL AND full_ < 5 THEN stop ELSE last + 1 END) AS next_place,
    any_value(CASE WHEN stop IS NOT NULL AND full_ < 5 THEN reason END) AS stopped_reason FROM (SELECT *, (stop IS NULL OR place < stop) AND before_ < 5 AS reached, max(CASE WHEN (stop IS NULL OR place < stop) AND before_ < 5 THEN place ELSE -1 END) OVER (PARTITION BY job) AS last,
    sum(CASE WHEN ok AND (stop IS NULL OR place < stop) AND before_ < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY job) AS full_ FROM (SELECT *, ok, min(CASE WHEN stops THEN place END) OVER (PARTITION BY job) AS stop, arg_min(why, CASE WHEN stops THEN place END) OVER (PARTITION BY job) AS reason,
    coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM (
    SELECT job, place, s < 400 AS ok, s IS NULL OR s >= 400 AND s NOT IN (404, 410) AS stops, CASE WHEN s IS NULL THEN 'timeout' ELSE 'http_' || s END AS why FROM (
    SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, CASE event_id % 23 WHEN 1 THEN 404 WHEN 2 THEN 410 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN NULL ELSE 200 END AS s FROM events))))
    GROUP BY job"""


@query(_LOG)
def limited_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of fetch logs with five downloads at most; the log is made of the events, one job a user, statuses by remainders of event_id."""
    n = F.col("event_id") % 23
    status = F.when(n == 1, 404).when(n == 2, 410).when(n == 3, 429).when(n == 4, 503).when(n == 5, F.lit(None)).otherwise(200)
    rows = archive.resume(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id"), "job", ["event_id"], 0)
    fetched = rows.select("job", "place", status.cast("int").alias("status"), F.when(n == 5, "timeout").alias("error"))
    return archive.download_log(fetched, "job", ["place"], 5)


@query(
    r"""SELECT rec_no, CASE WHEN rec_no % 5 = 1 THEN 'not JSON' WHEN rec_no % 5 = 2 THEN 'not an object' END AS error, CASE WHEN rec_no % 5 = 0 THEN length(trim(coalesce(title, ''), ' ')) END AS n FROM articles WHERE rec_no % 5 <= 2"""
)
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which two in five are no JSON object, read leniently; they are made of the titles."""
    k = F.col("rec_no") % 5
    line = F.when(k == 1, F.lit("{bad")).when(k == 2, F.lit("[1]")).otherwise(F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("title"))))
    rows = table(spark, sf_dir, "articles").filter(k <= 2).select("rec_no", line.alias("value"))
    return rows.select("rec_no", line_error(F.col("value")).alias("error"), F.length(F.trim(F.try_variant_get(F.try_parse_json("value"), "$.title", "string"))).cast("bigint").alias("n"))
