"""Readers, configuration, the paged source, the command line and streaming ingest."""

import json

import pytest

from archivolt import cli
from archivolt.operators import records, triage
from archivolt.plans import jobs
from archivolt.sources import config, files, jsonl, paged
from archivolt.streaming.ingest import ingest
from tests.test_operators import ARTICLE


def test_env_and_lists(tmp_path):
    file = tmp_path / "env"
    file.write_text("\ufeffCOOKIE=a=b\n# c\nREQUEST_DELAY=3\nbad\nCOOKIE = z\nDOWNLOAD_IMAGES=Yes\n", "utf-8")
    assert vars(config.load(file)) == {"cookie": "z", "download_images": True, "request_delay": 3.0, "max_retry": 3}
    with pytest.raises(ValueError, match="COOKIE is required"):
        config.load(tmp_path / "none")
    with pytest.raises(ValueError):
        config.boolean("maybe")
    with pytest.raises(ValueError):
        config.check_delay(1)
    (tmp_path / "l").write_text("# x\n\n a \n", "utf-8")
    assert config.addresses(tmp_path / "l") == ["a"]
    assert config.key_values(tmp_path / "none") == {}


def test_pages_stop_rules():
    data = {0: [1, 2], 2: [3], 3: []}
    got = list(paged.listing(lambda p: {"data": data[p], "paging": {"totals": 3}}))
    assert [(p.number, p.place, p.items, p.total) for p in got] == [(0, 0, [1, 2], 3), (1, 2, [3], 3), (2, 3, [], 3)]
    assert len(list(paged.listing(lambda p: {"data": [1] * 10, "paging": {"is_end": False}}, 0, 25))) == 3
    assert len(list(paged.listing(lambda p: {"data": [1], "paging": {"is_end": True}}))) == 1
    with pytest.raises(paged.FetchError):
        list(paged.listing(lambda p: {"data": 5}))


def test_retry():
    calls = []

    def fail(final):
        def fetch(place):
            calls.append(1)
            raise paged.FetchError("x", final)

        return fetch

    for final, expected in ((True, 1), (False, 3)):
        calls.clear()
        with pytest.raises(paged.FetchError):
            paged.patient(fail(final), 3, 0)(0)
        assert len(calls) == expected


def test_paged_source_reads_landed_pages(spark, tmp_path):
    landed(tmp_path, {0: [item("answer", 1), item("", 2)], 2: [item("pin", 3)]})
    spark.dataSource.register(paged.PagedSource)
    pages = spark.read.format("paged").option("delay", "0").load(str(tmp_path))
    assert [(r.page_no, r.page_place, len(r["items"])) for r in pages.collect()] == [(0, 0, 2), (1, 2, 1), (2, 3, 0)]
    assert [(r.page_no, r.place, json.loads(r.item)["content"]["id"]) for r in paged.items(pages).collect()] == [(0, 0, 1), (0, 1, 2), (1, 2, 3)]
    assert paged.items(pages, 0, 2).count() == 2
    assert paged.items(spark.read.format("paged").option("offset", "2").load(str(tmp_path))).count() == 1


def item(kind, number, **more):
    return {"created": 1705291200, "content": {"type": kind, "id": number, "title": f"t{number}", "url": f"https://a.example/{number}", "created": 1705291200, "author": {"name": "x"}} | more}


def landed(folder, pages, **paging):
    folder.mkdir(exist_ok=True)
    for place, items in pages.items():
        (folder / f"{place}.json").write_text(json.dumps({"data": items, "paging": paging}), "utf-8")


def written(path):
    return [json.loads(line) for file in sorted(path.glob("part-*")) for line in file.read_text("utf-8").splitlines()]


def test_export_of_a_fixture_resumes(spark, tmp_path):
    """Two items: both are exported; from offset 1 only the second; an id that is there already is skipped."""
    items = [{"id": f"answer_{k}", "title": f"t{k}", "url": f"https://a.example/{k}", "author": "x", "content": "c", "created_at": "2024-01-15T08:30:00Z"} for k in (1, 2)]
    (tmp_path / "f.json").write_text(json.dumps({"items": items}), "utf-8")
    run = lambda name: jobs.export_fixture(spark, str(tmp_path / "f.json"), str(tmp_path / f"{name}.jsonl"), str(tmp_path / f"{name}.state"))
    state = lambda name: files.load_state(spark, str(tmp_path / f"{name}.state"))
    assert run("a") == (2, 0) and state("a") == {"offset": 2, "exported": 2}
    assert [list(r) for r in written(tmp_path / "a.jsonl")] == [sorted(records.FIELDS)] * 2
    files.save_state(spark, str(tmp_path / "b.state"), 1, 1)
    assert run("b") == (1, 0) and state("b") == {"offset": 2, "exported": 2}
    assert [r["id"] for r in written(tmp_path / "b.jsonl")] == ["zhihu_answer_2"]
    files.save_state(spark, str(tmp_path / "b.state"), 0, 0)
    assert run("b") == (1, 1) and state("b") == {"offset": 2, "exported": 2}
    assert len(written(tmp_path / "b.jsonl")) == 2


def test_export_of_listings(spark, tmp_path):
    """Repeated ids are exported once, answers take their detail, and an item that gives no record writes nothing."""
    pages = tmp_path / "p"
    landed(pages, {0: [item("answer", 1), item("article", 2, content="<p>b <img src='https://i.example/a.png'></p>"), item("article", 2, content="again")]}, is_end=True)
    (tmp_path / "d.json").write_text(json.dumps({"kind": "answer", "id": "1", "detail": json.dumps({"id": 1, "url": "https://a.example/1", "content": "<b>x</b>", "created_time": 1705291200, "question": {"title": "q"}, "author": {"name": "n"}})}), "utf-8")
    out, state = tmp_path / "out" / "set-9.jsonl", str(tmp_path / "s.json")
    assert cli.main(["export", "--address", str(pages), "--details", str(tmp_path / "d.json"), "--output", str(out), "--state", state, "--limit", "0"], spark) == 0
    assert [(r["id"], r["content"], r["images"]) for r in written(out)] == [("zhihu_answer_1", "x", []), ("zhihu_article_2", "b", ["https://i.example/a.png"])]
    assert files.load_state(spark, state) == {"offset": 3, "exported": 2}
    landed(pages, {3: [item("article", 4, content="c"), item("course", 5)]}, is_end=True)
    assert cli.main(["export", "--address", str(pages), "--output", str(out), "--state", state, "--limit", "0"], spark) == 1
    assert len(written(out)) == 2 and files.load_state(spark, state)["offset"] == 3
    assert cli.main(["export", "--address", str(pages), "--output", str(out), "--state", state, "--limit", "1"], spark) == 0
    assert files.load_state(spark, state) == {"offset": 4, "exported": 3}
    member = tmp_path / "m"
    pair = [item("article", 7)["content"] | {"content": "body"}, item("article", 8)["content"]]
    landed(member, {0: pair, 1: pair[1:]}, is_end=True)
    assert cli.main(["export-author", "--address", str(member), "--output", str(tmp_path / "a.jsonl"), "--state", str(tmp_path / "a.state"), "--limit", "1"], spark) == 0
    assert [(r["id"], r["content"]) for r in written(tmp_path / "a.jsonl")] == [("zhihu_article_7", "body")]
    assert cli.main(["export-author", "--address", str(member), "--output", str(tmp_path / "a.jsonl"), "--state", str(tmp_path / "a.state"), "--limit", "1"], spark) == 1


def test_audits(spark, tmp_path):
    """Three items on two pages of each type; a wrong total is a warning; an empty last page counts; audited ones are left out."""
    landed(tmp_path / "a", {0: [item("answer", 1), item("article", 2)]}, totals=3)
    landed(tmp_path / "a", {2: [item("pin", 3)]}, totals=3, is_end=True)
    landed(tmp_path / "b", {0: [item("answer", 1)]}, totals=5)
    (tmp_path / "list").write_text(f"# two\n{tmp_path / 'a'}\n{tmp_path / 'b'}\n", "utf-8")
    report = str(tmp_path / "report")
    made = {r.collection_id: r for r in jobs.audit(spark, config.addresses(tmp_path / "list"), report).collect()}
    a, b = made["a"], made["b"]
    assert (a.reported_total, a.scanned_total, a.page_count, a.type_counts, a.warnings) == (3, 3, 2, {"answer": 1, "article": 1, "pin": 1}, [])
    assert (b.reported_total, b.scanned_total, b.page_count, b.warnings) == (5, 1, 2, ["reported_total_mismatch"])
    assert cli.main(["audit", "--list", str(tmp_path / "list"), "--report", report], spark) == 0
    assert len(written(tmp_path / "report")) == 2 and list(written(tmp_path / "report")[0]) == sorted(written(tmp_path / "report")[0])
    out = tmp_path / "raw"
    batch = ["export-batch", "--list", str(tmp_path / "list"), "--output", str(out), "--state", str(tmp_path / "states"), "--log", str(tmp_path / "log")]
    (tmp_path / "list").write_text(f"{tmp_path / 'a'}\n", "utf-8")
    landed(tmp_path / "a", {0: [item("article", 1, content="x"), item("article", 2, content="y")], 2: [item("pin", 3)]}, is_end=True)
    landed(tmp_path / "a", {0: [item("article", 1, content="x"), item("article", 2, content="y")]})
    assert cli.main([*batch, "--audit", report], spark) == 0
    assert len(written(out / "set-a.jsonl")) == 3 and "a: exported=3 skipped=0" in (tmp_path / "log").read_text()
    assert jobs.incomplete_addresses(spark, ["a", "b", "c"], report, str(out)) == ["b", "c"]
    assert {(r.collection_id, r.status) for r in jobs.verify(spark, report, str(out)).collect()} == {("a", "ok"), ("b", "mismatch")}


def test_downloads(spark, tmp_path):
    """Resume, statuses that pass and that stop, errors, the limit, the manifest and the index."""
    raw = tmp_path / "raw"
    raw.mkdir()
    images = [f"https://i.example/{k}.png" for k in range(4)]
    (raw / "set-7.jsonl").write_text(json.dumps(ARTICLE | {"images": [images[0], "", images[1]], "content": "论文"}) + "\n" + json.dumps(ARTICLE | {"id": "web_2", "images": images[1:]}) + "\n", "utf-8")
    (raw / "set-8.sample.jsonl").write_text("{bad", "utf-8")
    answers = {}

    def fetch(url):
        made = answers.get(url, (200, b"body", "image/png"))
        if isinstance(made, str):
            raise TimeoutError if made == "timeout" else OSError
        return made

    def run(name, limit=0):
        got = jobs.download_images(jobs.raw_images(spark, str(raw)), "j", str(tmp_path / "img"), str(tmp_path / name), None, fetch, limit, 0.0)
        return got["downloaded"], got["skipped"], got["stopped_reason"], files.load_state(spark, str(tmp_path / name))

    for status in (403, 429, 500):
        answers = {images[0]: (status, b"", "")}
        assert run(f"s{status}") == (0, 0, f"http_{status}", {"offset": 0, "exported": 0})
    for error, reason in (("timeout", "timeout"), ("broken", "network_error")):
        answers = {images[0]: error}
        assert run(reason) == (0, 0, reason, {"offset": 0, "exported": 0})
    answers = {images[0]: (404, b"", "")}
    assert run("s404", 1) == (1, 1, None, {"offset": 2, "exported": 1})
    assert run("s404", 1) == (1, 2, None, {"offset": 3, "exported": 2})
    assert run("s404") == (2, 3, None, {"offset": 5, "exported": 4})
    report, manifest, folder = str(tmp_path / "report.json"), str(tmp_path / "manifest"), str(tmp_path / "img2")
    assert cli.main(["triage", "--raw", str(raw), "--report", report], spark) == 0
    document = json.loads((tmp_path / "report.json").read_text("utf-8"))
    assert document["summary"] == {"raw_files": 1, "articles_with_images": 2, "images_total": 5}
    assert list(document["buckets"]) == list(triage.BUCKETS) and document["buckets"]["keep_knowledge"]["images"] == 2
    assert [x["image_url"] for x in document["items"]] == [*images[:2], *images[1:]]
    answers = {}
    found = jobs.candidates(spark, report)
    assert [r.image_url for r in found.orderBy("place").collect()] == images[:2]
    assert jobs.candidates(spark, report, ["review_unknown"]).count() == 4
    done = jobs.download_images(found, "t", folder, str(tmp_path / "t.json"), manifest, fetch, 1, 0.0)
    assert done == {"downloaded": 1, "skipped": 0, "stopped_reason": None}
    assert len(written(tmp_path / "manifest")) == 1 and written(tmp_path / "manifest")[0]["path"].startswith(folder)
    assert cli.main(["index", "--manifest", manifest, "--report", report, "--output", str(tmp_path / "index.json")], spark) == 0
    index = json.loads((tmp_path / "index.json").read_text("utf-8"))
    assert index["summary"] == {"articles": 1, "images": 1, "missing_candidates": 1}
    assert [x["image_url"] for x in index["missing_candidates"]] == [images[1]] and index["articles"][0]["images"][0]["image_url"] == images[0]
    assert cli.main(["triage-download", "--report", report, "--manifest", manifest, "--folder", folder, "--state", "x", "--delay", "1"], spark) == 1
    assert files.state_path("s", "/a/zhihu-12.jsonl") == "s/images-12.state.json" and files.state_path("s", "a/b.jsonl") == "s/images-b.state.json"


def test_jsonl(spark, tmp_path):
    file = tmp_path / "set-12.jsonl"
    file.write_text("﻿" + json.dumps(ARTICLE | {"title": "a b"}, ensure_ascii=False) + "\n\n{bad\n" + json.dumps({"id": ""}) + "\n", "utf-8")
    assert [r.id for r in jsonl.known_ids(spark, str(file)).collect()] == ["web_1"]
    assert jsonl.line_counts(spark, str(file)).first().n == 3
    assert [(r.value, r.error) for r in jsonl.malformed(spark, str(file)).collect()] == [("{bad", "not JSON")]
    (tmp_path / "blank.jsonl").write_text("\t\n\u00a0\n{}\n\n", "utf-8")
    assert jsonl.line_counts(spark, str(tmp_path / "blank.jsonl")).first().n == 1
    assert jsonl.lines(spark, str(file), exact=True).count() == 4
    assert jsonl.records(spark, str(tmp_path / "none")).count() == 0
    assert jsonl.line_counts(spark, str(tmp_path / "none*")).count() == 0
    row = jsonl.lines(spark, str(file)).select(jsonl.collection_of_file(jsonl.F.col("file"), "set-")).first()
    assert row[0] == "12"
    good = spark.createDataFrame([ARTICLE])
    jsonl.append(good, str(tmp_path / "out"))
    written = spark.read.text(str(tmp_path / "out")).first().value
    assert list(json.loads(written)) == sorted(ARTICLE)
    with pytest.raises(ValueError):
        jsonl.append(good.withColumn("url", jsonl.F.lit("x")), str(tmp_path / "out"))


def test_ingest_is_resumable(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "t"
    source.mkdir()
    run = lambda: ingest(spark, str(source), str(target), str(tmp_path / "r"), str(tmp_path / "c")).awaitTermination()
    counts = []
    for n, ids in enumerate((["web_1", "web_2", "bad"], ["web_2", "web_3"], None)):
        if ids:
            (source / f"{n}.json").write_text("\n".join(json.dumps(ARTICLE | {"id": i}) for i in ids), "utf-8")
        run()
        counts.append(spark.read.parquet(str(target)).count())
    assert counts == [2, 3, 3]
    (source / "9.json").write_text("\n".join(json.dumps(ARTICLE | {"id": "web_9", "title": t}) for t in ("zz", "aa")), "utf-8")
    run()
    assert [r.title for r in spark.read.parquet(str(target)).filter("id = 'web_9'").collect()] == ["zz"]
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_command_line(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "set-7.jsonl").write_text(json.dumps(ARTICLE | {"images": ["https://a/x.png"], "content": "论文"}) + "\n", "utf-8")
    (raw / "set-7.sample.jsonl").write_text(json.dumps(ARTICLE) + "\n", "utf-8")
    (tmp_path / "audit").write_text(json.dumps({"collection_id": "7", "scanned_total": 1}) + "\n", "utf-8")
    assert cli.main(["nonsense"], spark) == 2
    assert cli.main(["verify", "--report", str(tmp_path / "audit"), "--raw", str(raw)], spark) == 0
    assert cli.main(["validate", "--raw", str(raw / "set-7.jsonl")], spark) == 0
