"""Near-duplicates and the history against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from archivolt.llm import history, keyed, neardup, shingles
from archivolt.llm.forms import comparable


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(70)]
        rows.append((" ".join(base[:5]), " ".join(base[5:])))
        for edits in rng.sample([0, 2, 4, 7, 12, 25], 3):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = word()
            rows.append((" ".join(other[:5]), " ".join(other[5:])))
    rng.shuffle(rows)
    return rows + [(None, None), ("t", ""), (None, rows[0][1]), ("short", "text"), (rows[0][0], rows[0][1])]


def brute(rows):
    own = [comparable(t, c) if c else "" for t, c in rows]
    sets = [shingles.shingle_set(x) if len(x) >= shingles.LEAST else None for x in own]
    plain = [{x[k : k + 5] for k in range(len(x) - 4)} for x in own]
    pairs = set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] is not None and sets[b] is not None and len(plain[a] & plain[b]) >= 0.7 * len(plain[a] | plain[b]):
                pairs.add((a, b))
    return pairs


@pytest.fixture(scope="module")
def rows():
    return texts(3)


def test_trie_join_against_brute_force():
    rng = random.Random(5)
    codes = [rng.getrandbits(128) for _ in range(150)]
    codes += [c ^ sum(1 << rng.randrange(128) for _ in range(rng.randint(0, 50))) for c in codes]
    codes = sorted(codes + codes[:3])
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (codes[i] ^ codes[j]).bit_count() <= 34}
    got = list(neardup.trie_join(codes, 34))
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_and_groups(spark, rows, monkeypatch):
    df = spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate(rows)], "rec_no bigint, title string, content string").selectExpr("*", "1 AS h", "2 AS band")
    want = brute(rows)
    made = neardup.NearDuplicates(df, "rec_no", "title", "content")
    assert {tuple(r) for r in made.pairs().collect()} == want
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(want):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {r.rec_no: r for r in made.groups().collect()}
    assert all(r.group_id == root(k) for k, r in groups.items())
    monkeypatch.setattr(neardup, "TRIE_TEXTS", 2)  # every band is hot: blocks of pairs
    assert {tuple(r) for r in neardup.NearDuplicates(df, "rec_no", "title", "content").pairs().collect()} == want
    empty = neardup.NearDuplicates(df.limit(0), "rec_no", "title", "content")
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_instants():
    assert history.instant("2024-01-15T08:30:00Z") == history.instant("2024-01-15T16:30:00+08:00")
    for bad in (None, "", "unknown", "2024-01-15T08:30:00", "2024-13-01T00:00:00Z", "2024-02-30T00:00:00Z"):
        assert history.instant(bad) is None


def test_history_against_a_pass_in_order(spark, rows, tmp_path, monkeypatch):
    rng = random.Random(9)
    times = ["2024-01-15T08:30:00Z", "2024-01-15T16:29:00+08:00", None, "unknown", "2025-01-01T00:00:00Z"]
    table = [(k, rng.choice([1, 2, None]), t, c, rng.choice([None, *(f"web_{x}" for x in range(150))]), rng.choice(times)) for k, (t, c) in enumerate(rows)]
    df = spark.createDataFrame(table, "rec_no bigint, batch_no int, title string, content string, id string, saved_at string").selectExpr("*", "1 AS token")
    similar = brute(rows)
    linked = {k: set() for k in range(len(rows))}
    for a, b in similar:
        linked[a].add(b)
        linked[b].add(a)
    accepted, ids, rejected = set(), set(), set()
    order = lambda r: (r[1] is None, r[1] or 0, history.instant(r[5]) is None, history.instant(r[5]) or 0, r[0])
    for r in sorted(table, key=order):
        if (r[4] is not None and r[4] in ids) or linked[r[0]] & accepted:
            rejected.add(r[0])
        else:
            accepted.add(r[0])
            ids |= {r[4]} - {None}
    assert {r.rec_no for r in history.rejected(df).collect()} == rejected
    assert history.rejected(df.limit(0)).count() == 0
    with monkeypatch.context() as patch:
        patch.setattr(history, "ONE_TASK", 0)  # every batch is decided in rounds
        assert {r.rec_no for r in history.rejected(df).collect()} == rejected
    with monkeypatch.context() as patch:
        patch.setattr(keyed, "mounted", lambda parts: not parts)  # the index is on a file system that tasks can't open
        assert {r.rec_no for r in history.rejected(df).collect()} == rejected
    path = f"{tmp_path}/history"  # batch by batch, each in a session that opens what the one before left
    got = set()
    for batch in (1, 2, None):
        part = spark.newSession().createDataFrame(df.filter(F.col("batch_no").eqNullSafe(F.lit(batch))).collect(), df.schema)
        got |= {r.rec_no for r in history.rejected(part, path).collect()}
    assert got == rejected and history.History(spark, path).appended == 3


def test_a_batch_reads_by_key(spark, tmp_path, monkeypatch):
    """What a lookup reads follows the asked keys: the row groups read stay the same while the table grows eightfold."""
    monkeypatch.setattr(keyed, "GROUP_BYTES", 4096)
    read = {}
    schema = keyed.StructType().add("k", "long").add("body", "string")
    asked = spark.range(6).select((F.col("id") * 1_000_003 + 17).alias("want"))
    for n in (1, 8):
        rows = spark.range(20_000 * n).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("body"))
        path = f"file://{tmp_path}/t{n}"
        hits = rows.unionByName(asked.select(F.col("want").alias("k"), F.lit("hit").alias("body")))
        keyed.write(hits, path, "k", 4)
        got = keyed.lookup(asked, "want", [path], schema, "k", 4)
        assert {r.want for r in got.filter("body = 'hit'").collect()} == {k * 1_000_003 + 17 for k in range(6)}
        folder = f"{tmp_path}/t{n}/bucket=1"
        want = keyed.np.array(sorted(k for k in (j * 1_000_003 + 17 for j in range(6)) if k % 4 == 1))
        read[n] = sum(1 for _ in keyed._groups(folder, want, "k", ["k"]))
    assert 0 < read[8] <= read[1] + 1


def test_a_large_batch_needs_rounds_only_for_bound_rows(spark, monkeypatch):
    """One task decides what is left once the rows that nothing in the batch bears on are accepted."""
    rows = [(k, f"i{k}", 100 + k, (False, 1, False, k)) for k in range(40)] + [(40, "i3", 200, (False, 1, True, 0)), (41, None, 105, (False, 1, True, 0))]
    df = spark.createDataFrame(rows, "rec_no bigint, id string, h bigint, ord struct<last: boolean, b: int, late: boolean, t: bigint>")
    df = df.withColumn("ord", F.struct("ord.*", "rec_no"))
    links = spark.createDataFrame([(106, 107), (107, 108)], "h bigint, g bigint")
    names, settle = [], history.settle
    monkeypatch.setattr(history, "settle", lambda x, name: names.append(name) or settle(x, name))
    for most in (0, 12, 1000):
        names.clear()
        monkeypatch.setattr(history, "ONE_TASK", most)
        assert sorted(r.rec_no for r in history._in_order(df, links).collect()) == [k for k in range(40) if k != 7]
        assert ("decided" in names) == (most == 0)
