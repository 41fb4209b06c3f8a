"""Near-duplicate records by a Hamming self-join over binary tries (problem 2).

Every distinct compared text has a sketch of one bit from each of 128 min-hashes of its
shingles: two texts of similarity s differ in about (1 - s) / 2 of the bits. Sketches meet
in tries by bands of five min-hashes; each trie is joined with itself by walking pairs of
nodes together, adding up differing bits, and leaving a pair of nodes as soon as the error
budget is exceeded. Pairs of texts that remain are verified exactly.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.arrow import int_lists, map_slices, record_batch
from archivolt.llm.shingles import LEAST, THRESHOLD, _Comparable, comparable_texts, mix, shingle_hashes, verified
from archivolt.workspace import BROADCAST_BYTES, settle

#: 60 bands of 5: a pair of similarity 0.7 meets with probability 0.99998, of 0.75 almost surely.
BANDS, ROWS = 60, 5
#: Passes of one-permutation hashing and bins of each; BANDS * ROWS values in all.
PASSES, BINS = 6, 50
#: Bits of a sketch, and how many may differ: the mean at 0.7 is 19.2, the deviation 4.
BITS, BUDGET = 128, 38
#: Texts of a band in one trie; a larger band is joined as pairs of blocks of this size.
TRIE_TEXTS = 4000


def min_hashes(hashes: tuple[np.ndarray, np.ndarray], texts: int, passes: int = PASSES) -> np.ndarray:
    """``passes`` * BINS min-hashes of each of ``texts`` texts from the (hash, text) of their shingles.

    An empty bin takes a fixed other bin's value.
    """
    (hashes, owner), n, made = hashes, texts, []
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in range(passes):
        h = mix(hashes, p) if p else hashes
        place = owner * BINS + (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
        least = np.full(n * BINS, empty)
        np.minimum.at(least, place, mix(h, 100 + p))
        least = least.reshape(n, BINS)
        bins = np.arange(BINS)
        for attempt in range(1, 200):
            missing = least == empty
            if not missing.any():
                break
            other = (bins * 31 + attempt * 17) % BINS
            borrowed = least[:, other]
            least = np.where(missing & (borrowed != empty), borrowed, least)
        made.append(least)
    return np.concatenate(made, axis=1)


def sketches(values: np.ndarray, count: int = BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high and low half of the sketch, ``count`` band keys) from min-hashes."""
    bits = (mix(values[:, :BITS], 7) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
    bands = values[:, : count * ROWS].reshape(len(values), count, ROWS)
    key = np.broadcast_to(np.arange(count, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key ^ bands[:, :, k], 11 + k)
    return packed[:, 0].view(np.int64), packed[:, 1].view(np.int64), key.view(np.int64)


def trie_join(codes: list[int], budget: int, bits: int = BITS) -> Iterator[tuple[int, int]]:
    """Pairs of places in sorted ``codes`` whose Hamming distance is at most ``budget``.

    The sorted list is the trie: a node is a range with a common prefix. Pairs of nodes are
    walked together from the root with the number of prefix bits that differ.
    """
    stack = [(0, len(codes), 0, len(codes), bits, 0)]
    while stack:
        a, b, c, d, depth, wrong = stack.pop()
        if wrong > budget or b - a <= 0 or d - c <= 0:
            continue
        same = a == c
        if (b - a) * (d - c) <= 16 or depth == 0:
            for i in range(a, b):
                for j in range(i + 1 if same else c, d):
                    if (codes[i] ^ codes[j]).bit_count() <= budget:
                        yield i, j
            continue
        if same:  # skip the bits that the whole node shares
            depth = (codes[a] ^ codes[b - 1]).bit_length()
            if depth == 0:
                yield from ((i, j) for i in range(a, b) for j in range(i + 1, b))
                continue
        depth -= 1
        bit = 1 << depth
        middle = bisect_left(codes, (codes[a] >> depth | 1) << depth if not codes[a] & bit else codes[a] >> depth << depth, a, b)
        if same:
            stack += [(a, middle, a, middle, depth, wrong), (middle, b, middle, b, depth, wrong), (a, middle, middle, b, depth, wrong + 1)]
            continue
        other = bisect_left(codes, (codes[c] >> depth | 1) << depth if not codes[c] & bit else codes[c] >> depth << depth, c, d)
        stack += [
            (a, middle, c, other, depth, wrong),
            (middle, b, other, d, depth, wrong),
            (a, middle, other, d, depth, wrong + 1),
            (middle, b, c, other, depth, wrong + 1),
        ]


class _Sketch:
    """Class and sketch of every compared row; bands once for each text of a slice."""

    def __init__(self, key: str, title: str, content: str, least: int):
        self.key, self.compared = key, _Comparable(key, title, content, least)

    def __call__(self, part: pa.RecordBatch) -> dict:
        rows = self.compared(part)
        first = {h: k for k, h in reversed(list(enumerate(rows["h"])))}
        chosen = sorted(first.values())
        values = min_hashes(shingle_hashes([rows["text"][k] for k in chosen]), len(chosen))
        high, low, bands = sketches(values) if chosen else (np.zeros(0, np.int64),) * 2 + (np.zeros((0, BANDS), np.int64),)
        place = {k: n for n, k in enumerate(chosen)}
        n = len(rows["h"])
        s1, s2, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
        for k in range(n):
            if k in place:
                s1[k], s2[k] = high[place[k]], low[place[k]]
            offsets[k + 1] = offsets[k] + (BANDS if k in place else 0)
        return {self.key: rows[self.key], "h": rows["h"], "s1": s1, "s2": s2, "bands": int_lists(bands.ravel(), offsets, pa.int64())}


def _join_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes from rows sorted by trie and class."""
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    left_a: list[int] = []
    left_b: list[int] = []
    trie, texts = None, {}

    def joined() -> None:
        if len(texts) < 2:
            return
        rows = sorted((code, h, salt) for h, (code, salt) in texts.items())
        salts = {salt for _, _, salt in rows}
        for i, j in trie_join([r[0] for r in rows], BUDGET) if len(rows) > 2 else [(0, 1)] * ((rows[0][0] ^ rows[1][0]).bit_count() <= BUDGET):
            if len(salts) == 1 or rows[i][2] != rows[j][2]:
                left_a.append(min(rows[i][1], rows[j][1]))
                left_b.append(max(rows[i][1], rows[j][1]))

    for batch in batches:
        band, block = batch.column("band").to_numpy(), batch.column("block").to_numpy()
        n = len(band)
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = (band[1:] != band[:-1]) | (block[1:] != block[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        # tries of one text, apart from the batch's first and last, which may go on in others
        busy = (ends - starts > 1) | (starts == 0) | (ends == n)
        h, s1, s2, salt = (batch.column(c).to_numpy() for c in ("h", "s1", "s2", "salt"))
        u1, u2 = s1.view(np.uint64), s2.view(np.uint64)
        for a, b in zip(starts[busy].tolist(), ends[busy].tolist(), strict=True):
            own = (int(band[a]), int(block[a]))
            if own != trie:
                joined()
                trie, texts = own, {}
            for k in range(a, b):
                texts[int(h[k])] = (int(u1[k]) << 64 | int(u2[k]), int(salt[k]))
        if len(left_a) > 50_000:
            yield record_batch({"a": left_a, "b": left_b}, target)
            left_a.clear()
            left_b.clear()
    joined()
    yield record_batch({"a": left_a, "b": left_b}, target)


def _once(rows: DataFrame) -> DataFrame:
    """One row of each ``h``. Rows of texts that only one slice holds stay where they are while the rest is small."""
    repeated = settle(rows.groupBy("h").agg(F.count("*").alias("_n")).filter("_n > 1").select("h"), "repeated")
    if repeated.count() * 8 > BROADCAST_BYTES:
        return rows.dropDuplicates(["h"])
    repeated = F.broadcast(repeated)
    return rows.join(repeated, "h", "left_anti").unionByName(rows.join(repeated, "h", "left_semi").dropDuplicates(["h"]))


def _tries(rows: DataFrame) -> DataFrame:
    """(band, block, salt, h, s1, s2): one row for each trie a text goes to; ``rows`` holds each text once.

    Bands that hold more than about TRIE_TEXTS texts, seen in one text of 64, are split
    into blocks by a salt; each pair of blocks is a trie of its own.
    """
    bands = rows.select("h", "s1", "s2", F.explode("bands").alias("band"))
    hot = (
        bands.filter(F.pmod(F.xxhash64("h"), F.lit(64)) == 0)
        .groupBy("band")
        .agg(F.count("*").alias("_seen"))
        .filter(F.col("_seen") > TRIE_TEXTS // 64)
        .select("band", F.ceil(F.col("_seen") * 64 / TRIE_TEXTS).cast("int").alias("_blocks"))
    )
    hot = settle(hot, "hot-bands")
    n = hot.count()
    if not n:
        return bands.select("band", F.lit(0).alias("block"), F.lit(0).alias("salt"), "h", "s1", "s2")
    hot = F.broadcast(hot) if n * 24 <= BROADCAST_BYTES else hot
    spread = bands.join(hot, "band", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    spread = spread.withColumn("salt", F.pmod(F.xxhash64("h"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    spread = spread.withColumn("_other", other)
    return spread.select(
        "band", (F.least("salt", "_other") * 100_000 + F.greatest("salt", "_other")).cast("int").alias("block"), "salt", "h", "s1", "s2"
    )


class NearDuplicates:
    """Near-duplicate rows of a table: classes of equal compared texts and links between them.

    Rows without content and rows whose compared text (title, space, content) is under
    ``least`` code points are in no class. Nulls count as empty. Keys should be unique; a
    repeated key gives repeated pairs once. Other columns of the table are not read.
    """

    def __init__(self, df: DataFrame, key: str, title: str, content: str, threshold: float = THRESHOLD, least: int = LEAST):
        self.key, kind = key, df.schema[key].dataType.simpleString()
        schema = f"{key} {kind}, h bigint, s1 bigint, s2 bigint, bands array<bigint>"
        rows = settle(map_slices(df.select(key, title, content), schema, _Sketch(key, title, content, least)), "sketches")
        #: (key, h): the class of every compared row.
        self.members = rows.select(key, "h")
        tries = _tries(_once(rows.filter(F.size("bands") > 0).select("h", "s1", "s2", "bands"))).repartition("band", "block").sortWithinPartitions("band", "block")
        candidates = settle(tries.mapInArrow(_join_tries, "a bigint, b bigint").distinct(), "candidates")
        wanted = candidates.select(F.explode(F.array("a", "b")).alias("h")).distinct()
        stands_for = settle(self.members.join(wanted, "h", "left_semi").groupBy("h").agg(F.min(key).alias(key)), "classes")
        few = stands_for.count() * 24 <= BROADCAST_BYTES
        needed = F.broadcast(stands_for.select(key)) if few else stands_for.select(key)
        texts = comparable_texts(df.join(needed, key, "left_semi"), key, title, content, least)
        texts = texts.select("h", "text")
        pairs = candidates.join(texts.select(F.col("h").alias("a"), F.col("text").alias("_text_a")), "a")
        pairs = pairs.join(texts.select(F.col("h").alias("b"), F.col("text").alias("_text_b")), "b")
        #: (a, b): linked classes of different texts, each link once.
        self.links = settle(verified(pairs, ["a", "b"], threshold), "links")

    def pairs(self) -> DataFrame:
        """(rec_a, rec_b): every pair of rows, exact repeats included, the smaller key first."""
        m, key = self.members, self.key
        a = m.select(F.col("h").alias("a"), F.col(key).alias("_x"))
        b = m.select(F.col("h").alias("b"), F.col(key).alias("_y"))
        across = self.links.join(a, "a").join(b, "b")
        repeated = m.groupBy("h").agg(F.count("*").alias("_n")).filter("_n > 1").select("h")
        copies = m.join(repeated, "h", "left_semi")
        within = copies.select("h", F.col(key).alias("_x")).join(copies.select("h", F.col(key).alias("_y")), "h")
        return (
            across.select("_x", "_y")
            .unionByName(within.filter(F.col("_x") < F.col("_y")).select("_x", "_y"))
            .select(F.least("_x", "_y").alias("rec_a"), F.greatest("_x", "_y").alias("rec_b"))
            .filter(F.col("rec_a") != F.col("rec_b"))
            .distinct()
        )

    def groups(self) -> DataFrame:
        """(key, class_id, group_id, links): a row for each compared row.

        ``class_id`` is the least key with the same text, ``group_id`` the least key that
        chains of links lead to, ``links`` the number of rows of other texts linked to it.
        """
        key = self.key
        classes = self.members.groupBy("h").agg(F.min(key).alias("class_id"), F.count("*").alias("_n"))
        classes = settle(classes, "class-sizes")
        both = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = (
            both.join(classes.select(F.col("h").alias("b"), "_n"), "b").groupBy("a").agg(F.sum("_n").alias("links"))
        )
        ends = self.links
        for end in ("a", "b"):
            ends = ends.join(classes.select(F.col("h").alias(end), F.col("class_id").alias(f"_{end}")), end)
        label = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        rows = classes.join(degree.withColumnRenamed("a", "h"), "h", "left").join(label.withColumnRenamed("node", "class_id"), "class_id", "left")
        return self.members.join(rows, "h").select(
            key, "class_id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")
        )


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the component of every node that has an edge (a, b).

    Large-star and small-star steps until the edges no longer change; every step is written
    to the shared folder.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "star")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), "m")
        step = settle(small.select("u", F.col("m").alias("v")).filter("u <> v").distinct(), "star")
        total = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
        if step.agg(F.count("*"), total).first() == edges.agg(F.count("*"), total).first():
            break
        edges = step
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
