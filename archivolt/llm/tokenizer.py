"""Encoding a corpus with a public byte-level BPE tokenizer (problem 7).

Two tiers: a minimal perfect hash finds whole pre-tokens that are in the vocabulary; the
others are merged with a heap over linked bytes. Everything before the heap works on
whole slices: pre-tokens are cut by character classes, hashed by prefix sums, and each
distinct pre-token is looked up once. A missed pre-token is first cut where no token of the
vocabulary can reach over, so that the heap sees each short stretch once.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from archivolt.llm.arrow import int_lists, map_slices

#: Default place of the vocabulary; every function takes another.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Merged stretches a worker keeps; emptied when full, results do not depend on it.
KEPT = 400_000

# The characters with the Unicode property White_Space.
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Endings split off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


@lru_cache(1)
def _classes() -> np.ndarray:
    """Character class by code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[list(WHITE_SPACE)] = SPACE
    return table


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_P, _INVERSE)):
            made = np.full(size, base, np.uint64)
            made[0] = 1
            _powers[k] = np.multiply.accumulate(made)
    return _powers[0], _powers[1]


def _segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment of ``data``."""
    forward, back = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * back[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class PerfectHash:
    """A minimal perfect hash of n distinct 64-bit keys onto 0..n-1, by hash and displace.

    Keys fall into n/3 buckets; the largest first, each bucket takes the least displacement
    that puts all its keys on free slots; a bucket of one key stores the slot itself.
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        bucket = self._bucket(keys)
        self.displacement = np.zeros(self.buckets, np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        taken = bytearray(n)
        self.slot_of = np.zeros(n, np.int64)
        free = 0
        for b in np.argsort(-sizes, kind="stable").tolist():
            size = int(sizes[b])
            if not size:
                break
            members = order[bounds[b] : bounds[b + 1]].tolist()
            if size == 1:
                while taken[free]:
                    free += 1
                self.displacement[b] = -free - 1
                taken[free] = 1
                self.slot_of[members[0]] = free
                continue
            own = [int(keys[m]) for m in members]
            d = 0
            while True:
                slots = [self._place(key, d) for key in own]
                if len(set(slots)) == size and not any(taken[x] for x in slots):
                    break
                d += 1
            self.displacement[b] = d
            for m, x in zip(members, slots, strict=True):
                taken[x] = 1
                self.slot_of[m] = x

    def _place(self, key: int, d: int) -> int:
        h = (key ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        h = (h * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
        return (h >> 32) % self.n

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(7)) % np.uint64(self.buckets)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key outside the set, some slot."""
        d = self.displacement[self._bucket(keys)]
        h = keys ^ (np.maximum(d, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = h * np.uint64(0xC2B2AE3D27D4EB4F)
        return np.where(d < 0, -d - 1, ((h >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64))


class Encoder:
    """A vocabulary of byte strings with ranks, and what encoding needs of it."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        tokens = list(self.ranks)
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        keys = _segment_hashes(self.bytes, starts, ends)
        self.hash = PerfectHash(keys)
        slot = self.hash.slot_of
        self.key, self.id, self.start, self.length = (np.zeros(len(tokens), t) for t in (np.uint64, np.int32, np.int64, np.int64))
        self.key[slot], self.start[slot], self.length[slot] = keys, starts, lengths
        self.id[slot] = np.fromiter(self.ranks.values(), np.int32, len(tokens))
        self.pairs, self.tokens2 = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        self.triples = np.zeros(1 << 24, bool)
        wide = self.bytes.astype(np.int64)
        inner = np.ones(len(wide), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        self.pairs[wide[at] << 8 | wide[at + 1]] = True
        at = at[inner[np.minimum(at + 1, len(wide) - 1)]]
        self.triples[wide[at] << 16 | wide[at + 1] << 8 | wide[at + 2]] = True
        two = starts[lengths == 2]
        self.tokens2[wide[two] << 8 | wide[two + 1]] = True
        self.merged: dict[bytes, list[int]] = {}

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Id of each segment that is a token, else -1."""
        slot = self.hash.slots(keys)
        found = (self.key[slot] == keys) & (self.length[slot] == ends - starts)
        hits = np.flatnonzero(found)
        if len(hits):  # the hash is only trusted once the bytes agree
            sizes = self.length[slot[hits]]
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            same = data[np.repeat(starts[hits], sizes) + within] == self.bytes[np.repeat(self.start[slot[hits]], sizes) + within]
            bad = np.add.reduceat(~same, np.cumsum(sizes) - sizes) > 0
            found[hits[bad]] = False
        return np.where(found, self.id[slot], -1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a byte string: the pair of least rank is merged first, by a heap over linked bytes."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = []
        for k in range(n - 1):
            rank = ranks.get(piece[k : k + 2])
            if rank is not None:
                heap.append((rank, k, k + 1, k + 2))
        heapq.heapify(heap)
        while heap:
            _, left, right, stop = heapq.heappop(heap)
            if not (alive[left] and right < n and alive[right] and after[left] == right and end[right] == stop and end[left] == right):
                continue
            end[left], alive[right] = stop, False
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
                rank = ranks.get(piece[left : end[after[right]]])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, after[right], end[after[right]]))
            previous = before[left]
            if previous >= 0:
                rank = ranks.get(piece[previous:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, previous, left, stop))
        ids, k = [], 0
        while k < n:
            ids.append(ranks[piece[k : end[k]]])
            k = after[k]
        return ids

    def _missed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number a segment, for segments that are no tokens."""
        sizes = ends - starts
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        own = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])].astype(np.int64)
        n = len(own)
        first = np.zeros(n, bool)
        first[offsets[:-1]] = True
        pair = np.zeros(n, np.int64)
        pair[1:] = own[:-1] << 8 | own[1:]
        inside = ~first  # there is a byte before, in the same segment
        triple = np.zeros(n, bool)  # the three bytes that end here are in a token
        at = np.flatnonzero(inside & np.concatenate(([False], inside[:-1])))
        triple[at] = self.triples[own[at - 2] << 16 | own[at - 1] << 8 | own[at]]
        next_triple = np.concatenate((triple[1:], [False]))
        next_triple[np.append(offsets[1:-1] - 1, n - 1)] = False
        joined = inside & self.pairs[pair] & (self.tokens2[pair] | triple | next_triple)
        cuts = np.flatnonzero(~joined)
        stops = np.append(cuts[1:], n)
        keys = _segment_hashes(own.astype(np.uint8), cuts, stops)
        unique, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        ids = self.lookup(own.astype(np.uint8), cuts[index], stops[index], unique)
        lists: list[list[int]] = [[x] for x in ids.tolist()]
        raw = own.astype(np.uint8).tobytes()
        if len(self.merged) > KEPT:
            self.merged.clear()
        for k in np.flatnonzero(ids < 0).tolist():
            piece = raw[cuts[index[k]] : stops[index[k]]]
            got = self.merged.get(piece)
            if got is None:
                got = self.merge(piece)
                if len(piece) <= 64:
                    self.merged[piece] = got
            lists[k] = got
        flat, count = _ragged(lists, inverse)
        return flat, np.add.reduceat(count, np.searchsorted(cuts, offsets[:-1]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of the texts; null and empty texts have no ids."""
        clean = [t or "" for t in texts]
        joined = "".join(clean)
        document = np.concatenate(([0], np.cumsum([len(t) for t in clean]))).astype(np.int64)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        first = _pretokens(codes, document)
        starts = np.flatnonzero(first)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.concatenate(([0], np.cumsum(width)))
        byte_starts = place[starts]
        byte_ends = np.append(byte_starts[1:], len(data))
        keys = _segment_hashes(data, byte_starts, byte_ends)
        unique, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        u_starts, u_ends = byte_starts[index], byte_ends[index]
        ids = self.lookup(data, u_starts, u_ends, unique)
        count = np.ones(len(unique), np.int64)
        missed = np.flatnonzero(ids < 0)
        flat = ids.astype(np.int32)
        if len(missed):
            got, each = self._missed(data, u_starts[missed], u_ends[missed])
            count[missed] = each
            flat = np.empty(count.sum(), np.int32)
            at = np.cumsum(count) - count
            hit = ids >= 0
            flat[at[hit]] = ids[hit]
            flat[np.repeat(at[missed] - (np.cumsum(each) - each), each) + np.arange(len(got))] = got
        out, each = _gather(flat, count, inverse)
        ends = np.concatenate(([0], np.cumsum(each)))
        return out, ends[np.searchsorted(starts, document)]


def _gather(flat: np.ndarray, count: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ``index`` from ragged ``flat``, one after another."""
    at = np.cumsum(count) - count
    each = count[index]
    place = np.repeat(at[index] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    return flat[place], each


def _ragged(lists: list[list[int]], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.array([len(x) for x in lists], np.int64)
    flat = np.array([y for x in lists for y in x], np.int32)
    return _gather(flat, count, index)


def _pretokens(codes: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each character.

    Runs of letters, of numbers and of other characters, each with one space before it; an
    ending after an apostrophe; runs of white space without the last character before more text.
    """
    n = len(codes)
    kind = _classes()[codes]
    begin = np.zeros(n + 1, bool)
    begin[document] = True
    begin, finish = begin[:-1], begin[1:]
    before = np.concatenate(([OTHER], kind[:-1]))
    change = begin | (kind != before)
    space = kind == SPACE
    following_text = np.concatenate((~space[1:], [False])) & ~finish
    blank_last = space & following_text
    first = change.copy()
    first |= blank_last
    attached = blank_last & (codes == 0x20)
    first[1:] &= ~attached[:-1]
    quotes = np.flatnonzero((codes == 0x27) & first & (begin | (before != OTHER)))
    if len(quotes):
        stop = document[np.searchsorted(document, quotes, side="right")]
        for q, end in zip(quotes.tolist(), stop.tolist(), strict=True):
            tail = "".join(map(chr, codes[q + 1 : min(q + 3, end)]))
            length = next((len(c) for c in CONTRACTIONS if tail.startswith(c)), 0)
            if length:
                first[q + 1 : q + 1 + length] = False
                after = q + 1 + length
                if after < end:
                    first[after] = True
    return first


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once a worker."""
    return Encoder(path)


class _Encode:
    def __init__(self, key: str, text: str, path: str, lengths_only: bool):
        self.key, self.text, self.path, self.lengths_only = key, text, path, lengths_only

    def __call__(self, part: pa.RecordBatch) -> dict:
        ids, offsets = encoder(self.path).encode(part.column(self.text).to_pylist())
        if self.lengths_only:
            return {self.key: part.column(self.key), "n_tokens": np.diff(offsets)}
        return {self.key: part.column(self.key), "ids": int_lists(ids, offsets, pa.int32())}


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row, without special tokens; null and empty texts give an empty list.

    ``vocabulary`` is a file of base64 tokens and ranks that every executor can read. Rows
    are encoded where they are: no shuffle. Repeated rows come out as often as they come in.
    """
    field = StructField(key, df.schema[key].dataType)
    schema = StructType([field, StructField("ids", ArrayType(IntegerType()))])
    return map_slices(df.select(key, text), schema, _Encode(key, text, vocabulary, False), rows=1024, size=1 << 20)


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have none."""
    kind = df.schema[key].dataType.simpleString()
    return map_slices(df.select(key, text), f"{key} {kind}, n_tokens bigint", _Encode(key, text, vocabulary, True), rows=1024, size=1 << 20)


@lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every token by its id."""
    with open(path, "rb") as file:
        parts = [line.split() for line in file if line.strip()]
    made = [b""] * len(parts)
    for token, number in parts:
        made[int(number)] = base64.b64decode(token)
    return made


class _Decode:
    def __init__(self, key: str, path: str):
        self.key, self.path = key, path

    def __call__(self, part: pa.RecordBatch) -> dict:
        known = token_bytes(self.path)
        made = [b"".join(map(known.__getitem__, ids)).decode("utf-8", "surrogatepass") for ids in part.column("ids").to_pylist()]
        return {self.key: part.column(self.key), "text": made}


def texts_of(encoded: DataFrame, key: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of (key, ids): what was encoded, nulls as empty texts."""
    kind = encoded.schema[key].dataType.simpleString()
    return map_slices(encoded.select(key, "ids"), f"{key} {kind}, text string", _Decode(key, vocabulary), rows=1024, size=1 << 20)
