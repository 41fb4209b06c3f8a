"""Substrings of five code points, their hashes and their Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.arrow import map_slices
from archivolt.llm.forms import comparable, hash_pair

WIDTH, LEAST, THRESHOLD = 5, 300, 0.7

_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WIDTH)]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; another function for each seed."""
    h = h ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of every substring of WIDTH code points, text by text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    if len(codes) < WIDTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(codes) - WIDTH + 1
    h = codes[:n] * _FACTORS[0]
    for k in range(1, WIDTH):
        h += codes[k : k + n] * _FACTORS[k]
    owner = np.repeat(np.arange(len(texts)), lengths)
    whole = owner[:n] == owner[WIDTH - 1 :]
    return mix(h[whole]), owner[:n][whole]


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text."""
    return np.unique(shingle_hashes([text])[0])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared / all of two sorted sets; 0 for two empty ones."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


class _Verify:
    def __init__(self, carry: list[str], threshold: float):
        self.carry, self.threshold = carry, threshold

    def __call__(self, part: pa.RecordBatch) -> dict:
        sets: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            if text not in sets:
                sets[text] = shingle_set(text)
            return sets[text]

        a, b = part.column("_text_a").to_pylist(), part.column("_text_b").to_pylist()
        similar = np.array([jaccard(of(x), of(y)) >= self.threshold for x, y in zip(a, b, strict=True)], bool)
        kept = part.filter(pa.array(similar))
        return {c: kept.column(c) for c in self.carry}


def verified(pairs: DataFrame, carry: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The ``carry`` columns of the pairs whose ``_text_a`` and ``_text_b`` reach ``threshold``, exactly."""
    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in carry)
    return map_slices(pairs.select(*carry, "_text_a", "_text_b"), schema, _Verify(carry, threshold))


class _Comparable:
    def __init__(self, key: str, title: str, content: str, least: int):
        self.key, self.title, self.content, self.least = key, title, content, least

    def __call__(self, part: pa.RecordBatch) -> dict:
        keys, texts, hashes = [], [], []
        columns = (part.column(c).to_pylist() for c in (self.key, self.title, self.content))
        for key, title, content in zip(*columns, strict=True):
            if content:
                text = comparable(title, content)
                if len(text) >= self.least:
                    keys.append(key)
                    texts.append(text)
                    hashes.append(hash_pair(text)[0])
        return {self.key: keys, "h": hashes, "text": texts}


def comparable_texts(df: DataFrame, key: str, title: str, content: str, least: int = LEAST) -> DataFrame:
    """(key, h, text) of the rows with content whose compared text has ``least`` code points or more.

    ``h`` is 64 bits of the text's hash; equal texts have equal ``h``.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, title, content).filter(F.length(content) > 0)
    return map_slices(rows, f"{key} {kind}, h bigint, text string", _Comparable(key, title, content, least))
