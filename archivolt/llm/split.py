"""Cutting oversized texts at natural boundaries with an overlap (problem 1)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.arrow import map_slices
from archivolt.llm.sentences import SentenceModel, Splitter, _blocks, fit

LIMIT, OVERLAP = 1500, 100
LEVELS = ("paragraph", "sentence", "word")

_RUN = re.compile(r"[^\W_]+")
_WORD_END = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def cut(
    sums: Sequence[int], ends: Sequence[Sequence[int]], starts: Sequence[int], limit: int, overlap: int
) -> list[tuple[int, int, str]]:
    """(first token, token after the last, kind of end) of the pieces of one item.

    ``sums[k]`` is the size of the first k tokens, ``ends`` holds sorted token offsets where
    a piece may end, best level first, ``starts`` sorted offsets where an overlap begins if
    it can, else at an end of the last level.
    Every piece has at most ``limit``, together they cover the item, and each but the first
    repeats at most ``overlap`` of the one before. A piece ends at the last boundary under
    the limit of the best level that has one past what is covered, else at the limit.
    One token larger than the limit is a piece of its own.
    """
    last = len(sums) - 1
    pieces: list[tuple[int, int, str]] = []
    start = covered = 0
    while sums[last] - sums[start] > limit:
        most = bisect_right(sums, sums[start] + limit) - 1
        if most <= covered:
            start, most = covered, max(covered + 1, bisect_right(sums, sums[covered] + limit) - 1)
        end, kind = most, "none"
        for level, places in zip(LEVELS, ends, strict=False):
            at = bisect_right(places, most) - 1
            if at >= 0 and places[at] > covered:
                end, kind = places[at], level
                break
        pieces.append((start, end, kind))
        covered = end
        if covered >= last:
            return pieces
        back = bisect_left(sums, sums[end] - overlap)
        start = next((p[at] for p in (starts, ends[-1]) if (at := bisect_left(p, back)) < len(p) and p[at] < end), back)
        start = max(start, pieces[-1][0] + 1) if start < end else end
    pieces.append((start, last, "end"))
    return pieces


class _Lazy(Sequence):
    """Word ends of a text, found when first asked for."""

    def __init__(self, text: str):
        self.text, self.found = text, None

    def _all(self) -> list[int]:
        if self.found is None:
            self.found = [m.end() for m in _WORD_END.finditer(self.text)]
        return self.found

    def __getitem__(self, k):
        return self._all()[k]

    def __len__(self) -> int:
        return len(self._all())


def pieces(text: str, splitter: Splitter, title: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of end) in code points of the pieces of a text."""
    if len(text) <= limit:
        return [(0, len(text), "end")]
    spans = splitter.spans(text, title)
    paragraphs = [b for _, b in _blocks(text)]
    return cut(range(len(text) + 1), (paragraphs, [b for _, b in spans], _Lazy(text)), [a for a, _ in spans], limit, overlap)


def cuts_whole(units: Sequence[tuple[int, int]], size: int, limit: int) -> bool:
    """Whether ``cut`` parts a text of ``size`` code points at the ends of ``units`` alone, without a hard cut.

    Prefix sums count the code points inside units only, so that a piece is measured without
    what stands between them.
    """
    inside = np.zeros(size + 1, np.int64)
    for a, b in units:
        inside[a + 1 : b + 1] = 1
    made = cut(np.cumsum(inside).tolist(), ([b for _, b in units],), (), limit, 0)
    return all(kind != "none" for _, _, kind in made)


def boundary(text: str, splitter: Splitter, title: str | None = None, limit: int = LIMIT) -> str:
    """The first of paragraph, sentence and word whose ends alone cut the text into pieces up to the limit; else none."""
    levels = (
        lambda: _blocks(text),
        lambda: splitter.spans(text, title),
        lambda: [m.span() for m in _RUN.finditer(text)],
    )
    return next((name for name, units in zip(LEVELS, levels, strict=True) if cuts_whole(list(units()), len(text), limit)), "none")


class _Found:
    def __init__(self, key: str, text: str, title: str | None, model: SentenceModel, limit: int):
        self.key, self.text, self.title, self.limit, self.splitter = key, text, title, limit, Splitter(model)

    def __call__(self, part: pa.RecordBatch) -> dict:
        texts = part.column(self.text).to_pylist()
        titles = part.column(self.title).to_pylist() if self.title else [None] * len(texts)
        made = [boundary(x, self.splitter, t, self.limit) for x, t in zip(texts, titles, strict=True)]
        return {self.key: part.column(self.key), "boundary": made}


class _Pieces:
    def __init__(self, key: str, text: str, title: str | None, model: SentenceModel, limit: int, overlap: int):
        self.key, self.text, self.title, self.limit, self.overlap = key, text, title, limit, overlap
        self.splitter = Splitter(model)

    def __call__(self, part: pa.RecordBatch) -> dict:
        out: dict = {self.key: [], "piece_no": [], "start_pos": [], "end_pos": [], "ends_at": [], "piece": []}
        texts = part.column(self.text).to_pylist()
        titles = part.column(self.title).to_pylist() if self.title else [None] * len(texts)
        for key, text, title in zip(part.column(self.key).to_pylist(), texts, titles, strict=True):
            for n, (a, b, kind) in enumerate(pieces(text, self.splitter, title, self.limit, self.overlap)):
                row = (key, n, a, b, kind, text[a:b])
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        return out


def oversized(df: DataFrame, key: str, text: str, title: str | None = None, limit: int = LIMIT, model: SentenceModel | None = None) -> DataFrame:
    """(key, boundary) of every row whose text is over ``limit`` code points; no shuffle."""
    model = model or fit(df, key, text)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, text, *([title] if title else [])).filter(F.length(text) > limit)
    return map_slices(rows, f"{key} {kind}, boundary string", _Found(key, text, title, model, limit))


def split(
    df: DataFrame, key: str, text: str, title: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP, model: SentenceModel | None = None
) -> DataFrame:
    """(key, piece_no, start_pos, end_pos, ends_at, piece) of every non-empty text.

    Texts up to ``limit`` come out as one piece. Null and empty texts have no row. Each row
    is cut where it is: no shuffle besides that of the sentence model's training sample.
    """
    model = model or fit(df, key, text)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, text, *([title] if title else [])).filter(F.length(text) > 0)
    schema = f"{key} {kind}, piece_no int, start_pos bigint, end_pos bigint, ends_at string, piece string"
    return map_slices(rows, schema, _Pieces(key, text, title, model, limit, overlap))
