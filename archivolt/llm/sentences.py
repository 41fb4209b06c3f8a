"""Sentences of texts in many languages and scripts (problem 5).

Candidate boundaries are terminal punctuation with its closing marks, spaces in scripts
that have no terminal punctuation, and line breaks before list marks; a line of white
space always ends a sentence. A maximum-entropy model decides on each candidate from the
neighbouring tokens, their case, length, digits and script. It is trained on reliable
places only: ends of paragraphs are boundaries; punctuation before a lower-case word is
none, nor is a token that often stands before more text and never at a paragraph's end.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from archivolt.llm.arrow import bounded_sample, int_lists, map_slices, record_batch, slices
from archivolt.llm.forms import IGNORABLE, UNSETTLED, consistent_form, unsure

#: Bound of the training sample: rows with the least hash of key and text.
SAMPLE_ROWS = 8000
#: Counted cases of a task that are sent on before it counts further.
CASES = 200_000
#: Chance below which a token's absence from paragraph ends is reliable.
CHANCE = 0.0005
#: Share of a token's sightings at paragraph ends that makes a space after it a boundary.
SPACE_RATE = 0.05

TERMINAL = ".!?…。！？｡．؟۔।॥‽"
CLOSING = "”\"»」’)）]』】'›〉》"
OPENING = "“\"«「‘(（[『【¿¡„'‹〈《"
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ⺀-⿟々"
UNSPACED = "฀-๿຀-໿က-႟ក-៿"
HIDDEN = "".join(sorted(c for c in IGNORABLE if c <= "\uffff"))

BLANK = re.compile(r"(?:\r\n|\n|\r)(?:[^\S\r\n]*(?:\r\n|\n|\r))+")
MARK = re.compile(r"[^\S\r\n]*(?:[*•\-–·‣◦▪]+|\(?\d{1,3}[.)]|（\d{1,3}）|\d{1,3}[、．])(?=\s)")
_H = f"[{re.escape(HIDDEN)}]*"
_TAIL = rf"(?:{_H}[{TERMINAL}])*(?P<close>(?:{_H}[{re.escape(CLOSING)}“]|[    ]?»)*){_H}"
PUNCTUATED = rf"(?P<run>[{TERMINAL}]){_TAIL}(?P<gap>\s*)"
CANDIDATE = re.compile(PUNCTUATED)
CANDIDATE_UNSPACED = re.compile(
    rf"{PUNCTUATED}|(?<=[{UNSPACED}])(?P<space>[^\S\r\n]+|[^\S\r\n]*(?:\r\n|\n|\r)\s*)(?=\S)"
)
LIST_LINE = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?=[*•\-–·‣◦▪]\s)")
_wide = re.compile(f"[{CJK}。！？｡]")
_unspaced = re.compile(f"[{UNSPACED}]")


class _Kinds(dict):
    """Kind of a character: w(ide), u(nspaced), s(pace), h(idden), o(pening), or other."""

    def __missing__(self, c: str) -> str:
        kind = "w" if _wide.match(c) else "u" if _unspaced.match(c) else "s" if c.isspace() else ""
        self[c] = kind = kind or ("h" if c in IGNORABLE else "o" if c in OPENING else "x")
        return kind


KIND = _Kinds()
NOT_BEFORE = set(",;:，；：、)）]】」』”»،؛")


@dataclass
class SentenceModel:
    """Weights by feature, and how often a token stood in a paragraph and at its end."""

    weights: dict[str, float] = field(default_factory=dict)
    inside: dict[str, int] = field(default_factory=dict)
    at_end: dict[str, int] = field(default_factory=dict)
    #: So many sightings without one at a paragraph's end make a token reliable.
    reliable: int = 30


class Candidate(NamedTuple):
    end: int
    next: int
    run: str
    key: str
    left: str
    right: str
    word: str


class _Plain(dict):
    """Consistent forms of this worker's recent tokens; emptied when it grows."""

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        odd = UNSETTLED.search(token) or unsure(token)
        self[token] = made = consistent_form(token) if odd else token
        return made


_plains = _Plain()


def _plain(token: str) -> str:
    return token if token.isascii() else _plains[token]


def _script(c: str) -> str:
    if c < "ɐ" or "Ḁ" <= c <= "ỿ":
        return "l"
    if "Ѐ" <= c <= "ԯ":
        return "c"
    if KIND[c] in "wu":
        return KIND[c]
    return "g" if "Ͱ" <= c <= "Ͽ" else "o"


_CUT = re.compile(f"[{CJK}{re.escape(OPENING)}]")


def _left(text: str, start: int, at: int, tail: str) -> tuple[str, str]:
    """Key and class of what stands before a candidate at ``at`` in a block from ``start``."""
    before = text[max(start, at - 32) : at]
    if not before:
        return "^" + tail, "^"
    if before[-1].isspace():
        before = before.rstrip()
        tail = " " + tail
        if not before:
            return "^" + tail, "^"
    kind = KIND[before[-1]]
    if kind == "w":
        width = 2 if len(tail) == 1 or tail[-1] in TERMINAL else 1
        return _plain(before[-width - 2 :])[-width:] + tail, "w"
    if kind == "u":
        return _plain(before[-12:].rsplit(None, 1)[-1])[-3:] + tail, "u"
    parts = before.rsplit(None, 2)
    token = parts[-1]
    if not token.isascii():
        if (cut := [m.end() for m in _CUT.finditer(token)]) and cut[-1] < len(token):
            token = token[cut[-1] :]
        token = _plain(token)
        if not token:
            return "^" + tail, "^"
    elif token[0] in OPENING:
        token = token.lstrip(OPENING) or token
    if token.isdigit():
        previous = _plain(parts[-2]) if len(parts) > 1 else "^"
        return f"{previous.lower()[-8:]} #{tail}", "#"
    size = "1" if len(token) == 1 else "2" if len(token) <= 3 else "5" if len(token) <= 5 else "9"
    case = "U" if token.isupper() else "T" if token[:1].isupper() else "l" if token[:1].islower() else "n"
    dots = "." if "." in token else ""
    digits = "" if token.isalpha() else "#" if any(map(str.isdigit, token)) else ""
    return token[-12:].lower() + tail, f"{_script(token[-1])}{size}{case}{dots}{digits}"


_WORD = re.compile(r"\w+")


def _right(text: str, at: int, stop: int) -> tuple[str, str]:
    """Class and first word of what follows a candidate."""
    here, opened = at, ""
    while here < stop and (kind := KIND[text[here]]) in "oh":
        opened = "“" if kind == "o" else opened
        here += 1
    if here >= stop:
        return "$", ""
    c = text[here]
    if kind == "w":
        return opened + "w", _plain(text[here : here + 3])[:2]
    if kind == "u":
        return opened + "u", text[here : here + 4]
    match = _WORD.match(text, here, min(stop, here + 16))
    word = (_plain(match.group()) if match else c) or c
    first = word[0]
    kind = "d" if first.isdigit() else "l" if first.islower() else "U" if first.isupper() else "n" if first.isalpha() else "p"
    if match and kind == "l" and match.end() + 1 < stop and text[match.end()] in ".@/" and text[match.end() + 1].isalnum():
        kind = "x"  # a file, a host or a path
    return opened + kind + _script(first), word.lower()


def _blocks(text: str) -> list[tuple[int, int]]:
    """Places between lines of white space, without white space at their ends."""
    made, start = [], 0
    for match in [*BLANK.finditer(text), None]:
        stop = match.start() if match else len(text)
        a, b = start, stop
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            made.append((a, b))
        start = match.end() if match else stop
    return made


def _candidates(text: str, start: int, stop: int) -> list[Candidate]:
    made = []
    pattern = CANDIDATE if text.isascii() or not _unspaced.search(text, start, stop) else CANDIDATE_UNSPACED
    for m in pattern.finditer(text, start, stop):
        after = m.end()
        if after >= stop:
            continue
        following = text[after]
        if following in NOT_BEFORE:
            continue
        run = m.group("run")
        if run is None:
            key, left = _left(text, start, m.start(), "")
            made.append(Candidate(m.start(), after, " ", key, left, *_right(text, after, stop)))
            continue
        at, end, close = m.start(), m.start("gap"), m.group("close")
        if after == end and not close and run in ".?…" and following < "\u2e80" and KIND[text[at - 1] if at > start else " "] != "w":
            continue
        if close and "“" in close:  # closes a quotation only after a low opening mark
            cut = m.start("close") + close.index("“")
            opened = max(text.rfind("„", start, cut), text.rfind("“", start, cut))
            if opened < 0 or text[opened] != "„":
                end = after = cut
                close = close[: close.index("“")]
        tail = text[at : m.start("close")] + close
        if not (len(tail) == 1 or tail.isascii()):
            tail = _plain("".join(c for c in tail if KIND[c] not in "hs"))
        last = tail[-1 - len(close) :][:1] if close else tail[-1]
        if after == end:
            before = KIND[text[at - 1]] if at > start else "s"
            wide = KIND[text[after]] == "w" or (text[after] == "“")
            if last in ".…" and not (close and wide):
                if not (before == "w" or (wide and not text[at - 1 : at].isalnum())):
                    continue
            elif not (KIND[last] == "w" or wide or before == "w"):
                continue
        if run == "." and tail == "." and text[at - 1 : at].isalnum():
            mark = MARK.match(text, _line_start(text, start, at), stop)
            if mark and mark.end() == at + 1:
                continue
        key, left = _left(text, start, at, tail)
        made.append(Candidate(end, after, tail[0] + ("”" if close else ""), key, left, *_right(text, after, stop)))
    if LIST_LINE.search(text, start, stop):
        known = {c.next for c in made}
        for m in LIST_LINE.finditer(text, start, stop):
            if m.end() not in known:
                made.append(Candidate(m.start(), m.end(), "\n", "\n", "\n", "m", ""))
        made.sort(key=lambda c: c.end)
    return made


def _line_start(text: str, start: int, at: int) -> int:
    return max(start, text.rfind("\n", start, at) + 1, text.rfind("\r", start, at) + 1)


def _bucket(run: str, inside: int, at_end: int, reliable: int) -> str:
    """How a token stands to paragraph ends; a mere space needs an ending that is often seen there."""
    if run == " ":
        return "some" if at_end >= 3 and at_end >= SPACE_RATE * (inside + at_end) else "never"
    if at_end > 0:
        return "some"
    return "never" if inside >= reliable else "few"


def _features(c: Candidate, bucket: str) -> tuple[str, ...]:
    return (
        "B" + bucket,
        "P" + c.run,
        "L" + c.left,
        "R" + c.right,
        f"BR{bucket} {c.right}",
        f"PR{c.run} {c.right}",
        f"LR{c.left} {c.right}",
        f"BL{bucket} {c.left}",
        "W" + c.word,
        "K" + c.key,
    )


Cases = tuple[Counter[str], Counter[str], Counter[tuple], Counter[tuple]]


def train(texts: list[str], rounds: int = 150, penalty: float = 1e-4) -> SentenceModel:
    """Fit a model to the reliable boundaries of ``texts``; no texts give a model that splits at every candidate."""
    return _fitted(_cases(texts), rounds, penalty)


def train_all(texts: DataFrame, rounds: int = 150, penalty: float = 1e-4) -> SentenceModel:
    """As ``train`` of all rows of the column ``text``: cases are counted where the texts are."""
    schema = "kind int, case array<string>, n bigint"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[pa.RecordBatch]:
            for kind, counter in enumerate(cases):
                own = [[k] if kind < 2 else list(k) for k in counter]
                yield record_batch({"kind": [kind] * len(own), "case": own, "n": list(counter.values())}, target)

        cases = _cases([])
        for part in slices(batches):
            for counter, more in zip(cases, _cases(part.column("text").to_pylist()), strict=True):
                counter.update(more)
            if sum(map(len, cases)) > CASES:
                yield from made()
                cases = _cases([])
        yield from made()

    found = texts.select("text").mapInArrow(run, schema).groupBy("kind", "case").agg(F.sum("n").alias("n")).toArrow()
    cases = _cases([])
    column = found.column("case").combine_chunks()
    coded = column.flatten().dictionary_encode()  # each token is held once
    tokens, codes, offsets = coded.dictionary.to_pylist(), coded.indices.to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    made = [(kind, tuple([tokens[k] for k in codes[a:b]]), n) for kind, a, b, n in zip(found.column("kind").to_pylist(), offsets, offsets[1:], found.column("n").to_pylist(), strict=False)]
    del found, column, coded, tokens, codes
    for kind, case, n in sorted(made):
        cases[kind][case[0] if kind < 2 else case] = n
    del made
    return _fitted(cases, rounds, penalty)


def _cases(texts: list[str]) -> Cases:
    """Counts of the candidates inside blocks, of the ends of blocks, and of both with what surrounds them."""
    inside: Counter[str] = Counter()
    at_end: Counter[str] = Counter()
    open_cases: Counter[tuple] = Counter()
    ends: Counter[tuple] = Counter()
    for text in texts:
        blocks = _blocks(text)
        for k, (start, stop) in enumerate(blocks):
            for c in _candidates(text, start, stop):
                inside[c.key] += 1
                open_cases[(c.run, c.key, c.left, c.right, c.word)] += 1
            if k + 1 < len(blocks):
                last = _end_of(text, start, stop)
                if last:
                    right, word = _right(text, blocks[k + 1][0], blocks[k + 1][1])
                    at_end[last[1]] += 1
                    ends[(*last, right, word)] += 1
    return inside, at_end, open_cases, ends


def _fitted(cases: Cases, rounds: int, penalty: float) -> SentenceModel:
    inside, at_end, open_cases, ends = cases
    rate = min(0.5, (sum(at_end.values()) + 1) / (sum(at_end.values()) + sum(inside.values()) + 2))
    reliable = max(8, math.ceil(math.log(CHANCE) / math.log(1 - rate)))
    rows: Counter[tuple] = Counter()
    for (run, key, left, right, word), n in open_cases.items():
        bucket = _bucket(run, inside[key], at_end[key], reliable)
        c = Candidate(0, 0, run, key, left, right, word)
        if bucket == "never" or (right.lstrip("“")[0] == "l" and run not in " \n"):
            rows[(c, bucket, 0)] += n
        if run == "\n":
            rows[(c, bucket, 1)] += n
    for (run, key, left, right, word), n in ends.items():
        bucket = _bucket(run, inside[key], at_end[key] - 1, reliable)
        if run == " " and bucket == "never":
            continue
        rows[(Candidate(0, 0, run, key, left, right, word), bucket, 1)] += n
    model = SentenceModel(
        inside={k: n for k, n in inside.items() if n >= reliable or at_end[k]},
        at_end={k: n for k, n in at_end.items() if n},
        reliable=reliable,
    )
    if not rows:
        return model
    seen: Counter[str] = Counter()
    for (c, bucket, _), n in rows.items():  # a case's features are made when they are needed, and not kept
        for f in _features(c, bucket):
            seen[f] += n
    index = {f: k for k, f in enumerate(f for f, n in seen.items() if n >= 3)}
    none = len(index)
    del seen
    ids = np.fromiter((index.get(f, none) for c, bucket, _ in rows for f in _features(c, bucket)), np.int64).reshape(len(rows), -1)
    labels = np.array([label for *_, label in rows], dtype=np.float64)
    share = np.array(list(rows.values()), dtype=np.float64)
    share = np.sqrt(share) / np.sqrt(share).sum()
    w, velocity, bias = np.zeros(none + 1), np.zeros(none + 1), 0.0
    scale = np.zeros(none + 1)
    for _ in range(rounds):
        w[none] = 0
        p = 1 / (1 + np.exp(-np.clip(w[ids].sum(1) + bias, -30, 30)))
        miss = (labels - p) * share
        gradient = np.bincount(ids.ravel(), np.repeat(miss, ids.shape[1]), none + 1) - penalty * w
        scale += gradient**2
        velocity = 0.5 * velocity + gradient / (np.sqrt(scale) + 1e-6)
        w += 0.3 * velocity
        bias += 2.0 * miss.sum()
    w[none] = 0
    model.weights = {f: round(float(w[k]), 4) for f, k in index.items() if abs(w[k]) > 1e-3} | {"": float(bias)}
    return model


_END = re.compile(rf"(?P<run>[{TERMINAL}]){_TAIL}$")


def _end_of(text: str, start: int, stop: int) -> tuple[str, str, str] | None:
    """Run, key and class of the end of a block, if it ends as a sentence does."""
    m = _END.search(text, max(start, stop - 12), stop)
    if m:
        tail = _plain("".join(c for c in text[m.start() : stop] if KIND[c] not in "hs"))
        return tail[0] + ("”" if m.group("close") else ""), *_left(text, start, m.start(), tail)
    if _unspaced.match(text[stop - 1]):
        return " ", *_left(text, start, stop, "")
    return None


def _repeats(text: str, title: str) -> bool:
    """Whether a text reads the same as a title."""
    if text == title:
        return True
    return len(text) <= 2 * len(title) + 8 and len(title) <= 2 * len(text) + 8 and consistent_form(text) == consistent_form(title)


class Splitter:
    """Finds the sentences of texts with a model; keeps recent decisions of its worker."""

    def __init__(self, model: SentenceModel):
        self.model, self.known = model, {}

    def boundary(self, c: Candidate) -> bool:
        case = c[2:]
        made = self.known.get(case)
        if made is None:
            if len(self.known) > 300_000:
                self.known.clear()
            m = self.model
            bucket = _bucket(c.run, m.inside.get(c.key, 0), m.at_end.get(c.key, 0), m.reliable)
            score = m.weights.get("", 0.0) + sum(m.weights.get(f, 0.0) for f in _features(c, bucket))
            self.known[case] = made = score > 0 if m.weights else True
        return made

    def spans(self, text: str | None, title: str | None = None) -> list[tuple[int, int]]:
        """(start, end) of every sentence in code points; null, empty and blank texts have none."""
        if not text:
            return []
        blocks = _blocks(text)
        if title and blocks and _repeats(text.strip(), title.strip()):
            return [(blocks[0][0], blocks[-1][1])]
        made = []
        for start, stop in blocks:
            at = start
            for c in _candidates(text, start, stop):
                if c.end > at and self.boundary(c):
                    made.append((at, c.end))
                    at = c.next
            if at < stop:
                made.append((at, stop))
        return made


def fit(df: DataFrame, key: str, text: str, rows: int = SAMPLE_ROWS) -> SentenceModel:
    """Train on at most ``rows`` rows of ``df``, those with the least hash of key and text."""
    return train([r[0] for r in bounded_sample(df, [text, key], rows, F.length(text) > 0)])


class _Split:
    def __init__(self, key: str, text: str, title: str | None, model: SentenceModel):
        self.key, self.text, self.title, self.splitter = key, text, title, Splitter(model)

    def __call__(self, part: pa.RecordBatch) -> dict:
        texts = part.column(self.text).to_pylist()
        titles = part.column(self.title).to_pylist() if self.title else [None] * len(texts)
        offsets, starts, ends = [0], [], []
        for text, title in zip(texts, titles, strict=True):
            for a, b in self.splitter.spans(text, title):
                starts.append(a)
                ends.append(b)
            offsets.append(len(starts))
        return {
            self.key: part.column(self.key),
            "starts": int_lists(starts, offsets, pa.int64()),
            "ends": int_lists(ends, offsets, pa.int64()),
        }


def sentences(df: DataFrame, key: str, text: str, title: str | None = None, model: SentenceModel | None = None) -> DataFrame:
    """(key, start_pos, end_pos) of every sentence of ``text``, one row a sentence.

    A text equal to ``title`` is one sentence. Null, empty and blank texts have no row.
    Rows are handled where they are: no shuffle besides that of the training sample.
    """
    kind = df.schema[key].dataType.simpleString()
    model = model or fit(df, key, text)
    rows = df.select(key, text, *([title] if title else []))
    made = map_slices(rows, f"{key} {kind}, starts array<bigint>, ends array<bigint>", _Split(key, text, title, model))
    return made.select(key, F.inline(F.arrays_zip("starts", "ends")).alias("start_pos", "end_pos"))
