"""Keyword-stuffed and link-list pages (problem 9).

A page is cut into blocks at line ends and terminal punctuation, and the phrases of all blocks
of all pages (words in the form of problem 4, pairs of neighbouring characters where no spaces
part words, every two of them that follow each other in a block, five-word windows of short lines, the domains of links) are exploded and counted
by distinct hosts, in list-like blocks and in other blocks. A phrase that stands in the lists
of several hosts is replicated; one that stands on no more hosts outside lists is bait. A
block counts when enough of its phrases are replicated. How many that is depends on its list
density: the lists by build (links, tags, bracketed or separated items, product lines, words
that come again and again) together need few of them, any other block
needs a share of its words to be bait or in phrases that are, and a run of short lines a share of its lines. A page
is flagged when more than half of its text is in such blocks; without phrases that other
hosts hold, none is.
"""

from __future__ import annotations

import random
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.arrow import map_slices
from archivolt.llm.forms import COMMON, consistent_form
from archivolt.llm.shingles import mix
from archivolt.workspace import BROADCAST_BYTES, settle

#: A page needs so many list units, a phrase so many hosts (or repeats in its page).
LEAST_UNITS, HOSTS, REPEATS = 6, 3, 3
#: Share of the lines of a run that must hold a replicated phrase.
RUN_SHARE = 0.3
#: Share of the words of a block that must be bait, alone or with a neighbour; pairs of words
#: cover every longer phrase, which can't be on more hosts than its pairs.
BAIT_SHARE = 0.16
#: Times as many hosts must hold a pair of words in lists as outside them: headings and their lists share pairs too.
PAIR_TIMES = 3
#: Share of the words of a page's lists by build that must be replicated.
DENSE_SHARE = 0.02
#: Parts into which every phrase is split where the replicated ones are too many to broadcast.
PARTS = 16
#: Share of the letters of a line that must be in words repeated in it, if single spaces part its items.
AGAIN_SHARE = 0.6
#: Longest phrase counted, in words.
PHRASE_WORDS = 5

FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
TABLE = re.compile(r"^\s*\|.*\|\s*$")
SOURCE = re.compile(r"^\s*(?:\[\d+\]|\(\d+\))\s")
URL = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}/[^\s)\]\"<>]*", re.I)
MARKUP = re.compile(r"</?\w[^>]*>")
TAGGED = re.compile(r"(?:^|(?<=\s))(?:(?:[#@][^\s#@]+(?:#(?=[\s#@]|$))?)+|tags?:\S+)|【[^】\n]{1,40}】|\[[^\]\n]{1,40}\](?!\()")
TAG_SIGN = re.compile(r"[#@【\[]|tags?:")
TAG = re.compile(r"[#@][^\s#@]+")
ENDS = re.compile(r"(?<=[.!?…。！？।؟])[”\"»」’)）]*\s+|(?<=[。！？])(?=\S)|\n")
SEPARATOR = re.compile(r"\s*([,，、;；|/>•·→»]|\s[-–—]\s|\s{2}|:\s|：)\s*")
#: Every separator holds one of these characters, or white space after white space.
MARKS = ",，、;；|/>•·→»：:-–—"
MARK = re.compile(r"[,，、;；|/>•·→»：:\-–—]|(?<=\s)\s")
WORDS = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*")
STOPS, CLOSERS = ".!?…。！？।؟", "”\"»」’)）"
WIDE = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
#: Runs of scripts without spaces, and words of others.
_WIDE = "\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
WIDE_RUN = re.compile(f"[{_WIDE}]")
RUNS = re.compile(rf"[{_WIDE}]+|[^\W_{_WIDE}]+(?:['’.-][^\W_{_WIDE}]+)*")
PRICE = re.compile(r"(?:\d+\s?[$€元円£¥₽]|[$€£¥]\s?\d+|\s\d{2,4})\s*$")


def _closed(block: str) -> bool:
    """Whether a block ends as a sentence does, closing quotes and brackets aside."""
    end = block.rstrip().rstrip(CLOSERS)[-1:]
    return bool(end) and end in STOPS


def _priced(block: str) -> bool:
    """Whether a block ends in a price."""
    return bool(PRICE.search(block.rstrip()[-40:]))


def _short(unit: str, parts: list[str], words: int, letters: int) -> bool:
    """Whether a unit of the white-space separated ``parts`` has few words, or few letters of scripts without spaces."""
    if len(parts) > words and (unit.isascii() or len(unit) - unit.count(" ") > 2 * letters) or unit.isascii():
        return len(parts) <= words
    wide = len(WIDE.findall(unit))
    if wide and wide * 2 > len(unit.replace(" ", "")):
        return wide <= letters and max(map(len, parts), default=0) <= letters
    return len(parts) <= words


def _separated(block: str, parts: list[str], size: int) -> int:
    """Number of items of a block that is a list of short items with one kind of separator.

    ``parts`` are what white space separates, ``size`` their characters.
    """
    doubled = len(block) - size - len(parts) + 1  # white space after white space
    if doubled + sum(map(block.count, MARKS)) < LEAST_UNITS - 1 or len(MARK.findall(block)) < LEAST_UNITS - 1:
        return 0
    parts = SEPARATOR.split(block)
    units, marks = [u for u in parts[::2] if u.strip()], parts[1::2]
    if len(units) < LEAST_UNITS * (2 if _closed(block) else 1):
        return 0
    even = 1.25 * Counter(m.strip() for m in marks).most_common(1)[0][1] >= len(marks)
    wordy = len("".join(WORDS.findall("".join(units)))) >= 0.7 * len("".join("".join(units).split()))
    return len(units) if even and wordy and sum(_short(u, u.split(), 5, 14) for u in units) >= 0.9 * len(units) else 0


def _again(block: str, items: list[str]) -> bool:
    """Whether a block without an end is ``items`` that single spaces part and that are repeated in it."""
    if len(items) < 2 * LEAST_UNITS or _closed(block):
        return False
    often = Counter(items)
    return sum(len(w) for w in items if often[w] > 1 and any(map(str.isalpha, w))) >= AGAIN_SHARE * sum(map(len, items))


def _domain(link: re.Match) -> str:
    """The domain of a link between spaces."""
    return f" {link.group().partition('//')[2].partition('/')[0].lower().removeprefix('www.') or link.group().partition('/')[0]} "


def _form(text: str) -> Callable[[str], str]:
    """How blocks of a text are brought to consistent form: not at all if only signs between words would change."""
    bare = text
    if not text.isascii():
        for sign in COMMON:
            bare = bare.replace(sign, "")
    return str if consistent_form(bare) == bare else consistent_form


def _line_words(line: str, form: Callable[[str], str]) -> list[str]:
    return WORDS.findall(form(line).lower())


def _words(block: str, form: Callable[[str], str]) -> list[str]:
    """Lower-case words in consistent form; pairs of neighbours where a script writes no spaces between words."""
    block = form(block).lower()
    if block.isascii() or not WIDE_RUN.search(block):
        return WORDS.findall(block)
    out = []
    for run in RUNS.findall(block):
        if len(run) > 1 and WIDE_RUN.match(run):
            out += map(add, run, run[1:])
        else:
            out.append(run)
    return out


class Page:
    """The blocks of a text.

    ``total`` is the number of characters without white space; ``listed`` are the lists by
    build, ``runs`` the runs of short lines and ``blocks`` the rest, each with its characters;
    ``short`` the numbers of the blocks that are short. Code, tables and numbered sources are
    in none of them. ``dense`` tells whether the page has enough list units for its lists to
    count as such, ``listy`` whether lists, runs and short blocks hold more than half of it.
    """

    def __init__(self, text: str):
        self.total = len("".join(text.split()))
        self.listed: list[tuple[int, str]] = []
        self.runs: list[tuple[int, list[str]]] = []
        self.blocks: list[tuple[int, str]] = []
        self.short: list[int] = []
        self._run: list[tuple[int, str]] = []
        units = 0
        for line in (FENCE.sub("\n```\n", text) if "```" in text else text).splitlines():
            parts = line.split()
            if not parts:
                continue
            first = parts[0][0]
            if first == "|" and TABLE.match(line) or first in "[(" and SOURCE.match(line) or line == "```":
                self._end_run()
                continue
            tags = [m.group() for m in TAGGED.finditer(line)] if TAG_SIGN.search(line) else []
            links = URL.findall(line) if "/" in line or "www." in line.lower() else []
            size = sum(map(len, parts))
            rest = TAGGED.sub(" ", URL.sub(" ", MARKUP.sub(" ", line))) if links or tags else line
            marks = len(links) + sum(len(TAG.findall(t)) or 1 for t in tags)
            left = len("".join(WORDS.findall(rest))) if marks else 0
            if marks and (left <= 16 * marks or 2 * sum(map(len, links)) > size) and not (_closed(line) and marks < 2):
                self._end_run()
                self.listed.append((size, URL.sub(_domain, MARKUP.sub(" ", line))))
                units += marks
                continue
            if len(line) <= 60 and _short(line, parts, 7, 16) and not _closed(line) and not _priced(line) and not _separated(line, parts, size):
                self._run.append((size, line))
                units += 1
                continue
            self._end_run()
            for block in ENDS.split(line):
                block = block.strip()
                parts = block.split()
                size = sum(map(len, parts))
                if not size:
                    continue
                if n := _separated(block, parts, size):
                    self.listed.append((size, block))
                    units += n
                elif not _closed(block) and _priced(block) and _short(block, parts, 9, 24):
                    self.listed.append((size, block))
                    units += 1
                elif _again(block, parts):
                    self.listed.append((size, block))
                    units += LEAST_UNITS
                else:
                    if _short(block, parts, 8, 16):
                        self.short.append(len(self.blocks))
                        units += 1
                    self.blocks.append((size, block))
        self._end_run()
        held = sum(n for n, _ in self.listed) + sum(n for n, _ in self.runs) + sum(self.blocks[k][0] for k in self.short)
        self.dense = units >= LEAST_UNITS
        self.listy = self.dense and 2 * held > self.total

    def _end_run(self) -> None:
        if len(self._run) >= LEAST_UNITS:
            self.runs.append((sum(n for n, _ in self._run), [line for _, line in self._run]))
        else:
            self.blocks += self._run
        self._run = []


def _phrases(words: list[str]) -> list[str]:
    size = min(PHRASE_WORDS, len(words))
    return [*words, *(" ".join(words[k : k + size]) for k in range(len(words) - size + 1))] if size > 1 else words


def _hash(phrase: str) -> int:
    """An even number, 2 in its last two bits for a number; those of pairs are odd, with 3 if they hold a number."""
    return (xxhash.xxh3_64_intdigest(phrase) & ~3 | 2 * phrase.isdigit()) - (1 << 63)


class _Hashes(dict):
    """Hashes of this worker's recent phrases; emptied when it grows."""

    def __missing__(self, phrase: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[phrase] = made = _hash(phrase)
        return made


_known = _Hashes()


def _array(values: array) -> pa.Array:
    return pa.array(np.asarray(values))


_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _pairs(words: np.ndarray) -> np.ndarray:
    """Hashes of the phrases of two neighbouring words, from those of the words."""
    own = words.view(np.uint64)
    kind = np.uint64(1) | (own[:-1] | own[1:]) & np.uint64(2)
    return (mix(own[:-1] * _PAIR + own[1:], 1) & ~np.uint64(3) | kind).view(np.int64)


def _phrased(blocks: list[list[int]]) -> list[list[int]]:
    """The words of each block with its pairs of words."""
    pairs = _pairs(np.array([h for words in blocks for h in words], np.int64)).tolist()
    out, start = [], 0
    for words in blocks:
        out.append(words + pairs[start : start + max(0, len(words) - 1)])
        start += len(words)
    return out


class _Lists:
    """Lists of 64-bit numbers one after another."""

    def __init__(self):
        self.flat, self.ends = array("q"), array("i", [0])

    def add(self, values: Iterable[int]) -> None:
        self.flat.extend(values)
        self.ends.append(len(self.flat))

    def made(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(_array(self.ends), _array(self.flat))

    def pairs(self, wanted: np.ndarray) -> pa.ListArray:
        """The pairs of neighbours in each of the ``wanted`` lists, none in the others."""
        ends = np.asarray(self.ends)
        sizes = np.where(wanted, np.maximum(np.diff(ends) - 1, 0), 0)
        kept = np.repeat(np.column_stack((wanted, np.zeros(len(wanted), bool))).ravel(), np.column_stack((np.maximum(np.diff(ends) - 1, 0), np.minimum(np.diff(ends), 1))).ravel())
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(_pairs(np.asarray(self.flat, np.int64))[kept[:-1]]))


class _Evidence:
    """Blocks of each page with the hashes of their phrases, and the phrases of its lists."""

    def __init__(self, key: str, text: str):
        self.key, self.text = key, text

    def __call__(self, part: pa.RecordBatch) -> dict:
        out: dict = {self.key: [], "_row": [], "_host": [], "_total": []}
        base = random.getrandbits(62)  # tells rows apart, equal ones too; the table is written once
        phrases_of, words_of, units_of = _Lists(), _Lists(), _Lists()  # pages, blocks, lines
        sizes, dense, blocks_to = array("i"), array("b"), array("i", [0])
        run_sizes, units_to, runs_to = array("i"), array("i", [0]), array("i", [0])

        def hashed(phrases: list[str]) -> Iterator[int]:
            return map(_known.__getitem__, phrases)

        def phrased(blocks: list[list[str]]) -> list[list[int]]:
            return _phrased([list(hashed(words)) for words in blocks])

        def keep(size: int, build: bool, words: list[str]) -> None:
            sizes.append(size)
            dense.append(build)
            words_of.add(hashed(words))

        for key, text, host in zip(*(part.column(c).to_pylist() for c in (self.key, self.text, "_host")), strict=True):
            if not text:
                continue
            page, form, repeated = Page(text), _form(text), set()
            lines = [[_line_words(line, form) for line in run] for _, run in page.runs]
            own = [[_phrases(w) for w in run] for run in lines]
            if page.listy:  # runs and short blocks whose phrases come again and again in the page
                short = {k: _line_words(page.blocks[k][1], form) for k in page.short}
                often = Counter(p for run in own for phrases in run for p in phrases) + Counter(p for w in short.values() for p in _phrases(w))
                for k, run in enumerate(lines):
                    words = [p for w in run for p in w]
                    if words and sum(often[p] >= REPEATS for p in words) >= 0.75 * len(words) or 2 * sum(any(often[p] >= REPEATS for p in w) for w in run) >= len(run):
                        repeated.add(-1 - k)
                repeated.update(k for k, words in short.items() if words and sum(often[p] >= REPEATS for p in words) >= 0.75 * len(words))
            lists = [_words(block, form) for _, block in page.listed]
            listed = {h for phrases in phrased(lists) for h in phrases}
            held, lists = (sum(size for size, _ in page.listed), lists) if page.dense else (0, [])
            for k, (size, run) in enumerate(page.runs):
                each = [_words(line, form) for line in run]
                units = [{*hashed(phrases), *words} for phrases, words in zip(own[k], phrased(each), strict=True)]
                listed.update(*units)
                if -1 - k in repeated:
                    held += size
                    lists += each
                else:
                    run_sizes.append(size)
                    for unit in units:
                        units_of.add(unit)
                    units_to.append(len(units_of.ends) - 1)
            for k, (size, block) in enumerate(page.blocks):
                words = _words(block, form)
                if k in repeated:
                    held += size
                    lists.append(words)
                    listed.update(*phrased([words]))
                else:
                    keep(size, False, words)
            if held:
                keep(held, True, [w for words in lists for w in words])
            phrases_of.add(listed)
            for column, value in zip(out.values(), (key, base + len(blocks_to), host, page.total), strict=True):
                column.append(value)
            blocks_to.append(len(sizes))
            runs_to.append(len(run_sizes))
        plain = np.asarray(dense, np.int8) == 0  # the words of a replicated pair are replicated: lists by build need no pairs
        blocks = pa.StructArray.from_arrays([_array(sizes), _array(dense).cast(pa.bool_()), words_of.made(), words_of.pairs(plain)], ["size", "dense", "words", "pairs"])
        runs = pa.StructArray.from_arrays([_array(run_sizes), pa.ListArray.from_arrays(_array(units_to), units_of.made())], ["size", "units"])
        made = {"_listed": phrases_of.made(), "_runs": pa.ListArray.from_arrays(_array(runs_to), runs), "_blocks": pa.ListArray.from_arrays(_array(blocks_to), blocks)}
        return out | made


def _held(units: DataFrame, phrases: DataFrame, small: bool) -> DataFrame:
    """``units`` joined to the replicated ``phrases``: broadcast if ``small``, else by phrase and part of its rows."""
    if small:
        return units.join(F.broadcast(phrases), "_phrase")
    parts = phrases.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return units.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(PARTS)).cast("int")).join(parts, ["_phrase", "_part"]).drop("_part")


def stuffed_pages(df: DataFrame, key: str, text: str, host: Column, hosts: int = HOSTS) -> DataFrame:
    """(key) of the rows more than half of whose text is in blocks of phrases that lists of ``hosts`` hosts hold.

    ``host`` tells where a page stands; null is a host of its own. Null, empty and blank
    texts are never cases; equal rows have equal results; an empty table gives none. Phrases
    are counted once a host before they are shuffled.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, text, F.xxhash64(host).alias("_host"))
    schema = (
        f"{key} {kind}, _row bigint, _host bigint, _total bigint, _listed array<bigint>,"
        " _runs array<struct<size: int, units: array<array<bigint>>>>, _blocks array<struct<size: int, dense: boolean, words: array<bigint>, pairs: array<bigint>>>"
    )
    pages = settle(map_slices(rows, schema, _Evidence(key, text)), "list-evidence")
    by_host = lambda phrases: phrases.distinct().groupBy("_phrase").agg(F.count("*").alias("_hosts"))
    listed = settle(by_host(pages.select("_host", F.explode("_listed").alias("_phrase"))).filter((F.col("_hosts") >= hosts) & (F.col("_phrase").bitwiseAND(3) != 3)), "list-phrases")  # a pair with a number is no keyword
    small = 17 * listed.count() <= BROADCAST_BYTES
    plain = F.array_distinct(F.flatten(F.transform(F.filter("_blocks", lambda b: ~b.dense), lambda b: F.concat(b.words, b.pairs))))
    others = _held(pages.select("_host", "_row", F.explode(plain).alias("_phrase")), listed.select("_phrase"), small).select("_host", "_phrase")
    others = by_host(others).withColumnRenamed("_hosts", "_others")
    times = F.when(F.col("_phrase").bitwiseAND(1) == 1, PAIR_TIMES).otherwise(1)
    bait = F.coalesce("_others", F.lit(0)) * times <= F.col("_hosts")
    listed = settle(listed.join(others, "_phrase", "left").select("_phrase", bait.alias("_bait")), "bait")
    who = [key, "_row", "_total"]
    blocks = pages.select(*who, F.posexplode("_blocks").alias("_at", "b"))
    words = blocks.select(*who, "_at", "b.size", "b.dense", F.size("b.words").alias("_n"), F.posexplode(F.concat("b.words", "b.pairs")).alias("_unit", "_phrase"))
    runs = pages.select(*who, F.posexplode("_runs").alias("_at", "b"))
    lines = runs.select(*who, "_at", "b.size", F.lit(False).alias("dense"), F.size("b.units").alias("_n"), F.posexplode("b.units").alias("_unit", "_p"))
    lines = lines.select(*[c for c in lines.columns if c != "_p"], F.explode("_p").alias("_phrase"))
    covered = F.when(F.col("_unit") < F.col("_n"), F.array("_unit")).otherwise(F.array(F.col("_unit") - F.col("_n"), F.col("_unit") - F.col("_n") + 1))

    def counted(units: DataFrame, share: float, within: Column) -> DataFrame:
        held = _held(units, listed, small).filter("dense or _bait").withColumn("_unit", F.explode(within))
        held = held.groupBy(*who, "_at", "size", "dense", "_n").agg(F.count_distinct("_unit").alias("_hit"))
        return held.filter(F.col("_hit") >= F.when(F.col("dense"), DENSE_SHARE).otherwise(share) * F.col("_n"))

    held = counted(words, BAIT_SHARE, covered).unionByName(counted(lines, RUN_SHARE, F.array("_unit"))).groupBy(*who).agg(F.sum("size").alias("_held"))
    return held.filter(F.col("_held") * 2 > F.col("_total")).select(key).distinct()
