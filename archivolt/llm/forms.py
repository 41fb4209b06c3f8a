"""One consistent form for text that reads the same but is stored differently (problem 4).

A text is settled by a table (width, composition, invisible characters, kinds of space)
and word by word for look-alike letters. Words that are not in settled spelling are looked
up in tries over the settled words of the corpus with an edit automaton in which look-alike
letters and ignorable characters cost nothing and everything else exceeds the budget; the
most frequent match is the canonical spelling, and a word without a match takes the
spelling of the table. Letters that look alike only in some typefaces, or only next to
letters of another script, are no rule of the table: a word that mixes scripts beyond the
table is respelled only if the trie finds a word of the corpus that it reads like.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.arrow import map_slices, record_batch
from archivolt.workspace import settle

# Cyrillic and Greek letters and the Latin letters they look like.
CYRILLIC = "АВЕКМНОРСТУХЅІЈԚԜҺаеорсухѕіјһԁԛԝӏ"
CYRILLIC_AS_LATIN = "ABEKMHOPCTYXSIJQWhaeopcyxsijhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXo"

# Further letters that read as a Latin letter inside a word of another script.
LOOSE = "αγεηικνορτυχωвгикмнптԁһզհոսցօıɑɡᎪᏴᏟᎬᎻᏦᏞᎷᏢᏚᎢᏙᎳᏃ"
LOOSE_AS_LATIN = "ayenikvoptuxwbrukmhntdhqhnugoiagABCEHKLMPSTVWZ"

TO_LATIN = dict(zip(CYRILLIC + GREEK, CYRILLIC_AS_LATIN + GREEK_AS_LATIN, strict=True))
TO_CYRILLIC = {b: a for a, b in reversed(list(zip(CYRILLIC, CYRILLIC_AS_LATIN, strict=True)))}
TO_GREEK = dict(zip(GREEK_AS_LATIN, GREEK, strict=True))
SHARED = set(TO_LATIN.values())
READS_AS = dict(zip(LOOSE, LOOSE_AS_LATIN, strict=True)) | TO_LATIN

#: Compatibility blocks whose characters differ from their plain form in width or build only.
PLAIN_BLOCKS = (
    (0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFB50, 0xFDF9), (0xFE30, 0xFE4F),
    (0xFE70, 0xFEFC), (0xFF01, 0xFFEF), (0x2F800, 0x2FA1F),
)
VISIBLE_FORMATS = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x08E2}
FILLERS = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)


def _character_table() -> dict[str, str]:
    table: dict[str, str] = {}
    for first, last in PLAIN_BLOCKS:
        for code in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            if plain != chr(code):
                table[chr(code)] = plain
    for code in (*range(0x20), *range(0x7F, 0xA0)):
        if chr(code) not in "\t\n\v\f\r\x85":
            table[chr(code)] = ""
    for code in (*range(0xA0, 0x3001), *range(0xFE00, 0xFF00), *range(0xFFF0, 0xFFFC), *range(0xE0000, 0xE0200)):
        kind = unicodedata.category(chr(code))
        if kind == "Zs":
            table[chr(code)] = " "
        elif kind == "Cf" and code not in VISIBLE_FORMATS or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            table[chr(code)] = ""
    table |= {c: unicodedata.normalize("NFKC", c) for c in "ำຳ"}
    return table | {chr(code): "" for code in FILLERS}


TABLE = _character_table()
COMMON = [c for c in "，：！？（）；　" if c in TABLE]
#: The plane above 0xFFFF apart: a class that holds both is searched one member after another.
UNSETTLED = re.compile("[" + "".join(re.escape(c) for c in sorted(set(TABLE) - set(COMMON)) if c <= "\uffff") + "]")
UNSETTLED_ABOVE = re.compile("[\U0002f800-\U0002fa1f\U000e0000-\U000e01ff]")
IGNORABLE = {c for c, plain in TABLE.items() if not plain}

LATIN_RANGE, GREEK_RANGE, CYRILLIC_RANGE, MARKS = "A-Za-zÀ-ÖØ-öø-ɏɑɡḀ-ỿ", "ͰͱͲͳͶͷͻ-ͽͿΆΈ-Ͽ", "Ѐ-ԯ", "̀-ͯ"
ARMENIAN_RANGE, CHEROKEE_RANGE = "Ա-Ֆա-ֈ", "Ꭰ-Ᏽ"
SCRIPTS = (LATIN_RANGE, GREEK_RANGE, CYRILLIC_RANGE, ARMENIAN_RANGE, CHEROKEE_RANGE)
_W = f"[{''.join(SCRIPTS)}{MARKS}]"
WORD = re.compile(f"{_W}+")
_PAIRS = "|".join(f"[{a}][{MARKS}]*[{''.join(b for b in SCRIPTS if b != a)}]" for a in SCRIPTS)
MIXED = re.compile(_PAIRS)
#: Finds a word that mixes scripts, or one made of look-alike letters only.
UNSURE = re.compile(f"{_PAIRS}|(?<!{_W})[{CYRILLIC}{GREEK}{MARKS}ЁёЇї]+(?!{_W})")


_FOREIGN = re.compile(f"[{''.join(SCRIPTS[1:])}]")


def unsure(text: str) -> bool:
    """Whether a word of the text may have to be respelled; only letters of other scripts than Latin give cause."""
    return bool(_FOREIGN.search(text) and UNSURE.search(text))


def skeleton(word: str) -> str:
    """The word with every look-alike letter as Latin: equal for words that read the same."""
    return unicodedata.normalize(
        "NFC", "".join(TO_LATIN.get(c, c) for c in unicodedata.normalize("NFD", word) if c not in IGNORABLE)
    )


def reading(word: str) -> str:
    """The word with every letter that may read as a Latin one as that: equal wherever ``SpellingTrie`` can match."""
    return unicodedata.normalize(
        "NFC", "".join(READS_AS.get(c, c) for c in unicodedata.normalize("NFD", word) if c not in IGNORABLE)
    )


def settled_word(word: str) -> str:
    """The table's spelling of a word; the same for all words with the same skeleton.

    Letters that belong to one script alone decide; without any, or in a tie, Latin.
    """
    bare = unicodedata.normalize("NFD", skeleton(word))
    cyrillic = sum("Ѐ" <= c <= "ԯ" for c in bare)
    greek = sum("Ͱ" <= c <= "Ͽ" for c in bare)
    latin = sum(c.isalpha() and c < "ɐ" and c not in SHARED for c in bare)
    if cyrillic > max(latin, greek):
        bare = "".join(TO_CYRILLIC.get(c, c) for c in bare)
    elif greek > max(latin, cyrillic):
        bare = "".join(TO_GREEK.get(c, c) for c in bare)
    return unicodedata.normalize("NFC", bare)


def plain_characters(text: str) -> str:
    """Width, composition, invisible characters and kinds of space, by table."""
    for c in COMMON:
        if c in text:
            text = text.replace(c, TABLE[c])
    if UNSETTLED.search(text):
        text = UNSETTLED.sub(lambda m: TABLE[m.group()], text)
    if UNSETTLED_ABOVE.search(text):
        text = UNSETTLED_ABOVE.sub(lambda m: TABLE.get(m.group(), m.group()), text)
    return unicodedata.normalize("NFC", text)


class _Settled(dict):
    """Settled spellings of this worker's recent words; emptied when it grows."""

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[word] = made = settled_word(word)
        return made


_settled = _Settled()


def consistent_form(text: str | None) -> str | None:
    """The consistent form of a text by table alone; null stays null, empty stays empty."""
    if not text:
        return text
    if text.isascii() and text.isprintable():
        return text
    text = plain_characters(text)
    if unsure(text):
        text = WORD.sub(lambda m: _settled[m.group()], text)
    return text


def comparable(title: str | None, content: str | None) -> str:
    """Title, a space, content in consistent form, lower case, white space runs as one space."""
    return " ".join(consistent_form(f"{title or ''} {content or ''}").lower().split())


class SpellingTrie:
    """A trie over settled spellings, walked by an edit automaton.

    A look-alike letter in place of another and an ignorable character cost 0, any other
    edit costs 1; a branch is left as soon as its cost exceeds ``budget``. A word that mixes
    scripts beyond the table is matched by all letters that may read as another.
    """

    def __init__(self, words: Iterable[tuple[str, int]]):
        self.root: dict = {}
        for word, count in words:
            node = self.root
            for c in unicodedata.normalize("NFD", word):
                node = node.setdefault(c, {})
            node[""] = (word, node.get("", (word, 0))[1] + count)

    def matches(self, word: str, budget: int = 0) -> list[tuple[str, int]]:
        """Spellings within ``budget``, with their counts."""
        letters, found, states = unicodedata.normalize("NFD", word), {}, [(self.root, 0, 0)]
        seen, alike = set(), READS_AS if MIXED.search(settled_word(word)) else TO_LATIN
        while states:
            node, at, cost = states.pop()
            if cost > budget or (id(node), at, cost) in seen:
                continue
            seen.add((id(node), at, cost))
            if at == len(letters) and "" in node:
                found[node[""][0]] = node[""][1]
            if at < len(letters):
                here = letters[at]
                states.append((node, at + 1, cost + (here not in IGNORABLE)))
                for c, child in node.items():
                    if c:
                        same = c == here or alike.get(c, c) == alike.get(here, here)
                        states.append((child, at + 1, cost + (not same)))
            if cost < budget:
                states += [(child, at, cost + 1) for c, child in node.items() if c]
        return list(found.items())

    def canonical(self, word: str) -> str | None:
        """The most frequent match, ties by code points; None without one."""
        found = self.matches(word)
        return min(found, key=lambda x: (-x[1], x[0]))[0] if found else None


def hash_pair(text: str) -> tuple[int, int]:
    """128 bits of a text as two signed 64-bit numbers."""
    number = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    high, low = number >> 64, number & ((1 << 64) - 1)
    return high - ((high >> 63) << 64), low - ((low >> 63) << 64)


def doubtful_word(word: str) -> bool:
    """Whether a word has to be looked up: the table spells it differently, or it mixes scripts even so."""
    return _settled[word] != word or bool(MIXED.search(word))


def _canonical_words(words: DataFrame) -> DataFrame:
    """(word, canonical) of the doubtful words in (word, skeleton, n).

    Words with the same first three letters of the skeleton meet in one trie; such a group
    is the vocabulary of a prefix, whatever the number of rows. The vocabulary is that of
    words without doubt.
    """
    vocabulary = words.groupBy("word", "skeleton").agg(F.sum("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("word", pa.string()), ("canonical", pa.string())])
        prefix, held = None, []

        def matched() -> Iterator[pa.RecordBatch]:
            doubtful = [w for w, unsettled, _ in held if unsettled]
            if doubtful:
                trie = SpellingTrie((w, n) for w, unsettled, n in held if not unsettled)
                made = [trie.canonical(w) or settled_word(w) for w in doubtful]
                yield record_batch({"word": doubtful, "canonical": made}, target)

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("word", "doubtful", "n", "prefix")), strict=True)
            for word, unsettled, n, start in rows:
                if start != prefix:
                    yield from matched()
                    prefix, held = start, []
                held.append((word, unsettled, n))
        yield from matched()

    settled = map_slices(
        vocabulary, "word string, doubtful boolean, n bigint, skeleton string, prefix string", _settle
    )
    wanted = settled.filter("doubtful").select("skeleton").distinct()
    return (
        settled.join(wanted, "skeleton", "left_semi")
        .select("word", "doubtful", "n", "prefix")
        .repartition("prefix")
        .sortWithinPartitions("prefix", "word")
        .mapInArrow(run, "word string, canonical string")
    )


def _settle(part: pa.RecordBatch) -> dict:
    words, skeletons = part.column("word").to_pylist(), part.column("skeleton").to_pylist()
    return {
        "word": words,
        "doubtful": [doubtful_word(w) for w in words],
        "n": part.column("n"),
        "skeleton": skeletons,
        "prefix": [s[:3] for s in skeletons],
    }


def consistent_forms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, form) of every non-empty ``fields`` value of ``df``.

    Nulls and empty strings have no row; keys need not be unique; other columns are not
    read. Words are respelled by the corpus vocabulary (see the module).
    """
    kind = df.schema[key].dataType.simpleString()
    first = map_slices(df.select(key, *fields), f"{key} {kind}, field string, text string, doubtful array<string>", _First(key, fields))
    first = settle(first, "forms")
    words = map_slices(first.select("text"), "word string, skeleton string, n bigint", _count_words)
    spelling = _canonical_words(words)
    doubtful = first.filter(F.size("doubtful") > 0)
    respell = (
        doubtful.select(key, "field", "text", F.explode("doubtful").alias("word"))
        .select(key, "field", F.xxhash64("text").alias("_t"), "word")
        .distinct()
        .join(spelling, "word")
        .groupBy(key, "field", "_t")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "canonical"))).alias("_spelling"))
    )
    respelled = map_slices(
        doubtful.withColumn("_t", F.xxhash64("text"))
        .join(respell, [key, "field", "_t"], "left")
        .select(key, "field", "text", "_spelling"),
        f"{key} {kind}, field string, form string",
        _Respell(key),
    )
    return (
        first.filter(F.size("doubtful") == 0)
        .select(key, "field", F.col("text").alias("form"))
        .unionByName(respelled)
    )


class _First:
    """Characters by table, and the words whose spelling is in doubt."""

    def __init__(self, key: str, fields: list[str]):
        self.key, self.fields = key, fields

    def __call__(self, part: pa.RecordBatch) -> dict:
        keys = part.column(self.key).to_pylist()
        out: dict = {self.key: [], "field": [], "text": [], "doubtful": []}
        for field in self.fields:
            for k, text in zip(keys, part.column(field).to_pylist(), strict=True):
                if text:
                    plain = text if text.isascii() and text.isprintable() else plain_characters(text)
                    words: set[str] = set()
                    if unsure(plain):
                        words = {w for w in WORD.findall(plain) if doubtful_word(w)}
                    out[self.key].append(k)
                    out["field"].append(field)
                    out["text"].append(plain)
                    out["doubtful"].append(sorted(words))
        return out


class _Respell:
    def __init__(self, key: str):
        self.key = key

    def __call__(self, part: pa.RecordBatch) -> dict:
        forms = []
        for text, spelling in zip(part.column("text").to_pylist(), part.column("_spelling").to_pylist(), strict=True):
            known = dict(spelling or ())
            forms.append(WORD.sub(lambda m, known=known: known.get(m.group(), m.group()), text))
        return {self.key: part.column(self.key), "field": part.column("field"), "form": forms}


def _count_words(part: pa.RecordBatch) -> dict:
    """Words that share a spelling with others: those holding a look-alike letter."""
    counts: dict[str, int] = {}
    for text in part.column("text").to_pylist():
        for word in WORD.findall(text):
            counts[word] = counts.get(word, 0) + 1
    words = list(counts)
    return {"word": words, "skeleton": [reading(w) for w in words], "n": list(counts.values())}


def same_reading(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, rec_a, rec_b): pairs of rows whose field reads the same but differs in code points.

    Null and empty values give no pair, nor do equal values; each pair of keys comes once
    a field, the smaller first. Groups with one spelling only, however large, are dropped
    before any pair is made; pairs are made of distinct spellings and only then of their rows.
    """
    kind = df.schema[key].dataType.simpleString()
    forms = consistent_forms(df, key, fields)
    read = map_slices(forms, f"{key} {kind}, field string, h bigint, l bigint", _HashForm(key))
    raw = df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields))).alias("field", "raw"))
    raw = raw.filter(F.length("raw") > 0).select(key, "field", F.xxhash64("raw").alias("raw"))
    rows = read.join(raw, [key, "field"]).distinct()
    rows = settle(rows, "readings")
    group = ["field", "h", "l"]
    spellings = rows.select(*group, "raw").distinct()
    many = spellings.groupBy(*group).agg(F.count("*").alias("_n")).filter("_n > 1").select(*group)
    spellings = settle(spellings.join(many, group, "left_semi"), "spellings")
    pairs = spellings.join(spellings.select(*group, F.col("raw").alias("_other")), group).filter("raw < _other")
    left = rows.select(*group, "raw", F.col(key).alias("_a"))
    right = rows.select(*group, F.col("raw").alias("_other"), F.col(key).alias("_b"))
    found = pairs.join(left, [*group, "raw"]).join(right, [*group, "_other"]).filter("_a <> _b")
    return found.select("field", F.least("_a", "_b").alias("rec_a"), F.greatest("_a", "_b").alias("rec_b")).distinct()


class _HashForm:
    def __init__(self, key: str):
        self.key = key

    def __call__(self, part: pa.RecordBatch) -> dict:
        pairs = [hash_pair(x) for x in part.column("form").to_pylist()]
        return {
            self.key: part.column(self.key),
            "field": part.column("field"),
            "h": [h for h, _ in pairs],
            "l": [low for _, low in pairs],
        }
