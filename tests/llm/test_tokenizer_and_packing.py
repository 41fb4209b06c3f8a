"""Token ids against the public library, the perfect hash, and what containers must hold."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from archivolt.llm import packing, tokenizer

JSON = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def reference():
    made = Tokenizer.from_file(JSON)
    made.encode_special_tokens = True
    return made


def encode(texts):
    ids, offsets = tokenizer.encoder(tokenizer.VOCABULARY).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    made = tokenizer.PerfectHash(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    assert (made.slots(keys) == made.slot_of).all()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'s'reveldt  \n\t12é中文。ー😀‍\x85ab"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_ids_equal_the_library(reference, texts):
    assert encode(texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_defined_ids(reference):
    assert encode([None, "", "<|endoftext|>"]) == [[], [], reference.encode("<|endoftext|>", add_special_tokens=False).ids]
    long = "长文" * 30_000 + "x" * 5000
    assert encode([long])[0] == reference.encode(long, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=200), st.integers(1, 9))
def test_bins_hold_every_limit(sizes, documents):
    sizes = np.array(sizes, np.int64)
    bins = packing.best_fit(sizes, 100, documents, 6000)
    for b in set(bins.tolist()):
        own = sizes[bins == b]
        assert own.sum() <= 100 and len(own) <= documents and ((own * own).sum() <= 6000 or len(own) == 1)


def test_attention_binds():
    """A document whose cost leaves no room has a container of its own, where tokens alone would let another in."""
    sizes = np.array([2000, 40, 1900, 40], np.int64)
    cost = int(packing.ATTENTION * packing.CAPACITY**2)
    assert packing.best_fit(sizes, packing.CAPACITY, 256, packing.CAPACITY**2).tolist() == [0, 0, 1, 1]
    assert packing.best_fit(sizes, packing.CAPACITY, 256, cost).tolist() == [0, 1, 1, 1]


def test_containers(spark):
    rows = [(1, 5000), (2, 0), (3, None), *[(k, k % 700) for k in range(4, 400)]]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").selectExpr("*", "7 AS container_id")
    made = packing.pack(df, "doc_id").collect()
    fill, seen = {}, {}
    for r in made:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.n_tokens))
    assert max(fill.values()) <= 2048 and sorted(seen[1]) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert all(len(seen[k]) == 1 and seen[k][0][2] == (n or 0) for k, n in rows if k != 1)
    total = sum(n or 0 for _, n in rows)
    assert len(fill) <= total / 2048 + 2
    assert packing.pack(df.limit(0), "doc_id").count() == 0


def test_ids_stand_for_their_texts(spark):
    texts = ["", None, "a b  c", "长文 и 𝒳\u0000 é", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    back = {r.doc_id: r.text for r in tokenizer.texts_of(tokenizer.token_ids(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {k: x or "" for k, x in enumerate(texts)}


def test_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, "")], "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = sorted((r.doc_id, r.ids) for r in tokenizer.token_ids(df, "doc_id", "text").collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert tokenizer.token_ids(df.limit(0), "doc_id", "text").count() == 0
