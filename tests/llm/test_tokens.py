"""Token store, token counts and packing against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from packwise.llm import packing, simple8b, token_counts, token_store
from packwise.llm.common import scratch
from packwise.llm.queries import BYTE_BPE, PIECE_BPE, WORD_BPE
from packwise.llm.segments import Segments
from tests.llm.tables import DOCS, docs, empty

ODD = ["", " ", "  a", "a   b\t\n c ", "x  y 　z　", "It's we'll 'S 'll", "<|endoftext|> a<|endoftext|>b",
       "J̌ ǰ", "ÀÉ İx ŒŁ", "12 345 x9", "a  b \u0085\tq", "\x1c a \x1f\x00b", "f\x0b\x0cg  \n\n ", "🙂🙂 ok%%% &&&a"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,blanks", [(WORD_BPE, False), (BYTE_BPE, True)])
def test_stretches_give_the_ids_of_whole_texts(name, blanks):
    rng = random.Random(1)
    alphabet = " \n\t aé'sX9%<|́　"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    own = Segments(public_tokenizers.path(name), blanks)
    ids, counts = own.encode([t.encode() for t in texts])
    wanted = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in wanted]
    assert ids.tolist() == [i for w in wanted for i in w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.integers(0, 3), max_size=3000), st.data())
def test_simple8b_gives_back_what_it_got(values, data):
    array = np.array(values, np.uint64)
    packed = simple8b.encode(array)
    assert simple8b.decode(packed).tolist() == values
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    assert simple8b.decode_range(packed, a, b).tolist() == values[a:b]


def test_simple8b_packs_small_numbers_densely():
    assert len(simple8b.encode(np.ones(6000, np.uint64))) < 6000 / 60 * 8 + 200
    assert len(simple8b.encode(np.full(3000, 40_000, np.uint64))) < 3000 / 3 * 8 + 200


def expected_store(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        out.append((r[0], len(ids), crc(ids)))
        start += len(ids)
    return out, start


def stored(spark, df):
    path = scratch(spark, "store")
    token_store.write_store(df, path, public_tokenizers.path(WORD_BPE), 1)
    return token_store.open_store(spark, path)


@pytest.mark.parametrize("clashes", [False, True])
def test_store_round_trip(spark, clashes, monkeypatch):
    store = stored(spark, docs(spark, clashes=clashes))
    got = sorted(map(tuple, token_store.digest_store(store).collect()), key=lambda r: r[1])
    wanted, total = expected_store(DOCS)
    assert [r[0] for r in got] == [w[0] for w in wanted]
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sorted((w[0] or 0, w[1], w[2]) for w in wanted)
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    assert got[-1][1] + got[-1][2] == total
    for doc_id, _, n, ids in token_store.read_store(store).collect():
        assert len(ids) == 4 * n


def test_empty_store(spark):
    assert token_store.digest_store(stored(spark, empty(spark))).count() == 0


def test_counts_of_huge_texts_by_splicing():
    processor = token_counts.model(public_tokenizers.path(PIECE_BPE))
    assert token_counts.stable(processor)
    rng = random.Random(2)
    for i in range(600):
        text = "".join(rng.choice("ab  \né▁日c. eth") for _ in range(rng.randint(1, 400)))
        text = text.replace(" ", "x") if i % 5 == 0 else text  # no boundary to align on
        got = token_counts.count_tokens(processor, text, rng.choice((40, 64, 100)), rng.choice((4, 8, 16)))
        assert got == len(processor.encode(text))


@pytest.mark.parametrize("clashes", [False, True])
def test_counts(spark, clashes):
    path = public_tokenizers.path(PIECE_BPE)
    got = token_counts.with_counts(docs(spark, clashes=clashes), path, 4096, 1000, 16)
    name = "n_tokens_" if clashes else "n_tokens"
    processor = token_counts.model(path)
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r[name], r["over_limit"]) for r in got.collect()) == sorted(
        (d[0] or 0, len((d[1] or "").encode()), n, n > 4096)
        for d in DOCS for n in [len(processor.encode(d[1] or ""))])
    assert token_counts.with_counts(empty(spark), path, 4096).count() == 0


@pytest.mark.parametrize("clashes", [False, True])
def test_packing(spark, clashes):
    rows = packing.pack(docs(spark, clashes=clashes), public_tokenizers.path(BYTE_BPE), 0).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 for r in rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    wanted = []
    for d in DOCS:
        ids = tokenizer.encode(d[1] or "", add_special_tokens=False).ids + [0]
        start = 0
        for n in packing.piece_lengths(len(ids), 1024):
            piece = ids[start:start + n]
            wanted.append((d[0] or 0, start, n, crc(piece), len(ids), np.array(piece, "<u4").tobytes()))
            start += n
        assert start == len(ids)
    assert sorted((r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], bytes(r["ids"]))
                  for r in rows) == sorted(wanted)
    buckets = {}
    for r in rows:
        buckets.setdefault(r["sequence_id"] >> 58, set()).add(r["length"])
    assert all(lengths == {1 << b} for b, lengths in buckets.items())
    assert packing.pack(empty(spark), public_tokenizers.path(BYTE_BPE), 0).count() == 0


def test_buckets_are_written_apart(spark):
    path = scratch(spark, "buckets")
    packing.write_buckets(packing.pack(docs(spark), public_tokenizers.path(BYTE_BPE), 0), path)
    back = spark.read.parquet(path)
    assert back.where("bucket <> length").count() == 0 and back.select("bucket").distinct().count() > 3
