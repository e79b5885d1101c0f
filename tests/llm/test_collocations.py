"""Collocations against counts by plain Python."""

import random
import re
from collections import Counter

import pytest

from packwise.llm import collocations
from packwise.llm.queries import op13_collocations
from tests.llm.tables import DOCS, docs, empty, prose


def brute(rows, support, width, top, share):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i:i + k])) for k in range(1, width + 1) for i in range(len(w) - k + 1))
    found = {k: c for k, c in counts.items() if len(k[1]) > 1 and c >= support}
    inside = {(lang, p[i:j]) for (lang, p), c in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
              if j - i < len(p) and 100 * c >= share * found[lang, p[i:j]]}
    out = []
    for lang in sorted(n):
        ranked = []
        for (x, p), a in found.items():
            if x == lang and (x, p) not in inside:
                score, k = min((1_000_000 * a * a // (counts[x, p[:k]] * counts[x, p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), counts[x, p[:k]], counts[x, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return out


def drawn(seed, n):
    rng = random.Random(seed)
    parts = ["new york", "hot dog stand", "a", "b", "é", "Ab", "the", "the", "x y", "\U0001f600", "one. two", "c\td", "|", "z!"]
    return " ".join(rng.choice(parts) for _ in range(n))


ROWS = [*DOCS, *((i, drawn(i, 60), rng, "s", 0) for i in range(40, 90) for rng in [("en", "de", None, "und")[i % 4]]),
        *((i, drawn(7, 60), "en", "hot", 0) for i in range(100, 130)), *((None, drawn(i, 20), "xx", "s", 0) for i in range(30)),
        (200, "to be or not to be " * 3000, "en", "s", 0), (201, "w " * 30_000, "fr", "s", 0)]


@pytest.mark.parametrize(("support", "width", "top", "share", "shards"), [
    (10, 3, 2000, 50, 4), (3, 3, 7, 50, 2), (5, 5, 2000, 80, 7), (10, 2, 50, 50, 1)])
def test_against_brute_force(spark, support, width, top, share, shards):
    table = docs(spark, ROWS).selectExpr("*", "'x' AS shard", "1 AS count", "'y' AS key")
    got = collocations.collocations(table, support, width, top, share, shards)
    expected = brute([(r[2], r[1]) for r in ROWS], support, width, top, share)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected) and len(expected) > 10
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_small_blocks_and_narrow_maps(spark, monkeypatch):
    """Blocks cut languages and shards anywhere, and a full map lets everything through."""
    monkeypatch.setattr(collocations, "BLOCK", 500)
    monkeypatch.setattr(collocations, "HELD", 300)
    rows = [r for r in ROWS if r[0] not in (10, 200, 201)]
    got = collocations.collocations(docs(spark, rows), support=4)
    assert sorted(map(tuple, got.collect())) == sorted(brute([(r[2], r[1]) for r in rows], 4, 3, 2000, 50))
    monkeypatch.setattr(collocations, "through", lambda keys, bits: keys == keys)
    got = collocations.collocations(docs(spark, rows), support=4)
    assert sorted(map(tuple, got.collect())) == sorted(brute([(r[2], r[1]) for r in rows], 4, 3, 2000, 50))


def test_map_has_the_bits_of_its_keys_alone(spark):
    rng = random.Random(2)
    keys = [rng.getrandbits(64) for _ in range(3000)] + [0, (1 << 64) - 1]
    signed = [(k - (1 << 64) if k >> 63 else k,) for k in keys]
    bits = collocations.bit_map(spark.createDataFrame(signed, "key long"))
    import numpy as np
    assert collocations.through(np.array(keys, np.uint64), bits).all()
    assert int(np.bitwise_count(bits).sum()) == len({k >> (64 - collocations.FILTER_BITS) for k in keys})
    assert not collocations.bit_map(spark.createDataFrame([], "key long")).any()


def test_shard_supports_lose_no_phrase(spark):
    """A phrase below every shard's support is below the support in all."""
    words = spark.createDataFrame([("en", 1, s, c) for s, c in enumerate((1, 5, 77, 1000, 13))],
                                  "lang string, lang_hash long, shard int, n long")
    for support in (1, 2, 7, 10, 1096, 5000):
        need = [r["need"] for r in collocations.shard_supports(words, support).collect()]
        assert sum(x - 1 for x in need) < support and len(need) == 5


def test_large_counts_are_exact(spark):
    big = 3_000_000_019
    rows = [("en", 1, "x", big), ("en", 1, "y", big + 7), ("en", 2, "x y", big - 1)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, count long")).first()
    assert got["score"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 7))


def test_empty_and_awkward_tables(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(docs(spark, [(1, None, None, None, 0), (2, " .,\n", "en", "a", 0)])).count() == 0
    one = [(i, prose(1, 30), "en", "a", 0) for i in range(12)]
    assert sorted(map(tuple, collocations.collocations(docs(spark, one)).collect())) == brute(
        [(r[2], r[1]) for r in one], 10, 3, 2000, 50)


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op13_collocations(spark, sf).collect())) == sorted(brute(rows, 10, 3, 2000, 50))
