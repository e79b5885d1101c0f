"""Collocations of a corpus: frequent phrases whose words stand together more than chance, by language.

Phrases are mined by partitions (SON). Documents are dealt to ``SHARDS`` shards by a hash of their id;
a phrase with ``support`` occurrences in a language has, in one shard at least, the part of them that
the shard has of the language's words. So every shard is mined completely at its proportional support,
level by level: pairs of words that may be frequent in a shard, then longer phrases whose shorter parts are
locally frequent. The union of what is frequent in some shard holds every frequent
phrase, and is counted once more over all shards, exactly and by the phrases themselves.

A shard is a key, not a task: tasks count phrases of their blocks of text by 64-bit hashes, counts are
combined before they move, and hashes alone move while shards are mined. A level is told to the next
pass as a bit map of ``FILTER_BITS`` bits, whatever the corpus (16 MB, sent to every task); two hashes of
one bit, or phrases of one hash, only let more phrases through to the exact count. Scores then need
joins of frequent phrases with the counts of their parts; one word may begin a large share of all phrases, and
adaptive execution splits such a join. Ranks are made in rounds, each of fewer parts of a language.

Defined results: null text has no words; a null language is ``und``; rows that repeat count each; rows
without doc_id count like others; ties are broken by the phrase; a language without frequent phrase gives no
row; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwise.llm.common import blocks, col, written

SUPPORT, WIDTH, TOP = 10, 3, 2000
#: A candidate goes if a longer one around it has so many percent of its occurrences.
CONTAINED = 50
SHARDS = 3
#: Parts of a language that are ranked by themselves, round after round.
ROUNDS = (256, 16, 2, 1)
FILTER_BITS = 27
#: Bytes of text that a task counts at once, and rows of counts that it brings together before they move.
BLOCK, HELD = 1 << 20, 100_000
#: Bits of one row of a bit map, as ``bitmap_construct_agg`` makes them (2^15).
ROW_BITS = 1 << 15

KIND = np.zeros(256, np.uint8)  # 0 in words, 1 between words, 2 between pieces
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Block:
    """The words of some texts: their hashes, languages, shards, and which follow each other in a piece."""

    def __init__(self, batch: pa.RecordBatch):
        texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        data = b"\n".join(texts).lower() + b"\n"
        kind = KIND[np.frombuffer(data, np.uint8)]
        inside = np.concatenate(([False], kind == 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int32)
        start = edges[::2]
        self.n = len(start)
        # Words and what is between them take turns in the data.
        turns = pa.array([], pa.binary()) if not self.n else pa.Array.from_buffers(
            pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        turns = turns.dictionary_encode()
        self.words = turns.dictionary
        self.word = turns.indices.to_numpy(zero_copy_only=False)[::2]
        self.word_hash = _hashes(self.words)
        breaks = np.cumsum(kind == 2, dtype=np.int32)
        self.piece = breaks[start]  # equal within a piece alone: texts are divided by breaks
        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary
        self.lang_hash = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs.to_pylist()], np.uint64)
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        per_text = np.diff(ends, prepend=0)
        self.lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), per_text)
        self.shard = np.repeat(batch.column("shard").to_numpy(zero_copy_only=False), per_text)

    def keys(self, width: int) -> np.ndarray:
        """Hash of language and phrase for every place that begins ``width`` words, in order (see ``places``)."""
        at = self.places(width)
        if not self.n:
            return np.zeros(0, np.uint64)
        key = mixed(self.lang_hash[self.lang[at]], self.word_hash[self.word[at]])
        for k in range(1, width):
            key = mixed(key, self.word_hash[self.word[at + k]])
        return key

    def places(self, width: int) -> np.ndarray:
        """Words that begin a phrase of ``width`` words inside a piece."""
        if width == 1:
            return np.arange(self.n)
        return np.flatnonzero(self.piece[:max(0, self.n - width + 1)] == self.piece[width - 1:])

    def distinct(self, at: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Language and words (as places in ``langs`` and ``words``) of the different phrases that begin at these
        places, and how often each does."""
        parts, n = [self.lang[at], *(self.word[at + k] for k in range(width))], max(1, len(self.words))
        if max(1, len(self.langs)) * n ** width < 1 << 63:
            code = parts[0].astype(np.int64)
            for part in parts[1:]:
                code = code * n + part
            code, counts = np.unique(code, return_counts=True)
            parts = []
            for _ in range(width):
                code, part = np.divmod(code, n)
                parts.insert(0, part)
            return [code, *parts], counts
        rows, counts = np.unique(np.stack(parts, axis=1), axis=0, return_counts=True)
        return list(rows.T), counts

    def phrases(self, words: list[np.ndarray]) -> pa.Array:
        parts = [self.words.take(pa.array(word)) for word in words]
        whole = parts[0] if len(parts) == 1 else pa.compute.binary_join_element_wise(*parts, b" ")
        return whole.cast(pa.string())


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of binary values, which stand one after the other in their buffer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32, len(words) + 1, 4 * words.offset).tolist()
    data = memoryview(data)
    return np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:])], np.uint64)


def mixed(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A hash of two hashes; the order matters."""
    x = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + value
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def through(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys have their bit in the map."""
    place = keys >> np.uint64(64 - FILTER_BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _over_blocks(docs: DataFrame, schema: str, count: Callable[[Block], pa.RecordBatch],
                 keys: list[str] | None = None) -> DataFrame:
    """What ``count`` makes of each block of the documents' text. With ``keys``, rows of equal keys are brought
    together while they are few: counts are added, other columns follow from the keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block in blocks(batches, "text", BLOCK):
            out = count(Block(block))
            if keys is None:
                yield from (out.slice(at, 1 << 16) for at in range(0, out.num_rows, 1 << 16))
                continue
            held.append(out)
            n += out.num_rows
            if n > HELD:
                held = together(held, keys)
                n = sum(b.num_rows for b in held)
                if n > HELD // 2:
                    yield from held
                    held, n = [], 0
        if n:
            yield from together(held, keys)

    return docs.mapInArrow(run, schema)


def together(batches: list[pa.RecordBatch], keys: list[str]) -> list[pa.RecordBatch]:
    """The rows with counts of equal keys added up, in batches of a bounded size."""
    table = pa.Table.from_batches(batches)
    names = table.schema.names
    how = {c: "sum" if c == "count" else "max" for c in names if c not in keys}
    added = table.group_by(keys, use_threads=False).aggregate(list(how.items()))
    out = pa.table({c: added.column(f"{c}_{how[c]}" if c in how else c) for c in names}, schema=table.schema)
    return out.combine_chunks().to_batches(max_chunksize=1 << 16)


def _dealt(docs: DataFrame, shards: int) -> DataFrame:
    lang = F.coalesce(col("lang").cast("string"), F.lit("und"))
    shard = F.pmod(F.xxhash64(col("doc_id")), F.lit(shards)).cast("int")
    return docs.select(F.coalesce(col("text"), F.lit("")).alias("text"), lang.alias("lang"), shard.alias("shard"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, shard, lang_hash, key, count: of each word over all shards (shard is null), and of all words
    of each shard (word is null)."""
    names = ["lang", "word", "shard", "lang_hash", "key", "count"]

    def count(block: Block) -> pa.RecordBatch:
        (lang, word), counts = block.distinct(np.arange(block.n), 1)
        size = len(counts)
        key = mixed(block.lang_hash[lang], block.word_hash[word]) if size else np.zeros(0, np.uint64)
        words = pa.RecordBatch.from_arrays([
            block.langs.take(pa.array(lang)), block.phrases([word]), pa.nulls(size, pa.int32()),
            pa.array(block.lang_hash[lang].view(np.int64)), pa.array(key.view(np.int64)), pa.array(counts)], names)
        group, counts = np.unique((block.lang.astype(np.int64) << 8) + block.shard, return_counts=True)
        size, lang = len(counts), group >> 8
        totals = pa.RecordBatch.from_arrays([
            block.langs.take(pa.array(lang)), pa.nulls(size, pa.string()), pa.array(group & 255).cast(pa.int32()),
            pa.array(block.lang_hash[lang].view(np.int64)), pa.nulls(size, pa.int64()), pa.array(counts)], names)
        return pa.Table.from_batches([words, totals]).combine_chunks().to_batches()[0] if block.n else words

    rows = _over_blocks(docs, "lang string, word string, shard int, lang_hash long, key long, count long", count,
                        ["lang", "word", "shard"])
    return rows.groupBy("lang", "word", "shard").agg(
        *[F.max(c).alias(c) for c in ("lang_hash", "key")], F.sum("count").alias("count"))


def mined(docs: DataFrame, width: int, parts) -> DataFrame:
    """lang_hash, key (with the shard in its last byte), count of phrases of ``width`` words whose two parts, each a
    word shorter, pass the map."""
    def count(block: Block) -> pa.RecordBatch:
        shorter = np.zeros(block.n + 1, bool)
        shorter[block.places(width - 1)] = through(block.keys(width - 1), parts.value)
        at = block.places(width)
        passed = shorter[at] & shorter[at + 1]
        key, at = block.keys(width)[passed], at[passed]
        key = (key >> np.uint64(8) << np.uint64(8)) | block.shard[at].astype(np.uint64)
        lang, out = block.lang[at], []
        for one in np.unique(lang):
            own, counts = np.unique(key[lang == one], return_counts=True)
            out.append(pa.RecordBatch.from_arrays([
                pa.array(np.full(len(own), block.lang_hash[one]).view(np.int64)), pa.array(own.view(np.int64)),
                pa.array(counts)], ["lang_hash", "key", "count"]))
        whole = pa.Table.from_batches(out).combine_chunks().to_batches() if out else []
        return whole[0] if whole else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["lang_hash", "key", "count"])

    rows = _over_blocks(docs, "lang_hash long, key long, count long", count)
    return rows.groupBy("key", "lang_hash").agg(F.sum("count").alias("count"))


def counted(docs: DataFrame, maps: dict[int, object]) -> DataFrame:
    """lang, words, phrase, count: exact counts over all shards of the phrases that pass the map of their width."""
    def count(block: Block) -> pa.RecordBatch:
        out = []
        for width, bits in maps.items():
            at = block.places(width)[through(block.keys(width), bits.value)]
            (lang, *words), counts = block.distinct(at, width)
            out.append(pa.record_batch({
                "lang": block.langs.take(pa.array(lang)), "words": pa.array(np.full(len(lang), width, np.int32)),
                "phrase": block.phrases(words), "count": pa.array(counts)}))
        whole = pa.Table.from_batches(out).combine_chunks().to_batches()
        return whole[0] if whole else out[0]

    rows = _over_blocks(docs, "lang string, words int, phrase string, count long", count, ["lang", "phrase"])
    return rows.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.sum("count").alias("count"))


def bit_map(keys: DataFrame) -> np.ndarray:
    """The map of all keys: 2^FILTER_BITS bits, put together by Spark, so many bytes at the driver whatever the keys."""
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    rows = keys.select(F.shiftright(place, 15).alias("row"), (place % ROW_BITS).alias("bit")).groupBy("row").agg(
        F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    size = ROW_BITS // 8
    for r in rows.collect():
        out[r["row"] * size:(r["row"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def locally_frequent(counts: DataFrame, shares: DataFrame) -> DataFrame:
    """The keys that reach their shard's support."""
    counts = counts.withColumn("shard", F.col("key").bitwiseAND(255).cast("int"))
    both = counts.join(shares.select("lang_hash", "shard", "need"), ["lang_hash", "shard"])
    return both.where(F.col("count") >= F.col("need")).select("key")


def shard_supports(shares: DataFrame, support: int) -> DataFrame:
    """``shares`` (lang, lang_hash, shard, n words) with ``need``: the occurrences there of a phrase of ``support``
    occurrences, if they follow the shards' words, rounded up."""
    total = shares.groupBy("lang").agg(F.sum("n").alias("total"))
    exact = F.col("n").cast("decimal(18,0)") * F.lit(support).cast("decimal(10,0)")
    wide = F.col("total").cast("decimal(28,0)")
    return shares.join(total, "lang").withColumn("need", _whole(exact + wide - 1, wide))


def _whole(a: Column, b: Column) -> Column:
    """a / b without its fraction, exactly."""
    return F.call_function("div", a, b)


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, width: int = WIDTH, shards: int = SHARDS) -> tuple[
        DataFrame, DataFrame]:
    """Phrases of up to ``width`` words with ``support`` occurrences or more in their language, as written
    tables: lang, n (words of the language); and lang, words, phrase, count."""
    if not 0 < shards <= 256:
        raise ValueError("shards are told by a byte")
    dealt, send = _dealt(docs, shards), docs.sparkSession.sparkContext.broadcast
    table = written(word_counts(dealt), "phrase-words")
    words = table.where(F.col("word").isNotNull())
    shares = table.where(F.col("word").isNull()).select("lang", "lang_hash", "shard", F.col("count").alias("n"))
    shares = written(shard_supports(shares, support), "phrase-shares")
    least = shares.groupBy("lang").agg(F.min("need").alias("need"))  # a word frequent in a shard has as many
    maps = {1: send(bit_map(words.join(least, "lang").where(F.col("count") >= F.col("need")).select("key")))}
    for size in range(2, width + 1):
        maps[size] = send(bit_map(locally_frequent(mined(dealt, size, maps[size - 1]), shares)))
        if size == 2:
            maps.pop(1).unpersist()
    phrases = words.where(F.col("count") >= support).select("lang", F.lit(1).alias("words"), F.col("word").alias("phrase"), "count")
    if width > 1:
        phrases = phrases.unionByName(counted(dealt, maps).where(F.col("count") >= support))
    phrases = written(phrases, "phrases")
    for sent in maps.values():
        sent.unpersist()
    return shares.groupBy("lang").agg(F.sum("n").alias("n")), phrases


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of each phrase of two words or more, at its lowest-scoring cut."""
    split = phrases.where(F.col("words") > 1).select(
        "lang", "phrase", F.col("count").alias("a"), "words", F.split("phrase", " ").alias("w"))
    cuts = split.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    for part, name in (("head", "l"), ("rest", "r")):
        counts = phrases.select("lang", F.col("phrase").alias(part), F.col("count").alias(name))
        cuts = cuts.join(counts, ["lang", part])
    a, left, right = (F.col(c).cast("decimal(14,0)") for c in ("a", "l", "r"))
    score = _whole(a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)
    # A score is a million at most: with the cut's place behind it one number tells the lowest and first.
    order = (F.shiftleft(score, 16) + F.col("k")).alias("order")
    best = cuts.select("lang", "phrase", "a", "l", "r", order).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), *[F.min_by(c, "order").alias(c) for c in ("l", "r")], F.min("order").alias("order"))
    return best.select("lang", "phrase", "a", "l", "r", F.shiftright("order", 16).alias("score"))


def contained(phrases: DataFrame, share: int = CONTAINED) -> DataFrame:
    """lang, phrase of candidates inside a longer one that has ``share`` percent of their occurrences."""
    split = phrases.where(F.col("words") > 2).select("lang", "count", "words", F.split("phrase", " ").alias("w"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " "))))
    most = split.select("lang", "count", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(
        F.max("count").alias("most"))
    both = phrases.where(F.col("words") > 1).join(most, ["lang", "phrase"])
    return both.where(100 * F.col("most") >= share * F.col("count")).select("lang", "phrase")


def collocations(docs: DataFrame, support: int = SUPPORT, width: int = WIDTH, top: int = TOP, share: int = CONTAINED,
                 shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of each language."""
    totals, phrases = frequent_phrases(docs, support, width, shards)
    rows = scored(phrases).join(contained(phrases, share), ["lang", "phrase"], "left_anti")
    ranked = rows
    for parts in ROUNDS:
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        order = Window.partitionBy("lang", part).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
