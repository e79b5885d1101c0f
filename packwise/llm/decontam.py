"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns the training documents into shards, rows of a written table. A shard holds
whole documents: the hashes of its terms in order, and for each term the ascending list of its
positions (positions run on through the shard, with a gap after each document that no window can
bridge). ``search`` looks up benchmark windows in every shard: a window with a term that the
shard lacks is out at once; for the others the list of the rarest term, moved back by its offset,
gives the candidate starts, which are intersected with the offset-adjusted lists of the other
terms from rare to frequent. Documents are not cut, so a shard's answer is final and nothing of
the corpus moves. The benchmark is taken in blocks of ``WINDOWS`` windows (all that is sent to a
task at once); every block is run against the whole index.

Terms are compared by 64-bit hashes. Defined results: null texts have no words; benchmark rows
without item_id mark words but name no item; rows of one item_id are one item; rows of one doc_id
stay apart; empty tables give no hits or no rows; other columns are not read. A document that is
longer than a shard is a shard of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwise.llm.common import blocks, col, written

WINDOW = 10
SHARD_BYTES = 4 << 20
WINDOWS = 100_000
NEAR = 4
#: Fixed by the word rule: ASCII letters (lower-cased) and digits and everything beyond ASCII are parts of words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
             for b in range(256))
INDEX = "shard long, doc_ids array<bigint>, n_words array<bigint>, terms binary, counts binary, positions binary"
_INDEX = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()),
                    ("counts", pa.binary()), ("positions", pa.binary())])


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(FOLD).split()


def term_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _shard(texts: list[bytes], gap: int) -> tuple[np.ndarray, bytes, bytes, bytes]:
    """Words of each text; terms, list lengths and position lists."""
    folded = b" ".join([*texts, b""]).translate(FOLD)
    raw = np.frombuffer(folded, np.uint8)
    word = np.concatenate(([False], raw != 32, [False]))
    first = np.flatnonzero(word[1:] & ~word[:-1])
    last = np.flatnonzero(word[:-1] & ~word[1:])
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(first, ends)
    n_words = np.diff(np.concatenate(([0], upto)))
    if not len(first):
        return n_words, b"", b"", b""
    offsets = np.concatenate(([0], np.cumsum(last - first))).astype(np.int32)
    data = folded.translate(None, b" ")
    coded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets),
                                                            pa.py_buffer(data)]).dictionary_encode()
    terms = np.fromiter(map(term_hash, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    by_term = np.argsort(terms)
    rank = np.empty(len(terms), np.int32)
    rank[by_term] = np.arange(len(terms))
    of_word = rank[coded.indices.to_numpy(zero_copy_only=False)]
    positions = np.arange(len(first)) + np.repeat(np.arange(len(texts)) * gap, n_words)
    positions = positions[np.argsort(of_word, kind="stable")].astype("<u4")
    counts = np.bincount(of_word, minlength=len(terms)).astype("<u4")
    return n_words, terms[by_term].astype("<u8").tobytes(), counts.tobytes(), positions.tobytes()


def build_index(docs: DataFrame, gap: int = 64) -> DataFrame:
    """The shards of docs(doc_id, text); ``gap`` must be longer than any window or nearness asked for."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 33
        for batch in blocks(batches, "text", SHARD_BYTES):
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            n_words, *lists = _shard(texts, gap)
            row = [shard, batch.column("doc_id").to_pylist(), n_words.tolist(), *lists]
            shard += 1
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _INDEX.types)], schema=_INDEX)

    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"))
    return written(rows.mapInArrow(build, INDEX), "positional-index")


def windows_of(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words(text)
    if not w:
        return []
    return list(dict.fromkeys(tuple(w[i:i + window]) for i in range(max(1, len(w) - window + 1))))


class Queries:
    """Windows as term numbers, and the items that hold them."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        found: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            for w in windows_of(text, window):
                found.setdefault(w, set()).add(item)
        self.windows = list(found)
        self.items = [sorted(x for x in found[w] if x is not None) for w in self.windows]
        terms = sorted({t for w in self.windows for t in w}, key=term_hash)
        number = {t: i for i, t in enumerate(terms)}
        self.hashes = np.array([term_hash(t) for t in terms], np.uint64)
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.terms = np.zeros((len(self.windows), window), np.int64)
        for i, w in enumerate(self.windows):
            self.terms[i, :len(w)] = [number[t] for t in w]
        self.used = np.arange(window)[None, :] < self.size[:, None]


class Shard:
    """The lists of one shard that the queries' terms have."""

    def __init__(self, queries: Queries, terms: bytes, counts: bytes, positions: bytes):
        own, n = np.frombuffer(terms, "<u8"), np.frombuffer(counts, "<u4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<u4")
        ends = np.cumsum(n)
        at = np.minimum(np.searchsorted(own, queries.hashes), max(0, len(own) - 1))
        there = own[at] == queries.hashes if len(own) else np.zeros(len(at), bool)
        self.first = np.where(there, ends[at] - n[at], 0) if len(own) else np.zeros(len(at), np.int64)
        self.length = np.where(there, n[at], 0) if len(own) else np.zeros(len(at), np.int64)

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.first[term]:self.first[term] + self.length[term]].astype(np.int64)

    def ranked(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose terms the shard all has, and their offsets from the rarest term on."""
        lengths = np.where(queries.used, self.length[queries.terms], np.iinfo(np.int64).max)
        live = np.flatnonzero(lengths.min(axis=1, initial=1 << 62) > 0)
        return live, np.argsort(lengths[live], axis=1, kind="stable")

    def anchors(self, queries: Queries, live: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of each live window's rarest term: rows of ``live`` and positions."""
        rarest = queries.terms[live, order[:, 0]]
        n = self.length[rarest]
        row = np.repeat(np.arange(len(live)), n)
        shift = np.repeat(self.first[rarest] - (np.cumsum(n) - n), n)
        return row, self.positions[shift + np.arange(len(row))].astype(np.int64)

    def phrases(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and starts of all exact occurrences."""
        live, order = self.ranked(queries)
        if not len(live):
            return live, live
        row, start = self.anchors(queries, live, order)
        start = start - order[row, 0]
        # The lists of all terms as one ascending list of (term, position), for one search a step.
        width = int(self.positions.max()) + 2 if len(self.positions) else 1
        needed = np.unique(queries.terms[live][queries.used[live]])
        joined = np.concatenate([self.list_of(t) + t * width for t in needed.tolist()])
        for step in range(1, order.shape[1]):
            if not len(row):
                break
            window, offset = live[row], order[row, step]
            open_ = offset < queries.size[window]
            place = start + offset
            wanted = queries.terms[window, np.minimum(offset, queries.size[window] - 1)] * width + place
            at = np.minimum(np.searchsorted(joined, wanted), len(joined) - 1)
            keep = ~open_ | ((joined[at] == wanted) & (place >= 0) & (place < width))
            row, start = row[keep], start[keep]
        keep = start >= 0
        return live[row[keep]], start[keep]

    def near(self, queries: Queries, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and places of the rarest term that have every other term at most
        the window's length plus ``slack`` words away, in any order."""
        live, order = self.ranked(queries)
        if not len(live):
            return live, live
        row, place = self.anchors(queries, live, order)
        keep = np.ones(len(row), bool)
        for step in range(1, order.shape[1]):
            window, offset = live[row], order[row, step]
            open_ = offset < queries.size[window]
            terms = queries.terms[window, np.minimum(offset, queries.size[window] - 1)]
            reach = queries.size[window] + slack
            for term in np.unique(terms[open_ & keep]).tolist():
                mine = np.flatnonzero(open_ & keep & (terms == term))
                own = self.list_of(term)
                at = np.searchsorted(own, place[mine])
                left = np.abs(place[mine] - own[np.maximum(at - 1, 0)])
                right = np.abs(own[np.minimum(at, len(own) - 1)] - place[mine])
                keep[mine] = np.minimum(left, right) <= reach[mine]
        return live[row[keep]], place[keep]


def _bounds(n_words: list[int], gap: int) -> np.ndarray:
    """First position of each document, and one past the last document's gap."""
    n = np.asarray(n_words, np.int64)
    return np.concatenate(([0], np.cumsum(n + gap)))


def _item_blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[Queries]:
    """The benchmark's rows streamed to the driver, a bounded block at a time."""
    rows = benchmark.select(col("item_id").cast("string").alias("item_id"), col("text").alias("text"))
    some, n = [], 0
    for r in rows.toLocalIterator():
        some.append((r["item_id"], r["text"]))
        n += len(words(r["text"]))
        if n >= most:
            yield Queries(some, window)
            some, n = [], 0
    yield Queries(some, window)


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int | None = None,
            gap: int = 64, most: int = WINDOWS) -> DataFrame:
    """Every match: doc_id, item_id, kind ('phrase' or 'near'), position (of the phrase or of the rarest
    term, in words of the document) and length of the window. Nearness is looked for if ``near`` is given."""
    out = None
    for queries in _item_blocks(benchmark, window, most):

        def find(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            for _, doc_ids, n_words, shard in _shards(batches, queries):
                begin = _bounds(n_words, gap)
                kinds = [("phrase", *shard.phrases(queries))]
                if near is not None:
                    kinds.append(("near", *shard.near(queries, near)))
                rows = [(doc_ids[d], item, kind, int(p - begin[d]), int(queries.size[w]))
                        for kind, which, places in kinds
                        for w, p, d in zip(which.tolist(), places.tolist(),
                                           (np.searchsorted(begin, places, "right") - 1).tolist())
                        for item in queries.items[w]]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    ["doc_id", "item_id", "kind", "position", "length"])

        found = index.mapInArrow(find, "doc_id long, item_id string, kind string, position long, length long")
        out = found if out is None else out.union(found)
    return out


def _shards(batches: Iterator[pa.RecordBatch], queries: Queries):
    for batch in batches:
        for i in range(batch.num_rows):
            number, doc_ids, n_words, terms, counts, positions = (
                batch.column(c)[i].as_py() for c in _INDEX.names)
            yield number, doc_ids, n_words, Shard(queries, terms, counts, positions)


def contamination(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, gap: int = 64,
                  most: int = WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, hits (spans of words within phrases), items (found, sorted)."""
    parts = []
    for queries in _item_blocks(benchmark, window, most):

        def find(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            for number, doc_ids, n_words, shard in _shards(batches, queries):
                begin = _bounds(n_words, gap)
                which, start = shard.phrases(queries)
                order = np.argsort(start, kind="stable")
                which, start = which[order], start[order]
                end = np.maximum.accumulate(start + queries.size[which]) if len(start) else start
                cuts = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1]))) if len(start) else start
                firsts = start[cuts]
                lasts = end[np.concatenate((cuts[1:] - 1, [len(end) - 1]))] if len(cuts) else cuts
                spans: list[list] = [[] for _ in doc_ids]
                items: list[set] = [set() for _ in doc_ids]
                for d, a, b in zip((np.searchsorted(begin, firsts, "right") - 1).tolist(), firsts.tolist(),
                                   lasts.tolist()):
                    spans[d].append({"first": a - int(begin[d]), "end": b - int(begin[d])})
                for d, w in set(zip((np.searchsorted(begin, start, "right") - 1).tolist(), which.tolist())):
                    items[d].update(queries.items[w])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(doc_ids), pa.int64()), pa.array(range(len(doc_ids)), pa.int32()),
                     pa.array(doc_ids, pa.int64()), pa.array(n_words, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                     pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names)

        names = ["shard", "place", "doc_id", "n_words", "hits", "items"]
        parts.append(index.mapInArrow(find, "shard long, place int, doc_id long, n_words long, "
                                            "hits array<struct<first:bigint,end:bigint>>, items array<string>"))
    out = parts[0]
    if len(parts) > 1:  # a document's row of every block of the benchmark
        for part in parts[1:]:
            out = out.union(part)
        out = out.groupBy("shard", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    n_hit = F.aggregate("hits", start, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["first"], a["upto"]))).alias("n"),
        F.greatest(a["upto"], x["end"]).alias("upto")), lambda a: a["n"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), "hits", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a benchmark window; rows without doc_id stay."""
    hit = contamination(build_index(docs.where(col("doc_id").isNotNull())), benchmark, window)
    hit = written(hit.where("n_hit > 0").select("doc_id"), "contaminated").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*map(col, docs.columns))
