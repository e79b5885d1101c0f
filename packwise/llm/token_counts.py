"""Exact token counts of whole texts, huge ones by overlapping chunks that are spliced.

A text of over ``chunk`` bytes is encoded in windows that overlap. Two neighbours are spliced
at a boundary that both have a token start at and that is proven stable: a blank after something
else than a blank. No piece of the vocabulary holds such a blank inside (``stable`` checks all
pieces), and byte-pair merges only ever make pieces, so what is left of the boundary can't change
what is right of it. Where the overlap has no such boundary, it is doubled, up to the whole text.

Defined results: null is an empty text with no tokens; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from packwise.llm.common import col, fresh

CHUNK, OVERLAP = 32_768, 128
BLANK = "▁"
_MODELS: dict[str, sentencepiece.SentencePieceProcessor] = {}


def model(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _MODELS:
        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def stable(processor: sentencepiece.SentencePieceProcessor) -> bool:
    """No piece has a blank after another character, and white space is taken as it is."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any(BLANK in p.lstrip(BLANK) for p in pieces) and len(processor.encode("a  b")) == 3


def starts(processor, data: bytes, at: int, end: int) -> list[int]:
    """Token starts of data[at:end], as places in data. A window begins at a blank, which the
    processor's own first blank stands for, or at the start of the text."""
    lead = 1 if at else 0
    got = processor.encode(data[at + lead:end].decode(), out_type="proto")
    return [at + lead + p.begin if i or not lead else at for i, p in enumerate(got.pieces)]


def splice(left: list[int], right: list[int], data: bytes) -> int | None:
    """The last boundary that both windows start a token at and that is proven stable."""
    for place in sorted(set(left) & set(right), reverse=True):
        if place and data[place] == 32 and data[place - 1] != 32 and not data.endswith(BLANK.encode(), 0, place):
            return place
    return None


def whole(data: bytes, end: int) -> int:
    """The end, moved back to the start of a character."""
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return min(end, len(data))


def count_tokens(processor, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    data = text.encode()
    if len(data) <= chunk:
        return len(processor.encode(text))
    total, at, end = 0, 0, whole(data, chunk)
    own = starts(processor, data, at, end)
    while end < len(data):
        width, place = overlap, None
        while place is None and width < end - at:
            first = data.find(b" ", max(at + 1, end - width), end)
            if first > 0:
                last = whole(data, first + chunk)
                right = starts(processor, data, first, last)
                place = splice(own, right, data)
            width *= 2
        if place is None or last <= end:  # nothing to align on in the whole window: widen the window itself
            end = whole(data, end + (end - at))
            own = starts(processor, data, at, end)
            continue
        total += sum(s < place for s in own)
        at, end = place, last
        own = [s for s in right if s >= place]
    return total + len(own)


def with_counts(docs: DataFrame, path: str, limit: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit, under these names or, where they clash, longer ones."""

    @pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        processor = model(path)
        widest = chunk if stable(processor) else float("inf")
        for batch in texts:
            yield pd.Series([0 if t is None else count_tokens(processor, t, widest, overlap) for t in batch],
                            dtype="int64")

    n_bytes, n_tokens, over = fresh(docs, "n_bytes", "n_tokens", "over_limit")
    return docs.withColumns({n_bytes: F.coalesce(F.octet_length(col("text")), F.lit(0)).cast("long"),
                             n_tokens: tokens(col("text"))}).withColumn(over, F.col(n_tokens) > limit)
