"""Language by compression: the language whose text helps zstandard most wins.

Each language has a raw-content dictionary, cut from a bounded sample of labelled rows. A text is
compressed piece by piece with every dictionary, so that a long text can't win by its own history;
the language with the smallest total is predicted, the alphabetically first on a tie. The margin
is (second - smallest) / second; a text is accepted if the margin reaches ``min_margin``.

Defined results: text that is null or has no letter is ``und``, score 0, rejected; with no labelled
rows everything is ``und``; with one language every text with a letter is that language, score 1;
other columns are kept, and none but the text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.functions import pandas_udf

from packwise.llm.common import col, fresh

#: The sample: at most so many labelled rows of a language, and code points from a hashed place of each.
SAMPLE_ROWS, SAMPLE_CHARS = 64, 512
PIECE = 4096
#: Greedy matches of four bytes and more: words of a language share short stretches.
LEVEL, MIN_MATCH = 3, 4
MIN_MARGIN = 0.005
#: What is compressed: ASCII letters (lower-cased) and everything beyond ASCII; the rest is a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNKNOWN = "und"


def letters(text: str) -> bytes:
    return b" ".join(text.encode().translate(FOLD).split())


@dataclass(frozen=True)
class Model:
    """Dictionary content by language, in alphabetical order."""

    dictionaries: tuple[tuple[str, bytes], ...]


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Learns from labelled(doc_id, text, lang): per language the rows of the smallest hashes of doc_id, of each a
    piece of ``chars`` code points from a place that the hash tells (the whole text, if it is shorter)."""
    usable = labelled.where(col("lang").isNotNull() & col("text").rlike(r"\p{L}"))
    usable = usable.select(col("lang").alias("lang"), col("text").alias("text"), col("doc_id").alias("doc_id"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model(())
    # Thinned by hash first, so that few rows are ranked: eight times the bound is expected to be left.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 8 * rows / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    places = F.greatest(F.char_length("text") - chars + 1, F.lit(1))
    start = (F.pmod(F.xxhash64(F.lit("place"), F.col("doc_id")), places) + 1).cast("int")
    ranked = usable.where(place < share[F.col("lang")]).select(
        "lang", F.substring(F.col("text"), start, F.lit(chars)).alias("text"), F.xxhash64("doc_id").alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    sample = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)
    texts: dict[str, list] = {lang: [] for lang in counts}
    for r in sample.collect():
        texts[r["lang"]].append((r["rank"], r["text"]))
    return Model(tuple((lang, b" ".join(letters(t) for _, t in sorted(found)))
                       for lang, found in sorted(texts.items()) if found))


class Scorer:
    def __init__(self, model: Model):
        self.languages, self.compressors = [], []
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, strategy=zstandard.STRATEGY_GREEDY, min_match=MIN_MATCH, write_content_size=False,
            write_checksum=False, write_dict_id=False)
        for lang, content in model.dictionaries:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=how)
            self.languages.append(lang)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=how, dict_data=data))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the margin."""
        if not self.languages or not text or not (text.isalpha() or any(map(str.isalpha, text))):
            return UNKNOWN, 0.0
        data = letters(text)
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]
        if len(sizes) == 1:
            return self.languages[0], 1.0
        low = min(sizes)
        second = min(s for i, s in enumerate(sizes) if i != sizes.index(low))
        return self.languages[sizes.index(low)], (second - low) / second


def identify(docs: DataFrame, model: Model, min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, score and accepted (longer names on a clash)."""

    @pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in texts:
            yield pd.DataFrame([scorer.predict(t) for t in batch], columns=["lang_pred", "score"])

    lang, score, accepted, both = fresh(docs, "lang_pred", "score", "accepted", "_lid")
    out = docs.withColumn(both, predict(col("text"))).select(
        *map(col, docs.columns), F.col(both)["lang_pred"].alias(lang), F.col(both)["score"].alias(score))
    return out.withColumn(accepted, (F.col(lang) != UNKNOWN) & (F.col(score) >= min_margin))
