"""Quality rules and a verdict by hashed n-grams, in DataFrame functions only.

Target and raw multinomials are counted over hash buckets of word unigrams and bigrams: the target
over all rows labelled good and not toxic, the raw one over all documents. A document's score is the
mean over its n-grams of log(p_target / p_raw); weights are whole numbers (millionths), so a score
doesn't depend on the order of summation. A document is kept if it passes the base rules and its
score reaches ``min_score``, which ``held_out_cut`` derives from all labelled rows as they score
without their own counts.

Shuffled are counts per bucket, summed before they move, and the texts of labelled rows (with few
others), once, to their labels. A bit map of the labels' ids and the weights (``BUCKETS`` numbers) go
to every task.

Defined results: null text has no words, no line and fails the base rules; with no trusted rows
all weights are zero and the base rules decide; rows of one doc_id are judged each for itself;
an empty table stays empty; other columns are kept by ``judge``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwise.functions.keys import perhaps_among
from packwise.llm.common import ASCII_SPACE, col, fresh, written

BUCKETS = 16_384
#: A lost good row weighs as so many kept bad ones.
LOSS = 10
SCALE = 1_000_000
SYMBOL_CHARS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    even = F.coalesce(text, F.lit(""))
    for blank in ASCII_SPACE[1:]:
        even = F.replace(even, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(even, " ", -1), "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def pairs_of(hashes: Column, others: Column, start: int) -> Column:
    """Hashes of each entry with the one of ``others`` that stands ``start`` places further."""
    left = F.greatest(F.size(others) - start, F.lit(0))
    both = F.zip_with(hashes, F.slice(others, F.lit(start + 1), left), lambda a, b: F.xxhash64(a, b))
    return F.slice(both, F.lit(1), left)


def base_measures(text: Column, words: Column, triples: Column) -> dict[str, Column]:
    """``triples`` are the hashes of all windows of three words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    symbols = F.lit(0)
    for mark in SYMBOL_CHARS:
        symbols = symbols + F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(triples),
    }


def repeat_words(windows: Column, width: int = 3) -> Column:
    """Words inside windows of three that the text has twice or more.

    Where no window repeats, that is all. Else windows are sorted by hash and place; a window that
    equals a neighbour repeats. Of the repeated places in order, each adds the words that the one
    before it doesn't reach.
    """
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    after = F.slice(ranked, F.lit(2), F.size(windows))
    same = F.zip_with(ranked, after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.array_compact(same))))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, p: F.struct((a["n"] + p + width - F.greatest(a["upto"], p)).alias("n"), (p + width).alias("upto")),
        lambda a: a["n"])
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeats, covered).otherwise(0).cast("long")


def trusted_ids(labels: DataFrame, bound: int | None = None) -> DataFrame:
    """The ids of rows labelled good and not toxic; with ``bound`` those of the smallest hashes."""
    good = labels.where(_is_good() & col("doc_id").isNotNull()).select(col("doc_id").alias("doc_id")).distinct()
    return good if bound is None else good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def _is_good() -> Column:
    return F.coalesce((col("quality") == 1) & (F.coalesce(col("toxic"), F.lit(0)) == 0), F.lit(False))


def marks_of(labels: DataFrame) -> DataFrame:
    """doc_id, good of every id labelled good and not toxic, or else bad."""
    told = labels.where(col("doc_id").isNotNull() & (_is_good() | (col("quality") == 0)))
    return told.groupBy(col("doc_id").alias("doc_id")).agg(F.max(_is_good()).alias("good"))


def labelled_rows(docs: DataFrame, marks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """lang, good, base_failed and the sorted buckets of all n-grams (``grams``) of every marked row.

    The rows are written: they are read for the target and for the threshold, and a filter on them isn't pushed
    below the join, where the base rules would run over all documents.
    """
    lang = col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"), lang.cast("string").alias("lang"))
    marks = marks.select("doc_id", "good")
    rows = perhaps_among(rows, marks, "doc_id")[0].join(marks.hint("shuffle_hash"), "doc_id")
    out, name = _measured(rows)
    grams = F.transform(F.concat(name["_one"], name["_two"]), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    return written(out.select("lang", "good", name["base_failed"], F.sort_array(grams).alias("grams")), "labelled-rows")


def _per_bucket(grams: DataFrame) -> dict[int, int]:
    """How often each bucket stands in the arrays of the one column."""
    each = grams.select(F.explode(F.col(grams.columns[0])).alias("bucket"))
    return {r["bucket"]: r["n"] for r in each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}


def counts_with(docs: DataFrame, rows: DataFrame, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """The raw count of each bucket over all documents, the target count over the good ``labelled_rows``."""
    one = docs.select(hashes_of(words_of(col("text"))).alias("_one"))
    every = one.select(F.explode(F.concat("_one", pairs_of(F.col("_one"), F.col("_one"), 1))).alias("_gram"))
    counts = every.groupBy(F.pmod("_gram", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    raw = {r["bucket"]: r["n"] for r in counts.collect()}
    target = _per_bucket(rows.where("good").select("grams"))
    return [(raw.get(b, 0), target.get(b, 0)) for b in range(buckets)]


def counted(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """The raw and the target count of each bucket; the target's are those of the rows with an id in ``trusted``."""
    marks = trusted.select(col("doc_id").alias("doc_id")).distinct().withColumn("good", F.lit(True))
    return counts_with(docs, labelled_rows(docs, marks, buckets), buckets)


def weights_of(counts: list[tuple[int, int]]) -> list[int]:
    """The weight of each bucket, in millionths: log of its share in the target over that in the raw corpus."""
    raw, target = (sum(r[i] for r in counts) for i in (0, 1))
    if not target:
        return [0] * len(counts)
    n = len(counts)
    return [round(SCALE * math.log((t + 1) * (raw + n) / ((r + 1) * (target + n)))) for r, t in counts]


def learn(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    return weights_of(counted(docs, trusted, buckets))


def held_scores(docs: DataFrame, labels: DataFrame, counts: list[tuple[int, int]]) -> DataFrame:
    """lang, good, score of every labelled row that passes the base rules (``scores_without_self``)."""
    return scores_without_self(labelled_rows(docs, marks_of(labels), len(counts)), counts)


def scores_without_self(rows: DataFrame, counts: list[tuple[int, int]]) -> DataFrame:
    """lang, good, score of the ``labelled_rows`` that pass the base rules. A good row is scored as if it weren't in
    the target. Its buckets are sorted, so each one's own count is the length of its run, and nothing moves."""
    size = len(counts)
    raw, trusted = (sum(r[i] for r in counts) for i in (0, 1))
    logs, target = (F.split(F.lit(",".join(map(str, x))), ",") for x in zip(*((math.log(r + 1), t) for r, t in counts)))
    logs, target = logs.cast("array<double>"), target.cast("array<bigint>")
    mine = F.when(F.col("good"), F.size("grams")).otherwise(0)
    passed = rows.where(~F.col("base_failed")).withColumn(
        "_scale", F.lit(math.log(raw + size)) - F.log(F.greatest(F.lit(trusted) - mine, F.lit(0)) + size))
    ends = F.array_compact(F.transform("grams", lambda b, i: F.when(
        ~F.get("grams", i + 1).eqNullSafe(b), F.struct(b.alias("b"), (i + 1).alias("upto")))))

    def add(a: Column, end: Column) -> Column:
        n = end["upto"] - a["upto"]
        left = F.greatest(F.get(target, end["b"]) - F.when(F.col("good"), n).otherwise(0), F.lit(0)) + 1
        weight = F.rint(SCALE * (F.log(left) + F.col("_scale") - F.get(logs, end["b"]))).cast("long")
        return F.struct((a["total"] + n * weight).alias("total"), end["upto"].alias("upto"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("upto"))
    total = F.aggregate(ends, start, add, lambda a: a["total"])
    return passed.select("lang", "good", (total / F.lit(float(SCALE)) / F.size("grams")).alias("score"))


#: Shares are summed as whole numbers of this unit, so that no order of summation matters; TIE is a share too small to tell.
UNIT, TIE = 10 ** 17, 10 ** 8
#: Scores are brought together by their whole number of so many parts.
PARTS = 4096


def held_out_cut(held: DataFrame, loss: float = LOSS) -> float:
    """``threshold`` over all rows of a frame (lang, good, score), whatever their number.

    Shares are summed along the scores in ranges of a width of 1 / PARTS; the ranges' sums, as many as the span of the
    scores has, are then summed along the ranges. One row a language and single figures come to the driver.
    """
    held = written(held, "held-scores")
    sizes = held.where("good").groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    n_langs, n_bad = sizes.count(), held.where("not good").count()
    if not n_langs or not n_bad:
        return -math.inf
    own = F.when(F.col("good"), F.lit(-loss * UNIT / n_langs) / F.col("_n")).otherwise(F.lit(UNIT / n_bad))
    shared = held.join(F.broadcast(sizes), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    steps = written(shared.groupBy("score").agg(F.sum(F.round(own).cast("long")).alias("step")).withColumn(
        "range", F.floor(F.col("score") * PARTS)), "score-steps")
    before = F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = steps.groupBy("range").agg(F.sum("step").alias("sum")).select(
        "range", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("step").over(Window.partitionBy("range").orderBy("score"))
    gains = steps.withColumn("within", within).join(ranges, "range").select(
        "score", (F.col("before") + F.col("within")).alias("gain"))
    best = gains.agg(F.max("gain")).first()[0]
    if best <= TIE:
        return -math.inf
    last = gains.where(F.col("gain") >= best - TIE).agg(F.min("score")).first()[0]
    after = steps.where(F.col("score") > last).agg(F.min("score")).first()[0]
    return math.nextafter(last, math.inf) if after is None else after


def threshold(held: list[tuple[str | None, bool, float]], loss: float = LOSS) -> float:
    """The score t with the largest share of bad rows below it, less ``loss`` times that of good rows, of a short list.

    The share of good rows is the mean of the languages' shares, so one with little target evidence
    isn't given up for the others. Of equal scores the lowest; no bound without good or bad rows.
    """
    kinds = {lang: [s for x, good, s in held if good and x == lang] for lang in {x for x, good, _ in held if good}}
    bad = [s for _, good, s in held if not good]
    if not kinds or not bad:
        return -math.inf
    step = {s: 0.0 for _, _, s in held}
    for s in bad:
        step[s] += 1 / len(bad)
    for scores in kinds.values():
        for s in scores:
            step[s] -= loss / len(scores) / len(kinds)
    best, found, gain = 0.0, -math.inf, 0.0
    order = sorted(step)
    for s, after in zip(order, [*order[1:], math.nextafter(order[-1], math.inf)]):
        gain += step[s]
        if gain > best + 1e-9:
            best, found = gain, after
    return found


def _measured(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with hashes of words, pairs and triples, base measures and base_failed, and the names that these have."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept",
             "_words", "_one", "_two", "_three")
    name = dict(zip(names, fresh(docs, *names)))
    words, one, two, three = (F.col(name[n]) for n in names[-4:])
    # One column after the other: each is used several times, and computed once.
    out = docs.withColumn(name["_words"], words_of(col("text"))).withColumn(name["_one"], hashes_of(words))
    out = out.withColumn(name["_two"], pairs_of(one, one, 1)).withColumn(name["_three"], pairs_of(two, one, 2))
    out = out.withColumns({name[k]: v for k, v in base_measures(col("text"), words, three).items()})
    n_words, n_repeat = F.col(name["n_words"]), F.col(name["n_repeat_words"])
    return out.withColumn(name["base_failed"], (n_words < 50) | (100 * n_repeat > 50 * n_words)), name


def judge(docs: DataFrame, weights: list[int], min_score: float = -math.inf) -> DataFrame:
    """docs with the base measures, base_failed, score and kept (longer names on a clash)."""
    out, name = _measured(docs)
    one, two = F.col(name["_one"]), F.col(name["_two"])
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    total, n_grams = F.lit(0).cast("long"), F.size(one) + F.size(two)
    for grams in (one, two):
        total = total + F.aggregate(grams, F.lit(0).cast("long"), lambda a, h: a + F.get(
            table, F.pmod(h, F.lit(len(weights))).cast("int")))
    out = out.withColumn(name["score"], F.when(n_grams > 0, total / F.lit(float(SCALE)) / n_grams).otherwise(0.0))
    out = out.withColumn(name["kept"], ~F.col(name["base_failed"]) & (F.col(name["score"]) >= min_score))
    return out.drop(*(name[n] for n in ("_words", "_one", "_two", "_three")))
