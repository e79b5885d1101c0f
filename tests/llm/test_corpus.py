"""Line dedup, SimHash, language, decontamination and quality against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from packwise.llm import components, decontam, langid, line_dedup, quality, simhash
from packwise.llm.queries import learnable
from tests.llm.tables import DOCS, LINE, docs, empty, prose

SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# Lines

def brute_lines(rows):
    def keys(text):
        return [ascii_lower(x.strip(SPACE)) for x in (text or "").split("\n")]

    holders = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            for k in keys(text):
                if len(k) >= 20:
                    holders.setdefault(k, set()).add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, keys(text))
                if doc_id is None or len(holders.get(k, ())) < 3 or len(k) < 20 or doc_id == max(holders[k])]
        out.append((doc_id or 0, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("clashes", [False, True])
def test_line_dedup(spark, clashes):
    got = line_dedup.drop_repeated_lines(docs(spark, clashes=clashes))
    name = "n_lines_" if clashes else "n_lines"
    rows = sorted((r["doc_id"] or 0, r[name], r["n_dropped"], r["text"]) for r in got.collect())
    assert rows == brute_lines(DOCS)
    by_id = {r[0]: r for r in rows}
    assert by_id[6][2] == 1 and by_id[7][2] == 0 and LINE in by_id[7][3]
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


# Fingerprints

def brute_print(text, shingle=4):
    words = [w for w in re.split(f"[{SPACE}]+", ascii_lower(text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_components(rows):
    named = [(r[0], brute_print(r[1])) for r in rows]
    pairs = [(i, j) for i in range(len(named)) for j in range(i)
             if None not in (named[i][0], named[j][0])
             and (named[i][0] == named[j][0] or bin(named[i][1] ^ named[j][1]).count("1") <= 4)]
    roots = union(len(named), pairs)
    least = {}
    for (doc_id, _), r in zip(named, roots):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted((d or 0, f"{p:016x}", least[r] if d is not None else 0) for (d, p), r in zip(named, roots))


@pytest.mark.parametrize("clashes", [False, True])
def test_simhash_rows(spark, clashes):
    got = simhash.near_duplicates(docs(spark, clashes=clashes)).collect()
    assert sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"] or 0) for r in got) == brute_components(DOCS)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_kept_rows(spark):
    kept = simhash.drop_near_duplicates(docs(spark))
    comps = {r[2] for r in brute_components(DOCS) if r[0]}
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(comps)
    assert kept.where("doc_id is null").count() == 2 and kept.columns == docs(spark).columns


@pytest.mark.parametrize("part", [8192, 7])
def test_links_lose_nothing(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        for _ in range(25):  # chains of fingerprints that drift away from the seed
            prints.add(seed)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                seed ^= 1 << b
    prints |= {0, 1, (1 << 64) - 1}
    prints = sorted(prints)
    nodes = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    links = simhash.link(spark.createDataFrame(nodes, "node long, fp long")).collect()
    assert all(bin(prints[u] ^ prints[v]).count("1") <= 64 for u, v in links)
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    assert union(len(prints), links) == union(len(prints), pairs)


def test_pivot_table_never_discards_a_link():
    rng = random.Random(4)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        assert all(abs(bin(a ^ p).count("1") - bin(b ^ p).count("1")) <= 4 for p in simhash.pivots())


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted([(i, 0) for i in range(1, 201)] + [(i, 1000) for i in range(1001, 1200)])
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Language

def test_language_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(learnable(table))
    assert [x for x, _ in model.dictionaries] == ["de", "en", "es", "fr"]
    assert all(len(c) < 4 * langid.SAMPLE_ROWS * langid.SAMPLE_CHARS for _, c in model.dictionaries)
    held = langid.identify(table.subtract(learnable(table)), model)
    rows = held.where("length(text) > 40").select("lang", "lang_pred", "accepted").collect()
    assert sum(r[0] == r[1] for r in rows) >= 0.97 * len(rows)
    assert sum(r[2] for r in rows) >= 0.97 * len(rows)


def test_language_is_learnt_from_any_place_of_a_text(spark):
    rows = [(i, " ".join(f"w{chr(97 + j // 26 % 26)}{chr(97 + j % 26)}x" for j in range(500)), "en", "a", 0) for i in range(40)]
    (_, content), = langid.learn(docs(spark, rows)).dictionaries
    found = {w for w in content.split() if len(w) == 4}
    assert len(found) > 450  # the first 512 code points hold 102 words
    short = langid.learn(docs(spark, [(1, "kurz und gut", "de", "a", 0)])).dictionaries
    assert short == (("de", b"kurz und gut"),)


def test_language_of_odd_rows(spark):
    model = langid.Model((("en", b"the river took old stones down to sea"), ("fr", "où êtes vous allés hier".encode())))
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, clashes=True), model).collect() if r["doc_id"]}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score_"] == 0 and not got[d]["accepted"] for d in (3, 4, 8, 9))
    assert got[1]["lang_pred"] == "en" and got[1]["accepted"] and 0 < got[1]["score_"] <= 1
    assert {r["lang_pred"] for r in langid.identify(docs(spark), langid.learn(empty(spark))).collect()} == {"und"}
    one = langid.identify(docs(spark), langid.Model((("en", b"the"),))).where("doc_id = 1").first()
    assert (one["lang_pred"], one["score"]) == ("en", 1.0)
    assert langid.identify(empty(spark), model).count() == 0


# Decontamination

ITEM = [("a", prose(1, 14)), ("b", "Short item"), ("c", None), ("d", ""), (None, prose(6, 12)), ("a", prose(7, 12)),
        ("e", prose(2, 9)), ("f", "nowhere to be found at all in any of these texts")]


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def brute_hits(rows, items, window=10):
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = brute_words(text), set(), set()
        for item, t in items:
            iw = brute_words(t)
            for i in range(max(1, len(iw) - window + 1) if iw else 0):
                win = iw[i:i + window]
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        if item is not None:
                            found.add(item)
        out.append((doc_id or 0, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out)


CONTAMINATED = [*[d for d in DOCS if d[0] != 10], (20, "A short-item, here. SHORT ITEM!", "en", "a", 0),
                (21, f"x {prose(1, 14)} y {prose(7, 12)} {prose(7, 12)}", "en", "a", 0)]


@pytest.mark.parametrize("most", [100_000, 10])
def test_contamination(spark, most):
    benchmark = spark.createDataFrame(ITEM, "item_id string, text string")
    index = decontam.build_index(docs(spark, CONTAMINATED, clashes=True))
    got = decontam.contamination(index, benchmark, most=most).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got) == brute_hits(
        CONTAMINATED, ITEM)
    none = decontam.contamination(index, benchmark.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(CONTAMINATED)
    assert decontam.contamination(decontam.build_index(empty(spark)), benchmark).count() == 0


def test_phrases_and_nearness(spark):
    rows = [(1, "zero alpha beta gamma delta end", "en", "a", 0), (2, "delta x beta y alpha z gamma", "en", "a", 0),
            (3, "alpha beta gamma " + "far " * 40 + "delta", "en", "a", 0), (4, None, None, None, None)]
    benchmark = spark.createDataFrame([("q", "Alpha, beta: gamma delta")], "item_id string, text string")
    got = decontam.matches(decontam.build_index(docs(spark, rows)), benchmark, near=4).collect()
    assert {(r["doc_id"], r["kind"]) for r in got} == {(1, "phrase"), (1, "near"), (2, "near")}
    assert [(r["position"], r["length"]) for r in got if r["kind"] == "phrase"] == [(1, 4)]


def test_dropped_documents(spark):
    benchmark = spark.createDataFrame(ITEM, "item_id string, text string")
    kept = decontam.drop_contaminated(docs(spark, CONTAMINATED), benchmark)
    bad = {r[0] for r in brute_hits(CONTAMINATED, ITEM) if r[0] and r[2]}
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(
        d[0] or 0 for d in CONTAMINATED if d[0] not in bad)


# Quality

def brute_measures(text):
    words = [w for w in re.split(f"[{SPACE}]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


EXTRA = [(30, "a b c a b c a b c d " * 20, "en", "a", 0), (31, "# * $ x\nq\nq\n \n \nq r s t q r s\n" * 3, "en", "a", 0),
         (32, "x x x", "en", "a", 0), (33, "one two three one two three four " + prose(9, 60), "en", "a", 0)]


@pytest.mark.parametrize("clashes", [False, True])
def test_base_measures(spark, clashes):
    rows = DOCS + EXTRA
    got = quality.judge(docs(spark, rows, clashes), [0] * 64)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    kept = "kept_" if clashes else "kept"
    assert sorted((r["doc_id"] or 0, *[r[n] for n in names], r[kept]) for r in got.collect()) == sorted(
        (d[0] or 0, *m, not m[-1]) for d in rows for m in [brute_measures(d[1])])
    assert quality.judge(empty(spark), [0] * 64).count() == 0


def test_weights_and_scores(spark):
    rows = [r for r in DOCS if r[0] not in (10, 11)] + EXTRA
    trusted = spark.createDataFrame([(1,), (33,), (99,)], "doc_id long")
    weights = quality.learn(docs(spark, rows), trusted, 64)
    one = quality.hashes_of(quality.words_of(F.col("text")))
    table = docs(spark, rows).select("doc_id", one.alias("one"), quality.pairs_of(one, one, 1).alias("two"))
    grams = [(r["doc_id"], [h % 64 for h in [*r["one"], *r["two"]]]) for r in table.collect()]
    for d, text, *_ in rows:
        words = [w for w in re.split(f"[{SPACE}]+", text or "") if w]
        assert (d, max(0, 2 * len(words) - 1)) in {(g[0], len(g[1])) for g in grams}
    raw, target = Counter(), Counter()
    for d, b in grams:
        raw.update(b)
        if d in (1, 33):
            target.update(b)
    R, T = sum(raw.values()) + 64, sum(target.values()) + 64
    assert weights == [round(1e6 * math.log((target[b] + 1) * R / ((raw[b] + 1) * T))) for b in range(64)]
    scored = {(r["doc_id"], r["n_words"]): r["score"] for r in quality.judge(docs(spark, rows), weights).collect()}
    for d, b in grams:
        if b:
            assert scored[d, (len(b) + 1) // 2] == pytest.approx(sum(weights[x] for x in b) / 1e6 / len(b))
    assert quality.learn(docs(spark, rows), trusted.limit(0), 64) == [0] * 64


def test_threshold_is_held_out(spark):
    good = [("en", True, 0.1 + i / 1000) for i in range(95)] + [("de", True, -0.3 + i / 1000) for i in range(5)]
    bad = [("en", False, -0.5 + i / 1000) for i in range(20)] + [("de", False, -0.2)]
    assert quality.threshold(good + bad) == -0.3 == quality.threshold(bad[::-1] + good[::-1])
    assert quality.threshold(good) == quality.threshold(bad) == quality.threshold([]) == -math.inf
    rows = [(i, prose(i, 80), "en", "a", 0) for i in range(1, 13)]
    labels = spark.createDataFrame([(i, int(i < 7), 0) for i in range(1, 11)], "doc_id long, quality int, toxic int")
    table = docs(spark, rows)
    counts = quality.counted(table, quality.trusted_ids(labels), 64)
    held = sorted((r["good"], round(r["score"], 5)) for r in quality.held_scores(table, labels, counts).collect())
    expected = []
    for i in range(1, 11):
        without = quality.trusted_ids(labels.where(F.col("doc_id") != i))
        scored = quality.judge(table.where(F.col("doc_id") == i), quality.learn(table, without, 64)).first()
        if not scored["base_failed"]:
            expected.append((i < 7, round(scored["score"], 5)))
    assert len(held) > 6 and held == sorted(expected)
    plan = quality.held_scores(table, labels, counts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "transform" in plan  # only the written labelled rows are judged


def test_all_labelled_rows_count(spark):
    """None of many labelled rows is left out of the target or the threshold."""
    n = 11_000
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"), F.lit(0).alias("toxic"))
    table = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat_ws(
        " ", *[F.hash("id", F.lit(i)) % 9 for i in range(4)], *[F.lit(f"w{i}") for i in range(60)]).alias("text"))
    rows = quality.labelled_rows(table, quality.marks_of(labels), 64)
    counts = quality.counts_with(table, rows, 64)
    assert counts == quality.counted(table, quality.trusted_ids(labels), 64)
    assert [sum(c) for c in zip(*counts)] == [n * 127, n // 2 * 127]
    few, rest = quality.perhaps_among(table, labels.where("doc_id < 40"), "doc_id")
    few = [r[0] for r in few.select("doc_id").collect()]
    assert set(few) >= set(range(40)) and len(few) < 100 and rest.count() + len(few) == n
    assert quality.perhaps_among(table, labels.withColumn("doc_id", F.col("doc_id").cast("int")), "doc_id")[0] is table
    held = quality.held_scores(table, labels, counts)
    assert {r["good"]: r["count"] for r in held.groupBy("good").count().collect()} == {True: n // 2, False: n // 2}


def test_cut_of_a_frame_is_that_of_a_list(spark):
    import random
    draw = random.Random(5)
    for n, spread in ((400, 1.0), (60, 0.001), (300, 9.0)):
        held = [(draw.choice(["en", "de", None]), good, round(draw.gauss(0.6 if good else -0.6, 0.4) * spread, 3))
                for good in (True, True, True, False) for _ in range(n // 4)]
        frame = spark.createDataFrame(held, "lang string, good boolean, score double")
        assert quality.held_out_cut(frame) == quality.threshold(held) > -math.inf
        for part in ("good", "not good", "false"):
            assert quality.held_out_cut(frame.where(part)) == -math.inf
    one = spark.createDataFrame([("en", True, 0.5), ("en", False, 0.25), ("en", False, 0.125)], frame.schema)
    assert quality.held_out_cut(one) == 0.5 and quality.held_out_cut(one.where("score <> 0.25")) == 0.5
    assert quality.held_out_cut(one.withColumn("good", F.col("score") < 0.2)) == -math.inf


def test_trusted_ids_are_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2, 1 if i % 10 == 1 else 0) for i in range(400)] + [(None, 1, 0), (7, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    assert quality.trusted_ids(labels).count() == 160
    assert quality.trusted_ids(labels, 20).count() == 20
    assert quality.trusted_ids(labels.limit(0)).count() == 0


def test_hash_is_xxh64(spark):
    got = spark.sql("SELECT xxhash64('a b c d') AS h").first()["h"] % (1 << 64)
    assert got == xxhash.xxh64_intdigest(b"a b c d", 42)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442") and np.bitwise_count(np.uint64(7)) == 3
