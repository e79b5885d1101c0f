"""The licence scan against searches by plain Python."""

import random
import re

import pytest

from packwise.llm import licences
from packwise.llm.licence_texts import NOTICES, PHRASES
from packwise.llm.queries import op12_licences
from tests.llm.tables import DOCS, docs, empty, prose

MIT = NOTICES["mit"][1]
TOY = {"one": ["a b c d e f g h", "a b c a b d"], "two": ["c d e x y z c d"], "none": ["", "?!"]}
TOY_PHRASES = {"p": "b c", "q": "c d e", "r": "z", "p2": "b c"}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(texts):
    return {tuple(w[i:j]) for w in map(words, texts) for i in range(len(w)) for j in range(i + 1, len(w) + 1)}


def brute_statistics(text, known):
    """Per place the length of the longest run of a notice that ends there."""
    w, out = words(text), []
    for j in range(len(w)):
        size = 0
        while size <= j and tuple(w[j - size:j + 1]) in known:
            size += 1
        out.append(size)
    return out


def brute_base(text, phrases):
    w = words(text)
    places = [(i, label) for label, p in phrases.items() for i in range(len(w))
              if words(p) and w[i:i + len(words(p))] == words(p)]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places})


def brute_best(text, notices, known, min_match, gap):
    """The largest covered share, by trying each match as the next of every earlier one."""
    w, sizes, best = words(text), brute_statistics(text, known), 0.0
    matches = [(j - s + 1, j, s) for j, s in enumerate(sizes)
               if s >= min_match and (j + 1 == len(w) or sizes[j + 1] <= s)]
    for n in (words(t) for ts in notices.values() for t in ts):
        done = []
        for first, end, size in matches:
            for last in [e for e in range(size - 1, len(n)) if n[e - size + 1:e + 1] == w[first:end + 1]]:
                covered = size
                for text_end, notice_end, got in done:
                    shared = max(0, text_end - first + 1, notice_end - (last - size))
                    if text_end < end and notice_end < last and first - text_end - 1 <= gap and shared < size:
                        covered = max(covered, got + size - shared)
                done.append((end, last, covered))
                best = max(best, covered / len(n))
    return best


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_statistics_and_chains_of_random_texts(piece):
    rng = random.Random(5)
    built = licences.Automaton(TOY, TOY_PHRASES)
    known = runs([*(t for ts in TOY.values() for t in ts), *TOY_PHRASES.values()])
    seen = set()
    for _ in range(1500):
        text = " ".join(rng.choice("abcdefghxyz"[:rng.choice((4, 6, 11))] + "?o") for _ in range(rng.randint(0, 30)))
        if rng.random() < 0.5:
            text += rng.choice((" a b c d ! e f", " c d e x o y z c"))
        got = list(licences.pieces_of(text, piece))
        assert [x.decode() for p in got for x in p] == words(text)
        sizes = [0] * len(words(text))
        for at, state, size, _ in built.statistics(iter(got)):
            if state >= 0:
                sizes[at] = size
        assert sizes == brute_statistics(text, known)
        row = licences.scan(built, got, 3, 2, 0.7)
        assert row[:5] == brute_base(text, TOY_PHRASES)
        score = 1.0 if row[1] else brute_best(text, TOY, known, 3, 2)
        assert row[6] == score
        seen |= {s[0] for s in row[7]}
        assert row[5] == sorted(set(row[4]) | {s[0] for s in row[7]})
    assert seen == {"one", "two"}


EXTRA = [
    (100, f"{prose(1, 40)}\n{MIT}\n{prose(2, 40)}", "en", "a", 0),
    (101, MIT.replace("sublicense, and/or", "sub-license and also quietly").upper(), "en", "a", 0),
    (102, " ".join(MIT.split()[:60]), "en", "a", 0),
    (103, "/* Licensed under the Apache License, Version 2.0. */ GNU General  Public\nLicense; MIT LICENSE CC-BY", "en", "a", 0),
    (104, "Licensed under CC BY-NC 4.0.", "en", "a", 0),
    (105, "This work is licensed under the GNU General Public License, version 3.", "en", "a", 0),
    (106, f"{prose(3, 3000)} {MIT} " * 40, "en", "a", 0),
    (107, "cc by by cc mitlicense gnu general public", "en", "a", 0),
    (108, NOTICES["gpl-2.0"][0], "en", "a", 0),
    (109, f"{NOTICES['bsd-3-clause'][0]} tail", "en", "a", 0),
]


@pytest.mark.parametrize("clashes", [(), ("n_words", "Labels", "score", "spans", "_scan")])
def test_rows(spark, clashes):
    table = docs(spark, DOCS + EXTRA).selectExpr("*", *[f"'x' AS {c}" for c in clashes])
    got = licences.scan_licences(table)
    assert got.columns[:-8] == table.columns
    names = got.columns[-8:]
    rows = [(r["doc_id"], r["text"], *[r[n] for n in names]) for r in got.collect()]
    assert len(rows) == len(DOCS + EXTRA)
    for row in rows:
        assert row[2:7] == brute_base(row[1], PHRASES)
        assert 0 <= row[8] <= 1 and set(row[6]) <= set(row[7])
    by_id = {r[0]: r for r in rows}
    assert by_id[100][7] == ["mit"] and by_id[100][8] == 1.0
    span = by_id[100][9][0]
    assert (span["first_word"], span["last_word"], span["share"]) == (40, 39 + len(words(MIT)), 1.0)
    assert by_id[101][7] == ["mit"] and 0.9 < by_id[101][8] < 1
    assert by_id[102][7] == [] and 0.3 < by_id[102][8] < 0.8
    assert by_id[103][7] == ["apache", "apache-2.0", "cc-by", "gpl", "mit"]
    assert by_id[104][7] == ["cc-by", "cc-by-nc-4.0"] and by_id[105][7] == ["gpl", "gpl-3.0"]
    assert len(by_id[106][9]) == 40 and all(s["share"] == 1.0 for s in by_id[106][9])
    assert by_id[107][2:7] == (8, 1, 0, 0, ["cc-by"])
    assert by_id[108][7] == ["gpl", "gpl-2.0"] and by_id[109][7] == ["bsd-3-clause"]
    assert by_id[10][7] == [] and by_id[3][2:7] == (0, 0, None, None, [])


def test_empty_tables_and_no_notices(spark):
    assert licences.scan_licences(empty(spark)).count() == 0
    rows = licences.scan_licences(docs(spark, EXTRA), {}, {}).collect()
    assert all(r["labels"] == [] and r["score"] == 0 and r["n_words"] == len(words(r["text"])) for r in rows)


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op12_licences(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        n, n_base, first, last, labels = brute_base(texts[r["doc_id"]], PHRASES)
        assert tuple(r)[1:6] == (n, n_base, first, last, ",".join(labels))
    assert sum(r["n_base"] for r in rows) > 0
