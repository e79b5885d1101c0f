"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

WORDS = ("the river took old stones down to sea where gulls call over grey water and boats lie still in "
         "harbour light until morning comes with wind from north").split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


LINE = "This very line is found in many documents"
DOCS = [
    (1, prose(1, 80), "en", "a", 0),
    (2, prose(1, 80), "en", "a", 0),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, f"{LINE}\n{prose(2, 30)}\n{LINE}", "en", "a", 0),
    (6, f"  {LINE.upper()}\t\n{prose(3, 30)}", "en", "b", 0),
    (7, f"{prose(4, 30)}\n{LINE}\n{LINE}", "en", "b", 0),
    (8, " \t\n\x0b\x0c\r ", "en", "b", 0),
    (9, "1234 5678   　 ---", "en", "b", 0),
    (10, prose(5, 40_000), "en", "b", 0),
    (11, "é́ ́x it's we'll <|endoftext|> b<|startoftext|>c  日本語 テスト 🙂%%%", "en", "b", 0),
    (12, "word", "en", "b", 0),
    (1, prose(1, 80), "en", "a", 0),
    (5, "another text of the same number", "en", "a", 0),
    (None, prose(6, 60), "en", None, 0),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
#: Extra columns whose names clash with what the operators add or use inside.
CLASHES = ("n_lines", "n_tokens", "score", "kept", "fp", "node", "lost", "_lost", "ids", "part", "words", "host")


def docs(spark, rows=DOCS, clashes=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        df = df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHES])
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
