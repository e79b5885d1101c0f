"""Text helpers against Python's own string methods."""

import random

from pyspark.sql import functions as F

from packwise.functions import text as tx

SPACES = [c for c in map(chr, range(0x10000)) if c.isspace()]


def test_space_characters_are_those_of_python():
    assert tx.SPACE_CHARACTERS == "".join(SPACES)


def test_strip_collapse_and_blankness(spark):
    rng = random.Random(3)
    letters = [*"abZ9-!", "é", "​", "﻿", "\U0001f600", "\x00", "\x7f", "᠎"]
    texts = ["", " ", *SPACES, None] + [
        "".join(rng.choice(SPACES if rng.random() < 0.2 else [" "] if rng.random() < 0.4 else letters)
                for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    t = F.col("text")
    got = df.select("i", tx.strip(t), tx.collapse(t), tx.has_text(t), tx.normalize_key(t)).collect()
    for i, stripped, collapsed, has, key in got:
        text = texts[i]
        if text is None:
            assert (stripped, collapsed, has, key) == (None, None, False, None)
        else:
            assert (stripped, collapsed, has) == (text.strip(), " ".join(text.split()), bool(text.strip()))
            assert key == " ".join(text.split()).lower()


def test_ordered_bits_are_those_of_the_double(spark):
    import struct
    rng = random.Random(4)
    numbers = [5e-324, 2.2250738585072014e-308, 2.2250738585072009e-308, 1.0, 0.5, 2.0, 1.7976931348623157e308]
    numbers += [2.0 ** k for k in range(-40, 40)] + [rng.random() for _ in range(500)]
    numbers += [x for k in range(-40, 40) for x in (2.0 ** k * (1 - 2 ** -53), 2.0 ** k * (1 + 2 ** -52))]
    numbers += [10 ** rng.uniform(-300, 300) for _ in range(500)]
    df = spark.createDataFrame([(n,) for n in numbers], "n double")
    for n, bits in df.select("n", tx.ordered_bits(F.col("n"))).collect():
        assert bits == struct.unpack("<q", struct.pack("<d", n))[0]
    assert df.limit(1).select(tx.ordered_bits(F.lit(float("nan")))).first()[0] == struct.unpack(
        "<q", struct.pack("<d", 1.7976931348623157e308))[0]
