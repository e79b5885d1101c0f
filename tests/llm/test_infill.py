"""Fill-in-middle rows against a cut made by plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packwise.llm import infill
from tests.llm.tables import DOCS, docs, empty, prose

EXTRA = [
    (100 + i, text, "en", "a", 0) for i, text in enumerate((
        "a", "ab cd", "x<P>y", "x<S>y z", "q<M>", "a<b<<c<", "<S", "P><", "S>M>P>< <", "🙂é\r\n\t\x00b", "$1 \\2 ${x} $",
        "word " * 30_000, "." * 50_000, "Ж" * 300 + "abc", "\n\n", "<p><s><m>", "a b\u0085c"))
] + [(200 + i, f"{prose(i, 12)} < {prose(i + 1, 9)} > P> S< {i}", "de", "b", 0) for i in range(200)]


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", text, None, None
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return len(units), form, out, len(p), len(m)


@pytest.mark.parametrize("clashes", [(), ("n", "form", "output", "Prefix_chars", "_a", "_whole")])
def test_rows_against_brute_force(spark, clashes):
    table = docs(spark, DOCS + EXTRA).selectExpr("*", *[f"'x' AS {c}" for c in clashes])
    got = infill.rearrange(table)
    names = got.columns[-5:]
    assert got.columns[:-5] == table.columns
    found = Counter((r["doc_id"], r["text"], *[r[n] for n in names]) for r in got.collect())
    assert found == Counter((d[0], d[1], *brute(d[0], d[1])) for d in DOCS + EXTRA)
    assert {k[3] for k in found} == {"plain", "psm", "spm"}
    back = got.select("text", infill.restored(F.col(names[2]), F.col(names[1])).alias("back"))
    assert back.where("back <> coalesce(text, '') or back is null").count() == 0


def test_empty_table_and_shares(spark):
    assert infill.rearrange(empty(spark)).count() == 0
    rows = infill.rearrange(docs(spark, DOCS + EXTRA), transformed=0)
    assert {r["form"] for r in rows.collect()} == {"plain"}
    rows = infill.rearrange(docs(spark, EXTRA), transformed=100, suffix_first=100)
    assert {r["form"] for r in rows.where("text not rlike '<[PSM]>'").collect()} == {"spm"}


def test_nothing_moves(spark):
    plan = infill.rearrange(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
