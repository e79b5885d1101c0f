"""The pipeline's stages, each against brute force on its own input."""

import importlib
import os
import sys

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from packwise.llm import langid
from packwise.llm.common import written
from packwise.llm.queries import BYTE_BPE, ORACLES, QUERIES, learnable
from tests.compare import compare, duck
from tests.llm import tables
from tests.llm.test_corpus import brute_components, brute_hits, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kinds = docs.columns, docs.dtypes
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "benchmark_free", "packed"]

    told = written(stages["language"](spark, docs, SF), "t")
    model = langid.Scorer(langid.learn(learnable(docs)))
    assert sorted(r["doc_id"] for r in told.collect()) == sorted(
        r["doc_id"] for r in docs.collect() if (p := model.predict(r["text"]))[0] != "und" and p[1] >= langid.MIN_MARGIN)
    assert told.columns == columns and told.count() > 0.9 * docs.count()

    lined = written(stages["lines"](spark, told, SF), "t")
    wanted = [(r[0], r[3]) for r in brute_lines([tuple(r) for r in told.collect()]) if not r[2] or r[3]]
    assert sorted((r["doc_id"], r["text"]) for r in lined.collect()) == wanted and lined.dtypes == kinds
    assert lined.where("n_chars <> length(text)").count() == 0

    single = written(stages["near_duplicates"](spark, lined, SF), "t")
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(
        {r[2] for r in brute_components([tuple(r) for r in lined.collect()])})

    free = written(stages["benchmark_free"](spark, single, SF), "t")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits([tuple(r) for r in single.collect()], [(str(i), t) for i, t in items])
    assert sorted(r["doc_id"] for r in free.collect()) == sorted(r[0] for r in hits if not r[2])
    assert free.columns == columns

    tokenizer = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    packed = stages["packed"](spark, free, SF).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {
        r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in free.collect()}
    assert corpus_pipeline.run(spark, SF).count() == stages["packed"](spark, free, SF).count()


def test_stages_take_awkward_rows_and_clashing_columns(spark):
    stages = dict(corpus_pipeline.STAGES)
    clash = ("accepted", "score", "lang_pred", "n_dropped", "n_lines", "component_id", "fp", "n_hit", "hits")
    for df in (tables.docs(spark), tables.empty(spark)):
        df = df.selectExpr("*", *[f"'x' AS {c}" for c in clash])
        for name in ("language", "lines", "near_duplicates", "benchmark_free"):
            out = stages[name](spark, df, SF)
            assert out.dtypes == df.dtypes and out.count() <= df.count()
        assert (stages["packed"](spark, df, SF).count() == 0) == (df.count() == 0)
    # Clean rows stay: the lines of doc 5's two rows are repeated, and only those go.
    assert stages["lines"](spark, tables.docs(spark), SF).where("doc_id = 10").first()["n_chars"] > 100_000


def test_twins_of_the_queries(spark):
    for name, sql in ORACLES.items():
        assert compare(spark, duck(SF), QUERIES[name], sql, SF) is None, name


def test_every_number_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n[:2] == "op" and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and "flagship" in names


def test_entry_without_the_subpackage(monkeypatch):
    """The driver deletes the subpackage; the other queries stay."""
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("packwise.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return None

    gone = [m for m in sys.modules if m.startswith("packwise.llm") or m == "corpus_pipeline"]
    for m in gone:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    monkeypatch.delattr(sys.modules["packwise"], "llm", raising=False)
    module = importlib.reload(entry)
    assert "flagship" in module.queries() and "pipeline" not in module.queries()
    assert os.path.exists(module.__file__)
