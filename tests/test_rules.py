"""Rule engine: golden rows for the traps, invariants, and the plan."""

import pytest
from pyspark.sql import functions as F

from packwise.operators import compliance as c
from packwise.sources.rules import compile_rules, load_rules

GOOD = {
    "manufacturer": "Acme Foods, Plot 4, Pune", "generic_name": "Biscuits", "net_quantity": "200 g",
    "mrp": "MRP Rs. 20 incl. of all taxes", "consumer_care": "care@acme.in 9876543210",
}


def score(spark, rows, rules=None):
    names = ["n"] + sorted({k for r in rows for k in r})
    ddl = ", ".join(
        f"{n} " + ("int" if n == "n" else "boolean" if n.startswith(("is_", "mrp_", "has_"))
                   else "double" if n.startswith(("pdp", "est")) else
                   "map<string,double>" if n == "ocr_confidence" else "string") for n in names)
    data = [tuple([i] + [r.get(k) for k in names[1:]]) for i, r in enumerate(rows)]
    out = c.check(spark.createDataFrame(data, ddl), rules or load_rules(spark))
    return out.orderBy("n").collect()


def ids(row):
    return [v["rule_id"] for v in row["violations"]]


def test_clean_label_and_unknown_type(spark):
    clean, odd = score(spark, [GOOD, {**GOOD, "product_type": "Toys"}])
    assert (clean["score"], clean["is_compliant"], clean["layers_applied"]) == (
        100.0, True, ["universal", "category:general"])
    assert odd["layers_applied"][1] == "category:toys" and odd["score"] == 100.0
    assert clean["summary"] == "Package appears COMPLIANT under general rules (Score: 100/100)."


def test_base_fields_exemptions_and_repeated_origin(spark):
    seeds, wholesale, imported = score(spark, [
        {**GOOD, "consumer_care": None, "product_type": "seed"},
        {"manufacturer": GOOD["manufacturer"], "generic_name": "x", "net_quantity": "1 kg",
         "product_type": "wholesale"},
        {**GOOD, "product_type": "imported", "is_imported": True},
    ])
    assert ids(seeds) == ["PRESENCE_CONSUMER_CARE"]
    assert ids(wholesale) == []
    assert ids(imported) == [
        "PRESENCE_COUNTRY_OF_ORIGIN", "PRESENCE_COUNTRY_OF_ORIGIN", "IMP_001", "COO_001"]
    assert imported["score"] == 40.0 and imported["missing_fields"] == ["country_of_origin"]
    assert imported["violations"][1]["legal_reference"] is None


def test_product_layer_weights_and_mrp_wording(spark):
    sun, wording, blank = score(spark, [
        {**GOOD, "product_type": "cosmetic", "specific_product": "Sunscreen"},
        {**GOOD, "mrp": None, "mrp_declaration_detected": True},
        {**GOOD, "mrp": "  "},
    ])
    assert ids(sun) == ["PROD_MANDATORY_BEST_BEFORE"] and sun["score"] == 96.0
    assert ids(wording) == ["MRP_VALUE_VERIFICATION"] and wording["is_compliant"]
    assert ids(blank) == ["PRESENCE_MRP", "MRP_001", "MRP_002", "MRP_003"]


def test_formats(spark):
    rows = score(spark, [
        {**GOOD, "net_quantity": "500 mg"}, {**GOOD, "net_quantity": "0 g"},
        {**GOOD, "best_before": "24 months"}, {**GOOD, "best_before": "Twenty-four months from packing"},
        {**GOOD, "mfg_date": "05 March 2026"}, {**GOOD, "unit_sale_price": "Rs 2"},
        {**GOOD, "unit_sale_price": "Rs 2", "is_multi_piece": True},
        {**GOOD, "pdp_area_cm2": 50.0, "estimated_font_height_mm": 1.25},
        {**GOOD, "consumer_care": "१२३१२३१२३१"},
        {**GOOD, "generic_name": " "},
    ])
    assert [ids(r) for r in rows] == [
        [], ["QTY_002"], ["DATE_BEST_BEFORE"], [], [], ["USP_001"], [], ["FONT_001"],
        ["CARE_001"], ["PRESENCE_GENERIC_NAME"]]
    font = rows[7]["violations"][0]
    assert font["message"] == (
        "Font height (1.2 mm) is below the minimum required (1.5 mm) for PDP area of 50 cm²")


def test_review_flag_and_severity_check(spark):
    low, fine = score(spark, [
        {**GOOD, "ocr_confidence": {"mrp": 0.49}}, {**GOOD, "ocr_confidence": {"mfg_date": 0.1}}])
    assert low["needs_manual_review"] and not fine["needs_manual_review"]
    with pytest.raises(ValueError):
        compile_rules(spark, {"general": {"mandatory": {"mrp": {"severity": "fatal"}}}}, {})


def test_custom_conditions(spark):
    rules = compile_rules(spark, {"general": {"custom_checks": [
        {"rule_id": "C", "field": "mrp", "expected_contains": "TAXES", "severity": "low"},
        {"rule_id": "A", "field": "net_quantity", "expected_any": ["kg", "ml"]},
        {"rule_id": "N", "field": "use_by", "must_not_exist": True, "severity": "info"},
        {"rule_id": "B", "field": "is_imported", "must_exist": True},
        {"rule_id": "ADVICE", "field": "mrp"},
    ]}}, {"p": {"exempted": ["consumer_care"], "extra_mandatory": [{"field": "is_imported"}]}})
    row = score(spark, [{**GOOD, "mrp": "Rs. 20", "use_by": "Jan 2027", "consumer_care": None,
                         "mrp_inclusive_of_taxes": True, "specific_product": "p"}], rules)[0]
    # A false flag is text for a custom check but missing for a product's mandatory field.
    assert ids(row) == ["C", "A", "N", "PROD_MANDATORY_IS_IMPORTED"]


def test_scoring_moves_no_label_rows(spark):
    text = F.col("id").cast("string")
    df = spark.range(10).withColumns({"product_type": text, "specific_product": text})
    plan = c.check(df, load_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_yaml_rule_folder(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "categories").mkdir()
    (tmp_path / "categories" / "snack.yaml").write_text(
        "mandatory:\n  dimensions: {severity: low, label: Size}\nexempted: [mrp]\n")
    (tmp_path / "general.yaml").write_text("exempted: []\n")
    rules = load_rules(spark, str(tmp_path))
    assert rules.category_names == ("snack", "general")
    row = score(spark, [{**GOOD, "mrp": None, "product_type": "snack"}], rules)[0]
    assert ids(row) == ["PRESENCE_DIMENSIONS"] and row["score"] == 97.0


def test_empty_rules_apply_nothing(spark):
    """An empty file is a known type or product without rules: no layer, no check."""
    rules = compile_rules(spark, {"general": {"product_type": "general", "mandatory": {"mrp": {}}}, "food": {}}, {"milk": {}})
    bare, other = score(spark, [
        {"product_type": "food", "specific_product": "milk"}, {"product_type": "toys", "specific_product": "tea"}], rules)
    assert bare["layers_applied"] == ["universal"] and not any(i.startswith("PRESENCE") for i in ids(bare))
    assert other["layers_applied"] == ["universal", "category:toys"] and "PRESENCE_MRP" in ids(other)


def test_zero_of_another_script_is_zero(spark):
    arabic, latin = score(spark, [{**GOOD, "net_quantity": "٠ g"}, {**GOOD, "net_quantity": "0 g"}])
    assert "QTY_002" in ids(latin) and "QTY_002" in ids(arabic)


def test_too_large_rules_are_refused(spark, monkeypatch):
    from packwise.sources import rules as module
    monkeypatch.setattr(module, "RULE_BYTES", 10)
    with pytest.raises(ValueError, match="rules take"):
        load_rules(spark)


def test_checks_by_value_give_the_same_rows(spark):
    values = {"mrp": ["Rs 20", "20", None, "", "MRP Rs. 5 incl. of all taxes", "x"], "net_quantity": ["0 g", "5 kg", "g", None],
              "mfg_date": ["soon", " 01/2026 ", " ", None], "consumer_care": ["a@b.co", "9876543210", None],
              "manufacturer": ["ACME", " ", "ACME Foods, Plot 4"], "unit_sale_price": ["Rs 2", "Rs 2 per g", None],
              "best_before": ["24 months from mfd", "x"], "use_by": [None, "Jan 2027"]}
    labels = [{**GOOD, **{f: vs[(i * k) % len(vs)] for k, (f, vs) in enumerate(values.items(), 1)}} for i in range(120)]
    schema = "id int, " + ", ".join(f"{f} string" for f in sorted({*GOOD, *values}))
    rows = [(i, *[x.get(f) if isinstance(x.get(f), (str, type(None))) else str(x[f]) for f in sorted({*GOOD, *values})])
            for i, x in enumerate(labels)]
    df, rules = spark.createDataFrame(rows, schema), load_rules(spark)
    plain = c.check(df, rules)
    for fields in (("mrp",), tuple(c.FACTS)):
        other = c.check(df, rules, fields)
        assert other.columns == plain.columns
        assert sorted(map(str, other.collect())) == sorted(map(str, plain.collect()))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (plain, c.check(df, rules, tuple(c.FACTS)))]
    assert [(c.EMAIL in p, c.SHELF_LIFE in p, "incl\\." in p) for p in plans] == [(True,) * 3, (False,) * 3]
    with pytest.raises(ValueError, match="brand"):
        c.check(df, rules, ("brand",))
    assert c.check(df.limit(0), rules, ("mrp",)).count() == 0
