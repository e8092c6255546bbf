"""Literal results for parsing, normalization and text keys."""

import pytest
from pyspark.sql import functions as F

from partmill.functions import text as tx
from partmill.functions.titles import with_title_candidates
from partmill.functions.values import approve_fractions, canonical_unit, split_units
from partmill.operators.normalization import Vocabulary, normalize_values


def one(spark, value, fn):
    return fn(spark.createDataFrame([(value,)], "v string")).first()


@pytest.mark.parametrize("raw,value,uom", [
    ('1/2"', "1/2", '"'), ("6pc", "6", "pc"), ("12 inches", "12", "inches"), ("10 - V", "10", "V"), ("in.", None, "in."),
    ("Built-in", "Built-in", None), ("Class A", "Class A", None), ("120 dB(A)", "120", "dB(A)"), (" ", None, None), (None, None, None)])
def test_split(spark, raw, value, uom):
    row = one(spark, raw, lambda d: split_units(d, "v", "value", "uom"))
    assert (row.value, row.uom) == (value, uom)


def test_split_by_separator(spark):
    row = one(spark, "Class A", lambda d: split_units(d, "v", "value", "uom", require_digit=False))
    assert (row.value, row.uom) == ("Class", "A")


@pytest.mark.parametrize("raw,value,method", [
    ("24.25", "24-1/4", "FRACTION"), ("0.5", "1/2", "FRACTION"), ("18", "18", None), ("18.0", "18", None), ("1 1/2", "1-1/2", "FRACTION"),
    ("46/64", "46/64", "FRACTION"), ("0.71875", "23/32", "FRACTION"), ("-0.5", "-1/2", "FRACTION"), ("nan", "nan", None),
    ("inf", "inf", None), ("abc", "abc", None), ("0.3", "0.3", None), ("2.0004", "2.0004", None)])
def test_fraction(spark, raw, value, method):
    row = one(spark, raw, lambda d: approve_fractions(d, "v", "value", "method"))
    assert (row.value, row.method) == (value, method)


def test_fraction_reduction_option(spark):
    row = one(spark, "3-46/64", lambda d: approve_fractions(d, "v", "value", "method", reduce_existing=True))
    assert row.value == "3-23/32"


def test_title(spark):
    row = one(spark, 'DCB518ASTS06G Diablo 1/2"x18" - Sanding Belt 6pc', lambda d: with_title_candidates(d, "v", "c"))
    got = {c.label: (c.value, c.uom, c.evidence_text) for c in row.c}
    assert got == {"Width": ("1/2", '"', '1/2"x18"'), "Length": ("18", '"', '1/2"x18"'), "Quantity": ("6pc", None, "6pc")}


@pytest.mark.parametrize("text,width,length,shown", [
    ("Belt 1 1/2 in. x 18 inches wide", ("1-1/2", "in."), ("18", "inches"), "1 1/2 in. x 18 inches"), ("3 / 4\" × 2.5", ("3/4", '"'), ("2.5", '"'), "3 / 4\" × 2.5"),
    ("1.25.5 in X 7 in", ("25.5", "in"), ("7", "in"), "25.5 in X 7 in"), ("4inx6 1/2in", ("4", "in"), ("6-1/2", "in"), "4inx6 1/2in"), ("5 x 6 in", None, None, None),
    ("2 in x wide 3 in x 4", ("3", "in"), ("4", "in"), "3 in x 4"), ("12 pins x 3", None, None, None)])
def test_sizes(spark, text, width, length, shown):
    found = {c.label: c for c in one(spark, text, lambda d: with_title_candidates(d, "v", "c")).c}
    assert (found.get("Width") and (found["Width"].value, found["Width"].uom)) == width
    assert (found.get("Length") and (found["Length"].value, found["Length"].uom)) == length
    assert (found.get("Width") and found["Width"].evidence_text) == shown


@pytest.mark.parametrize("text,pack", [("6 Pieces of", "6Pieces"), ("6pcs", "6pcs"), ("6pc2", None), ("6 packed", None), ("box of 3, 12 EA.", "12EA")])
def test_packs(spark, text, pack):
    assert next((c.value for c in one(spark, text, lambda d: with_title_candidates(d, "v", "c")).c if c.label == "Quantity"), None) == pack


@pytest.mark.parametrize("text,grit", [("50/80/120-Grit Multi-Grade", "50/80/120"), ("80 grit disc", "80"), ("gritty 80", None), ("a60 grit", None), ("60 / 80 - GRIT", "60/80"),
                                        ("36 grit, 60/80 grit", "60/80"), ("40/50/60/80/100/120 grit", "50/60/80/100/120"), ("60grits", None)])
def test_grit(spark, text, grit):
    row = one(spark, text, lambda d: with_title_candidates(d, "v", "c"))
    assert next((c.value for c in row.c if c.label == "Grit"), None) == grit


@pytest.mark.parametrize("name", ["Freud Inc (2435)", "FREUD INC", "Freud, Inc.", "Freud Incorporated", " freud  inc ", "Freud Inc."])
def test_entity_name(spark, name):
    assert one(spark, name, lambda d: d.select(tx.fold_entity_name(F.col("v")).alias("k"))).k == "freud inc"


@pytest.mark.parametrize("name,key", [("Müller & Söhne", "mu ller and so hne"), ("ﬁlter®", "filter"), (None, "")])
def test_entity_name_unicode(spark, name, key):
    assert one(spark, name, lambda d: d.select(tx.fold_entity_name(F.col("v")).alias("k"))).k == key


@pytest.mark.parametrize("raw,key", [("Cut‑Off  Discs", "cut off discs"), ("​Steel ", "steel"), ("ＡＢＣ", "abc")])
def test_lov_key(spark, raw, key):
    assert one(spark, raw, lambda d: d.select(tx.lov_key(F.col("v")).alias("k"))).k == key


@pytest.mark.parametrize("raw,shown", [("SandingBelt", "Sanding Belt"), ("LEDLamp_x-y", "LED Lamp x y"), (" ", None)])
def test_display(spark, raw, shown):
    assert one(spark, raw, lambda d: d.select(tx.display_text(F.col("v")).alias("k"))).k == shown


@pytest.mark.parametrize("raw,code", [('"', "in"), ("PCS", "EA"), (" v ", "V"), ("kg", None)])
def test_unit(spark, raw, code):
    assert one(spark, raw, lambda d: d.select(canonical_unit(F.col("v")).alias("k"))).k == code


@pytest.fixture(scope="module")
def vocab(spark):
    lov = spark.createDataFrame([("Abrasive Material", 0, "Aluminum Oxide", ["aluminum oxide blend"]), ("Abrasive Material", 1, "Ceramic", []),
                                 ("Material", 0, "Aluminum Oxide", []), ("Material", 1, "Ceramic", [])],
                                "label string, position int, canonical string, aliases array<string>")
    tax = spark.createDataFrame([(0, "A", "B", "Cut-Off Discs", "Tools>Cut-Off Discs", ["Metal Cut Off Wheel"])],
                                "node int, department string, class_name string, fine string, classpath string, aliases array<string>")
    filed = spark.createDataFrame([(0, "Material", "aluminum oxide grain", "Aluminum Oxide"), (1, "Material", "ceramic blend", "Ceramic"),
                                   (2, "Product Type", "masonry cut off wheel", "Cut-Off Discs"), (3, "Material", "steel wool", "Steel")],
                                  "position int, label string, raw_value string, canonical string")
    return Vocabulary.build(lov, tax, filed)


@pytest.mark.parametrize("label,value,classpath,expected,lov", [
    ("Abrasive Material", "aluminum oxide blend", None, "Aluminum Oxide", True), ("Material", "aluminum oxide", None, "Aluminum Oxide", True),
    ("Material", "aluminum oxide blend", None, "Aluminum Oxide", True), ("Abrasive Material", "Aluminum-Oxide Grain", None, "Aluminum Oxide", True),
    ("Product Type", "metal cut off wheel", "Tools>Cut-Off Discs", "Cut-Off Discs", True),
    ("product type", "Masonry Cut Off Wheel", " Tools>Cut-Off Discs ", "Cut-Off Discs", True),
    ("Product Type", "Type 1", "Tools>Cut-Off Discs", "Type 1", False), ("Product Type", "Metal Cut Off Wheel", "Elsewhere", "Metal Cut Off Wheel", False),
    ("Material", "steel wool", None, "steel wool", False), ("Colour", "dark  red", None, "dark red", False)])
def test_normalized_lov(spark, vocab, label, value, classpath, expected, lov):
    df = spark.createDataFrame([(label, value, None, classpath)], "label string, value string, uom string, classpath string")
    row = normalize_values(df, vocab).first()
    assert row.normalized_value == expected
    assert ("LOV" in (row.method or "")) == lov


def test_normalized_units(spark):
    df = spark.createDataFrame([("Width", '1/2"', None, None), ("Quantity", "6pc", None, None), ("Width", "0.5", "inches", None),
                                ("Width", "7", "in", None), ("Width", None, "inch", None)],
                               "label string, value string, uom string, classpath string")
    got = [(r.normalized_value, r.normalized_uom, r.method) for r in normalize_values(df, None).collect()]
    assert got == [("1/2", "in", "VALUE_UOM_SPLIT+FRACTION+UOM_STANDARD"), ("6", "EA", "VALUE_UOM_SPLIT+UOM_STANDARD"),
                   ("1/2", "in", "FRACTION+UOM_STANDARD"), ("7", "in", None), (None, "in", None)]


def test_length_only_fractions(spark):
    df = spark.createDataFrame([("Volts", "1.5", "V", None), ("Width", "1.5", "in", None)],
                               "label string, value string, uom string, classpath string")
    assert [r.normalized_value for r in normalize_values(df, None, length_only=True).collect()] == ["1.5", "1-1/2"]


@pytest.mark.parametrize("value,text,ok", [
    ("1/2 in", 'Belt 1/2"x18"', True), ("DCB-518", "dcb518asts", True), ("x", "abc", False), ("", "abc", False), ("sander", "Sanding belt", False)])
def test_grounding(spark, value, text, ok):
    df = spark.createDataFrame([(value, text)], "v string, t string")
    assert df.select(tx.appears_in(F.col("v"), F.col("t")).alias("k")).first().k == ok
