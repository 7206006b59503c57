"""Merges and renames with every conflict."""

import pytest

from titerloom.operators import registry as R


@pytest.fixture(scope="module")
def tables(spark):
    f = spark.createDataFrame
    return R.Tables(
        types=f([(1, "Ferritin", "ferritin", "ug/l"), (2, "Ferritin serum", "ferritin serum", None), (3, "Iron", "iron", None), (4, "Zinc", "zinc", None)], "type_id long, name string, key string, unit string"),
        aliases=f([("ferritin", "Ferritin", 1), ("ferritin serum", "Ferritin serum", 2), ("iron", "Iron", 3), ("fe", "Fe", 3), ("zinc", "Zinc", 4)], "alias_key string, alias_name string, type_id long"),
        rows=f([(10, 1, 100), (11, 2, 101), (12, 3, 101), (13, None, 102)], "id long, type_id long, file_id long"),
        tags=f([(1, "blood"), (2, "blood"), (2, "old"), (3, "old")], "type_id long, tag string"),
        insights=f([(1, "one"), (2, "two"), (3, "three")], "type_id long, text string"),
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge(spark, tables):
    asked = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 9, 1), (4, 4, 4), (5, 2, 3), (6, 4, 2)], "n long, source long, target long")
    out, results = R.merge(tables, asked)
    assert rows(results.select("n", "code", "reason")) == [(1, 200, "merged"), (2, 200, "merged"), (3, 404, "marker not found"), (4, 200, "nothing to do"), (5, 409, "source is merged twice"), (6, 409, "target is merged itself")]
    assert rows(out.types.select("type_id")) == [(1,), (4,)] and rows(out.rows.select("id", "type_id")) == [(10, 1), (11, 1), (12, 1), (13, None)]
    assert rows(out.tags) == [(1, "blood"), (1, "old")] and rows(out.insights) == [(1, "one")] and {r["type_id"] for r in out.aliases.collect()} == {1, 4}
    assert R.broken_keys(out).count() == 0
    out, _ = R.merge(tables, spark.createDataFrame([(1, 3, 4), (2, 2, 4)], "n long, source long, target long"))
    assert rows(out.insights) == [(1, "one"), (4, "three")] and rows(out.tags) == [(1, "blood"), (4, "blood"), (4, "old")]


def test_rename(spark, tables):
    asked = spark.createDataFrame([(1, "Fe", "Iron total"), (2, "Zinc", "FERRITIN"), (3, "none", "x"), (4, "Ferritin", None), (5, "Ferritin", "Ferritin"), (6, "Zinc", "Iron total"), (7, "Iron", "Eisen"), (8, "zinc", "fe")], "n long, name string, new_name string")
    out, results, again = R.rename(tables, asked)
    assert rows(results.select("n", "code", "reason")) == [
        (1, 200, "renamed"), (2, 409, "name exists"), (3, 404, "marker not found"), (4, 400, "name is required"), (5, 200, "nothing to do"), (6, 409, "name exists"), (7, 409, "marker is renamed already"), (8, 409, "name exists"),
    ]
    assert {r["type_id"]: (r["name"], r["key"]) for r in out.types.collect()}[3] == ("Iron total", "iron total")
    assert {(r["alias_key"], r["alias_name"], r["type_id"]) for r in out.aliases.collect()} >= {("iron", "Iron", 3), ("iron total", "Iron total", 3), ("fe", "Fe", 3)}
    assert rows(out.insights) == [(1, "one"), (2, "two")] and rows(again) == [(101,)] and R.broken_keys(out).count() == 0


def test_guides_do_not_pair_all_rules(spark):
    """A pair of units with n rules gives n * 3 rows, by no join of n * n; ties and a type with most rules are right."""
    import random

    from pyspark.sql import functions as F

    from titerloom.operators import rules

    r = random.Random(2)
    rows = [(i, r.choice((1, 1, 1, 2, 3, 4, 5, 6, 7)), r.choice("ab"), "u", r.choice((None, 1.0, 2.0))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, type_id long, original_key string, canonical_key string, factor double")
    got = {(x["type_id"], x["original_key"], x["rn"]): (x["rule_id"], x["guide_type"]) for x in rules.guide_rules(df, df).collect()}
    want = {}
    for t, k in {(x[1], x[2]) for x in rows}:
        for n, x in enumerate([x for x in rows if x[2] == k and x[1] != t and x[4] is not None][:3]):
            want[(t, k, n + 1)] = (x[0], x[1])
    assert got == want
    joined = rules.guide_rules(df, df)._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("Join") == 1 and joined.index("posexplode") < joined.index("Join")
    assert rules.guide_rules(df, df.where(F.lit(False))).isEmpty()
