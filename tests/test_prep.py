from pyspark.sql import functions as F

from equilens.operators import prep as px
from equilens.spec import AuditSpec


def test_mode_tie_and_missing(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("b", None), ("a", None), (None, None)],
                               "c string, d string")
    m = {r["feature"]: r["fill_cat"] for r in px.fit_modes(df, ["c", "d"]).collect()}
    assert m == {"c": "a", "d": "missing"}


def test_median_all_null_is_zero(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert px.fit_medians(df, ["x"]) == {"x": 0.0}


def test_unseen_category_gets_code_zero(spark):
    train = spark.createDataFrame([("b",), ("c",)], "v string")
    enc = px.fit_encoder(train, ["v"])
    test = spark.createDataFrame([(1, "a"), (2, "c")], "id int, v string")
    got = dict(px.encode(test, enc, ["v"]).select("id", "v").collect())
    assert got == {1: 0.0, 2: 1.0}


def test_to_binary_rules(spark):
    s = spark.createDataFrame([("no",), ("yes",)], "v string")
    assert [r[0] for r in px.to_binary(s, "v").orderBy("v").collect()] == [0, 1]
    f = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    assert [r[0] for r in px.to_binary(f, "v", "b").orderBy("v").select("b").collect()] == [0, 1, 1]
    i = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    assert [r[0] for r in px.to_binary(i, "v", "b").orderBy("v").select("b").collect()] == [0, 0, 1]
    z = spark.createDataFrame([(0,), (1,), (1,)], "v int")
    assert [r[0] for r in px.to_binary(z, "v", "b").orderBy("v").select("b").collect()] == [0, 1, 1]


def test_split_quotas_known():
    assert px.split_quotas({0: 10067, 1: 4933}) == {0: (8054, 2013), 1: (3946, 987)}
    assert px.split_quotas({0: 348, 1: 51}) == {0: (278, 70), 1: (41, 10)}


def test_split_disjoint_complete_exact(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(2000)], "row_id long, y int")
    s = px.stratified_split(df, "y", 0.2, 42)
    assert s.count() == 2000 and s.select("row_id").distinct().count() == 2000
    got = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    q = px.split_quotas({0: 1333, 1: 667})
    assert got == {(0, "train"): q[0][0], (0, "test"): q[0][1], (1, "train"): q[1][0], (1, "test"): q[1][1]}


def test_scale_zero_std_and_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    st = px.fit_scaler(df, ["a", "b"])
    out = [tuple(r) for r in px.scale(df, st).collect()]
    assert out == [(-1.0, 0.0), (1.0, 0.0), (0.0, 0.0)]


def test_prepare_shapes(spark):
    rows = [(i, "F" if i % 3 else "O", float(i), "x" if i % 2 else "y", None if i % 5 == 0 else float(i % 7))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, status string, a double, cat string, b double")
    df = df.withColumn("y", (F.col("status") == "F").cast("int")).drop("status")
    spec = AuditSpec(name="t", label="y", sensitive=["cat"], id_col="id")
    out, st = px.prepare(df, spec, 42)
    assert out.columns == ["row_id", "split", "y", "s_cat", "a", "cat", "b"]
    assert out.where("b IS NULL").count() == 0
    assert out.count() == 300
    assert set(st.categorical) == {"cat"} and set(st.numeric) == {"a", "b"}
    prof = {r["split"]: r for r in px.profile(out, st.features).collect()}
    assert prof["train"]["n"] + prof["test"]["n"] == 300 and prof["test"]["n_null"] == 0


def test_prepare_rejects_repeated_ids(spark):
    import pytest
    from equilens.operators import prep
    from equilens.spec import AuditSpec
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 1, 3.0)], "row_id long, y int, x double")
    with pytest.raises(ValueError, match="unique"):
        prep.prepare(df, AuditSpec("t", "y", ["x"]))
