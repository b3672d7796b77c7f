"""Dataset registry: audit specs + loaders.

Two kinds of entries: the driver fixtures (frames built from the parquet
tables) and the seven public tabular audits the reference runs, described by
their CSV layout and cleaning rules so a user holding those files can audit
them with ``load(spark, name, path)``. Unknown names raise; ``audit_all``
records such failures as rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import prep as px
from ..operators.dist import numbered
from ..sources.tables import CsvScan, scan_csv
from ..session import cut_lineage
from ..spec import AuditSpec
from . import frames


Scan = Callable[..., CsvScan]


def _schema(spec: str) -> T.StructType:
    """'name type, ...' with int / string / double types (no JVM needed)."""
    kinds = {"int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in
                         (part.strip().split() for part in spec.split(","))])


# ---------------------------------------------------------------------------
# CSV layouts of the public audit tables
# ---------------------------------------------------------------------------
ADULT_SCHEMA = _schema(
    "age int, workclass string, fnlwgt int, education string, education_num int, "
    "marital_status string, occupation string, relationship string, race string, sex string, "
    "capital_gain int, capital_loss int, hours_per_week int, native_country string, income string")
COMPAS_KEEP = ["sex", "age", "race", "priors_count", "c_charge_degree", "two_year_recid",
               "juv_fel_count", "juv_misd_count", "juv_other_count"]
DIABETES_DROP = ["weight", "payer_code", "medical_specialty"]
DIABETES_KEEP = ["race", "gender", "age", "admission_type_id", "time_in_hospital",
                 "num_lab_procedures", "num_procedures", "num_medications", "number_outpatient",
                 "number_emergency", "number_inpatient", "number_diagnoses", "max_glu_serum",
                 "A1Cresult", "insulin", "change", "diabetesMed", "readmitted"]
TITANIC_KEEP = ["pclass", "sex", "age", "sibsp", "parch", "fare", "embarked", "survived"]


def _with_id(df: DataFrame) -> DataFrame:
    """``df`` with a unique ``row_id`` by content: the place of a row in the order of a 128-bit hash of
    all its columns, equal rows one after the other. The same rows get the same ids however the files
    are split or ordered. Equal rows are counted, not gathered."""
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    rows = rows.withColumns({"__h": F.xxhash64(*df.columns), "__g": F.xxhash64(F.lit(1), *df.columns)})
    return cut_lineage(numbered(rows, ["__h", "__g", "__copy"], "row_id").select(*df.columns, "row_id"), "identified")


def load_adult(spark: SparkSession, path: str, scan: Scan = scan_csv) -> tuple[DataFrame, AuditSpec]:
    """Header-less CSV(s) (train and test; test lines start with '|1x3' and
    labels end in '.'), leading spaces skipped; '?' stays a category."""
    df = scan(spark, path, ADULT_SCHEMA, header=False, skip_leading_space=True, comment="|").rows
    df = px.drop_missing(df)
    df = df.withColumn("income", px.label_from("income", "eq", ">50K", strip_chars="."))
    return _with_id(df), AuditSpec("UCI Adult", "income", ["sex", "race"])


def load_compas(spark: SparkSession, path: str, scan: Scan = scan_csv) -> tuple[DataFrame, AuditSpec]:
    df = px.drop_missing(px.keep_columns(scan(spark, path).rows, COMPAS_KEEP))
    return _with_id(df), AuditSpec("COMPAS", "two_year_recid", ["sex", "race"])


def load_diabetes(spark: SparkSession, path: str, scan: Scan = scan_csv) -> tuple[DataFrame, AuditSpec]:
    df = scan(spark, path, null_tokens=["?", "None"]).rows
    df = px.keep_columns(px.drop_columns(df, DIABETES_DROP), DIABETES_KEEP)
    df = df.withColumn("readmitted", px.label_from("readmitted", "ne", "NO"))
    num, cat = px.split_kinds(df, [c for c in df.columns if c != "readmitted"])
    df, _ = px.impute(df, num, cat)
    return _with_id(df), AuditSpec("Diabetes 130-US", "readmitted", ["race", "gender"])


def load_meps(spark: SparkSession, path: str, scan: Scan = scan_csv) -> tuple[DataFrame, AuditSpec]:
    return _with_id(scan(spark, path).rows), AuditSpec("MEPS", "high_utilizer", ["race", "sex"])


def load_student(spark: SparkSession, path: str, scan: Scan = scan_csv) -> tuple[DataFrame, AuditSpec]:
    df = scan(spark, path, sep=";").rows
    df = px.drop_columns(df.withColumn("pass", px.label_from("G3", "ge", 10)), ["G3"])
    return _with_id(df), AuditSpec("Student Performance", "pass", ["sex", "age"])


def load_titanic(spark: SparkSession, path: str, scan: Scan = scan_csv) -> tuple[DataFrame, AuditSpec]:
    df = px.normalise_names(scan(spark, path).rows, {"gender": "sex"})
    df = px.keep_columns(df, TITANIC_KEEP)
    num = [c for c in ("age", "fare") if c in df.columns]
    cat = [c for c in ("embarked",) if c in df.columns]
    df, _ = px.impute(df, num, cat)
    return _with_id(df), AuditSpec("Titanic", "survived", ["sex", "pclass"])


def load_civil(spark: SparkSession, path: str, scan: Scan = scan_csv) -> tuple[DataFrame, AuditSpec]:
    return _with_id(scan(spark, path).rows), AuditSpec("CivilComments", "toxic", ["gender", "race"])


CSV_LOADERS: dict[str, Callable[..., tuple[DataFrame, AuditSpec]]] = {
    "UCI Adult": load_adult, "COMPAS": load_compas, "Diabetes 130-US": load_diabetes,
    "MEPS": load_meps, "Student Performance": load_student, "Titanic": load_titanic,
    "CivilComments": load_civil,
}


# ---------------------------------------------------------------------------
# Fixture loaders (driver tables)
# ---------------------------------------------------------------------------
def fixture_loaders(sf_dir: str) -> dict[str, Callable[[SparkSession], tuple[DataFrame, AuditSpec]]]:
    feats_c = frames.NUMERIC_C + frames.CATEGORICAL_C

    def orders_tab(spark):
        return frames.orders_tab(spark, sf_dir), AuditSpec("orders_tab", "y", frames.SENSITIVE_C,
                                                           features=feats_c)

    def dirty(spark):
        return frames.dirty_tab(spark, sf_dir), AuditSpec("dirty", "y", frames.SENSITIVE_C,
                                                          features=feats_c, null_tokens=["?"])

    def documents(spark):
        d = frames.documents_frame(spark, sf_dir).select(
            F.col("doc_id").alias("row_id"), "y", "n_chars", "lang", "source")
        return d, AuditSpec("documents", "y", frames.SENSITIVE_B, features=["n_chars", "lang", "source"])

    def vectors(spark):
        v = frames.vectors(spark, sf_dir).withColumnRenamed("s_parity", "parity")
        feats = ["parity"] + [f"f{i:02d}" for i in range(64)]
        return v, AuditSpec("vectors", "y", ["parity"], features=feats, categorical=["parity"])

    return {"orders_tab": orders_tab, "dirty": dirty, "documents": documents, "vectors": vectors}


def load(spark: SparkSession, name: str, path: str | None = None, rejects: list[DataFrame] | None = None
         ) -> tuple[DataFrame, AuditSpec]:
    """A registered table by name: CSV audits need ``path``; fixtures take the sf folder. The rejects of
    CSV scans (broken lines, cells not of their column's type) are appended to ``rejects``."""
    def scan(*args, **options) -> CsvScan:  # noqa: ANN002, ANN003
        got = scan_csv(*args, **options)
        if rejects is not None:
            rejects.append(got.rejects)
        return got
    if name in CSV_LOADERS:
        if path is None:
            raise ValueError(f"{name} needs the path of its CSV file(s)")
        return CSV_LOADERS[name](spark, path, scan)
    fx = fixture_loaders(path or "/root/testdata/sf0.01")
    if name in fx:
        return fx[name](spark)
    raise KeyError(f"unknown dataset {name!r}")
