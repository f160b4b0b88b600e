"""Reference normalisation (B5) and label helpers — the parsing cases."""
from pyspark.sql import functions as F

from lineaweave.functions import refs as R

CASES = [
    # (full_name, path, type) -> (id, type); one case for each branch
    (("lake.raw.clicks", None, "FOREIGN"), ("lake.raw.clicks", "FOREIGN")),               # a name keeps its type
    (("lake.raw.clicks", None, None), ("lake.raw.clicks", "TABLE")),                      # or is a table
    (("lake.raw.clicks", "gs://elsewhere/x", "VIEW"), ("lake.raw.clicks", "VIEW")),       # a name goes before a path
    ((None, "/Volumes/lake/raw/drop/2024/01/part.csv", "TABLE"), ("lake.raw.drop", "VOLUME")),
    ((None, "/Volumes/lake/raw/drop", None), ("lake.raw.drop", "VOLUME")),                # the volume itself
    ((None, "dbfs:/Volumes/lake/raw/drop/x", None), ("lake.raw.drop", "VOLUME")),         # with the scheme in front
    ((None, "/Volumes/lake/raw", None), ("volume:/Volumes/lake/raw", "VOLUME")),          # too short for a volume
    ((None, "gs://landing-zone/a/b?c=1", None), ("path:gs://landing-zone", "PATH")),      # a store: its bucket only
    ((None, "abfss://box@acct.example.net/a", None), ("path:abfss://box@acct.example.net", "PATH")),
    ((None, "/mnt/old/export", None), ("path:/mnt/old/export", "PATH")),                  # any other path as it is
    ((None, None, "TABLE"), (None, None)),
]


def _norm(spark, rows):
    df = spark.createDataFrame(rows, "name string, path string, type string")
    i, t = R.normalize_ref("name", "path", "type")
    return [(r[0], r[1]) for r in df.select(i, t).collect()]


def test_normalize_cases(spark):
    got = _norm(spark, [c[0] for c in CASES])
    assert got == [c[1] for c in CASES]


def test_generic_path_stays_whole(spark):
    long_path = "/mnt/" + "/".join(f"level{i}" for i in range(60))
    (i, t), = _norm(spark, [(None, long_path, None)])
    assert t == "PATH" and i == "path:" + long_path


def test_empty_strings_are_missing(spark):
    assert _norm(spark, [("", "", "")]) == [(None, None)]
    assert _norm(spark, [("c.s.t", None, "")]) == [("c.s.t", "TABLE")]


def test_labels_and_fqdn(spark):
    df = spark.createDataFrame([("c.s.t", "TABLE"), ("path:s3://b1", "PATH"), ("a.b", "VIEW")], "id string, t string")
    cat, sch, name = R.split_fqdn("id")
    out = df.select(R.node_label("id", "t"), cat, sch, name, R.stub_comment("id", "t")).collect()
    assert tuple(out[0]) == ("t", "c", "s", "t", "Cross-schema reference from c.s")
    assert tuple(out[1])[:4] == ("b1", "", "", "") and out[1][4] == "External storage: s3://b1"
    assert tuple(out[2])[:4] == ("b", "", "", "")


def test_type_label(spark):
    df = spark.createDataFrame([("MATERIALIZED_VIEW",), ("PATH",), ("WEIRD",)], "t string")
    label, cross = R.type_label("t")
    assert [tuple(r) for r in df.select(label, cross).collect()] == [
        ("MAT VIEW", False), ("STORAGE", True), ("TABLE", False)]


def test_bulk_rows_compile_to_methods_the_jvm_compiles(spark):
    """HotSpot leaves methods of more than 8,000 bytes to the interpreter."""
    import re

    from lineaweave.operators import graph as G
    names = [*G.ROW_KEY, "source_type", "target_type"]
    plan = G.normalize_rows(spark.range(10).selectExpr(*[f"if(id % 2 = 0, string(id), null) AS {c}" for c in names]))._jdf.queryExecution()
    text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan.executedPlan())
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000
