from pyspark.sql import functions as F

from vitaeloom.llm.canonical import map_values, meant

ENTRIES = [("rl", "record linkage"), ("rl", "Linkwright"), ("la", "least privilege clean-up"), ("dup1", "Brixomat"), ("dup2", "Brixomat"), ("log", "log parsing"), ("price", "discount ladder studies"), ("pt", "point in time lookups")]
MEANT = {
    "RECORD  linkage": {"rl"}, "linkage of record": {"rl"}, "lnkwrght": {"rl"}, "Link Wright tool": {"rl"}, "recrod linkagee basics": {"rl"}, "brixomqt": {"dup1", "dup2"}, "log pars.": {"log"}, "logparsing (3 yrs)": {"log"},
    "dscnt lddr stds": {"price"}, "in time lookups (point)": {"pt"}, "least-privilege-clean-up - expert": {"la"}, "ｌｏｇ parsing": {"log"},
}
NOT = ["organic weaving", "Drelhafinpa Hub", "log keeping", "record shops", "", "  ", "123", "privilege", "legal drafting"]


def test_mapping(spark):
    values = [("t", f"m{i}", v) for i, v in enumerate(MEANT)] + [("t", f"n{i}", v) for i, v in enumerate(NOT)] + [("t", "null", None), ("t", "m0", "RECORD  linkage"), ("t", None, "log parsing")]
    df = spark.createDataFrame(values, "tab string, row_key string, value string").withColumn("target", F.lit("clash"))
    entries = spark.createDataFrame([*ENTRIES, (None, "x"), ("x", None)], "target string, entry string")
    rows = map_values(df, entries).collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r["row_key"], set()).add(r["target"])
    for i, (v, want) in enumerate(MEANT.items()):
        assert got[f"m{i}"] == want, v
    for i, v in enumerate(NOT):
        assert got[f"n{i}"] == {None}, v
    assert got["null"] == {None} and len(rows) == len(MEANT) + 1 + len(NOT) + 1


def test_empty(spark):
    entries = spark.createDataFrame(ENTRIES, "target string, entry string")
    none = spark.createDataFrame([], "tab string, row_key string, value string")
    assert map_values(none, entries).count() == 0
    one = spark.createDataFrame([("t", "1", "log parsing")], "tab string, row_key string, value string")
    assert map_values(one, entries.limit(0)).first()["target"] is None


def test_meaning():
    assert meant("log parsing", "log parsing") == 0 and meant("basic routing", "text routing") is None and meant("mobile hosting", "model hosting") is None
    assert meant("x" * 5000, "log parsing") is None


def test_index_and_join_agree(spark):
    from vitaeloom.llm.canonical import bare, grams, near_entries, spaced

    forms = ["record linkage", "cost tracking", "sql", "pactline", "column pruning", "ab"]
    values = ["recrod linkage", "rcrd lnkg", "basic sql", "patcline", "", "zzz", "columnpruning", "a"]
    w = spark.createDataFrame([(f,) for f in forms], "form string").withColumn("grams", grams(spaced(F.col("form"))))
    a = spark.createDataFrame(list(enumerate(values)), "vid bigint, v string").withColumn("grams", grams(bare(spaced(F.col("v")))))
    got = [{(r["vid"], r["form"]): round(r["score"], 9) for r in near_entries(a, w, len(forms), 0.05, most).collect()} for most in (0, 100)]
    assert got[0] == got[1] and len(got[0]) > 5
