from pyspark.sql import functions as F

from mailsieve.functions import domains as H
from mailsieve.functions import lookalikes as L


def brute(rows, legit):
    out = {}
    for key, ds in rows:
        n = 0
        for d in ds or []:
            for name in legit:
                if d is not None and name is not None and name.split(".")[0] in d and d != name:
                    n += 1
        out[key] = out.get(key, 0) + n
    return out


ROWS = [
    (1, ["thethan.com", "paypa1.com", "thethan.com", None]), (2, []), (3, None), (4, ["a.org"]),
    (5, ["example.com", "example-login.com", "xample.com"]), (6, ["ab.cd", "abc.org"]), (4, ["zz.org"]),
]
LEGIT = ["than.com", "thethan.com", "example.com", "example.com", "a.net", "ab.cd", "c.org", ".com", ".com", "zz.org", None, "qqqq.com"]


def test_against_brute_force(spark):
    rows = spark.createDataFrame(ROWS, "k long, ds array<string>")
    legit = spark.createDataFrame([(x,) for x in LEGIT], "legit string")
    got = {r.k: r.lookalikes for r in L.row_lookalikes(rows, "k", "ds", legit, q=3).collect()}
    assert got == brute(ROWS, LEGIT)


def test_equals_the_row_function_for_a_short_list(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    domains = pages.select("page_id", F.transform(F.array("url"), lambda u: H.registered_domain(u)).alias("ds"))
    short = ["example.com", "example.org", "net.example", "th.com", "t.org"]
    legit = spark.createDataFrame([(x,) for x in short], "legit string")
    got = {r.page_id: r.lookalikes for r in L.row_lookalikes(domains, "page_id", "ds", legit).collect()}
    want = {r.page_id: r.n for r in domains.select("page_id", H.lookalike_count(F.col("ds"), short).alias("n")).collect()}
    assert got == want


def test_plan_has_no_nested_loop(spark):
    rows = spark.createDataFrame(ROWS, "k long, ds array<string>")
    legit = spark.createDataFrame([(x,) for x in LEGIT], "legit string")
    plan = L.row_lookalikes(rows, "k", "ds", legit)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
