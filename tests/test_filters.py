import pytest
from pyspark.sql import functions as F

from rolecall.operators.favorites import toggled, with_favorites
from rolecall.operators.filters import (
    FilterSpec, Mask, active, any_term, apply_filters, profile_filters, with_filter)
from rolecall.operators.scoring import rank_order_score, with_keywords
from rolecall.operators.sorting import standard_order, top_n, typed_order
from rolecall.plans.rank import rank
from rolecall.sources.profiles import Profile


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame(
        [(1, "Data Engineer (Intern)", True, 3, 1.5), (2, None, None, None, None),
         (3, "KELVIN ſpark", False, 0, 0.0), (4, "İstanbul C++", True, 5, 2.0)],
        "n int, title string, flag boolean, bin int, amount double")


def kept(df, **registry):
    return [r.n for r in apply_filters(df, registry).orderBy("n").collect()]


def test_terms(jobs):
    assert kept(jobs, t=FilterSpec("title", "(INTERN)")) == [1]
    assert kept(jobs, t=FilterSpec("title", ["kelvin"])) == [3]
    assert kept(jobs, t=FilterSpec("title", ["SPARK", "istanbul"])) == [3, 4]
    assert kept(jobs, t=FilterSpec("title", ["", "  "])) == [1, 3, 4]
    assert kept(jobs, t=FilterSpec("title", ["İSTANBUL C"])) == []  # lower-casing adds a dot
    assert kept(jobs, t=FilterSpec("title", ["c++"], invert=True)) == [1, 2, 3]
    assert kept(jobs, t=FilterSpec("title", ["c.+", "eng.*er"], mode="regex")) == [1, 4]


def test_scalars_and_fallbacks(jobs):
    assert kept(jobs, f=FilterSpec("flag", True)) == [1, 4]
    assert kept(jobs, f=FilterSpec("flag", False, invert=True)) == [1, 2, 4]
    assert kept(jobs, f=FilterSpec("bin", [0, 5])) == [3, 4]
    assert kept(jobs, f=FilterSpec("bin", [])) == []
    assert kept(jobs, f=FilterSpec("amount", 2)) == [4]
    assert kept(jobs, f=FilterSpec("title", 5)) == []
    assert kept(jobs, f=FilterSpec("gone", "x")) == []
    assert kept(jobs, f=FilterSpec("gone", "x", invert=True)) == [1, 2, 3, 4]
    assert kept(jobs, f=FilterSpec("title", ["a", 1])) == []
    assert kept(jobs, f=FilterSpec("bin", lambda c: c > 2)) == [1, 4]


def test_filter_and_inverse_cover_all_rows(jobs):
    for spec in (("title", "data"), ("flag", True), ("bin", [3])):
        yes, no = (kept(jobs, f=FilterSpec(*spec, invert=i)) for i in (False, True))
        assert sorted(yes + no) == [1, 2, 3, 4]


def test_registry_and_mask(spark, jobs):
    registry = with_filter({}, "a", FilterSpec("flag", True))
    registry = with_filter(registry, "a", FilterSpec("flag", False))
    assert kept(jobs, **registry) == [3]
    assert with_filter(registry, "a", None) == {}
    mask = spark.createDataFrame([(1, True), (2, False), (9, True)], "n int, ok boolean")
    assert kept(jobs, m=Mask(mask, "n", "ok")) == [1]
    assert kept(jobs, m=Mask(mask, "n", "ok", invert=True)) == [2, 3, 4]


def test_profile_filters():
    assert profile_filters(Profile()) == {}
    chosen = profile_filters(Profile(degree_level="bachelor", work_models=["remote"],
                                     job_types=["contract"], title_exclude_selected=["x"]))
    assert chosen["degree_level"].expression == [0, 1, 3, 7]
    assert chosen["work_models"].expression == [True]
    assert chosen["title_exclude"].invert
    assert "work_models" not in profile_filters(Profile(work_models=["remote", "onsite"]))


def test_keywords_and_rank_scores(spark):
    df = spark.createDataFrame(
        [("C++ dev", "we sell SALES", "TX"), (None, "salesforce", ""), ("x", None, None)],
        "title string, description string, state string")
    terms = {1: [r"c\+\+", "d.v"], 0: [r"\bsales\b"], -1: ["sales", "Foo|FORCE"]}
    rows = with_keywords(df, terms).collect()
    assert [(r.keyword_score, r.keywords) for r in rows] == [
        (1, ["c++", "d.v", "bsalesb", "sales"]), (-2, ["sales", "Foo|FORCE"]), (0, [])]
    scores = df.select(rank_order_score(F.col("state"), ["CA", "TX"]).alias("s")).collect()
    assert [r.s for r in scores] == [1, -1, 0]


def test_order_and_favorites(spark):
    rows = [(f"p{i}", "Data Engineer", "BS required", "Austin, TX", f"2024-01-0{1 + i % 3}", "indeed", False)
            for i in range(6)]
    df = spark.createDataFrame(rows, "id string, title string, description string, location string, "
                                     "date_posted string, site string, is_favorite boolean")
    profile = Profile(max_age_days=1, degree_values=(1, 0, 0), location_order_selected=["TX"])
    ranked = rank(df, profile, "2024-01-03").collect()
    assert [r.id for r in ranked] == ["p2", "p5", "p1", "p4"]
    assert all(r.location_score == 1 and r.degree_score == 1 for r in ranked)
    first = top_n(rank(df, profile, "2024-01-03"), standard_order(), 1).collect()
    assert [r.id for r in first] == ["p2"]
    viewed = df.where("id IN ('p0', 'p3')").withColumn("is_favorite", F.col("id") == "p3")
    flagged = with_favorites(df, toggled(viewed, F.lit(1)))
    assert [r.id for r in active(flagged, "2024-01-03", 1, only_favorites=True).collect()] == ["p0"]


def test_typed_order(spark):
    df = spark.createDataFrame([("10 days",), ("9",), ("abc",), ("ABD",), (None,), ("-1.5e1x",)], "v string")
    got = [r.v for r in df.orderBy(*typed_order([("v", True)])).collect()]
    assert got == ["-1.5e1x", "9", "10 days", "abc", "ABD", None]


def test_pushed_filters(spark, tmp_path):
    df = spark.range(10).selectExpr("cast(id as string) id", "'2024-01-01' date_posted", "'t' title", "'d' description")
    df.write.parquet(str(tmp_path / "p"))
    plan = active(spark.read.parquet(str(tmp_path / "p")), "2024-01-02", 1).select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date_posted,2024-01-01)" in text and "description" not in text
    assert any_term(F.col("title"), "x") is not None
