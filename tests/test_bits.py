from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.operators import bits as B
from pagescout.operators import frontier as FR
from pagescout.plans import crawl as CR
from queryset import corpus as C

SF = "/root/testdata/sf0.001"


def test_filter_lets_all_members_and_few_others_pass(spark):
    table = spark.range(40_000).selectExpr("id", "concat('host', id) AS host").union(spark.createDataFrame([(-1, None)], "id LONG, host STRING"))
    members = table.where("id % 4 = 0").select("host")
    found = B.may_match(table, "host", B.key_bits(members, "host"))
    row = found.agg(F.count_if(F.expr("id % 4 = 0")).alias("members"), F.count_if(F.expr("id % 4 != 0 OR id < 0")).alias("others")).first()
    assert row["members"] == 10_000 and row["others"] < 30_000 * 0.05
    assert B.may_match(table, "host", B.key_bits(members.where("false"), "host")).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_hosts_out_of_reach_are_not_parsed(spark, monkeypatch):
    pages, seeds = C.pages(spark, SF), FR.seed_frontier(C.seeds(spark, SF).limit(3))
    listed = spark.createDataFrame([], "url STRING, domain STRING, loc STRING")
    exact = {r.url for r in CR.within_reach(pages, seeds, listed).select("url").collect()}
    monkeypatch.setattr(S, "BROADCAST_LIMIT_BYTES", 0)
    filtered = {r.url for r in CR.within_reach(pages, seeds, listed).select("url").collect()}
    assert exact <= filtered and len(filtered) < pages.count() / 2


def test_fetch_by_filter_equals_fetch_by_broadcast(spark, monkeypatch):
    pages = spark.range(500).selectExpr("concat('u', id % 100) AS url_key", "id AS page_id")
    frontier = spark.createDataFrame([("u1", 0), ("u7", 1), ("x", 0)], "url_key STRING, depth INT")
    want = sorted(map(tuple, FR.fetch_join(frontier, pages).select("url_key", "page_id", "depth").collect()))
    monkeypatch.setattr(S, "BROADCAST_LIMIT_BYTES", 0)
    assert sorted(map(tuple, FR.fetch_join(frontier, pages).select("url_key", "page_id", "depth").collect())) == want and len(want) == 10
