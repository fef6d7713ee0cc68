import random
import time

import pytest

from pagescout.operators import robots as R
from pagescout.sources.tables import scan_robots
from pagescout.storage import materialize

CASES = [
    # body, status, path, allowed
    ("User-agent: *\nDisallow: /disallowed/", 200, "/disallowed/product", False),
    ("User-agent: *\nDisallow: /disallowed/", 200, "/allowed", True),
    ("User-agent: *\nDisallow: /", 404, "/x", True),
    ("User-agent: *\nDisallow:", 503, "/x", False),
    ("User-agent: *\nDisallow: /", 301, "/x", True),
    ("User-agent: *\nDisallow:", 200, "/x", True),
    ("User-agent: *\nDisallow: /a\nAllow: /a", 200, "/a", True),
    ("User-agent: *\nAllow: /a\nDisallow: /a/b", 200, "/a/b/c", False),
    ("User-agent: *\nDisallow: /a\nAllow: /a/b", 200, "/a/b/c", True),
    ("User-agent: *\nDisallow: /*.pdf$", 200, "/x/y.pdf", False),
    ("User-agent: *\nDisallow: /*.pdf$", 200, "/x/y.pdf?z=1", True),
    ("User-agent: *\nDisallow: /*?sku=", 200, "/x?sku=1", False),
    ("User-agent: *\nDisallow: /a.b", 200, "/axb", True),
    ("User-agent: *\nDisallow: /a.b*c", 200, "/axbc", True),
    ("User-agent: *\nDisallow: /für", 200, "/f%C3%BCr", False),
    ("User-agent: *\nDisallow: /\nUser-agent: PageScout\nDisallow: /only", 200, "/x", True),
    ("User-agent: *\nDisallow: /\nUser-agent: PageScout\nDisallow: /only", 200, "/only/x", False),
    ("User-agent: other\nUser-agent: pagescout\nDisallow: /s", 200, "/s", False),
    ("User-agent: pagescout\nDisallow: /1\n\nUser-agent: x\nDisallow: /2\nUser-agent: pagescout\nDisallow: /3", 200, "/3", False),
    ("User-agent: pagescout\nDisallow: /1\n\nUser-agent: x\nDisallow: /2\nUser-agent: pagescout\nDisallow: /3", 200, "/2", True),
    ("User-agent: other\nDisallow: /", 200, "/x", True),
    ("Disallow: /lost\nUser-agent: *\nDisallow: /found", 200, "/lost", True),
    ("USER-AGENT : *\r\nDISALLOW : /up # note\r\n", 200, "/up", False),
    ("User-agent: pagescout\nCrawl-delay: 2\nUser-agent: *\nDisallow: /", 200, "/x", True),
    ("User-agent: *\nDisallow: /", 200, "", False),
    ("<html>no robots</html>", 200, "/x", True),
]


@pytest.fixture(scope="module")
def tables(spark):
    robots = [(f"h{i}.com", status, body) for i, (body, status, _, _) in enumerate(CASES)]
    urls = [(i, f"https://H{i}.com{path}") for i, (_, _, path, _) in enumerate(CASES)]
    urls.append((len(CASES), "https://unknown.com/x"))
    return (
        scan_robots(spark.createDataFrame(robots, "host STRING, status INT, body STRING")),
        spark.createDataFrame(urls, "i INT, url STRING"),
    )


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": -1}, {"broadcast_limit": -1, "rows_per_task": 0.4}])
def test_verdicts_by_every_join(tables, options):
    robots, urls = tables
    rows = R.robots_verdict(urls, R.host_policy(robots), **options).orderBy("i").collect()
    assert [r.allowed for r in rows] == [c[3] for c in CASES] + [True]


def test_large_policy_is_not_broadcast(spark, tables):
    robots, urls = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = R.robots_verdict(urls, R.host_policy(robots), broadcast_limit=-1)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Only the list of hot keys, bounded by rows / rows_per_task, is broadcast.
    assert plan.count("BroadcastHashJoin") <= 2 and "SortMergeJoin" in plan


def test_delay_and_groups(spark):
    body = "User-agent: *\nCrawl-delay: 3\nCrawl-delay: x\nDisallow: /p\n\nUser-agent: a\nUser-agent: b\nCrawl-delay: 0.5\nAllow: /q"
    robots = spark.createDataFrame([("h", 200, body)], "host STRING, status INT, body STRING")
    assert {(r.agent, r.delay_s) for r in R.robots_delays(robots).collect()} == {("*", 3.0), ("a", 0.5), ("b", 0.5)}
    rules = {(r.agent, r.allow, r.path, r.path_len) for r in R.robots_rules(robots).collect()}
    assert rules == {("*", False, "/p", 2), ("a", True, "/q", 2), ("b", True, "/q", 2)}
    urls = spark.createDataFrame([("https://h/x",), ("https://i/x",)], "url STRING")
    got = {r.host: r.delay_s for r in R.robots_verdict(urls, R.host_policy(robots), default_delay=1.5).collect()}
    assert got == {"h": 3.0, "i": 1.5}
    assert R.agent_group(robots, "B").first().agent == "b"


def test_a_whole_agent_string_names_its_token(spark):
    body = "User-agent: shopbot\nDisallow: /mine\nCrawl-delay: 7\n\nUser-agent: *\nDisallow: /all"
    robots = spark.createDataFrame([("h", 200, body)], "host STRING, status INT, body STRING")
    for agent in ("shopbot", "ShopBot/1.0", "ShopBot/1.0 (+https://e.com)"):
        assert R.agent_group(robots, agent).first().agent == "shopbot"
        row = R.host_policy(robots, agent).first()
        assert [r.path for r in row.rules] == ["/mine"] and row.delay_s == 7
    plan = R.host_policy(robots, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1


def fits(rule, target):
    """The rule read character by character, every way of filling a star tried once."""
    anchored, rule = rule.endswith("$"), rule[:-1] if rule.endswith("$") else rule
    places = {0}
    for c in rule:
        if c == "*":
            places = set(range(min(places), len(target) + 1)) if places else places
        else:
            places = {p + 1 for p in places if p < len(target) and target[p] == c}
    return len(target) in places if anchored else bool(places)


def test_rules_equal_plain_matching(spark):
    rnd = random.Random(5)
    word = lambda letters, n: "/" + "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
    hosts, urls = [], []
    for h in range(120):
        rules = [(rnd.random() < 0.5, word("ab/*$" if rnd.random() < 0.6 else "ab/", 6) + rnd.choice(["", "", "$", "*"])) for _ in range(rnd.randint(1, 30))]
        hosts.append((f"h{h}.com", 200, "\n".join(["User-agent: *", *(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules)])))
        for _ in range(12):
            path = word("ab/$", 8)
            best = max(((len(p), a) for a, p in rules if fits(p, path)), default=(0, True))
            urls.append((len(urls), f"https://h{h}.com{path}", best[1]))
    robots = scan_robots(spark.createDataFrame(hosts, "host STRING, status INT, body STRING"))
    table = spark.createDataFrame(urls, "i INT, url STRING, expected BOOLEAN")
    judged = R.robots_verdict(table, R.host_policy(robots))
    assert judged.where("allowed != expected").take(3) == [] and judged.count() == len(urls)


def test_many_stars_take_no_time(spark):
    rule = "/" + "*a" * 20 + "*b"
    robots = spark.createDataFrame([("h", 200, f"User-agent: *\nDisallow: {rule}")], "host STRING, status INT, body STRING")
    urls = spark.createDataFrame([("https://h/" + "a" * 2000,), ("https://h/" + "a" * 2000 + "b",)], "url STRING")
    R.robots_verdict(urls.limit(0), R.host_policy(robots)).collect()
    start = time.monotonic()
    got = {r.url[-1]: r.allowed for r in R.robots_verdict(urls, R.host_policy(robots)).collect()}
    assert got == {"a": True, "b": False} and time.monotonic() - start < 10


def test_ten_thousand_rules_cost_a_few_lookups(spark):
    lines = [f"{'Allow' if i % 3 == 0 else 'Disallow'}: /section-{i:05d}/" for i in range(10_000)]
    robots = spark.createDataFrame([("h", 200, "\n".join(["User-agent: *", *lines]))], "host STRING, status INT, body STRING")
    policy = materialize(R.rule_index(R.host_policy(robots)), "policy")
    urls = spark.range(20_000).selectExpr("id", "concat('https://h/section-', lpad(cast(id % 10000 as string), 5, '0'), '/x') AS url")
    start = time.monotonic()
    wrong = R.robots_verdict(urls, policy).where("allowed != (id % 10000 % 3 = 0)").count()
    assert wrong == 0 and time.monotonic() - start < 20
