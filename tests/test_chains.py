import random

import pytest

from pagescout import settings as S
from pagescout.operators import chains as CH
from pagescout.operators import frontier as FR
from pagescout.operators import reports as RP


def series(links):
    """Head and position by walking."""
    after, before = {}, {}
    for a, b in sorted(links):
        after.setdefault(a, b)
    for a, b in sorted(after.items()):
        before.setdefault(b, a)
    out = set()
    for page in {p for link in links for p in link}:
        seen, at = [page], page
        while at in before and before[at] not in seen:
            at = before[at]
            seen.append(at)
        out.add((page, None, None, True) if at in before else (page, at, len(seen), False))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_series_equal_walking(spark, seed):
    rnd = random.Random(seed)
    links = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(70)]
    links += [(f"{rnd.choice('bcd')}{rnd.randint(0, 30):02d}", f"{rnd.choice('bcd')}{rnd.randint(0, 30):02d}") for _ in range(25)]
    links += [("x", "y"), ("y", "x"), ("z", "z"), ("p", "q"), ("p", "r"), ("o", "q")]
    table = spark.createDataFrame(links, "src STRING, dst STRING")
    assert {tuple(r) for r in CH.follow_next(table).collect()} == series(links)
    assert CH.follow_next(table.where("false")).count() == 0


def ends(named):
    out = set()
    for page, urls in named.items():
        path, at = [page], min(urls)
        while at not in path and at in named and min(named[at]) != at:
            path.append(at)
            at = min(named[at])
        loop = at in path and not (at == page and min(urls) == page)
        rep = min(path[path.index(at) :]) if loop else at
        out.add((page, rep, None if loop else 0 if at == page else len(path), loop, len(set(urls)) > 1))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_canonicals_equal_walking(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(40)] + [("t40", "zz")] + [(f"m{i:02d}", "t10") for i in range(30)]
    rows += [("zz", "zy"), ("zy", "zx"), ("zx", "zz")] if seed else [("zz", "zz")]
    rows += [(f"n{rnd.randint(0, 25):02d}", f"n{rnd.randint(0, 25):02d}") for _ in range(30)]
    named = {}
    for a, b in rows:
        named.setdefault(a, []).append(b)
    table = spark.createDataFrame(rows, "url_key STRING, canonical STRING")
    resolved = CH.resolve_canonicals(table)
    assert {tuple(r) for r in resolved.select("url_key", "representative", "hops", "is_loop", "conflict").collect()} == ends(named)
    products = spark.createDataFrame([("t01",), ("t02",), ("m01",), ("alone",)], "url_key STRING")
    rep = next(r[1] for r in ends(named) if r[0] == "t01")
    assert {tuple(r) for r in CH.products_by_representative(products, resolved).collect()} == {(rep, 3, "m01"), ("alone", 1, "alone")}


def test_round_bound_keeps_the_first_rows(spark):
    rnd = random.Random(2)
    rows = [(f"https://{'a' * rnd.randint(1, 3)}.com/{i}", i % 3, "d") for i in range(1500)]
    table = spark.createDataFrame(rows, "url_key STRING, depth INT, domain STRING")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for n in (0, 1, 499, 500, 501, 1000, 1500, 9999):
        kept, dropped = FR.round_bound(table, n, ranges=7, at_once=20)
        assert sorted(map(tuple, kept.collect())) == sorted(order[:n])
        assert dropped.count() == max(0, len(rows) - n)


def test_sketches_unite_within_their_bound(spark):
    # Three rounds that share half of their URLs.
    rows = spark.range(60_000).selectExpr("concat('u', id % 40000) AS url_key", "CAST(id % 3 AS INT) AS round", "id % 2 AS domain")
    sketches = RP.visited_sketches(rows, ["domain", "round"])
    assert sketches.selectExpr("max(length(sketch))").first()[0] < 10_000
    for r in RP.sketched_count(sketches, ["domain"]).collect():
        assert abs(r["visited"] - 20_000) <= 3 * 1.04 / 2 ** (S.SKETCH_PRECISION / 2) * 20_000
    few = rows.where("url_key IN ('u1', 'u2', 'u3')")
    assert {r["visited"] for r in RP.sketched_count(RP.visited_sketches(few, ["domain"]), ["domain"]).collect()} == {1, 2}
