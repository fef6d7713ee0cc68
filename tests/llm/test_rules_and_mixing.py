import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from pagescout.llm import mixing, quality_rules

DOCS = "doc_id long, text string, lang string, source string, kept string, mix_slot string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, None) for i, t, lang, s in rows], DOCS)


def test_base_counts_match_plain_python(spark):
    rnd = random.Random(1)
    rows = [(None, None, None, None), (1, "", "en", ""), (2, "a b\na b\n\n \nc", "en", "s"), (3, "x " * 5000, "en", "s"), (3, "x " * 5000, "en", "s"), (4, "漢字 \U0001f600 #*$ <|>", "zz", "s")]
    for i in range(10, 40):
        rows.append((i, " ".join(rnd.choice("abcd") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 60))) + rnd.choice(["", "\nx y\nx y"]), "en", "s"))
    got = {(r["doc_id"]): r for r in quality_rules.apply_rules(frame(spark, rows)).collect()}
    for i, t, _, _ in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        repeated = {j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(k, k + 8)} if len(w) < 500 else set(range(len(w)))
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated), failed
        ), i
        assert not (failed and r["kept"])
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0


def test_far_documents_fail_and_near_ones_stay(spark):
    rnd = random.Random(2)
    common = quality_rules.COMMON["en"].split()

    def prose(n):
        return " ".join(rnd.choice(common) if rnd.random() < 0.5 else "".join(rnd.choice("etaoinshr") for _ in range(6)) for _ in range(n))

    rows = [(i, prose(200), "en", "s") for i in range(40)]
    rows += [(100, prose(200).upper(), "en", "s"), (101, " ".join(f"{w}###" for w in prose(200).split()), "en", "s"), (102, "zq xv kj " * 4 + prose(20), "en", "s")]
    rows += [(103, " ".join("".join(rnd.choice("etaoinshr") for _ in range(7)) for _ in range(300)), "en", "s")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(frame(spark, rows)).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[i] for i in (100, 101, 103))


def test_divergence_is_that_of_the_definition(spark):
    p, q = [0.5, 0.5, 0.0], [0.2, 0.3, 0.5]
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    got = df.select(sum((quality_rules._divergence(F.get("p", F.lit(i)), F.get("q", F.lit(i))) for i in range(3)), F.lit(0.0))).first()[0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    assert abs(got - (kl(p) + kl(q)) / 2) < 1e-12


def test_mixture_keeps_within_one_block(spark):
    sizes = {"a": 200, "b": 90, "c": 40, "": 33}
    rows = [(i, "t", None, s if s else None) for s, n in sizes.items() for i in range(n)]
    rows += [(7, "t", None, "a"), (None, "t", None, "b")]
    weights = {"a": 5, "b": 3, "c": 1}
    out = mixing.interleave(frame(spark, rows), weights, block=4, quantum=100)
    assert out.columns == ["doc_id", "text", "lang", "source", "kept", "mix_slot", "mix_place"] and out.count() == len(rows)
    got = sorted((r["mix_slot"], r["mix_place"], r["source"] or "", r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect())
    assert len({g[:2] for g in got}) == len(rows)
    plan = {r["source"]: r["share"] for r in mixing.shares(spark.createDataFrame([(s, float(weights.get(s, 1))) for s in sizes], "source string, w double"), F.col("w"), 100).collect()}
    assert sum(plan.values()) == 100
    slots = {}
    for slot, _, s, _ in got:
        assert slots.setdefault(slot, s) == s
    last = {s: max(k for k, v in slots.items() if v == s) for s in sizes}
    for s in sizes:
        done = 0
        for t in range(min(last.values()) + 1):
            done += slots.get(t) == s
            assert abs(done - Fraction(plan[s] * (t + 1), 100)) < 1
        ids = [g[3] for g in got if g[2] == s]
        assert ids == sorted(ids)
    assert mixing.interleave(frame(spark, [])).count() == 0


def test_languages_of_a_small_share(spark, monkeypatch):
    rnd = random.Random(3)
    common = quality_rules.COMMON["en"].split()

    def prose(n):
        return " ".join(rnd.choice(common) if rnd.random() < 0.5 else "".join(rnd.choice("etaoinshr") for _ in range(6)) for _ in range(n))

    def greek(n):
        return " ".join("".join(rnd.choice("αβγδεζηθικλμ") for _ in range(5)) for _ in range(n))

    many = [(i, prose(200), "en", "s") for i in range(2600)]
    # 40 of 2,643 documents have text enough for a reference; the language "xx" has not.
    some = [(10_000 + i, greek(200), "el", "s") for i in range(40)]
    some += [(20_000, greek(200).replace("α", "ш"), "xx", "s"), (20_001, prose(200).upper(), "el", "s"), (20_002, "zz " * 300, "xx", "s")]
    kept = [(r["doc_id"], r["kept"]) for r in quality_rules.apply_rules(frame(spark, many + some)).where("doc_id >= 10000").collect()]
    assert sorted(i for i, k in kept if not k) == [20_001, 20_002]
    # The verdict is the same without the rows of other languages beside, and in several passes over the references.
    few = many[:60] + some
    whole = sorted(map(tuple, quality_rules.apply_rules(frame(spark, few), keep=["doc_id"]).collect()))
    assert [(r[0], r[-1]) for r in whole if r[0] >= 10_000] == sorted(kept)
    monkeypatch.setattr(quality_rules, "LANGUAGES_AT_ONCE", 1)
    assert sorted(map(tuple, quality_rules.apply_rules(frame(spark, few), keep=["doc_id"]).collect())) == whole


def test_rules_sql_is_the_operators_rule(spark):
    """Also for languages with too few words to be references, and rows without a language."""
    import duckdb

    from pagescout.llm.queries import ORACLE

    rnd = random.Random(6)
    english, greek = ["the", "and", "of", "cat", "house", "runs", "is", "to"], ["και", "το", "σπίτι", "γάτα", "τρέχει", "η"]
    text = lambda words, n: " ".join(rnd.choice(words) + str(rnd.randint(0, 9)) * (rnd.random() < 0.5) for _ in range(n))
    rows = [(i, "en", text(english, 150)) for i in range(60)] + [(100 + i, "el", text(greek, 140)) for i in range(20)]
    rows += [(200 + i, "en", text(greek, 150)) for i in range(5)] + [(300, None, text(greek, 150)), (301, None, text(english, 150)), (302, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    cur = con.execute(ORACLE["op1_quality_rules"])
    names = [c[0] for c in cur.description]
    got = quality_rules.apply_rules(docs, keep=["doc_id"]).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, cur.fetchall()))
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[100 + i] for i in range(20)) and not any(kept[200 + i] for i in range(5))
