import random
import re

from pyspark.sql import functions as F

from pagescout.llm import decontaminate, line_dedup, ngram_join, quality_gam, substring_dedup
from pagescout.llm.components import components
from pagescout.operators import skew
from pagescout.storage import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in rows], DOCS)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return (text or "").encode().split()


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    found = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def up(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[up(a)] = up(b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(found) == nodes
    assert all((found[a] == found[b]) == (up(a) == up(b)) for a in nodes for b in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = lower(t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[up(i)] = up(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[up(i)] = min(d, least.get(up(i), d))
    return sorted(((d, len(s), least.get(up(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(50)]
    base = [rnd.choice(vocabulary) for _ in range(60)]
    rows = [(None, None), (1, ""), (2, "  \n "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "É x y z q r"), (7, "é x y z q r"), (None, "one")]
    for i in range(10, 60):
        w = list(base[: rnd.choice([60, 60, 55, 30])])
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(70, rows[20][1]), (70, rows[20][1]), (71, " ".join(base * 40)), (72, " ".join(base * 40 + ["x"]))]
    found = ngram_join.near_duplicates(docs(spark, rows))
    got = sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute_components(rows)
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0


def units(line):
    if len(words(line)) >= line_dedup.MIN_WORDS:
        return "words", words(line)
    return "characters", list(line) if len(line) >= line_dedup.MIN_CHARACTERS else None


def near_line(a, b):
    (kind, a), (other, b) = units(a), units(b)
    if kind != other or a is None or b is None or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(7)
    lines = ["a b c d e f g", "a b c x e f g", "a b c d e f", "a b c d e f g h", "a  b c d e f g", "short one", "", " ", "b a c d e f g"]
    lines += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(5, 9))) for _ in range(40)]
    unspaced = "漢字\U0001f600é" * 75
    lines += [unspaced, unspaced[:100] + "x" + unspaced[101:], unspaced[:299], unspaced + "\U0001f601", "three words of characters", "three words of character", "three  words of character"]
    lines += ["\ta b\x0bc d\re f g ", "a b c d e f\x0c", "short one!", " ".join("abcdefghijkl"), "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxy"]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    rows += [(70, None), (71, "x y z " * 3000), (71, "x y z " * 3000), (72, "x y z " * 3000 + "w"), (73, "\n\n")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    places = [(d, n, line) for d, t in dict(rows).items() if t for n, line in enumerate(t.split("\n")) if words(line)]
    places.sort(key=lambda p: p[:2])
    first = {}
    for d, n, line in places:
        first.setdefault(line, (d, n))
    near = {a for a in first for b in first if a != b and first[b] < first[a] and near_line(a, b)}
    for d, t in dict(rows).items():
        mine = [(n, line) for n, line in enumerate((t or "").split("\n"))]
        gone = {n for n, line in mine if words(line) and (line in near or first[line] != (d, n))}
        text = t if not gone else "\n".join(line for n, line in mine if n not in gone)
        assert got[d] == (text, sum(bool(words(line)) for _, line in mine), len(gone)), d
    # Rows that repeat id and text come out alike.
    assert line_dedup.dedup_lines(docs(spark, rows)).count() == len(rows)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_keeps_columns_with_its_own_names(spark, monkeypatch):
    rows = [(i, "one two three four five six\nown line", [str(i)], {"a": i}, i, i) for i in range(3)]
    own = spark.createDataFrame(rows, "doc_id long, text string, _removed array<string>, _lines map<string, long>, row long, n_lines long")
    got = line_dedup.dedup_lines(own).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, rows[i][1] if i == 0 else "", [str(i)], {"a": i}, i, 2, 0 if i == 0 else 2) for i in range(3)]
    # A line found more often than a task should read is dealt to several tasks.
    monkeypatch.setattr(line_dedup, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(line_dedup.S, "ROWS_PER_TASK", 1)
    assert [tuple(r) for r in line_dedup.dedup_lines(own).orderBy("doc_id").collect()] == [tuple(r) for r in got]


def test_line_dedup_broadcasts_only_what_it_has_measured(spark, monkeypatch):
    text, plans = "one two three four five six %s", []
    rows = [(i, "\n".join([text % i, "漢字é" * 20 + str(i), "common"])) for i in range(6)]

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    def joined():
        plans.clear()
        last = line_dedup.dedup_lines(docs(spark, rows))
        plans.append(last._jdf.queryExecution().executedPlan().toString())
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in last.collect()}
        assert got == {i: (rows[0][1] if i == 0 else "", 3, 0 if i == 0 else 3) for i in range(6)}
        found = [x for plan in plans for x in re.findall(r"(\w+Join) \[(\w+#.*?|coalesce.*?)\], \[", plan)]
        return {kind: [re.sub(r"#\d+L?", "", keys) for name, keys in found if name == kind] for kind in ("BroadcastHashJoin", "SortMergeJoin")}

    monkeypatch.setattr(line_dedup, "materialize", kept)
    monkeypatch.setattr(skew, "materialize", kept)
    # Spark takes rows behind an explode for as small as their file: under this limit it would broadcast whatever it is left to guess.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        assert joined()["SortMergeJoin"] == ["head"]
        monkeypatch.setattr(line_dedup, "fits_broadcast", lambda df: False)
        monkeypatch.setattr(skew, "fits_broadcast", lambda *_: False)
        found = joined()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(found["SortMergeJoin"]) == sorted(["half", "line", "key, place, size", "id", "head", "line", "line, _salt", "_row, _salt"])
    # Left are the places of the ranking's partitions and the keys found more often than a task should read, thrice.
    assert sorted(x.split(",")[0] for x in found["BroadcastHashJoin"]) == sorted(["_all", "line", "_row", "coalesce(_row"])


def test_repeated_passages_match_brute_force(spark):
    rnd = random.Random(9)
    vocabulary = [f"v{i}" for i in range(200)]
    passage = [rnd.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(25):
        w = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 10, 60]))]
        at = rnd.randrange(36)
        w += passage[at : at + rnd.choice([34, 35, 36, 70])] + [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 40]))]
        rows.append((i, " ".join(w)))
    rows += [(30, None), (31, ""), (32, "z " * 80), (33, rows[3][1]), (33, rows[3][1]), (None, "q " * 34)]
    seen = {}
    for _, t in rows:
        w = words(t)
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    want = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((d, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    got = substring_dedup.remove_passages(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert substring_dedup.remove_passages(docs(spark, [])).count() == 0


def test_hot_anchors_give_the_same_stretches(spark):
    base = " ".join(f"v{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} " + base + f" c{i}") for i in range(20)]
    df = docs(spark, rows).select(substring_dedup.text_key(F.col("text")).alias("key"), "text")
    results = [
        sorted((r["key"], sorted({j for s in r["spans"] for j in range(s["from"], s["to"])})) for r in substring_dedup.repeated_passages(df, hot).collect())
        for hot in (5000, 2)
    ]
    assert results[0] == results[1] and all(s == list(range(2, 62)) for _, s in results[0]) and len(results[0]) == 20


def test_contamination_matches_brute_force(spark):
    import re

    rnd = random.Random(13)
    vocabulary = [f"v{i}" for i in range(30)]

    def text(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    items = [(1, text(30)), (2, text(12)), (3, "one Two"), (4, None), (5, ""), (6, text(9)), (7, text(10)), (2, text(11)), (None, text(20)), (None, "no id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, text(20)) for i in range(10)]
    for i in range(10, 40):
        t = (rnd.choice(items)[1] or "").split()
        a = rnd.randrange(len(t) or 1)
        rows.append((i, text(rnd.randrange(5)) + " " + "-".join(t[a : a + 15]).upper() + "! " + text(3)))
    rows += [(50, None), (51, ""), (52, "ONE, two"), (53, items[0][1]), (53, items[0][1]), (None, items[1][1]), (54, items[8][1]), (55, "No, id")]
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "").encode())
    want = []
    for d, t in rows:
        w, hit, ids = split(t), set(), set()
        for item, s in items:
            v = split(s)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if windows else 0):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= {item} - {None}
        want.append((d, len(w), len(hit), sorted(ids), len(ids), bool(hit)))
    for filter_bits in (decontaminate.FILTER_BITS, (1 << 16, 1 << 16)):
        decontaminate.FILTER_BITS, old = filter_bits, decontaminate.FILTER_BITS
        got = [(r[0], r[1], r[2], sorted(r[3]), r[4], r[5]) for r in decontaminate.contamination(docs(spark, rows), bench).collect()]
        decontaminate.FILTER_BITS = old
        assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = decontaminate.contamination(docs(spark, rows), bench, keep=True)
    assert kept.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "key", "size"] and kept.count() == len(rows)
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    assert decontaminate.contamination(docs(spark, rows), bench.where("false")).where("contaminated").count() == 0


def test_columns_of_own_names_and_maps_pass_through(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, passage, "k", "t", "s", 7, {"a": 1}), (2, passage + " end", None, None, None, None, None), (None, None, "k", "t", "s", 7, {})]
    own = spark.createDataFrame(rows, "doc_id long, text string, _key string, _text string, _spans string, _n_words long, row map<string, long>")
    bench = spark.createDataFrame([(1, "w3 w4 w5")], "item_id long, text string")
    order = lambda df: sorted((tuple(r) for r in df.select(*own.columns).collect()), key=repr)
    same = sorted(rows, key=repr)
    hit = decontaminate.contamination(own, bench, keep=True)
    assert order(hit) == same and sorted(r["n_hit"] for r in hit.collect()) == [0, 3, 3]
    cut = substring_dedup.remove_passages(own, keep=True)
    assert order(cut) == same and sorted(r["n_removed"] for r in cut.collect()) == [0, 40, 40]
    model = quality_gam.train(own, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert order(quality_gam.score_quality(own, model, keep=True)) == same


def test_open_lists_get_further_hubs(spark, monkeypatch):
    """Texts in chains of links, no one near to all others, and texts that share a passage without a link."""
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    base, passage = [f"w{i}" for i in range(200)], [f"p{i}" for i in range(12)]
    rows = [(i, " ".join(base[4 * i : 4 * i + 100])) for i in range(20)]
    rows += [(100 + i, " ".join(passage + [f"x{i // 3}-{j}" for j in range(20)] + ["z"] * (i % 3))) for i in range(30)]
    found = ngram_join.near_duplicates(docs(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(rows)
