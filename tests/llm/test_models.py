import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagescout.llm import interpolated_lm, quality_gam, token_counts, toxicity
from pagescout.llm.texts import ALNUM, labelled_sample, words_of

SF = "/root/testdata/sf0.01"
ODD = [(None, None), (1, ""), (2, " \n\t "), (3, "a " * 30_000), (3, "a " * 30_000), (4, "x" * 5_000), (5, "Ünïcode ßtraße 漢字 \U0001f600"), (6, "one")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with those that are added."""
    return spark.createDataFrame([(i, t, 1, "s", None) for i, t in ODD], "doc_id long, text string, score int, predicted string, n_tokens string")


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_token_counts_equal_the_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(token_counts.vocabulary_path())
    rnd = random.Random(1)
    parts = ["a", "é", "ß", " ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "1", "½", "'", "'re", "ll", "!", "#", "<|endoftext|>", "漢", "́", "\U0001f600", "<|"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    counter = token_counts.PieceCounter(token_counts.vocabulary_path())
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    got = token_counts.count_tokens(odd).collect()
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), size(t), size(t) > 1024) for i, t in ODD]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(odd.where("false")).count() == 0


def test_merges_follow_rank_then_place():
    class Small(token_counts.PieceCounter):
        def __init__(self):
            a, b = 97, 98
            self.merges = {(a, b): (0, 256), (256, 256): (1, 257), (a, a): (2, 258), (b, b): (3, 259)}

    def plain(text):
        s, merges = list(text), Small().merges
        while True:
            at = [(merges[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in merges]
            if not at:
                return len(s)
            _, i = min(at)
            s[i : i + 2] = [merges[s[i], s[i + 1]][1]]

    rnd = random.Random(2)
    for _ in range(300):
        text = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 20)))
        assert Small().merge_count(text) == plain(text)


def test_quality_model_on_held_out_documents(spark, odd):
    docs, labels = tables(spark)
    found = quality_gam.classify(docs, labels)
    got = found.join(labels, "doc_id").where("held_out and quality is not null").toPandas()
    assert ((got["predicted"] == 1) == (got["quality"] == 1)).mean() > 0.95
    assert found.where("score < 0 or score > 1 or score is null").count() == 0
    model = quality_gam.train(docs, labels)
    scored = quality_gam.score_quality(odd, model, keep=True)
    assert scored.count() == len(ODD) and scored.columns == ["doc_id", "text", "n_tokens", "score", "predicted"]
    assert quality_gam.classify(docs.where("false"), labels).count() == 0
    assert quality_gam.classify(odd, labels.where("false")).select("score").distinct().collect()[0][0] == 0.5


def test_additive_model_is_a_sum_of_lookups():
    r = np.random.default_rng(0)
    x = r.random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y, pairs=2)
    # Neither feature tells anything alone, so only the pair's table can.
    assert (0, 1) in [(a, b) for a, b, _ in model.pairs]
    assert (((model.score(x) > 0.5) == (y > 0)).mean()) > 0.85
    one = x[:1]
    by_hand = model.base + sum(t[np.searchsorted(c, v, side="right")] for t, c, v in zip(model.tables, model.cuts, one[0]))
    by_hand += sum(t[np.searchsorted(model.coarse[a], one[0, a], side="right"), np.searchsorted(model.coarse[b], one[0, b], side="right")] for a, b, t in model.pairs)
    assert model.logit(one)[0] == pytest.approx(by_hand)


def test_features_do_not_depend_on_the_chunk():
    texts = [b"", None, b"a b c", "ÄÖ 1 2\nÄÖ 1 2\n".encode(), b"w " * 300]
    together = quality_gam.features(texts)
    assert np.allclose(together, np.concatenate([quality_gam.features([t]) for t in texts]))


def test_toxicity_on_held_out_documents(spark, odd):
    docs = pd.read_parquet(f"{SF[:-4]}0.1/documents.parquet").merge(pd.read_parquet(f"{SF[:-4]}0.1/labels.parquet"), on="doc_id").sort_values("doc_id")[:2200]
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in docs["doc_id"]])
    texts, y = [t.encode() for t in docs["text"]], docs["toxic"].to_numpy(float)
    model = toxicity.fit([t for t, h in zip(texts, held) if not h], y[~held])
    score = model.score([t for t, h in zip(texts, held) if h])
    truth = y[held] == 1
    order = np.argsort(np.argsort(score)) + 1
    area = (order[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())
    assert area > 0.9 and ((score >= 0.5) == truth).mean() > 0.95
    got = toxicity.score_toxicity(odd, model).toPandas()
    assert len(got) == len(ODD) and got["score"].between(0, 1).all()
    assert np.allclose(model.score(texts[:20]), np.concatenate([model.score([t]) for t in texts[:20]]), atol=1e-5)
    assert toxicity.score_toxicity(odd.where("false"), model).count() == 0
    docs_, labels = tables(spark)
    assert toxicity.classify(odd, labels.where("false")).count() == len(ODD)
    del docs_


def test_toxicity_gradients_are_those_of_the_loss():
    texts = [b"one two three " * 20, b"four five six seven", b"x"]
    w = words_of(texts, ALNUM, lower=True)
    v = toxicity.Vocabulary.of(w)
    start, size, _ = toxicity.windows(w.first)
    net = toxicity.Network()
    net.p = {k: a.astype(float) for k, a in net.p.items()}
    odds = np.random.default_rng(0).standard_normal(v.word.size)
    words, y = toxicity.window_words(v, start, size), np.arange(start.size) % 2
    g = net.gradients(v, odds, words, size, y)

    def loss():
        x = net.inputs(v, odds)
        logit = net.forward(np.stack([x @ net.p["in"][i] + net.p["bias"][i] for i in (0, 1)], 1), words, size)
        return np.mean(np.log1p(np.exp(logit)) - y * logit)

    for k in net.p:
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        high = loss()
        net.p[k][i] = old - 1e-3
        low = loss()
        net.p[k][i] = old
        assert g[k][i] == pytest.approx((high - low) / 2e-3, rel=1e-2, abs=1e-5), k


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        start, size, text = toxicity.windows(np.array([0, n]))
        assert {w for a, s in zip(start, size) for w in range(a, a + s)} == set(range(n))


def test_language_model_matches_plain_counts(spark, odd, monkeypatch):
    monkeypatch.setattr(interpolated_lm, "CHUNK", 60_000)
    monkeypatch.setattr(interpolated_lm, "BLOCK", 5_000)
    docs = tables(spark)[0].select("doc_id", "text").limit(150).union(odd.select("doc_id", "text"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    held = F.coalesce(interpolated_lm.fold(F.col("doc_id"), 7) == 2, F.lit(False))
    model = interpolated_lm.train(docs, held)
    assert model.blocks > 1 and np.allclose(model.weights.sum(1), 1)
    got = sorted(map(tuple, interpolated_lm.score(model).collect()), key=repr)
    rows = [(i, [w.lower() for w in (t or "").encode().split()] + [None]) for i, t in docs.collect()]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    train = [t for (_, t), h in zip(rows, out) if not h]
    c = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["start"] + t, t))
    n, v = sum(c.values()), len(c)
    want = []
    for (i, t), h in zip(rows, out):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for u, w in zip(["start"] + t, t):
            seen = len(train) if u == "start" else c[u]
            weight = model.weights[min(int(math.log2(seen + 1)), interpolated_lm.BUCKETS - 1)]
            score += math.log10(weight[0] * (pairs[u, w] / seen if seen else 0) + weight[1] * c[w] / n + weight[2] / (v + 1))
        want.append((i, h, len(t), sum(c[w] > 0 for w in t), n, base, score))
    want.sort(key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want])
    assert interpolated_lm.score_by_fold(docs.where("false")).count() == 0


def test_language_model_counts_are_whole_at_any_size():
    keys = np.array([5, 5 + (1 << 48), 5 + (3 << 60)], np.uint64)
    seen = [np.array([6_000_000_000, 1, 70_000]), np.array([2, 300, 0])]
    asked = pa.table({
        "block": pa.array([0, 0], pa.int32()),
        "chunk": pa.array([3, 9], pa.int32()),
        "keys": [keys.tobytes()] * 2,
        "counts": [interpolated_lm._narrow(n) for n in seen],
    })
    found = interpolated_lm._answer(asked).to_pylist()
    assert [interpolated_lm._widen(r["totals"]).tolist() for r in found[:2]] == [[6_000_000_002, 301, 70_000]] * 2
    assert (found[2]["chunk"], found[2]["different"], found[2]["seen"]) == (-1, 3, 6_000_070_303)
    for n in ([], [255], [256], [65_536], [1 << 32], [(1 << 62) + 1]):
        assert interpolated_lm._widen(interpolated_lm._narrow(np.array(n, np.int64))).tolist() == n
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, np.uint64) * np.uint64(2))
    edges = interpolated_lm._blocks(values, 200_000)
    assert len(edges) == 200_001 and edges[0] == 0 and edges[-1] == 1000


def test_weights_maximise_the_likelihood():
    cells = [(3, 150, 100, 60), (3, 0, 120, 40)]
    weight = interpolated_lm.learn_weights(cells, 1e-6)[3]
    p = lambda l: sum(n * math.log(l[0] * (2.0 ** ((a - 160) / 4) if a else 0) + l[1] * 2.0 ** ((b - 160) / 4) + l[2] * 1e-6) for _, a, b, n in cells)
    r = np.random.default_rng(0)
    assert all(p(weight) > p(other) - 0.5 for other in r.dirichlet([1, 1, 1], 200))


def test_an_id_is_sampled_once_however_often_it_stands(spark):
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"text {i}") for i in range(40)] + [(train[0], f"other {k % 50}") for k in range(300)] + [(train[1], None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 100)
    assert got.columns == ["doc_id", "text", "label"]
    first = {i: min((t or "" for j, t in rows if j == i), key=lambda t: hashlib.md5(t.encode()).digest()) for i in train}
    assert sorted((r[0], r[1] or "", r[2]) for r in got.collect()) == [(i, first[i], i % 2) for i in train]
    assert labelled_sample(docs, labels, "quality", 7).count() == 7


def test_language_model_moves_narrow_keys_once(spark, odd, monkeypatch):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50_000):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        assert (interpolated_lm._unpacked(interpolated_lm._packed(keys)) == keys).all()
        assert len(interpolated_lm._packed(keys)) <= 7 * keys.size + 10
    ends = np.array([0, 1, (1 << 64) - 1], np.uint64)
    assert (interpolated_lm._unpacked(interpolated_lm._packed(ends)) == ends).all()
    monkeypatch.setattr(interpolated_lm, "CHUNK", 60_000)
    docs = spark.createDataFrame(odd[0], odd[1]) if isinstance(odd, tuple) else odd
    plan = interpolated_lm.score_by_fold(docs)._jdf.queryExecution().executedPlan().toString()
    # Texts and answers lie in buckets of their chunk.
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan


def test_chunks_follow_the_partitions():
    chunk = interpolated_lm.CHUNK
    assert interpolated_lm.chunk_shares([]) == ([], 1)
    assert interpolated_lm.chunk_shares([(2, 10), (0, 2 * chunk + 1), (1, 20), (3, chunk), (5, 5)]) == ([(0, 0, 3), (1, 3, 1), (2, 3, 1), (3, 4, 1), (5, 5, 1)], 6)


def test_texts_stay_in_their_partition(spark, monkeypatch):
    monkeypatch.setattr(interpolated_lm, "CHUNK", 2_000)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('word ', id % 7, ' ', repeat('x', 20)) AS text").repartition(4, "doc_id")
    docs = docs.cache()
    docs.count()
    place = {r.doc_id: r.part for r in docs.select("doc_id", F.spark_partition_id().alias("part")).collect()}
    model = interpolated_lm.train(docs, F.col("doc_id") % 7 == 2)
    parts, rows = collections.defaultdict(set), collections.Counter()
    for r in model.chunks.collect():
        parts[r.chunk].add(place[r.doc_id])
        rows[r.chunk] += 1
    assert sum(rows.values()) == 400 and len(parts) > 4
    assert all(len(p) == 1 for p in parts.values())
