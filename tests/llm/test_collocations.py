import random
import re
from collections import Counter, defaultdict

import pytest
from pagescout.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, longest=3, top=2000):
    count, total = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                count[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = set()
    for lang, grams in count.items():
        common = {g: a for g, a in grams.items() if a >= least}
        longer = Counter()
        for g, a in common.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    longer[g[i : i + n]] = max(longer[g[i : i + n]], a)
        found = []
        for g, a in common.items():
            if len(g) > 1 and not 100 * longer[g] >= 50 * a:
                score, k, left, right = min((10**6 * a * a // (grams[g[:k]] * grams[g[k:]]), k, grams[g[:k]], grams[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = ["the", "The", "cat", "sat", "É", "é", "a", "漢字", "x\x0by", "\x00", "new", "york", "city"]
    weights = [9, 3, 5, 5, 2, 2, 8, 2, 1, 1, 4, 4, 4]

    def text():
        parts = []
        for _ in range(rnd.randint(0, 40)):
            parts += ["new york city"] if rnd.random() < 0.1 else rnd.choices(words, weights)
            parts.append(rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!", "\r\n"]))
        return "".join(parts)

    made = [(i, rnd.choice(["en", "en", "de", None, "und", "a\nb", ""]), text()) for i in range(150)]
    return [*made, (None, None, None), (1, "en", ""), (2, "en", " .\n"), (3, "en", "a " * 30_000), (3, "en", "a " * 30_000), (4, "de", "x" * 5_000)]


@pytest.mark.parametrize("sample, bits", [(4, C.FILTER_BITS), (1 << 40, C.FILTER_BITS), (1 << 40, (1 << 17, 1 << 17)), (1, C.FILTER_BITS)])
def test_equals_counting_everything(spark, rows, monkeypatch, sample, bits):
    """Also where the sample proposes nothing, so that every common phrase has to come from failed borders."""
    monkeypatch.setattr(C, "SAMPLE", sample)
    monkeypatch.setattr(C, "FILTER_BITS", bits)
    docs = spark.createDataFrame([(*r, 1, None) for r in rows], "doc_id long, lang string, text string, key long, size string")
    assert {tuple(r) for r in C.collocations(docs).collect()} == brute(rows)


def test_bounds_are_parameters(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for least, longest, top in [(3, 4, 25), (20, 2, 3)]:
        got = C.collocations(docs, top=top, least=least, longest=longest)
        assert {tuple(r) for r in got.collect()} == brute(rows, least, longest, top)
    assert C.collocations(docs.where("false")).count() == 0


def test_products_beyond_64_bits(spark):
    """The score of counts of some trillions."""
    score = 10**6 * (3 * 10**12) ** 2 // (7 * 10**12 * 5 * 10**12)
    table = spark.createDataFrame([(3 * 10**12, 7 * 10**12, 5 * 10**12)], "a long, l long, r long")
    assert table.select(C.score()).first()[0] == score


def test_long_texts_are_cut_between_pieces():
    import pyarrow as pa

    text = ("one two three. " * 200_000).encode()
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text.decode()])], names=["lang", "text"])
    chunks = list(C._chunks(iter([batch])))
    assert b"".join(t for _, part in chunks for t in part) == text and len(chunks) > 1
    assert all(t.endswith(b".") for _, part in chunks[:-1] for t in part)


def test_phrases_are_put_together_and_looked_up_once(spark, monkeypatch):
    from pagescout.operators import skew

    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, "en", " ".join(rnd.choices(words, k=30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    # No lookup fits a broadcast, so keys are counted and spread.
    monkeypatch.setattr(C, "fits_broadcast", lambda *_: False)
    lookups = []
    salted = skew.salted_join
    monkeypatch.setattr(skew, "salted_join", lambda left, lookup, key, most, *counted: lookups.append((left, counted)) or salted(left, lookup, key, 50, *counted))
    many = C._outside(C.common_phrases(docs).where("size >= 2"), 3, 50)
    assert "Join" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in C.collocations(docs).collect()} == brute(rows)
    # The parts are counted on what was written, in front of the joins.
    for left, counted in lookups:
        plan = (counted[0] if counted and counted[0] is not None else left)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "uncut" in str((counted[0] if counted and counted[0] is not None else left).inputFiles())
