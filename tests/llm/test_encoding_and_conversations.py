import hashlib
import itertools
import random
import re
import zlib

import pytest

from pagescout.llm import conversation_repair as C
from pagescout.llm import piece_encoding as P

ODD = [(None, None), (1, ""), (2, " \n\t "), (3, "a " * 30_000), (3, "a " * 30_000), (4, "x" * 50_000), (5, "Ünïcode ßtraße 漢字 \U0001f600 ① ▁x"), (6, "one"), (7, " " * 5_000)]


def digest(ids, text):
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.model_path())


def test_pieces_equal_the_library(library):
    model, rnd = P.PieceModel(P.model_path()), random.Random(3)
    parts = [" ", "  ", "▁", "\n", "\t", "a", "the", "ing", " in", "é", "ﬁ", "①", "\U0001f600", "中", "0", "<s>", "<0x41>", "\x00", "　", "’", "tion", "er", ")", "!!"]
    pieces = [p.replace("▁", " ") for p in model.score]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))) for _ in range(2000)]
    texts += ["".join(rnd.choice(pieces).strip() for _ in range(3000)), " " * 1001, "a" * 1001]
    for text in texts:
        ids = library.encode(text)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)
    for _ in range(3000):
        ids = [rnd.choice([rnd.randint(0, 300), rnd.randint(0, 31_999)]) for _ in range(rnd.randint(1, 6))]
        assert model.decode(ids) == library.decode(ids)


def test_cover_equals_merging():
    """Backtracking against plain merging, on words whose tokens compete."""
    model, rnd = P.PieceModel(P.model_path()), random.Random(4)
    short = [p for p in model.tokens if 1 < len(p) < 6 and p.isascii()]
    for _ in range(3000):
        word = "".join(rnd.choice(short) for _ in range(rnd.randint(1, 4)))
        assert [model.tokens[t] for t in model.cover(word)] == model.merge(word)


def test_encoding_of_odd_rows(spark, library):
    docs = spark.createDataFrame([(i, t, "z", None) for i, t in ODD], "doc_id long, text string, ids string, n_tokens string")
    got = P.digest(P.decode_ids(P.encode_texts(docs))).collect()
    want = [(i, *digest(ids := library.encode(t or ""), library.decode(ids))) for i, t in ODD]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert P.encode_texts(docs.where("false")).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [3 + 0xC3, 3 + 0xC3])], "doc_id long, ids array<int>")
    assert [r["text"] for r in P.decode_ids(lists).orderBy("doc_id").collect()] == ["", "", "��"]


SPACE = " \t\n\v\f\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if not text.strip(SPACE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if text.rstrip(SPACE)[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, found):
    """All edits with at most two insertions in one place, the cheapest and least by plain enumeration."""
    best = None
    for inserts in itertools.product(["", "I", "II"], repeat=len(rows) + 1):
        if sum(map(len, inserts)) > 4:
            continue
        for kinds in itertools.product("DKR", repeat=len(rows)):
            if any(f in ("blank", "duplicate") and k != "D" for f, k in zip(found, kinds, strict=True)):
                continue
            audit = "".join(i + k for i, k in zip(inserts, [*kinds, ""], strict=True))
            cost = 5 * audit.count("I") + 2 * audit.count("D") + audit.count("R") + 5 * sum(f == "truncated" and k != "D" for f, k in zip(found, kinds, strict=True))
            if best and (cost, audit) >= best[:2]:
                continue
            pattern, kept = [], iter(zip(rows, kinds, strict=True))
            for c in audit:
                row = next(kept)[0] if c != "I" else None
                if c != "D":
                    pattern.append(row[1][:1] or "-" if c == "K" else "?")
            for first in ("", "s"):
                roles = first + "ua" * ((len(pattern) + 1 - len(first)) // 2)
                if roles == "s" or len(roles) != len(pattern) or any(p not in ("?", r) or (p == "?" and r == "s") for p, r in zip(pattern, roles, strict=True)):
                    continue
                names, kept, lines = {"u": "user", "a": "assistant"}, iter(rows), []
                at = iter(roles)
                for c in audit:
                    row = next(kept) if c != "I" else None
                    if c != "D":
                        r = next(at)
                        lines.append(f"{row[1] if c == 'K' else names[r]}:{row[2] if row else ''}")
                best = (cost, audit, "\n".join(lines))
    return best


def md5(text):
    return hashlib.md5(text.encode()).digest()


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r[2])))
    found = faults(rows)
    turns = {r[0] for r in rows if r[0] is not None}
    firsts = [r[1][:1] for r in rows]
    cost, audit, said = every_edit(rows, found)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False)), cost, audit, hashlib.sha256(said.encode()).hexdigest(),
    )


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "user", "assistant", "", "umpire"]
    texts = ["Yes.", "No", "  ", "Well! \n", "Why?", "", "é.", "line\nend.", "x"]
    return {c: [(rnd.choice([0, 1, 2, 3, 9, None]), rnd.choice(roles), rnd.choice(texts)) for _ in range(rnd.randint(0, 5))] for c in range(120)}


def test_repair_equals_enumeration(spark, talks):
    given = [(c, *r, 1) for c, rows in talks.items() for r in rows] + [(None, None, None, None, 1)]
    table = spark.createDataFrame(given, "conv_id long, turn long, role string, text string, audit long")
    want = {(c, *brute(rows)) for c, rows in talks.items() if rows} | {(None, *brute([(None, " ", " ")]))}
    for segment in (2, C.SEGMENT):
        assert {tuple(r) for r in C.repair(table, segment=segment).collect()} == want
    assert C.repair(table.where("false")).count() == 0


def test_damage(spark):
    rows = [(c, t, role, "Yes. Why?") for c in range(60) for t, role in [(0, "system"), (1, "assistant"), (None, None)]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want += [(c, t, "user" if kind == 4 else role or " ", text)] * {0: 0, 3: 2}.get(kind, 1)
    got = [tuple(r) for r in C.damage(table).select("conv_id", "turn", "role", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    gone = C.repair(table, C.damage(table).where("false")).where("conv_id = 5").collect()
    assert [tuple(r) for r in gone] == [(5, 0, 0, 0, 0, 0, 0, "", empty)]


def test_a_long_conversation_is_solved_in_parts(spark):
    rnd = random.Random(9)
    rows = [(1, t, rnd.choice(["user", "assistant", "tool"]), rnd.choice([f"{t}.", f"{t}", " "])) for t in range(700)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, parts = C.repair(table).collect(), C.repair(table, segment=16).collect()
    assert whole == parts
    fixed = C.Repair(C.named(table), 16).rows().orderBy("pos", "sub").collect()
    assert re.fullmatch("(ua)+", "".join(r["role"][0] for r in fixed))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in fixed).encode()).hexdigest() == whole[0]["repaired_sha256"]
