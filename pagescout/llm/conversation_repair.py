"""Repair of the structure of conversations by the cheapest edits, found once for all equal endings.

A row becomes one letter: its role (``s``, ``u``, ``a``, else ``o``; a capital where its text is cut
off) or ``x`` where it is blank or repeats an earlier row and has to go. The letters of up to ``SEGMENT``
rows are a signature. All different signatures, sorted from their ends, are the paths of an acyclic
word graph whose nodes are shared endings; each node gets, once, the least cost and the least audit from
every state of the grammar ``(s?(ua)+)?`` to every other. A conversation longer than one segment is put
together from these tables, so no task ever holds a conversation.

Insertions count to the row behind them. So two audits of the same rows are never each other's beginning,
and the smaller one is known from the first edits in which they differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescout.operators.skew import lookup_join, rank_in_group
from pagescout.storage import materialize

#: Rows of a conversation that are solved at one time.
SEGMENT = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The grammar: from a state with a role to a state.
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What has to be inserted behind the last row to end well, as cost and audit.
ENDING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
NAMES = {"u": "user", "a": "assistant"}
_BLANK, _LAST = "[\\x20\\x09-\\x0D]", "[.!?]"


@lru_cache(maxsize=1)
def steps() -> dict[tuple[int, str], list[tuple[int, str, int]]]:
    """For a state and a letter: the best edits towards each next state as ``(cost, audit, state)``."""
    out = {}
    for state in range(4):
        for letter in "suaoSUAOx":
            found = [(DELETE, "D", state)]
            ways = [(0, "", state)]
            for _ in range(2):
                ways += [(c + INSERT, a + "I", MOVES[s, r]) for c, a, s in ways for r in NAMES if (s, r) in MOVES]
            if letter != "x":
                broken = TRUNCATED * letter.isupper()
                for c, a, s in set(ways):
                    if (s, letter.lower()) in MOVES:
                        found.append((c + KEEP + broken, a + "K", MOVES[s, letter.lower()]))
                    found += [(c + REROLE + broken, a + "R", MOVES[s, r]) for r in NAMES if (s, r) in MOVES]
            out[state, letter] = [min(f for f in found if f[2] == end) for end in range(4) if any(f[2] == end for f in found)]
    return out


def solve(endings: Iterator[str]) -> Iterator[tuple[str, list, list, list]]:
    """``(signature, costs, ranks, audits)`` of sorted reversed signatures, 16 values each (from state x to state).

    Sorted from the end, signatures with one ending follow each other: the path of nodes stands in
    a list, and only the nodes behind the common part are new. It is as long as one signature.
    """
    table = steps()
    path = [([[0 if s == e else None for e in range(4)] for s in range(4)], None)]
    before = ""
    for ending in endings:
        shared = 0
        while shared < min(len(before), len(ending)) and before[shared] == ending[shared]:
            shared += 1
        del path[shared + 1 :]
        for letter in ending[shared:]:
            tail = path[-1][0]
            costs, picks = [], []
            for s in range(4):
                ways = table[s, letter]
                best = [min(((c + tail[n][e], a, n) for c, a, n in ways if tail[n][e] is not None), default=(None, None, None)) for e in range(4)]
                costs.append([b[0] for b in best])
                picks.append([b[1:] for b in best])
            path.append((costs, picks))
        before = ending
        audits = []
        for s in range(4):
            for e in range(4):
                if path[-1][0][s][e] is None:
                    audits.append(None)
                    continue
                state, parts = s, []
                for _, picks in path[:0:-1]:
                    part, state = picks[state][e]
                    parts.append(part)
                audits.append("".join(parts))
        ranks = []
        for s in range(4):
            mine = sorted(a for a in audits[4 * s : 4 * s + 4] if a is not None)
            ranks += [None if a is None else mine.index(a) for a in audits[4 * s : 4 * s + 4]]
        yield ending[::-1], [c for row in path[-1][0] for c in row], ranks, audits


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
_ARROW |= {f"array<{k}>": pa.list_(v) for k, v in _ARROW.items()}


def _packed(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    fields = pa.schema([(n, _ARROW[t]) for n, t in (c.split(" ") for c in schema.split(", "))])
    out, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    for row in rows:
        out.append(row)
        held += 1 + sum(len(v) for v in row if isinstance(v, str | list))
        if held > 1 << 16:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


def _mapped(df: DataFrame, schema: str, run: Callable[[Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """``run`` over the rows of each partition, one after the other."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for at in range(0, batch.num_rows, 512) for row in batch.slice(at, 512).to_pylist())
        return _packed(run(rows), schema)

    return df.mapInArrow(task, schema)


def _streamed(df: DataFrame, order: list[Column | str], schema: str, run: Callable[[Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """``run`` over the rows of whole conversations, in order, never a conversation at once."""
    return _mapped(df.repartition("conv").sortWithinPartitions("conv", *order), schema, run)


def damage(conversations: DataFrame) -> DataFrame:
    """``conv, conv_id, turn, role, text`` after the damage that tests repair with.

    ``crc32`` of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats
    it, 4 makes it the user's. NULL counts as one space in ids, roles, texts and the key; ``turn`` itself stays NULL.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", _LAST, "")).otherwise(F.col("text"))
    return (
        named(conversations)
        .withColumn("_kind", kind)
        .where("_kind != 0")
        .select(
            "conv", "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
            F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def named(conversations: DataFrame) -> DataFrame:
    """``conv, conv_id, turn, role, text``: ``conv`` is never NULL, NULL roles and texts are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return conversations.select(conv.alias("conv"), "conv_id", "turn", space("role"), space("text"))


class Repair:
    """The tables of a repair: :meth:`summary` a row per conversation, :meth:`rows` the repaired rows.

    ``rows`` comes from :func:`named` or :func:`damage`. Within a conversation, rows follow ``turn`` (NULL first), then
    role, then the MD5 of the text; equal rows are neighbours. A row's first fault counts: blank, duplicate, truncated.
    The tables between the steps are written to the shared folder.
    """

    def __init__(self, rows: DataFrame, segment: int = SEGMENT):
        spark = rows.sparkSession
        keyed = rows.withColumn("print", F.unhex(F.md5("text")))
        #: Rows with their place in the conversation, from 0.
        self.placed = materialize(
            rank_in_group(keyed.withColumn("_turn", F.coalesce(F.col("turn"), F.lit(-(2**63)))), "conv", ["_turn", F.col("turn").isNotNull(), "role", "print"], "pos")
            .withColumn("pos", F.col("pos") - 1).drop("_turn"),
            "conversation-rows",
        )
        first = F.substring("role", 1, 1)
        last = F.regexp_extract("text", f"(?s)([^\\x20\\x09-\\x0D]){_BLANK}*\\z", 1)
        narrow = self.placed.select(
            "conv", "pos", F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"),
            F.unhex(F.md5(F.concat(F.col("role"), F.lit("\n"), F.hex("print")))).alias("same"),
            (last == "").alias("blank"), (~last.rlike(_LAST)).alias("cut"),
        )
        firsts = narrow.groupBy("conv", "same").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("new"))
        fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("cut"), "truncated")
        judged = narrow.join(firsts, ["conv", "pos"], "left").withColumn("fault", fault)
        letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
        in_order = F.array_sort(F.collect_list(F.struct("pos", letter.alias("letter"), "initial")))
        parts = (
            judged.withColumn("segment", F.floor(F.col("pos") / segment))
            .groupBy("conv", "segment")
            .agg(in_order.alias("rows"), *[F.sum((F.col("fault").eqNullSafe(k)).cast("long")).alias(k) for k in ("blank", "duplicate", "truncated")])
        )
        pairs = F.zip_with(F.slice("rows", 1, F.size("rows") - 1), F.slice("rows", 2, F.size("rows")), lambda a, b: F.concat(a["initial"], b["initial"]))
        legal = ["su", "ua", "au"]
        #: Segments with their signature and counts.
        self.segments = materialize(
            parts.select(
                "conv", "segment", F.array_join(F.transform("rows", lambda r: r["letter"]), "").alias("signature"),
                F.size(F.filter(pairs, lambda p: ~p.isin(legal))).cast("long").alias("illegal"),
                F.col("rows")[0]["initial"].alias("first"), F.element_at("rows", -1)["initial"].alias("last"), "blank", "duplicate", "truncated",
            ),
            "segments",
        )
        reverse = self.segments.select(F.reverse("signature").alias("ending")).distinct()
        solved = materialize(
            _mapped(
                reverse.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "ending").sortWithinPartitions("ending"),
                "signature string, costs array<long>, ranks array<int>, audits array<string>",
                lambda rows: solve(r["ending"] for r in rows),
            ),
            "signatures",
        )
        with_costs = lookup_join(self.segments.select("conv", "segment", "signature"), solved.select("signature", "costs", "ranks"), "signature")
        backward = _streamed(with_costs.drop("signature"), [F.desc("segment")], "conv string, segment long, ends array<int>, cost long", _choose)
        self.ways = materialize(_streamed(backward, ["segment"], "conv string, segment long, start int, end int, tail string, cost long", _walk), "ways")
        chosen = self.ways.join(self.segments.select("conv", "segment", "signature"), ["conv", "segment"])
        audit = F.concat(F.col("audits")[F.col("start") * 4 + F.col("end")], F.col("tail"))
        #: Audits of segments, with the state they start in.
        self.audits = materialize(
            lookup_join(chosen, solved.select("signature", "audits"), "signature").select(
                "conv", "segment", (F.col("segment") * segment).alias("pos"), "start", "signature", audit.alias("audit")
            ),
            "audits",
        )

    def rows(self) -> DataFrame:
        """``conv, pos, sub, role, text``: the repaired rows, in the order of ``pos, sub``; inserted ones have empty texts."""
        edits = _mapped(self.audits, "conv string, pos long, inserted array<string>, role string", _edits)
        text = self.placed.select("conv", "pos", F.col("role").alias("old"), "text")
        lines = F.concat(
            F.transform("inserted", lambda r: F.struct(r.alias("role"), F.lit("").alias("text"))),
            F.when(F.col("role") == "", F.array().cast("array<struct<role:string,text:string>>")).otherwise(
                F.array(F.struct(F.when(F.col("role") == "=", F.col("old")).otherwise(F.col("role")).alias("role"), F.col("text").alias("text")))
            ),
        )
        return edits.join(text, ["conv", "pos"], "left").select("conv", "pos", F.posexplode(lines).alias("sub", "line")).select("conv", "pos", "sub", "line.*")

    def summary(self) -> DataFrame:
        """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation with rows."""
        turns = self.placed.groupBy("conv", "turn").agg(F.lit(1).alias("one")).where("turn IS NOT NULL").groupBy("conv").agg(
            (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")
        )
        before = self.segments.select("conv", (F.col("segment") + 1).alias("segment"), F.col("last").alias("previous"))
        seam = self.segments.join(before, ["conv", "segment"], "left").withColumn(
            "illegal", F.col("illegal") + (~F.concat("previous", "first").isin("su", "ua", "au") & F.col("previous").isNotNull()).cast("long")
        )
        counts = seam.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
        cost = self.ways.where("segment = 0").select("conv", "cost")
        audit = self.audits.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("segment", "audit"))).alias("parts")).select(
            "conv", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit")
        )
        return counts.join(turns, "conv", "left").join(cost, "conv").join(audit, "conv").withColumn("gaps", F.coalesce("gaps", F.lit(0)))

    def hashes(self) -> DataFrame:
        """``conv, repaired_sha256``: of the repaired ``role:text`` lines, read as a stream."""
        return _streamed(self.rows(), ["pos", "sub"], "conv string, repaired_sha256 string", _hash)


def _choose(rows: Iterator[dict]) -> Iterator[tuple]:
    """From the last segment to the first: for each start the best end, and the cost to go from the start state."""
    conv, ahead = None, None
    for r in rows:
        if r["conv"] != conv:
            conv, ahead = r["conv"], [ENDING[s][0] for s in range(4)]
        ends, now = [], []
        for s in range(4):
            ways = [(r["costs"][4 * s + e] + ahead[e], r["ranks"][4 * s + e], e) for e in range(4) if r["costs"][4 * s + e] is not None and ahead[e] is not None]
            best = min(ways, default=(None, None, None))
            now.append(best[0])
            ends.append(best[2])
        ahead = now
        yield conv, r["segment"], ends, now[START]


def _walk(rows: Iterator[dict]) -> Iterator[tuple]:
    """From the first segment to the last: the states it starts and ends in."""
    held = None
    for r in rows:
        start = START
        if held is not None:
            start = held[3] if held[0] == r["conv"] else START
            yield (*held[:4], "" if held[0] == r["conv"] else ENDING[held[3]][1], held[4])
        held = (r["conv"], r["segment"], start, r["ends"][start], r["cost"])
    if held is not None:
        yield (*held[:4], ENDING[held[3]][1], held[4])


def _edits(rows: Iterator[dict]) -> Iterator[tuple]:
    """Audits as one row per row of the conversation (and one behind the last), with the roles that were meant."""
    for r in rows:
        state, pos, inserted, letters = r["start"], r["pos"], [], iter(r["signature"].lower())
        for edit in r["audit"]:
            role = "a" if state == USER else "u"
            if edit == "I":
                inserted.append(NAMES[role])
                state = MOVES[state, role]
                continue
            letter = next(letters)
            if edit != "D":
                state = MOVES[state, letter if edit == "K" else role]
            yield r["conv"], pos, inserted, {"D": "", "K": "="}.get(edit, NAMES[role])
            pos, inserted = pos + 1, []
        if inserted:
            yield r["conv"], pos, inserted, ""


def _hash(rows: Iterator[dict]) -> Iterator[tuple]:
    conv, sha = None, None
    for r in rows:
        if r["conv"] != conv:
            if sha is not None:
                yield conv, sha.hexdigest()
            conv, sha = r["conv"], hashlib.sha256()
        else:
            sha.update(b"\n")
        sha.update(f"{r['role']}:{r['text']}".encode())
    if sha is not None:
        yield conv, sha.hexdigest()


def repair(conversations: DataFrame, damaged: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for every id of ``conversations``.

    ``damaged`` (from :func:`damage`) stands for the rows to be repaired where these are not the given ones. A conversation
    without rows has zeros, an empty audit and the hash of the empty text; NULL is an id like others; an empty table gives an
    empty result; other columns are not read. Repeated rows are duplicates of each other.
    """
    ids = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    fixed = Repair(named(conversations) if damaged is None else damaged, segment)
    found = ids.join(fixed.summary(), "conv", "left").join(fixed.hashes(), "conv", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
