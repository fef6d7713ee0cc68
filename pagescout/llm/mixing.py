"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in order of id, are cut into blocks. With weight w, block j of a
source is released at slot floor(j / w) and due by slot ceil((j + 1) / w); each slot goes to the
released block with the earliest deadline. Weights are multiples of 1 / quantum, so the schedule
repeats after ``quantum`` slots: one round is laid out, all others follow from it. At every slot
up to which no source has run out, each source is less than one block away from its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagescout.operators.skew import rank_in_group
from pagescout.storage import materialize

BLOCK = 16
QUANTUM = 1000


def shares(sources: DataFrame, weight: Column, quantum: int = QUANTUM) -> DataFrame:
    """``source, share, quantum``: whole parts of the quantum in proportion to ``weight``, one at least.

    One row per source meets in a window; the number of sources, not of documents, bounds it.
    What rounding leaves goes to the largest remainders, then to the first names.
    """
    every = Window.partitionBy(F.lit(0))
    size = F.greatest(F.lit(quantum), 2 * F.count("*").over(every))
    exact = (F.col("_size") - F.count("*").over(every)) * F.col("_w") / F.sum("_w").over(every)
    left = F.col("_size") - F.sum("_part").over(every)
    rank = F.row_number().over(every.orderBy(F.round(F.col("_exact") - F.floor("_exact"), 9).desc(), "source"))
    return (
        sources.withColumn("_w", weight.cast("double"))
        .withColumn("_size", size.cast("long"))
        .withColumn("_exact", exact)
        .withColumn("_part", 1 + F.floor(F.round("_exact", 9)))
        .withColumns({"_left": left, "_rank": rank})
        .select("source", (F.col("_part") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("share"), F.col("_size").alias("quantum"))
    )


def one_round(shares_: DataFrame) -> DataFrame:
    """``source, share, quantum, turn, slot``: the slots of one round, by earliest deadline first."""
    row = shares_.agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("all"), F.max("quantum").alias("quantum"))

    def step(state: Column, slot: Column) -> Column:
        def due(done: Column, k: Column) -> Column:
            share = F.col("all")[k]["share"]
            released = F.floor(done * F.col("quantum") / share)
            deadline = F.ceil((done + 1) * F.col("quantum") / share)
            return F.struct((released > slot).alias("waits"), deadline.alias("deadline"), k.alias("k"), done.alias("turn"))

        pick = F.array_min(F.transform(state["done"], due))
        return F.struct(
            F.transform(state["done"], lambda done, k: done + (k == pick["k"]).cast("long")).alias("done"),
            F.concat(state["slots"], F.array(F.struct(pick["k"].alias("k"), pick["turn"].alias("turn")))).alias("slots"),
        )

    start = F.struct(F.transform("all", lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<struct<k: int, turn: bigint>>").alias("slots"))
    laid = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("quantum") - 1), start, step, lambda s: s["slots"])
    return (
        row.where(F.size("all") > 0)
        .select("all", "quantum", F.posexplode(laid).alias("slot", "_at"))
        .select(F.col("all")[F.col("_at.k")].alias("_s"), "quantum", F.col("_at.turn").alias("turn"), F.col("slot").cast("long").alias("slot"))
        .select("_s.source", "_s.share", "quantum", "turn", "slot")
    )


def interleave(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, quantum: int = QUANTUM, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with ``mix_slot`` and ``mix_place``: order by both to get the mixture.

    ``weights`` gives the target weight of sources; one that it does not name counts as 1. Without
    it the square root of a source's size is its weight. Every row is kept: where a source has
    run out, its slots stay empty. A NULL source is the source ''. Rows of one id in one source
    stand next to each other. ``mix_slot`` and ``mix_place`` replace columns of these names. No
    window holds a source: ranks come from a range sort. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("mix_slot", "mix_place")]
    rows = docs.select(
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(id_col).alias("id"), F.struct(*kept).alias("row")
    )
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.sqrt("n")
    else:
        known = [F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()]
        weight = F.coalesce(*known, F.lit(1.0))
    # The round has max(quantum, 2 x sources) rows and is wanted twice nowhere, but costs a fold.
    plan = materialize(one_round(shares(sizes, weight, quantum)), "mix-round")
    ranked = rank_in_group(rows, "source", ["id"], "_rank")
    number = F.floor((F.col("_rank") - 1) / block)
    share = plan.groupBy("source").agg(F.first("share").alias("share"), F.first("quantum").alias("quantum"))
    placed = (
        ranked.withColumn("_block", number)
        .join(F.broadcast(share), "source")
        .withColumns({"_round": F.floor(F.col("_block") / F.col("share")), "turn": F.col("_block") % F.col("share")})
    )
    slot = F.col("_round") * F.col("quantum") + F.col("slot")
    return placed.join(F.broadcast(plan.select("source", "turn", "slot")), ["source", "turn"]).select(
        "row.*", slot.alias("mix_slot"), ((F.col("_rank") - 1) % block).cast("int").alias("mix_place")
    )
