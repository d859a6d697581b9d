"""Filling containers of fixed capacity by deficit round-robin over source queues.

All documents of a source form a queue in hash order. A schedule says how much of
each queue belongs before any point of the whole output: sources advance in
proportion to their target shares; when one is used up the others share its part
in proportion, and sources without a share come last. A document belongs to the
block of output in which the schedule reaches it (blocks end where a source is
used up), so blocks hold the target proportions up to one document, and what a source is ahead or behind at the start
of a block follows from the prefix sums alone. Blocks are filled in parallel;
within one, each container gives every source its quantum, and the source that is
owed most places its largest document that fits, until no source that is owed
anything has one; the space left goes to the best fit of any queue, on credit.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.plans.lookup import broadcast_if_small, lookup
from weft.plans.storage import materialize

#: Tokens that one task packs.
BLOCK_TOKENS = 1 << 20
#: Documents of a source that are ordered in one task, about.
ROWS_A_SALT = 4000
UNKNOWN = "\u0000unknown"


def schedule(mine: dict, shares: dict) -> dict[str, list[tuple[float, float, float, float]]]:
    """(queue from, queue to, output from, output tokens per queue token) of every source, phase by phase.

    Without positive shares the sources' own sizes are their shares: one phase.
    """
    left, at, used = {s: float(v) for s, v in mine.items() if v > 0}, 0.0, dict.fromkeys(mine, 0.0)
    phases: dict = {s: [] for s in mine}
    while left:
        weights = {s: w for s in left if (w := shares.get(s) or 0.0) > 0} or dict(left)
        total = sum(weights.values())
        length = min(left[s] * total / w for s, w in weights.items())
        for s, w in weights.items():
            took = min(left[s], length * w / total)
            if left[s] - took <= 1e-9 * mine[s]:
                took = left[s]
            phases[s].append((used[s], used[s] + took, at, total / w))
            used[s] += took
            left[s] -= took
        left = {s: v for s, v in left.items() if v > 0}
        at += length
    return phases


def _blocks(phases: dict) -> dict[str, tuple[int, list[tuple[float, float, int, int, float]]]]:
    """Blocks in all, and (queue from, pace, first block, blocks, tokens of a block) of every step of every source; each phase is cut evenly."""
    lengths = {at: (to - begin) * pace for steps in phases.values() for begin, to, at, pace in steps}
    cut, count = {}, 0
    for at in sorted(lengths):
        blocks = max(1, math.ceil(lengths[at] / BLOCK_TOKENS))
        cut[at] = count, blocks, lengths[at] / blocks
        count += blocks
    return {s: (count, [(float(begin), float(pace), *cut[at]) for begin, _, at, pace in steps]) for s, steps in phases.items()}


def fill(sizes: list[int], sources: list, capacity: int, shares: dict, deficits: dict) -> list[tuple[int, int]]:
    """(container, place) of each item, all of at most ``capacity``; ``deficits`` is carried on in place."""
    queues: dict = {}
    for i, (size, source) in enumerate(zip(sizes, sources)):
        queues.setdefault(source, []).append((size, -i))
    for q in queues.values():
        q.sort()
    order = sorted(queues, key=str)
    out: list[tuple[int, int]] = [(-1, -1)] * len(sizes)
    container = 0

    def take(source, at: int, left: int) -> int:
        size, i = queues[source].pop(at)
        out[-i] = (container, capacity - left)
        deficits[source] = deficits.get(source, 0.0) - size
        return left - size

    while any(queues.values()):
        left = capacity
        for source in order:
            deficits[source] = deficits.get(source, 0.0) + capacity * shares.get(source, 0.0)
        while True:
            # the source that is owed most and has something that fits places its largest such document
            for source in sorted((s for s in order if deficits[s] > 0), key=lambda s: (-deficits[s], str(s))):
                at = bisect_right(queues[source], (left, 1)) - 1
                if at >= 0:
                    left = take(source, at, left)
                    break
            else:
                break
        while True:
            # space that is left goes to the best fit of any source, on credit
            fits = [(q[at][0], deficits[s], s, at) for s in order if (q := queues[s]) and (at := bisect_right(q, (left, 1)) - 1) >= 0]
            if not fits:
                break
            _, _, source, at = max(fits, key=lambda f: f[:2])
            left = take(source, at, left)
        container += 1
    return out


def pack(items: DataFrame, options: DataFrame, id: str = "doc_id", source: str = "source", shares: DataFrame | None = None) -> DataFrame:
    """Container and place of every item for every option: option_name, id, piece, container, place, tokens, unused.

    items: id, source, tokens long. options: option_name, capacity_tokens.
    shares: source, share; without it each source has its share of all tokens.
    Containers are numbered in the order of the output, so with given shares the
    first ones hold them, and later ones what is left when sources run out.
    An item longer than the capacity is cut into full containers and a rest;
    pieces count from 0, every other item is whole. ``place`` is the offset in
    the container, ``unused`` what the container has left.

    Defined cases: repeated rows count once; a null source is a source of its
    own; null or negative sizes count as 0; items without tokens are placed too,
    and take no space; options without a positive capacity and null ids are left
    out; no items or no options give no rows; other columns are ignored.
    """
    types = dict(items.dtypes)
    items = items.select(
        F.col(id).alias("id"), F.coalesce(source, F.lit(UNKNOWN)).alias("source"),
        F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long").alias("tokens"),
    ).where("id is not null").distinct()
    items = materialize(items, "pack-items")
    salts = max(1, items.count() // ROWS_A_SALT)
    options = options.select("option_name", F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0").distinct()
    options = materialize(options, "pack-options")
    each = items.crossJoin(broadcast_if_small(options)).withColumn(  # every item once per option
        "rest", F.when(F.col("tokens") <= F.col("capacity"), F.col("tokens")).otherwise(F.col("tokens") % F.col("capacity"))
    )
    each = each.withColumn("order", F.xxhash64("id")).withColumn("salt", F.pmod("order", F.lit(salts)))

    # prefix sums of each queue: over salts, then inside a salt
    salted = each.groupBy("option_name", "source", "salt").agg(F.sum("rest").alias("sum"))
    before = Window.partitionBy("option_name", "source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted = salted.select("option_name", "source", "salt", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    mine: dict = {}  # one number per option and source
    for r in each.groupBy("option_name", "source").agg(F.sum("rest").alias("mine")).toLocalIterator():
        mine.setdefault(r["option_name"], {})[r["source"]] = r["mine"]
    wanted = {}
    if shares is not None:
        wanted = {r["source"]: float(r["share"]) for r in shares.where("share > 0").groupBy("source").agg(F.max("share").alias("share")).collect()}
    plan = [(option, source, *x) for option, own in mine.items() for source, x in _blocks(schedule(own, wanted)).items()]
    step = "struct<`from`: double, pace: double, first: long, blocks: long, size: double>"
    whole = materialize(
        items.sparkSession.createDataFrame(plan, f"option_name {dict(options.dtypes)['option_name']}, source string, blocks long, steps array<{step}>"), "pack-plan"
    )
    inside = Window.partitionBy("option_name", "source", "salt").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    queued = lookup(each.join(salted, ["option_name", "source", "salt"]), whole, ["option_name", "source"]).withColumn(
        "at", F.col("start") + F.coalesce(F.sum("rest").over(inside), F.lit(0))
    )
    # the step that holds a point of the queue, and the block of it
    step = F.aggregate("steps", F.col("steps")[0], lambda x, p: F.when(F.col("at") >= p["from"], p).otherwise(x))
    queued = queued.withColumn("step", F.when(F.size("steps") > 0, step))
    inner = F.least(F.floor((F.col("at") - F.col("step.from")) * F.col("step.pace") / F.col("step.size")), F.col("step.blocks") - 1)
    queued = queued.withColumn("block", F.coalesce(F.col("step.first") + inner, F.pmod("salt", F.greatest("blocks", F.lit(1)))).cast("long"))
    due = F.col("step.from") + (F.col("block") - F.col("step.first")) * F.col("step.size") / F.col("step.pace")
    queued = queued.withColumns({"due": F.coalesce(due, F.lit(0.0)), "share": F.coalesce(1 / F.col("step.pace"), F.lit(0.0))})
    queued = materialize(queued.select("option_name", "capacity", "block", "source", "share", "due", "order", "id", "tokens", "rest"), "pack-queued")
    ahead = Window.partitionBy("option_name", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    got = queued.groupBy("option_name", "block", "source").agg(F.sum("rest").alias("sum"), F.first("due").alias("due")).select(
        "option_name", "block", "source", (F.col("due") - F.coalesce(F.sum("sum").over(ahead), F.lit(0))).alias("deficit")
    )

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["order", "id"], kind="stable")
        capacity, block = int(batch["capacity"].iloc[0]), int(batch["block"].iloc[0])
        totals = batch.groupby("source")["rest"].sum()
        own = dict(zip(batch["source"], batch["share"]))
        if sum(own.values()) <= 0:
            own = (totals / max(1, totals.sum())).to_dict()
        deficits = dict(zip(batch["source"], batch["deficit"].astype(float)))
        loose = batch[(batch["rest"] > 0) | (batch["tokens"] == 0)]
        spots = fill(loose["rest"].tolist(), loose["source"].tolist(), capacity, own, deficits)
        found = np.array(spots, dtype=np.int64).reshape(-1, 2)
        rows = pd.DataFrame(
            {
                "id": loose["id"], "piece": np.where(loose["tokens"] > capacity, loose["tokens"] // capacity, 0),
                "container": found[:, 0], "place": found[:, 1], "tokens": loose["rest"],
            }
        )
        long = batch[batch["tokens"] > capacity]
        full = (long["tokens"] // capacity).to_numpy()
        if len(long):
            first = int(found[:, 0].max()) + 1 if len(found) else 0
            count = int(full.sum())
            rows = pd.concat(
                [
                    rows,
                    pd.DataFrame(
                        {
                            "id": np.repeat(long["id"].to_numpy(), full), "piece": np.arange(count) - np.repeat(np.cumsum(full) - full, full),
                            "container": first + np.arange(count), "place": 0, "tokens": capacity,
                        }
                    ),
                ]
            )
        used = rows.groupby("container")["tokens"].transform("sum")
        rows["unused"] = capacity - used
        rows["container"] += block << 32
        rows.insert(0, "option_name", batch["option_name"].iloc[0])
        return rows

    placed = queued.join(got, ["option_name", "block", "source"]).groupBy("option_name", "block").applyInPandas(
        one, f"option_name string, id {types[id]}, piece long, container long, place long, tokens long, unused long"
    )
    return placed.withColumnRenamed("id", id)
