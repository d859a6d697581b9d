"""Mixing sources to target shares of all tokens, by entropy balancing.

Rates r of the documents are sought that differ least (in relative entropy,
weighed by tokens) from using every document once, so that each source gives
its share of the tokens, the mean log length of the mix stays that of the
documents it is drawn from, and no rate exceeds the source's cap. The solution
is r = min(cap, exp(a_source + b * log length)); a and b minimise a convex dual
function by damped Newton steps, each of which is one distributed aggregation.
Rates become whole numbers of copies by systematic rounding along each source in
order of length, and the rest of each source is mended by a copy of the best size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.plans.lookup import lookup
from weft.plans.storage import materialize

#: Newton steps at most; shares say how many were taken and how far the rates are from their targets after them.
STEPS = 60
TOLERANCE = 1e-7
ROWS_A_SALT = 100_000
#: Sources change one copy at a time until they miss their tokens by no more than this share, or no copy brings them nearer; so often at most.
NEAR_ENOUGH, CORRECTIONS = 1e-4, 8
#: A source that needs more of its capped tokens than this gives all it may.
SATURATED = 0.999


def _dual(groups: DataFrame, names: list[str], a: np.ndarray, b: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and Hessian of the dual function without its linear term, in shares of all tokens."""
    lam = F.element_at(F.create_map(*[x for n, v in zip(names, a) for x in (F.lit(n), F.lit(float(v)))]), F.col("source"))
    raw = lam + F.lit(float(b)) * F.col("x")
    free = raw < F.log("cap")
    rate = F.when(free, F.exp(F.least(raw, F.lit(50.0)))).otherwise(F.col("cap"))
    # of a clipped rate the value grows along its tangent
    value = F.when(free, rate).otherwise(F.col("cap") * (1 + raw - F.log("cap")))
    slope = F.when(free, rate).otherwise(0.0)
    w = F.col("tokens")
    rows = groups.groupBy("source").agg(
        F.sum(w * value).alias("v"), F.sum(w * rate).alias("g"), F.sum(w * rate * F.col("x")).alias("gx"),
        F.sum(w * slope).alias("h"), F.sum(w * slope * F.col("x")).alias("hx"), F.sum(w * slope * F.col("x") * F.col("x")).alias("hxx"),
    ).collect()  # one row per source
    d = len(names)
    value, grad, hess = 0.0, np.zeros(d + 1), np.zeros((d + 1, d + 1))
    for r in rows:
        i = names.index(r["source"])
        value += r["v"]
        grad[i], grad[d] = r["g"], grad[d] + r["gx"]
        hess[i, i], hess[i, d], hess[d, i] = r["h"], r["hx"], r["hx"]
        hess[d, d] += r["hxx"]
    return value, grad, hess


def solve(groups: DataFrame, names: list[str], wanted: np.ndarray, mean_x: float) -> tuple[np.ndarray, float, int, float]:
    """a per source, b, the number of Newton steps, and the largest relative miss of a source's tokens."""
    d = len(names)
    target = np.append(wanted, wanted.sum() * mean_x)
    at = np.zeros(d + 1)
    own = {r["source"]: r["t"] for r in groups.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    at[:d] = [np.log(w / own[n]) for n, w in zip(names, wanted)]
    value, grad, hess = _dual(groups, names, at[:d], at[d])
    for step in range(STEPS):
        miss = grad - target
        if np.abs(miss[:d] / wanted).max() < TOLERANCE and abs(miss[d]) < TOLERANCE * max(1.0, abs(target[d]), wanted.sum()):
            return at[:d], at[d], step, float(np.abs(miss[:d] / wanted).max())
        move = -np.linalg.solve(hess + 1e-12 * np.trace(hess) * np.eye(d + 1), miss)
        scale, slope = min(1.0, 5.0 / max(np.abs(move).max(), 1e-12)), miss @ move
        while True:
            new = at + scale * move
            found = _dual(groups, names, new[:d], new[d])
            if found[0] - target @ new <= value - target @ at + 1e-4 * scale * slope + 1e-9 * abs(value) or scale < 1e-4:
                break
            scale /= 2
        at, (value, grad, hess) = new, found
    return at[:d], at[d], STEPS, float(np.abs((grad - target)[:d] / wanted).max())


def _corrected(rounded: DataFrame, wanted: dict[str, float]) -> DataFrame | None:
    """One copy more or less, per source, of the document whose size is nearest to what the source lacks or has too much; None if all are near enough."""
    have = {r["source"]: r["t"] for r in rounded.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    lack = {n: w - have.get(n, 0) for n, w in wanted.items() if abs(w - have.get(n, 0)) > NEAR_ENOUGH * w}
    if not lack:
        return None
    lacks = F.element_at(F.create_map(*[x for n, v in lack.items() for x in (F.lit(n), F.lit(float(v)))]), F.col("source"))
    off = F.abs(F.abs("lack") - F.col("tokens"))
    can = F.when(F.col("lack") > 0, F.col("copies") < F.col("cap")).otherwise(F.col("copies") > 0)
    pick = (
        rounded.where(F.col("source").isin(list(lack))).withColumn("lack", lacks).where(can & (off < F.abs("lack")))
        .groupBy("source").agg(F.min(F.struct(off.alias("off"), "id", F.signum("lack").cast("int").alias("change"))).alias("p"))
        .select("p.id", "p.change")
    )
    pick = materialize(pick, "mix-pick")  # one row per source at most
    if not pick.count():
        return None
    return materialize(
        rounded.join(F.broadcast(pick), "id", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change"), "mix-rounded"
    )


def mix(items: DataFrame, targets: DataFrame, id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(chosen: id, source, tokens, rate, copies >= 1; shares: one row per target source with what it was to give and gives).

    items: id, source, tokens. targets: source, weight, max_repeats. The mix is
    as large as the caps allow with exact shares. Target sources without tokens
    cannot give anything; the others share their weight in proportion, which
    ``wanted_share`` shows. Sources that are no target are not used. ``rate_miss``
    is what the rates miss a source's tokens by, relatively, before rounding.

    Defined cases: repeated rows count once, null ids and sources are left out,
    items without tokens are never chosen, null or non-positive weights and caps
    make a source give nothing; of several target rows of a source the one of
    the largest weight holds; no usable source gives no chosen rows; other
    columns are ignored.
    """
    targets = (
        targets.select("source", F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("double").alias("cap"))
        .where("source is not null").groupBy("source")
        .agg(F.max(F.struct(F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("cap", F.lit(0.0)).alias("cap"))).alias("t"))
        .select("source", "t.weight", "t.cap")
    )
    items = items.select(F.col(id).alias("id"), "source", F.col("tokens").cast("long").alias("tokens")).where("id is not null and tokens > 0").distinct()
    items = materialize(lookup(items, materialize(targets.where("weight > 0 and cap >= 1"), "mix-targets"), ["source"]), "mix-items")
    own = {r["source"]: r for r in items.groupBy("source").agg(F.sum("tokens").alias("t"), F.first("weight").alias("w"), F.first("cap").alias("cap")).collect()}
    names = sorted(own)
    weight = sum(own[n]["w"] for n in names)
    size = min((own[n]["t"] * own[n]["cap"] * weight / own[n]["w"] for n in names), default=0.0)
    wanted = {n: size * own[n]["w"] / weight for n in names}

    full = [n for n in names if wanted[n] >= SATURATED * own[n]["t"] * own[n]["cap"]]
    free = [n for n in names if n not in full]
    total = float(sum(r["t"] for r in own.values())) or 1.0
    groups = items.where(F.col("source").isin(free)).groupBy("source", "cap", F.col("tokens").alias("n")).agg((F.sum("tokens") / total).alias("tokens"))
    mean = groups.agg(F.sum(F.col("tokens") * F.log("n")) / F.sum("tokens")).first()[0] or 0.0
    groups = materialize(groups.withColumn("x", F.log("n") - F.lit(mean)), "mix-groups")
    a, b, steps, miss = np.zeros(0), 0.0, 0, 0.0
    if free:
        a, b, steps, miss = solve(groups, free, np.array([wanted[n] / total for n in free]), 0.0)

    lam = {n: float(v) for n, v in zip(free, a)}
    rate = F.col("cap")
    if lam:
        known = F.create_map(*[x for n, v in lam.items() for x in (F.lit(n), F.lit(v))])
        tilted = F.exp(F.least(F.element_at(known, F.col("source")) + F.lit(float(b)) * (F.log("tokens") - F.lit(mean)), F.lit(50.0)))
        rate = F.when(F.col("source").isin(free), F.least(F.col("cap"), tilted)).otherwise(F.col("cap"))
    rated = items.withColumn("rate", rate).withColumn("order", F.xxhash64("id")).withColumn("band", F.floor(F.log2("tokens") * 8))

    salts = max(1, items.count() // ROWS_A_SALT)
    rated = rated.withColumn("salt", F.pmod("order", F.lit(salts)))
    sums = rated.groupBy("source", "band", "salt").agg(F.sum("rate").alias("sum"))
    before = Window.partitionBy("source").orderBy("band", "salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "band", "salt", F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("start"))
    inside = Window.partitionBy("source", "band", "salt").orderBy("tokens", "order", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rated.join(sums, ["source", "band", "salt"]).withColumn("at", F.col("start") + F.coalesce(F.sum("rate").over(inside), F.lit(0.0)) + 0.5)
    copies = F.least(F.col("cap"), F.floor(F.round(F.col("at") + F.col("rate"), 6)) - F.floor(F.round("at", 6)))
    copies = F.when(F.col("rate") >= F.col("cap"), F.col("cap")).otherwise(copies).cast("int")
    rounded = materialize(placed.select("id", "source", "tokens", "rate", "cap", copies.alias("copies")), "mix-rounded")
    for _ in range(CORRECTIONS):
        better = _corrected(rounded, {n: wanted[n] for n in free})
        if better is None:
            break
        rounded = better
    chosen = materialize(rounded.where("copies > 0").select("id", "source", "tokens", "rate", "copies"), "mix-chosen")

    used = chosen.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"),
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"),
    )
    sum_used = chosen.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    shares = targets.join(used, "source", "left").select(
        "source", "weight",
        F.when(F.col("source").isin(names), F.col("weight") / F.lit(weight or 1.0)).otherwise(0.0).alias("wanted_share"),
        (F.coalesce("tokens", F.lit(0)) / F.lit(float(max(sum_used, 1)))).alias("share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"),
        F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.col("cap").cast("int").alias("max_repeats"),
        F.lit(steps).alias("newton_steps"), F.lit(miss).alias("rate_miss"),
    )
    return chosen.withColumnRenamed("id", id), shares
