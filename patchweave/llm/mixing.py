"""Mixing sources to target weights by balanced (cube) sampling.

Every document of source *s* has to be taken ``r = target_s / size_s`` times on
average.  ``floor(r)`` copies are certain; the rest is an inclusion probability
``p``.  The cube method moves the vector of probabilities inside the null space
of the constraints (token total, document total) until every unit is 0 or 1 but
for as many units as there are constraints.  Flight runs in blocks of bounded
size; what blocks leave (at most two units each) is dealt into blocks again,
until one block a source is left, whose last units land on the 0/1 corner with
the least token error.

Rows that agree in source, id and size are one unit of m rows, so a key that
repeats without bound stays one row.  Of its rows ``floor(m * p)`` are taken for
certain and one more with the probability that is left, so that the flight
decides over single rows of weight size; a unit's rows are numbered and the
first ones are taken.  Sources are a table like any other: their places, targets
and totals are joined, never gathered.

Null text: size 0.  Null source: a source of its own, ordered last.  Size-0
rows are never sampled (they take 0 words).  Empty table: empty result.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, owned, session, ship, stage, table

BLOCK = 512
#: Rows of one unit that a task makes at a time.
STRETCH = 10_000
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3


def targets(sizes: list[int], weights: list[float], cap: float = MAX_REPEAT) -> list[float]:
    """Shares of the total by weight, none above ``cap`` times its size; the excess is reshared by weight."""
    total, fixed = float(sum(sizes)), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        rest, w = total - sum(fixed.values()), sum(weights[i] for i in open_)
        share = {i: rest * weights[i] / w for i in open_} if w else {}
        over = [i for i in open_ if share[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: float(cap * sizes[i]) for i in over}


def flight(weights: list[float], p: list[float], seed: int, land: bool) -> list[float]:
    """Fast cube flight for the constraints (sum w*p, sum p); ``land`` also rounds the last units."""
    rng, p, active, nxt, n = random.Random(seed), list(p), [], 0, len(p)
    eps = 1e-9
    # large units first, so that what is left for the landing is small; ties at random
    order = sorted(range(n), key=lambda i: (-weights[i], rng.random()))
    start = list(p)
    while True:
        while len(active) < 3 and nxt < n:
            i = order[nxt]
            nxt += 1
            if p[i] <= eps or p[i] >= 1 - eps:
                p[i] = float(p[i] > 0.5)
            else:
                active.append(i)
        if len(active) < 3:
            break
        a, b, c = active
        wa, wb, wc = weights[a], weights[b], weights[c]
        u = (wb - wc, wc - wa, wa - wb)  # orthogonal to (1, 1, 1) and to the weights
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for i, v in zip(active, u):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, p[i] / -v), min(down, (1 - p[i]) / -v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(active, u):
            p[i] += step * v
        for i in active:
            if p[i] <= eps or p[i] >= 1 - eps:
                p[i] = float(p[i] > 0.5)
        active = [i for i in active if 0 < p[i] < 1]
    if land and active:
        best = None
        for mask in range(1 << len(active)):
            bits = [mask >> k & 1 for k in range(len(active))]
            err = (abs(sum(weights[i] * (b - p[i]) for i, b in zip(active, bits))), abs(sum(b - p[i] for i, b in zip(active, bits))), mask)
            best = min(best or (err, bits), (err, bits))
        for i, b in zip(active, best[1]):
            p[i] = float(b)
    if land:  # the landed corner may move by single units while that brings the token total nearer
        for _ in range(16):
            off = sum(w * (b - a) for w, a, b in zip(weights, start, p))
            move = [(abs(off + w * (1 - 2 * b)), i) for i, (w, a, b) in enumerate(zip(weights, start, p)) if 0 < a < 1]
            if not move or min(move)[0] >= abs(off):
                break
            p[min(move)[1]] = 1 - p[min(move)[1]]
    return p


def _fly_groups(land: bool, seed: int):
    def run(key, rows):
        import pyarrow as pa

        rows = rows.sort_by([("doc_id", "ascending"), ("size", "ascending")])
        group_seed = (seed * 1_000_003 + key[0].as_py()) * 1_000_003 + key[1].as_py()
        p = flight([float(x) for x in rows["size"].to_pylist()], rows["p"].to_pylist(), group_seed, land)
        return rows.set_column(rows.column_names.index("p"), "p", pa.array(p, pa.float64()))

    return run


def _sized(id_col: str) -> list:
    """The columns that a unit is made of."""
    return [F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")]


def _placed(sources: DataFrame) -> DataFrame:
    """Sources with their place in code point order (null last), counted by ranges: no task sees them all."""
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stage(ranged.withColumn("part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "mix-sources", narrow=True)
    counts = ranged.groupBy("part").agg(F.count("*").alias("_n"))
    before = counts.select("part", (F.sum("_n").over(W.orderBy("part")) - F.col("_n")).alias("_before"))
    # a row of 16 bytes a partition of the shuffle
    return ranged.join(F.broadcast(before), "part").withColumn("s", F.col("_before") + F.col("_at")).drop("part", "_at", "_before")


def _level(sources: DataFrame, cap: float) -> float | None:
    """What a weight of 1 gets: sources whose share exceeds ``cap`` times their size stop there and the rest is shared anew."""
    capped = lambda at: F.lit(at) * F.col("weight") > cap * F.col("source_size")
    first = sources.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("w")).first()
    if not first.total or not first.w:
        return 0.0
    level = first.total / first.w
    while True:
        r = sources.agg(F.sum(F.when(capped(level), cap * F.col("source_size")).otherwise(0.0)).alias("full"), F.sum(F.when(capped(level), 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if not r.w:
            return None
        if (now := (first.total - r.full) / r.w) <= level:
            return level
        level = now


def _plan(sized: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """One row per unit: doc_id, source, size, source_size, target, m rows of which all are taken ``full`` times and ``extra`` once more."""
    spark = session(sized)
    ship(spark)
    units = stage(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m")), "mix-units", narrow=True)
    sources = _placed(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight)
    level, most = _level(sources, max_repeat), F.lit(float(max_repeat)) * F.col("source_size")
    target = most if level is None else F.least(F.lit(level) * F.col("weight"), most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    full = F.floor(rate + 1e-12).cast("int")
    known = sources.withColumn("target", target).select("s", F.col("source").alias("_source"), "source_size", "target", full.alias("full"), F.greatest(F.lit(0.0), rate - full).alias("p"), F.ceil(F.col("n") / block).alias("nb"))
    nb = known.agg(F.max("nb")).first()[0] or 1
    # no side is a sum by source as it stands, so that Spark can split a source that holds many rows over tasks
    rows = units.join(known.hint("merge"), units["source"].eqNullSafe(known["_source"])).drop("_source")
    of_m = F.col("m") * F.col("p")
    sure = F.when(F.col("size") > 0, F.floor(of_m + 1e-9)).otherwise(0).cast("long")
    rows = rows.withColumn("sure", sure).withColumn("p", F.greatest(of_m - F.col("sure"), F.lit(0.0)))
    columns = "s long, source string, source_size long, target double, full int, doc_id long, size long, m long, sure long, p double"
    names = [c.split()[0] for c in columns.split(", ")]
    live = (F.col("size") > 0) & (F.col("p") > 1e-12)
    done = [rows.filter(~live).select(*names[:-1], F.lit(0.0).alias("p"))]
    pending, last, part, round_ = rows.filter(live), False, F.col("nb"), 0
    while not last:
        last = nb <= 1
        keyed = pending.withColumn("b", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + round_)), part)).select(*names, "b")
        flown = stage(keyed.groupBy("s", "b").applyInArrow(_fly_groups(last, seed + round_), columns + ", b long").drop("b"), f"mix-flight{round_}", narrow=True)
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(flown.filter(whole) if not last else flown)
        pending = flown.filter(~whole)
        nb, round_ = -(-3 * nb // block) if nb > 1 else 1, round_ + 1
        part = F.lit(nb).cast("long")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("extra", F.col("sure") + F.col("p").cast("long")).drop("sure", "p", "s")


def _copies(k):
    """Copies of row ``k`` (from 0) of a unit."""
    return (F.col("full") + (k < F.col("extra")).cast("int")).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken."""
    out = _plan(docs.select(*_sized(id_col)), weights, max_repeat, block, seed)
    # a unit's rows come in stretches that are dealt over tasks, so that no task makes the rows of a key that repeats without bound
    out = out.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / STRETCH)))).repartition("doc_id", "source", "size", "_c")
    first = F.col("_c") * STRETCH
    out = out.withColumn("_k", F.explode(F.sequence(first, F.least(first + STRETCH, F.col("m")) - 1))).withColumn("copies", _copies(F.col("_k")))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def take(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus itself: each row as often as the mix takes it (size-0 documents once per certain copy)."""
    with owned() as own:
        # rows are numbered and written once, so that each row's own copies find it again; unit columns stand beside the row's own
        rows = stage(docs.select(F.struct(*docs.columns).alias("_doc"), *_sized(id_col)).withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
        unit = ["doc_id", "source", "size"]
        plan = _plan(rows.select(*unit), **options).select(*[F.col(c).alias(f"_{c}") for c in unit], F.monotonically_increasing_id().alias("u"), "m", "full", "extra")
        plan = stage(plan, "mix-copies", narrow=True)
        same = F.lit(True)
        for c in unit:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        # shuffled joins at every size: the plan has a row for every unit, its copies one for every row
        placed = stage(rows.select("_row", *unit).join(plan.hint("merge"), same).select("_row", "u", "m", "full", "extra"), "mix-placed", narrow=True)
        # rows of a unit are numbered by the partition they were written in, then in it: a unit that repeats without bound is dealt over tasks
        many = placed.filter("m > 1").withColumn("_part", F.shiftright("_row", 33))
        parts = many.groupBy("u", "_part").agg(F.count("*").alias("_n"))
        parts = parts.select("u", "_part", (F.sum("_n").over(W.partitionBy("u").orderBy("_part")) - F.col("_n")).alias("_before"))
        local = many.withColumn("_k", F.row_number().over(W.partitionBy("u", "_part").orderBy("_row")) - 1).join(parts, ["u", "_part"]).withColumn("_k", F.col("_k") + F.col("_before"))
        copies = placed.filter("m = 1").select("_row", _copies(F.lit(0)).alias("_copies")).union(local.select("_row", _copies(F.col("_k")).alias("_copies")))
        copies = stage(copies.filter("_copies > 0").withColumnRenamed("_row", "_of"), "mix-takes", narrow=True)
        own.keep(rows, copies)
        joined = rows.select("_doc", "_row").join(copies.hint("merge"), F.col("_row") == F.col("_of"))
        return joined.withColumn("_r", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("_doc.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
