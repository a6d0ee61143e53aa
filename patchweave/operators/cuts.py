"""Cuts of long sequences in parallel: chunks as transition tables, composed in a tree.

Where a sequence is cut depends on the cut before, but only through the number of rows since then, which a longest
group bounds.  A chunk of rows is therefore a table: for every number of rows since the last cut on entry, that number on
exit and how many cuts lie between.  Tables of chunks compose by looking one up in the next; a video's chunks compose in
two levels of lists, whose entries say what every chunk is entered with, and chunks then cut by themselves.  One long
video is cut by many tasks, and no task holds more than a chunk of it.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .stream import typed

#: Values of t in a chunk, and chunks (as a power of two) whose tables are composed at a time.
CHUNK, FAN_BITS = 4096, 7
#: What a chunk is entered with: rows since the last cut, cuts and rows before it.
STATE = "struct<since:int,cuts:long,rows:long>"
TABLE = "array<struct<since:int,cuts:long>>"


class Costs:
    """Cuts of one chunk: before a row that costs more than the threshold, at ``least`` rows and more, or at ``most``."""

    def __init__(self, cost: np.ndarray, threshold: float | None, least: int, most: int):
        self.n, self.least, self.most, self.cost = len(cost), least, most, cost
        self.dear = cost > threshold if threshold is not None else np.zeros(self.n, bool)
        at = np.where(self.dear, np.arange(self.n), self.n)
        self.next = np.append(np.minimum.accumulate(at[::-1])[::-1], self.n)  # the first dear row from a row on
        self.after = self._cut(np.arange(self.n))
        self.last, self.hops = self._ends()

    def _cut(self, start):
        """The cut that ends a group begun at ``start`` (which may lie before the chunk); n or more if there is none."""
        return np.minimum(self.next[np.clip(start + self.least, 0, self.n)], np.maximum(start + self.most, 0))

    def _ends(self):
        """For every row: the last group's start if a group begins there, and the cuts after it; by pointer jumping."""
        here = np.arange(self.n)
        to = np.where(self.after < self.n, self.after, here)
        hops = (to != here).astype(np.int64)
        while (to[to] != to).any():
            hops, to = hops + hops[to], to[to]
        return to, hops

    def table(self, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(since, cuts) on exit by rows since the last cut on entry, 0 (nothing before) to ``most``; a first chunk has 0 alone."""
        since = np.arange(1 if first else self.most + 1)
        first = np.where(since == 0, 0, self._cut(-since))
        met = first < self.n
        at = np.where(met, first, 0)
        return np.where(met, self.n - self.last[at], since + self.n), np.where(met, self.hops[at] + (since > 0), 0)

    def cuts(self, since: int) -> np.ndarray:
        """Rows before which the chunk is cut, in order."""
        at = 0 if since == 0 else int(self._cut(np.array([-since]))[0])
        out = [] if since == 0 or at >= self.n else [at]
        while at < self.n and self.after[at] < self.n:  # a step a group, not a row
            at = int(self.after[at])
            out.append(at)
        return np.array(out, np.int64)


def _chunks(batch, least: int, most: int) -> list[Costs]:
    """The chunks of a batch, their costs read off the batch as they lie."""
    cost = batch.column("cost")
    flat, edges = cost.flatten().to_numpy(zero_copy_only=False), cost.offsets.to_numpy() - cost.offsets[0].as_py()
    return [Costs(flat[a:b], thr, least, most) for a, b, thr in zip(edges[:-1], edges[1:], batch.column("thr").to_pylist())]


def _tables(packed: DataFrame, least: int, most: int) -> DataFrame:
    """video, chunk, n, table."""
    schema = f"{typed(packed, 'video', 'chunk')}, n long, since array<int>, cuts array<long>"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = _chunks(batch, least, most)
            since, cuts = zip(*(c.table(k == 0) for c, k in zip(found, batch.column("chunk").to_pylist()))) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("video"), batch.column("chunk"), pa.array([c.n for c in found], pa.int64()), pa.array(since, pa.list_(pa.int32())), pa.array(cuts, pa.list_(pa.int64()))], ["video", "chunk", "n", "since", "cuts"])

    return packed.mapInArrow(run, schema).select("video", "chunk", "n", F.arrays_zip(F.col("since"), F.col("cuts")).cast(TABLE).alias("table"))


def _step(state: Column, one: Column) -> Column:
    """The state after a chunk, from the state before it."""
    to = F.element_at(one["table"], state["since"] + 1)
    return F.struct(to["since"].alias("since"), (state["cuts"] + to["cuts"]).alias("cuts"), (state["rows"] + one["n"]).alias("rows"))


def _entered(members: Column, state: Column) -> Column:
    """Entries (chunk, state) of a list of chunks (chunk, n, table), entered one after the other."""
    begin = F.struct(state.alias("now"), F.array().cast(f"array<struct<chunk:long,state:{STATE}>>").alias("seen"))
    walk = lambda acc, x: F.struct(_step(acc["now"], x).alias("now"), F.concat(acc["seen"], F.array(F.struct(x["chunk"].alias("chunk"), acc["now"].alias("state")))).alias("seen"))
    return F.aggregate(members, begin, walk, lambda acc: acc["seen"])


def states(tables: DataFrame) -> DataFrame:
    """video, chunk, state, last: what every chunk is entered with and whether it is the last, from tables (video, chunk, n, table).

    Chunks are numbered from 0; the table of chunk 0 need hold its first entry only.
    """
    first = F.struct(F.lit(0).alias("since"), F.lit(0).cast("long").alias("cuts"), F.lit(0).cast("long").alias("rows")).cast(STATE)
    listed = F.sort_array(F.collect_list(F.struct("chunk", "n", "table"))).alias("members")
    blocks = tables.groupBy("video", F.shiftright("chunk", FAN_BITS).alias("block")).agg(listed)
    # a block's own table: every entry of the first looked up in the next
    look = lambda acc, x: F.transform(acc, lambda e: F.struct(F.element_at(x["table"], e["since"] + 1)["since"].alias("since"), (e["cuts"] + F.element_at(x["table"], e["since"] + 1)["cuts"]).alias("cuts")))
    whole = F.aggregate(F.slice("members", F.lit(2), F.size("members")), F.col("members")[0]["table"], look)
    rows = F.aggregate("members", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    top = blocks.select("video", F.col("block").alias("chunk"), rows.alias("n"), whole.alias("table")).groupBy("video").agg(listed)
    end = F.element_at("members", -1)["chunk"]
    above = top.select("video", end.alias("end"), F.explode(_entered(F.col("members"), first)).alias("e")).select("video", F.col("e.chunk").alias("block"), F.col("e.state").alias("state"), (F.col("e.chunk") == F.col("end")).alias("last"))
    inner = blocks.join(above, ["video", "block"]).select("video", "last", end.alias("end"), F.explode(_entered(F.col("members"), F.col("state"))).alias("e"))
    return inner.select("video", "e.chunk", "e.state", (F.col("last") & (F.col("e.chunk") == F.col("end"))).alias("last"))


def cut_by_cost(rows: DataFrame, least: int, most: int, chunk: int = CHUNK) -> DataFrame:
    """video, group_idx, start, end, frame_count, stop_reason, split_cost of rows(video, t, cost, thr).

    Rows are counted in order of t.  A null cost or threshold cuts nothing; the rows after the last cut are a group.
    """
    ship(rows.sparkSession)
    least = max(1, least)
    most = max(least, most)
    packed = rows.groupBy("video", F.floor(F.col("t") / chunk).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("t", F.col("cost").cast("double").alias("cost")))).alias("rows"), F.first("thr").alias("thr")).select("video", "chunk", F.col("rows.cost").alias("cost"), "thr")
    entered = states(_tables(packed, least, most))
    joined = packed.join(entered, ["video", "chunk"]).select("video", "cost", "thr", "state", "last")
    names = ["video", "group_idx", "start", "end", "frame_count", "stop_reason", "split_cost"]
    schema = f"{typed(rows, 'video')}, group_idx int, start int, end int, frame_count int, stop_reason string, split_cost double"

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32()] * 4 + [pa.string(), pa.float64()]
        for batch in batches:
            out, keys = [[] for _ in kinds], []
            for place, (one, state, last) in enumerate(zip(_chunks(batch, least, most), batch.column("state").to_pylist(), batch.column("last").to_pylist())):
                at = one.cuts(state["since"])
                base, group = state["rows"], state["cuts"]
                start = np.concatenate([[base - state["since"]], base + at])
                dear = one.dear[at] & (np.diff(start) >= least)
                cost = [None if x != x else x for x in one.cost[at].tolist()]
                reason = np.where(dear, "adaptive_gop_cost", "adaptive_gop_max_group_frames").tolist()
                if last:
                    start, cost, reason = np.append(start, base + one.n), [*cost, None], [*reason, "adaptive_gop_tail"]
                n = len(start) - 1
                keys += [place] * n
                for o, v in zip(out, (range(group, group + n), start[:-1].tolist(), start[1:].tolist(), np.diff(start).tolist(), reason, cost)):
                    o.extend(v)
            yield pa.RecordBatch.from_arrays([batch.column("video").take(pa.array(keys, pa.int64())), *[pa.array(o, t) for o, t in zip(out, kinds)]], names)

    return joined.mapInArrow(run, schema)


def merge_cheapest(spans: list[tuple[int, int, float | None]], target: int) -> list[tuple[int, int, float | None]]:
    """Merges neighbours until ``target`` groups are left: the left group with the least split cost goes first and keeps it.

    Candidates wait in a heap and neighbours are linked; a group's cost and place never change, so that one that lost
    its right neighbour only grows, and one that was swallowed is passed over when its turn comes.
    """
    n, left = len(spans), max(1, target)
    after, end, alive = list(range(1, n + 1)), [s[1] for s in spans], [True] * n
    heap = [(s[2] or 0.0, k) for k, s in enumerate(spans[:-1])]
    heapq.heapify(heap)
    while n > left:
        cost, k = heapq.heappop(heap)
        gone = after[k] if alive[k] else len(spans)
        if gone == len(spans):
            continue
        end[k], after[k], alive[gone], n = end[gone], after[gone], False, n - 1
        heapq.heappush(heap, (cost, k))
    return [(s[0], end[k], s[2]) for k, s in enumerate(spans) if alive[k]]
