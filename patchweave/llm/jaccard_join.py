"""N-gram Jaccard join: components of documents whose word-shingle sets are similar.

Jaccard distance is a metric, so pivots with triangle-inequality windows join a
region exactly: documents go to the cell of their nearest pivot and, where
``d(x, q) <= d(x, nearest) + 2 * radius``, to the cells of other pivots, and
cells join recursively until they are small.  Two facts shape what comes before:

* equal sets are one point: a class is represented by its row of smallest number;
* sets that share little lie at distance near 1 from one another and from every
  pivot, where no window excludes anything.  Root regions therefore come from
  signatures: ``BANDS`` keys of ``ROWS`` minima each.  A pair at the threshold
  misses all keys with probability ``(1 - 0.75**6)**80 < 2e-7`` (the higher the
  similarity, the less); documents that meet in a key, directly or through
  others, form a root region, and no pair of different regions is compared.

Regions of bounded size are joined in one task each.  Larger ones are dealt: all
their documents meet a few pivots in blocks, links to pivots are kept, documents
are cut into blocks by component, cell and distance ring, and two blocks are
compared only if their distance windows to every pivot overlap and they do not
belong to one component already.

A document without words has an empty set and links to nothing; so do rows
without id.  Null text counts as empty.  Repeated rows share their result.
Empty table: no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, owned, session, ship, stage, table
from .graph import apart, components

WIDTH = 5
NUM, DEN = 75, 100
ROWS, BANDS = 6, 80
#: Documents and shingles that one task may join.
REGION_DOCS, REGION_SHINGLES = 1_000, 2_000_000
BLOCK = 256
PIVOTS = 6
RADIUS = 1 - NUM / DEN


class MinHash:
    """BANDS keys of ROWS minima over multiplicative permutations of 32-bit values."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS):
        rng = np.random.default_rng(77)
        n = rows * bands
        self.rows, self.bands = rows, bands
        self.flip = rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]
        self.times = (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.salt = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        from .shingles import mix

        x = (hashes >> np.uint64(32)).astype(np.uint32)
        least = None
        with np.errstate(over="ignore"):
            for lo in range(0, len(x), 1024):
                part = (((x[None, lo : lo + 1024] ^ self.flip) * self.times) ^ (self.flip >> np.uint32(7))).min(1)
                least = part if least is None else np.minimum(least, part)
            keys = (mix(least.reshape(self.bands, self.rows).astype(np.uint64) + self.salt) * self.salt).sum(1)
            return mix(keys + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    from .shingles import mix

    with np.errstate(over="ignore"):
        return tuple(int(mix(x).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for x in (s, s ^ np.uint64(0x5851F42D4C957F2D)))


@lru_cache
def _hasher():
    from .shingles import Hasher

    return Hasher()


def _set(text: str | None) -> np.ndarray:
    return _hasher().shingles((text or "").encode(), WIDTH)


def _signatures():
    import pyarrow as pa

    sketch = MinHash()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, one, two, keys = [], [], [], []
                for text in part.column(2):
                    s = _set(text.as_py())
                    n.append(len(s))
                    h1, h2 = _identity(s)
                    one.append(h1)
                    two.append(h2)
                    keys.append(sketch(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "n", "h1", "h2", "keys"])

    return run


def linked(both, x, y):
    """100 * intersection >= 75 * union."""
    return DEN * both >= NUM * (x + y - both)


class Region:
    """Sets of a region with their postings; finds links through pivots, cells and windows."""

    LEAF = 64

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        _, column = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(column, kind="stable")
        self.posting = owner[order]
        self.start = np.searchsorted(column[order], np.arange(column.max() + 2 if len(column) else 1))
        self.columns = np.split(column, np.cumsum(self.size)[:-1])

    def overlap(self, i: int) -> np.ndarray:
        """Sizes of the intersections of set ``i`` with all sets."""
        lo, hi = self.start[self.columns[i]], self.start[self.columns[i] + 1]
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.posting[at], minlength=len(self.sets))

    def unite(self, group: np.ndarray) -> np.ndarray:
        """Component labels (smallest position) after all links, starting from the labels ``group``."""
        n = len(self.sets)

        def join(i, both):
            hit = linked(both, self.size[i], self.size)
            hit[i] = True
            labels = np.unique(group[hit])
            if len(labels) > 1:
                group[np.isin(group, labels)] = labels[0]

        if n <= self.LEAF:
            for i in range(n):
                if (group != group[i]).any():
                    join(i, self.overlap(i))
            return group
        pivots, distance, nearest = [], [], np.full(n, np.inf)
        for _ in range(8):
            p = int(np.argmax(np.where(np.isin(np.arange(n), pivots), -1.0, nearest)))
            both = self.overlap(p)
            join(p, both)
            pivots.append(p)
            distance.append(1 - both / (self.size + self.size[p] - both))
            nearest = np.minimum(nearest, distance[-1])
        for d in distance:
            cell = np.flatnonzero(d <= nearest + 2 * RADIUS + 1e-9)
            if len(np.unique(group[cell])) < 2:
                continue
            if len(cell) > 0.7 * n:  # no window excludes enough: meet what is not of the largest component
                labels, counts = np.unique(group[cell], return_counts=True)
                for i in cell[group[cell] != labels[counts.argmax()]]:
                    join(i, self.overlap(i))
                continue
            inner = Region([self.sets[i] for i in cell])
            labels, local = np.unique(group[cell], return_inverse=True)
            first = np.array([np.flatnonzero(local == k)[0] for k in range(len(labels))])
            found = inner.unite(first[local].copy())
            for k in np.unique(found):
                mine = np.unique(group[cell[found == k]])
                if len(mine) > 1:
                    group[np.isin(group, mine)] = mine[0]
        return group


def _join_region(pdf):
    import pandas as pd

    pdf = pdf.sort_values("id", kind="stable")
    ids = pdf["id"].to_numpy()
    group = Region([_set(t) for t in pdf["text"]]).unite(np.arange(len(ids)))
    return pd.DataFrame({"id": ids, "component": ids[[np.flatnonzero(group == g)[0] for g in group]]})


def _sets():
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([_set(t.as_py()).tobytes() for t in part.column(2)], pa.binary())], ["region", "id", "s"])

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _meet_pivots(docs, pivots):
    import pandas as pd

    sets = [np.frombuffer(s, np.uint64) for s in docs["s"]]
    pivots = pivots.sort_values("rank")
    ids, far, near = [], [], []
    for i, x in zip(docs["id"], sets):
        d, hits = [], []
        for p, raw in zip(pivots["id"], pivots["s"]):
            y = np.frombuffer(raw, np.uint64)
            both = _common(x, y)
            d.append(1 - both / (len(x) + len(y) - both))
            if p != i and linked(both, len(x), len(y)):
                hits.append(int(p))
        ids.append(i)
        far.append(d)
        near.append(hits)
    return pd.DataFrame({"region": docs["region"].iloc[0] if len(docs) else None, "id": ids, "d": far, "near": near})


def _meet_blocks(pdf):
    """Links between the two sides of a pair of blocks, at most one for each document and component met."""
    import pandas as pd

    pdf = pdf.sort_values(["side", "id"], kind="stable")
    sets = [np.frombuffer(s, np.uint64) for s in pdf["s"]]
    ids, labels, side = (pdf[c].to_numpy() for c in ("id", "label", "side"))
    space = Region(sets)
    _, group = np.unique(labels, return_inverse=True)
    out = []
    rows = np.flatnonzero(side == 0)
    other = np.flatnonzero(side == 1) if (side == 1).any() else rows
    if len(other) < len(rows):
        rows, other = other, rows
    for i in rows:
        open_ = other[group[other] != group[i]]
        if not len(open_):
            continue
        both = space.overlap(i)[open_]
        for j in open_[linked(both, space.size[i], space.size[open_])]:
            if group[i] != group[j]:
                out.append((ids[i], ids[j]))
                group[group == group[j]] = group[i]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _join_large(members: DataFrame, text: DataFrame) -> DataFrame:
    """Links of regions too large for a task: members (region, id, blocks), text (region, id, text)."""
    sets = stage(map_arrow(text.select("region", "id", "text"), lambda: _sets(), "region long, id long, s binary"), "join-sets")
    dealt = sets.join(members.select("id", "blocks"), "id").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks"))
    rank = F.row_number().over(W.partitionBy("region").orderBy(F.xxhash64("id", F.lit(2)), "id"))
    chosen = sets.select("region", "id").withColumn("rank", rank).filter(F.col("rank") <= PIVOTS)
    pivots = sets.join(chosen.select("id", "rank"), "id").join(members.groupBy("region").agg(F.max("blocks").alias("blocks")), "region")
    pivots = pivots.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("region", "block", "id", "rank", "s").toDF("region", "block", "id", "rank", "s")
    met = dealt.select("region", "block", "id", "s").groupBy("region", "block").cogroup(pivots.groupBy("region", "block"))
    placed = stage(met.applyInPandas(_meet_pivots, "region long, id long, d array<double>, near array<long>"), "join-pivots")
    links = placed.select("id", F.explode("near").alias("b")).select(F.col("id").alias("a"), "b")
    label = stage(components(links), "join-labels", narrow=True)
    home = F.array_position("d", F.array_min("d"))
    cells = placed.join(label.withColumnRenamed("component", "l"), "id", "left").select("region", "id", "d", F.coalesce("l", F.lit(-1)).alias("l"), F.coalesce("l", "id").alias("label"), home.alias("home"), F.floor(F.array_min("d") * 8).alias("ring"))
    by = ["region", "l", "home", "ring"]
    counted = cells.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    cells = apart(apart(cells, "region").join(apart(counted, "region").hint("merge"), by), "region")
    cells = stage(cells.withColumn("cell", F.xxhash64(*by, F.pmod(F.xxhash64("id", F.lit(3)), "parts"))), "join-cells")
    windows = [F.struct(F.min(F.col("d")[k]).alias("lo"), F.max(F.col("d")[k]).alias("hi")) for k in range(PIVOTS)]
    blocks = cells.groupBy("region", "cell", "l").agg(F.array(*windows).alias("w"))
    blocks = stage(blocks, "join-windows", narrow=True)
    x, y = blocks.alias("x"), blocks.alias("y")
    excluded = F.exists(F.zip_with("x.w", "y.w", lambda p, q: F.coalesce((p["lo"] - q["hi"] > RADIUS + 1e-9) | (q["lo"] - p["hi"] > RADIUS + 1e-9), F.lit(False))), lambda b: b)
    pairs = x.join(y, F.col("x.region") == F.col("y.region")).filter((F.col("x.cell") <= F.col("y.cell")) & ((F.col("x.l") < 0) | (F.col("x.l") != F.col("y.l"))) & ~excluded)
    pairs = stage(pairs.select(F.col("x.cell").alias("c0"), F.col("y.cell").alias("c1")), "join-pairs", narrow=True)
    sides = pairs.select("c0", "c1", F.col("c0").alias("cell"), F.lit(0).alias("side")).union(pairs.filter("c0 <> c1").select("c0", "c1", F.col("c1").alias("cell"), F.lit(1).alias("side")))
    dealt = sides.join(cells.select("cell", "id", "label"), "cell").join(sets.select("id", "s"), "id")
    more = dealt.groupBy("c0", "c1").applyInPandas(_meet_blocks, "a long, b long")
    return links.union(more)


def _numbered(docs: DataFrame, *columns) -> DataFrame:
    """Rows written once with a number, so that what is found for a row finds it again, whatever its id."""
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "join-rows")


def _classes(rows: DataFrame) -> DataFrame:
    """Classes of equal sets and their components, from staged (row, doc_id, text), numbers unique.

    One row per input row: row, doc_id, n, h1, h2, least (the smallest id of the component) and label (its smallest
    number); both null without words or id.  Tables that only lead there are deleted.
    """
    ship(session(rows))
    identity = ["n", "h1", "h2"]
    with owned() as owner:
        signed = stage(map_arrow(rows.select("row", "doc_id", "text"), lambda: _signatures(), "row long, doc_id long, n long, h1 long, h2 long, keys array<long>"), "join-signatures")
        real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
        # keys depend on the set alone: copies of a set leave one array a task before the shuffle
        classes = stage(signed.filter(real).groupBy(*identity).agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.first("keys").alias("keys")), "join-classes")
        entries = classes.select(F.explode("keys").alias("key"), "node")
        shared = entries.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("c")).filter("b < c").select("key", "b")
        meet = apart(entries, "key").join(apart(shared, "key").hint("merge"), "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
        region = components(meet).withColumnRenamed("component", "region")
        sized = region.join(classes.select(F.col("node").alias("id"), "n", "least").hint("merge"), "id")
        large = (F.col("docs") > REGION_DOCS) | (F.col("shingles") > REGION_SHINGLES)
        blocks = F.greatest(F.ceil(F.col("docs") / BLOCK), F.ceil(F.col("shingles") / (REGION_SHINGLES // 4))).cast("long")
        weight = sized.groupBy("region").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).select("region", large.alias("large"), blocks.alias("blocks"))
        members = stage(apart(apart(sized, "region").join(apart(weight, "region").hint("merge"), "region"), "region"), "join-members", narrow=True)
        # shuffled at every size: members grow with the corpus
        found = lambda some: some.join(rows.select(F.col("row").alias("id"), "text").hint("merge"), "id")
        result = found(members.filter("not large").select("id", "region")).select("region", "id", "text").groupBy("region").applyInPandas(_join_region, "id long, component long")
        if members.filter("large").limit(1).count():
            result = result.union(components(_join_large(members.filter("large"), found(members.filter("large").select("id", "region")))))
        result = stage(result, "join-components")
        mine = result.join(members.select("id", "least").hint("merge"), "id")
        named = mine.groupBy("component").agg(F.min("least").alias("first"))
        ended = apart(apart(mine, "component").join(apart(named, "component").hint("merge"), "component"), "component").select(F.col("id").alias("node"), "component", "first")
        # both sides of a join by a hot key are written tables or placed anew, so that Spark can split the key over tasks
        own = signed.select("row", "doc_id", *identity)
        known = own.filter(real).join(classes.select(*identity, "node", "least").hint("merge"), identity).select("row", "doc_id", *identity, "node", "least")
        alone = own.filter(~real).select("*", F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("label"))
        linked_ = known.join(ended.hint("merge"), "node", "left").select("row", "doc_id", *identity, F.coalesce("first", "least").alias("least"), F.coalesce("component", "node").alias("label"))
        out = stage(linked_.union(alone), "join-result")
        owner.keep(out)
        return out


def _unite(found: DataFrame) -> DataFrame:
    """doc_id, component_id of every id: components whose rows share an id are one, named by the smallest id in it."""
    with owned() as own:
        labels = found.filter(F.col("doc_id").isNotNull()).select("doc_id", "label").distinct()
        home = labels.groupBy("doc_id").agg(F.min("label").alias("home"))
        pairs = apart(labels, "doc_id").join(apart(home, "doc_id").hint("merge"), "doc_id").filter("label <> home").select(F.col("label").alias("a"), F.col("home").alias("b"))
        whole = components(pairs).select(F.col("id").alias("home"), "component")
        placed = stage(home.join(whole.hint("merge"), "home", "left").select("doc_id", F.coalesce("component", "home").alias("whole")), "join-placed", narrow=True)
        named = placed.filter(F.col("whole").isNotNull()).groupBy("whole").agg(F.min("doc_id").alias("component_id"))
        out = stage(apart(placed, "whole").join(apart(named, "whole").hint("merge"), "whole", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id")), "join-ids", narrow=True)
        own.keep(out)
        return out


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; the texts of one id belong together."""
    with owned() as own:
        found = _classes(_numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), "text"))
        split = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n"), F.count("label").alias("m"))
        if not split.filter("a <> b or (m > 0 and m < n)").limit(1).count():
            own.keep(found)
            return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
        united = _unite(found)
        own.keep(found, united)
        return found.join(united.hint("merge"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Of every component of similar texts the row with the smallest id, once; all rows without id.

    Texts alone decide: rows that share an id but not a component stay.  Rows without words are copies of one another
    only under one id.
    """
    with owned() as own:
        rows = _numbered(docs, F.struct(*docs.columns).alias("_doc"))
        found = _classes(rows.select("row", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.text").alias("text")))
        of = found.filter(F.col("doc_id").isNotNull()).groupBy(F.col("label").isNull(), F.coalesce("label", "doc_id"))
        first = of.agg(F.min(F.struct("doc_id", "n", "h1", "h2", "row")).alias("first")).select("first.row")
        keep = stage(first.union(found.filter(F.col("doc_id").isNull()).select("row")), "join-keep", narrow=True)
        own.keep(rows, keep)
        # a shuffled join at every size: what stays grows with the corpus
        return rows.join(keep.hint("merge"), "row", "left_semi").select("_doc.*")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
