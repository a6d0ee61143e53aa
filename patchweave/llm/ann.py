"""Maximum-inner-product search over score-aware (anisotropic) quantised vectors.

Codes are four bits for each pair of dimensions.  Codebooks and codes minimise
``|r|^2 + (eta - 1) (r . x/|x|)^2`` for the residual ``r``: error parallel to the
vector, which moves large inner products, costs ``eta`` times as much as error
across it; ``eta`` follows from the score threshold ``T`` at which a pair counts.
Codebooks are fitted on a bounded sample (``sample`` rows, lowest hash of the id);
every row is coded: its direction, and the direction of the residual once more,
with the row's length and the lengths of both residuals.  The stated queries meet
all rows in blocks: codes and vectors of up to ``BLOCK`` bytes are one row, queries
are packed likewise, and a block of queries scans a block of codes through byte
tables (two codes a step).  The best ``keep`` of every block get their exact inner
products in double precision.  What the others can reach at most follows from their
codes and the lengths of their residuals (first of one, then of both codes): whoever
can still be among the nearest of the block is reranked as well, so that the result
is exact whatever the rows are; codes that fit badly cost time only.

Equal vectors are one entry of the index that lists its 21 smallest ids, so that
a vector that repeats without bound takes one place among the candidates and ties
still go to smaller ids.  Vectors that are null, zero, of another length than the
commonest, or hold null or non-finite components take no part; rows without id
neither.  Rows that repeat an id count once, with the least of their vectors.
Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, session, ship, stage, table

K = 20
EVERY = 20
SAMPLE = 10_000
THRESHOLD = 0.2
KEEP = 512
#: Bytes of vectors in a block, and queries that meet it at a time.
BLOCK = 8 << 20
QUERIES = 512
#: What a table step may be off by in single precision, for a sum of one.
STEP = 2e-6


def eta_of(dims: int, threshold: float = THRESHOLD) -> float:
    """How much more parallel error costs."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    """Sixteen codewords for each pair of dimensions; anisotropic codes by coordinate descent."""

    def __init__(self, books: np.ndarray, eta: float):
        self.books, self.eta = books, eta  # (pairs, 16, 2)

    @staticmethod
    def pairs(x: np.ndarray) -> np.ndarray:
        if x.shape[1] % 4:
            x = np.pad(x, ((0, 0), (0, 4 - x.shape[1] % 4)))
        return x.reshape(len(x), -1, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        p = self.pairs(x)
        u = self.pairs(x / np.linalg.norm(x, axis=1, keepdims=True))
        square = ((p[:, :, None, :] - self.books[None]) ** 2).sum(-1)
        codes = square.argmin(2)
        along = np.einsum("npcd,npd->npc", p[:, :, None, :] - self.books[None], u)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for m in range(p.shape[1]):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (square[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                total = rest + along[rows, m, codes[:, m]]
        return codes

    def decode(self, codes: np.ndarray, dims: int) -> np.ndarray:
        return self.books[np.arange(self.books.shape[0]), codes].reshape(len(codes), -1)[:, :dims]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with what a byte (two codes) stands for: (queries, bytes of a code, 256)."""
        inner = np.einsum("qpd,pcd->qpc", self.pairs(q), self.books).astype(np.float32)
        return (inner[:, 0::2, :, None] + inner[:, 1::2, None, :]).reshape(len(q), -1, 256)

    @staticmethod
    def fit(x: np.ndarray, eta: float, rounds: int = 6, seed: int = 5) -> "Quantiser":
        rng = np.random.default_rng(seed)
        p = Quantiser.pairs(x)
        u = Quantiser.pairs(x / np.linalg.norm(x, axis=1, keepdims=True))
        pick = rng.choice(len(x), 16, replace=len(x) < 16)
        own = Quantiser(p[pick].transpose(1, 0, 2) + 1e-6 * rng.standard_normal((p.shape[1], 16, 2)), 1.0)
        for step in range(rounds):
            own.eta = 1.0 if step < 3 else eta  # start from the plain quantiser
            codes = own.encode(x, sweeps=1)
            residual = p - own.books[np.arange(p.shape[1]), codes]
            along = (residual * u).sum(-1)
            total = along.sum(1)
            for m in range(p.shape[1]):
                um, extra = u[:, m], own.eta - 1
                a = np.eye(2) + extra * um[:, :, None] * um[:, None, :]
                b = np.einsum("nij,nj->ni", a, p[:, m]) + extra * ((total - along[:, m])[:, None] * um)
                for c in range(16):
                    hit = codes[:, m] == c
                    if hit.any():
                        own.books[m, c] = np.linalg.solve(a[hit].sum(0) + 1e-9 * np.eye(2), b[hit].sum(0))
        own.eta = eta
        return own


def _packed(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] * 16 + codes[:, 1::2]).astype(np.uint8)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths of vectors that are not zero."""
    most = np.abs(x).max(1, keepdims=True)
    length = np.linalg.norm(x / most, axis=1, keepdims=True)
    return x / most / length, (most * length)[:, 0]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, added up in the order of the dimensions as the query does."""
    return (x * q).cumsum(axis=1)[:, -1]


class Codes:
    """Anisotropic codes of directions, and plain codes of the directions of their residuals."""

    def __init__(self, first: Quantiser, second: Quantiser):
        self.first, self.second = first, second

    @staticmethod
    def fit(x: np.ndarray) -> "Codes":
        u = unit(x)[0]
        first = Quantiser.fit(u, eta_of(u.shape[1]))
        r = u - first.decode(first.encode(u), u.shape[1])
        r = r[np.abs(r).max(1) > 0]
        return Codes(first, Quantiser.fit(unit(r)[0] if len(r) else u, 1.0))

    def encode(self, x: np.ndarray) -> tuple:
        """Bytes of both codes, lengths of the rows, and of the residuals of the directions after one code and after both."""
        u, norm = unit(x)
        codes = self.first.encode(u)
        r = u - self.first.decode(codes, u.shape[1])
        some = np.abs(r).max(1) > 0
        v, rest = u.copy(), np.zeros(len(u))
        v[some], rest[some] = unit(r[some])
        more = self.second.encode(v, sweeps=0)
        left = np.linalg.norm(r - rest[:, None] * self.second.decode(more, u.shape[1]), axis=1)
        return _packed(codes), _packed(more), norm, rest, left


CODED = "id long, code binary, more binary, norm double, rest double, left double, v binary"


def _encode(own: Codes):
    def make():
        import pyarrow as pa

        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    x = np.array(part.column(1).to_pylist(), np.float64)
                    code, more, *lengths = own.encode(x)
                    raw = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), raw(code), raw(more), *map(pa.array, lengths), raw(x)], [c.split()[0] for c in CODED.split(", ")])

        return run

    return make


PACKED = "block long, ids binary, codes binary, more binary, norms binary, rests binary, lefts binary, vectors binary"


def _pack_codes(pdf):
    import pandas as pd

    pdf = pdf.sort_values("id", kind="stable")
    numbers = {f"{c}s": [pdf[c].to_numpy(np.float64).tobytes()] for c in ("norm", "rest", "left")}
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "codes": [b"".join(pdf["code"])], "more": [b"".join(pdf["more"])], **numbers, "vectors": [b"".join(pdf["v"])]})


def _pack_queries(pdf):
    import pandas as pd

    pdf = pdf.sort_values("id", kind="stable")
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "qids": [pdf["id"].to_numpy(np.int64).tobytes()], "queries": [np.array(pdf["v"].tolist(), np.float64).tobytes()]})


class Block:
    """Rows of the index, in ascending order of id, that queries scan."""

    def __init__(self, own: Codes, row: dict):
        self.own = own
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.codes, self.more = (np.frombuffer(row[c], np.uint8).reshape(len(self.ids), -1) for c in ("codes", "more"))
        self.norm, self.rest, self.left = (np.frombuffer(row[c], np.float64) for c in ("norms", "rests", "lefts"))
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), -1)
        slack = STEP * (2 + self.codes.shape[1]) * (1 + 2 * self.rest + self.left)
        self.rest_most, self.left_most = self.rest + slack, self.left + 2 * slack

    def nearest(self, q: np.ndarray, k: int, keep: int) -> list[np.ndarray]:
        """For every query the ids of the ``k`` rows of largest inner product, ties to smaller ids."""
        u, length = unit(q)
        tables, finer = self.own.first.tables(u), self.own.second.tables(u)
        score = np.zeros((len(q), len(self.ids)), np.float32)
        for lo in range(0, len(self.ids), 8192):
            part = self.codes[lo : lo + 8192]
            for m in range(part.shape[1]):
                score[:, lo : lo + 8192] += np.take(tables[:, m], part[:, m], axis=1)
        return [self._one(q[i], length[i], score[i].astype(np.float64), finer[i], k, keep) for i in range(len(q))]

    def _one(self, q, length, score, finer, k, keep):
        near = np.arange(len(score))
        if len(score) > max(k, keep):
            near = np.argpartition(-self.norm * score, max(k, keep) - 1)[: max(k, keep)]
        exact = products(self.x[near], q)
        if len(near) < len(score):
            # the k-th of these is reached by whoever belongs to the result
            least = np.partition(exact, len(exact) - k)[len(exact) - k] / length
            reach = self.norm * (score + self.rest_most) >= least
            reach[near] = False
            more = np.flatnonzero(reach)
            by = finer[np.arange(finer.shape[0]), self.more[more]].sum(1, dtype=np.float64)
            more = more[self.norm[more] * (score[more] + self.rest[more] * by + self.left_most[more]) >= least]
            near, exact = np.concatenate([near, more]), np.concatenate([exact, products(self.x[more], q)])
        return self.ids[near[np.lexsort((near, -exact))[:k]]]


def _scan(own: Codes, k: int, keep: int):
    def make():
        import pyarrow as pa

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    block, qids = Block(own, row), np.frombuffer(row["qids"], np.int64)
                    q = np.frombuffer(row["queries"], np.float64).reshape(len(qids), -1)
                    for lo in range(0, len(q), 64):
                        found = block.nearest(q[lo : lo + 64], k, keep)
                        yield pa.RecordBatch.from_arrays([pa.array(qids[lo : lo + 64]), pa.array(found, pa.list_(pa.int64()))], ["query_id", "near"])

        return run

    return make


RESULT = "query_id long, rank int, vec_id long, score double"


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("v") == (length[0].n if length else 0)).groupBy("id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, every: int = EVERY, k: int = K, keep: int = KEEP, sample: int = SAMPLE, **columns) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every row whose id ``every`` divides."""
    spark = session(vectors)
    ship(spark)
    rows = stage(valid_vectors(vectors, **columns), "ann-vectors")
    member = rows.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    member = stage(member.withColumn("rep", F.min("id").over(W.partitionBy("v"))), "ann-members")
    index = member.filter("r = 1").select("id", "v")
    fitted = np.array([r.v for r in index.orderBy(F.xxhash64("id", F.lit(6)), "id").limit(sample).collect()], np.float64)
    if not len(fitted):
        return spark.createDataFrame([], RESULT)
    own = Codes.fit(fitted)
    blocks = -(-index.count() * fitted.shape[1] * 8 // BLOCK)
    codes = map_arrow(index, _encode(own), CODED).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long"))
    codes = stage(codes.groupBy("block").applyInPandas(_pack_codes, PACKED), "ann-codes")
    queries = rows.filter(F.col("id") % every == 0)
    parts = max(1, -(-queries.count() // QUERIES))
    packed = queries.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("long")).groupBy("part").applyInPandas(_pack_queries, "part long, qids binary, queries binary")
    meet = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    scanned = map_arrow(meet.join(codes, "block").repartition("part", "block"), _scan(own, k + 1, keep), "query_id long, near array<long>")
    near = stage(scanned.select("query_id", F.explode("near").alias("rep")), "ann-near")
    mine = near.join(member.select("rep", F.col("id").alias("vec_id"), F.col("v").alias("x")), "rep").filter("query_id <> vec_id")
    exact = F.aggregate(F.zip_with("x", "q", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    scored = mine.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "vec_id", exact.alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
