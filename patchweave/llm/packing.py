"""Concatenate-and-cut packing of token streams into fixed windows.

Pass one tokenises every document once and writes its ids (two bytes each) with
the number of ids before it in its partition; totals of partitions are summed to
offsets (a prefix sum over as many rows as there are partitions).  Pass two adds
both and cuts at multiples of the window: a document that crosses a boundary
yields one boundary record for each window it touches.

Null text counts as empty: the document is its end id alone.  Empty table: no
rows.  Repeated rows are packed as often as they occur.  Only the last sequence
can be shorter than the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, session, stage, table
from .tokens import tokenizer_path, word_ids

WINDOW = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"


def _tokenise(path: str, end_id: int):
    def make():
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        ids = word_ids(path)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u2").tobytes()

        def run(batches):
            before = 0
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    piece = batch.slice(lo, 512)
                    got = [ids(t) + end for t in piece.column(1).to_pylist()]
                    n = np.array([len(g) // 2 for g in got], np.int64)
                    first = before + np.cumsum(n) - n
                    before += int(n.sum())
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(n), part)), pa.array(first), pa.array(n), pa.array(got, pa.binary())], ["doc_id", "part", "first", "n", "ids"])

        return run

    return make


def _cut(window: int):
    def make():
        import numpy as np
        import pyarrow as pa

        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    rows = batch.slice(lo, 512)
                    out = [[] for _ in range(7)]
                    for doc, at, n, ids in zip(*(c.to_pylist() for c in rows.columns)):
                        wide = np.frombuffer(ids, "<u2").astype("<u4")
                        start = 0
                        while start < n:
                            seq, off = divmod(at + start, window)
                            length = min(n - start, window - off)
                            for o, v in zip(out, (doc, start, length, n, seq, off, wide[start : start + length].tobytes())):
                                o.append(v)
                            start += length
                    yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, [pa.int64()] * 6 + [pa.binary()])], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        return run

    return make


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit little-endian)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = stage(map_arrow(text, _tokenise(path or tokenizer_path(VOCABULARY), end_id), "doc_id long, part long, first long, n long, ids binary"), "pack-tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    # one row of 16 bytes a partition of the scan: a size the scan's own planning already holds on the driver
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("first")).alias("at"), "n", "ids")
    return map_arrow(placed, _cut(window), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
