"""Token counts of whole documents from counts of distinct pre-tokens.

Pass one gathers the distinct pre-tokens of the corpus with their frequencies;
each is tokenised once.  Pass two joins the counts to the frequencies of
pre-tokens in every document and sums; ids are never materialised.  The join has
two arms: the ``hot`` most frequent pre-tokens of up to ``HOT_LENGTH`` characters
(a fixed bound) are broadcast and met while a document is read, so that words that stand in every document never
travel; occurrences of all others are shuffled to the vocabulary and summed.

A pre-token is here a stretch without an inner blank, with its leading space,
which the library's own pre-tokeniser cuts further while counting.  Strings of
special tokens count as one token each, as the library takes them by default.

Null and empty texts: 0 bytes, 0 tokens.  Repeated rows: one result each.  Empty
table: no rows.
"""

from __future__ import annotations

from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, session, stage, table
from .tokens import PreTokens, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
HOT = 200_000
LIMIT = 1024
#: Characters of a pre-token that may be broadcast: with ``HOT`` the bound of the broadcast.
HOT_LENGTH = 48
#: Distinct pre-tokens, and characters of text they may come from, that a task holds before it passes them on.
HOLD, HOLD_CHARACTERS = 200_000, 32 << 20


def _frequencies(path: str):
    def make():
        from collections import Counter

        pre = PreTokens(path)

        def run(batches):
            seen: Counter = Counter()
            read = 0

            def out():
                keys = list(seen)
                for lo in range(0, len(keys), 20_000):
                    part = keys[lo : lo + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[k] for k in part], pa.int64())], ["piece", "freq"])

            for batch in batches:
                for text in batch.column(0):
                    text = text.as_py() or ""
                    seen.update(pre(text)[0])
                    read += len(text)
                    if len(seen) > HOLD or read > HOLD_CHARACTERS:
                        yield from out()
                        seen.clear()
                        read = 0
            yield from out()

        return run

    return make


def _piece_counts(path: str):
    def make():
        pre = PreTokens(path)

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pre.count(p) for p in batch.column(0).to_pylist()], pa.int64())], ["piece", "freq", "n"])

        return run

    return make


def _documents(path: str, hot):
    def make():
        from collections import Counter

        from pyspark import TaskContext

        table_ = pa.ipc.open_stream(hot.value).read_all()
        pre, known = PreTokens(path), dict(zip(table_["piece"].to_pylist(), table_["n"].to_pylist()))
        rare_type = pa.list_(pa.struct([("piece", pa.string()), ("freq", pa.int64())]))

        def run(batches):
            at = TaskContext.get().partitionId() << 36
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    keys, sizes, base, rare = [], [], [], []
                    for text in part.column(1).to_pylist():
                        pieces, total = pre(text)
                        left = []
                        for p, f in Counter(pieces).items():
                            n = known.get(p)
                            if n is None:
                                left.append({"piece": p, "freq": f})
                            else:
                                total += n * f
                        keys.append(at)
                        at += 1
                        sizes.append(len(text.encode()))
                        base.append(total)
                        rare.append(left)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), part.column(0), pa.array(sizes, pa.int64()), pa.array(base, pa.int64()), pa.array(rare, rare_type)], ["key", "doc_id", "n_bytes", "base", "rare"])

        return run

    return make


def hot_from(vocabulary: DataFrame, hot: int) -> int:
    """The least frequency from which at most ``hot`` pre-tokens are found (steps of a sixteenth of a power of two)."""
    step = F.floor(F.log2("freq") * 16)
    found, least = 0, 1
    for r in sorted(vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("freq").alias("lo"), F.max("freq").alias("hi")).collect(), key=lambda r: -r.step):
        found += r.n
        if found > hot:
            return r.hi + 1
        least = r.lo
    return least


def token_counts(docs: DataFrame, path: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of ``docs``."""
    spark, path = session(docs), path or tokenizer_path(VOCABULARY)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    seen = map_arrow(text.select("text"), _frequencies(path), "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    vocabulary = stage(map_arrow(seen, _piece_counts(path), "piece string, freq long, n long"), "pieces")
    short = vocabulary.filter(F.length("piece") <= HOT_LENGTH)
    top = short.filter(F.col("freq") >= hot_from(short, hot)).select("piece", F.col("n").cast("int")).toArrow()
    buffer = BytesIO()
    with pa.ipc.new_stream(buffer, top.schema) as out:
        out.write_table(top)
    top = spark.sparkContext.broadcast(buffer.getvalue())
    rows = stage(map_arrow(text, _documents(path, top), "key long, doc_id long, n_bytes long, base long, rare array<struct<piece:string,freq:long>>"), "piece-frequencies")
    rare = rows.select("key", F.explode("rare").alias("r")).select("key", "r.piece", "r.freq")
    more = rare.join(vocabulary.select("piece", "n"), "piece").groupBy("key").agg(F.sum(F.col("freq") * F.col("n")).alias("more"))
    return rows.select("key", "doc_id", "n_bytes", "base").join(more, "key", "left").select("doc_id", "n_bytes", (F.col("base") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
