"""Transcript parsing and canonical chat rendering.

A raw transcript is a sequence of rows (conversation, turn order, text) whose
text may hold several lines, each perhaps opened by a speaker marker.  A hidden
Markov model with two states for each role (a turn's first line, and lines inside
it, which only follow lines of their turn) explains the lines: it emits the
marker class of a line (none, a role's marker, or a name that is not known), its
length class, whether it asks, and whether it opens the conversation.  Initial, transition and emission probabilities are counted
(with add-one smoothing) from rows with known roles; Viterbi recovers the roles.

Conversations of any length are decoded without gathering them.  Rows are sorted by
ranges and numbered; ``CHUNK`` neighbours of a conversation are a chunk.  Max-plus
products are associative, so every chunk becomes a matrix over states, ``2**FAN_BITS``
neighbouring matrices multiply to one, and so on until a conversation has one.  On
the way back every product hands the states at its edges to its factors, and
chunks decode by themselves between the states at their edges.  Ties go to the
role listed first.

Recovered turns begin at a line in a first-line state; adjacent rows of one turn
are merged, over the edges of chunks too.  Known markers are stripped (names that
are not known stay, as they may be text) and turns rendered as ``<|role|>\\ntext<|end|>``.

Null and empty texts: one empty line.  Null turn: ordered first.  Null
conversation: a conversation of its own.  Exactly repeated rows count once, in
learning too; a conversation opens with its smallest turn.
Unknown or null roles are left out of learning.  Empty table: no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, owned, stage, table

ROLES = ("system", "user", "assistant")
#: Speaker markers by role.
MARKERS = {
    "system": ("System", "SYSTEM", "[system]", "Instructions"),
    "user": ("User", "Human", "[user]", "Q", "Customer"),
    "assistant": ("Assistant", "AI", "[assistant]", "A", "Agent"),
}
#: Names that the transcripts of the query use and the parser does not know.
FOREIGN = {"system": "Note", "user": "Guest", "assistant": "Bot"}
CHUNK = 128
#: Neighbouring matrices that are multiplied at a time: 2**FAN_BITS.
FAN_BITS = 7
N_LENGTH = 6
#: marker class (0: none, then roles, then unknown names), length class, asks, opens
SHAPE = (len(ROLES) + 2, N_LENGTH, 2, 2)


@lru_cache
def _marker_pattern():
    import re

    every = sorted(((m, r) for r, ms in MARKERS.items() for m in ms), key=lambda x: (-len(x[0]), x[0]))
    names = "|".join(re.escape(m) for m, _ in every)
    lead = r"^\s*(?:[#>*-]\s*)?"
    return re.compile(rf"{lead}({names})\s*:\s*", re.IGNORECASE), {m.lower(): ROLES.index(r) + 1 for m, r in every}, re.compile(rf"{lead}[^\W\d_][\w.-]{{0,23}}:\s")


def features(lines: list[str], opens: bool) -> tuple[np.ndarray, list[str]]:
    """Feature classes (lines x 4) and the lines without their markers."""
    pattern, classes, name = _marker_pattern()
    out, bare = np.zeros((len(lines), 4), np.int64), []
    for i, line in enumerate(lines):
        m = pattern.match(line)
        body = line[m.end() :] if m else line
        bare.append(body)
        kind = classes[m[1].lower()] if m else len(ROLES) + 1 if name.match(line) else 0
        out[i] = (kind, min(N_LENGTH - 1, max(0, len(body).bit_length() - 4)), body.rstrip().endswith("?"), opens and i == 0)
    return out, bare


STATES = 2 * len(ROLES)  #: 2 r: first line of a turn of role r; 2 r + 1: inside it


class Model:
    """Log probabilities of an HMM over STATES."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.start, self.step, self.emit = start, step, emit

    @staticmethod
    def from_counts(start, step, emit) -> "Model":
        state = np.arange(STATES)
        first = state % 2 == 0
        may = first[None, :] | (state[:, None] // 2 == state[None, :] // 2)

        def norm(a, allowed):
            a = np.where(allowed, np.asarray(a, float) + 1.0, 0.0)
            with np.errstate(divide="ignore"):
                return np.log(a / a.sum(-1, keepdims=True))

        return Model(norm(start, first), norm(step, may), [norm(e, np.ones_like(e, bool)) for e in emit])

    def scores(self, f: np.ndarray) -> np.ndarray:
        return sum(e[:, f[:, k]] for k, e in enumerate(self.emit)).T

    def moves(self, f: np.ndarray, opens: bool):
        """For every line the max-plus matrix [state before, state of the line]; an opening line ignores what was before."""
        for i, row in enumerate(self.scores(f)):
            yield (np.broadcast_to(self.start, (STATES, STATES)) if opens and i == 0 else self.step) + row[None, :]

    def matrix(self, f: np.ndarray, opens: bool) -> np.ndarray:
        out = None
        for one in self.moves(f, opens):
            out = one if out is None else (out[:, :, None] + one[None]).max(1)
        return out

    def path(self, f: np.ndarray, opens: bool, before: np.ndarray, last: int | None) -> np.ndarray:
        """The best states of lines from scores ``before``, ending in ``last`` if given."""
        back, alpha = [], before
        for one in self.moves(f, opens):
            reach = alpha[:, None] + one
            back.append(reach.argmax(0))
            alpha = reach.max(0)
        states = np.zeros(len(f), np.int64)
        states[-1] = int(alpha.argmax()) if last is None else last
        for i in range(len(f) - 1, 0, -1):
            states[i - 1] = back[i][states[i]]
        return states


def _count():
    import pyarrow as pa

    def run(batches):
        start, step = np.zeros(STATES), np.zeros((STATES, STATES))
        emit = [np.zeros((STATES, n)) for n in SHAPE]
        for batch in batches:
            for text, role, prev, long, opens in zip(*(c.to_pylist() for c in batch.columns)):
                f, _ = features((text or "").split("\n"), opens)
                r = 2 * ROLES.index(role)
                if opens:
                    start[r] += 1
                elif prev in ROLES:
                    step[2 * ROLES.index(prev) + long, r] += 1
                if len(f) > 1:
                    step[r, r + 1] += 1
                    step[r + 1, r + 1] += len(f) - 2
                states = np.full(len(f), r + 1)
                states[0] = r
                for k in range(4):
                    np.add.at(emit[k], (states, f[:, k]), 1)
        flat = np.concatenate([start, step.ravel(), *[e.ravel() for e in emit]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "n"])

    return run


def train(rows: DataFrame) -> Model:
    """Counts over all given rows (conv_id, turn, role, text)."""
    # the role before, by an equality on the turn's number within the conversation
    known = rows.filter(F.col("role").isin(*ROLES)).select("conv_id", "turn", "role", "text").distinct()
    # of rows that share a turn the least by role and text comes before the next turn
    least = known.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("r"))
    before = least.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("r.role").alias("prev"), F.coalesce(F.contains("r.text", F.lit("\n")), F.lit(False)).cast("int").alias("long"))
    first = rows.groupBy("conv_id").agg(F.min("turn").alias("first"))
    opens = F.coalesce(F.col("turn") == F.col("first"), F.lit(False)).alias("opens")
    joined = known.join(before, ["conv_id", "turn"], "left").join(first, "conv_id", "left").select("text", "role", "prev", "long", opens)
    flat = {r.k: r.n for r in map_arrow(joined, lambda: _count(), "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    sizes = [STATES, STATES**2, *[STATES * n for n in SHAPE]]
    values = np.array([flat.get(i, 0.0) for i in range(sum(sizes))])
    start, step, *emit = np.split(values, np.cumsum(sizes)[:-1])
    return Model.from_counts(start, step.reshape(STATES, STATES), [e.reshape(STATES, n) for e, n in zip(emit, SHAPE)])


def by_key(df: DataFrame, keys: list[str], order: list, make, schema: str) -> DataFrame:
    """Rows of a key, in order, given to ``make()(key, rows)``, which returns result rows.

    Partitions are sorted by key and read as a stream: one group is held at a time, without a data frame for each.
    """
    at = [df.columns.index(k) for k in keys]
    names = [c.split()[0] for c in schema.split(", ")]

    def factory():
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_json_string

        each, target = make(), to_arrow_schema(_parse_datatype_json_string(kinds))

        def run(batches):
            key, held, out = None, [], []

            def flush():
                cols = list(zip(*out)) or [()] * len(names)
                batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, target)], names)
                out.clear()
                return batch

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    now = tuple(row[i] for i in at)
                    if held and now != key:
                        out.extend(each(key, held))
                        held = []
                        if len(out) >= 5_000:
                            yield flush()
                    key = now
                    held.append(row)
            if held:
                out.extend(each(key, held))
            yield flush()

        return run

    spark = df.sparkSession
    kinds = spark.createDataFrame([], schema).schema.json()
    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys, *order), factory, schema)


def _chunk_matrix(model: Model):
    def make():
        def run(key, rows):
            out = None
            for k, (_, _, _, text, opens) in enumerate(rows):
                one = model.matrix(features(text.split("\n"), opens and k == 0)[0], opens and k == 0)
                out = one if out is None else (out[:, :, None] + one[None]).max(1)
            return [(*key, out.ravel().tolist())]

        return run

    return make


def _product():
    def run(key, rows):
        out = None
        for r in rows:
            one = np.array(r[3]).reshape(STATES, STATES)
            out = one if out is None else (out[:, :, None] + one[None]).max(1)
        return [(*key, out.ravel().tolist())]

    return run


def _whole():
    """The last state of a whole conversation from its matrix; no state lies before it."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            last = [int(np.array(m).reshape(STATES, STATES).max(0).argmax()) for m in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([-1] * len(last), pa.int32()), pa.array(last, pa.int32())], ["key", "g", "first", "last"])

    return run


def _before(first: int) -> np.ndarray:
    alpha = np.zeros(STATES)
    if first >= 0:
        alpha[:] = -np.inf
        alpha[first] = 0.0
    return alpha


def _factors():
    """The states before and at the end of every factor, from those of the product."""

    def run(key, rows):
        mats = [np.array(r[3]).reshape(STATES, STATES) for r in rows]
        first, last = rows[0][4:6]
        alpha, before = _before(first), []
        for m in mats:
            before.append(alpha)
            alpha = (alpha[:, None] + m).max(0)
        ends = []
        for m, a in zip(reversed(mats), reversed(before)):
            ends.append(last)
            last = int((a + m[:, last]).argmax())
        ends = ends[::-1]
        return [(key[0], r[2], f, e) for r, f, e in zip(rows, [first, *ends[:-1]], ends)]

    return run


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}<|end|>"


def _decode(model: Model):
    def make():
        def run(key, rows):
            opens, first, last = rows[0][5:8]
            parts = [features(r[4].split("\n"), opens and k == 0) for k, r in enumerate(rows)]
            states = model.path(np.concatenate([f for f, _ in parts]), opens, _before(first), last)
            out, k = [], 0
            for r, (_, bare) in zip(rows, parts):
                for line in bare:
                    role, inside = divmod(int(states[k]), 2)
                    if not inside or not out:
                        out.append([r[3], role, [line], bool(inside)])
                    else:
                        out[-1][2].append(line)
                    k += 1
            return [(*key, i, turn, ROLES[role], "\n".join(lines), inside) for i, (turn, role, lines, inside) in enumerate(out)]

        return run

    return make


def _numbered(rows: DataFrame, chunk: int) -> DataFrame:
    """key (the conversation as text), pos (its place among all rows in order), g (chunk), turn, text; written.

    Ranges are cut on a prefix of the text, so that rows without turn are dealt as well and samples of it stay small.
    """
    clean = rows.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.substring("text", 1, 32)]
    ranged = clean.repartitionByRange(*order).sortWithinPartitions(*order[:2], "text").withColumn("_at", F.monotonically_increasing_id())
    ranged = stage(ranged.withColumn("_part", F.shiftright("_at", 33)), "chat-sorted")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # a row of 16 bytes a partition of the shuffle
    before = F.broadcast(counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before")))
    pos = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return ranged.join(before, "_part").withColumn("pos", pos).select("key", F.floor(F.col("pos") / chunk).alias("g"), "pos", "turn", "text")


def _edges(nodes: DataFrame) -> DataFrame:
    """key, g, first, last: the states before (-1: none) and at the end of every chunk, from their matrices (key, g, m)."""
    levels, tops, kinds = [], [], "key string, g long, first int, last int"
    while True:
        several = nodes.groupBy("key").agg(F.count("*").alias("n"))
        tops.append(map_arrow(nodes.join(several.filter("n = 1").select("key").hint("merge"), "key", "left_semi"), lambda: _whole(), kinds))
        below = nodes.join(several.filter("n > 1").select("key").hint("merge"), "key", "left_semi").select("key", F.shiftright("g", FAN_BITS).alias("p"), "g", "m")
        if not below.limit(1).count():
            break
        levels.append(below)
        nodes = stage(by_key(below, ["key", "p"], ["g"], _product, "key string, g long, m array<double>"), "chat-products")
    edges = tops.pop()
    while levels:
        above = edges.withColumnRenamed("g", "p")
        # shuffled at every size: edges grow with the conversations
        own = levels.pop().join(above.hint("merge"), ["key", "p"]).select("key", "p", "g", "m", "first", "last")
        edges = by_key(own, ["key", "p"], ["g"], _factors, kinds).union(tops.pop())
    return edges


def parse(rows: DataFrame, model: Model, chunk: int = CHUNK) -> DataFrame:
    """Recovered turns of transcripts (conv_id, turn, text): conv_id, chunk, at, turn, role, text, rendered."""
    with owned() as own:
        lines = _numbered(rows, chunk)
        first = lines.groupBy("key").agg(F.min("g").alias("g")).withColumn("opens", F.lit(True))
        lines = lines.join(first.hint("merge"), ["key", "g"], "left").select("key", "g", "pos", "turn", "text", F.coalesce("opens", F.lit(False)).alias("opens"))
        nodes = by_key(lines.select("key", "g", "pos", "text", "opens"), ["key", "g"], ["pos"], _chunk_matrix(model), "key string, g long, m array<double>")
        edges = _edges(stage(nodes, "chat-chunks"))
        joined = lines.join(edges.hint("merge"), ["key", "g"]).select("key", "g", "pos", "turn", "text", "opens", "first", "last")
        pieces = stage(by_key(joined, ["key", "g"], ["pos"], _decode(model), "key string, g long, at int, turn long, role string, text string, goes_on boolean"), "chat-pieces")
        # a piece that goes on belongs to the last turn that began in a chunk before it: one row a chunk is looked through
        begun = pieces.groupBy("key", "g").agg(F.max(F.when(~F.col("goes_on"), F.col("at"))).alias("s"), F.bool_or("goes_on").alias("goes_on"))
        last = F.last(F.when(F.col("s").isNotNull(), F.struct(F.col("g").alias("g"), F.col("s").alias("at"))), True).over(W.partitionBy("key").orderBy("g").rowsBetween(W.unboundedPreceding, -1))
        home = begun.withColumn("home", last).filter("goes_on").select("key", "g", F.col("home.g").alias("hg"), F.col("home.at").alias("hat"))
        tails = pieces.filter("goes_on").join(home.hint("merge"), ["key", "g"]).groupBy("key", F.col("hg").alias("g"), F.col("hat").alias("at")).agg(F.array_sort(F.collect_list(F.struct("g", "text"))).alias("more"))
        turns = pieces.filter(~F.col("goes_on")).join(tails.hint("merge"), ["key", "g", "at"], "left")
        own.keep(pieces)
    text = F.concat_ws("\n", F.col("text"), F.array_join(F.transform("more", lambda x: x["text"]), "\n"))
    turns = turns.select(F.nullif("key", F.lit("")).cast("long").alias("conv_id"), F.col("g").alias("chunk"), "at", "turn", "role", text.alias("text"))
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>")))


def transcripts(rows: DataFrame) -> DataFrame:
    """Raw transcripts made of a table with roles: of six turns four open with a marker of their role, one with a name the parser does not know, one with none, by hash."""
    pick = F.pmod(F.xxhash64("conv_id", "turn", F.lit(4)), F.lit(6))
    marker = F.lit(None).cast("string")
    for role, names in MARKERS.items():
        at = F.pmod(F.xxhash64("conv_id", "turn", F.lit(5)), F.lit(len(names)))
        for i, n in enumerate(names):
            marker = F.when((F.col("role") == role) & (at == i), n).otherwise(marker)
        marker = F.when((F.col("role") == role) & (pick == 1), FOREIGN[role]).otherwise(marker)
    text = F.when(marker.isNotNull() & (pick > 0), F.concat(marker, F.lit(": "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", text.alias("text"))


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """Turns recovered from transcripts of all conversations; the model counts conversations whose crc32 mod 4 is not 2."""
    raw = transcripts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    fold = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    model = train(raw.filter(F.coalesce(fold != 2, F.lit(False))))
    return parse(raw, model).withColumn("held_out", F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
