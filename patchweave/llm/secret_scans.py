"""Secret scans: fixed patterns, and multipart credentials linked within scopes.

Base spans are the leftmost non-overlapping matches of three patterns (assign,
access, hex) of which those that are too short are dropped.  Offsets are code
points, ends exclusive.  Matches and their places come from extracting all
matches and splitting at them: a match starts after all the pieces and matches
before it.

The method adds weak candidates: identifiers (``user``, ``client id``, ...
assignments), secret-looking values (20 or more characters of mixed classes) and
endpoints (URLs with a scheme, host:port).  Parts of a document are joined on
intervals: two parts lie in one scope if the gap between them is at most
``SCOPE`` code points.  Parts are dealt into cells of that width, so that the
join is an equality on (row, cell) with a neighbour's copy.  A weak candidate is
reported only if complementary parts co-occur: a weak identifier beside a secret
part, a weak secret beside an identifier, a weak endpoint beside an identifier
and a secret.  Base spans act as parts too (access: identifier; assign and hex:
secret).  A weak candidate that overlaps a base span of its role is left to it.

Null text: no spans.  Empty and very long texts, ties and repeated rows: every
row by itself (rows are numbered).  Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, table

# Fixed values of the base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
ORDER = {"assign": 0, "access": 1, "hex": 2, "weak_id": 3, "weak_secret": 4, "weak_endpoint": 5}

WEAK_ID = r"""(?i:(?<![A-Za-z0-9])(?:user(?:name)?|login|client_?id|access_?key(?:_?id)?|account))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}"
WEAK_ENDPOINT = r"(?:(?<![A-Za-z])[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._:@/-]+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,8}:[0-9]{2,5}(?![0-9]))"
SCOPE = 300
SPAN = "array<struct<kind:string,at:int,end:int>>"
#: Matches of a text that are walked at a time, so that growing lists are short and the walk stays linear.
BLOCK = 256


def places(text: Column, pattern: str, kind: str, guard: Column, keep=None) -> Column:
    """The matches of ``pattern`` as (kind, at, end); ``keep`` sees (match index from 0) and may drop some."""
    sizes = lambda a: F.transform(a, lambda x: F.length(x))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(sizes(gaps), sizes(matches), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    one = lambda acc, x: F.struct((acc["pos"] + x["g"] + x["m"]).alias("pos"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), (acc["pos"] + x["g"]).alias("at"), (acc["pos"] + x["g"] + x["m"]).alias("end")))).alias("out"))
    # every block by itself from 0, then moved by the length of the blocks before it
    last = F.floor((F.size(both) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.filter(F.slice(both, b * BLOCK + 1, F.lit(BLOCK)), lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out")), one))
    moved = lambda s, by: F.struct(s["kind"].alias("kind"), (s["at"] + by).alias("at"), (s["end"] + by).alias("end"))
    walk = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, b: F.struct((acc["pos"] + b["pos"]).alias("pos"), F.concat(acc["out"], F.array(F.transform(b["out"], lambda s: moved(s, acc["pos"])))).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )
    found = walk if keep is None else F.filter(walk, keep)
    return F.when(guard, found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Base spans of a text in order of kind."""
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST["assign"])
    assign = F.transform(F.filter(F.arrays_zip(places(text, ASSIGN, "assign", F.lit(True)).alias("s"), long_enough.alias("ok")), lambda x: x["ok"]), lambda x: x["s"])
    assign = F.when(text.rlike(ASSIGN), assign).otherwise(F.array().cast(SPAN))
    wide = lambda kind: lambda s: s["end"] - s["at"] >= LEAST[kind]
    access = places(text, ACCESS, "access", F.contains(text, F.lit("AKIA")), wide("access"))
    # the longest run decides whether the pattern, which matches every run, has to be walked
    hexes = places(text, f"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}", "hex", text.rlike(f"[0-9a-f]{{{LEAST['hex']}}}"))
    return F.concat(assign, access, hexes)


def weak_spans(text: Column) -> Column:
    parts = [("weak_id", WEAK_ID), ("weak_secret", WEAK_SECRET), ("weak_endpoint", WEAK_ENDPOINT)]
    return F.concat(*[places(text, p, k, text.rlike(p)) for k, p in parts])


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = lambda s: F.element_at(F.create_map(*[F.lit(v) for kv in ORDER.items() for v in kv]), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["at"].alias("at"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, carry: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """Every row with ``carry`` columns, ``base`` and ``linked`` spans."""
    carry = carry or ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*carry, base_spans(text).alias("base"), weak_spans(text).alias("weak"))
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "secret-parts")
    role = F.when(F.col("p.kind").isin("access", "weak_id"), "id").when(F.col("p.kind") == "weak_endpoint", "endpoint").otherwise("secret")
    cell = lambda c: F.floor(F.col(c) / scope).cast("int")
    parts = rows.filter((F.size("weak") > 0)).select("_row", F.explode(F.concat("base", "weak")).alias("p")).select("_row", "p.kind", "p.at", "p.end", role.alias("role"))
    weak = parts.filter(F.col("kind").startswith("weak"))
    # a part of the other side within reach ends in, or starts in, a cell from one before to one after the candidate's own
    near = weak.select("_row", "kind", F.col("at").alias("a"), F.col("end").alias("b"), F.col("role").alias("r"), F.explode(F.sequence(F.floor((F.col("at") - scope) / scope).cast("int"), F.floor((F.col("end") + scope) / scope).cast("int"))).alias("cell"))
    reach = parts.select("_row", "at", "end", "role", F.explode(F.sequence(cell("at"), cell("end"))).alias("cell"), F.col("kind").startswith("weak").alias("is_weak"))
    pairs = near.join(reach, ["_row", "cell"]).filter((F.col("r") != F.col("role")) & (F.col("at") <= F.col("b") + scope) & (F.col("end") + scope >= F.col("a")))
    clear = weak.select("_row", "kind", F.col("at").alias("a"), F.col("end").alias("b"))
    roles = pairs.groupBy("_row", "kind", "a", "b").agg(F.bool_or(F.col("role") == "id").alias("id"), F.bool_or(F.col("role") == "secret").alias("secret"))
    met = roles.filter(F.when(F.col("kind") == "weak_id", F.col("secret")).when(F.col("kind") == "weak_secret", F.col("id")).otherwise(F.col("id") & F.col("secret")))
    linked = met.join(clear, ["_row", "kind", "a", "b"], "left_semi").groupBy("_row").agg(F.collect_set(F.struct("kind", F.col("a").alias("at"), F.col("b").alias("end"))).alias("linked"))
    out = rows.join(linked, "_row", "left").withColumn("linked", F.coalesce("linked", F.array().cast(SPAN)))
    covered = lambda w: F.exists("base", lambda b: (b["at"] < w["end"]) & (w["at"] < b["end"]) & (((w["kind"] == "weak_id") & (b["kind"] == "access")) | ((w["kind"] == "weak_secret") & (b["kind"] != "access"))))
    return out.select(*carry, "base", F.filter("linked", lambda w: ~covered(w)).alias("linked"))


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every stretch that a span covers replaced by ``mark``."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["at"].alias("at"), s["end"].alias("end"))))
    walk = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["at"] >= acc["pos"], F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.array(F.substring(text, acc["pos"] + 1, s["at"] - acc["pos"]), F.lit(mark))).alias("out"))).otherwise(F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, walk).otherwise(text)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows with base and linked spans masked; n_chars follows the text.  Null texts stay null."""
    # a row's spans stay beside it, whatever its id
    found = scan(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), ["_doc"])
    text = found.select("_doc.*", F.concat("base", "linked").alias("_spans")).withColumn("text", masked(F.col("text"), F.col("_spans"), mark))
    if "n_chars" in docs.columns:
        text = text.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return text.select(*docs.columns)


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "linked")).alias("spans"))
