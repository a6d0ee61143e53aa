"""String functions of records, keys and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha1_8(x: Column) -> Column:
    return F.substring(F.sha1(x.cast("binary")), 1, 8)


def clock(seconds: Column) -> Column:
    """MM:SS, with hours in front from an hour on; negative counts as 0."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", F.floor(s / 60), r))


def seconds_tag(seconds: Column, decimals: int = 1) -> Column:
    return F.format_string(f"<%.{decimals}f seconds>", seconds.cast("double"))


def image_tags(content: Column, n: Column) -> Column:
    """Leading image tags (any case) replaced by ``n`` of them on lines of their own."""
    bare = F.regexp_replace(content, r"(?i)^\s*(?:<image>\s*)+", "")
    return F.concat(F.repeat(F.lit("<image>\n"), n), bare)


def _name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(_name(path), r"(?<=.)\.[^.]+$", "")


def key_of(path: Column, key: Column, id_: Column) -> Column:
    """A record's own key if it has one; else stem, hash of the path and the first eight characters of the id, if any, joined by two underscores."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(key), F.concat_ws("__", stem(path), sha1_8(path), F.substring(some(id_), 1, 8)))


def _parts(path: Column) -> Column:
    """The parts of a path; single dots go, double dots take the part before them."""
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), F.array().cast("array<string>"), step)


def mirror_key(path: Column, root: Column, strip: bool = True) -> Column:
    """The path below ``root``, without its suffix if ``strip``; null for a path that does not lie below it."""
    p, r = _parts(path), _parts(root)
    inside = (path.startswith("/") == root.startswith("/")) & (F.size(p) > F.size(r)) & (F.slice(p, F.lit(1), F.size(r)) == r)
    key = F.array_join(F.slice(p, F.size(r) + 1, F.size(p)), "/")
    return F.when(inside, F.regexp_replace(key, r"(?<=[^/])\.[^./]+$", "") if strip else key)


def first_path(json: Column) -> Column:
    """First non-empty of video, path, video_path, at the top, then under custom."""
    got = lambda p: F.nullif(F.get_json_object(json, p), F.lit(""))
    return F.coalesce(*[got(f"$.{pre}{k}") for pre in ("", "custom.") for k in ("video", "path", "video_path")])


def caption(json: Column) -> Column:
    return F.coalesce(F.get_json_object(json, "$.response.body.choices[0].message.content"), F.lit(""))


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


VISION = ("<|vision_start|>", "<|image_pad|>", "<|vision_end|>")


def with_vision_runs(text: Column, runs: Column) -> Column:
    """``text`` with everything from its first vision start to its last vision end (and one line break) replaced by one
    stretch a run; runs: array of struct(label, tokens).  Text without such marks stays."""
    start, pad, end = VISION
    body = F.array_join(F.transform(runs, lambda r: F.concat(r["label"], F.lit(start), F.repeat(F.lit(pad), r["tokens"].cast("int")), F.lit(end + "\n"))), "")
    first, back = F.locate(start, text), F.locate(end[::-1], F.reverse(text))
    tail = F.substring(text, F.length(text) - back + 2, F.length(text))
    tail = F.when(tail.startswith("\n"), F.substring(tail, F.lit(2), F.length(text))).otherwise(tail)
    return F.when((first == 0) | (back == 0), text).otherwise(F.concat(F.substring(text, F.lit(1), first - 1), body, tail))
