"""BPE encoding and decoding with a distinct-word table.

Texts are split once.  The rows a task reads are cut into chunks of bounded size;
a chunk becomes one row that holds its distinct words and, for every document, the
places of its words in that list.  Words of all chunks are shuffled to tables by
word, where each distinct word is encoded once, and its ids go back to the chunks
by the word's place.  A chunk then reads its documents' ids off its places.  What
travels is a chunk's distinct words and a few bytes for each, never an occurrence,
and the most frequent word has as many rows as there are chunks.

A word is a stretch without an inner blank, with its leading space, which the
library's pre-tokeniser may cut further while it is encoded.  Strings of special
tokens inside a text are words of their own, as the library takes them by default.

Decoding joins ids to the pieces of the vocabulary (a table of fixed size), batch
by batch.  Bytes that are no UTF-8 become replacement characters; ids outside the
vocabulary have no piece and are skipped, as the library does.

Null and empty texts: no ids, which decode to an empty text.  Repeated rows: one
result each.  Texts of any length are one document of a chunk.  Empty table: no
rows.  Other columns of the input take no part.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release_part, session, ship, stage, table
from .tokens import PreTokens, byte_alphabet, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: Characters of text, distinct words and documents of a chunk.
CHUNK_CHARACTERS, CHUNK_WORDS, CHUNK_DOCS = 32 << 20, 600_000, 50_000
#: Places of words that a task encodes at a time.
HOLD = 100_000
#: Words and documents whose ids are made at a time, and places that are renumbered: what a worker holds beside its chunk.
WORDS_STEP, DOCS_STEP, PLACES_STEP = 5_000, 256, 1 << 20
#: Shares of the words (by hash) that are shuffled and encoded one after the other: what one needs on disk is gone before the next.
SLICES = 3
#: Compression of packed numbers.
LEVEL = 9


def _chunks(path: str, characters: int, words: int, docs: int):
    """For every chunk a row of kind 0 with its doc_ids, the lengths of documents and the places of their words, and one of kind 1 with its words."""

    def make():
        from array import array

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        pre = PreTokens(path)
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.string())]

        def split(text):
            if pre.cut is None or not any(s in text for s in pre.special):
                return pre.segment(text)
            out, at = [], 0
            for m in pre.cut.finditer(text):
                if at < m.start():
                    out += pre.segment(text[at : m.start()])
                out.append(m[0])
                at = m.end()
            return out + (pre.segment(text[at:]) if at < len(text) else [])

        def run(batches):
            chunk = TaskContext.get().partitionId() << 32
            seen, ids, lengths, places, read = {}, [], [], array("I"), 0

            def both():
                # the more frequent the word the smaller its place, which packs well
                of, own = np.frombuffer(places, np.uint32), list(seen)
                seen.clear()
                steps = [of[lo : lo + PLACES_STEP] for lo in range(0, len(of), PLACES_STEP)]
                count = np.zeros(len(own), np.int64)
                for step in steps:
                    count += np.bincount(step, minlength=len(own))
                order = np.argsort(-count, kind="stable")
                rank = np.empty(len(own), np.uint32)
                rank[order] = np.arange(len(own))
                for step in steps:
                    step[:] = rank[step]
                for row in ((0, chunk, ids, packed(lengths), packed(of), None), (1, chunk, None, None, None, [own[i] for i in order])):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["kind", "chunk", "doc_ids", "lengths", "places", "words"])

            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = split(text)
                    place = [seen.setdefault(w, len(seen)) for w in found]
                    ids.append(doc)
                    lengths.append(len(place))
                    places.extend(place)
                    read += len(text)
                    if read > characters or len(seen) > words or len(ids) >= docs:
                        yield from both()
                        chunk += 1
                        seen, ids, lengths, places, read = {}, [], [], array("I"), 0
            if ids:
                yield from both()
            seen, ids, lengths, places = {}, [], [], None
            pa.default_memory_pool().release_unused()  # a worker waits for its next task with what it holds

        return run

    return make


def packed(values) -> bytes:
    """32-bit numbers byte plane by byte plane, compressed: what ``unpacked`` gives back."""
    import numpy as np
    import pyarrow as pa

    octets = np.ascontiguousarray(np.asarray(values, "<u4")).view(np.uint8).reshape(-1, 4)
    planes = octets.tobytes("F")
    return len(planes).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=LEVEL).compress(planes, asbytes=True) if planes else b"")


def unpacked(data: bytes):
    import numpy as np
    import pyarrow as pa

    size = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _encode_words(path: str, hold: int):
    """From (word, chunk, place), equal words together: rows (chunk, places, sizes, ids), each of many words of a chunk; of places the steps from one to the next."""

    def make():
        import os

        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        last: list = [None, None]

        def rows(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            words = rows.column(0).combine_chunks().dictionary_encode()
            words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
            fresh = words.dictionary.to_pylist()
            again = fresh[0] == last[0]  # the word that the rows before ended in
            ids = [last[1]] * again
            for lo in range(int(again), len(fresh), WORDS_STEP):
                ids += [np.array(e.ids, "<u4") for e in tok.encode_batch_fast(fresh[lo : lo + WORDS_STEP], add_special_tokens=False)]
            last[:] = fresh[-1], ids[-1]
            size = np.array([len(x) for x in ids], np.int64)
            start, flat = np.cumsum(size) - size, np.concatenate(ids)
            word, chunk, place = (np.asarray(c) for c in (words.indices, rows.column(1), rows.column(2)))
            order = np.argsort(chunk, kind="stable")
            edges = np.flatnonzero(np.diff(chunk[order], prepend=-1, append=-1))
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                mine = order[a:b]
                mine = mine[np.argsort(place[mine])]
                w = word[mine]
                out.append((int(chunk[mine[0]]), packed(np.diff(place[mine], prepend=0)), packed(size[w]), packed(flat[gather(start[w], size[w])])))
            for lo in range(0, len(out), 1000):
                cols = list(zip(*out[lo : lo + 1000]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["chunk", "places", "sizes", "ids"])

        def run(batches):
            held, n = [], 0
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    n += batch.num_rows
                if n >= hold:
                    yield from rows(held)
                    held, n = [], 0
            if held:
                yield from rows(held)

        return run

    return make


def gather(starts, lengths):
    """Positions of stretches (start, length), one stretch after the other."""
    import numpy as np

    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _documents(docs, words):
    """The ids of a chunk's documents from its places and the ids of its words."""
    import numpy as np
    import pyarrow as pa

    if not docs.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
    none = np.zeros(0, "<u4")
    column = lambda name: map(unpacked, words[name].to_pylist())
    place = np.concatenate([none, *map(np.cumsum, column("places"))]).astype(np.int64)
    size, flat = np.concatenate([none, *column("sizes")]).astype(np.int64), np.concatenate([none, *column("ids")])
    start = np.zeros(len(place), np.int64)
    length = np.zeros(len(place), np.int64)
    start[place], length[place] = np.cumsum(size) - size, size
    row = docs.to_pylist()[0]
    of, n = unpacked(row["places"]), unpacked(row["lengths"]).astype(np.int64)
    edges, out = np.concatenate([[0], np.cumsum(n)]), []
    for lo in range(0, len(n), DOCS_STEP):  # in several batches, so that Spark reads them one by one
        own = edges[lo : lo + DOCS_STEP + 1]
        found = [flat[gather(start[of[a:b]], length[of[a:b]])].tobytes() if b > a else b"" for a, b in zip(own[:-1], own[1:])]
        out.append(pa.record_batch([pa.array(row["doc_ids"][lo : lo + DOCS_STEP], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "ids"]))
    return pa.Table.from_batches(out)


def _chunked(docs: DataFrame, path: str | None = None, characters: int = CHUNK_CHARACTERS, words: int = CHUNK_WORDS, chunk_docs: int = CHUNK_DOCS, hold: int = HOLD, slices: int = SLICES) -> DataFrame:
    """Chunks of documents, cogrouped with the ids of their words."""
    ship(session(docs))
    path = path or tokenizer_path(VOCABULARY)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = "kind int, chunk long, doc_ids array<long>, lengths binary, places binary, words array<string>"
    chunks = stage(map_arrow(text, _chunks(path, characters, words, chunk_docs), kinds), "bpe-chunks", codec="zstd", by="kind")
    placed = chunks.filter("kind = 1").select("chunk", F.posexplode("words").alias("place", "word")).select("word", "chunk", "place")
    encoded = None
    for k in range(slices):
        part = placed.filter(F.pmod(F.xxhash64("word"), F.lit(slices)) == k).repartition("word").sortWithinPartitions("word")
        part = stage(map_arrow(part, _encode_words(path, hold), "chunk long, places binary, sizes binary, ids binary"), "bpe-words")
        encoded = part if encoded is None else encoded.union(part)
    release_part(chunks, "kind=1")  # the words are encoded
    return chunks.filter("kind = 0").select("chunk", "doc_ids", "lengths", "places").groupBy("chunk").cogroup(encoded.groupBy("chunk"))


def encode(docs: DataFrame, path: str | None = None, **sizes) -> DataFrame:
    """doc_id, ids (unsigned 32-bit little-endian numbers) of every row of ``docs``."""
    return _chunked(docs, path, **sizes).applyInArrow(_documents, "doc_id long, ids binary")


def encode_and_decode(docs: DataFrame, path: str | None = None, **sizes) -> DataFrame:
    """``decode(encode(docs))``, ids and texts made by one Python worker a task instead of two."""
    path = path or tokenizer_path(VOCABULARY)
    return _chunked(docs, path, **sizes).applyInArrow(_documents_and_texts(path), "doc_id long, ids binary, text string")


def pieces(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary, in order; an id without a token has none."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    vocabulary = tok.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


@lru_cache(maxsize=1)
def _piece(path: str):
    """The bytes of every id, and none after the last; one for all tasks and chunks of a worker."""
    import pyarrow as pa

    return pa.array([*pieces(path), b""], pa.large_binary())


def _decoded(path: str, batches):
    """Batches (doc_id, ids) with their texts."""
    import numpy as np
    import pyarrow as pa

    piece = _piece(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, DOCS_STEP):
            rows = batch.slice(lo, DOCS_STEP)
            ids = [np.frombuffer(x or b"", "<u4") for x in rows.column(1).to_pylist()]
            joined = piece.take(pa.array(np.minimum(np.concatenate(ids), len(piece) - 1)))
            at, data = (np.frombuffer(b, t) for b, t in zip(joined.buffers()[1:], (np.int64, np.uint8)))
            edges = at[np.concatenate([[0], np.cumsum([len(x) for x in ids])])]
            out = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.string())], ["doc_id", "ids", "text"])


def _texts(path: str):
    return lambda: lambda batches: _decoded(path, batches)


def _documents_and_texts(path: str):
    def run(docs, words):
        import pyarrow as pa

        kinds = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])
        return pa.Table.from_batches(list(_decoded(path, _documents(docs, words).to_batches())), kinds)

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, text of rows (doc_id, ids); null ids decode to an empty text."""
    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), _texts(path or tokenizer_path(VOCABULARY)), "doc_id long, ids binary, text string")


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    found = encode_and_decode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), sha("ids").alias("ids_sha256"), sha("text").alias("decoded_sha256"))
