"""Token-ID output: best-fit-decreasing packing into rows of equal length.

Texts are tokenised once, dealt into shards of bounded size by hash, and packed within
their shard: the longest piece first, each into the row with the least room that still
takes it, found with a segment tree over capacities. A document longer than a row is cut
into whole rows and a rest, without loss. Each packed row has its ids as one fixed-length
binary (little-endian), the cumulative lengths of its segments and the places where
positions start again.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the byte-level vocabulary cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
CAPACITY = 2048
#: Bytes of text in a shard, on average: what one task packs at a time.
SHARD_BYTES = 1 << 20
#: Longer texts are encoded in pieces of at least so many characters.
_PIECE = 1 << 18

SCHEMA = "shard int, row int, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, segments array<struct<doc_id long, start long, length int>>"


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode(encoding, text: str) -> list[int]:
    """All ids of a text.

    A long one is encoded in pieces that end before white space after another character,
    where the pattern always cuts. Within a word, or white space, of over ``_PIECE``
    characters there is no such place: it is cut anyway, without loss, because the tokenizer
    can't take runs of a million.
    """
    if len(text) <= _PIECE:
        return encoding.encode_ordinary(text)
    out: list[int] = []
    at = 0
    while at < len(text):
        end = at + _PIECE
        while end < min(len(text), at + 2 * _PIECE) and not (text[end].isspace() and not text[end - 1].isspace()):
            end += 1
        out += encoding.encode_ordinary(text[at:end])
        at = end
    return out


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int | None = END_OF_TEXT, text: str = "text") -> DataFrame:
    """(doc_id, h, ids) for the rows with text: ids as 16-bit integers, closed by ``end``; ``h`` a hash of id, text and the row's place."""
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())  # the vocabulary, about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            ids = pa.array((array("H", encode(encoding, t) + ([] if end is None else [end])).tobytes() for t in batch.column(2).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["doc_id", "h", "ids"])

    t = F.col(text)
    rows = docs.where(t.isNotNull() & (t != "")).select("doc_id", F.xxhash64("doc_id", t, F.monotonically_increasing_id()).alias("h"), t.alias("_t"))
    return rows.mapInArrow(run, "doc_id long, h long, ids binary")


class Rows:
    """Open rows by room left, with a segment tree over 0..capacity that finds the least room of at least so much."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.capacity, self.n = capacity, 0

    def _mark(self, room: int, value: int) -> None:
        i = room + self.leaves
        self.tree[i] = value
        while i > 1:
            i >>= 1
            value = self.tree[2 * i] | self.tree[2 * i + 1]
            if self.tree[i] == value:
                break
            self.tree[i] = value

    def _least(self, size: int) -> int | None:
        """The least room of at least ``size`` that a row has."""
        i = size + self.leaves
        if self.tree[i]:
            return size
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None

    def place(self, size: int) -> int:
        """The row that takes a piece of this size; a new one if no other can."""
        room = self._least(size)
        if room is None:
            row, room = self.n, self.capacity
            self.n += 1
        else:
            row = self.rooms[room].pop()
            if not self.rooms[room]:
                self._mark(room, 0)
        if room > size:
            if not self.rooms[room - size]:
                self._mark(room - size, 1)
            self.rooms[room - size].append(row)
        return row


def pack_lengths(lengths: list[int], capacity: int) -> list[int]:
    """The row of each piece; lengths must be in decreasing order and at most ``capacity``."""
    rows = Rows(capacity)
    return [rows.place(n) for n in lengths]


def _packed(capacity: int, pad: int):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32())]))

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        docs = table.column("doc_id").to_pylist()
        ids = [np.frombuffer(x.as_py(), np.uint16) for x in table.column("ids")]
        # whole documents in an order that does not depend on how rows arrived
        order = sorted(range(len(docs)), key=lambda i: (docs[i] is None, docs[i] or 0, ids[i].tobytes()))
        pieces = [(min(capacity, len(ids[i]) - at), i, at) for i in order for at in range(0, len(ids[i]), capacity)]
        pieces.sort(key=lambda p: -p[0])
        rows: list[list[tuple[int, int, int]]] = []
        for piece, row in zip(pieces, pack_lengths([p[0] for p in pieces], capacity), strict=True):
            if row == len(rows):
                rows.append([])
            rows[row].append(piece)
        matrix = np.full((len(rows), capacity), pad, np.uint16)
        ends = []
        for k, row in enumerate(rows):
            at = [0]
            for n, i, start in row:
                matrix[k, at[-1] : at[-1] + n] = ids[i][start : start + n]
                at.append(at[-1] + n)
            ends.append(at)
        ints = pa.list_(pa.int32())
        return pa.table(
            {
                "shard": pa.array([shard] * len(rows), pa.int32()),
                "row": pa.array(range(len(rows)), pa.int32()),
                "n_tokens": pa.array([at[-1] for at in ends], pa.int32()),
                "ids": pa.array([m.tobytes() for m in matrix], pa.binary()),
                "cu_seqlens": pa.array(ends, ints),
                "resets": pa.array([at[:-1] for at in ends], ints),
                "segments": pa.array([[{"doc_id": docs[i], "start": start, "length": n} for n, i, start in row] for row in rows], kind),
            }
        )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END_OF_TEXT, shard_bytes: int = SHARD_BYTES, text: str = "text") -> DataFrame:
    """Packed rows of ``docs`` (doc_id, text), see ``SCHEMA``.

    ``ids`` holds ``capacity`` 16-bit ids, filled up with ``end`` after ``n_tokens``;
    ``cu_seqlens`` starts with 0 and ends with ``n_tokens``; ``resets`` are the places where
    a segment, and its positions, start. ``segments`` says which tokens of which document
    each is. Null and empty texts give no tokens; repeated rows are packed each, and dealt
    out like any others (which shard a row goes to depends on its place in its file, too).
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    dealt = tokenize(docs, vocabulary, pattern, end, text).select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "doc_id", "ids")
    return dealt.groupBy("shard").applyInArrow(_packed(capacity, end), SCHEMA)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, ids) again: the segments of each document put together in order, as 16-bit ids. For tables without repeated doc_ids."""
    cut = F.transform("segments", lambda s, i: F.struct(s["doc_id"].alias("doc_id"), s["start"].alias("start"), F.substring(F.col("ids"), 2 * F.get("resets", i) + 1, 2 * s["length"]).alias("part")))
    parts = packed.select(F.explode(cut).alias("s")).groupBy("s.doc_id").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.part"))).alias("p"))
    return parts.select("doc_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["part"])).alias("ids"))


def op8(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
