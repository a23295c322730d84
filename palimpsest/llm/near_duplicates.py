"""MinHash near-duplicates with odd sketches.

Documents of equal shingle sets become one node first, so copies never form pairs. Each
node has MinHash samples, banded into buckets, and an odd sketch: a bitmap in which every
sample flips one bit, so that two sketches differ in few bits only if most samples agree.
A second odd sketch, of the whole shingle set, has at most as many differing bits as the
sets have different shingles, so it rules pairs out for certain.

Within a bucket the most typical member is compared with every other; afterwards members
that are still in different components are compared too, so no link between two texts of a
bucket is missed. A large bucket in which much is unlinked (a template whose pages fall
short of the limit) is split for that by rare shingles: two sets of the wanted similarity
share one of their few rarest, so pages that have only the template in common never meet.
Sketches decide which pairs are worth it, full shingle sets decide the links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .charblocks import mix, powers
from .common import materialize

#: Samples in a band and bands: two sets of similarity 0.8 share no bucket with probability 6e-5.
ROWS, BANDS = 6, 32
#: Bits of an odd sketch, as 64-bit words.
SKETCH_WORDS = 8
#: 64-bit words of the odd sketch of a whole set.
WHOLE_WORDS = 16
#: A pair is verified if its sketches' estimate falls short of the limit by at most this: five standard deviations of the sampling and the sketch.
SLACK = 0.2
#: A bucket with more members in question is split by their rarest shingles.
HOT = 16
#: Counters that tell how rare a shingle is (by hash; what shares one only looks more common).
SLOTS = 1 << 20
#: Rows of an Arrow batch that are worked on at a time, and bytes of their text.
_ROWS, _BYTES = 500, 4 << 20
#: Up to so many ids (24 bytes each) are sent to every executor to pick out their texts; beyond that the join shuffles.
BROADCAST_IDS = 2_000_000
_CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def _word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words in UTF-8 text, ASCII letters lower-cased."""
    found = []
    at = 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not _SPACE[data[end]] and end < at + 2 * _CHUNK:
            end += 1
        raw = np.frombuffer(data[at:end].lower(), np.uint8)
        step = np.diff((~_SPACE[raw]).astype(np.int8), prepend=0, append=0)
        start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        h = np.zeros(len(raw) + 1, np.uint64)
        up, down = powers(2 * _CHUNK + 2)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=h[1:])
        found.append(mix((h[stop] - h[start]) * down[start] + (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; of the whole sequence if it is shorter; none without words."""
    h = _word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _MULTIPLIER + h[k : len(h) - size + 1 + k]
    return np.unique(mix(out))


def set_key(shingles: np.ndarray) -> bytes | None:
    """The same 128 bits for equal sets; null for the empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


class Sampler:
    def __init__(self, rows: int = ROWS, bands: int = BANDS, words: int = SKETCH_WORDS, seed: int = 11):
        rng = np.random.default_rng(seed)
        k = rows * bands
        self.rows, self.bands, self.words = rows, bands, words
        self.a = rng.integers(0, 1 << 31, (k, 1), np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (k, 1), np.uint32)
        self.salt = mix(np.arange(1, k + 1, dtype=np.uint64))

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(out, (self.a * x[None, at : at + 2048] + self.b).min(1), out=out)
        return out

    def buckets(self, samples: np.ndarray) -> np.ndarray:
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for row in samples.reshape(self.bands, self.rows).T:
            out = mix(out * _MULTIPLIER + row)
        return out.view(np.int64)

    @staticmethod
    def whole(shingles: np.ndarray) -> np.ndarray:
        """The odd sketch of a set: the parity of its shingles in each of ``64 * WHOLE_WORDS`` places."""
        place = (shingles & np.uint64(64 * WHOLE_WORDS - 1)).astype(np.int64)
        return np.packbits((np.bincount(place, minlength=64 * WHOLE_WORDS) & 1).astype(np.uint8)).view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        bit = mix(samples.astype(np.uint64) ^ self.salt) % np.uint64(64 * self.words)
        odd = (np.bincount(bit.astype(np.int64), minlength=64 * self.words) & 1).astype(np.uint8)
        return np.packbits(odd).view(np.int64)


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """An Arrow batch (text in the second column) in slices of few rows and, unless one row is longer, few bytes."""
    sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0), np.int64))
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, min(at + _ROWS, int(np.searchsorted(sizes, before + _BYTES, "right"))))
        yield batch.slice(at, end - at)
        at = end


_LONGS = pa.list_(pa.int64())


def _sketched(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for part in (p for batch in batches for p in _portions(batch)):
            size, key, buckets, sketch, whole = [], [], [], [], []
            for text in part.column(1):
                s = shingle_set(text.as_py(), n)
                size.append(len(s))
                key.append(set_key(s))
                samples = sampler.samples(s) if len(s) else None
                buckets.append(None if samples is None else sampler.buckets(samples))
                sketch.append(None if samples is None else sampler.sketch(samples))
                whole.append(None if samples is None else sampler.whole(s))
            arrays = [part.column(0), part.column(2), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(buckets, _LONGS), pa.array(sketch, _LONGS), pa.array(whole, _LONGS)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "t", "n_shingles", "key", "buckets", "sketch", "whole"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _portions(batch)):
            found = [shingle_set(text.as_py(), n) for text in part.column(1)]
            # another text of the same doc_id is not the one asked for
            own = [i for i, (s, node) in enumerate(zip(found, part.column(0).to_pylist(), strict=True)) if set_key(s) == node]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), pa.array([found[i].view(np.int64) for i in own], _LONGS)], ["node", "set"])

    return run


def rarest(shingles: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """A set's rarest shingles, and how many of them it is looked up by.

    Of two sets with at least ``percent`` similarity the larger one has one of the
    shingles that the smaller one is looked up by among all of its rarest.
    """
    n = len(shingles)
    order = np.lexsort((shingles, counts[(shingles & np.uint64(len(counts) - 1)).astype(np.int64)]))
    return shingles[order[: n + percent * n // -100 + 1]], n + 2 * percent * n // -(100 + percent) + 1


def _rarest(counts, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, token, few = [], [], [], []
            for x, s in zip(batch.column(0), batch.column(1), strict=True):
                found, lookups = rarest(s.values.to_numpy(zero_copy_only=False).view(np.uint64), counts.value, percent)
                node += [x.as_py()] * len(found)
                n += [len(s)] * len(found)
                token.append(found.view(np.int64))
                few.append(np.arange(len(found)) < lookups)
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(np.concatenate(token)), pa.array(np.concatenate(few))], ["node", "n", "token", "lookup"])

    return run


def most_bits(least: float) -> int:
    """The number of differing sketch bits up to which a pair is verified.

    Of two sets of similarity J, about 2 k (1 - J) samples' bits are flipped in one sketch
    only, so n / 2 * (1 - exp(-4 k (1 - J) / n)) of n bits differ.
    """
    n, k = 64 * SKETCH_WORDS, ROWS * BANDS
    return math.floor(n / 2 * (1 - math.exp(-4 * k / n * (1 - max(least - SLACK, 0)))))


def _bits(a: str, b: str, words: int) -> Column:
    each = [F.bit_count(F.get(F.col(a), i).bitwiseXOR(F.get(F.col(b), i))) for i in range(words)]
    return sum(each[1:], each[0])


def _sides(nodes: DataFrame) -> list[DataFrame]:
    """What ``_promising`` needs of a pair's nodes a and b."""
    return [nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"), F.col("whole").alias(f"whole_{x}")) for x in ("a", "b")]


def _promising(percent: int) -> Column:
    """Whether a pair has to be verified: its samples agree well enough, and its sets may differ in few enough shingles."""
    most = F.col("n_a") + F.col("n_b")
    return ((100 + percent) * _bits("whole_a", "whole_b", WHOLE_WORDS) <= (100 - percent) * most) & (_bits("sketch_a", "sketch_b", SKETCH_WORDS) <= most_bits(percent / 100))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): the smallest node that each can reach.

    Large-star and small-star steps in turn, until every link leads to its component's
    smallest node; each round is written to the shared folder.
    """
    stars = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct())
        tip = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if tip.isEmpty() and after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        stars = after


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text, doc_id) for the nodes in ``wanted`` (node, doc): rows of the document that stands for each."""
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return docs.select(F.col("doc_id").alias("doc"), "text").join(few, "doc").select("node", "text")


def _shingles(wanted: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(node, set), once for each node."""
    return materialize(_texts(wanted, docs).mapInArrow(_sets(n), "node binary, set array<long>").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the materialised pairs (a, b) of nodes whose full sets have at least ``percent`` similarity."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _shingles(materialize(nodes.select("node", "doc").join(ends, "node", "left_semi")), docs, n)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("i"), (F.size("set_a") + F.size("set_b")).alias("t"))
    return shared.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b").distinct()


def _by_rare_shingles(members: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) worth a look among ``members`` (node, component, few): those that share one of their rarest shingles, one of them ``few``, in different components.

    Rareness is counted in ``SLOTS`` counters over the members; every pair of the wanted
    similarity is found whatever they say.
    """
    spark = docs.sparkSession
    sets = _shingles(materialize(nodes.select("node", "doc").join(members, "node", "left_semi")), docs, n)
    slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1))
    counts = np.zeros(SLOTS, np.int64)
    for r in sets.select(F.explode("set").alias("h")).groupBy(slot.alias("s")).agg(F.count("*").alias("n")).toLocalIterator():
        counts[r["s"]] = r["n"]  # at most SLOTS rows
    tokens = sets.mapInArrow(_rarest(spark.sparkContext.broadcast(counts), percent), "node binary, n long, token long, lookup boolean")
    tokens = materialize(tokens.join(members, "node"))
    sketched = tokens.join(nodes.select("node", "sketch", "whole"), "node")
    side = lambda x: sketched.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "lookup", "component", "few", "sketch", "whole")])
    fits = (F.col("lookup_a") & (F.col("n_a") <= F.col("n_b")) & (100 * F.col("n_a") >= percent * F.col("n_b"))) | (F.col("lookup_b") & (F.col("n_b") <= F.col("n_a")) & (100 * F.col("n_b") >= percent * F.col("n_a")))
    # sketches decide within the join, so that a family of which many share a token leaves few rows
    found = side("a").where("few_a").join(side("b"), "token").where(fits & (F.col("component_a") != F.col("component_b")) & _promising(percent))
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _analyse(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, t, n_shingles, key) for all rows, (node, doc) and (node, component) for the texts: t hashes a text, a node is a set's key."""
    docs = docs.select("doc_id", "text")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    rows = materialize(rows.mapInArrow(_sketched(n), "doc_id long, t long, n_shingles long, key binary, buckets array<long>, sketch array<long>, whole array<long>"))
    full = rows.where("key is not null and doc_id is not null")
    nodes = materialize(full.groupBy(F.col("key").alias("node")).agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("n_shingles", "buckets", "sketch", "whole")]))
    left, right = _sides(nodes)

    entries = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(entries.join(sizes, "bucket"))
    # a node whose buckets are large in most bands is near the middle of its family
    typical = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = shared.select("bucket", "node").join(typical, "node")
    leads = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("x")).select("bucket", F.col("x.node").alias("lead"))
    star = shared.join(leads, "bucket").where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    star = materialize(star.join(left, "a").join(right, "b").where(_promising(percent)).select("a", "b"))
    links = materialize(_verified(star, nodes, docs, n, percent))
    found = components(links)

    # what is left: members of a bucket outside the component that most of its members are in, against all others
    placed = shared.select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("x"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1").select("bucket", F.col("x.component").alias("main"), (F.col("n") > HOT).alias("hot"))
    open_ = materialize(placed.join(main, "bucket").withColumn("few", F.col("component") != F.col("main")))
    small = open_.where("not hot")
    few = small.where("few").select("bucket", F.col("node").alias("a"), F.col("component").alias("ca"))
    rest = small.select("bucket", F.col("node").alias("b"), F.col("component").alias("cb"), "few")
    near = few.join(rest, "bucket").where((F.col("ca") != F.col("cb")) & (~F.col("few") | (F.col("a") < F.col("b")))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hot = materialize(open_.where("hot").groupBy("node", "component").agg(F.max("few").alias("few")))
    if not hot.isEmpty():
        near = near.union(_by_rare_shingles(hot, nodes, docs, n, percent))
    near = near.distinct().join(left, "a").join(right, "b").where(_promising(percent)).select("a", "b")
    more = materialize(_verified(materialize(near.join(star, ["a", "b"], "left_anti")), nodes, docs, n, percent))
    if not more.isEmpty():
        found = components(links.union(more))
    return rows.select("doc_id", "t", "n_shingles", "key"), nodes.select("node", "doc"), found


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Documents are linked if their sets of ``n``-word shingles have at least ``percent``
    similarity; ``component_id`` is the smallest doc_id that links lead to, and the document
    of that id is kept. Documents without words, and rows without a doc_id (kept, null
    component), are linked with nothing. Rows of the same doc_id are one document: its
    different texts are linked with each other.
    """
    rows, nodes, found = _analyse(docs, n, percent)
    placed = nodes.join(found, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    ids = rows.where("key is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("key")).alias("lo"), F.max(F.xxhash64("key")).alias("hi")).where("lo <> hi")
    ids = materialize(rows.select("doc_id", F.col("key").alias("node")).join(ids, "doc_id", "left_semi").join(placed, "node").select("doc_id", "component").distinct())
    if not ids.isEmpty():
        firsts = ids.groupBy("doc_id").agg(F.min("component").alias("b"))
        joined = components(ids.join(firsts, "doc_id").select(F.col("component").alias("a"), "b").where("a <> b"))
        placed = placed.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_m")), "component", "left").select("node", "doc", F.coalesce("_m", "component").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("doc").alias("_c"))
    names = placed.join(smallest, "component").select(F.col("node").alias("key"), "_c")
    out = rows.select("doc_id", "n_shingles", "key").join(names, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``.

    It is the one of the smallest doc_id. Here the texts of one doc_id stand for themselves,
    so that none goes unless one like it stays; equal rows stay together.
    """
    rows, nodes, found = _analyse(docs, n, percent)
    placed = nodes.join(found, "node")
    best = placed.groupBy("component").agg(F.min(F.struct("doc", "node")).alias("x")).select("component", F.col("x.doc").alias("_doc"), F.col("x.node").alias("_node"))
    # within a component only the best text of the best document stays, in a set without links only its first document
    chosen = nodes.join(placed.join(best, "component").select("node", "_doc", "_node"), "node", "left").select(F.col("node").alias("key"), F.coalesce("_doc", "doc").alias("_doc"), F.coalesce("_node", "node").alias("_node"))
    gone = rows.where("key is not null and doc_id is not null").join(chosen, "key").where("doc_id <> _doc or key <> _node").select("doc_id", "t").distinct()
    return docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["t"]), "left_anti")


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4)


#: All pairs of documents that share a shingle, and all that each can reach.
OP9_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, w, unnest(range(greatest(len(w) - 3, least(len(w), 1)))) p from w),
s as (select distinct doc_id, array_to_string(w[p + 1 : p + 4], ' ') s from g),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r(node, reach) as (select doc_id, doc_id from documents union select r.node, e.b from r join e on e.a = r.reach)
select node doc_id, coalesce(n, 0)::bigint n_shingles, min(reach) component_id, node = min(reach) kept from r left join n on doc_id = node group by node, n
"""
