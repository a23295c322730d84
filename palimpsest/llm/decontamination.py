"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming search, exact verification.

Documents and benchmark items become arrays of words; a shingle is five words with its
letters as weight. For each length that an item has, every window of so many words gets a
126-bit SimHash of its weighted shingles, from running sums, unless too little of its
weight is in shingles of the benchmark (of whatever item) for the similarity to be reached.
Fingerprints are cut into ten blocks. Two that differ in at most ``RADIUS`` bits differ in
at most ``NEAR`` bits of some block, so the index has each item under all values that near
to its blocks, and a window looks up its ten. Only this tells which items a window is held
against; pairs that it finds are verified by weighted Jaccard similarity of their shingle
sets. DataFrame functions only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of the ten blocks, half of them for each half of a fingerprint.
BLOCKS = (13, 13, 13, 12, 12)
#: Bits in which a block may differ from that of the item it finds, and the distance within which that finds every pair.
NEAR = 2
RADIUS = 2 * len(BLOCKS) * (NEAR + 1) - 1
#: Pairs further apart are dropped: at a similarity of 0.8 about 19.1 of 126 bits differ, with a standard deviation of 4.
FAR = 40
#: ASCII letters and digits, and all other characters beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many benchmark shingles are sent to every executor (about 40 bytes each); beyond that the join shuffles.
BROADCAST_SHINGLES = 500_000
#: Up to so many documents with candidate windows are named to every executor; beyond that the join shuffles.
BROADCAST_DOCS = 2_000_000
#: Up to so many entries of the index (about 50 bytes each, 1,000 an item) are sent to every executor; beyond that the join shuffles.
BROADCAST_ENTRIES = 300_000
#: Starts of windows that are worked on as one row.
PIECE = 2048


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """A hash for each ``n`` adjacent words; of all words together if there are fewer, and none without words."""
    def hashed(h: Column) -> Column:
        count = F.greatest(F.size(h) - n + 1, F.lit(1))
        every = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.when(F.size(h) > 0, every).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def shingles_of(words: Column, n: int = SHINGLE) -> Column:
    """The shingles in their order with their weights, the characters of their words: array of (h, w)."""
    def both(w: Column) -> Column:
        sizes = F.transform(w, lambda x: F.length(x))
        weigh = lambda s: lambda i: F.aggregate(F.slice(s, i + 1, n), F.lit(0), lambda a, x: a + x)
        weights = let(sizes, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - n, F.lit(0))), weigh(s)))
        return F.zip_with(shingle_hashes(w, n), weights, lambda h, x: F.struct(h.alias("h"), x.alias("w")))

    return let(words, both)


# A SimHash weighs, for each of its 126 bits, the shingles whose hash has that bit against
# the others. Twice the weight of the former is summed, three bits to a long, FIELD bits
# each: "q0" to "q41" are these longs and "qw" is the weight of all shingles. Sums over a
# window are differences of running sums. FIELD - 1 bits hold a sum; the highest bit of a
# field turns up where the sum exceeds "qw", for all three by one addition.
HALF, FIELD = 63, 21
_SUMS = [f"q{k}" for k in range(2 * HALF // 3)]
_ONES = 1 + (1 << FIELD) + (1 << 2 * FIELD)
_TOPS = _ONES << FIELD - 1


def packed(h: Column, w: Column, heaviest: int) -> dict[str, Column]:
    """What one shingle adds to ``_SUMS`` and to "qw"; no shingle weighs more than ``heaviest`` here."""
    w = F.least(w, F.lit(heaviest)).cast("long")
    hashes = (h, F.xxhash64(h))
    found = {}
    for k, name in enumerate(_SUMS):
        each = [F.when(F.getbit(hashes[k // FIELD], F.lit(k % FIELD + FIELD * f)) == 1, F.shiftleft(w, 1 + FIELD * f)).otherwise(F.lit(0).cast("long")) for f in range(3)]
        found[name] = each[0] + each[1] + each[2]
    return found | {"qw": w}


def fingerprint(summed) -> tuple[Column, Column]:
    """Two longs of 63 bits: each is set if the shingles whose hash has it outweigh the others; ``summed(name)`` is the sum of that name."""
    halves = []
    for half in range(2):
        out = None
        for k in range(FIELD):
            # the tops of the three fields become the bits k, k + FIELD and k + 2 * FIELD
            over = (summed(_SUMS[half * FIELD + k]) + summed("qt")).bitwiseAND(F.lit(_TOPS))
            bits = F.shiftright(over, FIELD - 1 - k)
            out = bits if out is None else out.bitwiseOR(bits)
        halves.append(out)
    return halves[0], halves[1]


def threshold(weight: Column) -> Column:
    """What, added to a long of sums, carries into the top of each field whose sum exceeds ``weight``: "qt"."""
    return (F.lit((1 << FIELD - 1) - 1).cast("long") - weight) * F.lit(_ONES)


def blocks(fp: tuple[Column, Column], near: int = 0) -> Column:
    """A fingerprint's blocks, and all values that differ from them in at most ``near`` bits: array of (k, v)."""
    def around(k: int, value: Column, size: int) -> Column:
        flips = F.array(*[F.lit(sum(1 << i for i in x)) for n in range(near + 1) for x in combinations(range(size), n)])
        return let(value.cast("int"), lambda v: F.transform(flips, lambda x: F.struct(F.lit(k).alias("k"), v.bitwiseXOR(x).alias("v"))))

    found = []
    for half, long in enumerate(fp):
        for k, size in enumerate(BLOCKS):
            value = F.shiftrightunsigned(long, sum(BLOCKS[:k])).bitwiseAND(F.lit((1 << size) - 1))
            found.append(around(k + half * len(BLOCKS), value, size))
    return F.concat(*found)


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle sets."""
    weight = lambda s: F.aggregate(s, F.lit(0), lambda t, x: t + x["w"])
    return let(weight(F.array_intersect(a, b)), lambda both: both / (weight(a) + weight(b) - both))


def catalogue(benchmark: DataFrame) -> DataFrame:
    """The items with words: item_id, len, room (shingles in a window of that many words), shingles, item_set and total (the weight of the set)."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    items = words.select("item_id", F.size("_w").alias("len"), F.greatest(F.size("_w") - SHINGLE + 1, F.lit(1)).alias("room"), shingles_of(F.col("_w")).alias("shingles")).distinct()
    items = items.withColumn("item_set", F.array_sort(F.array_distinct("shingles")))
    return items.withColumn("total", F.aggregate("item_set", F.lit(0).cast("long"), lambda t, x: t + x["w"]))


def marked(items: DataFrame, heaviest: int) -> DataFrame:
    """item_id, len, item_set and the fingerprint f1, f2 of each item."""
    parts = items.select("item_id", "len", "item_set", F.xxhash64("shingles").alias("id"), F.explode("shingles").alias("x"))
    parts = parts.select("item_id", "len", "item_set", "id", *[c.alias(n) for n, c in packed(F.col("x.h"), F.col("x.w"), heaviest).items()])
    sums = parts.groupBy("item_id", "len", "item_set", "id").agg(*[F.sum(n).alias(n) for n in (*_SUMS, "qw")]).withColumn("qt", threshold(F.col("qw")))
    f1, f2 = fingerprint(F.col)
    return sums.select("item_id", "len", "item_set", f1.alias("f1"), f2.alias("f2"))


def index(items: DataFrame) -> DataFrame:
    """len, k, v and the fingerprints f1, f2 of ``marked`` items: every value within ``NEAR`` bits of each block."""
    found = items.select("len", "f1", "f2").distinct()
    return found.select("len", "f1", "f2", F.explode(blocks((F.col("f1"), F.col("f2")), NEAR)).alias("y")).select("len", "f1", "f2", "y.*")


def stretches(docs: DataFrame, known: DataFrame, reach: int, lightest: float, text: str) -> DataFrame:
    """Where windows with enough benchmark shingles can start: _r (hash of the document's row), from and to (a word, below 0 before the text).

    ``known`` has the benchmark's shingles (h, w), ``reach`` the most shingles of a window.
    Shingles found further apart than that share no window, and a stretch whose finds weigh
    less than ``lightest`` has none worth a look.
    """
    shared = F.broadcast(known) if known.count() <= BROADCAST_SHINGLES else known
    hits = docs.select(F.xxhash64("doc_id", text).alias("_r"), words_of(F.col(text)).alias("_w")).select("_r", F.posexplode(shingle_hashes(F.col("_w"))).alias("pos", "h"))
    hits = hits.join(shared, "h").select("_r", "pos", "w").distinct()
    order = Window.partitionBy("_r").orderBy("pos")
    runs = hits.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(order) >= reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order)).groupBy("_r", "run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sum("w").alias("w"))
    return runs.where(F.col("w") >= lightest).select("_r", (F.col("lo") - reach + 1).alias("from"), F.col("hi").alias("to"))


def pieces(docs: DataFrame, found: DataFrame, reach: int, text: str) -> DataFrame:
    """The shingles that the windows of each stretch see, at most ``PIECE`` starts a row: doc_id, _r, from, to, at (the first shingle's place), x (array of (h, w)), size (shingles of the text)."""
    named = found.select("_r").distinct()
    if named.count() <= BROADCAST_DOCS:
        named = F.broadcast(named)
    held = docs.select("doc_id", F.col(text).alias("_t"), F.xxhash64("doc_id", text).alias("_r")).join(named, "_r", "left_semi").dropDuplicates(["_r"])
    rows = held.select("doc_id", "_r", shingles_of(words_of(F.col("_t"))).alias("_x")).join(found, "_r")
    rows = rows.select("doc_id", "_r", "_x", "to", F.explode(F.sequence("from", "to", F.lit(PIECE))).alias("from"))
    rows = rows.withColumns({"to": F.least("to", F.col("from") + PIECE - 1), "at": F.greatest("from", F.lit(0)), "size": F.size("_x")})
    return rows.select("doc_id", "_r", "from", "to", "at", F.slice("_x", F.col("at") + 1, F.col("to") - F.col("at") + reach).alias("x"), "size")


def windows(cut: DataFrame, known: DataFrame, lengths: list[tuple[int, int, int]], least: float, heaviest: int) -> DataFrame:
    """The windows of ``pieces`` that may reach ``least``: _r, from, len, a, b (first and last shingle) and the fingerprint f1, f2.

    ``lengths`` has for each length of an item its shingles and the least weight of an item.
    Of a window's distinct shingles at least the share ``least`` of the weight has to be the
    benchmark's; here the benchmark's count as often as they occur and others only where
    the piece has them first, so no such window is left out.
    """
    shared = F.broadcast(known) if known.count() <= BROADCAST_SHINGLES else known
    rows = cut.select("_r", "from", F.posexplode("x").alias("i", "x")).select("_r", "from", "i", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    rows = rows.join(shared.select("h", F.lit(True).alias("hit")), "h", "left").repartition("_r", "from")
    first = F.row_number().over(Window.partitionBy("_r", "from", "h").orderBy("i")) == 1
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"qb": F.when(F.col("hit"), F.col("w").cast("long")).otherwise(zero), "qn": F.when(first & F.col("hit").isNull(), F.col("w").cast("long")).otherwise(zero)})
    rows = rows.withColumns(packed(F.col("h"), F.col("w"), heaviest))
    names = [*_SUMS, "qw", "qb", "qn"]
    run = Window.partitionBy("_r", "from").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("_r", "from", "i", *[F.sum(n).over(run).alias(n) for n in names])
    lists = sums.groupBy("_r", "from").agg(F.array_sort(F.collect_list(F.struct("i", *names))).alias("c"))
    none = F.struct(F.lit(-1).alias("i"), *[zero.alias(n) for n in names])
    lists = lists.select("_r", F.col("from").alias("p"), F.concat(F.array(none), F.col("c")).alias("c"))
    lists = lists.withColumns({"cb": F.transform("c", lambda x: x["qb"]), "cn": F.transform("c", lambda x: x["qn"])}).join(cut.select("_r", F.col("from").alias("p"), "to", "at", "size"), ["_r", "p"])
    kinds = F.array(*[F.struct(F.lit(n).alias("len"), F.lit(room).alias("room"), F.lit(float(w)).alias("w")) for n, room, w in lengths])

    def ends(kind: Column, s: Column) -> tuple[Column, Column]:
        """Places in the running sums before a window's first and after its last shingle."""
        return F.greatest(s, F.lit(0)) - F.col("at"), F.least(s + kind["room"], F.col("size")) - F.col("at")

    def taken(kind: Column) -> Column:
        """The starts of windows of one length that may reach ``least``."""
        def enough(s: Column) -> Column:
            a, b = ends(kind, s)
            both, other = F.get("cb", b) - F.get("cb", a), F.get("cn", b) - F.get("cn", a)
            # a window that both ends of the text cut is the one that starts with the text
            return (both >= kind["w"] * least - 1e-6) & ((1 - least) * both >= least * other - 1e-6) & ((s >= 0) | (s + kind["room"] < F.col("size")))

        lo = F.greatest(F.col("p"), 1 - kind["room"])
        return F.filter(F.sequence(lo, F.greatest(F.least(F.col("to"), F.col("size") - 1), lo)), enough)

    def fingerprinted(kind: Column) -> Column:
        def mark(s: Column) -> Column:
            a, b = ends(kind, s)
            sums = F.struct(F.get("c", a).alias("d"), F.get("c", b).alias("e"))

            def both(x: Column) -> Column:
                weight = threshold(x["e"]["qw"] - x["d"]["qw"])
                return let(F.struct(x["d"].alias("d"), x["e"].alias("e"), weight.alias("t")), halves)

            def halves(x: Column) -> Column:
                f1, f2 = fingerprint(lambda n: x["t"] if n == "qt" else x["e"][n] - x["d"][n])
                return F.struct(kind["len"].alias("len"), (a + F.col("at")).alias("a"), (b + F.col("at") - 1).alias("b"), f1.alias("f1"), f2.alias("f2"))

            return let(sums, both)

        return F.transform(taken(kind), mark)

    return lists.select("_r", F.col("p").alias("from"), F.explode(F.flatten(F.transform(kinds, fingerprinted))).alias("w")).select("_r", "from", "w.*")


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, text: str = "text") -> DataFrame:
    """For each document and benchmark item that it repeats: doc_id, item_id, similarity, start (word of the best window, from 0) and n_windows.

    ``similarity`` is the best of all windows of the item's number of words, wherever they
    start; at a text's ends windows of fewer words count too. ``n_windows`` says how many
    reach ``least``. Items and documents without words match nothing. Items of fewer than
    five words are one shingle and match documents that consist of just these words.
    Repeated item ids give one row; so do rows of one doc_id, whose windows count together.
    """
    items = materialize(catalogue(benchmark))
    lengths = [(r["len"], r["room"], r["w"]) for r in items.groupBy("len", "room").agg(F.min("total").alias("w")).orderBy("len").collect()]  # one row for each length
    if not lengths:
        return docs.select("doc_id").where("false").join(benchmark.select("item_id"), F.lit(False)).select("doc_id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).cast("long").alias("n_windows"))
    reach = max(room for _, room, _ in lengths)
    heaviest = ((1 << FIELD - 2) - 1) // (PIECE + 2 * reach)  # no sum outgrows its field
    known = materialize(items.select(F.explode("item_set").alias("x")).select("x.*").dropDuplicates(["h"]))
    found = materialize(stretches(docs, known, reach, least * min(w for *_, w in lengths), text))
    cut = materialize(pieces(docs, found, reach, text))
    ours = windows(cut, known, lengths, least, heaviest)
    named = materialize(marked(items, heaviest))
    theirs = materialize(index(named))
    entries = F.broadcast(theirs) if theirs.count() <= BROADCAST_ENTRIES else theirs
    looked = ours.withColumnsRenamed({"f1": "g1", "f2": "g2"}).withColumn("y", F.explode(blocks((F.col("g1"), F.col("g2"))))).select("_r", "from", "len", "a", "b", "g1", "g2", "y.*")
    near = looked.join(entries, ["len", "k", "v"]).where(distance((F.col("g1"), F.col("g2")), (F.col("f1"), F.col("f2"))) <= FAR)
    near = materialize(near.select("_r", "from", "len", "a", "b", "f1", "f2").distinct())
    pairs = near.join(named, ["len", "f1", "f2"]).join(cut.select("doc_id", "_r", "from", "at", "x"), ["_r", "from"])
    pairs = pairs.withColumn("_s", F.array_distinct(F.slice("x", F.col("a") - F.col("at") + 1, F.col("b") - F.col("a") + 1)))
    pairs = pairs.select("doc_id", "item_id", "_r", "a", "b", similarity(F.col("_s"), F.col("item_set")).alias("similarity")).where(F.col("similarity") >= least).distinct()
    return pairs.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max_by("a", F.struct("similarity", -F.col("a"))).alias("start"), F.count("*").alias("n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that repeat a benchmark item; those without a doc_id stay."""
    return docs.join(matches(docs, benchmark, least).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every window of every document that shares a shingle with an item of its length, against that item.
OP10_SQL = rf"""
with w as (select row_number() over () r, doc_id, w from (select distinct doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') w from documents)),
iw as (select distinct item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') w from benchmark),
g as (select r, w, unnest(range(greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)))) p from w),
s as (select r, w, p, array_to_string(w[p + 1 : p + {SHINGLE}], ' ') s from g),
ig as (select item_id, w, unnest(range(greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)))) p from iw),
i as (select distinct item_id, len(w) n, array_to_string(w[p + 1 : p + {SHINGLE}], ' ') s from ig),
h as (select distinct r, w, item_id, n, p from s join i using (s)),
e as (select distinct r, w, item_id, n, unnest(range(p - greatest(n - {SHINGLE}, 0), p + 1)) b from h),
c as (select distinct r, item_id, greatest(b, 0) b, w[greatest(b, 0) + 1 : least(b + greatest(n, {SHINGLE}), len(w))] x from e),
cg as (select distinct r, item_id, b, len(x) l, unnest(list_transform(range(greatest(len(x) - {SHINGLE - 1}, 1)), lambda k: array_to_string(x[k + 1 : k + {SHINGLE}], ' '))) s from c),
wt as (select r, item_id, b, l, sum(length(replace(cg.s, ' ', ''))) t, sum(case when i.s is not null then length(replace(cg.s, ' ', '')) else 0 end) m from cg left join i using (item_id, s) group by all),
it as (select item_id, sum(length(replace(s, ' ', ''))) t from (select distinct item_id, s from i) group by item_id),
q as (select r, item_id, b, m / (wt.t + it.t - m)::double sim from wt join it using (item_id) where m / (wt.t + it.t - m)::double >= {SIMILARITY})
select doc_id, item_id, max(sim) similarity, arg_max(b, (sim, -b))::int "start", count(*) n_windows from q join w using (r) group by doc_id, item_id
"""
