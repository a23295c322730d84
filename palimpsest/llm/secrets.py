"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model has the character transitions of random strings (keys and tokens that the fixed
patterns found in a bounded sample of documents, and digests), the other those of ordinary
identifiers (all other alphanumeric runs of that sample). A long run whose transitions are
likelier under the first is a secret too. DataFrame functions only; positions come from
splitting a text at its matches, so they count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fresh, let, materialize

#: Kind, pattern, group whose length counts, least length of it.
KINDS = [
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: What a text must match to have a span of a kind at all: spares most texts the splitting.
GATES = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Runs of at least so many characters are candidates of the Markov models.
LEAST = 16
RUN, LONG_RUN = r"[A-Za-z0-9+/_=-]+", rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least mean log-likelihood ratio of a transition.
THRESHOLD = 0.5
_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
#: Beyond any place in a text.
_FAR = 1 << 60


def running(values: Column, join=lambda a, x: a + x, start: int = 0, block: int = 256) -> Column:
    """Running sums (or ``join``, from ``start``) of an array. Blocks keep the copying below the square of its length."""
    zero = F.lit(start).cast("bigint")

    def plain(v: Column) -> Column:
        return F.aggregate(v, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(join(F.coalesce(F.get(a, F.size(a) - 1), zero), x))))

    def blocked(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(block)), lambda b: F.slice(v, b, block))

        def shifted(p: Column) -> Column:
            sums = plain(F.transform(p, lambda x: F.aggregate(x, zero, join)))
            return let(sums, lambda s: F.flatten(F.transform(p, lambda x, i: F.transform(plain(x), lambda y: join(F.coalesce(F.get(s, i - 1), zero), y)))))

        return let(parts, shifted)

    return F.when(F.size(values) == 0, values).otherwise(blocked(values))


def places(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern``: array of (s, m), where they start and what they are."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))

    def placed(found: Column) -> Column:
        # end of match i: the gaps and matches up to it
        ends = running(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.length(m) + g))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("s"), m.alias("m")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def spans(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` with at least ``least`` characters in ``group``, as ``_SPAN``."""
    judged = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m) >= least)
    both = F.zip_with(places(text, pattern), judged, lambda x, j: F.struct(x["s"].alias("s"), x["m"].alias("m"), j.alias("j")))
    good = F.filter(both, lambda x: x["j"])
    return F.transform(good, lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["m"])).alias("end"))).cast(_SPAN)


def apart(runs: Column, known: Column) -> Column:
    """The ``runs`` (array of (s, m)) that overlap none of the spans ``known``, in one pass over both in order."""
    one = F.transform(known, lambda b: F.struct(b["start"].alias("s"), F.lit(0).alias("k"), b["end"].alias("e"), F.lit("").alias("m")))
    two = F.transform(runs, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("k"), (x["s"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))

    def swept(v: Column) -> Column:
        reach = running(F.transform(v, lambda x: F.when(x["k"] == 0, x["e"]).otherwise(F.lit(0).cast("bigint"))), lambda a, x: F.greatest(a, x))
        ahead = F.reverse(running(F.reverse(F.transform(v, lambda x: F.when(x["k"] == 0, x["s"]).otherwise(F.lit(_FAR).cast("bigint")))), lambda a, x: F.least(a, x), _FAR))
        free = F.zip_with(F.zip_with(reach, ahead, lambda r, a: F.struct(r.alias("r"), a.alias("a"))), v, lambda x, y: F.struct(((y["k"] == 1) & (x["r"] <= y["s"]) & (x["a"] >= y["e"])).alias("free"), y.alias("y")))
        return F.transform(F.filter(free, lambda x: x["free"]), lambda x: F.struct(x["y"]["s"].alias("s"), x["y"]["m"].alias("m")))

    return F.when(F.size(known) == 0, runs).otherwise(let(F.array_sort(F.concat(one, two)), swept))


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(_SPAN)
    return {kind: F.when(text.rlike(GATES[kind]), spans(text, pattern, group, least, kind, rank)).otherwise(none) for rank, (kind, pattern, group, least) in enumerate(KINDS)}


def characters(token: Column) -> Column:
    """A token's characters, in one pass over it."""
    return F.filter(F.split(token, "", -1), lambda c: c != "")


def transitions(tokens: DataFrame, column: str) -> DataFrame:
    """Counts of adjacent characters of the alphabet in a column of tokens."""
    pairs = let(characters(F.col(column)), lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b)))
    return tokens.where(F.length(column) > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def train(docs: DataFrame, text: str = "text", max_docs: int = 10_000) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of the transitions, row by row of ``ALPHABET`` (and one place for other characters).

    The labelled sample is of at most ``max_docs`` documents, the first by a hash of the
    text. Their base spans, and digests of their texts, are random; the alphanumeric runs of
    those without base spans are ordinary.
    """
    t = F.col(text)
    rows = docs.select(text).where(t.isNotNull() & (t != ""))
    hit = t.rlike("|".join(f"(?:{g})" for g in GATES.values()))
    sample = materialize(bounded_sample(rows, max_docs, t).withColumn("_hit", hit))
    long_enough = lambda found, n: F.filter(found, lambda m: F.length(m) >= n)
    value = F.concat(*[long_enough(F.regexp_extract_all(t, F.lit(p), F.lit(g)), n) for _, p, g, n in KINDS])
    value = F.array_union(value, F.array(F.base64(F.unhex(F.sha2(t, 256))), F.sha2(t, 256)))
    random = transitions(sample.select(F.explode(value).alias("_t")), "_t").withColumn("random", F.lit(True))
    ordinary = transitions(sample.where(~F.col("_hit")).select(F.explode(F.regexp_extract_all(t, F.lit(RUN), F.lit(0))).alias("_t")), "_t").withColumn("random", F.lit(False))
    size = len(ALPHABET) + 1
    counts = {k: [[0] * size for _ in range(size)] for k in (True, False)}
    for r in random.union(ordinary).collect():  # at most one row for each pair of alphabet characters and model
        a, b = (ALPHABET.find(c) + 1 for c in r["pair"])
        counts[r["random"]][a][b] += r["n"]
    chances = {k: _smoothed(v) for k, v in counts.items()}
    return [round(math.log(x / y), 3) for r, o in zip(chances[True], chances[False], strict=True) for x, y in zip(r, o, strict=True)]


def _smoothed(counts: list[list[int]], weight: float = 5.0) -> list[list[float]]:
    """Transition probabilities; each character's are drawn to the overall ones with the weight of so many transitions."""
    n = len(counts)
    totals = [sum(row[b] for row in counts) + 0.5 for b in range(n)]
    overall = [x / sum(totals) for x in totals]
    return [[(row[b] + weight * overall[b]) / (sum(row) + weight) for b in range(n)] for row in counts]


def likelihood_ratio(token: Column, table: Column, index: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    size = len(ALPHABET) + 1
    codes = F.transform(characters(token), lambda c: F.get(index, F.ascii(c)))

    def mean(c: Column) -> Column:
        steps = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.get(table, a * size + b))
        return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (F.size(c) - 1)

    return let(codes, mean)


def scan(docs: DataFrame, table: list[float], text: str = "text") -> DataFrame:
    """``docs`` with ``assign``, ``access``, ``hex`` and ``markov``: arrays of spans (columns of these names are replaced).

    ``markov`` has the runs of at least ``LEAST`` characters whose mean ratio is at least
    ``THRESHOLD`` and that overlap no span of the fixed patterns. A null text is empty.
    """
    names = [k for k, *_ in KINDS]
    [own] = fresh(docs, "_t")
    t = F.col(own)
    out = docs.withColumn(own, F.coalesce(F.col(text), F.lit(""))).drop("markov").withColumns(base_spans(t))
    scores = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    index = F.split(F.lit(",".join(str(ALPHABET.find(chr(i)) + 1) for i in range(128))), ",").cast("array<int>")

    def added() -> Column:
        known = F.concat(*[F.col(k) for k in names])
        runs = let(known, lambda k: apart(places(t, LONG_RUN), k))
        likely = F.filter(runs, lambda x: likelihood_ratio(x["m"], scores, index) >= THRESHOLD)
        return F.transform(likely, lambda x: F.struct(x["s"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("markov").alias("kind"), (x["s"] + F.length(x["m"])).alias("end"))).cast(_SPAN)

    return out.withColumn("markov", F.when(t.rlike(LONG_RUN), added()).otherwise(F.array().cast(_SPAN))).drop(own)


def listed(found: Column) -> Column:
    """Spans as kind:start:end, by start and then kind as listed."""
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(docs))
    base = F.concat("assign", "access", "hex")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.concat(base, "markov")).alias("spans"))
