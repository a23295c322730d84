import re

from palimpsest.llm import decontamination

WORDS = re.compile(decontamination.WORDS)


def shingles(words, n=5):
    return {tuple(words[k : k + n]): sum(map(len, words[k : k + n])) for k in range(max(1, len(words) - n + 1))} if words else {}


def brute(docs, items, least=0.8):
    """Every window of every document of an item's size, aligned or not, against the item."""
    out = {}
    for d, text in docs:
        w = WORDS.findall((text or "").lower())
        for i, item in items:
            x = WORDS.findall((item or "").lower())
            if not x or not w:
                continue
            b = shingles(x)
            for k in range(max(1, len(w) - len(x) + 1)):
                a = shingles(w[k : k + len(x)])
                both = sum(v for s, v in a.items() if s in b)
                score = both / (sum(a.values()) + sum(b.values()) - both)
                if score >= least:
                    out[d, i] = max(score, out.get((d, i), 0))
    return out


def test_against_brute_force(spark, docs_of, prose):
    items = [(i, prose(900 + i, 18 + 4 * i)) for i in range(10)] + [(20, "too short"), (21, None), (22, "")]
    docs = []
    for i, item in items[:10]:
        docs.append((i, prose(i, 100) + " " + item + " " + prose(50 + i, 100)))
        docs.append((100 + i, prose(60 + i, 30) + "\n" + item.upper().replace(" ", ", ") + prose(70 + i, 30)))
        words = item.split()
        words[len(words) // 2] = "changed"
        docs.append((200 + i, prose(80 + i, 30) + " " + " ".join(words)))
        docs.append((300 + i, prose(90 + i, 30) + " " + " ".join(words[: len(words) // 2])))
        docs.append((400 + i, item))
    docs += [(500, "Too, short!"), (501, prose(3, 300)), (502, None), (503, "")]
    found = {(r.doc_id, r.item_id): r.similarity for r in decontamination.matches(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert found.keys() == want.keys() and len(want) > 30
    assert all(abs(found[k] - want[k]) < 1e-12 for k in want)


def aligned_best(text, item):
    """The best of the windows at which a shingle of the text is in its place in the item."""
    w, x = WORDS.findall(text.lower()), WORDS.findall(item.lower())
    b, best = shingles(x), 0
    for p in range(len(w) - 4):
        for q in range(len(x) - 4):
            if w[p : p + 5] == x[q : q + 5]:
                a = shingles(w[max(p - q, 0) : p - q + len(x)])
                both = sum(v for s, v in a.items() if s in b)
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
    return best


def test_insertions_and_deletions(spark, docs_of, prose):
    """Windows between two alignments can pass where the aligned ones don't."""
    items = [(i, prose(700 + i, 46 + i)) for i in range(6)]
    docs = []
    for i, item in items:
        words = item.split()
        for k in range(2, 7):
            for at in (5, len(words) - 6):
                more = prose(1000 + 10 * i + k, k, "klmnop").split()
                docs.append((10_000 + 1000 * i + 100 * k + at, " ".join([prose(i, 20), *words[:at], *more, *words[at:], prose(50 + i, 20)])))
                docs.append((50_000 + 1000 * i + 100 * k + at, " ".join([prose(i, 20), *words[:at], *words[at + k :], prose(50 + i, 20)])))
    found = {(r.doc_id, r.item_id): r.similarity for r in decontamination.matches(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    texts, known = dict(docs), dict(items)
    assert any(aligned_best(texts[d], known[i]) < 0.8 for d, i in want)
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_blocks_guarantee_the_radius(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = []
    for n in [*range(decontamination.RADIUS + 1)] * 6:
        x = [rng.randrange(1 << 63) for _ in range(2)]
        y = list(x)
        for bit in rng.sample(range(126), n):
            y[bit // 63] ^= 1 << bit % 63
        rows.append((*x, *y, n))
    df = spark.createDataFrame(rows, "a long, b long, c long, d long, n int")
    one, two = (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))
    assert df.where(decontamination.distance(one, two) != F.col("n")).count() == 0
    meet = F.arrays_overlap(decontamination.blocks(one), decontamination.blocks(two, decontamination.NEAR))
    assert df.where(~meet).count() == 0
    far = spark.range(300).select(F.xxhash64("id", F.lit(1)).alias("a"), F.xxhash64("id", F.lit(2)).alias("b"), F.xxhash64("id", F.lit(3)).alias("c"), F.xxhash64("id", F.lit(4)).alias("d"))
    assert far.where(meet).count() < 60  # the index selects: one in nine of unrelated ones


def test_fingerprints_against_brute_force(spark, prose):
    """The SimHash of running sums is that of each window by itself, and pieces don't change the result."""
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(1, prose(1, 30)), (2, prose(2, 41))], "item_id long, text string")
    cat = decontamination.catalogue(items)
    x = F.explode("shingles").alias("x")
    rows = {r["item_id"]: r for r in decontamination.marked(cat, 400).collect()}
    for i in (1, 2):
        each = cat.where(F.col("item_id") == i).select(x).select("x.h", F.xxhash64("x.h").alias("g"), "x.w").collect()
        for half, name in (("h", "f1"), ("g", "f2")):
            want = sum(1 << b for b in range(63) if 2 * sum(r["w"] for r in each if r[half] >> b & 1) > sum(r["w"] for r in each))
            assert rows[i][name] == want


def test_cut_texts_and_pieces(spark, docs_of, prose, monkeypatch):
    items = [(i, prose(700 + i, 46 + i)) for i in range(4)]
    docs = []
    for i, item in items:
        w = item.split()
        docs += [(10 * i, " ".join(w[5:]) + prose(i, 60)), (10 * i + 1, prose(i, 60) + " " + " ".join(w[:-5])), (10 * i + 2, " ".join(w[3:-3])), (10 * i + 3, " ".join([item] * 9))]
    known = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontamination.matches(docs_of(docs), known).collect()))
    assert len(whole) == 16
    monkeypatch.setattr(decontamination, "PIECE", 7)
    assert sorted(map(tuple, decontamination.matches(docs_of(docs), known).collect())) == whole


def test_odd_rows(spark, docs_of, odd):
    items = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (2, None), (None, "x y z")], "item_id long, text string")
    found = decontamination.matches(odd.withColumnRenamed("n_chars", "similarity"), items).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(6, 1)]
    assert decontamination.decontaminate(odd, items).count() == 8
    assert decontamination.matches(docs_of([]), items).count() == 0
    assert decontamination.matches(odd, items.where("false")).count() == 0
