import random

import numpy as np

from palimpsest.llm import near_duplicates


def sets(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent=80):
    s = {i: sets(t, n) for i, t in rows}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def family(prose, seed, n_words, n, edits):
    rng = random.Random(seed)
    words = prose(seed, n_words).split()
    out = []
    for _ in range(n):
        copy = list(words)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_against_brute_force(docs_of, prose):
    texts = [prose(i, 30 + i) for i in range(40)]
    for k in range(6):
        texts += family(prose, 100 + k, 60 + 40 * k, 12, 2 + k)
    texts += [texts[3]] * 5 + [texts[4].upper(), texts[5].replace(" ", "\n\t "), "one two", "One  TWO", "one two three", "", "   ", "é é é é é", "É é é é é"]
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    for n in (4, 5):
        found = {r.doc_id: r for r in near_duplicates.near_duplicates(docs_of(rows), n).collect()}
        for i, (size, component) in brute(rows, n).items():
            assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (size, component, component == i), texts[i][:80]


def test_a_chain_of_copies_is_one_component(docs_of, prose):
    words = prose(7, 200).split()
    chain = []
    for k in range(12):
        words = [*words]
        words[10 * k + 5] = f"other{k}"
        chain.append(" ".join(words))
    found = near_duplicates.near_duplicates(docs_of(list(enumerate(chain, 50))), 4).collect()
    assert {r.component_id for r in found} == {50} and sum(r.kept for r in found) == 1


def test_odd_rows(docs_of, odd):
    found = near_duplicates.near_duplicates(odd.withColumnRenamed("n_chars", "kept"), 4).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 10 and all(r.kept for r in found)
    assert (by[1].n_shingles, by[1].component_id, by[2].n_shingles, by[None].component_id) == (0, 1, 0, None)
    assert near_duplicates.near_duplicates(docs_of([])).count() == 0
    assert near_duplicates.deduplicate(odd).count() == 10


def test_same_id_with_other_text(docs_of, prose):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(1, a), (1, b), (2, a), (3, b + " x"), (4, prose(3, 80))]
    assert {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs_of(rows)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_a_document_of_two_texts_loses_none(docs_of, prose):
    a, b = prose(1, 80), prose(2, 80)
    docs = docs_of([(1, a), (2, a), (2, b), (3, a + " more")])
    assert [(r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs).orderBy("doc_id").collect()] == [(1, True), (1, False), (1, False), (1, False)]
    assert sorted((r.doc_id, r.text) for r in near_duplicates.deduplicate(docs).collect()) == sorted([(1, a), (2, b)])


def templates(prose, n, common, own):
    """Pages that have ``common`` words in common and ``own`` of their own."""
    head = prose(9, common).split()
    return [" ".join(head + [f"w{i}x{k}" for k in range(own)]) for i in range(n)]


def test_hot_buckets_against_brute_force(docs_of, prose, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT", 3)
    texts = []
    for own in (8, 9, 10, 12, 16):  # similarities around the limit
        texts += templates(prose, 14, 78, own)
    for k in range(4):
        texts += family(prose, 300 + k, 90, 14, 9)
    rows = list(enumerate(texts))
    found = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs_of(rows), 4).collect()}
    assert found == {i: component for i, (_, component) in brute(rows, 4).items()}


def test_large_templates_below_the_limit(docs_of, prose, monkeypatch):
    rows = list(enumerate(templates(prose, 6000, 75, 12)))  # similarity 0.75: 18 million pairs
    seen = []
    verified = near_duplicates._verified
    monkeypatch.setattr(near_duplicates, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    found = near_duplicates.near_duplicates(docs_of([*rows, (6000, rows[17][1] + " end")]), 4).collect()
    assert {r.doc_id for r in found if not r.kept} == {6000} and sum(seen) < 20_000


def test_rarest_shingles_meet():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 5, 64)
    for _ in range(300):
        pool = rng.integers(0, 1 << 62, 120).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 110), replace=False)) for _ in range(2))
        a, b = sorted((a, b), key=len)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 50 * (len(a) + len(b) - shared):
            x, lookups = near_duplicates.rarest(a, counts, 50)
            assert len(np.intersect1d(x[:lookups], near_duplicates.rarest(b, counts, 50)[0]))


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)], "a long, b long").where("a <> b")
    found = {r.node: r.component for r in near_duplicates.components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    sampler = near_duplicates.Sampler()
    n, k = 64 * near_duplicates.SKETCH_WORDS, near_duplicates.ROWS * near_duplicates.BANDS
    for shared in (0.95, 0.9, 0.8):
        errors = []
        for _ in range(30):
            size = 600
            both = int(2 * size * shared / (1 + shared))
            pool = rng.integers(0, 1 << 63, 2 * size - both, np.int64).view(np.uint64)
            a, b = (sampler.sketch(sampler.samples(np.unique(x))) for x in (pool[:size], pool[size - both :]))
            z = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
            errors.append(1 + n / (4 * k) * np.log(1 - 2 * z / n) - shared)
        assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < near_duplicates.SLACK


def test_long_texts_and_chunk_ends():
    text = "alpha beta " * 300_000
    assert len(near_duplicates.shingle_set(text, 4)) == 2
    assert len(near_duplicates._word_hashes(b"x" * (3 << 20))) in (1, 2)
