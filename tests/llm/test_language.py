import numpy as np

from palimpsest.llm import language

ALPHABETS = {"aa": "abcdefgh", "bb": "ghijklmno", "cc": "pqrstuéè"}


def corpus(prose, n=40):
    return [(100 * k + i, prose(1000 * k + i, 60, letters), lang, "s") for k, (lang, letters) in enumerate(ALPHABETS.items()) for i in range(n)]


def test_held_out_accuracy(spark, docs_of, prose):
    rows = corpus(prose)
    filters = language.learn(docs_of([r for r in rows if r[0] % 4]))
    found = language.identify(docs_of([r for r in rows if r[0] % 4 == 0]), filters).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_prediction_against_brute_force(docs_of, prose):
    """Bit-sliced counting gives what looking up each n-gram in each language's filter gives."""
    filters = language.learn(docs_of(corpus(prose, 8)))
    texts = [prose(5000 + i, 30, a) for i, a in enumerate([*ALPHABETS.values(), "xyz"])] + ["a", "Abc  12 dé!"]
    total, hits, _ = filters.count(texts)
    for i, text in enumerate(texts):
        shown = "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        want, n = np.zeros(len(filters.langs)), 0
        for size in language.SIZES:
            for k in range(len(shown) - size + 1):
                g = shown[k : k + size]
                if (g[0] != " " or g[1] != " ") if size == 2 else " " not in g[1:-1]:
                    n += 1
                    code = next(language.blocks([g]))
                    h = code.prefix_hash(np.array([ord(c) for c in g + " "], np.uint32))
                    key = code.hash_between(h, np.array([0]), np.array([size])) + np.uint64(size)
                    want += [int(filters.masks(0, key)[0]) >> l & 1 for l in range(len(want))]
        assert total[i] == n and (hits[i] == want).all()


def test_copies_do_not_stand_or_fall_as_one(docs_of, prose):
    """The sample's threshold is by doc_id and text, so a mass of copies leaves some."""
    rows = [(i, "abcd efgh abcd", "aa", "s") for i in range(3000)] + [(5000 + i, prose(i, 30, "klmnop"), "bb", "s") for i in range(20)]
    assert language.learn(docs_of(rows), max_docs=50).langs == ["aa", "bb"]


def test_odd_rows_and_clashing_columns(spark, docs_of, odd, prose):
    filters = language.learn(docs_of(corpus(prose, 8)))
    found = language.identify(odd.withColumnRenamed("source", "score").withColumnRenamed("n_chars", "_p"), filters).collect()
    assert len(found) == 10
    by = {r.doc_id: r for r in found}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3
    assert by[1].score == 0.0 and by[4].lang_pred in ALPHABETS


def test_nothing_to_learn_from(docs_of, odd):
    filters = language.learn(docs_of([]).where("false"))
    assert {r.lang_pred for r in language.identify(odd, filters).collect()} == {"und"}


def test_filters_hold_what_was_put_in():
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, 500, np.int64).view(np.uint64) for _ in range(70)]
    filters = language.Filters([f"{i:02}" for i in range(70)], sets, 14, 3)
    for l, s in enumerate(sets):
        assert ((filters.masks(l // 64, s) >> np.uint64(l % 64)) & np.uint64(1)).all()


def test_long_texts_are_counted_whole(docs_of, prose):
    filters = language.learn(docs_of(corpus(prose, 8)))
    a, b = prose(1, 300, ALPHABETS["aa"]), prose(2, 150_000, ALPHABETS["bb"])
    assert filters.predict([a + " " + b, a])[0] == ["bb", "aa"]


def test_tables_without_rows(spark, docs_of, prose):
    filters = language.learn(docs_of(corpus(prose, 4)))
    assert language.identify(docs_of([]), filters).count() == 0
