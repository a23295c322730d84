"""Queries with SQL give the same rows as DuckDB on small tables that the provided ones have no example of."""

import duckdb
import pytest
from test_queries import plain

from palimpsest.operators import retrieval
from palimpsest.plans import queries


@pytest.fixture
def same(spark, tmp_path):
    def run(name, **tables):
        db = duckdb.connect()
        for table, rows in tables.items():
            db.execute(f"create table {table} as {rows}")
            db.execute(f"copy {table} to '{tmp_path}/{table}.parquet'")
        df = queries.QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        want = db.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
        found = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
        assert found == sorted(tuple(map(plain, r)) for r in want)
        return found

    return run


#: 7 and 14 are both roots, and 14 is derived from 7.
ROOTS = "select i doc_id, 'word' || i || ' some text' as text, 'en' lang, case when i in (7, 14) then 'src3' else 'src1' end source, 15 n_chars from (values (0), (3), (7), (13), (14)) t(i)"


def test_combined_root_derived_from_root(same):
    vectors = "select i vec_id, [i, 1, i % 3]::float[] embedding from range(18) t(i)"
    found = same("retrieve_combined", documents=ROOTS, embeddings=vectors, labels="select 3::bigint doc_id, 0 quality, 0 toxic")
    assert len(found) == 5


def test_stale_root_derived_from_root(same):
    assert [k for k, s in same("staleness", documents=ROOTS) if s == "Stale"] == ["14"]


@pytest.mark.parametrize("words", [0, 1000])
def test_bm25_over_blocks(same, monkeypatch, words):
    for name, size in {"DOCS": 40, "QUERIES": 2, "WORDS": words}.items():
        monkeypatch.setattr(retrieval, name, size)
    text = "case when i % 40 = 7 then null when i % 40 = 8 then '' else 'the word' || i % 9 || ' and the ' || repeat(chr(97 + (i % 5)::int) || ' ', (i % 4)::int) || ' of' end"
    found = same("retrieve_bm25", documents=f"select i doc_id, {text} as text from range(300) t(i)")
    assert len(found) == 60


def test_expand_in_many_tasks(same, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIRS", 500)
    found = same("retrieve_expand", lineitem="select i % 211 l_partkey, case when i % 3 = 0 then 1 else i % 17 end l_suppkey from range(2000) t(i)")
    assert len(found) == 5


def _shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty()
    none = gateway.jvm.java.util.ArrayList()
    stages = context.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}


def test_bm25_shuffles_documents_not_words(spark, same, monkeypatch):
    """2,000 documents of 100 different words, some of which occur twice."""
    monkeypatch.setattr(retrieval, "ROWS", 777)
    word = "(i * 37 + i // 50 * 13 + j * 11) % 200"
    text = f"array_to_string(list_transform(range(100 + i % 9), lambda j: chr((97 + {word} // 26)::int) || chr((97 + {word} % 26)::int) || case when j > 99 then ' ' || chr((97 + i % 26)::int) else '' end), ' ')"
    before = _shuffled(spark)
    found = same("retrieve_bm25", documents=f"select i::int doc_id, {text} as text from range(2000) t(i)")
    assert len(found) == 400
    assert sum(n for k, n in _shuffled(spark).items() if k not in before) < 15_000
