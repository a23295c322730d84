import random

import pytest

from palimpsest.errors import Conflict, Missing, NoSuchRef, RefExists, Truncated
from palimpsest.operators import fleet, logs, versions
from palimpsest.sources.store import ROOT, VersionedTable
from palimpsest.streaming import replica


def rows(df):
    return {r.page_no: r.page_id for r in df.collect()}


def test_random_session_against_a_dict(spark, tmp_path):
    rng = random.Random(9)
    store, model, heads = VersionedTable(spark, str(tmp_path), "p"), {ROOT: {}}, {"main": ROOT}
    store.branch("main")
    for step in range(14):
        name = rng.choice(sorted(heads))
        if step % 5 == 4:
            store.branch(f"b{step}", heads[name])
            heads[f"b{step}"] = heads[name]
            continue
        changes = {rng.randrange(8): rng.choice([None, *"uvwx"]) for _ in range(3)}
        made = store.commit(name, spark.createDataFrame(list(changes.items()), "page_no long, page_id string"), 1000 + step)
        after = {k: v for k, v in (model[heads[name]] | changes).items() if v is not None}
        assert (made == heads[name]) == (after == model[heads[name]])
        model[made], heads[name] = after, made
        assert rows(store.as_of(made)) == after
    for name, at in heads.items():
        assert rows(store.as_of(store.head(name))) == model[at]
    assert store.unreachable().isEmpty()


def test_depth_is_bounded_and_history_stays(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path), "p")
    store.branch("main")
    seen = [ROOT]
    for i in range(10):
        seen.append(store.commit("main", spark.createDataFrame([(i, f"v{i}")], "page_no long, page_id string"), i, base=seen[-1]))
    assert [store._manifest(m)["depth"] for m in seen] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 0, 1]
    assert rows(store.as_of(seen[10])) == {i: f"v{i}" for i in range(10)} and rows(store.as_of(seen[4])) == {i: f"v{i}" for i in range(4)}
    assert store.rewind("main", seen[3]) == seen[10] and store.unreachable().count() == 7
    with pytest.raises(Conflict):
        store.commit("main", spark.createDataFrame([(1, "z")], "page_no long, page_id string"), 99, base=seen[10])


def test_refs(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path), "p")
    store.branch("main")
    a = store.commit("main", spark.createDataFrame([(1, "a")], "page_no long, page_id string"), 1)
    store.branch("side", a)
    b = store.commit("side", spark.createDataFrame([(1, None), (2, "b")], "page_no long, page_id string"), 2)
    c = store.commit("main", spark.createDataFrame([(1, "c")], "page_no long, page_id string"), 3)
    assert store.merge_base(b, c) == a
    assert {r.page_no: r["class"] for r in store.diff3(b, c).collect()} == {1: "Conflict", 2: "AOnly"}
    store.tag("v1", a)
    store.tag("v1", a)
    for call in (lambda: store.tag("v1", b), lambda: store.branch("main", a)):
        with pytest.raises(RefExists):
            call()
    with pytest.raises(NoSuchRef):
        store.rewind("none", a)
    with pytest.raises(Missing):
        store.branch("x", "f" * 64)
    store.delete_branch("side")
    assert {r.name for r in store.refs().collect()} == {"main", "v1"}


def test_restore_makes_a_branch(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path), "p")
    store.branch("main")
    made = [store.commit("main", spark.createDataFrame([(1, f"v{i}")], "page_no long, page_id string"), 10 * i) for i in range(1, 4)]
    assert store.restore("then", "main", 25) == store.head("then") == made[1] and store.head("main") == made[2]
    assert rows(store.as_of(store.head("then"))) == {1: "v2"}
    assert store.restore("before", "main", 9) == ROOT
    with pytest.raises(RefExists):
        store.restore("then", "main", 30)


def test_replica_moves_at_commits_only(spark, tmp_path):
    def write(n, recs):
        spark.createDataFrame([(n, lsn, no, pid, commit, False, False) for lsn, no, pid, commit in recs], replica.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    run = lambda: replica.follow(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    write(0, [(1, 7, 70, False), (2, None, None, True), (3, 8, 80, False)])
    run()
    assert rows(replica.visible(spark, f"{tmp_path}/out")) == {7: 70} and replica.lag(spark, f"{tmp_path}/out", 3) == 1
    write(1, [(4, 7, None, False), (5, None, None, True)])
    run()
    assert rows(replica.visible(spark, f"{tmp_path}/out")) == {8: 80}


def test_three_way_classes_and_tombstones(spark):
    make = lambda d: spark.createDataFrame(list(d.items()), "page_no long, page_id string")
    base, a, b = {0: "x", 1: "x", 2: "x", 3: "x", 4: "x"}, {0: "x", 1: "y", 2: "x", 3: "y"}, {0: "x", 1: "x", 2: "z", 3: "z"}
    found = {r.page_no: r["class"] for r in versions.diff3(make(base), make(a), make(b)).collect()}
    assert found == {1: "AOnly", 2: "BOnly", 3: "Conflict", 4: "BothSame"}
    chain = spark.createDataFrame([(1, "old", 2), (1, None, 1), (2, "p", 2), (2, "q", 0)], "page_no long, page_id string, hop int")
    assert rows(versions.resolve(chain)) == {2: "q"}


def test_cycles_end_a_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long")
    assert versions.closure(edges, spark.createDataFrame([(1,)], "n long"), 50).count() == 3


def test_what_a_fleet_refuses():
    fleet.check(["count", "avg"])
    for wrong in (lambda: fleet.check(["median"]), lambda: fleet.check([], joins_databases=True), lambda: fleet.check([], distinct=True), lambda: fleet.check([], window=True)):
        with pytest.raises(fleet.Unsupported):
            wrong()


def test_eviction_stops_at_the_budget(spark):
    pages = spark.createDataFrame([(i, 10, 100 - i, i != 3) for i in range(10)], "page long, size long, touched long, durable boolean")
    assert {r.page for r in logs.evictions(pages, 75).collect()} == {9, 8, 7}
    assert logs.evictions(pages, 100).count() == 0


def test_history_of_any_length(spark, tmp_path):
    """More commits than any fixed number of rounds reaches: all of them are live, and old forks have their base."""
    store, n = VersionedTable(spark, str(tmp_path), "p"), 10_100
    line = [(f"m{i}", f"m{i - 1}" if i else ROOT, None, 0, 0, i) for i in range(n)]
    store._append("manifests", [*line, ("fork", "m3", None, 0, 0, n), ("loose", "m5", None, 0, 0, n)], "manifest string, parent string, overlay_base string, depth int, page_count long, created_at_ms long")
    store.branch("main", f"m{n - 1}")
    store.branch("old", "fork")
    assert [r.manifest for r in store.unreachable().collect()] == ["loose"]
    assert store.merge_base(f"m{n - 1}", "fork") == "m3"


def test_closure_is_whole_or_refused(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "child long, parent long")
    loop = chain.union(spark.createDataFrame([(6, 2)], chain.schema))
    forked = loop.union(spark.createDataFrame([(0, 4)], chain.schema))
    root = spark.createDataFrame([(0,)], "node long")
    far = lambda df: {r.node: r.distance for r in df.collect()}
    want = {i: i for i in range(7)}
    assert far(versions.closure(chain, root)) == far(versions.closure(loop, root)) == far(versions.closure(chain, root, 6)) == want
    assert far(versions.closure(forked, root)) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1, 5: 2, 6: 3}
    with pytest.raises(Truncated):
        versions.closure(chain, root, 5).collect()
