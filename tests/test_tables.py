"""Stores and tables: what a change writes, and what two writers and an interrupted one leave."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources.tables import Conflict, Snapshot, Store, Table, partition_name, partition_of
from lodestone.streaming import sync_stream
from lodestone.operators.chunk import ChunkSize


def rows(spark, *r):
    return spark.createDataFrame(list(r), "id int, v string").coalesce(1)


@pytest.fixture
def table(spark, tmp_path):
    return Table(Store(spark, str(tmp_path)), "t", "id INT, v STRING", ["id"], unique=True, buckets=4)


def content(table, *at):
    return sorted(map(tuple, table.read(*at).collect()))


def test_upserts_and_deletes(spark, table):
    assert content(table) == [] and table.store.snapshot() == Snapshot()
    table.upsert(rows(spark, (1, "a"), (1, "b"), (2, "c")))
    table.upsert(rows(spark, (1, "d"), (3, "e"), (1, "f")))
    assert content(table) == [(1, "f"), (2, "c"), (3, "e")]
    first = table.store.snapshot()
    table.delete(F.col("id") == 2)
    assert content(table) == [(1, "f"), (3, "e")] and content(table, first) == [(1, "f"), (2, "c"), (3, "e")]
    table.delete(F.lit(None).cast("boolean"))
    table.delete(F.lit(True))
    assert content(table) == [] and table.store.snapshot().of("t") == {}
    table.upsert(rows(spark, (None, "x"), (None, "y")))
    table.upsert(rows(spark, (None, "z")))
    assert content(table) == [(None, "z")]
    table.upsert(rows(spark))
    assert content(table) == [(None, "z")]


def test_a_change_writes_the_buckets_it_touches(spark, table):
    table.upsert(spark.range(100).selectExpr("cast(id as int) id", "'old' v"))
    before = table.store.snapshot()
    assert len(before.of("t")) == 4
    after = table.upsert(rows(spark, (7, "new")))
    changed = [b for b in after.of("t") if after.of("t")[b] != before.of("t")[b]]
    assert len(changed) == 1
    top = after.of("t")[changed[0]].split("/")[0]
    files = glob.glob(f"{table.store.path}/t/{top}/**/*.parquet", recursive=True)
    assert {os.path.basename(os.path.dirname(f)) for f in files} == set(changed)
    assert table.read().count() == 100 and table.read().where("v = 'new'").count() == 1
    gone = table.delete(F.col("id") == 7)
    assert sum(gone.of("t")[b] != f for b, f in after.of("t").items() if b in gone.of("t")) <= 1 and table.read().count() == 99


def test_of_two_writers_one_gets_a_conflict(spark, table):
    table.upsert(rows(spark, (1, "a")))
    read_by_both = table.store.snapshot()
    table.upsert(rows(spark, (2, "b")), after=read_by_both)
    for late in (lambda: table.upsert(rows(spark, (3, "c")), after=read_by_both), lambda: table.commit(rows(spark, (9, "z")), read_by_both), lambda: table.delete(F.lit(True), after=read_by_both)):
        with pytest.raises(Conflict):
            late()
    assert content(table) == [(1, "a"), (2, "b")]
    assert not [f for f in os.listdir(f"{table.store.path}/_versions") if f.startswith(".") and not f.endswith(".crc")]


def test_an_interrupted_writer_leaves_the_old_version(spark, table):
    table.upsert(rows(spark, (1, "a"), (2, "b")))
    versions = f"{table.store.path}/_versions"
    # one that died while it wrote its pointer aside, and an empty pointer of another tool
    open(f"{versions}/.half", "w").write('{"t": {"_buck')
    open(f"{versions}/000000000002", "w").close()
    assert content(table) == [(1, "a"), (2, "b")]
    with pytest.raises(Conflict):  # the number is taken; nothing is lost
        table.upsert(rows(spark, (3, "c")))
    os.remove(f"{versions}/000000000002")
    table.upsert(rows(spark, (3, "c")))
    assert content(table) == [(1, "a"), (2, "b"), (3, "c")]


def test_one_version_for_all_tables_of_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    a, b = (Table(store, name, "id INT, v STRING", ["id"], True, 2) for name in "ab")
    at = store.publish(Snapshot(), {"a": a.replaced(rows(spark, (1, "a"))), "b": b.replaced(rows(spark, (1, "b")))})
    later = a.upsert(rows(spark, (2, "a2")))
    assert (content(a), content(b)) == ([(1, "a"), (2, "a2")], [(1, "b")]) and content(a, at) == [(1, "a")] and later.version == 2


def test_partitions_are_pruned_and_null_is_not_empty(spark, tmp_path):
    t = Table(Store(spark, str(tmp_path)), "t", "ns STRING, id INT", ["ns", "id"], True, 2, ("ns",))
    spaces = [None, "", "none", "a/b=c", "é", "x" * 300]
    t.upsert(spark.createDataFrame([(s, i) for s in spaces for i in range(5)], "ns string, id int"))
    assert t.read().count() == 30
    for s in spaces:
        own = t.read(ns=s)
        assert {(x.ns, x.id) for x in own.collect()} == {(s, i) for i in range(5)}
        assert {f"_by0={partition_of(s)}" in f for f in own.inputFiles()} == {True}
        assert spark.createDataFrame([(s,)], "s string").select(partition_name(F.col("s"))).first()[0] == partition_of(s)
    t.upsert(spark.createDataFrame([(None, 1), ("", 9)], "ns string, id int"))
    assert t.read(ns=None).count() == 5 and t.read(ns="").count() == 6 and t.read(ns="there is none").count() == 0


def test_a_stream_commits_chunks_and_quarantine_at_once(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    chunks, held = sync_stream.chunk_table(store), sync_stream.quarantine_table(store)
    run = lambda: sync_stream.sync_stream(spark, str(docs), chunks, str(tmp_path / "seen"), ChunkSize(40, 0, 4), quarantine=held).awaitTermination()
    (docs / "a.md").write_text("# A\n\nThe first text has some words.\n")
    (docs / "b.md").write_text("  \n")
    run()
    assert store.snapshot().version == 1 and held.read().count() == 1 and chunks.read().select("document_id").distinct().count() == 1
    (docs / "c.md").write_text("# C\n\nAnother text has some words too.\n")
    run()
    assert store.snapshot().version == 2 and held.read().count() == 1 and chunks.read().select("document_id").distinct().count() == 2
    assert os.listdir(tmp_path / "store" / "_staging") in ([], [f".{store.own}.crc"])
