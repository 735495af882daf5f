"""Pack store: the same pack again, other content, writers at the same time; lineage of deep chains; reload."""

import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from corvex.operators import packs
from corvex.sources import shared


def store(spark):
    return packs.PackStore(spark, f"{shared.shared_dir(spark)}/test-packs-{random.random()}")


def rows(spark, *named):
    made = spark.createDataFrame([(k, p, v, t) for k, p, v, t in named], "pack_id string, parent_pack_id string, pack_version int, text string")
    return packs.sealed(made, ["pack_id", "text", "pack_version"])


def test_same_again_and_conflict(spark):
    s = store(spark)
    assert s.packs().count() == 0
    first = rows(spark, ("p1", None, 1, "a"), ("p2", "p1", 2, None))
    assert s.save(first) == 2 and s.save(first) == 0
    assert s.save(rows(spark, ("p1", None, 1, "a"), ("p3", "p2", 3, "c"))) == 1
    with pytest.raises(packs.PackConflict, match="p2"):
        s.save(rows(spark, ("p4", None, 1, "x"), ("p2", "p1", 2, "other")))
    with pytest.raises(packs.PackConflict, match="p5"):
        s.save(rows(spark, ("p5", None, 1, "x"), ("p5", None, 1, "y")))
    got = packs.verified(s.packs()).collect()
    assert sorted(r.pack_id for r in got) == ["p1", "p2", "p3"] and all(r.intact for r in got)
    assert s.save(rows(spark, ("p6", None, 1, "x"), ("p6", None, 1, "x"))) == 1


def test_writers_at_the_same_time(spark):
    s, stored, failed = store(spark), [], []

    def write(i):
        try:
            stored.append(packs.PackStore(spark, s.path).save(rows(spark, ("shared", None, 1, "same"), (f"own{i}", None, 1, str(i)), ("clash", None, 1, str(i % 2)))))
        except packs.PackConflict as e:
            failed.append(str(e))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    ids = [r.pack_id for r in s.packs().collect()]
    assert len(ids) == len(set(ids)) and {"shared", "clash"} <= set(ids)
    # Who stored ``clash`` first decides which two of the four writers may succeed.
    assert len(failed) == 2 and sorted(stored, reverse=True)[0] == 3 and sum(stored) == len(ids)


def test_put_if_absent_once(spark):
    path, won = f"{shared.shared_dir(spark)}/test-claim-{random.random()}", []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if shared.put_if_absent(spark, path, str(i)) else None) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and shared.read_text(spark, path) == str(won[0])


def test_lineage_of_deep_chains(spark):
    links = [(f"a{i}", f"a{i - 1}" if i else None) for i in range(51)] + [(f"b{i}", "a30" if i == 0 else f"b{i - 1}") for i in range(20)] + [("alone", None), ("orphan", "gone"), ("alone", None)]
    got = {tuple(r) for r in packs.ancestors(spark.createDataFrame(links, "pack string, parent string"), "pack", "parent").collect()}
    con = duckdb.connect()
    con.execute("create table l (pack varchar, parent varchar)")
    con.executemany("insert into l values (?, ?)", links)
    want = con.execute("with recursive r as (select distinct pack, pack as a, 0 as d from l union all select r.pack, l.parent, d + 1 from r join (select distinct * from l) l on l.pack = r.a where l.parent is not null) select * from r").fetchall()
    assert got == set(want) and ("a50", "a0", 50) in got and ("orphan", "gone", 1) in got


def test_lineage_faults(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "pack string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        packs.ancestors(frame(("a", "b"), ("b", "c"), ("c", "a")), "pack", "parent")
    with pytest.raises(ValueError, match="two parents"):
        packs.ancestors(frame(("a", "b"), ("a", "c")), "pack", "parent")
    assert packs.ancestors(frame(("a", None)).limit(0), "pack", "parent").count() == 0


def test_reload(spark):
    links = spark.createDataFrame([("p1", None), ("p2", "p1"), ("p3", "p2"), ("q", None)], "pack_id string, parent_pack_id string")
    items = spark.createDataFrame([("p1", 1, "i1", "c1", None), ("p1", 2, "i2", "c2", "own"), ("p3", 1, "i3", "gone", None), ("q", 1, "i4", "c1", None)], "pack_id string, rank int, pack_item_id string, chunk_id string, text string")
    pages = spark.createDataFrame([("c1", 4, 5, "chunk one"), ("c2", 6, 6, "chunk two")], "chunk_id string, page_start int, page_end int, chunk_text string")
    anchors = spark.createDataFrame([("c1", "x2"), ("c1", "x1")], "chunk_id string, anchor_id string")
    got = packs.reload(links, items, pages, anchors, links.where(F.col("pack_id") == "p3").select("pack_id")).orderBy("place").collect()
    assert [(r.pack_item_id, r.generation, r.text, r.page_start, r.anchor_id) for r in got] == [("i3", 0, None, None, None), ("i1", 2, "chunk one", 4, "x1"), ("i2", 2, "own", 6, None)]
