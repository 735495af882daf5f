"""Balanced label propagation: shards of even size that cut few links.

Documents with equal texts are linked.  They are not linked pair by pair: a
group is a hub, and a document's neighbours vote through it.  Documents begin
in shards by hash.  In a round, each hub counts its members by shard, chooses
the shard that holds most of them and still has room (more than one, if a shard
cannot hold it), and members of the other shards move there.  Quotas keep the
shards even: what may move between two shards is settled on a matrix of shards
by shards, and a document moves if its hash falls under the share that the quota
allows.  At last, the few documents over a shard's size, unlinked ones first,
take the free slots of other shards.

Only DataFrame functions are used.  Rows are kept in order of their hub, and
the number of the partition a row lies in goes with it: hub and partition are
the key of every join, so that a hub with a third of all rows is spread over as
many keys as it fills partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvex.llm import store

SHARDS = 8
ROUNDS = 6
#: A shard is full when less than this share of its size is left; propagation ends when less than that share of all documents moves.
FULL, STILL = 0.02, 0.002


def quotas(wants: dict[tuple[int, int], float], room: list[int]) -> list[list[float]]:
    """The share of the documents wanting from s to t that may go.

    A shard takes as many as it has room for and as leave it: whatever asks for
    more is scaled down, which lets fewer leave others, until nothing changes.
    """
    n = len(room)
    flow = [[float(wants.get((s, t), 0)) for t in range(n)] for s in range(n)]
    for _ in range(1000):
        changed = False
        for t in range(n):
            most = max(0.0, room[t] + sum(flow[t]))
            asked = sum(flow[s][t] for s in range(n))
            if asked > most * (1 + 1e-9) + 1e-9:
                for s in range(n):
                    flow[s][t] *= most / asked
                changed = True
        if not changed:
            break
    return [[flow[s][t] / wants[s, t] if wants.get((s, t)) else 0.0 for t in range(n)] for s in range(n)]


def _sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _votes(linked: DataFrame, full: list[bool], size: float) -> DataFrame:
    """Of each hub: members by shard, the shards to go to, which shards' members want to, and its partitions.

    A hub that no shard can hold takes as many shards as it needs.
    """
    shards = range(len(full))
    votes = linked.groupBy("hub").agg(*[F.count_if(F.col("shard") == s).alias(f"c{s}") for s in shards], F.min("pid").alias("lo"), F.max("pid").alias("hi"))
    # Equal votes are decided by the hub's hash, so that they don't all fall to one shard; a full shard loses them.
    tie = lambda s: F.pmod(F.xxhash64("hub") + F.lit(s), F.lit(len(full)))
    standing = F.array(*[F.struct(F.col(f"c{s}").alias("c"), F.lit(not full[s]).alias("open"), tie(s).alias("tie"), F.lit(s).alias("t")) for s in shards])
    counts = F.array(*[F.col(f"c{s}") for s in shards])
    votes = votes.select("hub", "lo", "hi", counts.alias("counts"), F.sort_array(standing, asc=False).alias("order"))
    needed = F.ceil(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c) / F.lit(size)).cast("int")
    votes = votes.withColumn("chosen", F.slice("order", 1, F.greatest(F.lit(1), needed)))
    open_ones = lambda c: F.filter(c, lambda x: x["open"])
    votes = votes.withColumn("dest", F.when(F.size(open_ones("chosen")) > 0, open_ones("chosen")).otherwise(F.slice(open_ones("order"), 1, 1)))
    stay = F.transform("chosen", lambda x: x["t"])
    wants = F.transform(F.sort_array(F.transform("order", lambda x: F.struct(x["t"].alias("t"), x.alias("own")))), lambda x: (x["own"]["c"] > 0) & ~F.array_contains(stay, x["t"]) & F.coalesce(x["own"] < F.get("dest", F.lit(0)), F.lit(False)))
    return votes.select("hub", "counts", F.transform("dest", lambda x: x["t"]).alias("to"), wants.alias("wants"), "lo", "hi")


def propagate(linked: DataFrame, free: list[int], shards: int = SHARDS, rounds: int = ROUNDS, scratch: store.Scratch | None = None) -> DataFrame:
    """Moves linked rows (row, hub, pid, shard, and others) towards their neighbours' shards.  Staged.

    free: the unlinked documents of each shard, which give way.  Driver and
    rounds exchange matrices of shards by shards only.
    """
    scratch = scratch or store.Scratch(linked.sparkSession)
    now = linked
    for turn in range(rounds):
        held = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row for each shard
        total = sum(held.values()) + sum(free)
        room = [size - held.get(s, 0) for s, size in enumerate(_sizes(total, shards))]
        full = [r <= FULL * total / shards for r in room]
        if all(full):
            # Every shard holds linked documents to the brim: they may still change places.
            full = [False] * shards
        votes = scratch.stage(_votes(now, full, total / shards), "votes")
        asked = votes.select("to", F.posexplode(F.arrays_zip("counts", "wants")).alias("s", "v")).where("v.wants")
        asked = asked.select("s", F.explode("to").alias("t"), (F.col("v.counts") / F.size("to")).alias("n")).groupBy("s", "t").agg(F.sum("n").alias("n"))
        wants = {(r["s"], r["t"]): r["n"] for r in asked.collect()}  # shards by shards
        share = quotas(wants, room)
        if sum(share[s][t] * n for (s, t), n in wants.items()) <= STILL * total:
            scratch.drop(votes)
            break
        table = F.array(*[F.array(*map(F.lit, row)) for row in share])
        near = votes.where(F.exists("wants", lambda w: w)).select("hub", F.explode(F.sequence("lo", "hi")).alias("pid"), "to", "wants")
        moved = now.join(near, ["hub", "pid"], "left").withColumn("t", F.get("to", F.pmod(F.xxhash64("row", F.lit(-1)), F.size("to")).cast("int")))
        chance = F.shiftrightunsigned(F.xxhash64("row", F.lit(turn)), 11) / F.lit(float(1 << 53))
        moves = F.coalesce(F.get("wants", F.col("shard")), F.lit(False)) & (chance < F.get(F.get(table, F.col("shard")), F.col("t")))
        moved = moved.withColumn("shard", F.when(moves, F.col("t")).otherwise(F.col("shard")))
        before, now = now, scratch.stage(moved.select(linked.columns), "moved")
        scratch.drop(votes, *([before] if before is not linked else []))
    return now


def _placed(rows: DataFrame, shards: int, scratch: store.Scratch) -> DataFrame:
    """Exact sizes and slots: rows over a shard's size take the free slots of others.

    Rows are ranked in their shard without a sort of the whole shard: ranges are
    in order, and each row's place in its range is added to what lies before.
    """
    ordered = rows.repartitionByRange("shard", "unlinked", "hub", "row").sortWithinPartitions("shard", "unlinked", "hub", "row")
    ordered = scratch.stage(ordered.withColumns({"pid": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).drop("hub"), "placed")
    parts = ordered.groupBy("pid", "shard").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("pid", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    held = {r["shard"]: r["n"] for r in ordered.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row for each shard
    n = [held.get(s, 0) for s in range(shards)]
    size = _sizes(sum(n), shards)
    over, holes = [0], [0]
    for s in range(shards):
        over.append(over[-1] + max(0, n[s] - size[s]))
        holes.append(holes[-1] + max(0, size[s] - n[s]))
    pick = lambda values, at: F.get(F.array(*[F.lit(v).cast("long") for v in values]), at)
    # As many rows as ranges and shards.
    ranked = ordered.join(F.broadcast(parts), ["pid", "shard"]).withColumn("rank", F.col("at") + F.col("shift"))
    ranked = ranked.withColumn("k", F.when(F.col("rank") >= pick(size, F.col("shard")), F.col("rank") - pick(size, F.col("shard")) + pick(over, F.col("shard"))))
    to = sum((F.when(F.col("k") >= end, 1).otherwise(0) for end in holes[1:]), F.lit(0))
    ranked = ranked.withColumn("to", F.when(F.col("k").isNotNull(), to))
    slot = F.when(F.col("to").isNull(), F.col("rank")).otherwise(F.col("k") - pick(holes, F.col("to")) + pick(n, F.col("to")))
    return ranked.select("key", "size", "crc", F.coalesce("to", "shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): law ``rows``, shards at most one document apart.

    Slots of a shard have no gaps from 0.  A null text is empty, and empty texts
    are equal ones; rows that repeat are documents of their own; null keys stay
    null; a group larger than a shard fills several; very long texts are hashed
    in their row and not moved.  An empty table gives no rows.  Other columns
    are dropped first, so that their names cannot clash.
    """
    spark = docs.sparkSession
    scratch, last = store.Scratch(spark), store.Scratch(spark)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("crc"), F.unhex(F.sha2(content, 256)).alias("hub"))
    hashed = scratch.stage(rows.withColumn("row", F.monotonically_increasing_id()), "hashed")
    # In order of hubs; a hub may fill many partitions, as rows have an order within it.
    ordered = hashed.repartitionByRange("hub", "row").withColumn("pid", F.spark_partition_id())
    ordered = scratch.stage(ordered.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "ordered")
    hubs = ordered.groupBy("hub").agg(F.count("*").alias("n"), F.min("pid").alias("lo"), F.max("pid").alias("hi")).where("n > 1")
    hubs = hubs.select("hub", F.explode(F.sequence("lo", "hi")).alias("pid"), F.lit(False).alias("unlinked"))
    rows = scratch.stage(ordered.join(hubs, ["hub", "pid"], "left").withColumn("unlinked", F.coalesce("unlinked", F.lit(True))), "rows")
    alone = rows.where("unlinked")
    free = {r["shard"]: r["n"] for r in alone.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row for each shard
    linked = propagate(rows.where("not unlinked"), [free.get(s, 0) for s in range(shards)], shards, rounds, scratch)
    out = _placed(alone.unionByName(linked), shards, last)
    scratch.drop_all()
    return out.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
