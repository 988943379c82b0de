"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts in the shard its id hashes to; documents of a group that
share a shard move alike, so the state is one row for each (group, chunk, first shard) with the shard it is in now. In
each round a group's documents elsewhere want to move to the shard that holds most of their neighbours, or of those
with room the one that holds most; a shard admits what fits its quota or is balanced by what leaves. Rounds are joins over stored tables; they end
when nothing moves. Then documents without neighbours, and what exceeds a quota, fill the shards that have room.

Law: ``rows``. Shards hold N // shards rows each, the first N % shards one more. A group larger than a quota must span
several shards: it is cut into chunks (by id hash, about a 64th of a quota each) that start and move separately. Any other
group is one chunk and, but for what exceeds a quota at the end, comes together. Groups of more than a 1024th of all rows are few
and broadcast to their rows, so no key is handled whole by one task. Null texts count as empty; repeated ids are rows of their own.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, drop_table, materialize, with_ordinals

CLASSES = 64
#: While labels move, a shard may hold this fraction (one in so many) over its quota; the end brings it to the quota.
SLACK = 10


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("_group"))
    base = materialize(base, "sizes")
    rows = base.count()
    quota = [rows // shards + (b < rows % shards) for b in range(shards)]
    most = max(1, rows // shards)  # a group of more rows than this is cut
    chunk_rows = max(1, most // 64)

    groups = base.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_group").alias("_g"), "_n")
    found_groups = materialize(groups, "groups")
    hot = F.broadcast(found_groups.where(F.col("_n") * HOT_SHARE > rows).select(F.col("_g").alias("_hg"), F.col("_n").alias("_hn")))
    cold = found_groups.where(F.col("_n") * HOT_SHARE <= rows)
    known = base.join(hot, base["_group"] == F.col("_hg"), "left")
    # rows of a hot group, whose count is known, meet the shuffle under keys of their own and find nothing there
    key = F.when(F.col("_hn").isNull(), F.col("_group")).otherwise(F.concat(F.lit("hot"), F.xxhash64("_id").cast("string")).cast("binary"))
    known = known.withColumn("_key", key).join(cold, F.col("_key") == cold["_g"], "left").withColumn("_rows", F.coalesce("_hn", "_n"))
    cut = F.coalesce(F.col("_rows") > most, F.lit(False))
    chunk = F.when(cut, F.pmod(F.xxhash64(F.lit("chunk"), "_id"), F.ceil(F.col("_rows") / chunk_rows).cast("long"))).otherwise(F.lit(0).cast("long"))
    start = F.when(cut, F.xxhash64(F.lit("first"), "_group", "_chunk")).otherwise(F.xxhash64(F.lit("first"), "_id"))
    linked = known.withColumn("_chunk", chunk).withColumn("_first", F.pmod(start, F.lit(shards)).cast("int")).select("_id", "size", "text_crc32", "_group", F.col("_rows").alias("_n"), "_first", "_chunk")
    linked = materialize(linked, "linked")
    drop_table(base)

    cells = linked.where("_n > 1").groupBy("_group", "_chunk", "_first").agg(F.count(F.lit(1)).alias("m"), (F.max("_n") > most).alias("_large")).withColumn("_shard", F.col("_first"))
    cells = propagate(materialize(cells, "cells"), quota, rounds)

    found = cells.select(F.col("_group").alias("_cg"), F.col("_chunk").alias("_cc"), F.col("_first").alias("_cf"), F.col("_shard").alias("_cs"))
    placed = linked.join(found, (linked["_group"] == found["_cg"]) & (linked["_chunk"] == found["_cc"]) & (linked["_first"] == found["_cf"]), "left")
    key = F.coalesce(F.col("_cs") * 2 + (F.col("_n") > most).cast("int"), F.lit(2 * shards))
    placed = materialize(placed.select("_id", "size", "text_crc32", key.alias("_key")), "placed")
    drop_table(found_groups)
    drop_table(linked)
    drop_table(cells)

    # documents are numbered within their shard: small groups, then groups that span shards anyway, which are the first
    # to give way; those without neighbours by themselves (the last key). Slots follow from the counts alone.
    count = dict(placed.groupBy("_key").count().collect())
    count = [count.get(k, 0) for k in range(2 * shards + 1)]
    kept, base, room = [], [], []
    for b in range(shards):
        small = min(count[2 * b], quota[b])
        large = min(count[2 * b + 1], quota[b] - small)
        kept, base, room = [*kept, small, large], [*base, 0, small], [*room, quota[b] - small - large]
    kept, base = [*kept, 0], [*base, 0]
    free_at = [count[-1] + x for x in (0, *accumulate(c - k for c, k in zip(count[:-1], kept, strict=False)))][:-1] + [0]
    room_ends = list(accumulate(room))
    taken, room_at = [q - r for q, r in zip(quota, room, strict=True)], [0, *room_ends[:-1]]
    pick = lambda key, values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), key + 1)

    numbered = with_ordinals(placed, ["_key"], rows, "_o", [F.xxhash64("_id"), F.col("_id"), F.col("text_crc32")], F.col("_id"))
    label = F.col("_key")
    numbered = numbered.withColumn("_free", F.when(F.col("_o") >= pick(label, kept), pick(label, free_at) + F.col("_o") - pick(label, kept)))
    filled = F.aggregate(F.array(*[F.lit(int(e)) for e in room_ends]), F.lit(0), lambda n, e: n + F.when(F.col("_free") >= e, 1).otherwise(0))
    own = F.floor(label / 2).cast("int")
    numbered = numbered.withColumn("shard", F.when(F.col("_free").isNull(), own).otherwise(F.least(filled, F.lit(shards - 1))).cast("int"))
    slot = F.when(F.col("_free").isNull(), pick(label, base) + F.col("_o")).otherwise(pick(F.col("shard"), taken) + F.col("_free") - pick(F.col("shard"), room_at))
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def propagate(cells: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """Move cells (``_group``, ``_chunk``, ``_first``, ``m``, ``_large``, ``_shard``) towards their group's heaviest shards under the quotas."""
    shards = len(quota)
    for turn in range(rounds):
        load = dict(cells.groupBy("_shard").agg(F.sum("m")).collect())
        room = [q + q // SLACK - load.get(b, 0) for b, q in enumerate(quota)]
        open_to = [b for b, r in enumerate(room) if r > 0] if turn % 2 else []
        weight = cells.groupBy("_group", "_shard").agg(F.sum("m").alias("w"))
        rank = F.struct("w", F.pmod(F.xxhash64("_group", "_shard"), F.lit(1 << 30)).alias("tie"), "_shard")
        best = weight.groupBy("_group").agg(F.max(rank).alias("top"), F.max(F.when(F.col("_shard").isin(open_to or [-1]), rank)).alias("open"))
        # in every other round those that find the heaviest shard full look for the heaviest one with room
        best = best.select(F.col("_group").alias("_bg"), F.coalesce("open", "top").alias("to"), "top")
        own = weight.select(F.col("_group").alias("_wg"), F.col("_shard").alias("_ws"), rank.alias("own"))
        wish = cells.join(own, (cells["_group"] == own["_wg"]) & (cells["_shard"] == own["_ws"])).join(best, F.col("_group") == F.col("_bg"))
        goes = (F.col("to._shard") != F.col("_shard")) & (F.col("to") > F.col("own")) & (F.col("top._shard") != F.col("_shard"))
        target = F.when(goes, F.col("to._shard"))
        full = [b for b, r in enumerate(room) if r <= 0]
        if open_to and full:
            # groups that span shards in any case make way: from full shards to the one with most room
            target = F.when(F.col("_large") & F.col("_shard").isin(full), F.lit(max(open_to, key=lambda b: room[b]))).otherwise(target)
        kind = F.pmod(F.xxhash64(F.lit(turn), "_group", "_chunk"), F.lit(CLASSES // 2)).cast("int") + F.when(F.col("_large"), CLASSES // 2).otherwise(0)
        key = (F.col("_shard") * shards + F.col("_target")) * CLASSES + kind
        wish = wish.withColumn("_target", target).select("_group", "_chunk", "_first", "m", "_large", "_shard", key.alias("wish"))
        wish = materialize(wish, "wish")
        asked = dict(wish.where("wish is not null").groupBy("wish").agg(F.sum("m")).collect())  # shards^2 * CLASSES rows at most
        allowed = admitted(asked, room, shards)
        if not allowed:
            drop_table(wish)
            if turn % 2:
                break
            continue
        flags = wish.sparkSession.createDataFrame([(k,) for k in sorted(allowed)], "_key int")
        to = F.floor(F.col("wish") / CLASSES).cast("int") % shards
        moved = wish.join(F.broadcast(flags), F.col("wish") == F.col("_key"), "left")
        after = materialize(moved.select("_group", "_chunk", "_first", "m", "_large", F.when(F.col("_key").isNotNull(), to).otherwise(F.col("_shard")).alias("_shard")), "cells")
        drop_table(cells)
        drop_table(wish)
        cells = after
    return cells


def admitted(asked: dict[int, int], room: list[int], shards: int) -> set[int]:
    """Which classes of moves fit: into room, and against moves the other way between the same two shards."""
    ends = lambda k: divmod(k // CLASSES, shards)
    waiting, out = sorted(asked, key=lambda k: (k % CLASSES >= CLASSES // 2, -asked[k], k)), set()  # large groups last

    def admit(*keys: int) -> None:
        for k in keys:
            source, target = ends(k)
            room[source] += asked[k]
            room[target] -= asked[k]
            out.add(k)

    while True:
        before = len(out)
        for k in waiting:
            if k not in out and asked[k] <= room[ends(k)[1]]:
                admit(k)
        lanes: dict[tuple[int, int], list[int]] = {}
        for k in waiting:
            if k not in out:
                lanes.setdefault(ends(k), []).append(k)
        for (i, j), there in lanes.items():
            back = lanes.get((j, i), []) if i < j else []
            a = b = 0
            while a < len(there) and b < len(back):
                net = asked[there[a]] - asked[back[b]]
                if net <= room[j] and -net <= room[i]:
                    admit(there[a], back[b])
                    a, b = a + 1, b + 1
                elif net > 0:
                    a += 1
                else:
                    b += 1
        if len(out) == before:
            return out
