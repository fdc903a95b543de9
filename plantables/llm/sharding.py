"""Sharding by balanced label propagation: linked documents move to their neighbours' shards.

Documents start in a shard by hash, but those of large hubs (a hub is what
links its documents: here, an equal text) in the shard where the hub fits best
as a whole. In each round every hub names the shard where most of its rows are,
and its documents move there as far as the shard has room. Then rows are
ranked and what a shard holds over its quota goes where there is room, rows
without links first, so that counts are at most one apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantables.llm.common import Cut, cut, fresh

SHARDS = 16
#: Rounds at most; they end once no hub wants to move.
ROUNDS = 12
#: What a shard may hold of linked rows over their even share between rounds, if that is more than a shard's size.
SLACK = 0.05
#: Rows ranked together, about; and the least number of such groups in a shard.
RANKED_ROWS = 20_000
#: A hub of more than this part of a shard is placed whole before the rounds; there are LARGE * shards of them at most.
LARGE = 16
LEAST_GROUPS = 16


def _chance(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) / F.lit(1_000_003)


def _by_shard(values: dict[int, float], shard: Column, kind: str, key: str = "int") -> Column:
    """A value looked up by shard (or hub), from as many as there are shards (or large hubs)."""
    pairs = [x for k, v in values.items() for x in (F.lit(int(k)).cast(key), F.lit(v).cast(kind))]
    return F.element_at(F.create_map(*pairs), shard)


def _parts_of_hubs(links: DataFrame, total: int, shards: int) -> DataFrame:
    """links(node, hub, rows) -> hubs too large for a shard are several, by the node's hash, as few as can be.

    Hub sizes are summed within tasks and written before they are joined, so
    that Spark knows whether to broadcast them, or where to split a hot hub;
    so are votes below.
    """
    most = max(1, -(-total // shards))
    sizes = cut(links.groupBy("hub").agg(F.sum("rows").alias("held"), F.count("*").alias("nodes")).filter("nodes > 1 or held > 1"), "hubs")
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.ceil(F.col("held") / most))
    return links.join(sizes, "hub").select("node", "rows", F.when(F.col("held") <= most, F.col("hub")).otherwise(F.xxhash64("hub", part)).alias("hub"))


def best_fit(sizes: dict[int, int], total: int, shards: int) -> dict[int, int]:
    """A shard for each hub of some size, largest first: where it leaves least room, or where there is most if it fits nowhere."""
    room = {s: total // shards + (s < total % shards) for s in range(shards)}
    found = {}
    for hub, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fits = [s for s in room if room[s] >= size]
        found[hub] = min(fits, key=lambda s: (room[s], s)) if fits else max(room, key=lambda s: (room[s], -s))
        room[found[hub]] -= size
    return found


def start(node: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit("shard")), F.lit(shards)).cast("int")


def propagate(links: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """links(node, hub, rows) -> (node, hub, shard): a shard for each linked node after the rounds.

    hub: of the node's hubs the one with the most say. total: rows of all
    nodes, linked or not. Only shard totals come to the driver.
    """
    linked = cut(_parts_of_hubs(links, total, shards), "linked")
    # sums over hubs of more than a part of a shard: LARGE * shards rows at most, as each link's rows count for one hub
    large = linked.groupBy("hub").agg(F.sum("rows").alias("n")).filter(F.col("n") > max(1, total // (shards * LARGE))).collect()
    seed = _by_shard(best_fit({r.hub: r.n for r in large}, total, shards), F.col("hub"), "int", "long") if large else F.lit(None).cast("int")
    nodes = linked.withColumn("seed", seed).groupBy("node").agg(F.max("rows").alias("rows"), F.min("hub").alias("hub"), F.min("seed").alias("seed"))
    now = Cut(nodes.select("node", "rows", "hub", F.coalesce("seed", start(F.col("node"), shards)).alias("shard")), "shards")
    # only linked rows count between rounds: the others give way to them when rows are ranked
    own = {r["shard"]: r["n"] for r in now.df.groupBy("shard").agg(F.sum("rows").alias("n")).collect()}
    held = {s: own.get(s, 0) for s in range(shards)}
    most = max(total, sum(held.values()) * (1 + SLACK)) / shards
    for r in range(rounds):
        votes = linked.select("node", "hub").join(now.df.select("node", "rows", "shard"), "node").groupBy("hub", "shard").agg(F.sum("rows").alias("n"))
        # a shard without room is named only by hubs that stand nowhere else
        room = _by_shard({s: float(held[s] < most) for s in held}, F.col("shard"), "double")
        named = Cut(votes.groupBy("hub").agg(F.max_by("shard", F.struct(room, "n", F.xxhash64("hub", "shard"))).alias("wish"), F.max("n").alias("n")), "votes")
        says = linked.select("node", "hub").join(named.df, "hub").groupBy("node").agg(F.max_by(F.struct("wish", "hub"), F.struct("n", "hub")).alias("top"))
        want = Cut(now.df.drop("hub").join(says, "node").select("node", "rows", "shard", "top.wish", "top.hub"), "wishes")
        named.drop()
        moves = want.df.filter("wish <> shard").groupBy("wish", "shard").agg(F.sum("rows").alias("n")).collect()
        if not moves:
            want.drop()
            break
        into = {s: sum(m.n for m in moves if m.wish == s) for s in range(shards)}
        out = {s: sum(m.n for m in moves if m.shard == s) for s in range(shards)}
        part = {s: min(1.0, max(0.0, most - held[s] + out[s] / 2) / into[s]) if into[s] else 0.0 for s in range(shards)}
        goes = (F.col("wish") != F.col("shard")) & (_chance("hub", F.lit(r)) < _by_shard(part, F.col("wish"), "double"))
        after = Cut(want.df.select("node", "rows", "hub", F.when(goes, F.col("wish")).otherwise(F.col("shard")).alias("shard")), "shards")
        moved = want.df.filter(goes).groupBy("wish", "shard").agg(F.sum("rows").alias("n")).collect()
        for m in moved:
            held[m.wish] += m.n
            held[m.shard] -= m.n
        now.drop()
        want.drop()
        now = after
    return now.df.select("node", "hub", "shard")


def _ranked(rows: DataFrame, total: int, shards: int) -> tuple[DataFrame, dict[int, int]]:
    """Adds `rank`, gapless from 0 in each shard, linked rows first; and the rows of each shard.

    Ranks are counted in small groups by hash, after the sums of the groups
    before. There is a group for RANKED_ROWS rows, and their sums are all that
    a task holds of a shard.
    """
    groups = max(LEAST_GROUPS, total // shards // RANKED_ROWS)
    single = F.col("hub").isNull()
    part = F.pmod(F.xxhash64(F.coalesce("hub", "node"), F.when(single, F.lit(0)).otherwise(F.lit(1))), F.lit(groups))
    part = F.when(single, part + groups).otherwise(part)
    rows = rows.withColumn("part", part)
    # a group that holds a large hub is several, by a hash of the node
    size = max(1, min(RANKED_ROWS, total // (shards * groups)))
    wide = cut(rows.groupBy("shard", "part").agg(F.ceil(F.count("*") / size).cast("int").alias("width")), "widths")
    rows = rows.join(wide, ["shard", "part"]).withColumn("sub", F.pmod(F.xxhash64("node", F.lit("sub")), F.col("width")).cast("int"))
    sizes = rows.groupBy("shard", "part", "sub").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "part", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("part", "sub")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard", "part", "sub").orderBy("hub", "node", "size", "text_crc32", "row")
    ranked = rows.join(before, ["shard", "part", "sub"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    held = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return ranked, {s: held.get(s, 0) for s in range(shards)}


def _columns(docs: DataFrame, row: Column) -> DataFrame:
    """What sharding needs of each row: row, doc_id, size, text_crc32, link (what equal texts share) and node."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "row", "doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("link"), F.coalesce("doc_id", F.xxhash64("text")).alias("node")
    )


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """documents(doc_id, text) -> doc_id, size (UTF-8 bytes + 1), text_crc32, law "rows", shard, slot, grown_shard.

    Shards' row counts are at most one apart; slots are gapless from 0 in each
    shard; documents of equal text are linked. A null text has no bytes
    (size 1, checksum 0). Rows that repeat each get a slot of their own; a
    text of any length is read once, for its size and hashes. An empty table
    gives none. grown_shard is null under this law. Other columns aren't read,
    whatever their names.
    """
    return _assigned(cut(_columns(docs, F.monotonically_increasing_id()), "sizes"), shards, rounds).drop("row")


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """The documents with all their columns, and assign()'s law, shard and slot (in place of columns of these names).

    Rows are numbered in a written copy, so that each finds its own shard and
    slot though ids and texts repeat; texts move once.
    """
    law = ["law", "shard", "slot"]
    (number,) = fresh(docs, "__row")
    held = cut(docs.drop(*law).withColumn(number, F.monotonically_increasing_id()), "rows")
    placed = _assigned(cut(_columns(held, F.col(number)), "sizes"), shards, rounds)
    return held.join(placed.select(F.col("row").alias(number), *law), number).drop(number)


def _assigned(rows: DataFrame, shards: int, rounds: int) -> DataFrame:
    """_columns() rows, written -> those of assign(), and row."""
    total = rows.count()
    links = rows.groupBy("node", F.col("link").alias("hub")).agg(F.count("*").alias("rows"))
    label = propagate(links, total, shards, rounds)
    placed = cut(rows.drop("link").join(label, "node", "left").withColumn("shard", F.coalesce("shard", start(F.col("node"), shards))), "placed")
    ranked, held = _ranked(placed, total, shards)
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    over, under = {}, []
    extra = room = 0
    for s in range(shards):
        over[s] = extra
        extra += max(0, held[s] - quota[s])
        if held[s] < quota[s]:
            under.append((s, room, room + quota[s] - held[s], held[s]))
            room += quota[s] - held[s]
    stays = F.col("rank") < _by_shard(quota, F.col("shard"), "long")
    number = F.col("rank") - _by_shard(quota, F.col("shard"), "long") + _by_shard(over, F.col("shard"), "long")
    to, slot = (reduce(lambda done, u, k=k: F.when((number >= u[1]) & (number < u[2]), F.lit(u[0]) if k == 0 else number - u[1] + u[3]).otherwise(done), under, F.lit(None)) for k in (0, 1))
    return ranked.select(
        "row",
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(stays, F.col("shard")).otherwise(to).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
