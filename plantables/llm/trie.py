"""The trie of conversation prefixes, its subtrees summed along an Euler tour.

Prefixes are named by polynomial hashes of their turns, which are made in one
scan over conversations in order, and put together where a conversation goes
on in another part. A node has two arcs, in and out of its subtree; each arc
knows the next one of the tour. The tour is ranked by contraction: in each
round arcs that hash lower than both neighbours, a third of all, are taken
out, until what is left fits one task; then the rounds are gone through
backwards. Sums over a subtree are differences of prefix sums over the
tour's positions, which are cut into ranges.

Rounds are joins and sums on arc ids, each written. The driver sees counts,
and a row for each part of the ordered scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantables.llm.common import Cut

#: Conversations that share first turns: with the one whose id is a multiple of FAMILY, fewer than SHARED of them.
FAMILY, SHARED = 100, 6
#: Names of prefixes are polynomials modulo these primes, 93 bits together, in these bases.
PRIMES, BASES = (2147483647, 2147483629, 2147483587), (1103515245, 1664525, 22695477)
NAME, BEFORE = ("k1", "k2", "k3"), ("b1", "b2", "b3")
#: Children of a node are linked within so many groups, and the groups with each other, so that no group holds all children of one node.
GROUPS = 512
#: Arcs that one task ranks (32 bytes each), and positions in a range of prefix sums.
FEW, RANGE = 1 << 18, 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()


def _times(a: Column, b: Column, prime: int) -> Column:
    return F.pmod(a * b, F.lit(prime))


def _power(base: int, exponent: Column, prime: int, lowest: int, highest: int) -> Column:
    """base to a small power, negative ones too."""
    listed = F.array(*(F.lit(pow(base, i, prime)).cast("long") for i in range(lowest, highest + 1)))
    return F.element_at(listed, (exponent - lowest + 1).cast("int"))


def hashed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> rows without an id dropped, texts as hashes; text_head and the hashes order turns of one number."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.substring(role, 1, 32).alias("role_head"),
        F.substring(text, 1, 32).alias("text_head"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit("b"), role, text).alias("h2"),
        F.char_length(text).cast("long").alias("chars"),
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order -> the number of each within its part of the conversation, and polynomials of its turns so far."""
    part, key, n, sums = TaskContext.get().partitionId(), None, 0, [0, 0, 0]
    for b in batches:
        if not b.num_rows:
            continue
        conv, h1, h2 = (b.column(i).to_numpy() for i in range(3))
        starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        size = np.diff(np.append(starts, len(conv)))
        at = np.arange(len(conv)) - np.repeat(starts, size) + 1
        ongoing = conv[0] == key
        if ongoing:
            at[: size[0]] += n
        mixed = (h1.view(np.uint64), h2.view(np.uint64), h1.view(np.uint64) ^ (h2.view(np.uint64) >> np.uint64(32)))
        some, where = np.unique(at, return_inverse=True)
        names, before = [], []
        for i, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
            powers = np.array([pow(base, int(x), prime) for x in some], np.int64)[where]
            term = ((mixed[i] % np.uint64(prime - 1)).astype(np.int64) + 1) * powers % prime
            run = np.cumsum(term)  # fewer than 2**32 rows in a batch
            run -= np.repeat(run[starts] - term[starts], size)
            if ongoing:
                run[: size[0]] += sums[i]
            before.append((run - term) % prime)
            names.append(run % prime)
            sums[i] = int(names[-1][-1])
        key, n = conv[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(at), b.column(3), *map(pa.array, names + before)], ["conv_id", "part", "at", "chars", *NAME, *BEFORE])


def numbered(turns: DataFrame) -> DataFrame:
    """hashed() -> (conv_id, at, chars, k1 to k3, b1 to b3): each turn's number from 1, and the names of the turns up to it and before it.

    Rows are sorted over all parts, so a conversation of any length is spread
    over several. What its earlier parts hold is added from a table of those
    conversations that go over a part's end, at most one for each part.
    """
    order = ("conv_id", "turn", "role_head", "text_head", "h1", "h2")
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    held = Cut(ordered.select("conv_id", "h1", "h2", "chars").mapInArrow(_scan, f"conv_id long, part int, at long, chars long, {', '.join(f'{k} long' for k in NAME + BEFORE)}"), "turns")
    edges = sorted((r.part, r.low, r.high) for r in held.df.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).collect())
    spread = sorted({b for (_, _, a), (_, b, _) in zip(edges, edges[1:], strict=False) if a == b})
    if not spread:
        return held.df.drop("part")
    spark = turns.sparkSession
    ids = F.broadcast(spark.createDataFrame([(c,) for c in spread], "conv_id long"))  # fewer than the parts
    ends = held.df.join(ids, "conv_id").groupBy("conv_id", "part").agg(F.max("at").alias("n"), *(F.max_by(k, "at").alias(k) for k in NAME)).collect()
    carry, last = [], None
    for r in sorted(ends, key=lambda r: (r.conv_id, r.part)):
        if r.conv_id != last:
            last, n, sums = r.conv_id, 0, [0, 0, 0]
        powers = [pow(b, n, p) for b, p in zip(BASES, PRIMES, strict=True)]
        carry.append((r.conv_id, r.part, n, *sums, *powers))
        sums = [(s + w * r[k]) % p for s, w, k, p in zip(sums, powers, NAME, PRIMES, strict=True)]
        n += r.n
    schema = f"conv_id long, part int, before long, {', '.join(f'{x}{i} long' for x in ('s', 'w') for i in (1, 2, 3))}"
    moved = held.df.join(F.broadcast(spark.createDataFrame(carry, schema)), ["conv_id", "part"], "left")
    names = [F.coalesce(F.pmod(F.col(f"s{i}") + F.col(f"w{i}") * F.col(k), F.lit(p)), F.col(k)).alias(k) for of in (NAME, BEFORE) for i, k, p in zip((1, 2, 3), of, PRIMES, strict=True)]
    return moved.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "chars", *names)


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """numbered() -> members of nodes (conv_id, depth, names, parents' names p1 to p3, chars), and ends (conv_id, depth, names).

    Conversation c becomes the first h turns of c - c % family, h being the
    CRC-32 of c's decimal digits modulo shared, and its own turns after its
    first h.
    """
    name = F.struct(*NAME)
    first = [F.max(F.when(F.col("at") == i, F.struct(*NAME, "chars"))).alias(f"f{i}") for i in range(1, shared)]
    own = Cut(turns.groupBy("conv_id").agg(F.max("at").alias("n"), F.max_by(name, "at").alias("last"), *first), "conversations")
    base = own.df.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *(F.col(f"f{i}").alias(f"g{i}") for i in range(1, shared)))
    zero = F.struct(*(F.lit(0).cast("long").alias(k) for k in (*NAME, "chars")))

    def pick(of: str, i: Column) -> Column:
        return F.coalesce(F.element_at(F.array(zero, *(F.col(f"{of}{j}") for j in range(1, shared))), (i + 1).cast("int")), zero)

    h = (F.crc32(F.col("conv_id").cast("string")) % shared).alias("h")
    joined = own.df.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(base, "base", "left")
    joined = joined.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    info = Cut(
        joined.select("conv_id", "n", "h", "k", "last", pick("f", F.col("h")).alias("own_head"), pick("g", F.col("k")).alias("head"), F.array(zero, *(F.col(f"g{j}") for j in range(1, shared))).alias("shared")),
        "heads",
    )
    own.drop()

    def moved(of: str, i: int) -> Column:
        """The name of head, then the turns from own_head to some own name."""
        k, p, b = NAME[i], PRIMES[i], BASES[i]
        shift = _power(b, F.col("k") - F.col("h"), p, 1 - shared, 0)
        rest = F.pmod(F.col(of) - F.col(f"own_head.{k}"), F.lit(p))
        return F.pmod(F.col(f"head.{k}") + _times(rest, shift, p), F.lit(p))

    tail = turns.join(info.df.select("conv_id", "n", "h", "k", "own_head", "head"), "conv_id").filter("at > h")
    members = tail.select("conv_id", (F.col("at") - F.col("h") + F.col("k")).alias("depth"), *(moved(k, i).alias(k) for i, k in enumerate(NAME)), *(moved(b, i).alias(f"p{i + 1}") for i, b in enumerate(BEFORE)), "chars")
    taken = info.df.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "k")).alias("depth"), "shared")
    here, above = (F.element_at("shared", i.cast("int")) for i in (F.col("depth") + 1, F.greatest("depth", F.lit(1))))
    members = members.unionByName(taken.select("conv_id", "depth", *(here[k].alias(k) for k in NAME), *(above[k].alias(f"p{i + 1}") for i, k in enumerate(NAME)), here["chars"].alias("chars")))
    longer = F.col("n") > F.col("h")
    ends = info.df.select("conv_id", F.when(longer, F.col("n") - F.col("h") + F.col("k")).otherwise(F.col("k")).alias("depth"), *(F.when(longer, moved(f"last.{k}", i)).otherwise(F.col(f"head.{k}")).alias(k) for i, k in enumerate(NAME)))
    return members, ends


def ends_digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, names) -> (depth, names, ends_sha256): a running digest of the ids that end at a node, in order; one id is held at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, done = None, None, []

        def out():
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], ["depth", *NAME, "ends_sha256"])

        for b in batches:
            *keys, ids = (c.to_pylist() for c in b.columns)
            for k, i in zip(zip(*keys, strict=True), ids, strict=True):
                if k != key:
                    if now:
                        done.append((*key, now.hexdigest()))
                    key, now = k, hashlib.sha256(str(i).encode())
                else:
                    now.update(f",{i}".encode())
            if done:
                yield out()
                done = []
        if now:
            done.append((*key, now.hexdigest()))
            yield out()

    keys = ("depth", *NAME)
    ordered = ends.select(*keys, "conv_id").repartition(*keys).sortWithinPartitions(*keys, "conv_id")
    return ordered.mapInArrow(digest, f"depth long, {', '.join(f'{k} long' for k in NAME)}, ends_sha256 string")


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(id, depth, names, parents' names, conv_id) -> the tour's arcs (arc, next), children (id, n_children) and parents (id, parent_conv_id).

    Arc 2 id goes into a node's subtree and 2 id + 1 out of it. Siblings are
    linked within GROUPS groups, then group to group.
    """
    above = ["up", "p1", "p2", "p3"]
    child = nodes.filter("depth > 0").select("id", (F.col("depth") - 1).alias("up"), "p1", "p2", "p3", F.pmod(F.xxhash64("id"), F.lit(GROUPS)).alias("group"))
    group = Cut(child.groupBy(*above, "group").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")), "groups")
    of = Window.partitionBy(*above).orderBy("group")
    parent = nodes.select(F.col("depth").alias("up"), *(F.col(k).alias(f"p{i + 1}") for i, k in enumerate(NAME)), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = Cut(group.df.withColumn("next_first", F.lead("first").over(of)).withColumn("opens", F.lag("first").over(of).isNull()).join(parent, above), "families")
    group.drop()
    beside = child.select("id", F.lead("id").over(Window.partitionBy(*above, "group").orderBy("id")).alias("sibling")).filter("sibling is not null")
    children = linked.df.groupBy("parent").agg(F.sum("n").alias("n_children")).withColumnRenamed("parent", "id")
    arcs = (
        linked.df.filter("opens").selectExpr("2 * parent as arc", "2 * first as next")
        .unionByName(linked.df.selectExpr("2 * last + 1 as arc", "coalesce(2 * next_first, 2 * parent + 1) as next"))
        .unionByName(beside.selectExpr("2 * id + 1 as arc", "2 * sibling as next"))
        .unionByName(nodes.join(children, "id", "left_anti").selectExpr("2 * id as arc", "2 * id + 1 as next"))
    )
    parents = child.join(linked.df.select(*above, "group", "parent_conv_id"), [*above, "group"]).select("id", "parent_conv_id")
    return arcs, children, parents


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All arcs left, in one task -> their positions, by doubling jumps towards the start."""
    table = pa.Table.from_batches(batches, pa.schema([("arc", pa.int64()), ("prev", pa.int64()), ("back", pa.int64())]))
    arc, prev, back = (table.column(i).fill_null(-1).to_numpy() for i in range(3))
    if not len(arc):
        return
    order = np.argsort(arc)
    arc, prev, back = arc[order], prev[order], back[order]
    to, far = np.searchsorted(arc, prev), np.where(prev < 0, 0, back)
    to[prev < 0] = np.flatnonzero(prev < 0)
    while (to != to[to]).any():
        far, to = far + far[to], to[to]
    yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(far)], ["arc", "pos"])


def ranked(arcs: DataFrame) -> DataFrame:
    """(arc, next) of one list -> (arc, pos): positions from 0, for the last arc too."""
    spark = arcs.sparkSession
    none = F.lit(None).cast("long")
    both = arcs.select("arc", "next", none.alias("prev"), none.alias("back")).unionByName(arcs.select(F.col("next").alias("arc"), none.alias("next"), F.col("arc").alias("prev"), F.lit(1).cast("long").alias("back")))
    now = Cut(both.groupBy("arc").agg(F.max("next").alias("next"), F.max("prev").alias("prev"), F.max("back").alias("back")), "arcs")
    rounds: list[tuple[Cut, Column]] = []
    while now.df.count() > FEW:
        salt = F.lit(len(rounds))
        mine, ahead, behind = (F.xxhash64(salt, c) for c in ("arc", "next", "prev"))
        out = F.col("next").isNotNull() & F.col("prev").isNotNull() & (mine < ahead) & (mine < behind)
        gone, stay = now.df.filter(out), now.df.filter(~out)
        told = stay.select("arc", "next", "prev", "back", none.alias("new_next"), none.alias("new_prev"))
        told = told.unionByName(gone.select(F.col("prev").alias("arc"), none.alias("next"), none.alias("prev"), none.alias("back"), F.col("next").alias("new_next"), none.alias("new_prev")))
        told = told.unionByName(gone.select(F.col("next").alias("arc"), none.alias("next"), none.alias("prev"), "back", none.alias("new_next"), F.col("prev").alias("new_prev")))
        after = told.groupBy("arc").agg(
            F.coalesce(F.max("new_next"), F.max("next")).alias("next"),
            F.coalesce(F.max("new_prev"), F.max("prev")).alias("prev"),
            F.sum("back").alias("back"),
        )
        rounds.append((now, out))
        now = Cut(after, "arcs")
    # at most FEW rows
    found = [Cut(now.df.select("arc", "prev", "back").coalesce(1).mapInArrow(_walk, "arc long, pos long"), "positions")]
    now.drop()
    for held, out in reversed(rounds):
        known = spark.read.schema("arc long, pos long").parquet(*(x.path for x in found))
        gone = held.df.filter(out).select("arc", F.col("prev").alias("to"), "back")
        found.append(Cut(gone.join(known.withColumnRenamed("arc", "to"), "to").select("arc", (F.col("pos") + F.col("back")).alias("pos")), "positions"))
        held.drop()
    return spark.read.schema("arc long, pos long").parquet(*(x.path for x in found))


def subtree_sums(positions: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """ranked(), and (id, names...) -> (id, names...): sums over each node's subtree, from prefix sums at its two arcs."""
    entered = positions.select(F.shiftright("arc", 1).alias("id"), "pos", (F.col("arc") % 2 == 0).alias("enters"))
    put = entered.join(values, "id").select("id", "pos", "enters", F.floor(F.col("pos") / RANGE).alias("range"), *(F.when(F.col("enters"), F.col(n)).otherwise(0).alias(n) for n in names))
    held = Cut(put, "tour")
    each = held.df.groupBy("range").agg(*(F.sum(n).alias(n) for n in names))
    # a row for each RANGE positions
    before = each.select("range", *(F.coalesce(F.sum(n).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{n}") for n in names))
    within = Window.partitionBy("range").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = held.df.select("id", "enters", "range", *(F.sum(n).over(within).alias(f"to_{n}") for n in names), *names).join(before, "range")
    return run.groupBy("id").agg(*(F.sum(F.when(F.col("enters"), F.col(n) - F.col(f"to_{n}") - F.col(f"_{n}")).otherwise(F.col(f"to_{n}") + F.col(f"_{n}"))).alias(n) for n in names))


def trie(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> (node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    Turns are ordered by number, null first, then by role, the first
    characters of the text, and a hash. Rows without a conversation's id take
    no part; null roles and texts are empty; other columns are ignored; no
    rows give no nodes.
    """
    members, ends = rebuilt(numbered(hashed(turns)), family, shared)
    above = ["p1", "p2", "p3"]
    made = members.groupBy("depth", *NAME).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.max(p).alias(p) for p in above), F.max("chars").alias("chars"))
    nodes = Cut(made.withColumn("id", F.monotonically_increasing_id()), "nodes")
    arcs, children, parents = tour(nodes.df)
    known = Cut(nodes.df.join(children, "id", "left").join(parents, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "known")
    values = known.df.select("id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = subtree_sums(ranked(arcs), values, ["n_leaves", "saved_tokens"])
    return (
        known.df.join(sums, "id")
        .join(ends_digest(ends), ["depth", *NAME], "left")
        .select(F.col("id").alias("node"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    )
