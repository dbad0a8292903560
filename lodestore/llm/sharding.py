"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Rows hash to points on a ring; the arc that ends in a virtual node belongs to
that node's shard.  Every shard may hold so many rows and no more; what overflows
continues clockwise to the next node whose shard has room.  Row counts per arc
decide all of that, so the plan is made from a fixed number of counts, however large
the table, and rows find their shard by their rank within their arc.  An arc is cut
into ranges that are ranked apart, and a range with very many rows, as where rows
repeat, once more by the tasks that read them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, cut, replace

SHARDS, NODES = 24, 128
RANGES = 1 << 14  # of the ring, besides its arcs
CROWDED = 1_000_000  # rows of a range that are ranked in one task at most


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, in order; positions are below 2**52."""
    points = ((int(md5(f"{s}/{v}".encode()).hexdigest()[:13], 16), s) for s in range(shards) for v in range(nodes))
    return sorted(points)


def position(doc_id: Column, text: Column) -> Column:
    """Where on the ring a row stands; rows without an id stand by their text."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")


def arc_of(at: Column, points: Sequence[int]) -> Column:
    """Index of the first node at or after a position; past the last node, 0 again.

    The ring is cut into equal cells.  A cell knows its first arc and the few nodes
    inside it, so a row compares itself with those few only.
    """
    cells = 1 << max(1, (4 * len(points)).bit_length())
    width = (1 << 52) // cells
    first = [bisect_right(points, c * width - 1) for c in range(cells)]
    inside = [[p for p in points[a:b]] for a, b in zip(first, [*first[1:], len(points)], strict=True)]
    cell = F.floor(at / F.lit(width)).cast("int")
    base = F.element_at(F.from_json(F.lit(str(first)), "array<int>"), cell + 1)
    nodes = F.element_at(F.from_json(F.lit(str(inside)), "array<array<bigint>>"), cell + 1)
    return ((base + F.size(F.filter(nodes, lambda p: p < at))) % len(points)).cast("int")


def flow(counts: dict[int, int], owners: Sequence[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, ranks end, shard, first slot) for all rows of all arcs.

    Shards hold the mean rounded up, or down, so that all together hold every row:
    counts differ by one at most.  Rows stay with their arc's shard while it has
    room; the rest go on clockwise, arc by arc.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot = [0] * shards
    pieces, spilled = [], []

    def put(arc: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard] - slot[shard])
        if n > 0:
            pieces.append((arc, lo, lo + n, shard, slot[shard]))
            slot[shard] += n
        return lo + max(0, n)

    for arc in sorted(counts):
        if (lo := put(arc, 0, counts[arc], owners[arc])) < counts[arc]:
            spilled.append((arc, lo))
    for arc, lo in spilled:
        node = arc
        while lo < counts[arc]:
            node = (node + 1) % len(owners)
            lo = put(arc, lo, counts[arc], owners[node])
    return pieces


@aside
def shard(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, crowded: int = CROWDED) -> DataFrame:
    """Adds size long, text_crc32 long, law string, shard int, slot long and grown_shard int to documents (doc_id, text, ...).

    size: UTF-8 bytes of the text plus 8.  law: 'rows', counts of shards differ by
    one at most.  slot: place in the shard, gapless from 0.  grown_shard: null under
    this law.  Null text has size 8 and the checksum of empty text; rows without an
    id stand by their text; repeated rows stand together and get slots of their own.
    A range of the ring with more than `crowded` rows is ranked by task and then by
    place; which of its rows overflow may then differ from run to run.
    Input columns with an output's name give way.  Fewer rows than shards leave
    shards empty; an empty table stays empty.
    """
    points = [p for p, _ in ring(shards, nodes)]
    owners = [s for _, s in ring(shards, nodes)]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    at = position(F.col("doc_id"), F.col("text"))
    where = {"__arc": arc_of(F.col("__at"), points), "__range": F.floor(F.col("__at") / F.lit((1 << 52) // RANGES)).cast("int")}
    # as many rows as the ring has nodes and ranges; only ids are read here, and texts where ids are null
    counts = docs.select(at.alias("__at")).select(*(c.alias(n) for n, c in where.items())).groupBy("__arc", "__range").count().collect()
    sizes: dict[int, int] = {}
    starts = []
    for r in sorted(counts, key=lambda r: (r["__arc"], r["__range"])):
        arc = r["__arc"]
        starts.append((arc, r["__range"], sizes.get(arc, 0), int(r["count"] > crowded)))
        sizes[arc] = sizes.get(arc, 0) + r["count"]
    out = replace(docs, size=(F.octet_length(text) + 8).cast("long"), text_crc32=F.crc32(text)).withColumn("__at", at).withColumns(where)
    out = out.join(F.broadcast(_listed(docs, starts, ("__arc", "__range", "__start", "__crowded"))), ["__arc", "__range"])
    order = ["__at", F.col("doc_id").cast("string"), "text_crc32", "size"]
    rank = F.row_number().over(Window.partitionBy("__arc", "__range").orderBy(*order)) - 1 + F.col("__start")
    ranked = out.where("__crowded = 0").withColumn("__rank", rank)
    if any(x[3] for x in starts):
        # written, a row keeps the number of its task
        held = cut(out.where("__crowded = 1").withColumn("__task", F.spark_partition_id()))
        tasks = held.groupBy("__arc", "__range", "__task").count()
        before = F.sum("count").over(Window.partitionBy("__arc", "__range").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
        tasks = tasks.select("__arc", "__range", "__task", F.coalesce(before, F.lit(0)).alias("__more"))
        inside = F.row_number().over(Window.partitionBy("__arc", "__range", "__task").orderBy(*order)) - 1
        held = held.withColumn("__inside", inside).join(tasks, ["__arc", "__range", "__task"])
        ranked = ranked.unionByName(held.withColumn("__rank", F.col("__start") + F.col("__more") + F.col("__inside")).select(*(f"`{c}`" for c in ranked.columns)))
    plan = _listed(docs, flow(sizes, owners, shards), ("__arc", "__lo", "__hi", "__shard", "__slot"))
    out = ranked.join(F.broadcast(plan), "__arc").where("__rank >= __lo and __rank < __hi")  # nodes + shards rows at most
    out = replace(out, law=F.lit("rows"), shard=F.col("__shard").cast("int"), slot=F.col("__slot") + F.col("__rank") - F.col("__lo"), grown_shard=F.lit(None).cast("int"))
    return out.drop("__at", "__arc", "__range", "__start", "__crowded", "__lo", "__hi", "__shard", "__slot", "__rank")


def _listed(df: DataFrame, rows: Sequence[tuple[int, ...]], names: Sequence[str]) -> DataFrame:
    """A few rows of numbers as a table."""
    each = F.from_json(F.lit(str([list(r) for r in rows])), "array<array<bigint>>")
    return df.sparkSession.range(1).select(F.explode(each).alias("r")).select(*(F.col("r")[i].alias(n) for i, n in enumerate(names)))
