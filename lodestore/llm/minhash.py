"""MinHash near-dedup by a signature-coordinate inverted join.

Texts with equal word sequences are one class.  Each class posts itself under its
(coordinate, value) pairs.  Two classes are candidates when they collide in MATCHES
coordinates, so

* a value that no other class has is dropped, and a class with fewer shared values
  than MATCHES is skipped;
* collisions are first counted with leaders, the most central members of lists, a
  few for each class; that gathers most candidates in groups by linear work;
* of a class's shared values only the rarest, all but MATCHES - 1, are merged: two
  classes with MATCHES collisions meet under one of them (prefix).  Lists whose
  members are in one group already are skipped.

Links are confirmed on full shingle sets: each class with its leader first, and then,
in groups that aren't in one component yet, all classes in tiles of bounded size.
Tiles report stars of their components, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import aside, components, cut, drop, grouped, sliced, small_batches

WORDS, PERCENT = 5, 80
COORDINATES, MATCHES = 64, 38  # at similarity 0.8 fewer collisions have a chance of about 4e-5
LEADERS = 4  # of a class, that its collisions are counted with first
SHORT = 48  # members of a list whose pairs are simply joined
TILE = 256  # members of a longer list, or of a group, that are compared at once
COLUMNS = 8_192  # shingles that are multiplied at once


def _hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = textnp.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(texts: pa.Array, width: int, coordinates: int = COORDINATES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, both hashes of the word sequence, and the signature (uint32, a row for each text; 0 without words)."""
    data, at = textnp.raw(texts)
    begin, end, first = textnp.spans(data, at)
    hashes = textnp.word_hashes(data, begin, end)
    grams, where = textnp.shingles(hashes, first, width)
    one, two = textnp.sequence_hashes(hashes, first)
    sizes = np.array([len(np.unique(grams[a:b])) for a, b in zip(where[:-1], where[1:], strict=True)], np.int64)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), coordinates), np.uint32)
    if len(full):
        for k, (a, b) in enumerate(zip(*_hashers(coordinates), strict=True)):
            out[full, k] = np.minimum.reduceat(((grams * a + b) >> np.uint64(32)).astype(np.uint32), where[:-1][full])
    return sizes, one, two, out


def _text_hashes() -> list[Column]:
    """Hashes x and y of the text; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("x"), F.hash(text).alias("y")]


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, one, two, keys array<long>, x, y), a row for each document; keys: its coordinate-value pairs; x, y: hashes of its text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(COORDINATES, dtype=np.int64) << 32
        for b in sliced(batches, "text"):
            sizes, one, two, found = signatures(b.column("text"), width)
            keys = (base + found.astype(np.int64))[sizes > 0]
            at = np.concatenate([[0], np.cumsum((sizes > 0) * COORDINATES)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists, b.column("x"), b.column("y")], ["doc_id", "n_shingles", "one", "two", "keys", "x", "y"])

    return docs.select(F.col("doc_id").cast("long"), "text", *_text_hashes()).mapInArrow(sign, "doc_id long, n_shingles long, one long, two long, keys array<long>, x long, y int")


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    data, at = textnp.raw(texts)
    begin, end, first = textnp.spans(data, at)
    grams, where = textnp.shingles(textnp.word_hashes(data, begin, end), first, width)
    return [np.unique(grams[a:b]) for a, b in zip(where[:-1], where[1:], strict=True)]


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (src, dst) of document ids whose full shingle sets are similar enough."""
    pairs = cut(pairs)
    wanted = pairs.select(F.col("src").alias("id")).unionAll(pairs.select(F.col("dst").alias("id"))).distinct()
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "a"):
            a, c = _sets(b.column("a"), width), _sets(b.column("b"), width)
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, c, strict=True)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(a, c, strict=True)], np.int64) - common
            yield b.select(["src", "dst"]).filter(pa.array((100 * common >= percent * union) & (common > 0)))

    left, right = (texts.select(F.col("id").alias(k), F.col("text").alias(t)) for k, t in (("src", "a"), ("dst", "b")))
    return pairs.join(left, "src").join(right, "dst").select("src", "dst", "a", "b").mapInArrow(test, "src long, dst long")


def _stars(ids: np.ndarray, hit: np.ndarray) -> pa.Table:
    """(src, dst): each id whose component, under a symmetric matrix of hits, has a smaller one, with the smallest."""
    label = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        low = np.minimum(label, np.where(hit, label[None], big).min(1, initial=big))
        if (low == label).all():
            break
        label = low
    on = label < ids
    return pa.table({"src": ids[on], "dst": label[on]})


def _gathered(live: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, m, id, part) of prefix postings in lists whose members aren't all in one group."""
    placed = live.select("id", F.slice("shared", 1, F.size("shared") - MATCHES + 1).alias("prefix")).join(parts, F.col("id") == F.col("node"), "left")
    posts = placed.select("id", F.coalesce("component", "id").alias("part"), F.explode("prefix.key").alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("m"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key", "m")
    return cut(posts.join(lists, "key"))


def _collided(live: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (src, dst) of classes that collide in MATCHES coordinates."""
    left, right = (live.select(F.col("id").alias(c), F.col("shared.key").alias(k)) for c, k in (("src", "a"), ("dst", "b")))
    return pairs.join(left, "src").join(right, "dst").where(F.size(F.array_intersect("a", "b")) >= MATCHES).select("src", "dst")


def _short(live: DataFrame, posts: DataFrame) -> DataFrame:
    """Candidates (src, dst) of different groups that meet in a short list."""
    few = posts.where(F.col("m") <= SHORT)
    other = few.select("key", F.col("id").alias("dst"), F.col("part").alias("of"))
    return _collided(live, few.select("key", F.col("id").alias("src"), "part").join(other, "key").where("src < dst and part <> of").select("src", "dst").distinct())


def _long(live: DataFrame, posts: DataFrame) -> DataFrame:
    """Stars (src, dst) of the candidates that meet in a long list, tile by tile."""
    posts = posts.where(F.col("m") > SHORT).withColumn("blocks", F.ceil(F.col("m") / TILE).cast("int"))
    posts = posts.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posts = posts.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id")
    posts = posts.join(live.select("id", F.col("shared.key").alias("keys")), "id")

    def merge(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        lists = t["keys"].combine_chunks()
        row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        keys = lists.flatten().to_numpy()
        grid = np.full((len(ids), COORDINATES), -1, np.int64)
        grid[row, keys >> 32] = keys
        hit = np.array([np.count_nonzero((grid == g) & (g >= 0), axis=1) >= MATCHES for g in grid])
        return _stars(ids, hit)

    return grouped(posts, ["key", "lo", "hi"], merge, "src long, dst long")


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of several sets of shingles are similar enough, as a symmetric matrix."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, column, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    twice = count[column] > 1
    row, column = row[twice], np.unique(column[twice], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.int64)
    for lo in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        common += np.rint(part @ part.T).astype(np.int64)
    return (100 * common >= percent * (sizes[:, None] + sizes[None] - common)) & (common > 0)


def _confirmed(groups: DataFrame, parts: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Stars (src, dst) of links between classes (node, component) of candidate groups that are in different components (parts) so far."""
    joined = groups.join(parts.select(F.col("node").alias("id"), F.col("component").alias("part")), F.col("node") == F.col("id"), "left")
    joined = joined.select(F.col("component").alias("grp"), F.col("node").alias("id"), F.coalesce("part", "node").alias("part"))
    # these are written, so that Spark knows how large they are: small, they are broadcast; large, large groups are split
    sizes = joined.groupBy("grp", "part").agg(F.count("*").alias("of_part"))
    open_ = cut(sizes.groupBy("grp").agg(F.count("*").alias("parts")).where("parts > 1").select("grp"))
    sizes = cut(sizes.join(open_, "grp"))
    rest = sizes.where(F.col("of_part") < TILE).groupBy("grp").agg(F.sum("of_part").alias("rest"))
    rest = cut(rest)
    members = joined.join(sizes, ["grp", "part"]).join(rest, "grp", "left")
    # a component as large as a tile has blocks of its own, which needn't meet one another; the others share blocks
    own = F.col("of_part") >= TILE
    blocks = F.ceil(F.when(own, F.col("of_part")).otherwise(F.col("rest")) / TILE)
    members = cut(members.select("grp", "id", F.struct(F.when(own, F.col("part")).otherwise(F.lit(-1)).alias("part"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("no")).alias("block")))
    others = cut(members.select("grp", F.col("block").alias("other")).distinct())
    tiles = members.join(others, "grp").where("block.part = -1 or block = other or block.part <> other.part")
    tiles = tiles.where("block.part = -1 or block <> other").select("grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id")
    tiles = tiles.select("grp", F.col("lo.part").alias("lp"), F.col("lo.no").alias("ln"), F.col("hi.part").alias("hp"), F.col("hi.no").alias("hn"), "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(members.select("id"), "id", "left_semi")

    def test(t: pa.Table) -> pa.Table:
        return _stars(t["id"].to_numpy(), similar(_sets(t["text"], width), percent))

    return grouped(tiles.join(cut(texts), "id"), ["grp", "lp", "ln", "hp", "hn"], test, "src long, dst long")


def _as_edges(parts: DataFrame) -> DataFrame:
    """Components so far, as edges that join the same nodes."""
    return parts.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))


def linked(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each document (doc_id, text, ...).

    Documents are linked when their sets of shingles, of so many words each, A-Z as
    a-z, share percent or more of their union.  component_id: the smallest doc_id
    reachable by links; kept: it is the document's own.  A text with fewer words is
    one shingle; null texts and texts without words have none and link with nothing.
    Rows without an id link with nothing, have no component and are kept.  Repeated
    ids are one document with several texts.  Other columns are not looked at; an
    empty table gives an empty result.
    """
    return _linked(docs, width, percent).drop("x", "y")


def _linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of linked(), and hashes x and y of their texts."""
    with small_batches(docs.sparkSession):
        rows = cut(signed(docs, width))
    known = rows.where("n_shingles > 0 and doc_id is not null")
    classes = cut(known.groupBy("one", "two").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")))
    posts = classes.select("id", F.explode("keys").alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = posts.join(lists, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("shared"))
    live = cut(live.where(F.size("shared") >= MATCHES))

    # a list's leader: who shares the most with the most
    weight = F.aggregate("shared", F.lit(0.0), lambda a, x: a + F.log(x["n"].cast("double")))
    listed = live.select("id", weight.alias("weight"), F.explode("shared.key").alias("key"))
    leaders = listed.groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("leader"))
    met = listed.join(leaders, "key").where("leader <> id").groupBy("id", "leader").agg(F.count("*").alias("n"))
    best = met.groupBy("id").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("n", -F.col("leader"))))), 1, LEADERS).alias("best"))
    best = cut(best.select(F.col("id").alias("src"), F.posexplode(F.transform("best", lambda b: -b["col2"])).alias("pos", "dst")))
    close = cut(_collided(live, best.select("src", "dst")))
    groups = components(close)
    posts = _gathered(live, groups)
    groups = components(_as_edges(groups).unionAll(_short(live, posts)).unionAll(_long(live, posts)))
    drop(posts)

    first = confirm(best.where("pos = 0").select("src", "dst").join(close, ["src", "dst"], "left_semi"), docs, width, percent)
    with small_batches(docs.sparkSession):
        edges = cut(first)
    parts = components(edges)
    parts = components(_as_edges(parts).unionAll(_confirmed(groups, parts, docs, width, percent)))
    placed = rows.join(classes.select("one", "two", F.col("id").alias("__class")), ["one", "two"], "left").join(parts, F.col("__class") == F.col("node"), "left")
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.when(F.col("n_shingles") > 0, F.col("__class")), "doc_id"))
    return placed.select("doc_id", "n_shingles", least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"), "x", "y")


@aside
def dedup(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the one whose id is its component's, with the columns of the input.

    Of a repeated id only the texts that linked() doesn't keep go.
    """
    gone = _linked(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("x").alias("__x"), F.col("y").alias("__y")).distinct()
    x, y = _text_hashes()
    return docs.join(gone, (F.col("doc_id") == F.col("__gone")) & (x == F.col("__x")) & (y == F.col("__y")), "left_anti")
