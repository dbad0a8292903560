"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Within each label, vectors go to the cell of their nearest centroid.  A vector also
visits every cell that can hold a vector linked with it: one whose bisecting plane
it is close enough to.  So no link is lost to the cells, whatever the centroids are.
Cells are compared in tiles of bounded size, and a tile reports counts and a star
for each of its components, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut
from .vectors import matrix, usable

COSINE = 0.93
CELL_ROWS = 2_048  # vectors that a cell is meant for
MOST_CELLS = 64  # of one label and length; larger cells have more tiles
MOST_GROUPS = 256  # labels and lengths with cells of their own; vectors of others share one cell each
SAMPLE = 20_000  # vectors that centroids are learned from, about
TILE = 1_024
STEPS = 10


def centroids(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit vectors: k unit centroids, fewer for fewer vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(STEPS):
        home = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def places(x: np.ndarray, c: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) of unit vectors: each in its home cell, and as a visitor in smaller-numbered cells in reach.

    A linked vector at home beyond the plane that bisects both centroids is at least
    as far away as the plane.
    """
    near = x @ c.T
    home = near.argmax(1)
    apart = np.linalg.norm(c[:, None] - c[None], axis=2)[home]
    reach = (near.max(1)[:, None] - near) <= np.sqrt(max(0.0, 1 - cosine * cosine)) * apart + 1e-9
    visit = reach & (np.arange(len(c))[None] < home[:, None])
    row, cell = np.nonzero(visit)
    return np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell]), np.concatenate([np.ones(len(x), bool), np.zeros(len(row), bool)])


def compare(ids: list[np.ndarray], sizes: list[np.ndarray], x: list[np.ndarray], same: bool, cosine: float) -> pd.DataFrame:
    """(id, links, root) of the vectors of two blocks that are linked; root: the smallest id of its component here."""
    norm = [np.linalg.norm(v, axis=1) for v in x]
    hit = (x[0] @ x[1].T) / (norm[0][:, None] * norm[1][None]) >= cosine
    if same:
        np.fill_diagonal(hit, False)
    n = len(ids[0])
    links = [hit @ sizes[1], sizes[0] @ hit]
    label = [ids[0].copy(), ids[1].copy()]
    big = np.iinfo(np.int64).max
    while True:  # labels sink to the smallest id reachable
        a = np.minimum(label[0], np.where(hit, label[1][None], big).min(1, initial=big))
        b = np.minimum(label[1], np.where(hit, a[:, None], big).min(0, initial=big))
        if same:
            a = b = np.minimum(a, b)
        if (a == label[0]).all() and (b == label[1]).all():
            break
        label = [a, b]
    parts = [(0, slice(0, n))] if same else [(0, slice(0, n)), (1, slice(0, len(ids[1])))]
    out = [pd.DataFrame({"id": ids[i], "links": links[i], "root": label[i]})[links[i] > 0] for i, _ in parts]
    return pd.concat(out)


def linked(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vector (vec_id, embedding array, label).

    Vectors of equal, not null label and equal length are linked when their cosine,
    in double precision, is at least `cosine`.  n_links: other vectors linked
    directly; component_id: the smallest vec_id reachable; kept: it is the vector's
    own.  Vectors that are null, zero or hold null or non-finite components, and
    rows without label or id, link with nothing and are kept.  Equal vectors are
    compared once.  Repeated ids are one vector in components.  Other columns are
    not looked at; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    base = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    good = usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    base = base.select("vec_id", "v", F.when(good, F.concat_ws("/", F.col("label").cast("string"), F.size("v").cast("string"))).alias("grp"), F.xxhash64("v").alias("h"), F.hash("v").alias("g"))
    classes = cut(base.where("grp is not null").groupBy("grp", "h", "g").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v")))
    large = classes.groupBy("grp").count().where(F.col("count") > CELL_ROWS).orderBy(F.desc("count"), "grp").limit(MOST_GROUPS).collect()
    total = sum(r["count"] for r in large)
    share = min(1.0, SAMPLE / max(1, total))
    sample = classes.where(F.col("grp").isin([r["grp"] for r in large])).where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)).select("grp", "id", "v").toPandas().sort_values("id")
    learned = {}
    for r in large:
        x = matrix(sample.loc[sample["grp"] == r["grp"], "v"])
        if len(x):
            learned[r["grp"]] = centroids(x / np.linalg.norm(x, axis=1, keepdims=True), min(MOST_CELLS, -(-r["count"] // CELL_ROWS)))
    held = spark.sparkContext.broadcast(learned)  # MOST_GROUPS * MOST_CELLS centroids at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (b.iloc[i : i + TILE] for b in batches for i in range(0, len(b), TILE)):
            for grp, part in b.groupby("grp"):
                c = held.value.get(grp)
                if c is None:
                    yield part.assign(cell=0, home=True)
                    continue
                x = matrix(part["v"])
                row, cell, home = places(x / np.linalg.norm(x, axis=1, keepdims=True), c, cosine)
                yield part.iloc[row].assign(cell=cell, home=home)

    placed = cut(classes.select("grp", "id", "m", "v").mapInPandas(assign, "grp string, id long, m long, v array<double>, cell int, home boolean"))
    blocks = placed.groupBy("grp", "cell").agg(*(F.greatest(F.lit(1), F.ceil(F.count_if(x) / TILE)).cast("int").alias(n) for n, x in (("homes", F.col("home")), ("guests", ~F.col("home")))), F.count_if(~F.col("home")).alias("any"))
    tiles = placed.join(blocks, ["grp", "cell"])
    own = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    tiles = tiles.withColumn("own", own)
    at_home = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda i: F.struct(F.lit("h").alias("kind"), F.least(i, F.col("own")).alias("a"), F.greatest(i, F.col("own")).alias("b"))),
        F.when(F.col("any") > 0, F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda i: F.struct(F.lit("g").alias("kind"), F.col("own").alias("a"), i.alias("b")))).otherwise(F.array().cast("array<struct<kind:string,a:int,b:int>>")),
    )
    as_guest = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda i: F.struct(F.lit("g").alias("kind"), i.alias("a"), F.col("own").alias("b")))
    tiles = tiles.withColumn("tile", F.explode(F.when(F.col("home"), at_home).otherwise(as_guest)))
    tiles = tiles.select("grp", "cell", "tile.kind", "tile.a", "tile.b", "own", "home", "id", "m", "v")

    def product(part: pd.DataFrame) -> pd.DataFrame:
        kind, a, b = part["kind"].iloc[0], part["a"].iloc[0], part["b"].iloc[0]
        sides = [part[part["home"] & (part["own"] == a)], part[(part["home"] if kind == "h" else ~part["home"]) & (part["own"] == b)]]
        sides = [s.sort_values("id") for s in sides]
        if not (len(sides[0]) and len(sides[1])):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        return compare(*([s[c].to_numpy() for s in sides] for c in ("id", "m")), [matrix(s["v"]) for s in sides], kind == "h" and a == b, cosine)

    found = cut(tiles.groupBy("grp", "cell", "kind", "a", "b").applyInPandas(product, "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    of = classes.select("grp", "h", "g", "id", "m").join(links, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    of = of.select("grp", "h", "g", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "id").alias("part"))
    out = base.select("vec_id", "grp", "h", "g").join(of, ["grp", "h", "g"], "left")
    least = F.coalesce("part", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), F.coalesce(F.col("vec_id") == least, F.lit(True)).alias("kept"))


def dedup(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One vector of each group of linked ones, that with the smallest id, with the columns of the input."""
    gone = linked(rows, cosine).where(~F.col("kept")).select(F.col("vec_id").alias("__gone")).distinct()
    return rows.join(gone, F.col("vec_id") == F.col("__gone"), "left_anti")
