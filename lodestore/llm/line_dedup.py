"""Cross-site line dedup by distinct-site spread.

Each line hash gathers a HyperLogLog sketch of the sites (sources) it occurs on;
sketches merge by aggregation.  Lines whose estimate lies near the threshold get
an exact distinct count, so the decision is that of exact counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, aside, cut, replace

MIN_SITES = 5
SKETCH_BITS = 10  # 3 % standard error
MOST_SHARE = 0.5  # of the words of a document known to have copies
BLANK = r"^[\x20\x09-\x0D]*$"


def _row_key() -> list[Column]:
    """What tells rows apart: id and text.  Rows equal in both are treated alike."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__x"), F.hash(text).alias("__y")]


def _lines(docs: DataFrame) -> DataFrame:
    """(h, g, site, __id, __x, __y, pos, n): a row for each line that isn't blank."""
    site = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("site")
    each = docs.select(*_row_key(), site, F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("pos", "line"))
    each = each.where(~F.col("line").rlike(BLANK))
    return each.select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "site", "__id", "__x", "__y", "pos", F.regexp_count("line", F.lit(WORD)).alias("n"))


def spread(lines: DataFrame, min_sites: int, bits: int = SKETCH_BITS) -> DataFrame:
    """Line hashes (h, g) on at least min_sites sites, with the first place (__id, __x, __y, pos) as first."""
    # nulls sort first in structs, so the flag keeps rows without an id last
    place = F.struct(F.col("__id").isNull().alias("none"), "__id", "__x", "__y", "pos")
    many = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", bits).alias("sketch"), F.min(place).alias("first"))
    many = many.withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch")
    many = cut(many.where(F.col("sites") * 2 >= min_sites))
    near = many.where(F.col("sites") < 2 * min_sites).select("h", "g")
    exact = lines.select("h", "g", "site").join(near, ["h", "g"]).distinct().groupBy("h", "g").agg(F.count("*").alias("exact"))
    sure = many.where(F.col("sites") >= 2 * min_sites)
    return sure.select("h", "g", "first").unionAll(many.join(exact.where(F.col("exact") >= min_sites), ["h", "g"]).select("h", "g", "first"))


def _without(lines: Column, gone: Column) -> Column:
    """The lines whose places aren't among those gone: what lies between two places that follow each other."""
    marks = F.concat(F.array(F.lit(-1)), F.array_sort(gone), F.array(F.size(lines)))
    spans = F.zip_with(F.slice(marks, 1, F.size(marks) - 1), F.slice(marks, 2, F.size(marks) - 1), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.flatten(spans)


@aside
def dedup(docs: DataFrame, min_sites: int = MIN_SITES, copies: DataFrame | None = None, most_share: float = MOST_SHARE) -> DataFrame:
    """Documents (doc_id, text, source, ...) without boilerplate lines; adds n_lines int and n_removed int, sets n_chars if there.

    A line that occurs on min_sites sites or more stays only where it stands first
    (smallest doc_id, then place).  Lines are compared byte for byte; blank lines
    stay.  Where copies (doc_id) are given, those among them of whose words more than
    most_share would go stay whole, for document-level dedup to judge; without
    copies, no document does.  All rows stay; null and empty texts stay as they are
    (n_lines 0).  A null source is a site of its own.  Rows equal in doc_id and text
    are treated alike.  An empty table stays empty; input columns with an output's
    name give way.
    """
    lines = cut(_lines(docs))
    common = spread(lines, min_sites)
    # common lines are few; where they are not, Spark's skew join splits the hot ones
    hits = lines.join(common, ["h", "g"])
    first = F.col("first.__id").eqNullSafe(F.col("__id")) & (F.col("first.__x") == F.col("__x")) & (F.col("first.__y") == F.col("__y")) & (F.col("first.pos") == F.col("pos"))
    gone = hits.where(~first).groupBy("__id", "__x", "__y").agg(F.collect_list("pos").alias("__gone"), F.sum("n").alias("__n"))
    gone = gone.select(F.col("__id").alias("__i"), F.col("__x").alias("__u"), F.col("__y").alias("__v"), "__gone", "__n")
    rows = docs.withColumns(dict(zip(("__id", "__x", "__y"), _row_key(), strict=True)))
    out = rows.join(gone, rows["__id"].eqNullSafe(F.col("__i")) & (F.col("__x") == F.col("__u")) & (F.col("__y") == F.col("__v")), "left")
    cutting = F.col("__gone").isNotNull()
    if copies is not None:
        known = copies.select(F.col("doc_id").alias("__c")).distinct()
        out = out.join(known, F.col("doc_id") == F.col("__c"), "left")
        cutting = cutting & (F.col("__c").isNull() | (F.col("__n") <= F.regexp_count("text", F.lit(WORD)) * most_share))
    split = F.split(F.col("text"), "\n", -1)
    text = F.when(cutting, F.array_join(_without(split, F.col("__gone")), "\n")).otherwise(F.col("text"))
    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.size(split)).otherwise(0)
    values = {"n_lines": n_lines, "n_removed": F.when(cutting, F.size("__gone")).otherwise(0)}
    out = replace(out, **values, __text=text).drop("__id", "__x", "__y", "__i", "__u", "__v", "__gone", "__n", "__c")
    out = out.withColumn("text", F.col("__text")).drop("__text")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
