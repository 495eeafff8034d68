"""Colour groups, legends and the relational steps of k-means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import exprs


def line_groups(segments: DataFrame) -> DataFrame:
    """image_id, key, segments, first_ord: segments of the same quantised colour and style, by first appearance."""
    key = exprs.quantised_key(F.col("r"), F.col("g"), F.col("b"), F.col("is_dashed"))
    return segments.groupBy("image_id", key.alias("key")).agg(F.count(F.lit(1)).alias("segments"), F.min("ord").alias("first_ord"))


def legend(clusters: DataFrame) -> DataFrame:
    """clusters with a name each; the second and later ones of a name get _1, _2, ..."""
    named = clusters.withColumn("base", exprs.rgb_name(F.col("r"), F.col("g"), F.col("b")))
    before = F.row_number().over(Window.partitionBy("image_id", "base").orderBy("ord")) - 1
    label = F.when(F.col("before") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("before").cast("string")))
    return named.withColumn("before", before).withColumn("label", label).drop("base", "before")


def with_rgb(entries: DataFrame, clusters: DataFrame) -> DataFrame:
    """Legend entries (image_id, ord, label) with their cluster's colour; black where there is no such cluster."""
    colours = clusters.select("image_id", "ord", "r", "g", "b")
    return entries.select("image_id", "ord", "label").join(colours, ["image_id", "ord"], "left").fillna(0, ["r", "g", "b"])


def by_count(found: DataFrame) -> DataFrame:
    """found (image_id, ord, count, ...) with ``place``: the most frequent cluster first, the earlier one of equals."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("count"), "ord")) - 1)


def coloured(lines: DataFrame) -> DataFrame:
    """Lines that have a colour: ``color_rgb``, or else ``color`` (structs); black is one."""
    return lines.withColumn("rgb", F.coalesce("color_rgb", "color")).where("rgb is not null")


def nearest(entries: list[tuple[str, int, int, int]], r: Column, g: Column, b: Column) -> Column:
    """The label of the nearest entry of a legend, the first on a tie; null for an empty legend."""
    if not entries:
        return F.lit(None).cast("string")
    sq = lambda c, v: (c - v) * (c - v)
    return F.array_min(F.array(*[F.struct((sq(r, x) + sq(g, y) + sq(b, z)).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("label")) for k, (name, x, y, z) in enumerate(entries)]))["label"]


def shares(labelled: DataFrame, clusters: list[str] | None = None) -> DataFrame:
    """image_id, label, count, percentage of each label of an image's colours; listed clusters appear even where empty."""
    counts = labelled.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("count"))
    if clusters:
        every = counts.select("image_id").distinct().select("image_id", F.explode(F.array(*map(F.lit, clusters))).alias("label"))
        counts = every.join(counts, ["image_id", "label"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy("image_id"))
    return counts.withColumn("percentage", F.bround(100.0 * F.col("count") / total, 2))


def exact_centres(labelled: DataFrame) -> DataFrame:
    """Each cluster's centre, cut to integers, and how many colours of the image equal it exactly."""
    centre = lambda c: F.floor(F.avg(c)).cast("long").alias(c)
    centres = labelled.groupBy("image_id", "label").agg(centre("r"), centre("g"), centre("b"))
    same = labelled.groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    totals = labelled.groupBy("image_id").agg(F.count(F.lit(1)).alias("total"))
    found = centres.join(same, ["image_id", "r", "g", "b"], "left").join(totals, "image_id").withColumn("count", F.coalesce("n", F.lit(0)))
    return found.select("image_id", "label", "r", "g", "b", "count", F.bround(100.0 * F.col("count") / F.col("total"), 2).alias("percentage"))


def squared_distance(point: Column, centre: Column) -> Column:
    """The sum of squared differences over values that both have; null if there is none."""
    return F.aggregate(F.zip_with(point, centre, lambda a, b: (a - b) * (a - b)), F.lit(None).cast("long"), lambda s, x: F.coalesce(s + x, s, x))


def assigned(points: DataFrame, centres: list[list[int] | None]) -> DataFrame:
    """points with the number of the nearest of k centres (the first on a tie) and the squared distance. A centre without a distance comes after all others."""
    d = [squared_distance(F.col("v"), F.array(*[F.lit(x).cast("long") for x in c]) if c is not None else F.lit(None).cast("array<long>")) for c in centres]
    each = [F.struct(x.isNull().alias("far"), x.alias("d"), F.lit(k).cast("long").alias("k")) for k, x in enumerate(d)]
    best = F.array_min(F.array(*each)) if each else F.lit(None).cast("struct<far:boolean,d:bigint,k:bigint>")
    return points.withColumn("best", best).withColumn("cluster", F.col("best.k")).withColumn("d2", F.col("best.d")).drop("best")


def elbow(inertias: DataFrame, ratio: float = 0.8) -> DataFrame:
    """image_id, k: the last k before the inertia falls by too little; no inertia before counts as no fall."""
    w = Window.partitionBy("image_id").orderBy("k")
    before = F.lag("inertia").over(w)
    step = inertias.withColumn("stops", F.when(before.isNotNull(), F.when(before == 0, True).otherwise(F.col("inertia") / before > ratio)).otherwise(False))
    return step.groupBy("image_id").agg(F.coalesce(F.min(F.when(F.col("stops"), F.col("k"))) - 1, F.max("k")).alias("k"))


def best_run(runs: DataFrame) -> DataFrame:
    """image_id, run: the run of least inertia, the first of equals."""
    return runs.groupBy("image_id").agg(F.min(F.struct("inertia", "run")).alias("m")).select("image_id", F.col("m.run").alias("run"), F.col("m.inertia").alias("inertia"))
