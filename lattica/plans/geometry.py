"""Queries over segments, boxes, tiles and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import exprs
from lattica.operators import graph, tiling
from lattica.plans.registry import query
from lattica.sources.adapters import ctes, view


@query(ctes("v_segments") + """ select image_id, ord, round_even(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)), 2) as length, round_even(degrees(atan2(abs(y2-y1), abs(x2-x1))), 2) as angle from v_segments""")
def segment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return view(spark, sf_dir, "v_segments").select("image_id", "ord", exprs.segment_length(*at).alias("length"), exprs.segment_angle(*at).alias("angle"))


_EDGES = """e as (select distinct l.image_id, l.ord as a, r.ord as b from v_segments l join v_segments r on l.image_id = r.image_id and l.ord < r.ord
    where least(pow(l.x1-r.x1,2)+pow(l.y1-r.y1,2), pow(l.x1-r.x2,2)+pow(l.y1-r.y2,2), pow(l.x2-r.x1,2)+pow(l.y2-r.y1,2), pow(l.x2-r.x2,2)+pow(l.y2-r.y2,2)) < 225)"""


@query(ctes("v_segments") + ", " + _EDGES + " select image_id, a, b from e")
def connection_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.endpoint_edges(view(spark, sf_dir, "v_segments"))


@query(ctes("v_segments").replace("with ", "with recursive ", 1) + ", " + _EDGES + """,
    linked as (select image_id, a, b from e union select image_id, b, a from e),
    reach as (select image_id, ord, ord as root from v_segments union select linked.image_id, linked.b, reach.root from reach
        join linked on linked.image_id = reach.image_id and linked.a = reach.ord)
    select image_id, count(distinct root) as connections from (select image_id, ord, min(root) as root from reach group by 1, 2) group by 1""")
def connection_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = view(spark, sf_dir, "v_segments")
    return graph.image_components(segments, graph.endpoint_edges(segments, once=False)).groupBy("image_id").agg(F.countDistinct("root").alias("connections"))


@query(ctes("v_texts") + """ select l.image_id, l.ord as a, r.ord as b from v_texts l join v_texts r on l.image_id = r.image_id and l.ord < r.ord
    where pow(greatest(0, l.x - r.x - r.width, r.x - l.x - l.width), 2) + pow(greatest(0, l.y - r.y - r.height, r.y - l.y - l.height), 2) < 900""")
def text_gap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.text_edges(view(spark, sf_dir, "v_texts"))


@query(ctes("v_rects") + """, p as (select l.image_id, l.ord as a, r.ord as b, l.area + r.area as s,
        greatest(0, least(l.x+l.width, r.x+r.width) - greatest(l.x, r.x)) * greatest(0, least(l.y+l.height, r.y+r.height) - greatest(l.y, r.y)) as i
        from v_rects l join v_rects r on l.image_id = r.image_id and l.ord < r.ord)
    select image_id, a, b, round_even(i / (s - i), 6) as iou from p where i / (s - i) > 0.5""")
def iou_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.iou_edges(view(spark, sf_dir, "v_rects"))


_AREA = 1700 * 1200


@query(ctes("v_rects") + f""" select image_id, row_number() over (partition by image_id order by y, x, ord) - 1 as zone, x, y, width, height from v_rects
    where area >= {_AREA} * 0.01 and area <= {_AREA} * 0.95 and greatest(width, height) / greatest(least(width, height), 1) <= 8""")
def zone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.zones(view(spark, sf_dir, "v_rects"), F.lit(_AREA))


@query(ctes("v_rects") + f""", z as (select * from v_rects where area >= {_AREA} * 0.01 and area <= {_AREA} * 0.95 and greatest(width, height) / greatest(least(width,
        height), 1) <= 8)
    select image_id, count(*) as zones, round_even(cast(sum(area) as double) / {_AREA}, 6) as coverage,
        count(*) between 3 and (2 + image_id % 3) * (2 + image_id % 4) and cast(sum(area) as double) / {_AREA} between 0.30 and 1.5 as use_smart_tiling from z group by 1""")
def zone_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.coverage(tiling.zones(view(spark, sf_dir, "v_rects"), F.lit(_AREA)), F.lit(_AREA), (2 + F.col("image_id") % 3) * (2 + F.col("image_id") % 4))


@query(ctes("v_rects") + """, m as (select image_id, case when count(*) >= 3 then median(area) else 50000.0 end as split from v_rects group by 1)
    select image_id, ord, area, case when area >= split then 'zone' else 'device' end as kind from v_rects join m using (image_id)""")
def shape_median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.split_by_median(view(spark, sf_dir, "v_rects")).select("image_id", "ord", "area", "kind")


@query(ctes("v_rects") + " select image_id, ord, x, y, width, height, area, x + width // 2 as cx, y + height // 2 as cy from v_rects where area between 100 and 5000")
def icon_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_rects").where(F.col("area").between(100, 5000)).selectExpr("image_id", "ord", "x", "y", "width", "height", "area", "x + width div 2 as cx", "y + height div 2 as cy")


@query(ctes("v_rects") + """, f as (select image_id, ord, 3 + ord % 6 as vertices, cast(area as double) as area, 2.0 * (width + height) as perimeter from v_rects where area >= 500)
    select image_id, ord, case when vertices = 4 then 'rectangle' when 4 * pi() * area / (perimeter * perimeter) > 0.75 then 'circle' else 'polygon' end as type from f""")
def contour_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = view(spark, sf_dir, "v_rects").where("area >= 500").withColumn("vertices", 3 + F.col("ord") % 6)
    return features.select("image_id", "ord", exprs.contour_type(F.col("vertices"), F.col("area").cast("double"), 2.0 * (F.col("width") + F.col("height"))).alias("type"))


@query(ctes("v_images") + """ select image_id, 1 as upscale_factor, 3 as morph_kernel_size, case when thickness >= 4 then 0 when thickness >= 2 then 1
        else 2 end as morph_iterations,
    case when thickness < 2 or line_density < 0.03 then 3 else 0 end as close_gaps_kernel, contrast < 50 as clahe_enabled, 2.0::double as clahe_clip_limit,
        8 as clahe_grid_size, true as sharpen_enabled,
    case when text_density > 0.05 then 1.0 else 1.5 end::double as sharpen_amount, case when line_density > 0.15 then 16 when line_density > 0.08 then 12
        when line_density > 0.03 then 8 else 4 end as tile_count from v_images""")
def preprocess_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.preprocess_params(view(spark, sf_dir, "v_images")).withColumn("upscale_factor", F.lit(1))


@query(ctes("v_images") + """, t as (select *, case when line_density + text_density > 0.20 then 16 when line_density + text_density > 0.10 then 12
        when line_density + text_density > 0.04 then 8 else 4 end as target, w / h as aspect from v_images),
    f as (select *, case when w >= h then greatest(1, round_even(sqrt(target) * sqrt(aspect), 0)) else greatest(1, round_even(sqrt(target) / sqrt(aspect), 0)) end as major from t)
    select image_id, greatest(2, case when w >= h then greatest(1, round_even(target / major, 0)) else major end)::bigint as rows, greatest(2, case when w >= h
        then major else greatest(1, round_even(target / major, 0)) end)::bigint as cols,
        round_even(least(0.40, 0.20 + case when text_density > 0.05 then 0.05 else 0 end + case when thickness < 2 then 0.05 else 0 end + case when colors > 6 then 0.05
        else 0 end)::double, 2) as overlap from f""")
def tiling_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiling_params(view(spark, sf_dir, "v_images"))


@query(ctes("v_images").replace("with ", "with recursive ", 1) + """,
    f as (select image_id, greatest(1, ceil((h - 256) / 768.0))::bigint as rows, greatest(1, ceil((w - 256) / 768.0))::bigint as cols from v_images),
    o as (select image_id, greatest(1, round_even(sqrt(16 / (cols / rows)), 0))::bigint as r, cols / rows as ratio from f where rows * cols > 16),
    s as (select image_id, r, greatest(1, round_even(r * ratio, 0))::bigint as c from o union all
        select image_id, case when r >= c then greatest(1, r - 1) else r end, case when r >= c then c else greatest(1, c - 1) end from s where r * c > 16),
    g as (select image_id, greatest(r, 16 // c) as rows, c from s where r * c <= 16)
    select image_id, rows, cols from f where rows * cols <= 16 union all select image_id, rows, greatest(c, 16 // rows) from g""")
def grid_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.grid_size(view(spark, sf_dir, "v_images")).select("image_id", "rows", "cols")


def _axis(length: str, n: str) -> str:
    return f"""select image_id, i, case when {n} = 1 then 0 else greatest(0, least(round_even((len - t) / ({n} - 1) * i, 0), len - t)) end::bigint as origin,
        case when {n} = 1 then len else least(t, len - greatest(0, least(round_even((len - t) / ({n} - 1) * i, 0), len - t))) end::bigint as size from (
        select image_id, {n}, {length} as len, greatest(1, least(round_even({length} / (1 + 0.75::double * ({n} - 1)), 0), {length}))::bigint as t,
        unnest(range({n})) as i from im)"""


_IM = "im as (select *, 1 + image_id % 4 as rows, 1 + image_id % 5 as cols from v_images)"


@query(ctes("v_images") + f", {_IM} " + _axis("w", "cols"))
def axis_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = view(spark, sf_dir, "v_images").withColumn("cols", 1 + F.col("image_id") % 5)
    return images.select("image_id", F.inline(exprs.axis_positions(F.col("w"), F.col("cols"), 0.25))).select("image_id", "i", "origin", "size")


_TILES = f"""{_IM}, ax as ({_axis('w', 'cols')}), ay as ({_axis('h', 'rows')}),
    tiles as materialized (select ay.image_id, ay.i as row_no, ax.i as col_no, ax.origin as x, ay.origin as y, ax.size as width, ay.size as height from ax
        join ay using (image_id))"""


def _gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_images").withColumn("rows", 1 + F.col("image_id") % 4).withColumn("cols", 1 + F.col("image_id") % 5)


@query(ctes("v_images") + f", {_TILES} select image_id, row_no, col_no, row_number() over (partition by image_id order by row_no, col_no) - 1 as ord, x, y, width, height from tiles")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiles(_gridded(spark, sf_dir), 0.25)


_PAIRS = """pairs as (select a.image_id, a.row_no as row_a, a.col_no as col_a, b.row_no as row_b, b.col_no as col_b, greatest(a.x, b.x) as x, greatest(a.y, b.y) as y,
    greatest(0, least(a.x+a.width, b.x+b.width) - greatest(a.x, b.x)) as width, greatest(0, least(a.y+a.height, b.y+b.height) - greatest(a.y, b.y)) as height
    from tiles a join tiles b on a.image_id = b.image_id and ((b.row_no = a.row_no and b.col_no = a.col_no + 1) or (b.row_no = a.row_no + 1 and b.col_no = a.col_no)))"""


@query(ctes("v_images") + f", {_TILES}, {_PAIRS} select image_id, row_a, col_a, row_b, col_b from pairs")
def tile_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.adjacent(_gridded(spark, sf_dir), 0.25).select("image_id", "row_a", "col_a", "row_b", "col_b")


@query(ctes("v_images") + f", {_TILES}, {_PAIRS} select * from pairs")
def tile_overlap_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.adjacent(_gridded(spark, sf_dir), 0.25)


@query(ctes("v_images") + """ select image_id, round_even(w * (1024.0::double / greatest(w, h)), 0)::bigint as global_w, round_even(h * (1024.0::double / greatest(w,
        h)), 0)::bigint as global_h,
    case when greatest(w, h) > 1024 then 'area' else 'linear' end as interpolation, case when greatest(w, h) <= 1024 then w
        else round_even(w * (1024.0::double / greatest(w, h)), 0)::bigint end as model_w,
    case when greatest(w, h) <= 1024 then h else round_even(h * (1024.0::double / greatest(w, h)), 0)::bigint end as model_h from v_images""")
def view_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = exprs.scaled_to(F.col("w"), F.col("h"), 1024)
    small = F.greatest("w", "h") <= 1024
    return view(spark, sf_dir, "v_images").select("image_id", w.alias("global_w"), h.alias("global_h"), F.when(small, "linear").otherwise("area").alias("interpolation"),
                                                  F.when(small, F.col("w")).otherwise(w).alias("model_w"), F.when(small, F.col("h")).otherwise(h).alias("model_h"))


@query(ctes("v_segments", "v_rects") + """ select s.image_id, s.ord, t.x + s.x1 as x1, t.y + s.y1 as y1, t.x + s.x2 as x2, t.y + s.y2 as y2 from v_segments s join v_rects t using (image_id, ord)""")
def coord_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = view(spark, sf_dir, "v_rects").select("image_id", "ord", "x", "y")
    return tiling.to_image(view(spark, sf_dir, "v_segments").join(tiles, ["image_id", "ord"])).select("image_id", "ord", "x1", "y1", "x2", "y2")


@query(ctes("v_images", "v_rects") + """, z as (select r.image_id, r.ord, greatest(0, least(r.x - 300, 1199)) as x, greatest(0, least(r.y - 200, 899)) as y, r.width,
        r.height from v_rects r)
    select image_id, ord, x, y, least(width, 1200 - x) as width, least(height, 900 - y) as height from z""")
def zone_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = view(spark, sf_dir, "v_rects").withColumn("x", F.col("x") - 300).withColumn("y", F.col("y") - 200)
    return tiling.clamped(rects, 1200, 900).select("image_id", "ord", "x", "y", "width", "height")


@query(None)
def greedy_box_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merged_zones(view(spark, sf_dir, "v_rects"))
