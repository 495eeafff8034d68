"""Queries over pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import pixels, tiling
from lattica.plans.geometry import _axis
from lattica.plans.registry import query
from lattica.sources.adapters import ctes, view

_G = "(r*4899 + g*9617 + b*1868 + 8192) // 16384"
_OTSU = f"""h as (select image_id, {_G} as level, count(*) as n from v_pixels group by 1, 2),
    w as (select image_id, level, sum(n) over o as w0, sum(level*n) over o as s0, sum(n) over a as nn, sum(level*n) over a as ss
        from h window o as (partition by image_id order by level), a as (partition by image_id)),
    v as (select image_id, level, case when w0 < nn then (ss*w0 - nn*s0)::double * (ss*w0 - nn*s0)::double / (w0 * (nn - w0))::double else 0 end as b from w),
    t as (select image_id, level as threshold from (select *, row_number() over (partition by image_id order by b desc, level) as n from v) where n = 1)"""


@query(ctes("v_pixels") + f" select image_id, y, x, {_G} as gray from v_pixels")
def gray_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_pixels").select("image_id", "y", "x", pixels.gray().alias("gray"))


@query(ctes("v_pixels") + f", {_OTSU} select image_id, threshold from t")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.otsu(view(spark, sf_dir, "v_pixels"))


@query(ctes("v_pixels") + f", {_OTSU} select image_id, round_even(count(*) filter (where {_G} <= threshold)::double / count(*), 6) as line_density from v_pixels join t using (image_id) group by 1")
def line_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.line_densities(view(spark, sf_dir, "v_pixels"))


@query(ctes("v_pixels") + f" select image_id, round_even(stddev_pop({_G}), 6) as contrast_score from v_pixels group by 1")
def contrast_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_pixels").groupBy("image_id").agg(F.bround(F.stddev_pop(pixels.gray()), 6).alias("contrast_score"))


_OFFSETS = "(values (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) as o(dy, dx)"


def _stencil(source: str, how: str) -> str:
    """Values are moved to their neighbours' places; places outside the image have no pixel of their own."""
    return f"""select image_id, y, x, {how}(b) as b, {how}(g) as g, {how}(r) as r from (
        select image_id, y + dy as y, x + dx as x, b, g, r, dy = 0 and dx = 0 as own from {source}, {_OFFSETS}) group by 1, 2, 3 having bool_or(own)"""


@query(ctes("v_pixels") + " " + _stencil("v_pixels", "min"))
def erode_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.stencil(view(spark, sf_dir, "v_pixels"), ["b", "g", "r"], "min")


@query(ctes("v_pixels") + f", e as ({_stencil('v_pixels', 'min')}) " + _stencil("e", "max"))
def close_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.stencil(view(spark, sf_dir, "v_pixels"), ["b", "g", "r"], "min", "max")


@query(ctes("v_pixels") + f""", {_OTSU}, i as (select image_id, y, x, {_G} <= threshold as ink from v_pixels join t using (image_id)),
    n as (select distinct image_id, y + dy as y, x + dx as x from i, (values (0, 1), (0, -1), (1, 0), (-1, 0)) as o(dy, dx) where ink)
    select image_id, y, x from i semi join n using (image_id, y, x) where not ink""")
def new_line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.gained(view(spark, sf_dir, "v_pixels"))


@query(ctes("v_pixels") + f""", {_OTSU}, i as (select image_id, y, x, b, g, r, {_G} <= threshold as ink from v_pixels join t using (image_id)),
    n as (select distinct image_id, y + dy as y, x + dx as x from i, (values (0, 1), (0, -1), (1, 0), (-1, 0)) as o(dy, dx) where ink)
    select i.image_id, i.y, i.x, case when n.x is not null and not ink then 0 else b end as b, case when n.x is not null and not ink then 0 else g end as g, case
        when n.x is not null and not ink then 0 else r end as r
    from i left join n using (image_id, y, x)""")
def enhance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.enhanced(view(spark, sf_dir, "v_pixels"))


def _ink_step(source: str, how: str) -> str:
    return f"""select image_id, y, x, {how}(ink) as ink from (
        select image_id, y + dy as y, x + dx as x, ink, dy = 0 and dx = 0 as own from {source}, {_OFFSETS}) group by 1, 2, 3 having bool_or(own)"""


@query(ctes("v_pixels") + f""", {_OTSU}, i as (select image_id, y, x, ({_G} <= threshold)::int as ink from v_pixels join t using (image_id)),
        k as ({_ink_step('i', 'max')}), c as ({_ink_step('k', 'min')})
    select image_id, y, x, 255 - 255 * ink as gray from c""")
def close_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.closed_gray(view(spark, sf_dir, "v_pixels"))


@query(ctes("v_pixels") + f""", im as (select image_id, 1 + image_id % 3 as rows, 1 + image_id % 2 as cols, 16 as w, 16 as h from (select distinct image_id from v_pixels)),
    ax as materialized ({_axis('w', 'cols')}), ay as materialized ({_axis('h', 'rows')})
    select p.image_id, ay.i as row_no, ax.i as col_no, count(*) as pixels, sum({_G})::bigint as gray from v_pixels p
        join ax on ax.image_id = p.image_id and p.x >= ax.origin and p.x < ax.origin + ax.size
        join ay on ay.image_id = p.image_id and p.y >= ay.origin and p.y < ay.origin + ay.size group by 1, 2, 3""")
def tile_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = view(spark, sf_dir, "v_pixels").where("y = 0 and x = 0").selectExpr("image_id", "16L as w", "16L as h", "1 + image_id % 3 as rows", "1 + image_id % 2 as cols")
    cropped = pixels.crops(view(spark, sf_dir, "v_pixels"), tiling.tiles(image, 0.25))
    return cropped.groupBy("image_id", "row_no", "col_no").agg(F.count(F.lit(1)).alias("pixels"), F.sum(pixels.gray()).alias("gray"))


_HSV = """c as (select *, greatest(r,g,b) as v, greatest(r,g,b) - least(r,g,b) as d from v_pixels),
    hue as (select *, case when d = 0 then 0 when v = r then 30*(g-b)/d::double when v = g then 60 + 30*(b-r)/d::double else 120 + 30*(r-g)/d::double end as q, case
        when v = 0 then 0 else round_even(255*d/v::double, 0) end as s from c),
    hs as (select image_id, y, x, v, s, round_even(case when q < 0 then q + 180 else q end, 0)::bigint % 180 as h from hue)"""


@query(ctes("v_pixels") + f""", {_HSV}, k(n, lo, hi) as (values {', '.join(f"('{n}', {lo}, {hi})" for n, lo, hi in pixels.HSV_RANGES)})
    select distinct image_id, case when n like 'red!_%' escape '!' then 'red' else n end as channel, y, x from hs join k on h between lo and hi where s >= 70 and v >= 50""")
def hsv_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.channels(view(spark, sf_dir, "v_pixels"))


_LINES = "l as (select image_id, o as ord, (image_id*5+o*7)%16 as x1, (image_id*3+o*11)%16 as y1, (o*13+image_id)%16 as x2, (o*5+image_id*2)%16 as y2 from (select distinct image_id from v_pixels), (select unnest(range(10)) as o))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = view(spark, sf_dir, "v_pixels").where("y = 0 and x = 0").select("image_id", F.explode(F.expr("sequence(0L, 9L)")).alias("ord"))
    return ids.selectExpr("image_id", "ord", "(image_id*5+ord*7)%16 as x1", "(image_id*3+ord*11)%16 as y1", "(ord*13+image_id)%16 as x2", "(ord*5+image_id*2)%16 as y2")


def _sampled(n: int) -> str:
    return f"""{_LINES}, s as (select l.image_id, l.ord, i, r, g, b, {_G} as gray from (select *, unnest(range({n})) as i from l) l
        join v_pixels p on p.image_id = l.image_id and p.x = (x1*{n - 1} + i*(x2-x1)) // {n - 1} and p.y = (y1*{n - 1} + i*(y2-y1)) // {n - 1})"""


@query(ctes("v_pixels") + f", {_sampled(20)} select image_id, ord, floor(avg(r))::bigint as r, floor(avg(g))::bigint as g, floor(avg(b))::bigint as b from s group by 1, 2")
def segment_mean_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.mean_colours(_lines(spark, sf_dir), view(spark, sf_dir, "v_pixels"))


@query(ctes("v_pixels") + f""", {_sampled(40)}, d as (select *, sign(gray * count(*) over (partition by image_id, ord) - sum(gray) over (partition by image_id,
        ord)) as side from s),
    c as (select *, lag(side) over (partition by image_id, ord order by i) as was from d)
    select image_id, ord, count(*) filter (where side <> was) as changes, count(*) filter (where side <> was) >= 6 as is_dashed from c group by 1, 2""")
def dash_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.dashes(_lines(spark, sf_dir), view(spark, sf_dir, "v_pixels"))
