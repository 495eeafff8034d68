"""Queries over progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import resume
from lattica.plans.registry import query
from lattica.sources.adapters import ctes, view


@query(ctes("v_tiles", "v_progress") + " select t.* from v_tiles t semi join v_progress p on p.image_id = t.image_id and p.tile = t.tile")
def resume_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.cached(view(spark, sf_dir, "v_tiles"), view(spark, sf_dir, "v_progress"))


@query(ctes("v_tiles", "v_progress") + """, l as (select t.* from v_tiles t left join v_progress p on p.image_id = t.image_id and p.tile = t.tile and t.tile + 1 < 3
        where p.tile is null and t.tile + 1 >= 3),
    q as (select *, max((action = 'quit')::int) over (partition by image_id order by tile) as quits from l) select image_id, tile, row_no, col_no, action from q
        where quits = 0 and action = 'run'""")
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.todo(view(spark, sf_dir, "v_tiles"), view(spark, sf_dir, "v_progress"), from_tile=3)


@query(ctes("v_tiles", "v_progress") + " select t.image_id, t.tile, coalesce(p.result, '') as result from v_tiles t left join v_progress p on p.image_id = t.image_id and p.tile = t.tile")
def resume_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.answers(view(spark, sf_dir, "v_tiles"), view(spark, sf_dir, "v_progress")).select("image_id", "tile", "result")


@query(ctes("v_segments", "v_texts", "v_rects") + """, u as (select image_id, 1 as l, 0 as t, 0 as s from v_segments union all select image_id, 0, 1, 0 from v_texts
        union all select image_id, 0, 0, 1 from v_rects)
    select image_id, sum(l)::bigint as lines, sum(t)::bigint as texts, sum(s)::bigint as shapes from u group by 1""")
def tile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [view(spark, sf_dir, n).select("image_id", F.lit(k).alias("kind")) for k, n in enumerate(("v_segments", "v_texts", "v_rects"))]
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return rows.groupBy("image_id").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in enumerate(("lines", "texts", "shapes"))])


@query(ctes("v_tiles", "v_progress") + " select t.image_id, count(p.tile) as done, count(*) as total from v_tiles t left join v_progress p on p.image_id = t.image_id and p.tile = t.tile group by 1")
def progress_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.counted(view(spark, sf_dir, "v_tiles"), view(spark, sf_dir, "v_progress"))
