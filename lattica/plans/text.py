"""Queries over model answers, prompts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import exprs
from lattica.operators import graph, text, tiling
from lattica.plans.color import CLUSTER_SQL, legend_of
from lattica.plans.geometry import _EDGES
from lattica.plans.registry import query
from lattica.sources import ocr
from lattica.sources.adapters import ctes, view

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_BULLETS = f"""lines as (select image_id, ord, unnest(string_split(result, chr(10))) as raw, generate_subscripts(string_split(result, chr(10)), 1) as pos from v_answers),
    bullets as (select image_id, ord, pos, {strip('raw')} as line from lines),
    keyed as (select *, {strip("lower(ltrim(line, '-* '))")} as k from bullets where (line like '-%' or line like '*%') and length(line) > 3),
    firsts as (select * from (select *, row_number() over (partition by image_id, k order by ord, pos) as n from keyed) where n = 1)"""


@query(ctes("v_answers") + ", " + _BULLETS + " select image_id, row_number() over (partition by image_id order by ord, pos) - 1 as item, line from firsts")
def inventory_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.inventory(view(spark, sf_dir, "v_answers"))


@query(ctes("v_answers") + ", " + _BULLETS + f""",
    items as (select image_id, string_agg(line, chr(10) order by ord, pos) as items from firsts group by image_id),
    tiles as (select image_id, string_agg('### Zone (row ' || (ord-1)//3 || ', col ' || (ord-1)%3 || ') at (' || ((ord-1)%3)*768 || ', ' || ((ord-1)//3)*768 || ')'
        || chr(10) || chr(10) || {strip('result')} || chr(10), chr(10) order by ord) as tiles
        from v_answers where ord between 1 and 8 group by image_id),
    ids as (select distinct image_id from v_answers)
    select ids.image_id, '## 1. OVERVIEW' || chr(10) || chr(10) || coalesce({strip('g.result')}, '') || chr(10) || chr(10) || '## 2. DETAILED ANALYSIS BY ZONE' || chr(10)
        || coalesce(chr(10) || tiles, '') || case when c.image_id is not null then chr(10) || '## 3. CROSS-ZONE CONNECTIONS' || chr(10) ||
           case when {strip('c.result')} <> '' then chr(10) || '### Connection group 1' || chr(10) || chr(10) || {strip('c.result')} || chr(10) else '' end else '' end
        || chr(10) || '## 4. CONSOLIDATED INVENTORY' || chr(10) || chr(10) || coalesce(items, 'No structured inventory items detected.') as report
    from ids left join (select * from v_answers where ord = 0) g on g.image_id = ids.image_id left join tiles on tiles.image_id = ids.image_id
        left join (select * from v_answers where ord = 9) c on c.image_id = ids.image_id left join items on items.image_id = ids.image_id""")
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ord") - 1
    answers = view(spark, sf_dir, "v_answers").select(
        "image_id", "ord", "result", F.when(F.col("ord") == 0, "global").when(F.col("ord") == 9, "cross").otherwise("tile").alias("pass"),
        F.floor(at / 3).alias("row_no"), (at % 3).alias("col_no"), (at % 3 * 768).alias("x"), (F.floor(at / 3) * 768).alias("y"))
    return text.report(answers)


_QUANT = "'(' || r//32*32 || ',' || g//32*32 || ',' || b//32*32 || ')_' || case when is_dashed then 'dashed' else 'solid' end"


_CONTEXT = ctes("v_segments", "v_texts", "v_rects").replace("with ", "with recursive ", 1) + f""", {_EDGES},
    linked as (select image_id, a, b from e union select image_id, b, a from e),
    reach as (select image_id, ord, ord as root from v_segments union select linked.image_id, linked.b, reach.root from reach
        join linked on linked.image_id = reach.image_id and linked.a = reach.ord),
    conn as (select image_id, count(distinct root) as n from (select image_id, ord, min(root) as root from reach group by 1, 2) group by 1),
    te as (select l.image_id, l.ord as a, r.ord as b from v_texts l join v_texts r on l.image_id = r.image_id and l.ord <> r.ord
        where pow(greatest(0, l.x - r.x - r.width, r.x - l.x - l.width), 2) + pow(greatest(0, l.y - r.y - r.height, r.y - l.y - l.height), 2) < 900),
    treach as (select image_id, ord, ord as root from v_texts union select te.image_id, te.b, treach.root from treach
        join te on te.image_id = treach.image_id and te.a = treach.ord),
    own as (select image_id, ord, min(root) as root from treach group by 1, 2),
    multi as (select image_id, root, string_agg(text, ' / ' order by y, x, ord) as label from own join v_texts using (image_id, ord) group by 1, 2 having count(*) > 1),
    grps as (select image_id, count(*) as n, string_agg('  - "' || label || '"', chr(10) order by root) filter (where k <= 10) as t from (select *, row_number()
        over (partition by image_id order by root) as k from multi) group by 1),
    {CLUSTER_SQL},
    leg as (select image_id, string_agg('  - ' || label || ': RGB(' || r || ', ' || g || ', ' || b || ')', chr(10) order by ord) as t from lr group by 1),
    grp as (select image_id, {_QUANT} as k, count(*) as n, min(ord) as o from v_segments group by 1, 2),
    cats as (select image_id, count(*) as groups, string_agg('  - ' || k || ': ' || n || ' segments', chr(10) order by o) as t from grp group by 1),
    segs as (select image_id, count(*) as n from v_segments group by 1),
    labs as (select image_id, count(*) as n, string_agg('"' || text || '"', ', ' order by ord) filter (where ord_n <= 30) as t from (select *, row_number()
        over (partition by image_id order by ord) as ord_n from v_texts) group by 1),
    med as (select image_id, case when count(*) >= 3 then median(area) else 50000.0 end as m from v_rects group by 1),
    shp as (select v.image_id, count(*) filter (where area >= m) as z, count(*) filter (where area < m) as d, count(*) filter (where area between 100 and 5000) as i
        from v_rects v join med using (image_id) group by 1)
    select s.image_id, s.n || ' line segments detected, grouped into ' || groups || ' visual categories.'
        || chr(10) || 'Estimated distinct connections: ' || conn.n || '.' || chr(10) || 'Line categories:' || chr(10) || cats.t || chr(10)
      || 'Colour legend (auto-detected):' || chr(10) || leg.t || chr(10)
      || 'OCR detected ' || coalesce(labs.n, 0) || ' text elements.' || coalesce(chr(10) || 'Visible labels: ' || labs.t, '') || case when labs.n > 30
        then chr(10) || '  ... and ' || (labs.n - 30) || ' more.' else '' end || chr(10)
      || coalesce(grps.n || ' multi-line label groups detected:' || chr(10) || grps.t || chr(10), '')
      || 'Shapes: ' || shp.z || ' zones, ' || shp.d || ' device boxes, ' || shp.i || ' icons detected.' as context
    from segs s join cats using (image_id) join conn using (image_id) join leg using (image_id) left join labs using (image_id) left join grps using (image_id)
        join shp using (image_id)"""


def _ordered(order: str, *fields: str):
    """Aggregate: structs of fields in an order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))


def multi_groups(texts: DataFrame) -> DataFrame:
    """image_id, root, label: groups of several texts that stand near each other, joined from the top."""
    own = graph.image_components(texts, graph.text_edges(texts)).join(texts, ["image_id", "ord"])
    found = own.groupBy("image_id", "root").agg(F.count(F.lit(1)).alias("members"), text.joined([F.col("y"), F.col("x"), F.col("ord")], F.col("text"), " / ").alias("label"))
    return found.where("members > 1").drop("members")


@query(_CONTEXT)
def cv_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, texts, rects = (view(spark, sf_dir, n) for n in ("v_segments", "v_texts", "v_rects"))
    key = exprs.quantised_key(F.col("r"), F.col("g"), F.col("b"), F.col("is_dashed"))
    groups = segments.groupBy("image_id", key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o"))
    lines = groups.groupBy("image_id").agg(F.sum("n").alias("lines"), _ordered("o", "key", "n").alias("categories"))
    linked = graph.image_components(segments, graph.endpoint_edges(segments, once=False)).groupBy("image_id").agg(F.countDistinct("root").alias("connections"))
    legend = legend_of(segments).groupBy("image_id").agg(_ordered("ord", "label", "r", "g", "b").alias("legend"))
    labels = texts.groupBy("image_id").agg(F.transform(_ordered("ord", "text"), lambda x: x["text"]).alias("texts"))
    multi = multi_groups(texts).groupBy("image_id").agg(F.transform(_ordered("root", "label"), lambda x: x["label"]).alias("groups"))
    shapes = tiling.split_by_median(rects).groupBy("image_id").agg(
        F.count_if(F.col("kind") == "zone").alias("zones"), F.count_if(F.col("kind") == "device").alias("devices"), F.count_if(F.col("area").between(100, 5000)).alias("icons"))
    whole = lines.join(linked, "image_id").join(legend, "image_id").join(labels, "image_id", "left").join(multi, "image_id", "left").join(shapes, "image_id")
    strings = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    block = text.cv_context(F.col("lines"), F.col("connections"), F.col("categories"), F.col("legend"), strings(F.col("texts")), strings(F.col("groups")),
                            F.col("zones"), F.col("devices"), F.col("icons"))
    return whole.select("image_id", block.alias("context"))


@query(ctes("v_segments", "v_texts") + """,
    s as (select image_id, count(*) as n, count(*) filter (where degrees(atan2(abs(y2-y1), abs(x2-x1))) < 30) as flat from v_segments group by 1),
    t as (select image_id, count(*) as n, string_agg(text, ', ' order by ord) filter (where nth <= 10) as labels from (select *, row_number()
        over (partition by image_id order by ord) as nth from v_texts) group by 1)
    select s.image_id, 'CV analysis detected ' || s.n || ' line segments and ' || coalesce(t.n, 0) || ' text labels. ' || case when s.n > 0
        then 'Line orientations: mostly ' || case when flat*2 > s.n then 'horizontal' else 'mixed' end || '. ' else '' end
        || coalesce('Detected labels: ' || labels || '. ', '') as context from s left join t using (image_id)""")
def tile_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = exprs.segment_angle(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    lines = view(spark, sf_dir, "v_segments").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(angle < 30).alias("flat"))
    labels = view(spark, sf_dir, "v_texts").groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("labels"))
    none = F.array().cast("array<string>")
    return lines.join(labels, "image_id", "left").select("image_id", text.tile_context(F.col("n"), F.col("flat"), F.coalesce("labels", none)).alias("context"))


@query(ctes("v_images") + """ select image_id, '## ANALYSIS METADATA' || chr(10) || chr(10) || '| Parameter | Value |' || chr(10) || '|---|---|'
        || chr(10) || '| Source | img' || image_id || '.png |' || chr(10)
    || '| Image size | ' || w || 'x' || h || ' |' || chr(10) || chr(10) as meta, '/data/img' || image_id || '.md' as report_path from v_images""")
def meta_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.format_string("/data/img%d.png", "image_id")
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    meta = text.meta_table(F.array(entry("Source", exprs.base_name(path)), entry("Image size", F.format_string("%dx%d", "w", "h"))))
    return view(spark, sf_dir, "v_images").select("image_id", meta.alias("meta"), F.concat(exprs.without_extension(path), F.lit(".md")).alias("report_path"))


@query(ctes("v_images") + """ select image_id, '# Diagram Analysis: img' || image_id || '.png' || chr(10) || chr(10) || 'Generated on 2024-05-06 07:08 UTC' || chr(10) || chr(10)
    || '## ANALYSIS METADATA' || chr(10) || chr(10) || '| Parameter | Value |' || chr(10) || '|---|---|' || chr(10) || '| Source | img' || image_id || '.png |'
        || chr(10) || '| Image size | ' || w || 'x' || h || ' |' || chr(10)
    || '| Dilation | kernel=3 iter=' || case when thickness >= 4 then 0 when thickness >= 2 then 1 else 2 end || ' |'
        || chr(10) || '| Tiles | ' || (1 + image_id % 4) * (1 + image_id % 5) || ' (' || (1 + image_id % 4) || 'x' || (1 + image_id % 5) || ') |' || chr(10)
    || '| Model | stub |' || chr(10) || '| Duration | ' || round_even(contrast / 8, 1) || 's |' || chr(10) || chr(10)
    || case when colors = 0 then '' else '## COMPUTER VISION FINDINGS' || chr(10) || chr(10) || '- **Lines detected**: ' || w || ' segments'
        || chr(10) || '- **Text elements**: ' || h || ' labels extracted via OCR' || chr(10)
    || '- **Shapes detected**: ' || colors || ' (rectangles, circles, polygons)' || chr(10) || '- **Color categories**: ' || colors || ' distinct line color groups'
        || chr(10) || chr(10) end
    || '## 1. OVERVIEW' || chr(10) || chr(10) || 'seen ' || image_id || chr(10) || chr(10) || '## 2. DETAILED ANALYSIS BY ZONE' || chr(10)
        || chr(10) || '## 4. CONSOLIDATED INVENTORY' || chr(10) || chr(10)
    || 'No structured inventory items detected.' || chr(10) as report from v_images""")
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = tiling.preprocess_params(view(spark, sf_dir, "v_images")).join(view(spark, sf_dir, "v_images"), "image_id")
    answers = images.select("image_id", F.lit("global").alias("pass"), *[F.lit(0).cast("long").alias(c) for c in ("ord", "row_no", "col_no", "x", "y")], F.format_string("seen %d", "image_id").alias("result"))
    path = F.format_string("/data/img%d.png", "image_id")
    rows, cols = 1 + F.col("image_id") % 4, 1 + F.col("image_id") % 5
    meta = text.meta_table(text.meta_entries(path, F.col("w"), F.col("h"), F.col("morph_kernel_size"), F.col("morph_iterations"), rows, cols, F.lit("stub"), F.bround(F.col("contrast") / 8, 1)))
    summary = F.when(F.col("colors") == 0, "").otherwise(text.cv_summary(F.col("w"), F.col("h"), F.col("colors"), F.col("colors")))
    whole = images.join(text.report(answers).withColumnRenamed("report", "merged"), "image_id")
    return whole.select("image_id", text.full_report(path, F.lit("2024-05-06 07:08:09").cast("timestamp"), meta, summary, F.col("merged")).alias("report"))


_ANSWER = strip("regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g')")


@query(ctes("v_raw_answers") + f" select conv_id, turn, {_ANSWER} as answer from v_raw_answers")
def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_raw_answers").select("conv_id", "turn", exprs.without_thinking(F.col("raw")).alias("answer"))


@query(ctes("v_texts") + """ select image_id, ord, 'Look at the labels. Context: ' || text || ' {cv_context} End.' as prompt from v_texts""")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.concat("text", F.lit(" {cv_context}"))
    return view(spark, sf_dir, "v_texts").select("image_id", "ord", text.rendered(F.lit("Look at the labels. Context: {cv_context} End."), context).alias("prompt"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of seven characters of each raw answer."""
    raw = view(spark, sf_dir, "v_raw_answers")
    pieces = F.expr("transform(sequence(0, greatest(0, (length(raw) - 1) div 7)), i -> substring(raw, i * 7 + 1, 7))")
    return raw.select("conv_id", "turn", F.posexplode(pieces).alias("seq", "fragment")).where(F.length("fragment") > 0)


@query(ctes("v_raw_answers") + f" select conv_id, turn, (length(raw) + 6) // 7 as fragments, {_ANSWER} as answer from v_raw_answers where length(raw) > 0")
def token_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = tokens(spark, sf_dir).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("fragments"), text.joined([F.col("seq")], F.col("fragment"), "").alias("raw"))
    return whole.select("conv_id", "turn", "fragments", exprs.without_thinking(F.col("raw")).alias("answer"))


@query(ctes("v_texts") + """ select image_id, ord, x, y, width, height, round_even(0.5::double + (ord % 7) / 30.0::double, 4) as confidence, text from v_texts""")
def ocr_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from polygons whose points lie between pixels, in no fixed order."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, right, low = F.col("x") + 0.7, F.col("y") + 0.2, F.col("x") + F.col("width") + 0.4, F.col("y") + F.col("height") + 0.9
    raw = view(spark, sf_dir, "v_texts").select("image_id", "ord", F.array(at(right, y), at(x, low), at(x, y), at(right, low)).alias("polygon"), "text", (F.lit(0.5) + F.col("ord") % 7 / 30.0).alias("confidence"))
    return ocr.texts(raw)


@query(ctes("v_texts").replace("with ", "with recursive ", 1) + """,
    e as (select l.image_id, l.ord as a, r.ord as b from v_texts l join v_texts r on l.image_id = r.image_id and l.ord <> r.ord
        where pow(greatest(0, l.x - r.x - r.width, r.x - l.x - l.width), 2) + pow(greatest(0, l.y - r.y - r.height, r.y - l.y - l.height), 2) < 900),
    reach as (select image_id, ord, ord as root from v_texts union select e.image_id, e.b, reach.root from reach join e on e.image_id = reach.image_id and e.a = reach.ord),
    own as (select image_id, ord, min(root) as root from reach group by 1, 2)
    select image_id, root, count(*) as members, string_agg(text, ' / ' order by y, x, ord) as label from own join v_texts using (image_id, ord) group by 1, 2""")
def text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = view(spark, sf_dir, "v_texts")
    own = graph.image_components(texts, graph.text_edges(texts)).join(texts, ["image_id", "ord"])
    return own.groupBy("image_id", "root").agg(F.count(F.lit(1)).alias("members"), text.joined([F.col("y"), F.col("x"), F.col("ord")], F.col("text"), " / ").alias("label"))
