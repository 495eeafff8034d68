"""Queries that run kernels, models and streams. Kernels are tested by golden vectors and plain loops, not by SQL."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lattica.operators import kernels, model, text
from lattica.operators.images import by_image
from lattica.plans.registry import query
from lattica.plans.text import tokens
from lattica.sources.adapters import ctes, view
from lattica.streaming import think


def _by_image(spark: SparkSession, sf_dir: str, fn: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """fn over each image as an array; rows get the image_id in front. A call gets the whole images of an Arrow batch."""
    schema = f"image_id long, {schema}"
    names = [c.split()[0] for c in schema.split(",")]
    types = to_arrow_schema(StructType.fromDDL(schema)).types

    def run(table: pa.Table) -> pa.Table:
        image, y, x = (table.column(c).to_numpy() for c in ("image_id", "y", "x"))
        colours = np.stack([table.column(c).to_numpy() for c in ("b", "g", "r")], axis=1).astype(np.uint8)
        ids, first = np.unique(image, return_index=True)
        rows = []
        for key, i, j in zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), len(image)]):
            img = np.zeros((int(y[i:j].max()) + 1, int(x[i:j].max()) + 1, 3), np.uint8)
            img[y[i:j], x[i:j]] = colours[i:j]
            rows += [(key, *r) for r in fn(img)]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    pixels = view(spark, sf_dir, "v_pixels").select("image_id", "y", "x", "b", "g", "r")
    return by_image(pixels, ["y", "x"], run, schema)


def _rows(gray: np.ndarray) -> list[tuple]:
    return [(int(y), int(x), int(gray[y, x])) for y in range(gray.shape[0]) for x in range(gray.shape[1])]


_GRAY = "select image_id, y, x, ((r*4899 + g*9617 + b*1868 + 8192) // 16384)::double as v from v_pixels"


# Four cells of 64 pixels and a limit of 2.0 keep one pixel of each level; the rest of a cell's pixels are spread over all levels.
@query(ctes("v_pixels") + f""", g as (select image_id, y, x, v::bigint as v from ({_GRAY})), c as (select image_id, y // 8 as i, x // 8 as j, v, count(*) as n from g
        group by 1, 2, 3, 4),
    s as (select image_id, i, j, sum(n - 1)::double as spare from c group by 1, 2, 3),
    m as (select g.image_id, g.y, g.x, s.i, s.j, (count(c.v) + any_value(s.spare) * (any_value(g.v) + 1) / 256) * 255 / 64 as m from g join s using (image_id)
        left join c on c.image_id = g.image_id and c.i = s.i and c.j = s.j and c.v <= g.v group by 1, 2, 3, 4, 5),
    f as (select image_id, y, x, greatest(0, least(1, (y - 3.5::double) / 8)) as fy, greatest(0, least(1, (x - 3.5::double) / 8)) as fx,
        sum(m) filter (where i = 0 and j = 0) as a, sum(m) filter (where i = 0 and j = 1) as b,
        sum(m) filter (where i = 1 and j = 0) as c, sum(m) filter (where i = 1 and j = 1) as d from m group by 1, 2, 3)
    select image_id, y, x, greatest(0, least(255, round_even((a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy, 0)))::bigint as gray from f""")
def clahe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_image(spark, sf_dir, lambda img: _rows(kernels.clahe(kernels.to_gray(img), 2.0, 2)), "y long, x long, gray long")


_SIZE = "sz as (select image_id, max(y) + 1 as h, max(x) + 1 as w from v_pixels group by 1)"


def _weighted(source: str, axis: str, side: str, taps: str, place: str) -> str:
    """Values of ``source`` summed along an axis: ``taps`` (k, d, w) give, for each result, the places and their weights; ``place`` keeps them inside."""
    other = "x" if axis == "y" else "y"
    return f"""select q.image_id, q.{other}, q.k as {axis}, sum(q.w * s.v) as v from (
        select l.image_id, l.{other}, t.k, t.w, {place} as p from (select distinct image_id, {other} from {source}) l join sz using (image_id) join {taps} t on t.n = sz.{side}) q
        join {source} s on s.image_id = q.image_id and s.{other} = q.{other} and s.{axis} = q.p group by 1, 2, 3"""


_BLUR = """tp as (select n, k, k + d as i, exp(-d*d/18.0::double) / (select sum(exp(-e*e/18.0::double)) from range(-9, 10) as r(e)) as w
        from (select distinct h as n from sz union select w from sz), range(4096) as a(k), range(-9, 10) as b(d) where k < n)"""
_MIRRORED = "case when t.i < 0 then -1 - t.i when t.i >= t.n then 2 * t.n - 1 - t.i else t.i end"


@query(ctes("v_pixels") + f""", g as ({_GRAY}), {_SIZE}, {_BLUR}, down as ({_weighted('g', 'y', 'h', 'tp', _MIRRORED)}), done as ({_weighted('down', 'x', 'w', 'tp', _MIRRORED)})
    select g.image_id, g.y, g.x, greatest(0, least(255, round_even(2.5 * g.v - 1.5 * b.v, 0)))::bigint as gray from g
        join done b on b.image_id = g.image_id and b.y = g.y and b.x = g.x""")
def sharpen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_image(spark, sf_dir, lambda img: _rows(kernels.sharpened(kernels.to_gray(img))), "y long, x long, gray long")


@query()
def skeleton_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fn(img: np.ndarray) -> list[tuple]:
        gray = kernels.to_gray(img)
        return [(round(kernels.thickness(gray <= kernels.otsu(gray)), 6),)]

    return _by_image(spark, sf_dir, fn, "mean_line_thickness double")


@query()
def image_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_image(spark, sf_dir, lambda img: [tuple(kernels.characteristics(img).values())],
                     "mean_line_thickness double, line_density double, contrast_score double, text_density double, num_distinct_colors long")


@query()
def detect_lines_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_image(spark, sf_dir, lambda img: [(k, *s) for k, s in enumerate(kernels.line_segments(kernels.to_gray(img), 6, 7, 3))], "ord long, x1 long, y1 long, x2 long, y2 long")


@query()
def detect_shapes_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_image(spark, sf_dir, lambda img: [(k, *s.values()) for k, s in enumerate(kernels.shapes(kernels.to_gray(img), 10))],
                     "ord long, type string, x long, y long, width long, height long, area double, cx long, cy long")


@query()
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fn(img: np.ndarray) -> list[tuple]:
        centres, label, _ = kernels.kmeans(img.reshape(-1, 3), 4, runs=3)
        return [(k, *map(int, c[::-1]), int((label == k).sum())) for k, c in enumerate(centres)]

    return _by_image(spark, sf_dir, fn, "cluster long, r long, g long, b long, members long")


def _answer(prompt: str) -> str:
    """What the stub answers to a prompt without an image."""
    return f"'<think>' || length({prompt}) || '</think>- seen 0 bytes'"


def _prompt(name: str, context: str) -> str:
    return f"replace('{model.PROMPTS[name]}', '{{cv_context}}', {context})"


@query(ctes("v_tiles") + f" select image_id, 'tile' as pass, tile as ord, {_answer(_prompt('tile', chr(39) + 'none' + chr(39)))} as result, null::varchar as error from v_tiles where action = 'run'")
def vlm_stub_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = view(spark, sf_dir, "v_tiles").where("action = 'run'").select(
        "image_id", F.lit("tile").alias("pass"), F.col("tile").alias("ord"), text.rendered(F.lit(model.PROMPTS["tile"]), F.lit("none")).alias("prompt"), F.lit(None).cast("binary").alias("image"))
    return model.ask(requests, model.stub)


@query(ctes("v_tiles") + f""", c as (select image_id, tile, 'tile ' || tile as context from v_tiles where tile % 3 = 0),
    q as (select distinct image_id, 'global' as pass, 0::bigint as ord, '{model.PROMPTS["global"]}' || case when image_id % 2 = 0
        then '{model.MEASURED}' || 'image ' || image_id else '' end as prompt from v_tiles
        union all select t.image_id, 'tile', t.tile, {_prompt('tile', "coalesce(c.context, '')")} from v_tiles t left join c on c.image_id = t.image_id and c.tile = t.tile
        union all select a.image_id, 'cross', a.tile, {_prompt('cross', "''")} from v_tiles a
        join v_tiles b on b.image_id = a.image_id and b.row_no = a.row_no and b.col_no = a.col_no + 1)
    select image_id, pass, ord, {_answer('prompt')} as result, null::varchar as error from q""")
def three_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles, none = view(spark, sf_dir, "v_tiles"), F.lit(None).cast("binary").alias("image")
    views = tiles.select("image_id").distinct().select("image_id", F.when(F.col("image_id") % 2 == 0, F.format_string("image %d", "image_id")).alias("context"), none)
    contexts = tiles.where("tile % 3 = 0").select("image_id", "tile", F.format_string("tile %d", "tile").alias("context"))
    parts = model.with_contexts(tiles, contexts, ["image_id", "tile"]).select("image_id", F.col("tile").alias("ord"), "context", none)
    right = tiles.select("image_id", "row_no", (F.col("col_no") - 1).alias("col_no"))
    pairs = tiles.join(right, ["image_id", "row_no", "col_no"]).select("image_id", F.col("tile").alias("ord"), F.lit("").alias("context"), none)
    return model.ask(model.requests(views, parts, pairs), model.stub)


@query(ctes("v_raw_answers") + """ select conv_id * 1000 + turn as response_id, regexp_replace(raw, '(?s)<think>.*?(</think>|$)', '', 'g') as said,
    case when raw like '%</think>%' then regexp_extract(raw, '(?s)<think>(.*?)</think>', 1) else regexp_extract(raw, '(?s)<think>(.*)$', 1) end as thought
        from v_raw_answers where length(raw) > 0""")
def stream_think_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as a stream from files, through keyed state, to a table of pieces; what each response said and thought."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or _local(spark)
    base = f"{shared.rstrip('/')}/think-{uuid.uuid4().hex}"
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("response_id")
    rows = tokens(spark, sf_dir).select(key, F.col("seq").cast("long").alias("seq"), "fragment")
    ends = view(spark, sf_dir, "v_raw_answers").where("length(raw) > 0").select(key, F.lit((1 << 62)).cast("long").alias("seq"), F.lit(None).cast("string").alias("fragment"))
    rows.unionByName(ends).write.parquet(f"{base}/in")
    stream = think.pieces(spark.readStream.schema("response_id long, seq long, fragment string").parquet(f"{base}/in"))
    run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    pieces = spark.read.schema("response_id long, piece_no long, piece string, is_thinking boolean").parquet(f"{base}/out")
    part = lambda thinking: text.joined([F.col("piece_no")], F.when(F.col("is_thinking") == thinking, F.col("piece")), "")
    return pieces.groupBy("response_id").agg(part(False).alias("said"), part(True).alias("thought"))


def _local(spark: SparkSession) -> str:
    """A folder for tests, where no shared one is set; it goes with the driver."""
    folder = tempfile.mkdtemp(prefix="lattica-streams-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@functools.lru_cache(maxsize=1024)
def _zones_of(raw: bytes, shape: tuple[int, ...]) -> list[tuple]:
    img = np.frombuffer(raw, np.uint8).reshape(shape)
    large = np.repeat(np.repeat(img, 8, axis=0), 8, axis=1)  # tiny test images hold no zones otherwise
    return [(k, *box) for k, box in enumerate(kernels.zone_boxes(large))]


def _gray_zones(img: np.ndarray) -> list[tuple]:
    """Equal images have equal zones: a worker keeps those of the last thousand different small ones."""
    return _zones_of(img.tobytes(), img.shape) if img.size <= 4096 else _zones_of.__wrapped__(img.tobytes(), img.shape)


@query()
def detect_zones_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_image(spark, sf_dir, _gray_zones, "ord long, x long, y long, w long, h long")


@query()
def detect_rectangles_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_image(spark, sf_dir, lambda img: [(k, *r.values()) for k, r in enumerate(kernels.rectangles(kernels.to_gray(img), 10))], "ord long, x long, y long, width long, height long, area double")


@query()
def detect_icons_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_image(spark, sf_dir, lambda img: [(k, *r.values()) for k, r in enumerate(kernels.icons(kernels.to_gray(img), 5))],
                     "ord long, x long, y long, width long, height long, area double, cx long, cy long")


@query()
def described_lines_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_image(spark, sf_dir, lambda img: [(k, *s.values()) for k, s in enumerate(kernels.described_lines(img, 6, 7, 3))],
                     "ord long, x1 long, y1 long, x2 long, y2 long, length double, angle double, r long, g long, b long, is_dashed boolean")


@query()
def clahe_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_image(spark, sf_dir, lambda img: [(y, x, *map(int, v)) for y, row in enumerate(kernels.contrast_enhanced(img, 2.0, 2)) for x, v in enumerate(row)], "y long, x long, b long, g long, r long")


_LANCZOS = """raw as (select n, k, floor((k + 0.5) / 2 - 0.5)::bigint + t as i, (k + 0.5) / 2 - 0.5 - floor((k + 0.5) / 2 - 0.5) - t as d
        from (select distinct h as n from sz union select w from sz), range(8192) as a(k), range(-3, 5) as b(t) where k < 2 * n),
    wt as (select n, k, i, case when d = 0 then 1.0 else sin(pi()*d)/(pi()*d) * sin(pi()*d/4)/(pi()*d/4) end as w from raw),
    tp as (select n, k, i, w / sum(w) over (partition by n, k) as w from wt)"""
_KEPT = "greatest(0, least(t.n - 1, t.i))"


@query(ctes("v_pixels") + f""", g as ({_GRAY}), {_SIZE}, {_LANCZOS}, down as ({_weighted('g', 'y', 'h', 'tp', _KEPT)}), done as ({_weighted('down', 'x', 'w', 'tp', _KEPT)})
    select image_id, y, x, greatest(0, least(255, round_even(v, 0)))::bigint as gray from done""")
def upscale_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_image(spark, sf_dir, lambda img: _rows(kernels.upscaled(kernels.to_gray(img), 2)), "y long, x long, gray long")


@query()
def auto_k_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_image(spark, sf_dir, lambda img: [(k, *c.values()) for k, c in enumerate(kernels.clustered_colours(img[kernels.ink(kernels.to_gray(img))][:, ::-1]))],
                     "cluster long, r long, g long, b long, members long, percentage double")
