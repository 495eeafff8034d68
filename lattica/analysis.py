"""Analysis of whole images, from files to reports: calibration, tiles, measurements of each tile, the model's answers, one report an image.

Images are rows, named by their paths. An image with what belongs to it is what one call holds; all between is tables, so a folder
of any number of images goes through the same plan. Nothing of it reaches the driver but what a caller collects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import exprs
from lattica.operators import kernels, model, resume, text, tiling
from lattica.sources import ocr
from lattica.sources.images import png, to_array

TARGET, OVERLAP, LONGEST, LEAST_LENGTH = 1024, 0.25, 1024, 15
_PIXELS = ("height", "width", "channels", "data")


def _array(row: dict):
    return to_array(*(row[c] for c in _PIXELS))


def _rows(df: DataFrame, fn: Callable[[dict], list[dict]], names: pa.Schema, schema: str) -> DataFrame:
    """fn over rows, one at a time: a row holds an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(fn(batch.slice(k, 1).to_pylist()[0]), names)

    return df.mapInArrow(run, schema)


def described(images: DataFrame) -> DataFrame:
    """image_id, w, h and the characteristics that parameters follow from, under the names that ``operators.tiling`` takes."""
    names = pa.schema([("image_id", pa.string()), ("w", pa.int64()), ("h", pa.int64()), ("thickness", pa.float64()), ("line_density", pa.float64()),
                       ("contrast", pa.float64()), ("text_density", pa.float64()), ("colors", pa.int64())])

    def fn(row: dict) -> list[dict]:
        found = kernels.characteristics(_array(row))
        return [dict(zip(names.names, (row["image_id"], row["width"], row["height"], *found.values())))]

    return _rows(images.select("image_id", *_PIXELS), fn, names, "image_id string, w long, h long, thickness double, line_density double, contrast double, text_density double, colors long")


def plan(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each image: its parameters with rows and cols of the grid, and its tiles. Lines are thickened, so nothing is enlarged."""
    found = described(images)
    params = tiling.preprocess_params(found).withColumn("upscale_factor", F.lit(1))
    both = found.select("image_id", "w", "h").join(params, "image_id")
    sizes = [tiling.grid_size(both.where(F.col("tile_count") == most), TARGET, OVERLAP, most) for most in (4, 8, 12, 16)]
    grid = sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(sizes[3]).select("image_id", "rows", "cols")
    both = both.join(grid, "image_id")
    return both, tiling.tiles(both, OVERLAP)


_LINE = "x1:long,y1:long,x2:long,y2:long,length:double,angle:double,r:long,g:long,b:long,is_dashed:boolean"
_TEXT = "text:string,x:long,y:long,width:long,height:long,confidence:double"
_KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
_STRUCT = lambda spec: pa.struct([(f.split(":")[0], _KINDS[f.split(":")[1]]) for f in spec.split(",")])


def measured(images: DataFrame, params: DataFrame, tiles: DataFrame, make: Callable[[list[str]], ocr.Reader] = ocr.stub) -> DataFrame:
    """One row for each tile, its image (PNG, at most LONGEST pixels a side), lines, texts and number of shapes; and one of the whole image with ``ord`` -1."""
    names = pa.schema([("image_id", pa.string()), *[(c, pa.int64()) for c in ("ord", "row_no", "col_no", "x", "y", "width", "height")], ("image", pa.binary()),
                       ("lines", pa.list_(_STRUCT(_LINE))), ("texts", pa.list_(_STRUCT(_TEXT))), ("shapes", pa.int64())])
    grids = tiles.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", "row_no", "col_no", "x", "y", "width", "height"))).alias("tiles"))
    steps = params.select("image_id", F.struct(*[c for c in params.columns if c != "image_id"]).alias("params"))

    def fn(row: dict) -> list[dict]:
        img = list(kernels.preprocessed(_array(row), row["params"]).values())[-1]
        h, w = img.shape[:2]
        scale = LONGEST / max(h, w)
        view = kernels.resized(img, *(max(1, round(n * scale)) for n in (w, h)))
        whole = {"ord": -1, "row_no": 0, "col_no": 0, "x": 0, "y": 0, "width": w, "height": h, "image": png(view), "lines": [], "texts": [], "shapes": 0}
        out = [whole]
        read = ocr.reader(make)
        for t in row["tiles"]:
            part = kernels.crop(img, t["x"], t["y"], t["width"], t["height"])
            texts = []
            for polygon, said, sure in read(part):
                xs, ys = ([int(p[k]) for p in polygon] for k in (0, 1))
                texts.append({"text": said, "x": min(xs), "y": min(ys), "width": max(xs) - min(xs), "height": max(ys) - min(ys), "confidence": round(float(sure), 4)})
            gray = kernels.to_gray(part)
            out.append({**t, "image": png(kernels.crop(part, 0, 0, t["width"], t["height"], LONGEST)), "lines": kernels.described_lines(part, LEAST_LENGTH),
                        "texts": texts, "shapes": len(kernels.shapes(gray))})
        return [{"image_id": row["image_id"], **r} for r in out]

    rows = images.select("image_id", *_PIXELS).join(steps, "image_id").join(grids, "image_id")
    return _rows(rows, fn, names, "image_id string, ord long, row_no long, col_no long, x long, y long, width long, height long, image binary, "
                 f"lines array<struct<{_LINE}>>, texts array<struct<{_TEXT}>>, shapes long")


def steps(images: DataFrame, params: DataFrame) -> DataFrame:
    """image_id, stage, image (PNG): what each step of preprocessing makes; stages are numbered by the steps that ran."""
    names = pa.schema([("image_id", pa.string()), ("stage", pa.string()), ("image", pa.binary())])
    asked = params.select("image_id", F.struct(*[c for c in params.columns if c != "image_id"]).alias("params"))

    def fn(row: dict) -> list[dict]:
        return [{"image_id": row["image_id"], "stage": f"{k:02d}_{name}", "image": png(img)} for k, (name, img) in enumerate(kernels.preprocessed(_array(row), row["params"]).items(), 1)]

    return _rows(images.select("image_id", *_PIXELS).join(asked, "image_id"), fn, names, "image_id string, stage string, image binary")


def contexts(found: DataFrame) -> DataFrame:
    """image_id, ord, context: what each tile's prompt is told."""
    tiles = found.where("ord >= 0")
    flat = F.size(F.filter("lines", lambda x: x["angle"] < 30))
    return tiles.select("image_id", "ord", text.tile_context(F.size("lines"), flat, F.transform("texts", lambda t: t["text"])).alias("context"))


def asked(found: DataFrame, client: model.Client, progress: DataFrame | None = None, actions: DataFrame | None = None, from_tile: int = 0, workers: int | None = None) -> DataFrame:
    """image_id, pass, ord, result, error of the whole images and of the tiles that are to do. progress: answers that stand (tile -1 is the whole image);
    actions (image_id, tile, action: run, skip or quit): what a user said, else all run."""
    tiles = found.select("image_id", F.col("ord").alias("tile"), "image")
    said = actions if actions is not None else tiles.sparkSession.createDataFrame([], "image_id string, tile long, action string")
    known = progress if progress is not None else tiles.sparkSession.createDataFrame([], "image_id string, tile long, result string")
    tiles = tiles.join(said.select("image_id", "tile", "action"), ["image_id", "tile"], "left").withColumn("action", F.coalesce("action", F.lit("run")))
    parts = resume.todo(tiles.where("tile >= 0"), known, from_tile).withColumnRenamed("tile", "ord")
    parts = model.with_contexts(parts, contexts(found), ["image_id", "ord"])
    views = tiles.where("tile < 0").join(known, ["image_id", "tile"], "left_anti").withColumn("context", F.lit(""))
    return model.ask(model.requests(views, parts, parts.limit(0)), client, workers)


def reports(params: DataFrame, found: DataFrame, answers: DataFrame, stamp, model_name: str, seconds=None) -> DataFrame:
    """image_id, report. answers: image_id, tile (-1: the whole image), result; a tile without an answer has an empty one."""
    said = answers.select("image_id", F.col("tile").alias("ord"), exprs.without_thinking(F.col("result")).alias("result"))
    rows = found.select("image_id", "ord", "row_no", "col_no", "x", "y").join(said, ["image_id", "ord"], "left")
    merged = text.report(rows.withColumn("result", F.coalesce("result", F.lit(""))).withColumn("pass", F.when(F.col("ord") < 0, "global").otherwise("tile")))
    totals = found.groupBy("image_id").agg(F.sum(F.size("lines")).alias("lines"), F.sum(F.size("texts")).alias("texts"), F.sum("shapes").alias("shapes"),
                                           F.flatten(F.collect_list("lines")).alias("all_lines"))
    names = pa.schema([("image_id", pa.string()), ("clusters", pa.int64())])
    colours = _rows(totals.select("image_id", F.transform("all_lines", lambda x: F.array(x["r"], x["g"], x["b"])).alias("rgb")),
                    lambda r: [{"image_id": r["image_id"], "clusters": len(kernels.clustered_colours(r["rgb"]))}], names, "image_id string, clusters long")
    whole = params.join(totals.drop("all_lines"), "image_id").join(colours, "image_id").join(merged.withColumnRenamed("report", "merged"), "image_id")
    meta = text.meta_table(text.meta_entries(F.col("image_id"), F.col("w"), F.col("h"), F.col("morph_kernel_size"), F.col("morph_iterations"), F.col("rows"), F.col("cols"),
                                             F.lit(model_name), seconds))
    summary = text.cv_summary(F.col("lines"), F.col("texts"), F.col("shapes"), F.col("clusters"))
    return whole.select("image_id", text.full_report(F.col("image_id"), stamp, meta, summary, F.col("merged")).alias("report"))
