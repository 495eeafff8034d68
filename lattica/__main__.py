"""python -m lattica <image or folder> [--debug] [--from=N] [--url=...] [--model=...]: reports beside the images.

Progress is an appended table beside the images; a run that was stopped goes on from there, and it goes when all is done.
"""

from __future__ import annotations

import os
import sys
import time

USAGE = """Usage: python -m lattica <image or folder> [--debug] [--from=N] [--url=URL] [--model=NAME]

Options:
  --debug     write the image after each step into debug/
  --from=N    ask anew from tile N on (the first is 1)
  --url=URL   a server that answers prompts, one JSON object a line; without it, answers come from a stub
  --model=NAME  the model to ask for
"""


def arguments(argv: list[str]) -> tuple[list[str], dict[str, str | bool]]:
    """What isn't a flag, and the flags; one without a value is true."""
    flags = {name: value if eq else True for name, eq, value in (a.partition("=") for a in argv if a.startswith("--"))}
    return [a for a in argv if not a.startswith("--")], flags


def run(spark, path: str, client, model_name: str, from_tile: int = 0, debug: bool = False, workers: int | None = None, make=None) -> list[str]:
    """Analyse the images at a path; the paths of the reports."""
    from pyspark.sql import functions as F

    from lattica import analysis
    from lattica.sources import images, ocr, sinks

    began = time.time()
    found = images.read_images(spark, path).where("height > 0").withColumn("image_id", F.regexp_replace("origin", "^file:(//)?", ""))
    if found.isEmpty():
        raise FileNotFoundError(f"no image can be read at {path}")
    folder = path if os.path.isdir(path) else os.path.dirname(os.path.abspath(path))
    progress = f"{folder}/.progress-{os.path.basename(path.rstrip('/'))}"
    params, tiles = analysis.plan(found)
    params, tiles = params.persist(), tiles.persist()
    parts = analysis.measured(found, params, tiles, make or ocr.stub).persist()
    if debug:
        name = F.concat(F.lit(f"{folder}/debug/"), F.regexp_extract("image_id", "([^/]*)$", 1), F.lit("/"))
        file = lambda df, stage: df.select(F.concat(name, stage, F.lit(".png")).alias("path"), F.col("image").alias("body"))
        view = F.when(F.col("ord") < 0, "05_global_view").otherwise(F.format_string("05_tile_%d_%d", "row_no", "col_no"))
        sinks.write_files(file(analysis.steps(found, params), F.col("stage")).unionByName(file(parts, view)))
    known = sinks.read_progress(spark, progress)
    said = analysis.asked(parts, client, known, None, from_tile, workers)
    answers = said.where("error is null").select("image_id", F.when(F.col("pass") == "global", -1).otherwise(F.col("ord")).cast("long").alias("tile"), "result")
    sinks.append_progress(answers, progress, int(time.time() * 1000))
    known = sinks.read_progress(spark, progress)
    stamp = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    reports = analysis.reports(params, parts, known, stamp, model_name, F.lit(round(time.time() - began, 1)))
    out = sinks.write_reports(reports)
    sinks.finish_progress(parts.select("image_id", F.col("ord").alias("tile")), progress)
    for table in (parts, tiles, params):
        table.unpersist()
    return out


def main(argv: list[str] | None = None) -> int:
    paths, flags = arguments(sys.argv[1:] if argv is None else argv)
    if len(paths) != 1:
        print(USAGE)
        return 1
    from pyspark.sql import SparkSession

    from lattica.operators import model

    name = str(flags.get("--model", "stub"))
    client = model.http_client(str(flags["--url"]), name) if "--url" in flags else model.stub
    spark = SparkSession.builder.appName("lattica").getOrCreate()
    try:
        for report in run(spark, paths[0], client, name, int(flags.get("--from", 0)), "--debug" in flags):
            print(f"Report written to: {report}")
    except FileNotFoundError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        print("\nAborted.")
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
