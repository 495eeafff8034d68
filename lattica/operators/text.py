"""Merging answers into a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import exprs

#: Fixed wording of the report.
OVERVIEW, DETAILS, CROSS, INVENTORY = "## 1. OVERVIEW\n", "## 2. DETAILED ANALYSIS BY ZONE\n", "## 3. CROSS-ZONE CONNECTIONS\n", "## 4. CONSOLIDATED INVENTORY\n"
NOTHING = "No structured inventory items detected."


def joined(order: list[Column], text: Column, sep: str) -> Column:
    """Aggregate: texts in the order of some columns, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_text")))), lambda x: x["_text"]), sep)


def inventory(answers: DataFrame) -> DataFrame:
    """image_id, item (0, 1, ...), line: the first of each bullet in an image's answers, in their order."""
    rows = answers.select("image_id", "ord", F.posexplode(exprs.lines_of(F.col("result"))).alias("pos", "raw")).withColumn("line", exprs.stripped(F.col("raw")))
    rows = rows.where(exprs.is_bullet(F.col("line"))).withColumn("key", exprs.bullet_key(F.col("line")))
    first = rows.groupBy("image_id", "key").agg(F.min(F.struct("ord", "pos", "line")).alias("m"))
    numbered = F.row_number().over(Window.partitionBy("image_id").orderBy("m.ord", "m.pos")) - 1
    return first.select("image_id", numbered.cast("long").alias("item"), F.col("m.line").alias("line"))


def report(answers: DataFrame) -> DataFrame:
    """image_id, report. answers: image_id, pass (global, tile, cross), ord, row_no, col_no, x, y, result."""
    text, is_pass = exprs.stripped(F.col("result")), lambda p: F.col("pass") == p
    head = F.format_string("### Zone (row %d, col %d) at (%d, %d)\n", "row_no", "col_no", "x", "y")
    nth = F.row_number().over(Window.partitionBy("image_id", "pass").orderBy("ord"))
    part = (F.when(is_pass("global"), F.concat_ws("\n", text, F.lit("")))
            .when(is_pass("tile"), F.concat_ws("\n", head, text, F.lit("")))
            .when(text != "", F.concat_ws("\n", F.format_string("### Connection group %d\n", nth), text, F.lit(""))))
    section = F.when(is_pass("global"), 1).when(is_pass("tile"), 2).otherwise(3)
    parts = answers.select("image_id", section.alias("section"), F.when(is_pass("tile"), F.col("row_no")).otherwise(F.col("ord")).alias("k1"),
                           F.when(is_pass("tile"), F.col("col_no")).otherwise(F.lit(0)).alias("k2"), part.alias("part"))
    sections = parts.groupBy("image_id").agg(*[joined([F.col("k1"), F.col("k2")], F.when(F.col("section") == k, F.col("part")), "\n").alias(f"s{k}") for k in (1, 2, 3)],
                                             F.max(F.col("section") == 3).alias("crossed"), F.max(F.col("section") == 2).alias("tiled"), F.max(F.col("section") == 1).alias("seen"))
    items = inventory(answers).groupBy("image_id").agg(joined([F.col("item")], F.col("line"), "\n").alias("items"))
    whole = F.concat_ws("\n", F.lit(OVERVIEW), F.when(F.col("seen"), F.col("s1")).otherwise("\n"), F.lit(DETAILS), F.when(F.col("tiled"), F.col("s2")),
                        F.when(F.col("crossed"), F.lit(CROSS)), F.when(F.col("crossed") & (F.col("s3") != ""), F.col("s3")), F.lit(INVENTORY), F.coalesce("items", F.lit(NOTHING)))
    return sections.join(items, "image_id", "left").select("image_id", whole.alias("report"))


def meta_table(entries: Column) -> Column:
    """A markdown table of an ordered array of structs (k, v); empty if there are none."""
    rows = F.transform(entries, lambda e: F.concat(F.lit("| "), e["k"], F.lit(" | "), e["v"], F.lit(" |")))
    whole = F.concat(F.array(F.lit("## ANALYSIS METADATA\n"), F.lit("| Parameter | Value |"), F.lit("|---|---|")), rows, F.array(F.lit("\n")))
    return F.when(F.size(entries) > 0, F.array_join(whole, "\n")).otherwise("")


def meta_entries(path: Column, w: Column, h: Column, kernel: Column, times: Column, rows: Column, cols: Column, model: Column, seconds: Column | None = None) -> Column:
    """The entries of a run's metadata table."""
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    last = [entry("Duration", F.concat(seconds.cast("string"), F.lit("s")))] if seconds is not None else []
    return F.array(entry("Source", exprs.base_name(path)), entry("Image size", F.format_string("%dx%d", w, h)), entry("Dilation", F.format_string("kernel=%d iter=%d", kernel, times)),
                   entry("Tiles", F.format_string("%d (%dx%d)", rows * cols, rows, cols)), entry("Model", model), *last)


#: Fixed wording of what is measured in a diagram.
LINES, CONNECTIONS, CATEGORIES, CATEGORY = "%d line segments detected, grouped into %d visual categories.", "Estimated distinct connections: %d.", "Line categories:", "  - %s: %d segments"
COLOURS, COLOUR = "Colour legend (auto-detected):", "  - %s: RGB(%d, %d, %d)"
TEXTS, LABELS, MORE = "OCR detected %d text elements.", "Visible labels: ", "  ... and %d more."
GROUPS, GROUP, SHAPES = "%d multi-line label groups detected:", '  - "%s"', "Shapes: %d zones, %d device boxes, %d icons detected."
MOST_LABELS, MOST_GROUPS = 30, 10


def cv_context(lines: Column, connections: Column, categories: Column, legend: Column, texts: Column, groups: Column, zones: Column, devices: Column, icons: Column) -> Column:
    """What a prompt is told of a whole image. categories: structs (key, n); legend: (label, r, g, b); texts: strings; groups: joined labels of several
    texts; all in order, empty arrays where there are none."""
    block = lambda head, rows: F.when(F.size(rows) > 0, F.concat_ws("\n", head, F.array_join(rows, "\n")))
    n = F.size(texts)
    quoted = F.transform(F.slice(texts, 1, MOST_LABELS), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.concat_ws(
        "\n", F.format_string(LINES, lines, F.size(categories)), F.format_string(CONNECTIONS, connections),
        block(F.lit(CATEGORIES), F.transform(categories, lambda c: F.format_string(CATEGORY, c["key"], c["n"]))),
        block(F.lit(COLOURS), F.transform(legend, lambda c: F.format_string(COLOUR, c["label"], c["r"], c["g"], c["b"]))),
        F.format_string(TEXTS, n), F.when(n > 0, F.concat(F.lit(LABELS), F.array_join(quoted, ", "))), F.when(n > MOST_LABELS, F.format_string(MORE, n - MOST_LABELS)),
        block(F.format_string(GROUPS, F.size(groups)), F.transform(F.slice(groups, 1, MOST_GROUPS), lambda g: F.format_string(GROUP, g))),
        F.format_string(SHAPES, zones, devices, icons))


def cv_summary(lines: Column, texts: Column, shapes: Column, clusters: Column) -> Column:
    """Fixed wording, too."""
    return F.format_string("- **Lines detected**: %d segments\n- **Text elements**: %d labels extracted via OCR\n- **Shapes detected**: %d (rectangles, circles, polygons)\n"
                           "- **Color categories**: %d distinct line color groups", lines, texts, shapes, clusters)


def full_report(path: Column, stamp: Column, meta: Column, summary: Column, merged: Column) -> Column:
    section = F.when(summary != "", F.concat(F.lit("## COMPUTER VISION FINDINGS\n\n"), summary, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("# Diagram Analysis: "), exprs.base_name(path), F.lit("\n\nGenerated on "), F.date_format(stamp, "yyyy-MM-dd HH:mm"), F.lit(" UTC\n\n"), meta, section, merged, F.lit("\n"))


def rendered(template: Column, context: Column) -> Column:
    """A prompt; its context is put in as it is and isn't read as a template again."""
    return F.replace(template, F.lit("{cv_context}"), F.coalesce(context, F.lit("")))


def tile_context(lines: Column, flat: Column, labels: Column) -> Column:
    """What a tile's prompt is told: lines, of which ``flat`` have an angle under 30 degrees, and labels in order."""
    n = F.size(labels)
    orient = F.when(lines > 0, F.concat(F.lit("Line orientations: mostly "), F.when(flat * 2 > lines, "horizontal").otherwise("mixed"), F.lit(". "))).otherwise("")
    said = F.when(n > 0, F.concat(F.lit("Detected labels: "), F.array_join(F.slice(labels, 1, 10), ", "), F.lit(". "))).otherwise("")
    return F.concat(F.format_string("CV analysis detected %d line segments and %d text labels. ", lines, n), orient, said)
