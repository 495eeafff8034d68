"""Golden vectors and properties of the operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import exprs
from lattica.operators import color, graph, kernels, model, resume, text, tiling
from lattica.sources import images
from lattica.streaming import think


def column(spark, value, **inputs):
    """The value of a column over one row of inputs."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()] or ["id"]).select(value).first()[0]


def test_grid_sizes(spark):
    want = {(1024, 1024, 16): (1, 1), (200, 300, 16): (1, 1), (1080, 1920, 16): (2, 3), (1080, 1920, 4): (2, 2), (3000, 4000, 16): (4, 4), (3000, 4000, 4): (2, 2),
            (3000, 4000, 8): (2, 4), (1024, 8000, 4): (1, 4), (6000, 6000, 12): (4, 3), (2160, 3840, 8): (2, 4)}
    for (h, w, most), size in want.items():
        r = tiling.grid_size(spark.createDataFrame([(1, h, w)], "image_id long, h long, w long"), most=most).first()
        assert (r.rows, r.cols) == size, (h, w, most)


def test_axis_positions(spark):
    want = {(1000, 1): [(0, 1000)], (1000, 3): [(0, 400), (300, 400), (600, 400)], (1000, 4): [(0, 308), (231, 308), (461, 308), (692, 308)],
            (1920, 3): [(0, 768), (576, 768), (1152, 768)], (1080, 2): [(0, 617), (463, 617)]}
    for (length, n), positions in want.items():
        got = column(spark, exprs.axis_positions(F.col("l"), F.col("n"), 0.25), l=length, n=n)
        assert [(p.origin, p.size) for p in got] == positions


def test_preprocess_params(spark):
    rows = [(1, 1.5, .02, 40.0, .06), (2, 3.0, .10, 60.0, .01), (3, 4.0, .15, 50.0, .05)]
    got = {r.image_id: r for r in tiling.preprocess_params(spark.createDataFrame(rows, "image_id long, thickness double, line_density double, contrast double, text_density double")).collect()}
    parts = lambda r: (r.upscale_factor, r.morph_iterations, r.close_gaps_kernel, r.clahe_enabled, r.sharpen_amount, r.tile_count)
    assert parts(got[1]) == (2, 2, 3, True, 1.0, 4) and parts(got[2]) == (1, 1, 0, False, 1.5, 12) and parts(got[3]) == (1, 0, 0, False, 1.5, 12)


def test_tiling_params(spark):
    df = spark.createDataFrame([(1, 1080, 1920, .08, .03, 1.5, 7)], "image_id long, h long, w long, line_density double, text_density double, thickness double, colors long")
    r = tiling.tiling_params(df).first()
    assert (r.rows, r.cols, r.overlap) == (2, 5, 0.30)


def test_colour_names_and_legend(spark):
    want = {(0, 50, 200): "blue", (200, 180, 20): "yellow", (200, 90, 20): "red", (20, 200, 150): "teal", (150, 20, 200): "purple", (39, 39, 39): "black",
            (181, 170, 165): "white", (180, 170, 165): "gray", (0, 60, 0): "green"}
    for (r, g, b), name in want.items():
        assert column(spark, exprs.rgb_name(F.col("r"), F.col("g"), F.col("b")), r=r, g=g, b=b) == f"{name}_lines"
    three = spark.createDataFrame([(1, k, 200, 10, 10) for k in range(3)], "image_id long, ord long, r long, g long, b long")
    assert [r.label for r in color.legend(three).orderBy("ord").collect()] == ["red_lines", "red_lines_1", "red_lines_2"]
    assert column(spark, exprs.quantised_key(F.col("r"), F.col("g"), F.col("b"), F.lit(False)), r=31, g=32, b=255) == "(0,32,224)_solid"
    assert column(spark, color.nearest([("A", 0, 0, 0), ("B", 10, 0, 0)], F.col("r"), F.col("g"), F.col("b")), r=5, g=0, b=0) == "A"
    assert column(spark, color.nearest([], F.lit(1), F.lit(1), F.lit(1))) is None


def test_elbow_and_exact_centres(spark):
    runs = spark.createDataFrame([(1, 2, 100), (1, 3, 70), (1, 4, 60), (1, 5, 10), (2, 2, 0), (2, 3, 0)], "image_id long, k long, inertia long")
    assert {r.image_id: r.k for r in color.elbow(runs).collect()} == {1: 3, 2: 2}
    two = spark.createDataFrame([(1, "c", 0, 0, 0), (1, "c", 3, 3, 3)], "image_id long, label string, r long, g long, b long")
    r = color.exact_centres(two).first()
    assert (r.r, r["count"], r.percentage) == (1, 0, 0.0)


def test_strings(spark):
    for said, want in {"a<think>x\ny</think>b": "ab", "a<think>open": "a<think>open", "</think>a": "</think>a"}.items():
        assert column(spark, exprs.without_thinking(F.col("s")), s=said) == want
    assert column(spark, exprs.stripped(F.col("s")), s="  \x85\x1c a b　\n") == "a b"
    assert column(spark, exprs.without_extension(F.col("s")), s="/a.b/c.d.png") == "/a.b/c.d" and column(spark, exprs.without_extension(F.col("s")), s="/a/.png") == "/a/.png"
    assert column(spark, text.rendered(F.lit("x {cv_context} y"), F.col("c")), c="{cv_context} $1") == "x {cv_context} $1 y"
    empty = F.array().cast("array<struct<k:string,v:string>>")
    assert column(spark, text.meta_table(empty)) == ""
    one = F.array(F.struct(F.lit("A").alias("k"), F.lit("1").alias("v")))
    assert column(spark, text.meta_table(one)) == "## ANALYSIS METADATA\n\n| Parameter | Value |\n|---|---|\n| A | 1 |\n\n"


def test_inventory_and_report(spark):
    said = "- FW-1\n* fw-1\n-- x\n---\n**Devices**:\n1. x"
    df = spark.createDataFrame([(1, 0, "global", said), (1, 1, "cross", "a"), (1, 2, "cross", " "), (1, 3, "cross", "b"), (2, 0, "global", "no bullets")], "image_id long, ord long, pass string, result string").selectExpr("*", "0 as row_no", "0 as col_no", "0 as x", "0 as y")
    assert [r.line for r in text.inventory(df.where("image_id = 1")).orderBy("item").collect()] == ["- FW-1", "-- x", "**Devices**:"]
    got = {r.image_id: r.report for r in text.report(df).collect()}
    assert "### Connection group 1\n\na\n" in got[1] and "### Connection group 3\n\nb\n" in got[1] and "group 2" not in got[1]
    assert got[2] == "## 1. OVERVIEW\n\nno bullets\n\n## 2. DETAILED ANALYSIS BY ZONE\n\n## 4. CONSOLIDATED INVENTORY\n\nNo structured inventory items detected."


def test_proximity_equals_all_pairs(spark):
    rng = random.Random(4)
    seg = [(1, k, *(rng.randint(0, 150) for _ in range(4))) for k in range(80)]
    got = {(r.a, r.b) for r in graph.endpoint_edges(spark.createDataFrame(seg, "image_id long, ord long, x1 long, y1 long, x2 long, y2 long")).collect()}
    near = lambda p, q: any((px - qx) ** 2 + (py - qy) ** 2 < 225 for px, py in (p[2:4], p[4:6]) for qx, qy in (q[2:4], q[4:6]))
    assert got == {(p[1], q[1]) for p in seg for q in seg if p[1] < q[1] and near(p, q)}
    box = [(1, k, rng.randint(0, 400), rng.randint(0, 400), rng.randint(1, 90), rng.randint(1, 90)) for k in range(60)]
    df = spark.createDataFrame(box, "image_id long, ord long, x long, y long, width long, height long")

    def gap2(p, q):
        dx = max(0, p[2] - q[2] - q[4], q[2] - p[2] - p[4])
        dy = max(0, p[3] - q[3] - q[5], q[3] - p[3] - p[5])
        return dx * dx + dy * dy

    assert {(r.a, r.b) for r in graph.text_edges(df).collect()} == {(p[1], q[1]) for p in box for q in box if p[1] < q[1] and gap2(p, q) < 900}
    plan = graph.text_edges(df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_distances_at_the_limit(spark):
    two = lambda x: spark.createDataFrame([(1, 0, 0, 0, 500, 500), (1, 1, x, 0, 900, 900)], "image_id long, ord long, x1 long, y1 long, x2 long, y2 long")
    assert graph.endpoint_edges(two(15)).count() == 0 and graph.endpoint_edges(two(14)).count() == 1


def test_merge_boxes():
    assert graph.merge_boxes([(0, 0, 10, 10), (5, 0, 10, 10)]) == [(0, 0, 10, 10), (5, 0, 10, 10)]
    assert graph.merge_boxes([(0, 0, 10, 10), (2, 0, 10, 10)]) == [(0, 0, 12, 10)]
    assert graph.merge_boxes([]) == []


def test_median_split(spark):
    def zones(areas):
        df = spark.createDataFrame([(1, k, a) for k, a in enumerate(areas)], "image_id long, ord long, area long")
        return {r.area for r in tiling.split_by_median(df).where("kind = 'zone'").collect()}

    assert zones([1, 2, 3]) == {2, 3} and zones([1, 2, 3, 4]) == {3, 4} and zones([60000, 10]) == {60000}


def test_resume_with_gaps(spark):
    tiles = spark.createDataFrame([(1, k, "skip" if k in (1, 3) else "run") for k in range(4)], "image_id long, tile long, action string")
    done = spark.createDataFrame([(1, 0, "A"), (1, 2, "C")], "image_id long, tile long, result string")
    assert [r.result for r in resume.answers(tiles, done).orderBy("tile").collect()] == ["A", "", "C", ""]
    assert resume.todo(tiles, done).count() == 0
    stops = tiles.withColumn("action", F.when(F.col("tile") == 1, "quit").otherwise("run"))
    assert [r.tile for r in resume.todo(stops, done.limit(0)).orderBy("tile").collect()] == [0]
    appended = spark.createDataFrame([(1, 0, "old", 1), (1, 0, "new", 2)], "image_id long, tile long, result string, version long")
    assert resume.latest(appended).first().result == "new"


def test_split_tags():
    state, out = (False, ""), []
    for fragment in ("a<thi", "nk>x</", "think>b<", "c"):
        got, *state = think.split(fragment, *state)
        out += got
    assert out == [("a", False), ("x", True), ("b", False), ("<c", False)] and tuple(state) == (False, "")


def test_model_calls(spark):
    requests = spark.createDataFrame([(1, "tile", 0, "p", bytearray(b"xyz")), (1, "tile", 1, "fail", None)], "image_id long, pass string, ord long, prompt string, image binary")

    def client(prompt, image):
        if prompt == "fail":
            raise ConnectionError
        return model.stub(prompt, image)

    got = {r.ord: (r.result, r.error) for r in model.ask(requests, client, workers=2).collect()}
    assert got == {0: ("<think>1</think>- seen 3 bytes", None), 1: (None, "unreachable")}


def test_kernels_on_small_images():
    flat = np.full((20, 30), 77, np.uint8)
    assert (kernels.sharpened(flat) == flat).all() and (kernels.resized(flat, 15, 10) == 77).all() and kernels.resized(flat, 45, 40).shape == (40, 45)
    assert kernels.clahe(flat).shape == flat.shape and not kernels.edges(flat).any() and kernels.shapes(flat) == []
    full = np.ones((6, 6), bool)
    assert kernels.skeleton(full).sum() == 0 and kernels.thickness(full) == 1.0
    bar = np.zeros((9, 40), bool)
    bar[3:6, 2:38] = True
    assert 2 <= kernels.thickness(bar) <= 4
    spots = np.zeros((8, 8), bool)
    spots[0, 0] = spots[1, 1] = spots[5, 5] = True
    assert kernels.components(spots).max() == 2 and kernels.regions(kernels.components(spots))[0] == (0, 0, 2, 2, 2)
    page = np.full((120, 160), 255, np.uint8)
    page[30:90, 40:120] = 0
    found = kernels.shapes(page)
    assert [s["type"] for s in found] == ["rectangle"] and abs(found[0]["cx"] - 80) <= 2 and abs(found[0]["cy"] - 60) <= 2
    page[:] = 255
    page[50, 10:150] = 0
    assert any(abs(x2 - x1) > 100 and abs(y2 - y1) <= 2 for x1, y1, x2, y2 in kernels.line_segments(page))


def test_kmeans():
    data = np.array([[0, 0], [0, 1], [10, 10], [10, 11]])
    centres, label, inertia = kernels.kmeans(data, 2)
    assert inertia == 1.0 and label[0] == label[1] != label[2] == label[3]
    assert len(kernels.kmeans(data[:1], 2)[0]) == 1 and kernels.distinct_colours(np.zeros((1, 3))) == 1


def test_image_source_reads_what_png_writes(spark, tmp_path):
    rng = np.random.default_rng(0)
    img, gray = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8), rng.integers(0, 256, (4, 3), dtype=np.uint8)
    for name, a in (("a", img), ("b", gray)):
        (tmp_path / f"{name}.png").write_bytes(images.png(a))
    (tmp_path / "c.png").write_bytes(b"no image")
    rows = {r.origin[-5:]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    back = lambda r: images.to_array(r.height, r.width, r.channels, bytes(r.data))
    assert (back(rows["a.png"]) == img).all() and (back(rows["b.png"])[..., 0] == gray).all() and rows["c.png"].height == -1
    assert images.read_images(spark, str(tmp_path), True).count() == 2
    with pytest.raises(ValueError):
        images.png(np.zeros((0, 3), np.uint8))


@pytest.mark.parametrize("name", ["close_gray", "enhance_lines", "line_density", "new_line_pixels"])
def test_thresholds_are_found_with_the_pixels(spark, name):
    """A threshold that is joined to the pixels is a broadcast that ends the query where it takes too long."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_thresholds_of_a_batch_are_those_of_its_images():
    from lattica.operators import kernels, pixels

    rng = np.random.default_rng(3)
    images = [rng.integers(0, rng.integers(1, 257), rng.integers(1, 300)) for _ in range(200)] + [np.array([7]), np.array([3, 3]), np.array([0, 255])]
    got = pixels._thresholds(np.repeat(np.arange(len(images)), [len(x) for x in images]), np.concatenate(images))
    assert (got == np.concatenate([np.full(len(x), x.min() if len(set(x)) == 1 else kernels.otsu(x.astype(np.uint8))) for x in images])).all()
