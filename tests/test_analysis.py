"""From files to reports: sources, sinks, the three passes and the command line."""

import http.server
import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import __main__ as cli
from lattica import analysis
from lattica.operators import kernels, model
from lattica.sources import images, ocr, sinks
from lattica.streaming import think


def diagram():
    img = np.full((220, 320, 3), 255, np.uint8)
    for x, y, w, h, c in ((20, 20, 120, 80, (0, 0, 200)), (170, 120, 120, 70, (0, 120, 0))):
        img[y:y + 3, x:x + w], img[y + h - 3:y + h, x:x + w] = c, c
        img[y:y + h, x:x + 3], img[y:y + h, x + w - 3:x + w] = c, c
    img[60:62, 140:230] = 0
    return img


@pytest.fixture
def folder(tmp_path):
    for name, img in (("one.png", diagram()), ("two.png", diagram()[::-1])):
        (tmp_path / name).write_bytes(images.png(img))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    return tmp_path


def test_reports_of_a_folder(spark, folder):
    asked = []
    out = cli.run(spark, str(folder), model.stub, "stub", debug=True)
    assert out == [f"{folder}/one.md", f"{folder}/two.md"]
    for path in out:
        report = open(path, encoding="utf-8").read()
        assert report.startswith(f"# Diagram Analysis: {os.path.basename(path)[:-3]}.png\n\nGenerated on ") and " UTC\n\n## ANALYSIS METADATA\n" in report
        assert "| Image size | 320x220 |\n" in report and "| Tiles | 1 (1x1) |" in report and "| Model | stub |" in report
        assert "- **Text elements**: 1 labels" in report and "### Zone (row 0, col 0) at (0, 0)" in report and "<think>" not in report
        assert "- seen " in report.split("## 4. CONSOLIDATED INVENTORY")[1]
    shown = sorted(os.listdir(folder / "debug" / "one.png"))
    assert "01_original.png" in shown and "05_global_view.png" in shown and "05_tile_0_0.png" in shown
    assert not [f for f in os.listdir(folder) if f.startswith(".progress")] and not asked


def test_a_stopped_run_goes_on(spark, folder):
    def failing(prompt, image):
        if "every device" in prompt:
            raise ConnectionError("down")
        return "the whole"

    cli.run(spark, str(folder), failing, "m")
    left = [f for f in os.listdir(folder) if f.startswith(".progress")]
    assert len(left) == 1 and "the whole" in open(folder / "one.md").read()
    known = sinks.read_progress(spark, str(folder / left[0]))
    assert {(r.tile, r.result) for r in known.collect()} == {(-1, "the whole")} and known.count() == 2
    cli.run(spark, str(folder), lambda prompt, image: "- a part", "m")
    report = open(folder / "one.md").read()
    assert "the whole" in report and "- a part" in report and not [f for f in os.listdir(folder) if f.startswith(".progress")]


def test_actions_and_from_tile(spark, folder):
    found = images.read_images(spark, str(folder)).where("height > 0").withColumn("image_id", F.col("origin"))
    params, tiles = analysis.plan(found)
    more = tiles.unionByName(tiles.withColumn("ord", F.lit(1).cast("long")).withColumn("col_no", F.lit(1).cast("long")))
    parts = analysis.measured(found, params, more).persist()
    first = parts.agg(F.min("image_id")).first()[0]
    actions = spark.createDataFrame([(first, 0, "skip")], "image_id string, tile long, action string")
    done = spark.createDataFrame([(first, -1, "seen"), (first, 1, "old")], "image_id string, tile long, result string")
    got = lambda **k: {(r["image_id"] == first, r["pass"], r["ord"]) for r in analysis.asked(parts, model.stub, **k).collect()}
    rest = {(False, "global", 0), (False, "tile", 0), (False, "tile", 1)}
    assert got() == rest | {(True, "global", 0), (True, "tile", 0), (True, "tile", 1)}
    assert got(progress=done, actions=actions) == rest
    assert got(progress=done, from_tile=2) == {(False, "global", 0), (False, "tile", 1), (True, "tile", 1)}
    parts.unpersist()


def test_arguments():
    assert cli.arguments(["a.png", "--from=3", "--debug"]) == (["a.png"], {"--from": "3", "--debug": True})
    assert int(cli.arguments(["--from"])[1]["--from"]) == 1
    assert cli.main([]) == 1 and cli.main(["a", "b"]) == 1


def test_missing_image(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"no")
    assert cli.main([str(tmp_path / "x.png")]) == 1


def test_requests_of_three_passes(spark):
    views = spark.createDataFrame([(1, None, "lines"), (2, None, "")], "image_id long, image binary, context string")
    tiles = spark.createDataFrame([(1, 0, None, "c {cv_context}")], "image_id long, ord long, image binary, context string")
    rows = {(r["pass"], r["image_id"]): r["prompt"] for r in model.requests(views, tiles, tiles).collect()}
    assert rows["global", 1] == model.PROMPTS["global"] + model.MEASURED + "lines" and rows["global", 2] == model.PROMPTS["global"]
    assert rows["tile", 1] == model.PROMPTS["tile"].replace("{cv_context}", "c {cv_context}") and rows["cross", 1].endswith("c {cv_context}")


def test_answers_of_a_server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            for part in ("a<thi", "nk>x</think>", asked["model"]):
                self.wfile.write(json.dumps({"response": part}).encode() + b"\n")
            self.wfile.write(json.dumps({"done": True}).encode() + b"\n")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert list(model.fragments(url, "m", "p", b"x")) == ["a<thi", "nk>x</think>", "m"] and model.http_client(url, "m")("p", None) == "a<think>x</think>m"
    server.shutdown()
    server.server_close()
    with pytest.raises(ConnectionError):
        model.http_client(url, "m", 5)("p", None)


def test_texts_of_images(spark, folder):
    found = images.read_images(spark, str(folder)).withColumn("image_id", F.col("origin"))
    got = ocr.read_texts(found).collect()
    assert [(r.ord, r.text, r.x, r.y, r.width, r.height, r.confidence) for r in got] == [(0, "320x220", 0, 0, 160, 110, 0.9876)] * 2


def test_a_response_that_ends_within_a_tag():
    assert think.split("a<thi", False, "") == ([("a", False)], False, "<thi")


def test_an_end_marker_gives_back_what_is_held(spark, tmp_path):
    rows = [(1, 0, "a<thi"), (1, 1, None), (2, 0, "<think>b</th"), (2, 1, "ink>c"), (2, 2, None)]
    spark.createDataFrame(rows, "response_id long, seq long, fragment string").write.parquet(str(tmp_path / "in"))
    stream = think.pieces(spark.readStream.schema("response_id long, seq long, fragment string").parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {}
    for r in spark.table("ended").orderBy("response_id", "piece_no").collect():
        got.setdefault((r.response_id, r.is_thinking), []).append(r.piece)
    assert {k: "".join(v) for k, v in got.items()} == {(1, False): "a<thi", (2, True): "b", (2, False): "c"}


def test_console_text(spark):
    rows = spark.createDataFrame([("a", True), ("b", False)], "piece string, is_thinking boolean")
    assert [r[0] for r in rows.select(sinks.console_text(F.col("piece"), F.col("is_thinking"))).collect()] == ["\x1b[2ma\x1b[0m", "b"]


def test_zones_and_boxes():
    img = diagram()
    # the line that leaves the first frame belongs to its region
    assert kernels.zone_boxes(img) == [(20, 20, 210, 80), (170, 120, 120, 70)]
    img[60:62, 140:230] = 255
    assert kernels.zone_boxes(img) == [(20, 20, 120, 80), (170, 120, 120, 70)]
    rects = kernels.rectangles(kernels.to_gray(img))
    assert len(rects) >= 1 and all(r["area"] > 5000 for r in rects)
    line = max(kernels.described_lines(img), key=lambda s: s["length"])
    assert line["length"] >= 80 and min(line["angle"], 90 - line["angle"]) < 2 and not line["is_dashed"]
    assert kernels.crop(img, 20, 20, 120, 80, 60).shape == (40, 60, 3) and kernels.crop(img, 20, 20, 120, 80).shape == (80, 120, 3)
    inner = np.zeros((30, 30), bool)
    inner[2:28, 2:28], inner[4:26, 4:26], inner[10:14, 10:14] = True, False, True
    assert kernels.components(inner).max() == 2 and kernels.outer(inner).max() == 1


def test_enhancement_against_plain_loops():
    rng = np.random.default_rng(3)
    img = rng.integers(0, 256, (9, 11, 3), dtype=np.uint8)
    cross = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
    near = lambda a, y, x, how: how(a[y + dy, x + dx] for dy, dx in cross if 0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1])
    low = np.array([[[near(img[..., c].astype(int), y, x, min) for c in range(3)] for x in range(11)] for y in range(9)])
    assert (kernels.thickened(img) == low).all()
    closed = np.array([[[near(low[..., c], y, x, max) for c in range(3)] for x in range(11)] for y in range(9)])
    assert (kernels.gaps_closed(img) == closed).all()
    gray = kernels.to_gray(img)
    dark = kernels.ink(gray)
    grown = np.array([[near(dark, y, x, any) for x in range(11)] for y in range(9)])
    out = kernels.lines_enhanced(img, 3, 1)
    assert (out[grown & ~dark] == 0).all() and (out[~(grown & ~dark)] == img[~(grown & ~dark)]).all()
    assert (kernels.thickened(gray) == np.where(grown, 0, 255)).all() and kernels.thickened(img, 3, 0) is img
    assert np.abs(kernels.from_lab(kernels.to_lab(img)).astype(int) - img).max() <= 1
    flat = np.full((16, 16, 3), 90, np.uint8)
    assert np.abs(kernels.contrast_enhanced(img, 2.0, 2).astype(int) - img).max() > 0 and kernels.contrast_enhanced(flat, 2.0, 2).std() == 0


def test_lanczos_against_plain_sums():
    x = np.random.default_rng(5).integers(0, 256, (6, 7), dtype=np.uint8)
    got = kernels.upscaled(x, 3)
    sinc = lambda v: 1.0 if v == 0 else np.sin(np.pi * v) / (np.pi * v)

    def weights(n, k):
        at = (k + 0.5) / 3 - 0.5
        low = int(np.floor(at))
        w = [(min(max(low + t, 0), n - 1), sinc(at - low - t) * sinc((at - low - t) / 4)) for t in range(-3, 5)]
        total = sum(v for _, v in w)
        return [(i, v / total) for i, v in w]

    for y in range(18):
        for c in range(21):
            want = sum(a * b * x[i, j] for i, a in weights(6, y) for j, b in weights(7, c))
            assert abs(float(got[y, c]) - min(max(want, 0), 255)) <= 0.51
    assert kernels.upscaled(x, 1) is x


def test_clustered_colours():
    points = [(0, 0, 0)] * 6 + [(200, 0, 0)] * 3 + [(0, 0, 200)] * 2
    got = kernels.clustered_colours(points, 3)
    assert [(r["r"], r["g"], r["b"], r["count"]) for r in got] == [(0, 0, 0, 6), (200, 0, 0, 3), (0, 0, 200, 2)] and abs(sum(r["percentage"] for r in got) - 100) < 0.1
    assert kernels.clustered_colours([]) == [] and kernels.clustered_colours([(1, 2, 3)])[0]["count"] == 1


def test_regions_against_a_plain_fill():
    """Labels in reading order, boxes and sizes, without a pass over the image for each region."""
    rng = np.random.default_rng(5)
    for k in range(60):
        mask = rng.random(rng.integers(1, 30, 2)) < rng.random()
        labels = kernels.components(mask, diagonal=bool(k % 2))
        near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if k % 2 or not a or not b]
        want, boxes = np.zeros(mask.shape, np.int32), []
        for y, x in zip(*np.nonzero(mask)):
            if not want[y, x]:
                todo, seen = [(int(y), int(x))], []
                want[y, x] = len(boxes) + 1
                while todo:
                    seen.append(todo.pop())
                    for a, b in near:
                        i, j = seen[-1][0] + a, seen[-1][1] + b
                        if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not want[i, j]:
                            want[i, j] = len(boxes) + 1
                            todo.append((i, j))
                ys, xs = zip(*seen)
                boxes.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(seen)))
        assert (labels == want).all() and kernels.regions(labels) == boxes


def test_zones_without_a_call_for_each_image(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["detect_zones_kernel"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
