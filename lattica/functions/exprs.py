"""Column functions: rounding, strings, boxes and colours. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() knows it.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def half_even(x: Column) -> Column:
    """Nearest integer, ties to even."""
    return F.rint(x).cast("long")


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def lines_of(s: Column) -> Column:
    return F.split(s, LINE_BREAK)


def is_bullet(line: Column) -> Column:
    """A stripped line that begins with a dash or an asterisk and has more than three characters."""
    return line.rlike("^[-*]") & (F.length(line) > 3)


def bullet_key(line: Column) -> Column:
    """What makes two bullets the same: their text in lower case, without marks and spaces around it."""
    return stripped(F.lower(F.regexp_replace(line, "^[-* ]+", "")))


def without_thinking(s: Column) -> Column:
    """Closed think blocks go; an open one stays."""
    return stripped(F.regexp_replace(s, "(?s)<think>.*?</think>", ""))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/.])\.[^./]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def segment_length(x1, y1, x2, y2) -> Column:
    return F.bround(F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 2)


def segment_angle(x1, y1, x2, y2) -> Column:
    return F.bround(F.degrees(F.atan2(F.abs(y2 - y1), F.abs(x2 - x1))), 2)


def box_gap2(a: str, b: str) -> Column:
    """Squared gap of two boxes (structs x, y, width, height); 0 where they overlap."""
    axis = lambda p, s: F.greatest(F.lit(0), F.col(f"{a}.{p}") - F.col(f"{b}.{p}") - F.col(f"{b}.{s}"), F.col(f"{b}.{p}") - F.col(f"{a}.{p}") - F.col(f"{a}.{s}"))
    dx, dy = axis("x", "width"), axis("y", "height")
    return dx * dx + dy * dy


def overlap_area(a: str, b: str) -> Column:
    side = lambda p, s: F.greatest(F.lit(0), F.least(F.col(f"{a}.{p}") + F.col(f"{a}.{s}"), F.col(f"{b}.{p}") + F.col(f"{b}.{s}")) - F.greatest(f"{a}.{p}", f"{b}.{p}"))
    return side("x", "width") * side("y", "height")


def iou(a: str, b: str) -> Column:
    both = overlap_area(a, b)
    union = F.col(f"{a}.width") * F.col(f"{a}.height") + F.col(f"{b}.width") * F.col(f"{b}.height") - both
    return F.when(union > 0, both / union).otherwise(0.0)


def rgb_name(r: Column, g: Column, b: Column) -> Column:
    """The name of a colour: dark and colourless ones first, then by the largest channel (red before green before blue)."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    warm = F.when((g > b) & (g > 100), "yellow").otherwise("red")
    fresh = F.when((b > r) & (b > 100), "teal").otherwise("green")
    cold = F.when((r > g) & (r > 100), "purple").otherwise("blue")
    name = (F.when(top < 40, "black").when((top - low < 30) & (top > 180), "white").when(top - low < 30, "gray")
            .when((r >= g) & (r >= b), warm).when((g >= r) & (g >= b), fresh).otherwise(cold))
    return F.concat(name, F.lit("_lines"))


def quantised_key(r: Column, g: Column, b: Column, dashed: Column) -> Column:
    q = lambda c: F.floor(c / 32) * 32
    return F.format_string("(%d,%d,%d)_%s", q(r), q(g), q(b), F.when(dashed, "dashed").otherwise("solid"))


def contour_type(vertices: Column, area: Column, perimeter: Column) -> Column:
    circular = F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter)).otherwise(0.0)
    return F.when(vertices == 4, "rectangle").when(circular > 0.75, "circle").otherwise("polygon")


def axis_positions(length: Column, n: Column, overlap: float) -> Column:
    """Origin and size of n tiles along an axis, the first at its start and the last at its end."""
    size = F.greatest(F.lit(1), F.least(half_even(length / (1 + (1 - overlap) * (n - 1))), length))
    step = (length - size) / (n - 1)
    at = lambda i: F.greatest(F.lit(0), F.least(half_even(step * i), length - size))
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("long").alias("i"), at(i).cast("long").alias("origin"), F.least(size, length - at(i)).cast("long").alias("size")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("origin"), length.cast("long").alias("size")))
    return F.when(n == 1, one).otherwise(many)


def scaled_to(w: Column, h: Column, target: int) -> tuple[Column, Column]:
    longest = F.greatest(w, h)
    return half_even(w * (target / longest)), half_even(h * (target / longest))
