"""Views that read the driver's tables as diagram records, by integer arithmetic that any SQL engine does alike.

The text of a view is one for Spark and the SQL that results are compared with, but for integer division (``//`` here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: view → (table, columns, condition)
VIEWS = {
    "v_segments": ("orders", """o_orderkey // 50 as image_id, o_orderkey % 50 as ord, (o_orderkey*37)%400 as x1, (o_orderkey*91)%300 as y1,
        (o_orderkey*37)%400 + (o_custkey*13)%120 as x2, (o_orderkey*91)%300 + (o_custkey*29)%90 as y2,
        (o_orderkey*7)%256 as r, (o_custkey*11)%256 as g, (o_orderkey*3+o_custkey)%256 as b, (o_orderkey + o_custkey)%3 = 0 as is_dashed""", "true"),
    "v_texts": ("part", """p_partkey // 40 as image_id, p_partkey % 40 as ord, p_name as text, (p_partkey*53)%900 as x, (p_partkey*29)%600 as y,
        cast(20+p_size as bigint) as width, 8+p_partkey%9 as height""", "true"),
    "v_rects": ("orders", """o_orderkey // 50 as image_id, o_orderkey % 50 as ord, (o_orderkey*17)%1500 as x, (o_orderkey*23)%1000 as y,
        20+(o_orderkey*31)%300 as width, 15+(o_orderkey*41)%200 as height, (20+(o_orderkey*31)%300)*(15+(o_orderkey*41)%200) as area""", "true"),
    "v_images": ("orders", """o_orderkey as image_id, 200+(o_orderkey*131)%6000 as w, 150+(o_orderkey*173)%4500 as h,
        cast(o_orderkey%25 as double)/100 as line_density, cast(o_orderkey%9 as double)/100 as text_density, 1+cast(o_orderkey%40 as double)/10 as thickness,
        cast(20+o_orderkey%60 as double) as contrast, o_orderkey%13 as colors""", "true"),
    "v_progress": ("orders", "o_orderkey // 12 as image_id, o_orderkey % 12 as tile, o_orderpriority as result", "o_orderkey % 3 = 0"),
    "v_tiles": ("orders", "o_orderkey // 12 as image_id, o_orderkey % 12 as tile, (o_orderkey % 12) // 4 as row_no, o_orderkey % 4 as col_no, case when o_orderkey % 11 = 0 then 'skip' when o_orderkey % 29 = 0 then 'quit' else 'run' end as action", "true"),
}

ANSWER_SQL = """select doc_id // 10 as image_id, doc_id % 10 as ord, array_to_string(list_transform(string_split(text, chr(10)),
    lambda x, i: case when i % 3 = 0 then '* ' || x when i % 2 = 1 then '- ' || x else x end), chr(10)) as result from documents"""
RAW_SQL = """select conv_id, turn, case when turn % 5 = 0 then '<think>' || left(text, 40) || text else left(text, 5) || '<think>' || left(text,
        40) || '</think>' || text end as raw
    from conversations where role = 'assistant'"""
PIXEL_SQL = """select p as image_id, y, x, case when dark then (p*40)%120 else 230 + (7*x+3*y+p)%20 end as b,
    case when dark then (p*23)%90 else 230 + (5*x+y+p)%20 end as g, case when dark then (p*11)%60 else 230 + (x+11*y+p)%20 end as r from (
    select p, y, x, (x between 2 and 12 and y in (4, 10)) or (y between 4 and 10 and x in (2, 12)) or (x+y)%15 = p%15 as dark from (
    select p_partkey as p, unnest(range(16)) as y from part) join (select unnest(range(16)) as x) on true)"""


def sql(name: str) -> str:
    """The view as a subquery of the comparing SQL."""
    own = {"v_answers": ANSWER_SQL, "v_raw_answers": RAW_SQL, "v_pixels": PIXEL_SQL}
    if name in own:
        return own[name]
    table, columns, condition = VIEWS[name]
    return f"select {columns} from {table} where {condition}"


def ctes(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({sql(n)})" for n in names)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "v_answers":
        line = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("* "), x)).when((i + 1) % 2 == 1, F.concat(F.lit("- "), x)).otherwise(x))
        return read(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("image_id"), (F.col("doc_id") % 10).alias("ord"), F.array_join(line, "\n").alias("result"))
    if name == "v_raw_answers":
        raw = F.expr("case when turn % 5 = 0 then '<think>' || left(text, 40) || text else left(text, 5) || '<think>' || left(text, 40) || '</think>' || text end")
        return read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", raw.alias("raw"))
    if name == "v_pixels":
        # a row becomes 256, so few splits of a small file would be all the tasks there are; an image's pixels come from one task
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p")).repartition(tasks, "p")
        grid = parts.select("p", F.explode(F.expr("sequence(0L, 15L)")).alias("y"))
        grid = grid.select("p", "y", F.explode(F.expr("sequence(0L, 15L)")).alias("x"))
        dark = F.expr("(x between 2 and 12 and y in (4, 10)) or (y between 4 and 10 and x in (2, 12)) or (x+y)%15 = p%15")
        pick = lambda a, b: F.when(dark, F.expr(a)).otherwise(F.expr(b))
        return grid.select(F.col("p").alias("image_id"), "y", "x", pick("(p*40)%120", "230 + (7*x+3*y+p)%20").alias("b"),
                           pick("(p*23)%90", "230 + (5*x+y+p)%20").alias("g"), pick("(p*11)%60", "230 + (x+11*y+p)%20").alias("r"))
    table, columns, condition = VIEWS[name]
    return read(spark, sf_dir, table).where(condition).selectExpr(*[c.replace("//", "div").strip() for c in _split(columns)])


def _split(columns: str) -> list[str]:
    """Columns at the commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
