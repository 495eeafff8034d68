"""Exact deduplication by a log-structured merge index, with DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space has become one space.

* **Memtables and runs.** Each task's part of a batch is a memtable. It flushes one *run*, a Parquet file of its digests
  with their identifiers, sorted by digest, with a Bloom filter on the digest and the fences (least and largest digest)
  that Parquet keeps for each row group. Nothing is shuffled for that.
* **Compaction.** Runs are merged by digest; the smallest identifier survives. The merged level is sorted as well. Later
  batches flush further runs and are compacted with the level that is there.
* **Lookup.** Single digests are looked up through fences and filters (``find``). Documents are looked up by a join with
  the digests of more than one row, which Spark filters by a Bloom filter of its own before a large shuffle. Hits are
  verified byte by byte against the text of the row that stays. A hit that fails is a document of its own.

Defined cases: a null text counts as empty, and all such texts are one group; a null identifier counts as larger than
all others; rows that repeat the same identifier and text are members of their group, each counted and each with the
same ``kept``; ``kept_rows`` returns only one of them. Extra columns are ignored by ``lookup`` and carried by
``kept_rows``, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import broadcast_if_small, scratch_path, text_or_empty

#: Runs of white space other than one lone space. Lone spaces stay as they are, so they need no replacement.
SPACE_RUN = r"(?:[\x09-\x0D]|\x20(?=[\x20\x09-\x0D]))[\x20\x09-\x0D]*"
#: Digests with copies are broadcast up to so many rows (about 100 bytes each); beyond, the lookup shuffles.
BROADCAST_ROWS = 200_000
#: Groups of copies are verified in parts of about so many rows.
PART_ROWS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, " ")


class DigestIndex:
    """A log-structured merge index of text digests in a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "digests")
        self.pending: list[str] = []
        self.level: str | None = None
        self.generation = 0

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}"
        (df.write.option("parquet.bloom.filter.enabled#digest", "true")
           .option("parquet.bloom.filter.expected.ndv#digest", "1000000").parquet(path))
        return path

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add a batch of documents: one sorted run for each memtable."""
        self.generation += 1
        one = F.lit(1).cast("long")
        rows = docs.select(F.sha2(normalised(text_or_empty(text_col)), 256).alias("digest"), F.col(id_col).alias("id"), one.alias("rows"), one.alias("at_id"))
        self.pending.append(self._write(rows.sortWithinPartitions("digest", "id"), f"runs-{self.generation}"))

    def compact(self) -> None:
        """Merge all pending runs and the level below them into one sorted level."""
        paths = self.pending + ([self.level] if self.level else [])
        if not paths:
            raise ValueError("nothing was flushed")
        entries = None
        for path in paths:
            part = self.spark.read.parquet(path).select("digest", "id", "rows", "at_id")
            entries = part if entries is None else entries.unionByName(part)
        merged = _merged(entries).sortWithinPartitions("digest")
        self.generation += 1
        self.level, self.pending = self._write(merged, f"level-{self.generation}"), []

    def entries(self) -> DataFrame:
        """digest, id (the smallest), rows (of the group), at_id (rows that carry the smallest id)."""
        return self.spark.read.parquet(self.level)

    def find(self, digests: list[str]) -> DataFrame:
        """The entries of some digests: row groups whose fences or filters rule them out aren't read. Runs that aren't compacted yet count as well."""
        parts = [self.spark.read.parquet(path).where(F.col("digest").isin(digests)) for path in [*self.pending, *([self.level] if self.level else [])]]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return _merged(every)


def _merged(entries: DataFrame) -> DataFrame:
    """One row for each digest. Rows of an identifier are summed first, so a digest of any number of rows is no one task's."""
    least = F.expr("min_by(at_id, struct(id is null, id))").alias("at_id")
    by_id = entries.groupBy("digest", "id").agg(F.sum("rows").alias("rows"), F.sum("at_id").alias("at_id"))
    return by_id.groupBy("digest").agg(F.expr("min_by(id, struct(id is null, id))").alias("id"), F.sum("rows").alias("rows"), least)


def _looked_up(index: DigestIndex, docs: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """docs as one struct ``row``, with id, digest, keep_id, group_size, at_id and kept; hits are verified."""
    copies = broadcast_if_small(index.entries().where("rows > 1").select(
        F.col("digest").alias("k"), F.col("id").alias("keep"), "rows", "at_id"), broadcast_rows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(id_col).alias("id"), normalised(text_or_empty(text_col)).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).join(copies, F.col("digest") == F.col("k"), "left")
    alone = rows.where("k is null").select("row", "id", "digest", F.col("id").alias("keep_id"),
                                           F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("at_id"))
    hits = rows.where("k is not null")
    # A large group is verified in parts, each with its own copy of the text that stays.
    parts = (F.floor(F.col("rows") / PART_ROWS) + 1).cast("int")
    keepers = (hits.where("id <=> keep").select(F.col("digest").alias("kept_digest"), F.col("body").alias("kept_body"), parts.alias("parts"))
               .groupBy("kept_digest").agg(F.min("kept_body").alias("kept_body"), F.max("parts").alias("parts"))
               .select("kept_digest", "kept_body", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("kept_part")))
    hits = hits.withColumn("part", F.pmod(F.xxhash64("id", F.struct("row")), parts).cast("int"))
    same = F.col("body") == F.col("kept_body")
    verified = hits.join(keepers, (F.col("digest") == F.col("kept_digest")) & (F.col("part") == F.col("kept_part"))).select(
        "row", "id", "digest", F.when(same, F.col("keep")).otherwise(F.col("id")).alias("keep_id"),
        F.when(same, F.col("rows")).otherwise(F.lit(1)).cast("long").alias("group_size"),
        F.when(same, F.col("at_id")).otherwise(F.lit(1)).cast("long").alias("at_id"))
    return alone.unionByName(verified).withColumn("kept", F.expr("id <=> keep_id"))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DigestIndex:
    index = DigestIndex(docs.sparkSession)
    index.flush(docs, id_col, text_col)
    index.compact()
    return index


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document: its identifier, keep_id, group_size, kept, text_sha256."""
    found = _looked_up(build(docs, id_col, text_col), docs.select(id_col, text_col), id_col, text_col, broadcast_rows)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat identifier and text, one."""
    found = _looked_up(build(docs, id_col, text_col), docs, id_col, text_col, broadcast_rows).where("kept")
    once = found.where("at_id = 1").select("row")
    repeated = found.where("at_id > 1").groupBy("id", "digest").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(repeated).select(*[F.col("row")[c].alias(c) for c in docs.columns])
