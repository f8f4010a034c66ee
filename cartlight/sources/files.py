"""Readers and writers (A family)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlight import schemas
from cartlight.functions.ranking import top_k


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON record per line; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def read_catalog(spark: SparkSession, path: str, *, schema: str = schemas.DOCUMENT, partitions: int | None = None) -> DataFrame:
    """Products of a document file (plain or gzip).

    A gzip file is one task; the repartition spreads its rows before any work.
    """
    products = spark.read.schema(schema).json(path).select("product.*")
    if "sku_options" in products.columns:
        # JSON keys are text; SKU numbers are integers in every table
        products = products.withColumn("sku_options", F.transform_keys("sku_options", lambda k, _: k.cast("int")))
    return products.repartition(partitions) if partitions else products


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with ``file`` and ``line_no`` (from 0) in file order.

    Lines are numbered inside their split; the splits of a file then get the
    number of lines before them. Only one row per split is exchanged for that.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    sizes = lines.groupBy("file", "_start").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("file", "_start").orderBy("_at")
    numbered = lines.withColumn("_i", F.row_number().over(inside) - 1).join(offsets, ["file", "_start"])
    return numbered.select("file", (F.col("_i") + F.col("_off")).alias("line_no"), "value")


def read_rollouts(spark: SparkSession, path: str, *, step: str = schemas.STEP) -> DataFrame:
    """One trajectory array per line to one row per step: ``file, line_no, pos, step``."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    steps = F.from_json("value", f"array<{step}>")
    return lines.select("file", "line_no", F.posexplode(steps).alias("pos", "step"))


def read_step_dumps(spark: SparkSession, path: str, schema: str, *, pattern: str = r"(\d+)\.jsonl$") -> DataFrame:
    """Dump files with the training step taken from the file path, and the source kept."""
    rows = spark.read.schema(schema).json(path)
    source = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(source, pattern, 1).cast("int").alias("dump_step"), source.alias("source"))


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, half-written lines) of a file that is still being written."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    parsed = text.select(
        "value", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")
    )
    bad = F.col("r._corrupt_record").isNotNull()
    return parsed.filter(~bad).select("r.*").drop("_corrupt_record"), parsed.filter(bad).select("value")


def read_parquet_concat(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of several parquet datasets by column name; missing columns are null."""
    out = spark.read.parquet(paths[0])
    for path in paths[1:]:
        out = out.unionByName(spark.read.parquet(path), allowMissingColumns=True)
    return out


def parse_metric_log(lines: DataFrame, *, text: str = "value") -> DataFrame:
    """``[step N] key=value, ...`` lines to finite ``step, key, value`` rows; the last value of a key wins per line."""
    plain = F.regexp_replace(text, "\u001b\\[[0-9;]*m", "")
    body = F.regexp_extract(plain, r"\[step\s+(\d+)\]\s+(.*)", 2)
    rows = lines.select(
        *[c for c in lines.columns if c != text],
        F.regexp_extract(plain, r"\[step\s+(\d+)\]\s+(.*)", 1).try_cast("int").alias("step"),
        F.posexplode(F.split(body, ", ")).alias("pos", "item"),
    )
    pair = rows.filter(F.col("step").isNotNull() & F.contains("item", F.lit("=")))
    value = F.substring_index("item", "=", -1)
    key = F.expr("trim(left(item, length(item) - length(substring_index(item, '=', -1)) - 1))")
    out = pair.select(*[c for c in pair.columns if c != "item"], key.alias("key"), F.trim(value).try_cast("double").alias("value"))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return out.filter(finite)


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", force: bool = False, partition_by: list[str] | None = None) -> None:
    """Write as json, parquet or csv; an existing target is an error unless forced."""
    writer = df.write.format(fmt).mode("overwrite" if force else "errorifexists")
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


#: Bytes read at a time, and files in flight at most.
CHUNK, FILE_TASKS = 8 << 20, 4096


def _open_file(path: str):
    """A file as Spark names it, opened through pyarrow's file systems."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_stream(inner)


def _digest(path: str) -> tuple[str, int, int]:
    """sha256, lines with more than white space, and bytes of a file, read in chunks."""
    digest, rows, size, begun = hashlib.sha256(), 0, 0, False
    with _open_file(path) as source:
        while chunk := source.read(CHUNK):
            digest.update(chunk)
            size += len(chunk)
            first, *more = chunk.split(b"\n")
            begun = begun or bool(first.strip())  # the line that the last chunk left open
            if more:
                rows += begun + sum(1 for line in more[:-1] if line.strip())
                begun = bool(more[-1].strip())
    return digest.hexdigest(), rows + begun, size


def file_manifest(spark: SparkSession, path: str, *, glob: str = "*.json*") -> DataFrame:
    """``file, sha256, rows, bytes`` of every file below ``path``; rows are lines that are not blank.

    A file is read once, in chunks, by one task, which hashes and counts at
    the same time, so files may be of any size; only names are exchanged (the
    driver has them from listing the folder, as for any read). The folder must
    be reachable through pyarrow's file systems. Empty files count no rows; no
    file at all gives no row.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    names = [unquote(uri) for uri in found.inputFiles()]  # a scan would leave empty files out
    listed = spark.createDataFrame([(name,) for name in names], "path string")

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (name, *_digest(name))], ["file", "sha256", "rows", "bytes"])

    return listed.repartition(max(1, min(len(names), FILE_TASKS))).mapInArrow(read, "file string, sha256 string, rows bigint, bytes bigint")


def line_subset(spark: SparkSession, path: str, *, limit: int) -> DataFrame:
    """First lines of each file; blank ones count, then are dropped."""
    lines = numbered_lines(spark, path)
    return lines.filter((F.col("line_no") < limit) & (F.trim("value") != ""))


def resume_pending(queries: DataFrame, done: DataFrame, *, query: str = "query", order: str) -> DataFrame:
    """Queries without a rollout, first occurrence of each only."""
    first = queries.groupBy(query).agg(F.min(order).alias(order))
    return first.join(done.select(query).distinct(), query, "left_anti")


def row_align_check(left: DataFrame, right: DataFrame, *, line: str = "line_no", key: str) -> DataFrame:
    """Positions where two files disagree: one ends early, or the keys differ."""
    a = left.select(line, F.col(key).alias("left_key"))
    b = right.select(line, F.col(key).alias("right_key"))
    return a.join(b, line, "full_outer").filter(~F.col("left_key").eqNullSafe(F.col("right_key")))


def require_aligned(mismatches: DataFrame) -> DataFrame:
    """Number of mismatches; any mismatch is an error."""
    n = F.count("*")
    return mismatches.agg(F.when(n > 0, F.raise_error(F.lit("files are not aligned")).cast("bigint")).otherwise(n).alias("mismatches"))


def metrics_wide(metrics: DataFrame, *, step: str = "step", key: str = "key", value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """One row per step, one column per metric, names sorted."""
    pivoted = metrics.groupBy(step).pivot(key, sorted(keys) if keys else None).agg(F.max(value))
    return pivoted.select(step, *sorted(c for c in pivoted.columns if c != step))


def run_metadata(df: DataFrame, *, name: str, aliases: dict[str, list[str]] | None = None, overrides: dict[str, Column] | None = None) -> DataFrame:
    """Run settings: override, else the first alias column present, else from the name.

    Names hold ``t02``, ``top_p09``, ``seed1``, ``g8``; a leading 0 is a decimal.
    """
    aliases = aliases or {
        "temperature": ["temperature", "train_temperature", "rollout_temperature"],
        "top_p": ["top_p", "train_top_p", "rollout_top_p"],
        "seed": ["seed", "rollout_seed", "sampling_seed"],
        "group_size": ["group_size", "rollout_n", "n", "G"],
    }
    patterns = {
        "temperature": r"(?i)(?:^|[_-])t(?:emp)?(\d+)(?:[_-]|$)",
        "top_p": r"(?i)(?:^|[_-])top[_-]?p(\d+)(?:[_-]|$)",
        "seed": r"(?i)(?:^|[_-])seed(\d+)(?:[_-]|$)",
        "group_size": r"(?i)(?:^|[_-])g(\d+)(?:[_-]|$)",
    }
    columns = {}
    for key, pattern in patterns.items():
        digits = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
        number = digits.cast("double")
        if key in ("temperature", "top_p"):
            number = F.when(digits.startswith("0"), number / F.pow(F.lit(10.0), F.length(digits) - 1)).otherwise(number / 10)
        known = [F.col(c).cast("double") for c in aliases[key] if c in df.columns]
        first = [overrides[key].cast("double")] if overrides and key in overrides else []
        columns[key] = F.coalesce(*first, *known, number)
    return df.withColumns(columns)


def select_ranges(df: DataFrame, ranges: str, *, line: str = "line_no") -> DataFrame:
    """Rows whose number is in a set such as ``1-5,9``.

    The text is a literal, so the intervals are literals too and the filter is
    pushed to the scan.
    """
    parts = [p.strip() for p in ranges.split(",") if p.strip()]
    keep = F.lit(False)
    for part in parts:
        low, _, high = part.partition("-")
        keep = keep | F.col(line).between(int(low), int(high or low))
    return df.filter(keep)


def range_rows(sets: DataFrame, *, text: str) -> DataFrame:
    """Numbers of range sets held in a column, one row each."""
    part = F.explode(F.split(text, ",")).alias("_p")
    rows = sets.select(*[c for c in sets.columns if c != text], part).filter(F.trim("_p") != "")
    low = F.trim(F.split_part("_p", F.lit("-"), F.lit(1))).cast("bigint")
    high = F.coalesce(F.trim(F.split_part("_p", F.lit("-"), F.lit(2))).try_cast("bigint"), low)
    rest = [c for c in rows.columns if c != "_p"]
    return rows.select(*rest, F.explode(F.sequence(low, high)).alias("line_no")).distinct()


def last_rollout_per_query(steps: DataFrame, *, query: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """Rollout table with one row per query: the last line wins; ``limit`` keeps the first lines only."""
    rows = steps.filter(F.col("line_no") < limit) if limit is not None else steps
    return top_k(rows, [query], [o.desc() for o in order], 1)
