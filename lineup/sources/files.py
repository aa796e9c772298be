"""File sources and sinks (S1, S5, S10-S14, P18, U2) and the JDBC reader (S3)."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path, schema: StructType | str, date_format: str = "yyyy-MM-dd",
             mode: str = "PERMISSIVE") -> DataFrame:
    """S1 + S5: CSV with an explicit schema (no inference pass over the data), columns found by
    the name in each file's header, not by their place.  In PERMISSIVE mode a malformed row keeps
    NULLs and, when the schema has a ``_corrupt_record`` column, its raw text.  A file
    that lacks a column is an error; ``scan_csv`` sets such files aside."""
    df, rejected = scan_csv(spark, [path], schema, date_format=date_format, mode=mode, base=path)
    if rejected:
        raise ValueError(f"unreadable files: {rejected[:5]}")
    return df


def scan_csv(spark: SparkSession, paths, schema: StructType | str, required=None, date_format: str = "yyyy-MM-dd",
             mode: str = "PERMISSIVE", base: str | None = None,
             source_col: str | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """S12 + U2: many CSV files whose headers differ in order, spelling (``normalize_headers``) or
    further columns, as one table, and the files that were set aside as ``(path, reason)``.

    The first line of every file is read on the driver (files, not rows).  Files are grouped by header,
    each group is one scan with that header's column order, and the groups are united by
    name.  A file without a ``required`` column (by default all of the schema), an empty file
    and a missing path are set aside; a column that is not required and not there is NULL.  Under ``base``
    folders named ``column=value`` give columns.  It is an error if no file is left.
    """
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    corrupt = spark.conf.get("spark.sql.columnNameOfCorruptRecord")
    rejected: list[tuple[str, str]] = []
    files: list[str] = []
    roots = existing_paths(spark, paths)
    rejected += [(p, "missing") for p in paths if p not in roots]
    for root in roots:
        files += data_files(spark, root)
    if not roots:
        raise FileNotFoundError("none of the listed inputs exists")

    groups: dict[tuple[str, ...], list[str]] = {}
    by_folder = {part.split("=", 1)[0] for f in files for part in _below(f, base).split("/")[:-1] if "=" in part} if base else set()
    needed = [f.name for f in schema.fields if f.name != corrupt and f.name not in by_folder] if required is None else list(required)
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda f: first_line(spark, f), files))
    for file, line in zip(files, headers):
        names = normalize_headers(next(csv.reader([line]), [])) if line else []
        absent = [c for c in needed if _plain(c) not in names]
        if not line:
            rejected.append((file, "empty"))
        elif absent:
            rejected.append((file, "lacks " + ", ".join(absent)))
        elif len(set(names)) < len(names):
            rejected.append((file, "repeats a column"))
        else:
            groups.setdefault(tuple(names), []).append(file)
    if not groups:
        raise ValueError(f"no readable file: {rejected[:5]}")

    own = {_plain(f.name): f for f in schema.fields}
    scans = []
    for names, members in groups.items():
        fields = [StructField(own[n].name, own[n].dataType) if n in own else StructField(f"_other_{i}", StringType())
                  for i, n in enumerate(names)]
        fields += [f for f in schema.fields if f.name in by_folder or f.name == corrupt and _plain(corrupt) not in names]
        reader = (spark.read.schema(StructType(fields)).option("header", True).option("dateFormat", date_format)
                  .option("mode", mode))
        if by_folder:
            reader = reader.option("basePath", base)
        df = reader.csv(list(roots) if len(groups) == 1 and not rejected else members)
        have = {f.name for f in fields}
        cols = [F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        scans.append(df.select(*cols, *([F.col("_metadata.file_path").alias(source_col)] if source_col else [])))
    return reduce(DataFrame.unionByName, scans), rejected


def _plain(name: str) -> str:
    return normalize_headers([name])[0]


def _below(path: str, base: str) -> str:
    """``path`` relative to ``base``, whatever scheme either is written with."""
    bare = [p.split(":", 1)[-1].lstrip("/") for p in (path, base)]
    return bare[0].removeprefix(bare[1].rstrip("/")).lstrip("/")


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The files under ``path`` (itself, if it is one), hidden ones left out, in order."""
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    listed = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hp, True)
    out = []
    while listed.hasNext():
        found = listed.next().getPath().toString()
        if not any(part[:1] in ("_", ".") for part in _below(found, path).split("/")):
            out.append(found)
    return sorted(out)


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file (compressed or not), "" for an empty one; no more than a buffer is read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hp = jvm.org.apache.hadoop.fs.Path(path)
    stream = hp.getFileSystem(conf).open(hp)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(hp)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
        codec.createInputStream(stream) if codec is not None else stream, "UTF-8"))
    try:
        return (reader.readLine() or "").removeprefix("\ufeff")
    finally:
        reader.close()


def write_csv(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """CSV sink; ``partition_by`` writes one directory per value and replaces only the
    partitions that ``df`` holds."""
    _writer(df, partition_by, mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Parquet sink, optionally partitioned (for partition pruning on read); as ``write_csv``."""
    _writer(df, partition_by, mode).parquet(path)


def _writer(df: DataFrame, partition_by, mode: str):
    """A writer that, when partitioned and overwriting, stages its files beside the table and moves in
    place of old ones only the partitions that it wrote: a season written again replaces itself, the
    others stay, and a failed write leaves all as it was."""
    if not partition_by:
        return df.write.mode(mode)
    w = df.write.mode(mode).partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    return w.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else w


def existing_paths(spark: SparkSession, paths) -> list[str]:
    """Keep the paths that exist (a driver-side listing, no data read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            out.append(p)
    return out


def read_many(spark: SparkSession, paths, schema, fmt: str = "csv", source_col: str | None = "source_file",
              required=None):
    """S12 + U2: every listed file that exists and has the needed columns, found by name; missing
    ones and those without a needed column are skipped (``scan_csv`` names them), and it is an
    error only if none is left."""
    if fmt == "csv":
        return scan_csv(spark, paths, schema, required, source_col=source_col)[0]
    found = existing_paths(spark, paths)
    if not found:
        raise FileNotFoundError("none of the listed inputs exists")
    df = spark.read.schema(schema).format(fmt).load(found)
    return df.withColumn(source_col, F.col("_metadata.file_path")) if source_col else df


def fresh_only(df: DataFrame, max_age_days: float = 7.0, now=None) -> DataFrame:
    """Rows of files modified within ``max_age_days`` (file metadata column)."""
    now_col = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    age = F.col("_metadata.file_modification_time")
    return df.where(age >= now_col - F.make_dt_interval(secs=F.lit(float(max_age_days * 86400))))


def normalize_headers(names) -> list[str]:
    """A two-level header is joined as ``level0_level1``; then the text is
    stripped, each space becomes '_' and letters are lower-cased."""
    out = []
    for n in names:
        if isinstance(n, (tuple, list)):
            n = "_".join(str(x) for x in n)
        out.append(str(n).strip().replace(" ", "_").lower())
    return out


def with_normalized_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*normalize_headers(df.columns))


def dataset_metadata(df: DataFrame, date_cols=()) -> DataFrame:
    """One row with the row count, the columns, and min / max of each date column."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in date_cols:
        aggs += [F.min(c).cast("string").alias(f"min_{c}"), F.max(c).cast("string").alias(f"max_{c}")]
    return df.agg(*aggs).withColumns({
        "columns": F.array(*[F.lit(c) for c in df.columns]),
        "n_columns": F.lit(len(df.columns)),
    })


def statistics_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose Parquet scans answer counts, minima and maxima from the
    files' footers where those hold them (its settings do not touch the caller's)."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def file_metadata(spark: SparkSession, path: str, date_cols=()) -> DataFrame:
    """``dataset_metadata`` of a written Parquet table and its number of files and bytes, from the
    listing and the footers: no data page is read.  Where a footer lacks a statistic (Spark
    refuses the short cut then), or a column's type is not covered by it, the rows are scanned."""
    try:
        row = dataset_metadata(statistics_session(spark).read.parquet(path), date_cols).first()
    except (PySparkException, Py4JJavaError) as e:
        if "No min/max found" not in str(e):
            raise
        row = dataset_metadata(spark.read.parquet(path), date_cols).first()
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    sizes = [p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(jvm.org.apache.hadoop.fs.Path, data_files(spark, path))]
    fields = ["rows long", *[f"{k}_{c} string" for c in date_cols for k in ("min", "max")], "columns array<string>",
              "n_columns int", "files long", "bytes long"]
    return spark.createDataFrame([(*row, len(sizes), sum(sizes))], ", ".join(fields))


def files_size(df: DataFrame) -> DataFrame:
    """Number and total bytes of the files that a file-based DataFrame reads."""
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 8,
              properties: dict | None = None) -> DataFrame:
    """S3: a database table as a DataFrame.  With a numeric
    ``partition_column`` and bounds the read is split into ``num_partitions``
    parallel range queries; filters and columns are pushed into the SQL."""
    opts = dict(properties or {})
    if partition_column is not None:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                               numPartitions=num_partitions, properties=opts)
    return spark.read.jdbc(url, table, properties=opts)
