"""Readers: lines, chunks, separated and delimited records, whole files, LIBSVM, TSV, adjacency lists, images, JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.strings import leading_double, leading_int, tokens
from keelson.operators.collection import Registry


def resolve(url: str) -> str:
    """nfs:// paths are local ones, hdfs:// and the schemes Spark knows stay; others are an error."""
    if url.startswith("nfs://"):
        return "file://" + url[len("nfs:/") :].replace("//", "/")
    if re.match(r"(hdfs|file|viewfs|s3a|abfss|gs)://", url) or "://" not in url:
        return url
    raise ValueError(f"unknown scheme: {url}")


def read_lines(spark: SparkSession, url: str, keep_empty: bool = False) -> DataFrame:
    """Lines between \\n; \\r stays, as part of a line."""
    rows = spark.read.option("lineSep", "\n").text(resolve(url))
    return rows if keep_empty else rows.where(F.length("value") > 0)


def read_chunks(spark: SparkSession, url: str, size: int) -> DataFrame:
    """Consecutive records of `size` bytes of each file, the last one shorter: path, index, value."""
    if size < 1:
        raise ValueError("a chunk has a byte or more")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(resolve(url)).where("length > 0")
    at = files.select("path", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("index"))
    return at.select("path", "index", F.expr(f"substring(content, cast(index * {size} + 1 as int), {size})").alias("value"))


def read_separated(spark: SparkSession, url: str, separator: str) -> DataFrame:
    """Text between occurrences of a separator, at which files split over tasks. A separator that begins a file gives no record, nor does one that ends it; two in a row hold an empty record."""
    rows = spark.read.option("lineSep", separator).text(resolve(url))
    rows = rows.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    first = rows.where("_b = 0").groupBy("_f").agg(F.min("_i").alias("_i")).withColumn("_first", F.lit(True))  # a row for each file
    kept = rows.join(first, ["_f", "_i"], "left").where("_first is null or length(value) > 0")
    return kept.select("value")


def between(text: Column, start: str, end: str) -> Column:
    """The texts strictly between each start and the next end; a start without end is an error."""
    pattern = f"(?s)\\Q{start}\\E(.*?)\\Q{end}\\E"
    rest = F.regexp_replace(text, pattern, "")
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    return F.when(F.locate(start, rest) > 0, F.raise_error(F.lit(f"data format error: {start} without {end}"))).otherwise(found)


def read_between(spark: SparkSession, url: str, start: str, end: str) -> DataFrame:
    rows = spark.read.text(resolve(url), wholetext=True)
    return rows.select(F.explode(between(F.col("value"), start, end)).alias("value"))


def read_binary_files(spark: SparkSession, url: str, pattern: str = "") -> DataFrame:
    """Whole files whose path below the base matches a regular expression fully: path, length, content."""
    base, _, given = url.partition(":") if url.count(":") == 1 and "://" not in url else (url, "", "")
    pattern = pattern or given or ".*"
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"bad pattern {pattern}: {e}") from e
    root = re.sub(r"^file:/*", "/", resolve(base)).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(resolve(base))
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), f"^\\Q{root}\\E/", "")
    return files.withColumn("path", relative).where(F.col("path").rlike(f"^(?:{pattern})$")).select("path", "length", "content")


def parse_libsvm(lines: DataFrame, column: str = "value") -> DataFrame:
    """label idx:val ... with idx from 1, to label, sparse features from 0."""
    words = tokens(F.col(column), " \t")
    entry = lambda w: F.struct((leading_int(F.substring_index(w, ":", 1)) - 1).cast("int").alias("fea"), leading_double(F.split_part(w, F.lit(":"), F.lit(2))).alias("val"))
    rows = lines.select(words.alias("w")).where(F.size("w") > 0)
    return rows.select(leading_double(F.col("w")[0]).alias("label"), F.transform(F.slice("w", 2, F.size("w")), entry).alias("features"))


def feature_count(sparse: DataFrame, features: str = "features") -> int:
    """The largest index plus one, over all rows."""
    return sparse.agg(F.max(F.array_max(F.transform(features, lambda e: e["fea"])))).first()[0] + 1


def read_libsvm(spark: SparkSession, url: str, features: int | None = None) -> tuple[DataFrame, int]:
    """Rows and the number of features (the largest index unless given)."""
    rows = parse_libsvm(read_lines(spark, url))
    return rows, features or feature_count(rows)


def parse_tsv(lines: DataFrame, column: str = "value") -> DataFrame:
    """Numbers between blanks or tabs; the last is the label."""
    rows = lines.select(F.transform(tokens(F.col(column), " \t"), leading_double).alias("x")).where(F.size("x") > 0)
    return rows.select(F.element_at("x", -1).alias("label"), F.expr("slice(x, 1, size(x) - 1)").alias("features"))


def read_tsv(spark: SparkSession, url: str) -> DataFrame:
    return parse_tsv(read_lines(spark, url))


def load_points(spark: SparkSession, url: str, kind: str) -> DataFrame:
    if kind == "libsvm":
        return read_libsvm(spark, url)[0]
    if kind == "tsv":
        return read_tsv(spark, url)
    raise ValueError(f"unknown data format: {kind}")


def parse_adjacency(lines: DataFrame, separators: str = " \t", column: str = "value") -> DataFrame:
    """src n d1 d2 ... to id, adj; the count is not used."""
    rows = lines.select(tokens(F.col(column), separators).alias("w")).where(F.size("w") > 0)
    return rows.select(leading_int(F.col("w")[0]).alias("id"), F.transform(F.slice("w", 3, F.size("w")), leading_int).alias("adj"))


def edges_of(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("id").alias("src"), F.explode("adj").alias("dst"))


def parse_images(lines: DataFrame, column: str = "value", top: float = 255.0) -> DataFrame:
    """label,p0,p1,... to label and sparse features p / top, zeros left out."""
    v = F.transform(F.split(column, ","), leading_double)
    rows = lines.where(F.length(column) > 0).select(v.alias("v"))
    scaled = F.transform(F.expr("slice(v, 2, size(v))"), lambda x, i: F.struct(i.alias("fea"), (x / top).alias("val")))
    return rows.select(F.col("v")[0].cast("int").alias("label"), F.filter(scaled, lambda e: e["val"] != 0).alias("features"))


def read_json_documents(spark: SparkSession, url: str, schema: str | None = None, query: Column | None = None) -> DataFrame:
    """JSON documents, one a line: as text, or parsed by a schema; `query` filters at the source."""
    if schema is None:
        return read_lines(spark, url)
    rows = spark.read.schema(schema).json(resolve(url))
    return rows if query is None else rows.where(query)


def read_mongodb(spark: SparkSession, uri: str, database: str, collection: str, pipeline: str | None = None) -> DataFrame:
    """A MongoDB collection, where the cluster has that connector; its partitioner makes the splits."""
    reader = spark.read.format("mongodb").option("connection.uri", uri).option("database", database).option("collection", collection)
    return (reader.option("aggregation.pipeline", pipeline) if pipeline else reader).load()


#: Input formats by name.
FORMATS = Registry("format")
for _name, _reader in (("lines", read_lines), ("chunks", read_chunks), ("separated", read_separated), ("between", read_between), ("binary", read_binary_files), ("libsvm", read_libsvm), ("tsv", read_tsv), ("json", read_json_documents), ("mongodb", read_mongodb)):
    FORMATS.create(_reader, _name)


def load(rows: DataFrame, parse: Column | None = None, where: Column | None = None, explode: Column | None = None, name: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Scan then parse: keep rows `where`, one output row for each element of `explode`, or the columns of `parse`, beside the columns `keep`."""
    rows = rows if where is None else rows.where(where)
    if explode is not None:
        return rows.select(*(keep or []), F.explode(explode).alias(name))
    return rows if parse is None else rows.select(*(keep or []), parse.alias(name))
