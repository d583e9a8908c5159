"""Sources and sinks: tables from files, registries as documents, history tables, JSON results."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.sources import arrays

#: The history tables and their columns.
TABLES = {
    "analysis_results": "id bigint, algorithm string, input_size bigint, parameters string, timestamp timestamp_ntz",
    "performance_metrics": "id bigint, model_name string, batch_size int, framework string, device string, throughput double, latency_ms double, memory_mb double, parameters string, timestamp timestamp_ntz",
    "data_quality_metrics": "id bigint, dataset_name string, completeness double, uniqueness double, consistency double, accuracy double, parameters string, timestamp timestamp_ntz",
    "suggestions": "id string, title string, description string, code_example string, severity string, justification string, rule_name string, rule_version string, feedback string, timestamp double, ai_explanation string",
    "model_stats": "model_class string, total_instances int, inefficiencies_detected int, suggestions_implemented int, performance_metrics string, last_updated double",
    "feedback_history": "suggestion_id string, feedback string, timestamp double",
}


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; give a schema for large inputs, else types are inferred in a second pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_npz(spark: SparkSession, path: str, array: str | None = None) -> DataFrame:
    """An array of an NPZ file, the first if none is named, as columns c0, c1, ... of doubles; read by ranges of rows, see :mod:`fieldglass.sources.arrays`."""
    arrays.register(spark)
    reader = spark.read.format("arrays").option("path", path)
    return (reader.option("array", array) if array else reader).load().drop("row")


def read_validation(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """A validation set by the ending of its name, and its target: the last column. Other endings are an error."""
    if path.endswith(".csv"):
        df = read_csv(spark, path)
    elif path.endswith(".npz"):
        df = read_npz(spark, path)
    elif path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown kind of validation file: {path}")
    return df, df.columns[-1]


def synthetic(spark: SparkSession, rows: int = 1000, columns: int = 10, seed: int = 42) -> DataFrame:
    """A stand-in validation set of normal columns and a 0/1 target; the same seed gives the same rows."""
    return spark.range(rows, numPartitions=1).select(*[F.randn(seed + i).alias(f"f{i}") for i in range(columns)], (F.rand(seed - 1) > 0.5).cast("int").alias("target"))


def file_kinds(df: DataFrame) -> DataFrame:
    """kind, n: what the files are that a table's rows come from, by their endings; files without rows are not seen."""
    ending = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)(?:\.(?:gz|snappy|zst|bz2))?$", 1))
    kind = F.when(ending.isin("tfrecord", "tfrecords"), "tfrecord").when(ending.isin("parquet", "csv", "json", "orc", "npz"), ending).otherwise("other")
    names = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name")).distinct()
    return names.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


#: The first bytes of a file, in hex, and what it is.
MAGIC = [("50415231", "parquet"), ("4f5243", "orc"), ("4f626a01", "avro"), ("934e554d5059", "npy"), ("504b0304", "zip"), ("1f8b", "gzip"), ("28b52ffd", "zstd"), ("7b", "json"), ("5b", "json")]


def _leading_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = []
        for path in batch.column("path").to_pylist():
            fs, top = arrays.open_path(path)
            with fs.open_input_file(top) as f:
                heads.append(f.read(8))
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(heads, pa.binary())], ["path", "length", "head"])


def kinds_by_content(spark: SparkSession, path: str) -> DataFrame:
    """path, length, kind of every file in a folder (or the one file), by its first bytes, which tasks read; ``text`` if they are printable, ``empty``, else ``other``.

    Files whose names begin with a dot or underscore are left out, as Spark does.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").mapInArrow(_leading_bytes, "path string, length long, head binary")
    start = F.lower(F.hex("head"))
    kind = F.when(F.col("length") == 0, "empty")
    for magic, name in MAGIC:
        kind = kind.when(start.startswith(magic), name)
    printable = F.decode("head", "UTF-8").rlike(r"^[\t\n\r\x20-\x7E]+$")
    return files.select("path", "length", kind.when(printable, "text").otherwise("other").alias("kind"))


def rows_by_kind(spark: SparkSession, path: str) -> DataFrame:
    """kind, n_files, n_rows of a table of Parquet files: kinds by content, rows by the file that Spark says they come from."""
    where = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = spark.read.parquet(path).groupBy(where(F.col("_metadata.file_path")).alias("of")).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds_by_content(spark, path)
    return kinds.join(rows, where(F.col("path")) == F.col("of"), "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def write_json(df: DataFrame, path: str) -> None:
    """A result as JSON lines."""
    df.write.mode("overwrite").json(path)


def int_keyed_to_rows(spark: SparkSession, table: Mapping[int, Mapping[str, float]], key: str) -> DataFrame:
    """An int-keyed mapping of numbers as rows, as results are exported."""
    names = sorted({n for v in table.values() for n in v})
    rows = [(int(k), *[None if v.get(n) is None else float(v[n]) for n in names]) for k, v in sorted(table.items())]
    return spark.createDataFrame(rows, f"{key} int, " + ", ".join(f"{n} double" for n in names))


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The history tables, where they don't exist yet; partition-free Parquet, rows are only appended."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def append(df: DataFrame, table: str, database: str = "default") -> None:
    """Appends rows by column name; columns that are missing become NULL, maps and structs become JSON text."""
    spark = df.sparkSession
    target = spark.table(f"{database}.{table}")
    encoded = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(c) for c in df.columns]
    have = df.select(*encoded)
    have.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema]).write.insertInto(f"{database}.{table}")


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Versions (model, version, created_at, status, metrics, tags) and promotions (model, seq, version, stage, promoted_at, reason) of a registry document; an
    unreadable document is an empty registry."""
    versions = "model string, version string, created_at string, status string, metrics map<string,double>, tags map<string,string>"
    promotions = "model string, seq int, version string, stage string, promoted_at string, reason string"
    doc = spark.read.option("wholetext", True).text(path)
    model = "struct<versions: map<string, struct<created_at: string, status: string, metrics: map<string,double>, tags: map<string,string>>>, promotions: array<struct<version: string, stage: string, promoted_at: string, reason: string>>>"
    found = doc.select(F.explode(F.from_json("value", f"struct<models: map<string, {model}>>")["models"]).alias("model", "m"))
    v = found.select("model", F.explode("m.versions").alias("version", "v")).select("model", "version", "v.created_at", "v.status", "v.metrics", "v.tags")
    p = found.select("model", F.posexplode("m.promotions").alias("seq", "p")).select("model", "seq", "p.version", "p.stage", "p.promoted_at", "p.reason")
    return v.select(*[x.split(" ")[0] for x in versions.split(", ")]), p.select(*[x.split(" ")[0] for x in promotions.split(", ")])


def write_registry(versions: DataFrame, promotions: DataFrame, path: str) -> None:
    """The document back from its tables: one JSON object per model, assembled in the tasks and written as one text file per model."""
    v = versions.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("version", F.struct("created_at", "status", "metrics", "tags"))), lambda a, b: F.when(a["version"] < b["version"], -1).otherwise(1))).alias("versions"))
    p = promotions.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "version", "stage", "promoted_at", "reason"))), lambda x: x.dropFields("seq")).alias("promotions"))
    body = F.to_json(F.struct("versions", F.coalesce("promotions", F.array().cast(p.schema["promotions"].dataType)).alias("promotions")))
    doc = v.join(p, "model", "left").select(F.format_string('{"models": {%s: %s}}', F.to_json(F.array("model")), body).alias("value"))
    doc.select(F.regexp_replace("value", r'^(\{"models": \{)\[(.*?)\]', "$1$2").alias("value")).write.mode("overwrite").text(path)


def config(path: str) -> dict:
    """A JSON configuration file on the driver."""
    with open(path) as f:
        return json.load(f)
