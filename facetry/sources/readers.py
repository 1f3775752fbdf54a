"""Sources: profile documents, dimension lists, labels, artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.functions.scores import coerce_variant_scores, coerce_vector, variant_number

META = {"id": "string", "name": "string", "type": "string", "continent": "string", "countryCode": "string",
        "latitude": "double", "longitude": "double", "region": "string", "population": "bigint",
        "timeZone": "string", "extendedAt": "string"}

LABEL_SCHEMA = "id string, label int"


def scan_profiles(spark: SparkSession, path: str, glob: str = "data.*.json") -> DataFrame:
    """Raw records of all files: (file, pos, record variant).  A file is an array or one object.

    One document is one value, as JSON arrays cannot be split; files are the
    unit of parallelism.  Unreadable files are left to ``bad_files``.
    """
    docs = _documents(spark, path, glob).where(F.col("doc").isNotNull())
    return spark.sql("""
        SELECT file, item.pos AS pos, item.value AS record
        FROM {docs}, LATERAL variant_explode(doc) AS item""", docs=docs)


def _documents(spark: SparkSession, path: str, glob: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    if not raw.inputFiles():
        raise FileNotFoundError(f"no file {glob} below {path}")
    parsed = F.try_parse_json("value")
    single = F.schema_of_variant(parsed).startswith("OBJECT")
    wrapped = F.when(single, F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]")))).otherwise(parsed)
    return raw.select(F.col("_metadata.file_path").alias("file"), "value", wrapped.alias("doc"))


def bad_files(spark: SparkSession, path: str, glob: str = "data.*.json") -> DataFrame:
    """Files that are not JSON, with their text, for the quarantine sink."""
    return _documents(spark, path, glob).where(F.col("doc").isNull()).select("file", F.col("value").alias("text"))


def entities_of(records: DataFrame) -> DataFrame:
    """Typed metadata of raw records, in file order."""
    get = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind).alias(name)
    return records.select("file", "pos", *[get(n, k) for n, k in META.items()],
                          F.try_variant_get("record", "$.famousDishes", "array<string>").alias("famousDishes"))


def scores_of(records: DataFrame, allow_bool: bool = True) -> DataFrame:
    """Long raw scores (file, pos, kind, raw_key, score), numbers above zero only."""
    pairs = None
    for field, kind in (("ingredients", "ing"), ("cookingMethods", "met")):
        maps = F.try_variant_get("record", f"$.{field}", "map<string,variant>")
        part = records.select("file", "pos", F.lit(kind).alias("kind"), F.explode(maps).alias("raw_key", "_v")).select(
            "file", "pos", "kind", "raw_key", variant_number(F.col("_v"), allow_bool).alias("score"))
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs.where(F.col("score") > 0)


def scan_profiles_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One array file; a missing file, bad JSON or another shape fails the job."""
    other = spark.read.text(path, wholetext=True).where(~F.startswith(F.ltrim("value"), F.lit("[")))
    if not other.isEmpty():
        raise ValueError(f"{path} does not hold an array")
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def scan_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file, or no rows when it is missing or unreadable."""
    try:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
        rows.head(1)
        return rows
    except (AnalysisException, Py4JJavaError):
        return spark.createDataFrame([], schema)


def load_alias_map(spark: SparkSession, path: str) -> DataFrame:
    """{"ingredients": {raw: canonical}, "cookingMethods": {...}} -> (kind, raw_key, canonical)."""
    doc = spark.read.schema("ingredients map<string,string>, cookingMethods map<string,string>").option("multiLine", True).json(path)
    part = lambda field, kind: doc.select(F.lit(kind).alias("kind"), F.explode(field).alias("raw_key", "canonical"))
    return part("ingredients", "ing").unionByName(part("cookingMethods", "met"))


def load_whitelist(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON array of names -> (kind, feature)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.lit(kind).alias("kind"), F.explode(F.from_json("value", "array<string>")).alias("feature")).distinct()


def load_key_catalog(spark: SparkSession, paths: Sequence[str], kind: str, pattern: str = r"^\s*'?([A-Za-z0-9_]+)'?\??\s*:\s*number") -> DataFrame:
    """Keys declared in schema text; the first existing source wins."""
    for path in paths:
        try:
            text = spark.read.text(path)
        except AnalysisException:
            continue
        keys = text.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias("feature")).distinct()
        if keys.head(1):
            return keys.select(F.lit(kind).alias("kind"), "feature")
    return spark.createDataFrame([], "kind string, feature string")


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).json(path)


def scan_artifact(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """First readable built artifact, with coerced score maps and vectors."""
    schema = ("id string, name string, continent string, countryCode string, latitude double, longitude double, "
              "ingredients variant, cookingMethods variant, embedding string, hue2d string")
    for path in paths:
        try:
            rows = spark.read.schema(schema).option("multiLine", True).json(path)
            rows.head(1)
        except (AnalysisException, Py4JJavaError):
            continue
        scores = lambda c: coerce_variant_scores(F.try_variant_get(c, "$", "map<string,variant>")).alias(c)
        return rows.select("id", "name", "continent", "countryCode", "latitude", "longitude",
                           scores("ingredients"), scores("cookingMethods"),
                           coerce_vector(F.col("embedding")).alias("embedding"), coerce_vector(F.col("hue2d")).alias("color_xyz"))
    raise FileNotFoundError(f"no readable artifact among {list(paths)}")


def batch_source(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1) -> DataFrame:
    """Rows handed out in micro-batches of whole files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
