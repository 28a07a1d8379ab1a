"""Tables, documents and lists. Paths are Spark's own: any file system, directories and globs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EDITIONS = "title string, anno_id string, iiif_manifest string"
ENTRIES = "id string, rubric string, year string, type string, entry string, pointer string"
DIGESTS = (
    "id string, date_start string, place string, text string, mentions array<struct<text:string,kind:string>>, "
    "gold array<struct<entity_id:string,status:string,catalogue_digests:int,absent_in_text:boolean,mention:struct<text:string,kind:string>>>"
)
PERSONS = (
    "id string, headword string, label string, subentry string, variants array<string>, aliases array<string>, "
    "profile struct<mention_forms:array<string>,date_min:string,date_max:string,digests:array<string>,places:array<string>,"
    "examples:array<struct<digest_id:string,date:string,text:string>>>"
)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """With a header; blanks after the separator are ignored."""
    return spark.read.csv(path, header=True, schema=schema, ignoreLeadingWhiteSpace=True, enforceSchema=False)


def csv_strings(spark: SparkSession, path: str, separator: str = ",", header: bool = True) -> DataFrame:
    """All columns as strings, named by the header; one pass over the first line only."""
    return spark.read.csv(path, sep=separator, header=header, inferSchema=False, ignoreLeadingWhiteSpace=True)


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a line; blank lines are skipped, as the reader does."""
    return spark.read.schema(schema).json(path)


def json_documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Files that hold one object or a list of objects each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def whole_texts(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Rows (path, text), one for each file."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def listed_texts(paths: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """The wanted files with their text; a missing one has an empty text and missing = true."""
    return paths.join(found, key, "left").select(*paths.columns, F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("missing"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are neither empty nor comments after #: ids, paths, and the like."""
    trimmed = spark.read.text(path).select(F.trim("value").alias("line"))
    return trimmed.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """array<string> parts of corpus lines, split at |, trimmed, without empty ones."""
    parts = F.filter(F.transform(F.split("line", r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    return lines(spark, path).select(parts.alias("parts")).where(F.size("parts") > 0)


def work_list(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows (name, url)."""
    return spark.read.csv(path, sep="\t", schema="name string, url string")


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Rows (path, length) of files below a folder, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", "length")


MANIFEST = (
    "struct<sequences:array<struct<canvases:array<struct<images:array<struct<motivation:string,resource:struct<service:struct<`@id`:string>>>>>>>>,"
    "items:array<struct<items:array<struct<items:array<struct<motivation:string,body:struct<id:string,service:array<struct<id:string,`@id`:string>>>>>>>>>,"
    "metadata:array<struct<label:struct<de:array<string>>,value:struct<de:array<string>>>>>"
)


def manifest_pages(manifests: DataFrame, body: str = "manifest") -> DataFrame:
    """A row (the columns, version, page, image_url, year) for each painted page of a manifest text of version 2 or 3; status tells unknown structures.

    image_url is the service's full picture where there is one, else the body's id.
    """
    read = manifests.withColumn("__m", F.from_json(F.col(body), MANIFEST))
    three = F.flatten(F.transform(F.coalesce(F.col("__m.items"), F.array()), lambda c: F.flatten(F.transform(c["items"], lambda a: F.filter(a["items"], lambda x: x["motivation"] == "painting")))))
    two = F.flatten(F.transform(F.coalesce(F.col("__m.sequences"), F.array()), lambda s: F.transform(s["canvases"], lambda c: c["images"][0]["resource"]["service"]["@id"])))
    full = lambda s: F.when(s.isNotNull(), F.concat(F.regexp_replace(s, "/+$", ""), F.lit("/full/max/0/default.jpg")))
    urls3 = F.transform(three, lambda x: F.coalesce(full(F.get(x["body"]["service"], F.lit(0))["id"]), full(F.get(x["body"]["service"], F.lit(0))["@id"]), x["body"]["id"]))
    urls = F.when(F.col("__m.items").isNotNull(), urls3).when(F.col("__m.sequences").isNotNull(), F.transform(two, full)).otherwise(F.array().cast("array<string>"))
    version = F.when(F.col("__m.items").isNotNull(), 3).when(F.col("__m.sequences").isNotNull(), 2)
    label = F.filter(F.coalesce(F.col("__m.metadata"), F.array()), lambda m: F.get(m["label"]["de"], F.lit(0)).isin("Jahr", "Datierung"))
    year = F.nullif(F.regexp_extract(F.get(F.get(label, F.lit(0))["value"]["de"], F.lit(0)), r"(\d{4})", 1), F.lit(""))
    out = read.select(*[c for c in manifests.columns if c != body], version.alias("version"), F.when(version.isNull(), "unknown structure").otherwise("ok").alias("status"), year.alias("issue_year"), F.posexplode_outer(urls).alias("page", "image_url"))
    return out


def seeded_choice(items: DataFrame, choices: DataFrame, seed: int, id_col: str, choice: str) -> DataFrame:
    """Adds to every item one of the choices, drawn with replacement by a hash of seed and id: the same on any number of partitions.

    choices: rows with an ordinal column ``ordinal`` from 0 without gaps.
    """
    n = choices.agg(F.count("*").alias("__n"))
    drawn = items.crossJoin(F.broadcast(n)).withColumn("__draw", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.greatest("__n", F.lit(1)))).drop("__n")
    return drawn.join(choices.select(F.col("ordinal").alias("__draw"), choice), "__draw", "left").drop("__draw")


def status_of(url: Column, found: Column) -> Column:
    """skipped: already a URL; error: unknown; success."""
    return F.when(url.rlike("^https?://"), "skipped").when(found.isNull(), "error").otherwise("success")
