"""Readers: transcripts with their sidecars, uploads as bytes, and the JSON documents of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from agendum.functions import text as X

# fixed value: what stands for a transcript that can't be read
NO_TRANSCRIPT = (
    "[NO TRANSCRIPT AVAILABLE] The rule-based STT baseline cannot decode audio. "
    "Upload a .txt transcript instead, or enable the Whisper backend "
    "(MOM_STT_BACKEND=whisper) once Person A's model is wired in."
)
MOST_TEXT, MOST_AUDIO = 5 << 20, 200 << 20


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in names]


def uploads(spark: SparkSession, path: str, content_types: DataFrame | None = None) -> DataFrame:
    """(path, name, kind, size, sha256, accepted, reason) of files, one row a file. content_types (name, content_type)
    says what senders claim; a file that isn't named there is of a type that fits any kind.

    A transcript of white space alone is `empty`; so is a file of 0 bytes, which Spark's scan leaves out and the store's
    listing (names only) adds.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    files = files.unionByName(_empty_files(spark, path))
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name"), X.upload_kind(name).alias("kind"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    rows = rows.withColumn("content_type", F.lit(None).cast("string")) if content_types is None else rows.join(content_types, "name", "left")
    text = F.col("kind") == "transcript"
    reason = (
        F.when(F.col("kind").isNull(), "unsupported_extension").when(~X.content_type_allowed(F.col("content_type"), F.col("kind")), "unsupported_media_type").when(F.col("size") == 0, "empty")
        .when(F.col("size") > F.when(text, MOST_TEXT).otherwise(MOST_AUDIO), "too_large").when(text & ~X.looks_like_text(F.col("content")), "not_text").when(~text & ~X.looks_like_audio(F.col("content")), "not_audio").when(text & (X.strip(F.col("content").cast("string")) == ""), "empty")
    )
    return rows.select("path", "name", "kind", "size", "sha256", reason.isNull().alias("accepted"), reason.alias("reason"))


def _empty_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files of 0 bytes below a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, names = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        file = found.next()
        if file.getLen() == 0 and not file.getPath().getName().startswith(("_", ".")):
            names.append((file.getPath().toString(), 0, bytearray()))
    return spark.createDataFrame(names, "path string, length long, content binary")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text, origin): a text file's own text, else its `.txt` sidecar's, else a notice."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = files.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), ext.alias("ext"), X.strip(F.make_valid_utf8(F.col("content").cast("string"))).alias("body"))
    own = rows.groupBy("stem").agg(F.max(F.when(F.col("ext").isin(".vtt", ".md") & (F.col("body") != ""), F.col("body"))).alias("main"), F.max(F.when((F.col("ext") == ".txt") & (F.col("body") != ""), F.col("body"))).alias("side"), F.bool_or(~F.col("ext").isin(".txt", ".vtt", ".md")).alias("audio"))
    text = F.coalesce("main", "side", F.lit(NO_TRANSCRIPT))
    origin = F.when(F.col("main").isNotNull(), "uploaded-transcript").when(F.col("side").isNotNull() & F.col("audio"), "sidecar-transcript").when(F.col("side").isNotNull(), "uploaded-transcript").otherwise("placeholder")
    return own.select("stem", text.alias("text"), origin.alias("origin"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(scenario, language, decisions, actions) of annotations whose scenarios are an object by name."""
    item = "array<struct<text:string,owner_name:string,deadline:string>>"
    found = spark.read.schema(f"scenarios map<string,struct<language:string,decisions:{item},actions:{item}>>").json(path, multiLine=True)
    return found.select(F.explode("scenarios").alias("scenario", "s")).select("scenario", "s.*")


def word_pairs(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.schema("pairs array<struct<id:string,error_type:string,reference:string,hypothesis:string>>").json(path, multiLine=True)
    return found.select(F.inline("pairs"))


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """The scenarios of a manifest: slug, title, language, purpose, what is expected, its files and their sizes."""
    one = "slug:string,title:string,language:string,purpose:string,expected:struct<decisions:int,actions:int,code_mixed:boolean,pii:int>,transcript:string,audio:string,words:int,audio_file_seconds:double,notional_spoken_seconds:double"
    found = spark.read.schema(f"scenarios array<struct<{one}>>").json(path, multiLine=True)
    return found.select(F.inline("scenarios"))
