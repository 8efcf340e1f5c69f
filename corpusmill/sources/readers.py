"""Readers and sinks, all on Spark's own text, JSON and Parquet sources; blank lines are skipped."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "ents array<array<string>>, cats string"


def read_jsonl(spark: SparkSession, path: str, ents_field: str = "ents", cats_field: str = "cats") -> DataFrame:
    """text, ents array<struct<start, end, label>>, cats, annotations out of lines ``[text, {fields}]``; a bad line has nulls."""
    v = F.col("value")
    lines = spark.read.text(path).where(F.trim(v) != "")
    raw = F.from_json(F.get_json_object(v, f"$[1].{ents_field}"), "array<array<string>>")
    ents = F.transform(raw, lambda e: F.struct(e[0].try_cast("int").alias("start"), e[1].try_cast("int").alias("end"), F.try_element_at(e, F.lit(3)).alias("label")))
    return lines.select(F.get_json_object(v, "$[0]").alias("text"), ents.alias("ents"), F.get_json_object(v, f"$[1].{cats_field}").alias("cats"), F.get_json_object(v, "$[1]").alias("annotations"))


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """text out of ``path/part/file`` dumps with a JSON object on each line; files whose names begin with a dot are skipped."""
    return json_text(spark.read.text(f"{path.rstrip('/')}/*/*").where(F.trim("value") != ""))


def json_text(lines: DataFrame, column: str = "value", field: str = "text") -> DataFrame:
    return lines.select(F.get_json_object(column, f"$.{field}").alias("text"))


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(sent, lines): lines of blocks that blank lines divide. Ids are by file and place, unique and in order.

    Files are split at blank lines as their first line ends, with a line feed or with a carriage return before it; where files of
    both kinds are mixed, the others' blocks are cut afterwards.
    """
    head = spark.read.option("lineSep", "\n").text(path).first()
    end = "\r\n\r\n" if head and head["value"].endswith("\r") else "\n\n"
    b = spark.read.option("lineSep", end).text(path).select(F.explode(F.split("value", r"(?:\r?\n){2,}")).alias("value"))
    b = b.select(F.monotonically_increasing_id().alias("sent"), F.split(F.trim(F.regexp_replace("value", "\r", "")), "\n").alias("lines"))
    return b.select("sent", F.filter("lines", lambda x: (F.trim(x) != "") & ~x.startswith("# ") & (x != "#")).alias("lines")).where(F.size("lines") > 0)


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """sent, pos, form, space_after: false where the last column has SpaceAfter=No."""
    rows = _blocks(spark, path).select("sent", F.posexplode("lines").alias("pos", "line"))
    cells = F.split("line", "\t")
    return rows.select("sent", "pos", F.try_element_at(cells, F.lit(2)).alias("form"), ~F.coalesce(F.try_element_at(cells, F.lit(10)), F.lit("")).contains("SpaceAfter=No")).toDF("sent", "pos", "form", "space_after")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """sent, pos, token, tag, iob out of lines of three columns."""
    rows = _blocks(spark, path).select("sent", F.posexplode("lines").alias("pos", "line"))
    c = F.split(F.trim("line"), r"\s+")
    return rows.select("sent", "pos", *[F.try_element_at(c, F.lit(i + 1)).alias(n) for i, n in enumerate(("token", "tag", "iob"))])


def read_vectors(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """word, idx, vector out of the text format with a header ``n d``; of a repeated word the last row counts.

    A row of another dimension fails the job when it is read. ``limit``: vectors read, by place in the file; all by default.
    """
    head = spark.read.text(path).first()["value"].split()
    dim = int(head[1])
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.split(F.rtrim("value"), " ").alias("c")).where((F.col("at") > 0) & (F.size("c") > 1))
    if limit is not None:
        rows = rows.orderBy("at").limit(limit)
    vector = F.transform(F.slice("c", F.lit(2), F.size("c") - 1), lambda x: x.cast("double"))
    checked = F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(F.concat(F.lit("a vector whose dimension isn't that of the header: "), F.col("c")[0])).cast("array<double>"))
    return rows.select(F.col("c")[0].alias("word"), (F.col("at") - 1).alias("idx"), checked.alias("vector")).groupBy("word").agg(F.max(F.struct("idx", "vector")).alias("r")).select("word", "r.idx", "r.vector")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """ids array<bigint> out of lines of ids between spaces."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.transform(F.split(F.trim("value"), " +"), lambda x: x.cast("long")).alias("ids"))


def read_pairs(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """word and a number out of lines ``word n``; lines of another form are passed over."""
    c = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(c.alias("c")).where(F.size("c") == 2)
    return rows.select(F.col("c")[0].alias("word"), F.col("c")[1].try_cast("long").alias(name)).where(F.col(name).isNotNull())


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("word")).where("word <> ''")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (in order of files and lines), text: one document a line."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def read_mapping(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_mapping(mapping: dict, path: str) -> None:
    Path(path).write_text(json.dumps(mapping, ensure_ascii=False, indent=1), encoding="utf-8")


def write_bigrams(pairs: DataFrame, path: str) -> None:
    """Lines ``a b`` tab count tab score of phrase candidates (a, b, count, npmi)."""
    pairs.select(F.concat_ws("\t", F.concat_ws(" ", "a", "b"), F.col("count").cast("string"), F.col("npmi").cast("string"))).write.mode("overwrite").text(path)


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """a, b, count, npmi."""
    c = F.split("value", "\t")
    p = F.split(c[0], " ", 2)
    return spark.read.text(path).where("value <> ''").select(p[0].alias("a"), p[1].alias("b"), c[1].try_cast("long").alias("count"), F.get(c, 2).try_cast("double").alias("npmi"))


def write_extension(vocab: DataFrame, path: str, size: int) -> None:
    """Lines ``id`` tab word tab count of the words that a vocabulary has beyond its first ``size`` ids."""
    vocab.where(F.col("id") >= size).select(F.concat_ws("\t", F.col("id").cast("string"), "word", F.col("count").cast("string"))).write.mode("overwrite").text(path)


def write_codes(codes: DataFrame, path: str) -> None:
    """An encoder's values and codes, as JSON lines."""
    codes.select(F.to_json(F.struct("value", "code")).alias("line")).write.mode("overwrite").text(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, code long").json(path)


def write_counts(counts: DataFrame, path: str, key: str = "word", value: str = "count") -> None:
    """Lines of key, tab, value."""
    counts.select(F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string"))).write.mode("overwrite").text(path)
