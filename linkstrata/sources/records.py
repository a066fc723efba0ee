"""Readers of records (S1-S13, S16, S24). All return DataFrames; bad records are dropped and can be counted, never fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """``rows`` with the fields of the JSON object in ``column``; broken texts, other values and nulls are no records."""
    kind = f"{schema}, _broken string"
    r = rows.withColumn("_r", F.from_json(column, kind, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    return r.filter("_r is not null and _r._broken is null").select(*rows.columns, "_r.*").drop("_broken")


def json_records(spark: SparkSession, paths: str | list[str], schema: StructType | str) -> DataFrame:
    """Records of JSON files: an array, an object with them under ``data`` or ``items``, or a record a line. Several files follow each other."""
    inner = schema if isinstance(schema, str) else schema.simpleString()
    record = inner if inner.startswith("struct<") else f"struct<{', '.join(inner.split(', '))}>" if ":" in inner else None
    kind = record or StructType.fromDDL(inner).simpleString()
    text = spark.read.text(paths, wholetext=True).withColumn("head", F.substring(F.regexp_replace("value", r"(?s)^[\s\x{feff}]*(\S).*$", "$1"), 1, 1))
    wrapped = F.from_json("value", f"struct<data:array<{kind}>,items:array<{kind}>>")
    lists = text.filter("head = '['").select(F.from_json("value", f"array<{kind}>").alias("a"))
    lists = lists.unionByName(text.filter("head = '{'").select(wrapped.alias("w")).select(F.coalesce("w.data", "w.items").alias("a")).filter("a is not null"))
    lines = text.filter(F.col("head") == "{").filter(F.coalesce(wrapped["data"], wrapped["items"]).isNull())
    lines = lines.select(F.explode(F.split("value", r"\r?\n")).alias("line")).filter("trim(line) <> ''").select(F.from_json("line", kind).alias("r"))
    return lists.select(F.explode("a").alias("r")).unionByName(lines).filter("r is not null").select("r.*")


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(qid, title, description) of tab-separated lines: two cuts at most, blank qids left out, a blank title is the qid, the last line of a qid wins."""
    from linkstrata.operators.gold import last_wins

    part = F.split("value", "\t", 3)
    rows = spark.read.text(path).select(F.trim(part[0]).alias("qid"), F.trim(F.get(part, F.lit(1))).alias("title"), F.trim(F.get(part, F.lit(2))).alias("description"), F.struct("_metadata.file_path", F.monotonically_increasing_id()).alias("at"))
    rows = rows.filter("qid <> ''").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "qid")).withColumn("description", F.coalesce("description", F.lit("")))
    return last_wins(rows, "qid", "at", "title", "description")


def described(spark: SparkSession, path: str, entities: DataFrame) -> DataFrame:
    """``entities`` (name, ...) with ``description`` out of 'name@@@@text' lines, blanks in names written as '_'; the last line wins."""
    from linkstrata.operators.gold import last_wins

    part = F.split("value", "@@@@", 2)
    rows = spark.read.text(path).select(F.trim(part[0]).alias("_name"), F.trim(F.get(part, F.lit(1))).alias("description"), F.monotonically_increasing_id().alias("at"))
    rows = last_wins(rows.filter("description is not null"), "_name", "at", "description")
    return entities.join(rows, F.replace("name", F.lit(" "), F.lit("_")) == F.col("_name"), "left").drop("_name")


def positional(spark: SparkSession, path: str) -> DataFrame:
    """Mentions of JSON arrays by position: 11 slots or more are one mention, 4 or more a passage whose annotations each give one.

    Every annotation is kept. Arrays of other lengths are left out.
    """
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.variant_get(F.parse_json("value"), "$", "array<variant>")).alias("v"))
    n = F.size(F.variant_get("v", "$", "array<variant>"))
    get = lambda at, kind="string": F.try_variant_get("v", f"$[{at}]", kind)
    one = rows.filter(n >= 11).select(get(0).alias("sentence"), get(1).alias("image"), get(2).alias("mention"), get(6).alias("url"))
    many = rows.filter((n >= 4) & (n < 11)).select(get(0).alias("sentence"), get(1).alias("image"), F.explode(get(2, "array<variant>")).alias("a"))
    many = many.select("sentence", "image", F.try_variant_get("a", "$[0]", "string").alias("mention"), F.try_variant_get("a", "$[2]", "string").alias("url"))
    both = one.unionByName(many)
    return both.withColumn("entity", F.when(F.contains("url", F.lit("/wiki/")), F.element_at(F.split("url", "/wiki/"), -1)))


def split_maps(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, split, id) of a JSON map of maps of id lists."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,array<bigint>>>")).alias("dataset", "m"))
    return rows.select("dataset", F.explode("m").alias("split", "ids")).select("dataset", "split", F.explode("ids").alias("id"))


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, v) of .npy matrices as float32: each file is read in one task, so keep files of moderate size."""
    import io

    import numpy as np
    import pandas as pd

    def read(batches):
        for b in batches:
            for name, content in zip(b.path, b.content):
                m = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                yield pd.DataFrame({"file": name, "row": np.arange(len(m)), "v": list(m)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, row long, v array<float>")


def rank_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rank batches as written by ``streaming.ranks``, all runs and batches."""
    return spark.read.parquet(path)


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result objects of many JSON files, their columns united, with the file's path."""
    return spark.read.option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("path"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, length) of all files below a path, contents unread."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return f.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def image_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files: exact duplicates of pictures."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def dummy(spark: SparkSession, mentions: int = 100, entities: int = 10) -> DataFrame:
    """(id, mention, entity): synthetic mentions whose gold is their number modulo the entities."""
    return spark.range(mentions).select("id", F.concat(F.lit("mention_"), F.col("id").cast("string")).alias("mention"), (F.col("id") % entities).alias("entity"))


def json_line_records(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Records of files with one a line: files are parted anywhere, so one of any size is read by many tasks. Broken lines are left out."""
    return parsed(spark.read.text(paths).filter("trim(value) <> ''"), "value", schema).drop("value")


def first_matches(spark: SparkSession, root: str, patterns: dict[str, list[str]]) -> dict[str, str]:
    """For each name the first file, by path, of the first of its patterns that matches below ``root``; names without any are left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs, found = at.getFileSystem(spark._jsc.hadoopConfiguration()), {}
    for name, own in patterns.items():
        for p in own:
            hits = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{p}"))
            if hits:
                found[name] = sorted(h.getPath().toString() for h in hits)[0]
                break
    return found


def by_manifest(spark: SparkSession, path: str, modes: dict[str, str], version: str, shard: str = "shard") -> DataFrame:
    """A table written by ``sinks.with_manifest``, if its manifest has these modes and version for all shards; raises otherwise.

    Rows have ``part``, their shard's place in the manifest; order comes from it, not from files.
    """
    m = spark.read.parquet(f"{path}.manifest")
    wanted = spark.createDataFrame(sorted(modes.items()), "tensor string, mode string")
    good = m.filter((F.col("version") == version) & F.col("complete")).join(wanted, ["tensor", "mode"], "left_semi").groupBy("shard").agg(F.count("*").alias("n"), F.max("rows").alias("rows"))
    shards = m.select("shard").distinct()
    if shards.join(good.filter(F.col("n") == len(modes)), "shard", "left_anti").head(1) or not good.head(1):
        raise ValueError("the manifest names other modes or another version")
    from linkstrata.operators.gold import dense_positions

    places = dense_positions(good.select("shard"), "shard", "part")
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(places), rows[shard].cast("string") == places["shard"]).select(*(rows[c] for c in rows.columns), "part")


def two_level_config(text: str) -> dict:
    """Settings of a text with 'key: value' lines, indented ones belonging to the last 'section:' line; '#' starts a comment, quotes around values are dropped."""
    out: dict = {}
    own = out
    for line in text.splitlines():
        line = line.partition("#")[0].rstrip()
        name, _, value = line.strip().partition(":")
        if not name:
            continue
        value = value.strip().strip("'\"")
        if not value:
            own = out[name.strip()] = {}
        else:
            (own if line[0].isspace() else out)[name.strip()] = value
    return out
