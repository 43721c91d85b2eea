"""Readers and writers of the file layouts that crawled corpora come in. All take any path that Spark can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import first_column_without_mark, stripped

#: Suffixes of a page's files.
PAGE_PARTS = {"html": "-html.txt", "xml": "-xml.txt", "screen": "-screen.png", "meta": ".json"}


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON value per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON object per line."""
    df.write.mode(mode).json(path)


def decoded_twice(raw: Column, schema: str) -> Column:
    """A value that was encoded as JSON, and the result again as a JSON string."""
    inner = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0]
    return F.from_json(inner, schema)


def encoded_twice(value: Column) -> Column:
    return F.element_at(F.regexp_extract_all(F.to_json(F.array(F.to_json(value))), F.lit(r"(?s)^\[(.*)\]$"), 1), 1)


def read_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """key, value of doubly encoded dictionaries, one per file."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(decoded_twice(F.col("value"), f"map<string,{value}>")).alias("key", "value"))


def write_map(rows: DataFrame, path: str, key: str = "key", value: str = "value", mode: str = "errorifexists") -> None:
    """One dictionary, doubly encoded, in one file: for tables that are dictionaries, not for bulk data."""
    one = rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("m"))
    one.select(encoded_twice(F.col("m")).alias("value")).coalesce(1).write.mode(mode).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: stripped lines of text files."""
    return spark.read.text(path).select(stripped(F.col("value")).alias("line"))


def write_lines(df: DataFrame, path: str, line: str = "line", mode: str = "errorifexists") -> None:
    df.select(F.col(line).cast("string")).write.mode(mode).text(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, name of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))


def read_pages(spark: SparkSession, path: str, least: dict[str, int] | None = None) -> DataFrame:
    """page_name and the files of each page (html, xml, screen, meta), of pages whose html is there.

    least: for each part, the fewest bytes a file must have; smaller ones count as missing. The
    sizes are tested on the listing, before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = None
    part = F.lit(None).cast("string")
    stem = F.lit(None).cast("string")
    for k, suffix in PAGE_PARTS.items():
        part = F.when(name.endswith(suffix), k).otherwise(part)
        stem = F.when(name.endswith(suffix), F.expr(f"substring(element_at(split(path, '/'), -1), 1, length(element_at(split(path, '/'), -1)) - {len(suffix)})")).otherwise(stem)
    wanted = part.isNotNull()
    for k, n in (least or {}).items():
        wanted = wanted & ((part != k) | (F.col("length") >= n))
    rows = files.filter(wanted).select(stem.alias("page_name"), part.alias("part"), "content")
    out = rows.groupBy("page_name").pivot("part", list(PAGE_PARTS)).agg(F.first("content"))
    return out.filter("html is not null").select("page_name", F.col("html").cast("string").alias("html"), F.col("xml").cast("string").alias("xml"), "screen", F.col("meta").cast("string").alias("meta"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV file, its byte-order mark taken off the first name."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*first_column_without_mark(df.columns))


def write_table(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "errorifexists") -> int:
    """Writes a CSV or, with a tab, a TSV table and returns its rows, which are counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).csv(path, sep=sep, header=header)
    return seen.get["rows"]


def write_dictionary(rows: DataFrame, path: str, key: str = "key", value: str = "value", mode: str = "errorifexists") -> int:
    """key and value, tab-separated, in order of key; returns the number of rows."""
    return write_table(rows.select(key, value).sort(key), path, "\t", False, mode)


def append_rows(df: DataFrame, path: str, kind: str = "json") -> None:
    """Adds rows to a log; the commit protocol makes each call all or nothing."""
    df.write.mode("append").format(kind).save(path)


def with_usage_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A usage log's rows with the formatted time that its table shows."""
    return df.withColumn("timestamp", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """image_id, file_name, annotation_id, category, bbox from an annotation file."""
    raw = read_json(
        spark, path,
        "images array<struct<id:long,file_name:string,width:int,height:int>>, "
        "annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,iscrowd:int>>, categories array<struct<id:long,name:string>>",
    )
    images = raw.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    notes = raw.select(F.explode("annotations").alias("a")).select(F.col("a.id").alias("annotation_id"), "a.image_id", "a.category_id", "a.bbox", "a.iscrowd")
    names = raw.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    return notes.join(images, "image_id").join(names, "category_id")


def alone_in_group(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys occur once."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")


def data_url(content: Column, mime: str = "image/png") -> Column:
    """Bytes as a data URL."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """id, app, query, check_point of agent tasks; each check is an array, a single value an array of one."""
    raw = read_json(spark, path, "id string, app string, package_name string, query string, check_point map<string,string>")
    many = F.transform_values("check_point", lambda _, v: F.coalesce(F.from_json(v, "array<string>"), F.array(v)))
    return raw.select("id", "app", "package_name", "query", many.alias("check_point"))


def read_apps(spark: SparkSession, path: str, by: str = "name") -> DataFrame:
    """by, ord and the rest of name, package, adb, text of an app catalogue; the first entry of a name or package counts."""
    raw = read_json(spark, path, "data array<struct<name_en:string,package:string,adb:array<string>,text:array<string>>>")
    rows = raw.select(F.posexplode("data").alias("ord", "a")).select("ord", F.col("a.name_en").alias("name"), "a.package", "a.adb", "a.text")
    return first_by(rows, by, "ord")


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows without a key are left out."""
    rest = [c for c in rows.columns if c != key]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def of_mode(catalogue: DataFrame, mode: str, column: str = "mode") -> DataFrame:
    """The entries of a catalogue for one mode; none for a mode that is not in it."""
    return catalogue.filter(F.col(column) == mode)


def image_size(content: Column) -> Column:
    """width, height of a PNG or GIF image's bytes, from its header; null for other bytes."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")
    small = lambda at: number(at, 1) + 256 * number(at + 1, 1)
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    gif = F.hex(F.substring(content, 1, 4)) == "47494638"
    return F.when(png, F.struct(number(17, 4).alias("width"), number(21, 4).alias("height"))).when(gif, F.struct(small(7).alias("width"), small(9).alias("height")))
