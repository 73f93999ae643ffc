"""File sources: tolerant and strict JSON, log lines, folders of texts, delimiter-split files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines by an explicit schema; lines that don't parse are skipped."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    return rows.where("j IS NOT NULL AND j._corrupt_record IS NULL").select(*[f"j.{f.name}" for f in schema.fields])


def event_log(spark: SparkSession, path: str, schema: str, day: str, names: list[str]) -> dict[str, DataFrame]:
    """One day's named event streams of a JSON-lines trace with columns timestamp and event."""
    log = json_lines(spark, path, schema).where(F.col("timestamp").startswith(day))
    return {n: log.where(F.col("event") == n) for n in names}


def strict_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON array or, with `lines`, JSON lines; a bad record raises."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def state_files(spark: SparkSession, folder: str, schema: str, active: list[str]) -> DataFrame:
    """A folder of one-object JSON files as rows; `name` is job_name or the file's stem, only active names stay."""
    rows = spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("_stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return rows.withColumn("name", F.coalesce("job_name", "_stem")).drop("_stem").where(F.col("name").isin(active))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """day, time, level, module, message of lines like `2024-01-01 10:00:00 ERROR module: text`."""
    p = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})\S* +([A-Z]+) +([\w.]+): ?(.*)$"
    parts = [F.regexp_extract("value", p, i).alias(n) for i, n in enumerate(("day", "time", "level", "module", "message"), 1)]
    return spark.read.text(path).select(*parts).where("day <> ''")


def text_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md", "txt"), least: int = 50, skip: tuple[str, ...] = (".git", "node_modules")) -> DataFrame:
    """Files below a folder: path, title, text and, if refused, the reason (extension, size or binary)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    f = f.where(~F.col("path").rlike("/(" + "|".join(s.replace(".", r"\.") for s in skip) + ")/"))
    text = F.decode("content", "UTF-8")
    reason = F.when(~F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*extensions), "extension").when(F.col("length") < least, "size").when(F.instr(F.hex(F.substring("content", 1, 512)), "00") % 2 == 1, "binary").otherwise("")
    title = F.coalesce(F.nullif(F.regexp_extract(text, r"(?m)^#+ +(.+)$", 1), F.lit("")), F.nullif(F.substring(F.regexp_extract(text, r"^\s*([^\n]+)", 1), 1, 100), F.lit("")), F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
    out = f.select("path", reason.alias("reason"), text.alias("text"), title.alias("title"))
    return out.select("path", "reason", F.when(F.col("reason") == "", F.col("title")).alias("title"), F.when(F.col("reason") == "", F.col("text")).alias("text"))


def delimited_entries(spark: SparkSession, path: str, delimiter: str = "§") -> DataFrame:
    """Entries of a file between delimiters, the first of those equal but for white space: path, pos, entry."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", f"\\Q{delimiter}\\E")).alias("pos", "entry"))
    rows = rows.withColumn("entry", F.trim(F.regexp_replace("entry", r"^\s+|\s+$", ""))).where("entry <> ''")
    w = Window.partitionBy("path", F.regexp_replace("entry", r"\s+", "")).orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def transcripts(messages: DataFrame, since: float | None = None) -> DataFrame:
    """Session digests of messages (session_id, project, role, content, ts): arrays of prompts and finals, turn counts."""
    ordered = lambda role: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("ts", "role", "content"))), lambda m: m["role"] == role), lambda m: m["content"])
    out = messages.groupBy("session_id").agg(F.first("project").alias("project"), ordered("user").alias("prompts"), ordered("assistant").alias("finals"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    out = out.withColumns({"n_user_turns": F.size("prompts"), "n_assistant_turns": F.size("finals")})
    return out.where(F.col("ended_at").isNull() | (F.col("ended_at") >= since)) if since is not None else out
