"""Documents, chunks, graph records, questions and logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.cut import kept

CHUNK = "chunk_id string, chunk_type string, title string, act struct<act_type:string,act_number:string,act_year:string,act_type_label:string>, text_en string, page_number int, indices struct<article:int,version:string>, clauses array<struct<index:string,text_en:string>>"
END = "struct<label:string,key:map<string,string>>"


def markdown(spark: SparkSession, root: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """path, text: one row per ``*.md`` file of ``root/files``, or of ``root`` without such a folder; ``skip`` and ``limit`` go by path."""
    inner = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/files")
    if inner.getFileSystem(spark._jsc.hadoopConfiguration()).exists(inner):
        root = inner.toString()
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(root)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if skip or limit:
        files = files.orderBy("path").offset(skip)
        files = files.limit(limit) if limit else files
    return files


def write_documents(chunks: DataFrame, path: str) -> None:
    """One JSON record per document (``path``) with its chunks by position."""
    fields = [c for c in chunks.columns if c not in ("path", "position")]
    whole = chunks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("position", F.to_json(F.struct(*fields)).alias("chunk")))).alias("c"))  # a document's chunks
    body = F.concat(F.lit('{"path":'), F.regexp_extract(F.to_json(F.array("path")), r"^\[([\s\S]*)\]$", 1), F.lit(',"chunks":['), F.array_join(F.transform("c", lambda x: x["chunk"]), ","), F.lit("]}"))
    whole.select(body.alias("value")).write.text(path)


def write_normalized(rows: DataFrame, path: str) -> None:
    """Validated chunks, one JSON record per document, without the mark of validity."""
    write_documents(rows.drop("valid"), path)


def parsed_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, document, chunk fields: a row per chunk of parsed documents; documents without chunks give none."""
    schema = T.StructType([T.StructField("document", T.MapType(T.StringType(), T.StringType())), T.StructField("chunks", T.ArrayType(T._parse_datatype_string(CHUNK)))])
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("path"), "document", F.explode("chunks").alias("c"))
    return rows.select("path", "document", "c.*")


def normalized_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, position, chunk fields of what ``write_normalized`` wrote; documents without chunks give none."""
    rows = spark.read.schema(f"path string, chunks array<struct<{_chunk_fields()}>>").json(path)
    return rows.select("path", F.posexplode("chunks").alias("position", "c")).select("path", "position", "c.*")


def _chunk_fields() -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in T._parse_datatype_string(CHUNK))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1 in its file), seq (from 0 over all files by path), value: lines in the order in which they stand.

    A file may be read in several splits: lines go by file, the split's place in it, and their order in the split.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    rows = kept(raw)
    counts = rows.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row a split
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own, files = Window.partitionBy("path").orderBy("split"), Window.orderBy("path")
    earlier = counts.groupBy("path").agg(F.sum("n").alias("n")).select("path", before(files).alias("offset"))  # a row a file
    places = counts.select("path", "split", "first", before(own).alias("skipped")).join(F.broadcast(earlier), "path")
    line = F.col("at") - F.col("first") + F.col("skipped")
    # a row a split: lines stay where they were read, none is shuffled or sorted
    return rows.join(F.broadcast(places), ["path", "split"]).select("path", (line + 1).alias("line"), (line + F.col("offset")).alias("seq"), "value")


def graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, broken) from JSON lines; ``seq`` is a line's place over all files, so that what was written last comes last.

    A record that has the fields ``type`` and ``from``, with whatever value, is an edge; any other is a node. Blank lines are passed over. broken: path, line,
    value of lines that aren't a JSON object, or lack a label and key, or an end's.
    """
    schema = f"label string, key map<string,string>, type string, `from` {END}, `to` {END}, properties map<string,string>, unread string"
    rows = ordered_lines(spark, path).where(F.trim("value") != "")
    fields = F.json_object_keys("value")
    rows = rows.withColumns({"r": F.from_json("value", schema, {"columnNameOfCorruptRecord": "unread"}), "edge": F.array_contains(fields, "type") & F.array_contains(fields, "from")})
    is_edge = F.coalesce("edge", F.lit(False))
    whole_end = lambda e: F.col(f"r.{e}.label").isNotNull() & F.col(f"r.{e}.key").isNotNull()
    good = F.when(is_edge, F.col("r.type").isNotNull() & whole_end("from") & whole_end("to")).otherwise(F.col("r.label").isNotNull() & F.col("r.key").isNotNull())
    good = F.col("r").isNotNull() & F.col("r.unread").isNull() & F.coalesce(good, F.lit(False))
    rows = kept(rows.withColumns({"edge": is_edge, "good": good}))
    properties = F.coalesce("r.properties", F.create_map().cast("map<string,string>")).alias("properties")
    nodes = rows.where("good AND NOT edge").select("seq", "r.label", "r.key", properties)
    edges = rows.where("good AND edge").select("seq", "r.type", F.col("r.from").alias("src"), F.col("r.to").alias("dst"), properties)
    return nodes, edges, rows.where("NOT good").select("path", "line", "value")


def graph_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``graph_lines``; a line that can't be read is an error."""
    nodes, edges, broken = graph_lines(spark, path)
    first = broken.orderBy("path", "line").first()
    if first is not None:
        raise ValueError(f"{first.path}, line {first.line}: not a record of a graph")
    return nodes, edges


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes, then edges, as JSON lines."""
    edges = edges.select("seq", "type", F.col("src").alias("from"), F.col("dst").alias("to"), "properties")
    nodes.select("seq", "label", "key", "properties").unionByName(edges, allowMissingColumns=True).write.json(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """qid, question: from a JSON list, or an object with ``questions`` or else ``queries``."""
    text = spark.read.format("text").option("wholetext", True).load(path).select(F.trim("value").alias("v"))
    lists = F.coalesce(F.from_json(F.when(F.col("v").startswith("["), F.col("v")), "array<string>"), F.from_json(F.get_json_object("v", "$.questions"), "array<string>"), F.from_json(F.get_json_object("v", "$.queries"), "array<string>"))
    return text.select(F.posexplode(lists).alias("qid", "question"))


def batch_counts(results: DataFrame) -> DataFrame:
    """total_queries, successful, failed of a batch of answers (``success``)."""
    return results.agg(F.count("*").alias("total_queries"), F.count_if("success").alias("successful"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"))


def write_report(results: DataFrame, path: str) -> None:
    """A batch of answers as JSON lines under ``path/results``, and its counts, one line, under ``path/summary``."""
    results.write.mode("overwrite").json(f"{path}/results")
    batch_counts(results).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(counts, results) of ``write_report``."""
    return spark.read.json(f"{path}/summary"), spark.read.json(f"{path}/results")


def append_log(events: DataFrame, path: str) -> None:
    """Append log lines (ts, phase, message, detail), a folder per day in place of rotated files."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" ["), F.col("phase"), F.lit("] "), F.col("message"), F.coalesce(F.concat(F.lit(" | "), "detail"), F.lit("")))
    events.select(F.to_date("ts").alias("day"), line.alias("line")).write.mode("append").partitionBy("day").parquet(path)


def run_query(spark: SparkSession, text: str, **args: object) -> dict[str, object]:
    """A query's DataFrame, or the reason why it can't be analyzed."""
    from pyspark.errors import PySparkException

    try:
        return {"success": True, "records": spark.sql(text, args=args or None)}
    except PySparkException as e:
        return {"success": False, "error": str(e)}
