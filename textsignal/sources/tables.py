"""Reading and writing comment tables, stage tables and result tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsignal.functions import text
from textsignal.session import new_path, without_shuffles

COMMENTS = T.StructType([
    T.StructField("comment_id", T.LongType()),
    T.StructField("body", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("yyyy", T.IntegerType()),
    T.StructField("mm", T.IntegerType()),
])
LABELLED = T.StructType([
    *COMMENTS.fields,
    T.StructField("clean_body", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("subreddit_type", T.StringType()),
])


MANIFEST = "_manifest.json"
PART_BYTES = 16 << 20  # of a table's files in a partition of ``compact``
MOST_BYTES = 128 << 20  # where there is a partition for each core
TASKS_A_CORE = 4  # of ``dealt`` rows
CODEC = "zstd"  # of tables with texts: smaller by a third or more than by Spark's default


def read_comments(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The comment table; ``yyyy``/``mm`` folders become columns and prune scans.

    ``partitions`` deals the rows out anew, for a table of a few large row groups, each of which is
    one task. It shuffles the text; without it the scan's own splits are kept.
    """
    df = cast_period(spark.read.schema(COMMENTS).parquet(path))
    return df.repartition(partitions, "comment_id") if partitions else df


def cast_period(df: DataFrame) -> DataFrame:
    """Cast ``yyyy`` and ``mm`` to int where the table has them."""
    found = [c for c in ("yyyy", "mm") if c in df.columns]
    return df.withColumns({c: text.whole_number(c) for c in found})


def write_labelled(df: DataFrame, path: str) -> None:
    """Parquet by month. Files are levelled out: many small tasks share one, a hot month gets several."""
    with without_shuffles(df.sparkSession):
        df.hint("rebalance", "yyyy", "mm").write.mode("overwrite").partitionBy("yyyy", "mm").parquet(path, compression=CODEC)


_CSV = {"header": True, "quote": '"', "escape": '"', "quoteAll": True,
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
        "nullValue": "\\N", "emptyValue": ""}


# What stands for a character that would end a line, or for the sign itself: then each line is a row.
_ESCAPES = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))


def _texts(df: DataFrame, change: Callable[[F.Column], F.Column]) -> DataFrame:
    return df.select(*[change(F.col(f"`{f.name}`")).alias(f.name) if f.dataType == T.StringType() else F.col(f"`{f.name}`") for f in df.schema])


def write_labelled_csv(df: DataFrame, path: str) -> None:
    """CSV with one row a line: in texts, a backslash and an s, n or r stands for backslash, line feed and carriage return."""
    def escaped(col):
        for sign, code in _ESCAPES:
            col = F.replace(col, F.lit(sign), F.lit(code))
        return col

    _texts(df, escaped).write.mode("overwrite").options(**_CSV).csv(path)


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType = LABELLED, multi_line: bool = False) -> DataFrame:
    """What ``write_labelled_csv`` wrote. No row spans lines, so a large file is read by many tasks.

    ``multi_line`` is for files of others, with quoted line ends and no escapes; each is one task.
    """
    def plain(col):
        for sign, code in reversed(_ESCAPES):
            col = F.replace(col, F.lit(code), F.lit(sign))
        return col

    df = spark.read.schema(schema).options(**_CSV, multiLine=multi_line).csv(path)
    return df if multi_line else _texts(df, plain)


def write_result(df: DataFrame, path: str) -> None:
    """A result table as one CSV file; for tables with a row per class, model or feature."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a Spark job has committed its output at ``path``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def stage_path(path: str, **settings) -> str:
    """The place of a stage made with these settings: other settings have another one."""
    key = json.dumps(settings, sort_keys=True, default=str)
    return f"{path}/{hashlib.md5(key.encode()).hexdigest()[:12]}"


def source_of(df: DataFrame) -> dict:
    """What a table is made from, so that equal sources mean equal rows.

    Of a table over files: each file with its size and time, listed by the driver as Spark's own scan does, and the
    plan over them. A table with any other leaf, such as rows of the session, is named by a hash of its rows, which reads them
    once: their number and the sum of their hashes, whatever their order.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed().canonicalized()
    leaves = plan.collectLeaves()
    kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    if kinds == {"LogicalRelation"}:
        shown, most = "spark.sql.debug.maxToStringFields", str((1 << 31) - 1)
        before = spark.conf.get(shown)
        spark.conf.set(shown, most)
        try:
            made = plan.toString()
        finally:
            spark.conf.set(shown, before)
        return {"files": [_file_state(spark, f) for f in sorted(df.inputFiles())], "plan": hashlib.md5(made.encode()).hexdigest()}
    if not df.columns:
        return {"columns": {}, "rows": df.count()}
    total = F.sum(F.xxhash64(*[F.to_json(F.struct(c)) for c in _quoted(df)]).cast("decimal(38, 0)"))
    n, of = df.agg(F.count("*"), total).first()
    return {"columns": dict(df.dtypes), "rows": n, "hash": str(of)}


def _quoted(df: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def _file_state(spark: SparkSession, file: str) -> tuple[str, int, int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
    state = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return file, state.getLen(), state.getModificationTime()


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Put what a stage was made from beside its data; readers of the data skip the file."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path, MANIFEST)
    out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True)
    try:
        out.write(bytearray(json.dumps(manifest, sort_keys=True, default=str, indent=1).encode()))
    finally:
        out.close()


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """What the stage at ``path`` was made from; None where nothing is written."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path, MANIFEST)
    files = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(file):
        return None
    stream = files.open(file)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def made_from(spark: SparkSession, path: str, manifest: dict, build: Callable[[str], None]) -> str:
    """The place of a stage under ``path`` that was made from this manifest; if there is none yet, ``build`` writes it first.

    The folder is named by the manifest's hash, so another input, word list or setting has another folder, and a
    stage is whole if its job committed and its manifest followed.
    """
    place = stage_path(path, **manifest)
    if not (is_complete(spark, place) and read_manifest(spark, place) is not None):
        with without_shuffles(spark):
            build(place)
        write_manifest(spark, place, manifest)
    return place


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the stage at ``path`` if it is complete, else compute and write it first."""
    if not is_complete(spark, path):
        with without_shuffles(spark):
            build().write.mode("overwrite").parquet(path, compression=CODEC)
    return spark.read.parquet(path)


def has_months(df: DataFrame) -> bool:
    return {"yyyy", "mm"} <= set(df.columns)


def read_labelled(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that ``write_labelled`` wrote; filters on ``yyyy`` and ``mm`` choose the folders that are read."""
    return spark.read.schema(schema).parquet(path).select(schema.fieldNames())


def by_month(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder, by month where it has months, and read it back."""
    if not has_months(df):
        return cut_lineage(df, name)
    path = new_path(df.sparkSession, name)
    write_labelled(df, path)
    return read_labelled(df.sparkSession, path, df.schema)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back."""
    spark = df.sparkSession
    return stage(spark, new_path(spark, name), lambda: df)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly to several tasks a core.

    A stored table's own tasks are its row groups, some of a month and some of several: as long as one takes, all others wait.
    Tables written from dealt rows have files of equal sizes, so what reads them is even, too.
    """
    spark = df.sparkSession
    return df.repartition(max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def table_bytes(spark: SparkSession, path: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def files_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table is read from; 0 for rows of the session."""
    return sum(_file_state(df.sparkSession, f)[1] for f in df.inputFiles())


def compact(spark: SparkSession, path: str, part_bytes: int = PART_BYTES, at_once: int = 1) -> DataFrame:
    """A written table in as few partitions as its size asks for: work that comes back to it often has few tasks.

    A table of more partitions than its share of the cores, if ``at_once`` users read it side by side, has larger ones,
    the same number for each core: so the tasks of an iteration do not grow with the table until a partition has ``MOST_BYTES``.
    """
    size = table_bytes(spark, path)
    return spark.read.parquet(path).coalesce(n_parts(size, part_bytes, -(-spark.sparkContext.defaultParallelism // max(1, at_once))))


def n_parts(size: int, part_bytes: int, cores: int) -> int:
    """Partitions of a table of this size for work on so many cores."""
    parts = max(1, -(-size // part_bytes))
    return parts if parts <= cores else cores * -(-size // (max(part_bytes, MOST_BYTES) * cores))


def compacted(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back in as few partitions as its size asks for."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return compact(df.sparkSession, path)


_BINARY = ("accuracy", "precision", "recall", "f1", "roc_auc")
_INTENSITY = ("accuracy", "macro_f1", "weighted_f1", "mae")
_TITLES = {
    "accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1",
    "roc_auc": "ROC-AUC", "macro_f1": "Macro F1", "weighted_f1": "Weighted F1", "mae": "MAE",
}


def markdown_rows(summary: DataFrame) -> DataFrame:
    """One Markdown line per summary row: four decimals, blank where a metric is null."""
    metrics = _BINARY if "roc_auc" in summary.columns else _INTENSITY
    cells = [F.col("model_name"), F.col("split_name")] + [
        F.when(F.col(m).isNotNull(), F.format_string("%.4f", F.col(m))).otherwise("") if m == "roc_auc"
        else F.format_string("%.4f", F.col(m))
        for m in metrics
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return summary.select("model_name", "split_name", line.alias("line"))


def markdown_head(summary: DataFrame) -> list[str]:
    metrics = _BINARY if "roc_auc" in summary.columns else _INTENSITY
    names = ["Model", "Split"] + [_TITLES[m] for m in metrics]
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]


def write_markdown(summary: DataFrame, path: str) -> None:
    """A summary table as one Markdown file, rows in model and split order."""
    head = summary.sparkSession.createDataFrame(
        [(i, "", line) for i, line in enumerate(markdown_head(summary))], "part int, key string, line string"
    )
    rows = markdown_rows(summary).select(
        F.lit(2).alias("part"), F.concat_ws(" ", "split_name", "model_name").alias("key"), "line"
    )
    (head.unionByName(rows).coalesce(1).sortWithinPartitions("part", "key")
     .select("line").write.mode("overwrite").text(path))
