"""Symbol tables and question-answer files: JSON as it is laid out by repository and snapshot, and partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMETER = "struct<name:string,type_annotation:string,default_value:string>"
FIELD = "struct<name:string,type_annotation:string,default_value:string,visibility:string,is_static:boolean>"
FUNCTIONS = f"name string, kind string, container string, signature string, parameters array<{PARAMETER}>, return_type string, decorators array<string>, visibility string, is_static boolean, is_abstract boolean, start_line int, end_line int, doc string, file string, calls array<string>, instantiations array<string>, field_accesses array<string>, string_literals array<string>, file_path string"
CLASSES = f"name string, kind string, base_classes array<string>, implemented_interfaces array<string>, decorators array<string>, fields array<{FIELD}>, methods array<string>, visibility string, is_abstract boolean, start_line int, end_line int, doc string, file string, file_path string"
IMPORTS = "module string, names array<string>, alias string, is_wildcard boolean, file_path string"
DOCS = "file_path string, doc string"
FILES = "path string, content_hash string, language string"
SLICE = "slice_id string, commit_hash string, commit_date string, slice_type string, version_tag string, metadata struct<total_files:int,total_lines:int,target_language_total_files:int,target_language_total_lines:int,changed_files_since_prev_slice:int,commit_message:string,lines_added:int,lines_deleted:int,slice_score:double>"
QA = "qa_id string, repo string, qa_type string, qa_subtype string, question string, answer string, slice_id string, from_slice_id string, to_slice_id string, question_key string, evidence struct<kind:string,name:string,file_path:string>"
#: Types of questions.
TYPES = ("intrinsic", "extrinsic", "temporal")
SYMBOLS = {"functions": FUNCTIONS, "classes": CLASSES, "imports": IMPORTS, "module_docs": DOCS}


def placed(df: DataFrame) -> DataFrame:
    """df with the repo and snapshot of the file that each row is from, and its place in the file."""
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, r"([^/]+)/slices/slice_\d+/", 1).alias("repo"), F.regexp_extract(path, r"/slices/slice_(\d+)/", 1).cast("int").alias("slice_idx"), F.monotonically_increasing_id().alias("ord"))


def read_symbols(spark: SparkSession, root: str, kind: str, repos: str = "*") -> DataFrame:
    """All rows of one kind of symbols: a JSON array for each snapshot. repos narrows the folders that are listed."""
    return placed(spark.read.schema(SYMBOLS[kind]).option("multiLine", True).json(f"{root}/{repos}/slices/slice_*/symbols/{kind}.json"))


def read_slices(spark: SparkSession, root: str, repos: str = "*") -> DataFrame:
    rows = placed(spark.read.schema(SLICE).option("multiLine", True).json(f"{root}/{repos}/slices/slice_*/metadata.json"))
    return rows.withColumn("slice_id", F.coalesce("slice_id", F.format_string("slice_%04d", "slice_idx")))


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of questions; blank lines are no rows."""
    return spark.read.schema(QA).json(path).filter(F.col("qa_id").isNotNull() | F.col("question").isNotNull())


def pool_path(root: str, qa_type: str) -> str:
    return f"{root}/all_qa_pairs.jsonl" if qa_type == "all" else f"{root}/{qa_type}_qa_pairs.jsonl"


def read_pool(spark: SparkSession, root: str, qa_type: str) -> DataFrame:
    """The questions of one type, or of all; none where there is no such file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pool_path(root, qa_type))
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], QA)
    return read_qa(spark, pool_path(root, qa_type))


def write_pools(qa: DataFrame, root: str) -> None:
    """Questions as pools that read_pool finds: one for each type of TYPES, and one of all."""
    for qa_type in TYPES:
        qa.filter(F.col("qa_type") == qa_type).write.mode("overwrite").json(pool_path(root, qa_type))
    qa.write.mode("overwrite").json(pool_path(root, "all"))


def write_qa(qa: DataFrame, root: str) -> None:
    """Questions by repo and type, as JSON lines."""
    qa.withColumns({"repo_": F.col("repo"), "type_": F.col("qa_type")}).write.mode("overwrite").partitionBy("repo_", "type_").json(root)


def write_symbols(parsed: DataFrame, root: str) -> None:
    """parsed (repo, slice_idx, path, and structs of symbols) as one table for each kind, by repo and snapshot."""
    for kind in ("functions", "classes", "imports"):
        rows = parsed.select("repo", "slice_idx", F.col("path").alias("file_path"), F.posexplode(kind).alias("ord", "s")).select("repo", "slice_idx", "ord", "s.*", "file_path")
        rows.write.mode("overwrite").partitionBy("repo", "slice_idx").parquet(f"{root}/{kind}")
    docs = parsed.filter("module_doc <> ''").select("repo", "slice_idx", F.col("path").alias("file_path"), F.col("module_doc").alias("doc"))
    docs.write.mode("overwrite").partitionBy("repo", "slice_idx").parquet(f"{root}/module_docs")
