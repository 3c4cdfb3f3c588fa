"""The data lake: one table per artifact, partitioned by product; missing tables read as none or empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("raw", "extracted", "geo", "aeo", "questions", "clusters", "report")

RUN = (
    "runId string, promptId string, promptText string, dimensions struct<intent:string,persona:struct<role:string,teamSize:string>,"
    "specificity:string,attribute:string,language:string,brandsNamed:array<string>>, source string, templateId string, stage string, "
    "temperature double, timestamp string, finishReason string, rawText string, error string"
)


class Lake:
    """Paths and readers under one root; the root is any path that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str, table: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"no such layer: {layer}")
        return f"{self.root}/{layer}/{table}"

    def exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def write(self, layer: str, table: str, df: DataFrame, product: str | None = None) -> None:
        """Replaces one product's part (then df has no product column, and may be empty), or the parts in df."""
        if product is not None:
            df.write.mode("overwrite").parquet(f"{self.path(layer, table)}/product={product}")
            return
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy("product") if "product" in df.columns else writer).parquet(self.path(layer, table))

    def read(self, layer: str, table: str) -> DataFrame | None:
        path = self.path(layer, table)
        return self.spark.read.parquet(path) if self.exists(path) else None

    def write_text(self, layer: str, name: str, text: str) -> str:
        """One text file (Markdown, XML), replaced if it is there; its path."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(layer, name))
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        return self.path(layer, name)

    def products(self) -> DataFrame:
        pages = self.read("raw", "page")
        empty = self.spark.createDataFrame([], "product string")
        return (empty if pages is None else pages.select("product").distinct()).orderBy("product")


def read_json(lake: Lake, path: str, schema: str) -> DataFrame | None:
    """The JSON document at a path as a row, or none where there is no such file."""
    return lake.spark.read.schema(schema).option("multiLine", True).json(path) if lake.exists(path) else None


def read_all_json(lake: Lake, folder: str, schema: str) -> DataFrame:
    """All JSON documents of a folder, with their ``file`` for order; no rows where there is no such folder."""
    if not lake.exists(folder):
        return lake.spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
    reader = lake.spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json")
    return reader.json(folder).withColumn("file", F.col("_metadata.file_name"))


def recorded_runs(lake: Lake, folder: str) -> DataFrame:
    """Runs kept as one JSON document each, in order of file: run_id, prompt_id, prompt_text, source, template_id, stage
    (of brand-grounded ones), temperature, timestamp, finish_reason, text, error."""
    runs = read_all_json(lake, folder, RUN).orderBy("file")
    names = {"runId": "run_id", "promptId": "prompt_id", "promptText": "prompt_text", "source": "source", "templateId": "template_id", "stage": "stage", "temperature": "temperature", "timestamp": "timestamp", "finishReason": "finish_reason", "rawText": "text", "error": "error"}
    return runs.select(*[F.col(c).alias(name) for c, name in names.items()])
