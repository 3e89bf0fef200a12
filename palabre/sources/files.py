"""Sources and sinks at the edge: optional tables, records in YAML, separated files with totals, fingerprints."""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.domain import french_number


def optional_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table, or an empty one of the schema if the path isn't there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def yaml_records(spark: SparkSession, path: str, schema: StructType | str, root: str | None = None) -> DataFrame:
    """Records of YAML files: each file is read whole on an executor, turned to JSON and parsed by the schema.

    ``root`` names the list of records; without it the file is a list. Dates become ISO text before parsing.
    """
    def text(x):
        return x.isoformat() if isinstance(x, (date, datetime)) else str(x)

    def run(batches):
        import yaml

        for b in batches:
            out = []
            for content in b["value"]:
                doc = yaml.safe_load(content)
                out += [json.dumps(r, default=text, ensure_ascii=False) for r in ((doc or {}).get(root, []) if root else doc or [])]
            yield pd.DataFrame({"record": out}, dtype="object")

    raw = spark.read.text(path, wholetext=True).mapInPandas(run, "record string")
    return raw.select(F.from_json("record", schema).alias("r")).select("r.*")


def decimal_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns of decimals with commas as doubles; a column named ``..._texte`` stays text."""
    return df.withColumns({c: french_number(F.col(c)) for c in columns if not c.endswith("_texte")})


def separated_with_totals(spark: SparkSession, path: str, key: list[str], value: str, wanted: DataFrame, name: str) -> DataFrame:
    """(key, total, mine): totals over every row of a ';' file, and the part of the wanted names."""
    d = spark.read.csv(path, sep=";", header=True)
    d = d.withColumn(value, F.col(value).try_cast("bigint"))
    w = wanted.select(F.col(name)).distinct().withColumn("_in", F.lit(1))
    return d.join(w, name, "left").groupBy(*key).agg(F.sum(value).alias("total"), F.sum(F.when(F.col("_in") == 1, F.col(value))).alias("mine"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, print): the first twelve hex digits of each file's SHA-256."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.substring(F.sha2("content", 256), 1, 12).alias("print"))


def stale(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Paths whose fingerprint isn't the recorded one, missing on either side included."""
    j = now.alias("a").join(recorded.alias("b"), "path", "full_outer")
    return j.filter(~F.col("a.print").eqNullSafe(F.col("b.print"))).select("path", F.col("a.print").alias("now"), F.col("b.print").alias("recorded"))


def write_display(df: DataFrame, path: str, decimals: int = 1) -> None:
    """A ';' file with decimals as text with a comma, whole numbers without a fraction."""
    out = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            x = F.round(F.col(c), decimals)
            out.append(F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.translate(x.cast("string"), ".", ",")).alias(c))
        else:
            out.append(F.col(c))
    df.select(*out).write.mode("overwrite").csv(path, sep=";", header=True)


def write_cards(df: DataFrame, by: str, path: str, tasks: int) -> None:
    """One file of JSON lines for each value of the text column ``by``, named ``by``=value.json, or null.json.

    All rows of a value come to one task in sequence. Files are written from Python (any file system that pyarrow
    opens by URI): a committed folder for each value costs Hadoop's local file system about 20 ms of a core. A file
    takes its name when it is whole, so a task may be run again.
    """

    def run(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        now, out, part, n = None, None, None, 0

        def close():
            if out is not None:
                out.close()
                files.move(part, f"{root}/{'null' if now is None else f'{by}={quote(now, safe=str())}'}.json")

        for b in batches:
            for value, line in zip(b[0].to_pylist(), b[1].to_pylist()):
                if out is None or value != now:
                    close()
                    now, part, n = value, f"{root}/_{uuid.uuid4().hex}", n + 1
                    out = files.open_output_stream(part)
                out.write(line.encode() + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows = df.select(by, F.to_json(F.struct(*[c for c in df.columns if c != by])).alias("card"))
    rows.repartition(tasks, by).sortWithinPartitions(by).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def read_cards(spark: SparkSession, by: str, path: str, schema: str, tasks: int) -> DataFrame:
    """The rows of ``write_cards`` with the value that the file's name tells; many small files go to each of ``tasks`` tasks."""
    d = spark.read.schema(schema).json(path).select("*", F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("_file"))
    value = F.url_decode(F.url_decode(F.substring("_file", len(by) + 2, 2**31 - 1)))  # of the path, then of the name
    return d.withColumn(by, F.when(F.col("_file") != "null", value)).drop("_file").coalesce(tasks)
