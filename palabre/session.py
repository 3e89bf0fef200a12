"""Session settings, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import os
import pkgutil
import tempfile
import warnings
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType


def build_session(app: str = "palabre", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE with skew handling, Arrow."""
    b = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting
    is absent and the session is local (tests, a laptop) is a folder of our own made.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def uncompiled(spark: SparkSession) -> Iterator[None]:
    """What is run within it has no classes generated for its stages: of hundreds of short stages the driver compiles each, which takes more than it saves."""
    key = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints, set for the context if it wasn't. A cluster must name one; a local session gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "palabre-checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def spread(spark: SparkSession, rows: int, per_task: int) -> int:
    """Number of partitions that gives about ``per_task`` rows each, never under the parallelism."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_task))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_palabre_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    here = os.path.join(tempfile.mkdtemp(prefix="palabre-"), "palabre.zip")
    with zipfile.ZipFile(here, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "palabre")):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
    sc.addPyFile(here)
    sc._palabre_shipped = True


def java_function(spark: SparkSession, name: str, returns: DataType) -> str | None:
    """The SQL name of the function of three arguments whose Java source ``functions/<name>.java`` holds, known to this session and its executors.

    It is compiled once for each context, by the compiler that Spark has for its generated classes, and sent as a jar.
    None where the driver's JVM can't be reached or has no such compiler.
    """
    sc, sql_name = spark.sparkContext, f"palabre_{name.lower()}"
    made = sc.__dict__.setdefault("_palabre_java", {})
    if name not in made:
        made[name] = None
        try:
            compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.cook(pkgutil.get_data(__package__, f"functions/{name}.java").decode())
            jar = os.path.join(tempfile.mkdtemp(prefix="palabre-"), f"{sql_name}.jar")
            with zipfile.ZipFile(jar, "w") as z:
                for k, code in compiler.getBytecodes().items():
                    z.writestr(k.replace(".", "/") + ".class", bytes(code))
            sc._jsc.addJar(jar)
            made[name] = compiler.getClassLoader().loadClass(f"{__package__}.{name}").newInstance()
        except (TypeError, Py4JError) as e:  # no such class, or one that works otherwise
            warnings.warn(f"{name}.java isn't used: {str(e)[:500]}", stacklevel=2)
    if made[name] is None:
        return None
    spark._jsparkSession.udf().register(sql_name, made[name], spark._jsparkSession.parseDataType(returns.json()))
    return sql_name


def even(df: DataFrame, key: str) -> DataFrame:
    """``df`` over at least the session's parallelism: an input of fewer splits than cores is spread by ``key`` and row."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(2 * n, key)
