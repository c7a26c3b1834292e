"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words: space, tab, LF, VT, FF, CR.
SPACE = " \t\n\x0b\x0c\r"
#: The same set inside a regular expression.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Spark's setting that removes a query's shuffle files when the query has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a new temporary folder (local mode only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-adloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers once per application, so that executors need not have it installed."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if getattr(context, "_adloom_shipped", False) or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="spark-adloom-")) / "adloom_tasks.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    context._adloom_shipped = True


class Scope:
    """Tables that shared_table() makes inside `with Scope()` are removed at its end, but for those of keep()."""

    open: list[Scope] = []

    def __enter__(self) -> Scope:
        self.made: list[DataFrame] = []
        Scope.open.append(self)
        return self

    def keep(self, stored: DataFrame) -> DataFrame:
        """The table goes to the scope around this one, if there is one."""
        self.made = [x for x in self.made if x is not stored]
        if len(Scope.open) > 1:
            Scope.open[-2].made.append(stored)
        return stored

    def __exit__(self, *error) -> None:
        Scope.open.remove(self)
        release(*self.made)


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends here, lost executors lose nothing.

    The files are removed by release(), or when the driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/adloom/{label}-{uuid.uuid4().hex}"
    # the written table takes the place of the shuffles behind it: their files go with the query, not when the driver
    # collects garbage
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._shared_path = path
    if Scope.open:
        Scope.open[-1].made.append(stored)
    return stored


def release(*stored: DataFrame) -> None:
    """Removes tables of shared_table() that no later plan reads."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: a lambda's argument is not an expression that is evaluated again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() alone would also change other scripts."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
