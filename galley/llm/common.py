"""What several operators of this subpackage share: scratch tables, size-checked broadcasts, SQL for words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_local_roots: dict[str, str] = {}
#: Folders of scratch tables made inside :func:`collecting`.
_collected: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="spark-galley-")
    return _local_roots[sc.applicationId]


class Scratch:
    """Tables that one operator writes to the shared folder to cut lineage. A lost executor costs no written table."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{scratch_root(spark)}/galley-{name}-{uuid.uuid4().hex}"
        self.count = 0
        for held in _collected:
            held.append(self.path)

    def write(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        """Write ``df`` and read it back."""
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that :meth:`write` gave and that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            for file in t.inputFiles()[:1]:
                folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
                folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def column(name: str) -> Column:
    """The column of that name, dots and backticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame, scratch: Scratch, *more: Column) -> DataFrame:
    """key (a long of its own for each row), row (a struct of all columns) and ``more``, written once so that keys stay the same.

    Equal rows are told apart by their keys, and no column of ``docs``, whatever its name or type, meets another.
    """
    return scratch.write(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*map(column, docs.columns)).alias("row"), *more), "zstd")


@contextmanager
def collecting() -> Iterator[list[str]]:
    """A list of the folders of scratch tables that operators make meanwhile."""
    made: list[str] = []
    _collected.append(made)
    try:
        yield made
    finally:
        _collected.remove(made)


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Delete the folders of scratch tables that nothing reads any more, as those of :func:`collecting` whose result is written."""
    for f in folders:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of at most this many bytes in all are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8_000_000


def small_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if ``rows`` counted rows fit in BROADCAST_BYTES, else ``df`` for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def words(text: Column | str) -> Column:
    """Words of a text in order, [] for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: str) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
