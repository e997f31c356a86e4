"""Make the package importable for Python workers; tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()
#: Rows that one task is dealt where rows are sorted.
TASK_ROWS = 300_000


def workers_see_package() -> bool:
    return ROOT in map(os.path.abspath, [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))])


def ship(spark: SparkSession) -> None:
    """Send the package's source to the workers once an application, unless they find it by themselves."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or workers_see_package():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="shapeflow-"), "shapeflow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "shapeflow")):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, ROOT))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a new temporary one, but only if driver and
    executors are one process (tests); on a cluster that raises, as no folder of one machine is seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shapeflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def tasks(rows: DataFrame, times: int = 1, count: int | None = None) -> int:
    """Among how many tasks to deal ``rows``, each of which becomes ``times`` rows: the session's partitions, or more on a larger table.
    Rows are counted where no ``count`` is given.

    So a task's share, and the memory it sorts in, stays as it is however long the table grows. Adaptive execution would
    merge partitions by their compressed bytes, which are a small part of what their rows take in memory; a number that is named stays.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows.count() if count is None else count) * times // TASK_ROWS))


def numbers_of(rows: DataFrame, number: str) -> int:
    """How many numbers from 0 to the largest there are."""
    return (rows.agg(F.max(number)).first()[0] or 0) + 1


def one_task_each(rows: DataFrame, number: str, numbers: int | None = None) -> DataFrame:
    """``rows`` dealt by a number from 0 that they have, each number to a task of its own: hashes of numbers would put some of them together, more the more there are."""
    return rows.repartitionById(numbers or numbers_of(rows, number), F.col(number))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
