"""Tables written to the folder that every executor and the driver share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost executor
loses nothing that was written, and a later reader prunes columns, which a
checkpointed RDD can't.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

from glossia.sources.shared import new_folder, saved

__all__ = ["new_dir", "saved", "ship", "unused"]

new_dir = new_folder


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not."""
    while name in df.columns:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Give executors this package unless they already find it on their path."""
    import glossia

    package = os.path.dirname(os.path.abspath(glossia.__file__))
    root = os.path.dirname(package)
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in on_path or getattr(sc, "_glossia_shipped", False):
        return
    where = tempfile.mkdtemp(prefix="spark-package-")
    sc.addPyFile(shutil.make_archive(f"{where}/glossia", "zip", root, "glossia"))
    sc._glossia_shipped = True
