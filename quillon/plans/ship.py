"""Makes the package importable in Python workers that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ensure_shipped(spark: SparkSession) -> None:
    """Sends the package's sources to the workers by Spark's own file server, once for each context.

    Nothing is sent where workers find it anyway: by PYTHONPATH, or in the folder where a local
    session runs.
    """
    context = spark.sparkContext
    on_path = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or (context.master.startswith("local[") and Path.cwd() == ROOT) or getattr(context, "_quillon_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="quillon-")) / "quillon.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "quillon").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(path))
    context._quillon_shipped = True
