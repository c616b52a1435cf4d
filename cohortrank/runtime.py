"""Getting the library's code to Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make the library importable on the workers, where PYTHONPATH does not do that already."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="code-")) / "cohortrank_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(Path(__file__).parent.rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
        if (pipeline := ROOT / "corpus_pipeline.py").exists():
            out.write(pipeline, pipeline.name)
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
