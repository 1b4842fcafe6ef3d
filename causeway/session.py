"""Sessions and the shipping of this package to executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="causeway-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch the file while the application runs
    target = Path(folder) / "causeway.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"causeway/{p.relative_to(here)}")
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for one machine, as tests and the bench use it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("causeway")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"), **conf}
    return builder.config(map=settings).getOrCreate()
