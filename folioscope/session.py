"""What a session needs before a query runs."""
from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_folioscope_shipped", False):
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as out:
        for path in sorted(HERE.rglob("*.py")):
            out.write(path, Path(HERE.name) / path.relative_to(HERE))
    # the driver's file server hands it out; nothing is read from this folder on other machines
    place = Path(tempfile.mkdtemp()) / "folioscope.zip"
    place.write_bytes(body.getvalue())
    context.addPyFile(str(place))
    context._folioscope_shipped = True


def checkpointing(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's ``spark.checkpoint.dir``; a temporary one only where it is unset and everything runs in this process.

    The temporary folder is removed when this process ends.  In a shared folder
    Spark removes a checkpoint when nothing refers to it any more, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    place = spark.conf.get("spark.checkpoint.dir", "") or ""
    context = spark.sparkContext
    if not place:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        place = getattr(context, "_folioscope_checkpoints", "")
        if not place:
            place = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, place, ignore_errors=True)
        context._folioscope_checkpoints = place
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(place)
    return place
