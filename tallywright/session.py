"""Where jobs may put intermediate data, and how code reaches the workers."""

from __future__ import annotations

import re
import sys
import tempfile

from uuid import uuid4

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder every machine sees, as the cluster names it.

    Only on a local master, as in tests, a fresh temporary folder stands in; a
    cluster without the setting is refused, since its machines share no such folder.
    """
    named = spark.conf.get(_SETTING, None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"{_SETTING} must name a folder that all machines see")
    return named or tempfile.mkdtemp(prefix="tallywright-")


def written_once(frame: DataFrame, name: str) -> DataFrame:
    """The rows, stored in the shared folder and read from there.

    What follows neither computes them again nor guesses their size: the planner
    broadcasts them only if the stored files are below its own threshold.
    """
    path = f"{shared_folder(frame.sparkSession).rstrip('/')}/{name}-{uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def ship(module_name: str) -> None:
    """Send a module's functions along with the jobs that use them.

    Python workers then need no installation of this package.
    """
    for name in (module_name, __name__):
        cloudpickle.register_pickle_by_value(sys.modules[name])
