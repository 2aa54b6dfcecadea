"""Tables that are made once for a session, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_written: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is named and one machine does all, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """Where ``write`` has put what goes by that name in this session."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _written:
        path = f"{shared_folder(spark)}/made-{uuid.uuid4().hex}"
        write(path)
        _written[key] = path
    return _written[key]


def local_path(path: str) -> str:
    """A path for programs that know no file systems but the machine's; on a cluster, the folder must be mounted everywhere."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} is no mounted folder")
    return path.removeprefix("file://")
