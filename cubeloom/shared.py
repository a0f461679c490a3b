"""Shared storage of a cluster: where what one task writes can be read by all."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from functools import cache

from pyarrow import fs
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared storage of the cluster.

    ``spark.checkpoint.dir`` is used where it is set.  Only a session that runs
    in one local process may do without, in a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or _local_root()
    return posixpath.join(root, f"{tag}-{uuid.uuid4().hex}")


@cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="cubeloom-")


def make_folder(uri: str) -> None:
    """A folder of any store that pyarrow knows, and those above it."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark can write to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
