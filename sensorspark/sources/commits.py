"""Commits: small JSON manifests that make stored folders valid, all or nothing.

A writer stores its data in a folder of its own and then puts one manifest,
which names the folder, in place by an atomic rename that fails where a manifest
of that name exists.  Readers list the manifests and read only the folders they
name.  A writer that is lost before the rename leaves the table as it was; one
that runs again finds its manifest and does nothing.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from sensorspark.session import path_exists


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, p):
    return p.getFileSystem(spark._jsc.hadoopConfiguration())


def put_manifest(spark: SparkSession, folder: str, name: str, content: dict) -> bool:
    """Put ``content`` in place as ``folder/name.json``; False where it exists."""
    tmp, final = _path(spark, f"{folder}/.{name}-{uuid.uuid4().hex}"), _path(spark, f"{folder}/{name}.json")
    fs = _fs(spark, final)
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(tmp, final, options)
    except Py4JJavaError:
        fs.delete(tmp, False)
        if fs.exists(final):
            return False
        raise
    return True


def manifests(spark: SparkSession, folder: str) -> dict[str, dict]:
    """name -> content of every manifest in ``folder``, by name."""
    if not path_exists(spark, folder):
        return {}
    root = _path(spark, folder)
    fs, out = _fs(spark, root), {}
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.endswith(".json") and not name.startswith("."):
            f = fs.open(s.getPath())
            try:
                out[name[:-5]] = json.loads(bytes(f.readAllBytes()).decode())
            finally:
                f.close()
    return dict(sorted(out.items()))


def remove_unnamed(spark: SparkSession, folder: str, named) -> int:
    """Delete the sub-folders of ``folder`` that no manifest names (what lost
    writers left); run it while no writer is at work."""
    if not path_exists(spark, folder):
        return 0
    fs, n = _fs(spark, _path(spark, folder)), 0
    for s in fs.listStatus(_path(spark, folder)):
        if s.getPath().getName() not in set(named):
            n += bool(fs.delete(s.getPath(), True))
    return n
