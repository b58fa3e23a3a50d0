"""Small control files on whatever file system the shared folder lives on."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, make = _fs(spark, path)
    return fs.exists(make(path))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly under a folder; empty if there is no such folder."""
    fs, make = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(make(path))) if fs.exists(make(path)) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder with all that is in it, if it is there."""
    fs, make = _fs(spark, path)
    fs.delete(make(path), True)


def commit_json(spark: SparkSession, path: str, content: dict) -> None:
    """Write a JSON file under a name of its own, then give it its final name, unless that is taken: readers see all of it or nothing.

    Of two writers of one name exactly one succeeds, the other gets an error: on local files by
    a hard link, elsewhere by a rename that doesn't replace, which is atomic on HDFS.  An object
    store without such a rename needs a store of its own for the manifests.
    """
    fs, make = _fs(spark, path)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    out = fs.create(make(draft), False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            plain = [make(p).toUri().getPath() for p in (draft, path)]
            os.link(*plain)
        else:
            context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            nothing = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(make(draft), make(path), nothing)
    except Exception as error:
        raise OSError(f"cannot commit {path}: another writer was first") from error
    finally:
        fs.delete(make(draft), False)


def read_json(spark: SparkSession, path: str) -> dict:
    fs, make = _fs(spark, path)
    stream = fs.open(make(path))
    text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    stream.close()
    return json.loads(text)


def ingest(spark: SparkSession, path: str):
    """path, content_id, media, size: binary files with their content address (SHA-256) and the kind their first bytes tell."""
    from pyspark.sql import functions as F

    head = F.hex(F.substring("content", 1, 8))
    media = (
        F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("504B0304"), "application/zip").when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("1F8B"), "application/gzip").when(head.startswith("50415231"), "application/parquet").otherwise("text/plain")
    )
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("content_id"), media.alias("media"), F.col("length").alias("size"))
