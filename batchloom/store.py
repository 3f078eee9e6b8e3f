"""Files and written tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_FALLBACK = "file:///tmp/batchloom"


def shared_dir(spark: SparkSession) -> str:
    """As ``spark.checkpoint.dir`` names it. Without that setting only a local master will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _FALLBACK


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: what made it (a provider's calls) isn't done again."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A path in any store that Spark's writers reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._own = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._own.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}") if name else self._own

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def rename(self, target: str) -> None:
        place = self._jvm.org.apache.hadoop.fs.Path(target)
        self._fs.mkdirs(place.getParent())
        if not self._fs.rename(self._own, place):
            raise OSError(f"{self.path} can't be renamed to {target}")

    def put(self, name: str, text: str | Iterable[str]) -> None:
        """A file of a text, or of blocks of text one after the other."""
        out = self._fs.create(self._at(name), True)
        try:
            for block in [text] if isinstance(text, str) else text:
                out.write(bytearray(block.encode("utf-8", "surrogateescape")))
        finally:
            out.close()

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def join(self, prefix: str, target: str) -> None:
        """One file of all files whose names begin with ``prefix``, in the order of names."""
        out = self._fs.create(self._jvm.org.apache.hadoop.fs.Path(target), True)
        try:
            for name in self.names():
                if name.startswith(prefix):
                    part = self._fs.open(self._at(name))
                    try:
                        self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                    finally:
                        part.close()
        finally:
            out.close()
