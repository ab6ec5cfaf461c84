"""Folders on any filesystem that Spark's Hadoop configuration reaches."""

from __future__ import annotations

from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder or file by its URI; small files are read and written from the driver, data by Spark."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self.path = self._fs.Path(self.uri)
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def of(cls, spark: SparkSession, place: Path | str | Folder) -> Folder:
        """A path on this machine, a URI, or a folder as it is."""
        if isinstance(place, Folder):
            return place
        return cls(spark, f"file://{place.resolve()}" if isinstance(place, Path) else place)

    def __truediv__(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.uri}/{name}")

    def __str__(self) -> str:
        return self.uri

    @property
    def parent(self) -> Folder:
        return Folder(self.spark, self.uri.rsplit("/", 1)[0])

    def exists(self) -> bool:
        return self.system.exists(self.path)

    def names(self) -> list[str]:
        """Names of what lies in the folder; none if it isn't there."""
        return [s.getPath().getName() for s in self.system.listStatus(self.path)] if self.exists() else []

    def make(self) -> None:
        self.system.mkdirs(self.path)

    def remove(self) -> None:
        self.system.delete(self.path, True)

    def move(self, target: Folder) -> None:
        """To a place where nothing is."""
        if target.exists() or not self.system.rename(self.path, target.path):
            raise FileExistsError(target.uri)

    def fetch(self, source: Path) -> None:
        """A copy of a file of this machine."""
        self.system.copyFromLocalFile(self._fs.Path(f"file://{source.resolve()}"), self.path)

    def read(self) -> str:
        stream = self.system.open(self.path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, text: str) -> None:
        """All or nothing: beside the file first, then in its place."""
        part = self.parent / f"{self.uri.rsplit('/', 1)[1]}.tmp"
        stream = self.system.create(part.path, True)
        stream.write(text.encode())
        stream.close()
        rename = getattr(self._fs, "Options$Rename")
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._fs.FileContext.getFileContext(self.path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part.path, self.path, options)

    def claim(self, text: str) -> bool:
        """Create the file with this text if it isn't there; whether it was created."""
        try:
            stream = self.system.create(self.path, False)
        except Py4JJavaError as e:
            if self.exists():
                return False
            raise e
        stream.write(text.encode())
        stream.close()
        return True

    def digests(self, skip: tuple[str, ...] = ("manifest.json",)) -> dict[str, str]:
        """The SHA-256 of each file below, taken by the executors; names that begin with a dot or an underscore don't count."""
        base = self.path.makeQualified(self.system.getUri(), self.system.getWorkingDirectory()).toString()
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.uri)
        # a row for each file comes to the driver, and goes into the manifest
        rows = files.select(F.substring("path", len(base) + 2, 10_000).alias("name"), F.sha2("content", 256).alias("sha")).where(~F.col("name").isin(*skip)).collect()
        return {r["name"]: r["sha"] for r in sorted(rows)}
