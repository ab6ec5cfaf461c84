"""Publication: locks, digests, atomic files, content-addressed releases and batches with a head, on any shared filesystem.

A folder counts once its manifest is there; manifests are written last and renamed into place.  Executors write the data
and take the checksums, the driver handles small files alone.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ledger
from ..staging import brief_shuffles
from ..streaming.pipeline import code_version
from .folder import Folder

#: A path on this machine, or a URI.
Place = Path | str | Folder

class PublicationError(RuntimeError):
    """Something published isn't what it claims to be, or another writer is at work."""


def digest(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def identity(*parts: object) -> str:
    return digest(":".join(map(str, parts)))


def file_digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_json(place: Folder, value: object) -> None:
    """All or nothing."""
    place.write(json.dumps(value, indent=1, sort_keys=True, default=str))


#: Seconds for which a writer holds a lock without renewing it; clocks of writers must agree to well within that.
LEASE_S = 300.0


class Lease:
    """A held lock: a file that only one writer can create, with its holder, its number and the time it runs out.

    A thread renews it at each third of its time.  When a holder has died and its time is over, the next writer moves the
    file to a name made of its number, which only one of several can do, and takes the next number.  So a writer that was
    merely slow finds at ``check`` that the lock isn't its own any more, and publishes nothing.
    """

    def __init__(self, place: Folder, seconds: float = LEASE_S):
        self.place, self.seconds = place, seconds
        self.token, self.number, self.until = f"{socket.gethostname()} {os.getpid()} {uuid.uuid4().hex}", 0, 0.0
        self._done, self._renewing = threading.Event(), None

    def _text(self) -> str:
        self.until = time.time() + self.seconds
        return json.dumps({"holder": self.token, "number": self.number, "until": self.until})

    def _found(self) -> dict | None:
        """What the lock's file says; None if there is no lock.  A file that can't be read is held by someone who is writing it."""
        try:
            return json.loads(self.place.read())
        except json.JSONDecodeError:
            return {"holder": "?", "number": 0, "until": float("inf")}
        except Py4JJavaError:
            if self.place.exists():
                raise
            return None

    def acquire(self) -> None:
        """PublicationError if another writer holds the lock."""
        folder, name = self.place.parent, self.place.uri.rsplit("/", 1)[1]
        folder.make()
        before = self._found()
        if before is not None and before["until"] < time.time():
            with contextlib.suppress(FileExistsError, Py4JJavaError):  # another was faster
                self.place.move(folder / f"{name}.expired-{before['number']}")
        ended = [n.rsplit("-", 1)[1] for n in folder.names() if n.startswith(f"{name}.expired-")]
        self.number = max(map(int, ended), default=0) + 1
        if not self.place.claim(self._text()):
            raise PublicationError(f"{self.place} is held by another writer: {self._found()}")

    def mine(self) -> bool:
        found = self._found()
        return found is not None and found["holder"] == self.token and time.time() < self.until

    def check(self) -> None:
        """PublicationError if the lock has run out or is another's: to be called right before anything is published."""
        if not self.mine():
            raise PublicationError(f"{self.place} was lost: {self._found()}")

    def renew(self) -> None:
        self.check()
        self.place.write(self._text())

    def _keep(self) -> None:
        while not self._done.wait(self.seconds / 3):
            try:
                self.renew()
            except PublicationError:
                return
            except Exception:  # the filesystem may answer again before the time is over
                continue

    def keep(self) -> None:
        """Renew from now on, until ``release``."""
        self._renewing = threading.Thread(target=self._keep, daemon=True)
        self._renewing.start()

    def release(self) -> None:
        """The lock's file goes if it is still this writer's."""
        self._done.set()
        if self._renewing is not None:
            self._renewing.join()
        if self.mine():
            self.place.remove()


@contextlib.contextmanager
def writer_lock(place: Folder, seconds: float = LEASE_S) -> Iterator[Lease]:
    """Exclusive, without waiting; what a writer that died has left is taken over after ``seconds``."""
    lease = Lease(place, seconds)
    lease.acquire()
    lease.keep()
    try:
        yield lease
    finally:
        lease.release()


def verify(folder: Folder) -> dict:
    """The manifest, after the executors found its checksums to hold."""
    manifest = json.loads((folder / "manifest.json").read())
    try:
        found = folder.digests()
    except Exception as e:  # a file that can't be read whole isn't what was published
        raise PublicationError(f"{folder} can't be read") from e
    if found != manifest["files"]:
        raise PublicationError(f"{folder} isn't what its manifest says")
    return manifest


def publish_folder(target: Folder, fill: Callable[[Folder], dict], lease: Lease | None = None) -> dict:
    """Fill a folder beside ``target``, add the manifest, move it there; what is there already is verified.

    With a lease, the manifest has its number, and nothing is moved if the lock was lost meanwhile.
    """
    if target.exists():
        return verify(target)
    target.parent.make()
    part = target.parent / f"incoming-{uuid.uuid4().hex}"
    part.make()
    try:
        about = fill(part)
        manifest = about | {"files": part.digests()}
        if lease is not None:
            manifest["writer"] = lease.number
        write_json(part / "manifest.json", manifest)
        if lease is not None:
            lease.check()
        part.move(target)
        return manifest
    except BaseException:
        part.remove()
        raise


def archive_source(spark: SparkSession, source: Path, root: Place) -> Folder:
    """A copy of a source file in a folder named by its digest."""
    sha = file_digest(source)
    target = Folder.of(spark, root) / sha

    def fill(part: Folder) -> dict:
        (part / source.name).fetch(source)
        return {"source": source.name, "sha256": sha}

    publish_folder(target, fill)
    return target


#: Columns whose values hardly repeat: for each file a dictionary of them would be built, found useless and undone.
UNIQUE = ("source_row_id", "source_row", "content_hash", "signed_amount", "duplicate_of")


def _write_months(rows: DataFrame, path: str) -> None:
    """Ledger rows as a Parquet table by month: many small files, so what each costs counts."""
    writer = rows.write.partitionBy("transaction_month").option("compression", "zstd")
    for c in UNIQUE:
        writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
    writer.parquet(path)


#: Rows that a task classifies at most, and at least while there are idle cores: what it sorts stays in memory.
ROWS, FEW_ROWS = 750_000, 50_000


def _parts(spark: SparkSession, rows: int) -> int:
    return max(1, -(-rows // ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // FEW_ROWS)))


def build_release(raw: DataFrame, root: Place, source_sha: str, expected_rows: int | None = None, version: str | None = None, dealt_by: tuple[str, ...] = ()) -> str:
    """Audit, facts and dimensions as Parquet tables of a release named by source, rows and code; the release's id.

    The audit and the facts are partitioned by month.  The same input and code give the same id, whose tables are
    verified and not written again.  ``dealt_by`` names columns that rows of equal content share and by which ``raw`` is
    dealt out already: rows are classified where they are.
    """
    version, root = version or code_version(), Folder.of(raw.sparkSession, root)
    with writer_lock(root / "releases.lock") as lease, brief_shuffles(raw.sparkSession):
        # one pass over the source for its name and its totals
        rows = ledger.source_marks(raw).first()
        release = identity(source_sha, f"{rows['row_count']}/{rows['contents']}", version)

        def fill(part: Folder) -> dict:
            spark, parts = raw.sparkSession, _parts(raw.sparkSession, rows["row_count"])
            uri = lambda name: f"{part}/{name}"
            # rows that lie in smaller parts are still sorted part by part; a task writes a file for each month, so some share one
            _write_months(ledger.classify(raw, dealt_by).coalesce(parts) if dealt_by else ledger.classify(raw, parts=parts), uri("audit"))
            audit = spark.read.parquet(uri("audit"))
            _write_months(ledger.facts(audit), uri("facts"))
            facts = spark.read.parquet(uri("facts"))
            # one pass by key gives a dimension and what its lines are counted by
            lines, keys, dims = F.count("*").alias("lines"), [], []
            for name, gathered in (("products", ledger.products(facts, lines)), ("customers", ledger.customers(facts, lines))):
                gathered.write.parquet(uri(f"keys/{name}"))
                keys.append(spark.read.parquet(uri(f"keys/{name}")))
                keys[-1].drop("lines").write.parquet(uri(name))
                dims.append(spark.read.parquet(uri(name)))
            figures = ledger.reconcile(raw, audit, facts, *dims, expected_rows, rows, tuple(keys), parts)
            (part / "keys").remove()
            profile = ledger.input_profile(audit, *dims).first().asDict()
            write_json(part / "quality.json", figures | profile | {"dispositions": [r.asDict() for r in ledger.dispositions(audit).collect()]})
            return {"release": release, "source": source_sha, "version": version}

        publish_folder(root / release, fill, lease)
        return release


def release_table(spark: SparkSession, root: Place, release: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{Folder.of(spark, root) / release / name}")


def register_release(spark: SparkSession, root: Place, release: str, prefix: str = "retail") -> list[str]:
    """A release's tables in the session's catalogue, with statistics for the optimiser; their names."""
    names = []
    for name in ("audit", "facts", "customers", "products"):
        table = f"{prefix}_{name}"
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{Folder.of(spark, root) / release / name}'")
        if "transaction_month" in spark.table(table).columns:
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
        names.append(table)
    return names


class BatchStore:
    """Batches of rows by data set, with a head that names the current one.

    A new id is written, read back and compared before the head moves to it.  A known id with the same content is
    verified and leaves the head where it is; with other content it is an error.

    Rows lie in order of ``key``, so files hold ranges of it.  A small table beside them (``ranges``) says what each file
    holds, by the values of ``facets`` (columns of few values): lookups and pages open the files that they need alone.
    """

    def __init__(self, spark: SparkSession, root: Place, key: str = "customer_id", facets: tuple[str, ...] = ()):
        self.spark, self.root, self.key, self.facets = spark, Folder.of(spark, root), key, facets

    def _folder(self, dataset: str, batch: str) -> Folder:
        if "/" in dataset or "/" in batch or batch.startswith("."):
            raise ValueError("names must not hold a path")
        return self.root / dataset / batch

    @staticmethod
    def content(about: object, rows: DataFrame) -> str:
        """A digest of the batch's description and its rows, in any order."""
        columns = sorted(rows.columns)
        sums = rows.select(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("h")).groupBy("h").count().agg(F.count("*"), F.sum("count"), *(F.sum(F.xxhash64("h", "count", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2))).first()
        return digest(f"{about}|{'|'.join(map(str, sums))}")

    def publish(self, dataset: str, batch: str, about: object, rows: DataFrame, check: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Whether the batch is new.  ``check`` gives rows that break a rule; none may."""
        with writer_lock(self.root / dataset / "store.lock") as lease:
            folder, sha = self._folder(dataset, batch), self.content(about, rows)
            if folder.exists():
                if verify(folder)["content"] != sha:
                    raise PublicationError(f"batch {batch} is there with other content")
                return False
            if check is not None and (bad := check(rows).take(3)):
                raise PublicationError(f"batch {batch} breaks a rule: {[r.asDict() for r in bad]}")

            def fill(part: Folder) -> dict:
                rows.orderBy(self.key).write.parquet(f"{part}/rows")
                stored = self.spark.read.parquet(f"{part}/rows")
                if self.content(about, stored) != sha:
                    raise PublicationError("the stored rows aren't those given")
                self._ranges(stored).write.parquet(f"{part}/ranges")
                write_json(part / "schema.json", stored.schema.jsonValue())
                return {"content": sha, "about": str(about)}

            publish_folder(folder, fill, lease)
            self._move_head(dataset, batch, lease)
            return True

    def _move_head(self, dataset: str, batch: str, lease: Lease) -> None:
        head = self.root / dataset / "current.json"
        lease.check()
        if head.exists() and json.loads(head.read()).get("writer", 0) > lease.number:
            raise PublicationError(f"{head} was moved by a later writer")
        write_json(head, {"batch": batch, "writer": lease.number})

    def current(self, dataset: str) -> str | None:
        head = self.root / dataset / "current.json"
        return json.loads(head.read())["batch"] if head.exists() else None

    def rows(self, dataset: str, batch: str | None = None) -> DataFrame | None:
        """Rows of a batch, by default the current one; None if there is none."""
        folder = self._published(dataset, batch)
        return None if folder is None else self.spark.read.parquet(f"{folder}/rows")

    def _published(self, dataset: str, batch: str | None) -> Folder | None:
        batch = batch or self.current(dataset)
        if batch is None or not (self._folder(dataset, batch) / "manifest.json").exists():
            return None
        return self._folder(dataset, batch)

    def _ranges(self, stored: DataFrame) -> DataFrame:
        """For each file and values of the facets: the least and the greatest key and the number of keys, in order of keys."""
        named = stored.select(F.col("_metadata.file_name").alias("file"), self.key, *self.facets)
        found = named.groupBy("file", *self.facets).agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count(self.key).alias("keys"))
        return found.coalesce(1).sortWithinPartitions("low")  # a row for each file and facet

    def _held(self, folder: Folder, where: dict[str, object]) -> DataFrame | None:
        """The ranges of files that hold rows with these values of facets; None for a batch that has no ranges."""
        if not (folder / "ranges").exists() or not set(where) <= set(self.facets):
            return None
        types = {c: self._schema(folder)[c].dataType for c in (self.key, *self.facets)}
        schema = T.StructType([T.StructField("file", T.StringType()), *(T.StructField(c, types[c]) for c in self.facets), T.StructField("low", types[self.key]), T.StructField("high", types[self.key]), T.StructField("keys", T.LongType())])
        ranges = self.spark.read.schema(schema).parquet(f"{folder}/ranges")
        for column, value in where.items():
            ranges = ranges.where(F.col(column) == value)
        return ranges.groupBy("file").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("keys").alias("keys"))

    @staticmethod
    def _schema(folder: Folder) -> T.StructType:
        return T.StructType.fromJson(json.loads((folder / "schema.json").read()))

    def _open(self, folder: Folder, files: list[str]) -> DataFrame:
        """These files' rows: nothing else is listed or opened, not even for the schema."""
        schema = self._schema(folder)
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{folder}/rows/{f}" for f in files])

    def lookup(self, dataset: str, key: object, batch: str | None = None) -> DataFrame | None:
        """The rows of a key, from the files whose range has it in it; None if there is no such batch."""
        folder = self._published(dataset, batch)
        if folder is None:
            return None
        held = self._held(folder, {})
        if held is None:
            rows = self.spark.read.parquet(f"{folder}/rows")
        else:
            # ranges of sorted files meet at their ends at most: one file, or those that share a repeated key
            files = held.where((F.col("low") <= key) & (F.col("high") >= key)).select("file").collect()
            rows = self._open(folder, [r["file"] for r in files])
        return rows.where(F.col(self.key) == key)

    def following(self, dataset: str, n: int, after: object = None, batch: str | None = None, **where) -> DataFrame | None:
        """Rows of the files that hold the first ``n`` keys beyond ``after`` with these values of facets, perhaps with others.

        Each file in question has such a row, so ``n`` files are enough, and fewer are opened where their counts say so.
        None if there is no such batch.
        """
        folder = self._published(dataset, batch)
        if folder is None:
            return None
        held = self._held(folder, where)
        if held is None:
            return self.spark.read.parquet(f"{folder}/rows")
        beyond = held if after is None else held.where(F.col("high") > after)
        files, found = [], 0
        for r in beyond.select("file", "keys", (F.col("low") > after if after is not None else F.lit(True)).alias("whole")).orderBy("low").limit(n).collect():
            files.append(r["file"])
            found += r["keys"] if r["whole"] else 1
            if found >= n:
                break
        return self._open(folder, files)
