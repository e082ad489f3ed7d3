"""A keyed table as a base and a log of changes.

The reference changes one cell at a time.  Plain Parquet has no MERGE, and writing a
whole catalogue for a few sold items doesn't scale, so a commit writes only the rows
of the keys it changes:

* ``deltas/<transaction>/<attempt>``: the new rows of the changed keys, ``_deleted``
  for keys that go;
* ``commits/<number>``: a small file that names the delta.  It is created only if it
  doesn't exist, so of two writers that read the same state one comes first;
  the other sees the conflict, reads the new state and computes its change again.
  Nothing is lost and nothing is applied on a stale state.

A reader takes the last base and replaces the keys that later commits changed by
their newest rows: the base is scanned once and anti-joined with the changed keys,
without a shuffle of the base while those fit a broadcast (Spark checks the size).
After ``compact_every`` commits the merged table becomes the next base, by a commit
of its own.  A transaction that was committed is not applied again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.sources.tables import file_system, read_table


class Conflict(Exception):
    """Another writer has taken the commit number."""


class ChangeLog:
    """``key``: a column expression name of the table, by which rows are replaced; all rows
    of a key change together, rows whose key is null never do."""

    def __init__(self, spark: SparkSession, base: str, key: Callable[[], "F.Column"] | None = None, compact_every: int = 32):
        self.spark, self.base, self.compact_every = spark, base.rstrip("/"), compact_every
        self.key = key or (lambda: F.col("sku"))

    # ------------------------------------------------------------ commits
    def _marker(self, number: int) -> str:
        return f"{self.base}/commits/{number:012d}"

    def numbers(self) -> list[int]:
        fs, p = file_system(self.spark, f"{self.base}/commits")
        if not fs.exists(p):
            return []
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit())

    def version(self) -> int:
        """Number of the newest commit; -1 before the first."""
        return max(self.numbers(), default=-1)

    def _read_marker(self, number: int) -> dict:
        fs, p = file_system(self.spark, self._marker(number))
        for wait in (0, 0.05, 0.2, 1, 5):  # its writer may just be writing it
            time.sleep(wait)
            stream = fs.open(p)
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                return json.loads(text)
        raise OSError(f"{self._marker(number)} was never finished")

    def _write_marker(self, number: int, entry: dict) -> None:
        fs, p = file_system(self.spark, self._marker(number))
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise Conflict(number) from e
            raise
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
        out.close()

    def _since_base(self, upto: int) -> tuple[str, list[tuple[int, str]]]:
        """Folder of the last base up to commit ``upto``, and the later deltas."""
        deltas = []
        for n in range(upto, -1, -1):
            entry = self._read_marker(n)
            if entry["kind"] == "base":
                return entry["folder"], deltas
            deltas.append((n, entry["folder"]))
        raise ValueError(f"no table under {self.base}")

    def _committed(self, transaction: str, after: int = -1) -> int | None:
        for n in reversed([x for x in self.numbers() if x > after]):
            if self._read_marker(n).get("transaction") == transaction:
                return n
        return None

    # ------------------------------------------------------------ reading
    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a commit, by default the newest."""
        upto = self.version() if version is None else version
        base, deltas = self._since_base(upto)
        rows = read_table(self.spark, f"{self.base}/{base}")
        if not deltas:
            return rows
        changes = self._changes(deltas)
        newest = changes.groupBy("_key").agg(F.max("_commit").alias("_newest"))
        kept = rows.withColumn("_key", self.key()).join(newest, "_key", "left_anti").select(*rows.columns)
        put = changes.join(newest, "_key").where((F.col("_commit") == F.col("_newest")) & ~F.col("_deleted")).select(*rows.columns)
        return kept.unionByName(put)

    def _changes(self, deltas: list[tuple[int, str]]) -> DataFrame:
        """Rows of the deltas with their key and commit."""
        number = F.create_map(*[x for n, f in deltas for x in (F.lit(f), F.lit(n))])
        folder = F.regexp_extract(F.col("_metadata.file_path"), "/(deltas/[^/]+/[^/]+)/[^/]+$", 1)
        schema = read_table(self.spark, f"{self.base}/{deltas[0][1]}").schema
        rows = self.spark.read.schema(schema).parquet(*[f"{self.base}/{f}" for _, f in deltas])
        return rows.withColumns({"_commit": F.try_element_at(number, F.replace(folder, F.lit("%20"), F.lit(" "))), "_key": self.key()})

    # ------------------------------------------------------------ writing
    def create(self, rows: DataFrame) -> None:
        """The first base; a table that exists is left as it is."""
        if self.version() >= 0:
            return
        folder = f"bases/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.base}/{folder}")
        try:
            self._write_marker(0, {"kind": "base", "folder": folder})
        except Conflict:
            pass

    def commit(self, transaction: str, change: Callable[[DataFrame], DataFrame], attempts: int = 20) -> int:
        """Apply ``change`` to the newest state and return the commit's number.

        ``change`` takes the table to the new rows of the keys that change (all rows
        of each), with ``_deleted`` true on keys that go.  It is called again if
        another writer was first, so it must depend on nothing but the table given.
        ``transaction`` names the change ([0-9a-zA-Z_-]): committed once, it isn't
        applied again."""
        tried, _ = file_system(self.spark, self.base)
        _, p = file_system(self.spark, f"{self.base}/deltas/{transaction}")
        if tried.exists(p):  # an earlier attempt got this far; a new transaction needs no search
            done = self._committed(transaction)
            if done is not None:
                return done
        for _ in range(attempts):
            seen = self.version()
            delta = change(self.read(seen))
            if "_deleted" not in delta.columns:
                delta = delta.withColumn("_deleted", F.lit(False))
            folder = f"deltas/{transaction}/{uuid.uuid4().hex}"
            delta.write.parquet(f"{self.base}/{folder}")
            try:
                self._write_marker(seen + 1, {"kind": "delta", "folder": folder, "transaction": transaction})
            except Conflict:
                done = self._committed(transaction, after=seen)
                if done is not None:
                    return done
                continue
            self._maybe_compact(seen + 1)
            return seen + 1
        raise Conflict(f"{transaction}: {attempts} attempts met other writers")

    def _maybe_compact(self, number: int) -> None:
        _, deltas = self._since_base(number)
        if len(deltas) >= self.compact_every:
            self.compact()

    def compact(self) -> None:
        """Write the merged table as the next base; given up if another commit is faster."""
        seen = self.version()
        folder = f"bases/{uuid.uuid4().hex}"
        self.read(seen).write.parquet(f"{self.base}/{folder}")
        try:
            self._write_marker(seen + 1, {"kind": "base", "folder": folder})
        except Conflict:
            pass
