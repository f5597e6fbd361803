"""A table that grows by commits: each adds all of its rows or none, and a transaction is committed once.

Rows go to a folder of their own under the table's path. A commit is a small file in ``_log``, numbered one above the last,
that names the folder; it is put in place by a rename that fails where another writer was first. What no commit
names isn't part of the table, so a writer that dies leaves nothing behind that is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommittedTable:
    """The table at ``path``, in any file system that Spark writes to and that renames in one step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self.root = self._path(self.path)
        self.files = self.root.getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), conf)
        self.log = self._path(self.root, "_log")

    def commits(self, after: int = 0) -> list[dict]:
        """version, transaction and folder of each commit above ``after``, in their order."""
        if not self.files.exists(self.log):
            return []
        names = sorted(s.getPath().getName() for s in self.files.listStatus(self.log))
        return [self._read(n) for n in names if n.endswith(".json") and int(n[:-5]) > after]

    def _read(self, name: str) -> dict:
        stream = self.files.open(self._path(self.log, name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, transaction: str | None, folder: str) -> bool:
        """Whether this commit is the one of that version."""
        draft = self._path(self.log, f".{uuid.uuid4().hex}")
        out = self.files.create(draft, True)
        out.write(json.dumps({"version": version, "transaction": transaction, "folder": folder}).encode())
        out.close()
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self.context.rename(draft, self._path(self.log, f"{version:020d}.json"), options)
            return True
        except Exception as failure:
            java = getattr(failure, "java_exception", None)
            if java is None or "FileAlreadyExists" not in java.getClass().getName():
                raise
            self.files.delete(draft, False)
            return False

    def _folders(self, commits: list[dict]) -> list[str]:
        return [f"{self.path}/{c['folder']}" for c in commits]

    def read(self, schema: str | None = None, after: int = 0) -> DataFrame | None:
        """The rows of all commits above ``after``; without one an empty table of ``schema``, or None."""
        folders = self._folders(self.commits(after))
        if folders:
            return self.spark.read.parquet(*folders)
        return None if schema is None else self.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame, transaction: str | None = None, keys: list[str] | None = None, unique: bool = True) -> bool:
        """Adds the rows, and says whether it did: a ``transaction`` that was committed before adds nothing.

        keys: rows whose keys the table has aren't added, nor, if keys are ``unique``, those that repeat among ``rows``.
        If another writer commits meanwhile, what it added is taken into account and the commit is tried again.
        """
        commits = self.commits()
        if transaction is not None and any(c["transaction"] == transaction for c in commits):
            return False
        if keys:
            rows = rows.dropDuplicates(keys) if unique else rows
            if commits:
                rows = self._lacking(rows, commits, keys)
        while True:
            folder = f"commit={uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folder}")
            self.files.mkdirs(self.log)
            while True:
                if self._commit(commits[-1]["version"] + 1 if commits else 1, transaction, folder):
                    return True
                new = self.commits(commits[-1]["version"] if commits else 0)
                commits += new
                if transaction is not None and any(c["transaction"] == transaction for c in new):
                    self.files.delete(self._path(self.root, folder), True)
                    return False
                if keys:
                    break
            # What was written here is read again, without what the others added, in place of what it came from.
            drafted = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
            rows = self._lacking(drafted, new, keys)

    def _lacking(self, rows: DataFrame, commits: list[dict], keys: list[str]) -> DataFrame:
        known = self.spark.read.parquet(*self._folders(commits)).select(*keys)
        fits = [F.col(f"new.{k}").eqNullSafe(F.col(f"known.{k}")) for k in keys]
        condition = fits[0]
        for fit in fits[1:]:
            condition = condition & fit
        return rows.alias("new").join(known.alias("known"), condition, "left_anti")

    def leftovers(self) -> Iterator[str]:
        """Folders that no commit names: of writers that died, or that are still at work."""
        if not self.files.exists(self.root):
            return
        named = {c["folder"] for c in self.commits()}
        for status in self.files.listStatus(self.root):
            name = status.getPath().getName()
            if name.startswith("commit=") and name not in named:
                yield name
