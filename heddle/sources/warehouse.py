"""A folder that holds a database: pieces of tables, and the catalog's versions.

A piece is a Parquet folder under ``data`` whose name is never used again. A
commit writes the next numbered file under ``catalog``, complete before it has
its name; the one of the greatest number counts. So a statement or transaction
happens as a whole or not at all, whatever ends it, and what an older catalog
names stays until ``vacuum``.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from heddle.errors import TransactionError

#: Versions of the catalog that are kept.
KEPT = 8


class Warehouse:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils
        self.number = max(self._numbers(), default=0)

    def _numbers(self) -> list[int]:
        where = self._path(f"{self.folder}/catalog")
        names = [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def load(self) -> dict | None:
        """The catalog's last version."""
        if not self.number:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/catalog/{self.number:012d}.json"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, state: dict) -> None:
        """Make ``state`` the catalog, unless somebody else has changed it since it was loaded."""
        target = self._path(f"{self.folder}/catalog/{self.number + 1:012d}.json")
        if max(self._numbers(), default=0) != self.number:
            raise TransactionError("another session has changed this database", "open it again")
        new = self._path(f"{self.folder}/catalog/.{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(json.dumps(state).encode())
        out.close()
        if not self._fs.rename(new, target):
            raise TransactionError("another session has changed this database", "open it again")
        self.number += 1
        for old in self._numbers()[:-KEPT]:
            self._fs.delete(self._path(f"{self.folder}/catalog/{old:012d}.json"), False)

    def write(self, df: DataFrame, name: str) -> str:
        """A new piece, by its name under ``data``."""
        piece = f"{re.sub(r'[^A-Za-z0-9_]', '_', name)}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/data/{piece}")
        return piece

    def path(self, piece: str) -> str:
        return f"{self.folder}/data/{piece}"

    def delete(self, piece: str) -> None:
        self._fs.delete(self._path(self.path(piece)), True)

    def vacuum(self, live: set[str]) -> list[str]:
        """Delete all pieces but ``live``."""
        where = self._path(f"{self.folder}/data")
        names = [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []
        gone = sorted(set(names) - live)
        for piece in gone:
            self.delete(piece)
        return gone
