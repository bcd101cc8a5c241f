"""Tables with unique keys that are published whole, generation by generation.

A writer puts a new generation into a folder of its own and then publishes it by renaming a small file to the number
after the one it has read.  The rename fails where that number is taken, so of two writers with one parent the second
gets ``StaleWriter`` and nothing of the first is lost; readers see the last published generation, never half a write.
What a crash before publication leaves is a folder that no one reads.

Keys are checked before publication: a null or repeated key raises ValueError.  The folder may be any that Spark writes to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleWriter(RuntimeError):
    """Another generation has been published since the one that this write began from."""


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        return self._fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generation(self) -> int:
        """Number of the last published generation, 0 before the first."""
        files, published = self._files(), self._path("published")
        if not files.exists(published):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(published)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, generation: int | None = None) -> DataFrame:
        """The rows of a generation, the last one if none is named.  Raises LookupError before the first."""
        n = self.generation() if generation is None else generation
        if not n:
            raise LookupError(f"nothing published in {self.folder}")
        data = self.spark.read.text(f"{self.folder}/published/{n:09d}").first()[0]
        return self.spark.read.parquet(f"{self.folder}/{data}")

    def write(self, rows: DataFrame) -> str:
        """Name of a new data folder with the rows, which nobody reads before it is published."""
        data = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{data}")
        made = self.spark.read.parquet(f"{self.folder}/{data}")
        if made.where(" OR ".join(f"`{k}` IS NULL" for k in self.keys)).limit(1).count():
            raise ValueError("null in a key")
        if made.groupBy(*self.keys).count().where(F.col("count") > 1).limit(1).count():
            raise ValueError("a key is repeated")
        return data

    def publish(self, data: str, parent: int) -> int:
        """Make a written folder the generation after ``parent``, and return its number."""
        files = self._files()
        files.mkdirs(self._path("published"))
        draft = self._path("published", f"draft-{uuid.uuid4().hex}")
        out = files.create(draft, True)
        out.write(bytearray(data.encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 1)
        never_over[0] = self._fs.Options.Rename.NONE
        try:
            context.rename(draft, self._path("published", f"{parent + 1:09d}"), never_over)
        except Exception as e:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise StaleWriter(f"generation {parent + 1} of {self.folder} is another writer's") from None
            raise
        return parent + 1

    def replace(self, rows: DataFrame) -> int:
        parent = self.generation()
        return self.publish(self.write(rows), parent)

    def upsert(self, fresh: DataFrame) -> int:
        """Fresh rows take the place of stored ones of their keys; other rows stay."""
        parent = self.generation()
        if not parent:
            return self.publish(self.write(fresh), 0)
        stored = self.read(parent)
        left = stored.join(fresh.select(*self.keys), self.keys, "left_anti").select(*stored.columns)
        return self.publish(self.write(left.unionByName(fresh, allowMissingColumns=True)), parent)
