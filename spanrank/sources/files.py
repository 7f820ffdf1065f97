"""Small files on whatever file system a cluster shares, through Hadoop's clients.

Only names and a few bytes go through the driver; tables are written by Spark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.gateway = spark.sparkContext._gateway
        # A plain path is one of the driver's machine, as it always was on one machine.
        self.root = (root if "://" in root else f"file://{root}").rstrip("/")
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, name: str = ""):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not be there yet; whether it was not.  Its whole text
        appears at once: a draft is renamed into place without overwriting."""
        return self.renamed(self.draft(text), name, "NONE")

    def replace(self, name: str, text: str) -> None:
        """Write a file over an old one, at once."""
        self.renamed(self.draft(text), name, "OVERWRITE")

    def draft(self, text: str):
        place = self.path(f".draft-{uuid.uuid4().hex}")
        out = self.fs.create(place, False)
        out.write(text.encode())
        out.close()
        return place

    def renamed(self, draft, name: str, how: str) -> bool:
        options = self.gateway.new_array(self.hadoop.Options.Rename, 1)
        options[0] = self.hadoop.Options.Rename.valueOf(how)
        try:
            self.hadoop.FileContext.getFileContext(self.path().toUri(), self.conf).rename(draft, self.path(name), options)
            return True
        except Exception:
            self.fs.delete(draft, False)
            if how == "NONE" and self.exists(name):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
