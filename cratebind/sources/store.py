"""Durable state: remembered matches, choices by hand and aliases, as versions of a table with a log of commits.

A new version is written beside the others and counts from the moment its commit is there, which is a file of the next number that only
one writer can make. A writer that finds the number taken reads again and repeats its change on what is there now, so no change is
lost; a writer that ends before its commit has changed nothing. Former versions stay as backups, the last few of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as T
from ..operators import caches

# fixed values: what the tables hold
LEARNED = "key string, path string, bitrate int"
MANUAL = "key string, path string"
ALIASES = "variant string, canonical string"


class Conflict(Exception):
    """Other writers were quicker each time."""


class Table:
    """A table of a store: `name` below `folder`, of the given columns."""

    def __init__(self, spark: SparkSession, folder: str, name: str, schema: str):
        self.spark, self.root, self.schema = spark, f"{folder.rstrip('/')}/{name}", schema

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[str]:
        """The commits that are there, the last one last; each is named by its number and its version."""
        fs, place = self._files(), self._path("commits")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(n for n in names if not n.startswith("."))

    def read(self, commit: str | None = None) -> DataFrame:
        """The table as of a commit, the last one if none is named; empty before the first."""
        found = commit or next(iter(self.commits()[::-1]), None)
        if found is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{self._version(found)}")

    def _version(self, commit: str) -> str:
        stream = self._files().open(self._path("commits", commit))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, number: int, version: str) -> bool:
        """Make the commit of a number, unless it is there: written under a hidden name and moved, whole, to its own."""
        jvm, fs = self.spark._jvm, self._files()
        place, hidden = fs.makeQualified(self._path("commits", f"{number:012d}")), fs.makeQualified(self._path("commits", f".{uuid.uuid4().hex}"))
        stream = fs.create(hidden, False)
        stream.write(version.encode())
        stream.close()
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # never over another
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(hidden, place, never)
        except Py4JJavaError as e:
            fs.delete(hidden, False)
            if fs.exists(place):
                return False
            raise e
        return True

    def update(self, change: Callable[[DataFrame], DataFrame], retries: int = 10, backups: int = 5) -> str:
        """Replace the table by change(table); the commit's name. Another writer's commit in between repeats the change."""
        for _ in range(retries):
            last = next(iter(self.commits()[::-1]), None)
            version = f"versions/{uuid.uuid4().hex}"
            change(self.read(last)).select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.root}/{version}")
            number = int(last or 0) + 1
            if self._commit(number, version):
                self._forget(backups)
                return f"{number:012d}"
            self._files().delete(self._path(version), True)
        raise Conflict(self.root)

    def restore(self, commit: str) -> str:
        """Make a former version the present one again."""
        former = self.read(commit)
        return self.update(lambda _: former)

    def _forget(self, backups: int) -> None:
        """Delete all versions but the present one and the `backups` before it, with their commits."""
        for commit in self.commits()[: -backups - 1]:
            self._files().delete(self._path(self._version(commit)), True)
            self._files().delete(self._path("commits", commit), False)


class Memory:
    """What is remembered between runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.learned = Table(spark, folder, "learned", LEARNED)
        self.manual = Table(spark, folder, "manual", MANUAL)
        self.aliases = Table(spark, folder, "aliases", ALIASES)

    def remember(self, rows: DataFrame, order: list[str]) -> str:
        """Take rows(key, path, bitrate and the order columns) in; the last of a key counts."""
        return self.learned.update(lambda old: caches.upsert(old, rows, order))

    def choose(self, choices: DataFrame) -> str:
        """Take choices(label, path) in, each under all keys of its label, and under the last path of a key by `order`, if there is one."""
        last = "order" if "order" in choices.columns else "path"
        new = choices.select(F.explode(K.manual_keys(F.col("label"))).alias("key"), "path", F.col(last).alias("__last")).groupBy("key").agg(F.max_by("path", "__last").alias("path"))
        return self.manual.update(lambda old: old.join(new, "key", "left_anti").unionByName(new))

    def accept(self, pairs: DataFrame) -> str:
        """Take accepted aliases(variant, canonical) in: not those that say nothing new, and no variant twice."""
        said = pairs.where("trim(variant) <> '' and trim(canonical) <> ''").where(T.norm_alias(F.col("variant")) != T.norm_alias(F.col("canonical")))
        once = said.groupBy("variant").agg(F.max("canonical").alias("canonical"))

        def change(old: DataFrame) -> DataFrame:
            known = old.select(T.norm_alias(F.col("variant")).alias("__v"), T.norm_alias(F.col("canonical")).alias("__c")).distinct()
            same = (T.norm_alias(F.col("variant")) == F.col("__v")) & (T.norm_alias(F.col("canonical")) == F.col("__c"))
            new = once.join(known, same, "left_anti")
            return old.join(new, "variant", "left_anti").unionByName(new)

        return self.aliases.update(change)
