"""Replacement of whole tables by staged versions: written, read back, checked, and only then made current.

A table is a folder with versions and a list of commits, in any store that Spark writes to. A new version is written beside the
current one, counted while it is written and again from its files, and handed to gates together with the current one. Only if all
of that holds is a commit added, which is one small file; readers take the version of the last commit, so they see the old rows or
the new ones and never a part. A refused version is removed, and any earlier one can be made current again. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

#: Takes the current rows (None at first) and the staged ones, and says why the staged ones can't replace them, if so.
Gate = Callable[[DataFrame | None, DataFrame], str | None]


class Refused(ValueError):
    """A staged version didn't pass; the current one stays."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def commits(self) -> list[tuple[int, str, int]]:
        """(number, version, rows) of all commits, a few small rows in order."""
        files, path = self._path(f"{self.root}/commits")
        if not files.exists(path):
            return []
        rows = self.spark.read.schema("n long, version string, n_rows long").parquet(f"{self.root}/commits").collect()
        return sorted((r.n, r.version, r.n_rows) for r in rows)

    def read(self, version: str | None = None) -> DataFrame | None:
        """The rows of a version, the current one if none is named; None before the first commit."""
        done = self.commits()
        if version is None and not done:
            return None
        return self.spark.read.parquet(f"{self.root}/data/{version or done[-1][1]}")

    def _commit(self, version: str, n_rows: int) -> None:
        done = self.commits()
        n = done[-1][0] + 1 if done else 1
        self.spark.createDataFrame([(n, version, n_rows)], "n long, version string, n_rows long").coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def replace(self, rows: DataFrame, gates: list[Gate] = (), least_rows: int = 1) -> str:
        """Makes rows the table's content if they pass; the new version's name."""
        version, seen = uuid.uuid4().hex, Observation()
        target = f"{self.root}/data/{version}"
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(target)
        staged = self.spark.read.parquet(target)
        written, counted = seen.get["n"], staged.count()
        why = None
        if written != counted:
            why = f"{written} rows were written and {counted} are read"
        elif counted < least_rows:
            why = f"{counted} rows are too few"
        else:
            current = self.read()
            why = next((w for g in gates if (w := g(current, staged))), None)
        if why:
            files, path = self._path(target)
            files.delete(path, True)
            raise Refused(why)
        self._commit(version, counted)
        return version

    def revert(self, version: str) -> None:
        """Makes an earlier version current again; the commits in between stay listed."""
        known = {v: n for _, v, n in self.commits()}
        if version not in known:
            raise Refused(f"{version} was never current")
        self._commit(version, known[version])


def ratio_gate(least: float = 0.97) -> Gate:
    """Refuses a version with too few rows beside the current one."""

    def gate(current: DataFrame | None, staged: DataFrame) -> str | None:
        if current is None:
            return None
        old, new = current.count(), staged.count()
        return f"{new} rows for {old}" if old and new < least * old else None

    return gate


def facts_gate(check: Callable[[DataFrame, DataFrame], DataFrame], against: DataFrame | None = None) -> Gate:
    """Refuses unless the one row that ``check`` makes of the current rows (or of ``against``) and the staged ones has ``passes``."""

    def gate(current: DataFrame | None, staged: DataFrame) -> str | None:
        base = against if against is not None else current
        if base is None:
            return None
        facts = check(base, staged).first().asDict()
        return None if facts["passes"] else ", ".join(f"{k} {v}" for k, v in facts.items())

    return gate


def unique_gate(keys: list[str]) -> Gate:
    """Refuses a version whose keys repeat or are null."""

    def gate(_: DataFrame | None, staged: DataFrame) -> str | None:
        null = F.lit(False)
        for k in keys:
            null = null | F.col(k).isNull()
        each = staged.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(null).alias("empty"))
        bad = each.agg(F.count_if((F.col("n") > 1) & ~F.col("empty")), F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0))).first()
        return f"{bad[0]} keys repeat, {bad[1]} rows have none" if any(bad) else None

    return gate
