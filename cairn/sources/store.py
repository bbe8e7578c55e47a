"""Versioned catalog on write-once storage with optimistic commits.

A family of versions is a folder ``<root>/<prefix>#<n>`` of Parquet tables. A version is
written aside and made visible by one rename that fails if the number is taken; the loser
merges onto the winner and tries the next number. Readers take the newest version.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from cairn.functions.text import version_index  # noqa: F401  (the canonical form of names)

Catalog = dict[str, DataFrame]


#: Error conditions of files that are there but damaged.
DAMAGED = ("CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA")


class Served:
    """The version that readers are shown."""

    def __init__(self, store: VersionStore):
        self.store, self.number, self.tables = store, 0, {}

    def set_version(self, n: int) -> None:
        self.number, self.tables = n, self.store.load(n)

    def set_if_newer(self, n: int) -> bool:
        """Shows version ``n`` unless that would go back."""
        if n <= self.number:
            return False
        self.set_version(n)
        return True


class CommitConflict(RuntimeError):
    """Every attempt lost against another writer."""


class VersionStore:
    def __init__(self, spark: SparkSession, root: str, prefix: str, attempts: int = 60):
        self.spark, self.root, self.prefix, self.attempts = spark, root.rstrip("/"), prefix, attempts
        self.conflicts: dict[int, int] = {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, n: int) -> str:
        return f"{self.root}/{self.prefix}#{n}"

    def versions(self) -> list[tuple[int, int]]:
        """(number, creation time in seconds) of every committed version, ascending."""
        top = self._path(self.root)
        if not self._fs.exists(top):
            return []
        out = []
        for s in self._fs.listStatus(top):
            name = s.getPath().getName()
            digits = name.removeprefix(f"{self.prefix}#")
            if name != digits and digits.isdigit() and str(int(digits)) == digits:
                out.append((int(digits), s.getModificationTime() // 1000))
        return sorted(out)

    def newest(self, floor: int = 0) -> int:
        return max([floor, *(n for n, _ in self.versions())])

    def fullest(self, table: str = "paths") -> int:
        """The readable version with the most rows of ``table``; of equal ones the newest."""
        size = {n: self.load(n)[table].count() for n, _ in self.versions() if table in self.load(n)}
        return max(size, key=lambda n: (size[n], n), default=0)

    def load(self, n: int | None = None, strict: bool = False) -> Catalog:
        """The tables of a version; an empty catalog if there is none, or if its files are
        no Parquet. Failures to reach the files are raised, since a writer would else
        commit onto an empty catalog. ``strict`` refuses damaged and empty versions, too."""
        n = self.newest() if n is None else n
        out: Catalog = {}
        if n:
            try:
                for s in self._fs.listStatus(self._path(self._at(n))):
                    name = s.getPath().getName()
                    out[name] = self.spark.read.parquet(f"{self._at(n)}/{name}")
            except (PySparkException, Py4JJavaError) as e:
                if strict or not any(condition in str(e) for condition in DAMAGED):
                    raise
                return {}
            if strict and not out:
                raise RuntimeError(f"version {n} is listed but empty")
        return out

    def save(self, merge: Callable[[Catalog], Catalog | None], floor: int = 0, now: int | None = None) -> int:
        """Commits ``merge(current)`` as the next version and returns its number; None from
        ``merge`` means that nothing changed and commits nothing.

        The number is above ``floor`` and all numbers seen before, even if a later listing
        no longer shows them. A lost race is counted in ``conflicts`` under its number, and
        ``merge`` runs again on what won. ``now`` sets the version's clock (simulations).
        """
        base = floor
        for _ in range(self.attempts):
            current = self.newest()
            base = max(base, current)
            made = merge(self.load(current) if current else {})
            if made is None:
                return base
            tmp = f"{self.root}/_tmp-{uuid.uuid4().hex}"
            for name, df in made.items():
                df.write.option("compression", "zstd").parquet(f"{tmp}/{name}")
            final = self._path(self._at(base + 1))
            if not self._fs.exists(final) and self._fs.rename(self._path(tmp), final):
                inner = self._path(f"{self._at(base + 1)}/{tmp.rsplit('/', 1)[1]}")
                if not self._fs.exists(inner):
                    if now is not None:
                        self._fs.setTimes(final, now * 1000, -1)
                    return base + 1
                self._fs.delete(inner, True)  # renamed into a folder that had just come
            self._fs.delete(self._path(tmp), True)
            self.conflicts[base + 1] = self.conflicts.get(base + 1, 0) + 1
        raise CommitConflict(f"{self.attempts} attempts; {self.conflicts}")

    def writable(self) -> bool:
        """Whether a version could be committed: a folder can be made beside the others."""
        probe = self._path(f"{self.root}/_probe-{uuid.uuid4().hex}")
        try:
            made = bool(self._fs.mkdirs(probe))
        except Py4JJavaError as e:
            if "AccessControlException" in str(e) or "Permission denied" in str(e):
                return False
            raise
        if made:
            self._fs.delete(probe, True)
        return made

    def wait_for(self, n: int, seconds: float, every: float = 0.2) -> bool:
        """Whether version ``n`` or a later one appears within ``seconds``."""
        end = time.monotonic() + seconds
        while self.newest() < n:
            if time.monotonic() >= end:
                return False
            time.sleep(every)
        return True

    def protected(self, column: str = "pack", table: str = "packs") -> DataFrame:
        """Keys used by any version that is still there."""
        out = None
        for n, _ in self.versions():
            keys = self.load(n, strict=True)[table].select(column)
            out = keys if out is None else out.union(keys)
        return out.distinct() if out is not None else self.spark.createDataFrame([], f"{column} string")

    def cleanup(self, now: int, min_age: int) -> list[int]:
        """Deletes versions older than the newest and than ``min_age``; returns them."""
        listed = self.versions()
        old = [n for n, t in listed[:-1] if max(now - t, 0) > min_age]
        for n in old:
            self._fs.delete(self._path(self._at(n)), True)
        return old
