"""Find the keys whose rows end a Spark job, and leave them out.

A row that makes its Python worker die (out of memory, a fault in native code) fails its task
each time it is tried and then the whole job, so nothing inside the worker can catch it. The
driver finds such rows by running the same job over ever smaller shares of the keys: a share
that passes is done with, one that fails is dealt again by the next digit of its keys' hash,
until a share has one key. Per such key that takes `fan` jobs a level and log(keys) / log(fan) levels.
No row is moved: a share is a filter on the key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Result = TypeVar("Result")
FAILURES = (PySparkException, Py4JJavaError)


@dataclass
class Quarantine:
    """Keys left out so far, by scope (keys of one scope say nothing about those of another).

    `limit` bounds the keys in all scopes: if more fail, the fault is not in single rows and
    the first failure is raised. With 0 nothing is searched for.
    """

    key: str
    limit: int = 16
    fan: int = 8
    found: dict[int, list[tuple[int, str]]] = field(default_factory=dict)

    def keys(self, scope: int) -> list[int]:
        return [key for key, _ in self.found.get(scope, [])]

    def size(self) -> int:
        return sum(len(keys) for keys in self.found.values())

    def kept(self, rows: DataFrame, scope: int) -> DataFrame:
        """The rows whose key is not left out."""
        keys = self.keys(scope)
        return rows.where(~F.col(self.key).isin(keys)) if keys else rows

    def run(self, rows: DataFrame, job: Callable[[DataFrame], Result], scope: int = 0) -> Result:
        """`job` of the rows without the keys that end it, as if those had never been there.

        A failed job is searched only if a share of it fails again: what passes on the second
        try (a lost executor) leaves nothing out.
        """
        try:
            return job(self.kept(rows, scope))
        except FAILURES as error:
            if not self.limit:
                raise
            self._search(self.kept(rows, scope), job, scope, error)
        return job(self.kept(rows, scope))

    def _search(self, rows: DataFrame, job: Callable, scope: int, first: Exception) -> None:
        # shares that failed, as digits of the key's hash
        failed: list[tuple[int, ...]] = [()]
        while failed:
            digits = failed.pop()
            for digit in range(self.fan):
                share = rows.where(self._share((*digits, digit)))
                keys = share.select(self.key).distinct().limit(2).collect()
                if not keys:
                    continue
                try:
                    job(share)
                except FAILURES as error:
                    if len(keys) > 1:
                        failed.append((*digits, digit))
                        continue
                    self.found.setdefault(scope, []).append((keys[0][0], str(error)[:500]))
                    if self.size() > self.limit:
                        raise first

    def _share(self, digits: tuple[int, ...]) -> Column:
        """One condition per digit; each level has a hash of its own, so shares go on splitting."""
        found = F.lit(True)
        for level, digit in enumerate(digits):
            found &= F.pmod(F.xxhash64(self.key, F.lit(level)), F.lit(self.fan)) == digit
        return found
