"""Commits of a store: one small file that says which written parts of its tables count.

Every write goes to a new folder ``written=<number>`` and shows only after a commit file with that
number exists. A commit file holds the last number, and for each table (or day of a table) the number
from which on its parts count. A commit is one rename, so several tables change together or not at
all; what a failed commit wrote is removed before the next one. One writer per store.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

GLOB_CHARS = re.compile(r"([\[\]{}*?\\])")
#: Name under which the parts of a table without days, or of all its days, are kept.
WHOLE = ""
#: Commit files kept for readers that are still at an earlier one.
KEPT = 20
_FOLDER, _OPEN = "_commits", "open"


@dataclass
class Pointer:
    """State of a store after a commit."""

    #: Folders of the key index.
    buckets: int
    #: Last part that counts.
    last: int = 0
    #: By table and day (or ``WHOLE``): first part that counts.
    floors: dict[str, dict[str, int]] = field(default_factory=dict)
    #: By table: last part written.
    tails: dict[str, int] = field(default_factory=dict)
    #: By derived table: last part of the facts it covers.
    covered: dict[str, int] = field(default_factory=dict)
    #: Replaced parts that still have files: table, day, first part that counts, seconds of the commit.
    retired: list[tuple[str, str, int, float]] = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> Pointer:
        return cls(**json.loads(text))

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def floor(self, table: str) -> dict[str, int]:
        return self.floors.get(table, {})

    def retire(self, table: str, day: str, now: float) -> None:
        """Parts before the next one no longer count for a day, or for all days."""
        own = self.floors.setdefault(table, {})
        if day == WHOLE:
            own.clear()
        own[day] = self.last
        self.retired.append((table, day, self.last, now))


class Files:
    """Small files of a store, through the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _system(self):
        return self._path(_FOLDER).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, pattern: str) -> list[str]:
        """Paths that match a pattern, below the root."""
        root = GLOB_CHARS.sub(r"\\\1", self.root)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
        found = self._system().globStatus(place) or []
        return [str(status.getPath().toString()) for status in found]

    def read(self, name: str) -> str:
        stream = self._system().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._system().create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        return not self._system().exists(self._path(new)) and self._system().rename(
            self._path(old), self._path(new)
        )

    def absolute(self) -> str:
        """The root as a path without scheme."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return str(self._system().makeQualified(place).toUri().getPath())

    def replace(self, path: str, name: str) -> None:
        """Move a file to a name below the root, over the file that has it."""
        target = self._path(name)
        system = self._system()
        system.mkdirs(target.getParent())
        system.delete(target, False)
        if not system.rename(self.spark._jvm.org.apache.hadoop.fs.Path(path), target):
            raise RuntimeError(f"cannot move {path} to {name}")

    def exists(self, name: str) -> bool:
        return self._system().exists(self._path(name))

    def delete(self, name: str) -> None:
        self._system().delete(self._path(name), True)

    def delete_all(self, paths: list[str]) -> None:
        for path in paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            self._system().delete(place, True)


class Journal:
    """The commit files of a store."""

    def __init__(self, files: Files, buckets: int) -> None:
        self.files = files
        self.buckets = buckets
        self.token = ""

    def _numbers(self) -> list[int]:
        names = [n.rsplit("/", 1)[-1] for n in self.files.names(f"{_FOLDER}/*.json")]
        return sorted(int(n.removesuffix(".json")) for n in names)

    def latest(self) -> tuple[int, Pointer]:
        """Number of the last commit and the state after it."""
        numbers = self._numbers()
        if not numbers:
            return 0, Pointer(self.buckets)
        return numbers[-1], Pointer.of(self.files.read(f"{_FOLDER}/{numbers[-1]:012}.json"))

    def begin(self) -> tuple[int, Pointer, bool]:
        """The last commit, and whether a writer after it has not ended.

        That writer is taken for lost. Should it still be there, it finds that it does not own
        the store any more and gives up without a commit.
        """
        number, pointer = self.latest()
        broken = self.files.exists(f"{_FOLDER}/{_OPEN}")
        self.token = uuid.uuid4().hex
        self.files.write(f"{_FOLDER}/{_OPEN}", self.token)
        return number, pointer, broken

    def is_owner(self) -> bool:
        """Whether no other writer began since."""
        name = f"{_FOLDER}/{_OPEN}"
        return self.files.exists(name) and self.files.read(name) == self.token

    def commit(self, number: int, pointer: Pointer) -> None:
        """Make a state the current one: a single rename that fails if another writer was first."""
        draft, name = f"{_FOLDER}/draft-{self.token}", f"{_FOLDER}/{number:012}.json"
        self.files.write(draft, pointer.text())
        if not self.is_owner() or not self.files.rename(draft, name):
            self.files.delete(draft)
            raise RuntimeError(f"another writer changed {self.files.root}")
        for old in self._numbers()[:-KEPT]:
            self.files.delete(f"{_FOLDER}/{old:012}.json")

    def end(self) -> None:
        if self.is_owner():
            self.files.delete(f"{_FOLDER}/{_OPEN}")
