"""File trees as a data source: folders are listed in parallel, with links, modes and stamps, and files hashed in pieces.

    spark.dataSource.register(TreeSource)
    spark.read.format("arbora_tree").option("root", "/mnt/x").option("folder", "x").load()

The tree must be mounted at the same path wherever tasks run.  The driver lists folders from the root down only until there are
`tasks` of them; a task then walks each, and what lies directly in the folders that the driver listed is dealt by name in parts of
FILES entries.  A folder or file that can't be read is a row of kind Error, and the walk goes on."""

from __future__ import annotations

import errno
import hashlib
import os
import stat
import zlib
from collections import deque
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "folder string, path string, kind string, mode int, target string, dev long, ino long, size long, mtime long, mtime_nsec long, ctime long, ctime_nsec long, hash string, error string"
#: Entries of one folder that a task looks at; bytes of a file that are in memory.
FILES, PIECE = 10_000, 4 << 20


class Part(InputPartition):
    """A folder (path below the root): all below it, or one part in `of` of what lies directly in it."""

    def __init__(self, path: str, deep: bool, part: int = 0, of: int = 1):
        super().__init__(path)
        self.path, self.deep, self.part, self.of = path, deep, part, of


def _reason(e: OSError) -> str:
    return errno.errorcode.get(e.errno or 0, "EIO")


def _digest(path: str) -> str:
    told = hashlib.sha256()
    with open(path, "rb", buffering=0) as f:
        while piece := f.read(PIECE):
            told.update(piece)
    return told.hexdigest()


class TreeReader(DataSourceReader):
    def __init__(self, root: str, folder: str, tasks: int, content: bool):
        self.root, self.folder, self.tasks, self.content = root.rstrip("/") or "/", folder, tasks, content

    def partitions(self) -> list[Part]:
        waiting, done = deque([""]), []
        while waiting and len(waiting) < self.tasks:
            path = waiting.popleft()
            n = 0
            try:
                with os.scandir(self._at(path)) as found:
                    for e in found:
                        n += 1
                        if e.is_dir(follow_symlinks=False):
                            waiting.append(f"{path}/{e.name}" if path else e.name)
            except OSError:
                pass  # the task that reads the folder tells
            of = max(1, -(-n // FILES))
            done += [Part(path, False, i, of) for i in range(of)]
        return [*done, *(Part(path, True) for path in waiting)]

    def _at(self, path: str) -> str:
        return os.path.join(self.root, path) if path else self.root

    def _error(self, path: str, e: OSError) -> tuple:
        return (self.folder, path, "Error", None, None, *[None] * 7, None, _reason(e))

    def _row(self, path: str) -> tuple:
        at = self._at(path)
        try:
            s = os.lstat(at)
            kind = "Symlink" if stat.S_ISLNK(s.st_mode) else "Directory" if stat.S_ISDIR(s.st_mode) else "File" if stat.S_ISREG(s.st_mode) else "Other"
            target = os.readlink(at) if kind == "Symlink" else None
            digest = _digest(at) if kind == "File" and self.content else None
            if digest is not None and (t := os.lstat(at)) and (t.st_mtime_ns, t.st_size, t.st_ino) != (s.st_mtime_ns, s.st_size, s.st_ino):
                raise OSError(errno.EBUSY, "it changed while it was read")
        except OSError as e:
            return self._error(path, e)
        times = (*divmod(s.st_mtime_ns, 10**9), *divmod(s.st_ctime_ns, 10**9))
        return (self.folder, path, kind, s.st_mode, target, s.st_dev, s.st_ino, s.st_size, *times, digest, None)

    def read(self, partition: Part) -> Iterator[tuple]:
        waiting = [partition.path]
        while waiting:
            path = waiting.pop()
            try:
                with os.scandir(self._at(path)) as found:
                    for e in found:
                        if partition.of > 1 and zlib.crc32(os.fsencode(e.name)) % partition.of != partition.part:
                            continue
                        below = f"{path}/{e.name}" if path else e.name
                        yield self._row(below)
                        if partition.deep and e.is_dir(follow_symlinks=False):
                            waiting.append(below)
            except OSError as e:
                if partition.part == 0:
                    yield self._error(path, e)


class TreeSource(DataSource):
    """Options: root, folder (a name for it), tasks (64), content (true: files are hashed)."""

    @classmethod
    def name(cls) -> str:
        return "arbora_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        o = self.options
        return TreeReader(o["root"], o.get("folder", ""), int(o.get("tasks", "64")), o.get("content", "true").lower() == "true")
