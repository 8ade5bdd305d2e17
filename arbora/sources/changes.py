"""A folder's change feed as a stream: the offset is the sequence number, lanes are partitions, rows come in pages.

    spark.dataSource.register(ChangeSource)
    spark.readStream.format("arbora_changes").option("path", "/mnt/index/folder=A").option("lanes", "3").load()

The path is a mounted folder of Parquet files with the entries of one folder (path, kind, size, seq and any others), to which one
writer adds files with ever higher sequence numbers.  A trigger takes what lies after the last one up to the head, which footers
tell.  That range is cut into stretches of `rows` sequence numbers, and a task reads one lane of one stretch from the row groups
that hold numbers of it; so a task's rows are bounded whatever a batch or a lane holds.

Besides the entry's columns a row has its lane and its page's `prior` and `upto`: who has taken all rows of a page may acknowledge
`upto` in the lane.  A page of lane 0 has up to PAGE rows and one of a bulk lane a single row, as with feed.lane_page; a stretch's
last page leads to the stretch's end.  A version that a later one has replaced, and that isn't in the files any more, isn't told."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType

from ..operators.feed import BULK_BYTES, PAGE

#: Columns that a row has besides the entry's.
ADDED = ("lane", "prior", "upto")


def _files(path: str) -> list[str]:
    """The finished files, by name."""
    out = []
    for at, folders, names in os.walk(path):
        folders[:] = [f for f in folders if not f.startswith(("_", "."))]
        out += [os.path.join(at, n) for n in names if n.endswith(".parquet") and not n.startswith(("_", "."))]
    return sorted(out)


def _spread(path: str | None, lanes: int) -> int:
    """The bulk lane of a path: feed.lane's rule."""
    return 1 + int(hashlib.sha256((path or "").encode()).hexdigest()[:15], 16) % max(lanes - 1, 1)


class Stretch(InputPartition):
    """One lane of the sequence numbers in (after, upto], and the files that may hold some."""

    def __init__(self, lane: int, after: int, upto: int, files: list[str]):
        super().__init__((lane, after, upto))
        self.lane, self.after, self.upto, self.files = lane, after, upto, files


class ChangeReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, path: str, lanes: int, rows: int, start: int):
        self.names = [f.name for f in schema.fields if f.name not in ADDED]
        self.path, self.lanes, self.rows, self.start = path, lanes, rows, start
        self.spans: dict[str, tuple[int, int] | None] = {}

    def _known(self) -> dict[str, tuple[int, int] | None]:
        """Each file's least and greatest number (None: no rows); footers of files that were seen before aren't read again."""
        now = _files(self.path)
        self.spans = {f: self.spans[f] if f in self.spans else self._span(f) for f in now}
        return self.spans

    @staticmethod
    def _span(file: str) -> tuple[int, int] | None:
        footer = pq.read_metadata(file)
        at = footer.schema.names.index("seq")
        told = [footer.row_group(g).column(at).statistics for g in range(footer.num_row_groups) if footer.row_group(g).num_rows]
        if not told:
            return None
        if all(s is not None and s.has_min_max for s in told):
            return min(s.min for s in told), max(s.max for s in told)
        seq = pc.min_max(pq.read_table(file, columns=["seq"])["seq"]).as_py()
        return None if seq["min"] is None else (seq["min"], seq["max"])

    def initialOffset(self) -> dict:
        return {"seq": self.start}

    def latestOffset(self) -> dict:
        return {"seq": max([self.start, *(s[1] for s in self._known().values() if s)])}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        spans = {f: s for f, s in self._known().items() if s and s[1] > start["seq"] and s[0] <= end["seq"]}
        out = []
        for after in range(start["seq"], end["seq"], self.rows):
            upto = min(after + self.rows, end["seq"])
            files = [f for f, (low, high) in spans.items() if high > after and low <= upto]
            if files:
                out += [Stretch(lane, after, upto, files) for lane in range(self.lanes)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        lane, field = partition.lane, ds.field
        wanted = (field("seq") > partition.after) & (field("seq") <= partition.upto)
        if self.lanes > 1:
            large = (field("kind") == "File") & (field("size") >= BULK_BYTES)
            large = pc.if_else(pc.is_null(large), False, large)
            wanted = wanted & (large if lane else ~large)
        found = ds.dataset(partition.files, format="parquet").to_table(columns=self.names, filter=wanted)
        if lane:
            found = found.filter(pa.array([_spread(p, self.lanes) == lane for p in found["path"].to_pylist()], pa.bool_()))
        found = found.sort_by("seq").combine_chunks()
        seqs, size = found["seq"].to_pylist(), 1 if lane else PAGE
        prior = partition.after
        for i in range(0, len(seqs), size):
            page = found.slice(i, size)
            upto = partition.upto if i + size >= len(seqs) and not lane else seqs[min(i + size, len(seqs)) - 1]
            n = page.num_rows
            page = page.append_column("lane", pa.array([lane] * n, pa.int32())).append_column("prior", pa.array([prior] * n, pa.int64())).append_column("upto", pa.array([upto] * n, pa.int64()))
            prior = upto
            yield from page.combine_chunks().to_batches()


class ChangeSource(DataSource):
    """Options: path, lanes (1 to 8; 1), rows (sequence numbers of a stretch; 50,000), after (where a new stream begins; 0)."""

    @classmethod
    def name(cls) -> str:
        return "arbora_changes"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError("no entries yet: give the stream a schema")
        told = from_arrow_schema(pq.read_schema(files[0]).remove_metadata())
        clash = [f.name for f in told.fields if f.name in ADDED]
        if clash:
            raise ValueError(f"entries have columns of the feed's own names: {clash}")
        return StructType([*told.fields]).add("lane", IntegerType()).add("prior", LongType()).add("upto", LongType())

    def streamReader(self, schema: StructType) -> ChangeReader:
        o = self.options
        lanes, rows = int(o.get("lanes", "1")), int(o.get("rows", "50000"))
        if not (1 <= lanes <= 8 and rows >= 1):
            raise ValueError("lanes are 1 to 8, and a stretch has a row at least")
        return ChangeReader(schema, o["path"], lanes, rows, int(o.get("after", "0")))
