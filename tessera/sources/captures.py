"""A streaming source of capture files that grow: each micro-batch goes on in each file at the record where the last one stopped.

    register(spark)
    spark.readStream.format("captures").option("path", folder).load()
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.sources.rtp import CAPTURED
from tessera.sources.streams import RangedFile

#: Bytes of a file that one task reads, about.
SPLIT = 16 << 20
#: Read at once where records are stepped over.
_CHUNK = 1 << 20


def record_ends(file: RangedFile, at: int, marker: int) -> tuple[int, int, bool]:
    """Where the whole records from `at` on end, how many they are, and whether something else follows them."""
    count, start, held = 0, at, b""
    while True:
        if at + 4 > start + len(held):
            start, held = at, file.read(at, _CHUNK)
        head = held[at - start : at - start + 4]
        if head and head != marker.to_bytes(2, "big")[: len(head)] + head[2:]:
            return at, count, True
        n = 4 + int.from_bytes(head[2:4], "big")
        if len(head) < 4 or at + n > file.size:
            return at, count, False
        at, count = at + n, count + 1


class _Stretch(InputPartition):
    def __init__(self, path: str, first: int, last: int, number: int, broken: bool):
        super().__init__(path)
        self.path, self.first, self.last, self.number, self.broken = path, first, last, number, broken


class CaptureStream(DataSourceStreamReader):
    """Offsets hold, for each file, the bytes and records that have been read, and whether it is broken there. A file that is
    broken is not read on. Options: path (a folder), marker (0xFFFF), split."""

    def __init__(self, options):
        self.path, self.marker, self.split = options["path"], int(options.get("marker", str(0xFFFF)), 0), int(options.get("split", SPLIT))
        self.known: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Steps over the records that have come, by their heads; what has been seen before is not looked at again."""
        store, inner = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        front = "file://" if self.path.startswith("file://") else ""
        for f in sorted(store.get_file_info(fs.FileSelector(inner)), key=lambda f: f.path):
            at, count, broken = self.known.get(f.path, [0, 0, False])
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and f.size > at and not broken:
                with RangedFile(front + f.path) as file:
                    end, more, broken = record_ends(file, at, self.marker)
                self.known[f.path] = [end, count + more, broken]
        return dict(self.known)

    def partitions(self, start: dict, end: dict):
        """Stretches of whole records of about `split` bytes each."""
        front = "file://" if self.path.startswith("file://") else ""
        self.known = {**end, **self.known}
        out = []
        for path, (last, _, broken) in end.items():
            first, number, was_broken = start.get(path, [0, 0, False])
            if last - first <= self.split:
                if last > first or broken and not was_broken:
                    out.append(_Stretch(front + path, first, last, number, broken and not was_broken))
                continue
            with RangedFile(front + path) as file:
                at = first
                while at < last:
                    to, count = _stretch(file, at, min(at + self.split, last))
                    out.append(_Stretch(front + path, at, to, number, broken and not was_broken and to >= last))
                    at, number = to, number + count
        return out or [_Stretch("", 0, 0, 0, False)]

    def read(self, partition) -> Iterator[tuple]:
        if not partition.path:
            return
        with RangedFile(partition.path) as file:
            number, at, start, held = partition.number, partition.first, partition.first, b""
            while at < partition.last:
                if at + 4 > start + len(held) or at + 4 + int.from_bytes(held[at - start + 2 : at - start + 4], "big") > start + len(held):
                    start, held = at, file.read(at, _CHUNK)
                n = int.from_bytes(held[at - start + 2 : at - start + 4], "big")
                yield partition.path, number, held[at - start + 4 : at - start + 4 + n], None
                at, number = at + 4 + n, number + 1
            if partition.broken:
                yield partition.path, number, None, f"no record begins at byte {at}"

    def commit(self, end: dict) -> None:
        pass


def _stretch(file: RangedFile, at: int, last: int) -> tuple[int, int]:
    """The first end of a record at or after `last`, and the records up to there."""
    count = 0
    start, held = at, b""
    while at < last:
        if at + 4 > start + len(held):
            start, held = at, file.read(at, _CHUNK)
        at, count = at + 4 + int.from_bytes(held[at - start + 2 : at - start + 4], "big"), count + 1
    return at, count


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return CAPTURED

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaptureStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)
