"""Raster files as tables of lines: PNM (P5, P6) and PGX, read and written by Python data sources.

A row is (path, c, y, row array<int>). Small files are read together by one task. Register with register(spark), then use the formats
"pnm" and "pgx"; samples are unsigned, or signed for PGX files that say so, of 1 to 16 bits.
"""

from __future__ import annotations

import glob
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "path string, c int, y int, row array<int>"
#: Bytes of files that one task reads, and bytes that opening one more counts for.
SPLIT, OPEN = 64 << 20, 1 << 16
#: Samples, and blocks of lines, that are handed on at once.
BATCH, BATCH_BLOCKS = 1 << 20, 1 << 13
_PNM = re.compile(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s")
_PGX = re.compile(rb"PG\s+(ML|LM)\s*([+-]?)\s*(\d+)\s+(\d+)\s+(\d+)[ \t]*\r?\n")


def read_pnm(data: bytes) -> list[np.ndarray]:
    """Planes of a P5 or P6 image; two-byte samples, for a greatest value over 255, come high byte first."""
    m = _PNM.match(data)
    if not m:
        raise ValueError("not a P5 or P6 file")
    n, width, height, top = 1 + 2 * (m[1] == b"P6"), int(m[2]), int(m[3]), int(m[4])
    if not 0 < top < 65536:
        raise ValueError(f"greatest value {top}")
    kind = np.dtype(">u2") if top > 255 else np.dtype("u1")
    flat = np.frombuffer(data, kind, width * height * n, m.end())
    return [flat[c::n].reshape(height, width).astype(np.int32) for c in range(n)]


def read_pgx(data: bytes) -> list[np.ndarray]:
    """The one plane of a PGX file, with its byte order, sign and depth."""
    m = _PGX.match(data)
    if not m:
        raise ValueError("not a PGX file")
    signed, depth, width, height = m[2] == b"-", int(m[3]), int(m[4]), int(m[5])
    size = 1 if depth <= 8 else 2 if depth <= 16 else 4
    kind = np.dtype(f"{'>' if m[1] == b'ML' else '<'}{'i' if signed else 'u'}{size}")
    return [np.frombuffer(data, kind, width * height, m.end()).reshape(height, width).astype(np.int32)]


def write_pnm(planes: list[np.ndarray], depth: int = 8) -> bytes:
    height, width = planes[0].shape
    kind = ">u2" if depth > 8 else "u1"
    flat = np.stack(planes, axis=-1).astype(kind)
    return b"P%d\n%d %d\n%d\n" % (5 if len(planes) == 1 else 6, width, height, (1 << depth) - 1) + flat.tobytes()


def write_pgx(plane: np.ndarray, depth: int = 8, signed: bool = False) -> bytes:
    height, width = plane.shape
    kind = f">{'i' if signed else 'u'}{1 if depth <= 8 else 2 if depth <= 16 else 4}"
    return b"PG ML %s %d %d %d\n" % (b"-" if signed else b"+", depth, width, height) + plane.astype(kind).tobytes()


def _lines(kind: str):
    parse = {"pnm": read_pnm, "pgx": read_pgx}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                try:
                    planes, error = parse(content.as_py() or b""), None
                except ValueError as e:
                    planes, error = [], str(e)
                rows = [(c, y, line) for c, plane in enumerate(planes) for y, line in enumerate(plane)]
                rows += [(None, None, None)] * (error is not None)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path.as_py()] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([error] * len(rows), pa.string()),
                    ],
                    names=["path", "c", "y", "row", "error"],
                )

    return run


def image_lines(files: DataFrame, kind: str) -> DataFrame:
    """(path, c, y, row, error) of images in any store that Spark reads. files: path and content, as from its format
    "binaryFile"; kind: "pnm" or "pgx". A file that is no such image has one row, with the error."""
    return files.select("path", "content").mapInArrow(_lines(kind), f"{SCHEMA}, error string")


class _FilesOf(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: list[str]):
        super().__init__(len(paths))
        self.paths = paths


def _line_batch(lines: list[tuple[str, int, int, np.ndarray]]) -> pa.RecordBatch:
    """Blocks (path, c, first y, lines) as rows."""
    counts = [len(block) for *_, block in lines]
    wide = np.repeat([block.shape[1] for *_, block in lines], counts)
    rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(wide)]), pa.int32()), pa.array(np.concatenate([block.ravel() for *_, block in lines]), pa.int32()))
    paths = pa.array([path for path, *_ in lines], pa.string()).take(pa.array(np.repeat(np.arange(len(lines)), counts)))
    columns = [paths, pa.array(np.repeat([c for _, c, *_ in lines], counts), pa.int32()), pa.array(np.concatenate([y + np.arange(len(block)) for _, _, y, block in lines]), pa.int32()), rows]
    return pa.RecordBatch.from_arrays(columns, names=["path", "c", "y", "row"])


class _Reader(DataSourceReader):
    def __init__(self, path: str, pattern: str, parse):
        self.path, self.pattern, self.parse = path, pattern, parse

    def partitions(self):
        """Files by their sizes, small ones together."""
        found = [self.path] if os.path.isfile(self.path) else sorted(glob.glob(os.path.join(self.path, self.pattern)))
        out, size = [[]], 0
        for p in found:
            n = os.path.getsize(p) + OPEN
            if out[-1] and size + n > SPLIT:
                out.append([])
                size = 0
            out[-1].append(p)
            size += n
        return [_FilesOf(paths) for paths in out]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        held, samples = [], 0
        for path in partition.paths:
            with open(path, "rb") as f:
                planes = self.parse(f.read())
            for c, plane in enumerate(planes):
                step = max(1, BATCH // max(1, plane.shape[1]))
                for y in range(0, len(plane), step):
                    block = plane[y : y + step]
                    held.append((path, c, y, block))
                    samples += block.size
                    if samples >= BATCH or len(held) >= BATCH_BLOCKS:
                        yield _line_batch(held)
                        held, samples = [], 0
        if held:
            yield _line_batch(held)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceArrowWriter):
    """Writes the images of a partition to a folder that driver and executors share; repartition by path first, so that an
    image's lines are in one. Lines may come in any order; one image's are held at a time if they come image by image.
    Files get their names when all tasks are done; an image with lines in two partitions is an error."""

    def __init__(self, path: str, suffix: str, options: dict):
        self.path, self.suffix = path, suffix
        self.depth, self.signed = int(options.get("depth", 8)), options.get("signed", "false") == "true"

    def write(self, batches) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        files: list[tuple[str, str]] = []
        now, comps = None, {}
        for batch in batches:
            path, c, y = (batch.column(name).to_pylist() for name in ("path", "c", "y"))
            lines = batch.column("row")
            samples, at = np.asarray(lines.values), lines.offsets.to_pylist()
            for i in range(batch.num_rows):
                if path[i] != now:
                    files += self._put(now, comps)
                    now, comps = path[i], {}
                comps.setdefault(c[i], {})[y[i]] = samples[at[i] : at[i + 1]]
        return _Written(files + self._put(now, comps))

    def _put(self, path: str | None, comps: dict[int, dict[int, np.ndarray]]) -> list[tuple[str, str]]:
        if path is None:
            return []
        planes = [np.array([lines[y] for y in sorted(lines)], np.int32) for _, lines in sorted(comps.items())]
        stem = os.path.splitext(os.path.basename(path))[0]
        if self.suffix == ".pgx":
            parts = [(f"{stem}_{c:02d}.pgx", write_pgx(p, self.depth, self.signed)) for c, p in enumerate(planes)]
        else:
            parts = [(f"{stem}{'.pgm' if len(planes) == 1 else '.ppm'}", write_pnm(planes, self.depth))]
        out = []
        for file, data in parts:
            held = os.path.join(self.path, f".{file}.{uuid.uuid4().hex}")
            with open(held, "wb") as f:
                f.write(data)
            out.append((held, file))
        return out

    def commit(self, messages) -> None:
        files = [x for m in messages if m is not None for x in m.files]
        twice = {name for name, n in Counter(name for _, name in files).items() if n > 1}
        if twice:
            self.abort(messages)
            raise ValueError(f"lines of {sorted(twice)[:3]} are in several partitions: repartition by path")
        for held, name in files:
            os.replace(held, os.path.join(self.path, name))

    def abort(self, messages) -> None:
        for held, _ in (x for m in messages if m is not None for x in m.files):
            if os.path.exists(held):
                os.remove(held)


class PnmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pnm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], "*.p[gpn]m", read_pnm)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], ".pnm", self.options)


class PgxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], "*.pgx", read_pgx)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], ".pgx", self.options)


def register(spark: SparkSession) -> None:
    for source in (PnmSource, PgxSource):
        spark.dataSource.register(source)
