"""OpenStreetMap PBF extracts as DataFrames.

A file is a chain of blobs, each behind a small header.  The headers are hopped over
first, reading a few bytes of each; the blobs they point to are then read, unpacked
and decoded by the tasks.  As routing needs it, ways are read first, and nodes only as
far as a way refers to them; of a blob, objects that a pass has no use for are
skipped undecoded, and relations always.

Tables: nodes ``id, lat, lon``; ways ``way_id, node_refs, highway, oneway, maxspeed,
junction`` as ``etl.classified`` takes them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tarmac.operators.etl import referenced_nodes
from tarmac.sources.shared import kept

#: Tags that a way keeps.
TAGS = ("highway", "oneway", "maxspeed", "junction")
#: Bounds of the format for a header and an unpacked blob (fixed values).
MAX_HEADER, MAX_BLOB = 64 << 10, 32 << 20
NANO = 1e-9
#: Rows of a block that is written.
BLOCK_ROWS = 8000

NODES, WAYS = "id long, lat double, lon double", "way_id long, node_refs array<long>, highway string, oneway string, maxspeed string, junction string"


class Malformed(ValueError):
    pass


def fields(data: memoryview) -> Iterator[tuple[int, int, int | memoryview]]:
    """(number, wire type, value) of a message's fields; numbers as they stand, texts and messages as bytes."""
    at, end = 0, len(data)
    while at < end:
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > end:
                raise Malformed("a field overhangs its message")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise Malformed(f"wire type {kind}")
        yield key >> 3, kind, value


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Malformed("a number has no end")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def packed(data: memoryview) -> np.ndarray:
    """All numbers of a packed field, unsigned."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    last = raw < 0x80
    if not last[-1]:
        raise Malformed("a number has no end")
    which = np.concatenate(([0], np.cumsum(last)[:-1]))
    first = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    place = np.arange(len(raw)) - first[which]
    out = np.zeros(int(last.sum()), dtype=np.uint64)
    np.bitwise_or.at(out, which, (raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64))
    return out


def signed(numbers: np.ndarray) -> np.ndarray:
    """Zigzag numbers."""
    return (numbers >> np.uint64(1)).astype(np.int64) ^ -(numbers & np.uint64(1)).astype(np.int64)


def unpacked(blob: bytes) -> bytes:
    """The block in a blob: stored or deflated."""
    for number, _, value in fields(memoryview(blob)):
        if number == 1:
            return bytes(value)
        if number == 3:
            return zlib.decompress(value)
        if number in (4, 5, 6, 7):
            raise Malformed("a compression that isn't supported")
    return b""


def blob_places(source, size: int) -> Iterator[tuple[str, int, int]]:
    """(kind, offset, size) of each blob of a file."""
    at = 0
    while at < size:
        length = int.from_bytes(source.read_at(4, at), "big")
        if not 0 < length <= MAX_HEADER:
            raise Malformed(f"no blob header at byte {at}")
        kind, held = "", 0
        for number, _, value in fields(memoryview(source.read_at(length, at + 4))):
            if number == 1:
                kind = bytes(value).decode()
            elif number == 3:
                held = value
        if held > MAX_BLOB or at + 4 + length + held > size:
            raise Malformed(f"the blob at byte {at} is cut short")
        yield kind, at + 4 + length, held
        at += 4 + length + held


class Block:
    """A block's strings, scale and groups."""

    def __init__(self, data: bytes):
        self.strings: list[bytes] = []
        self.groups: list[memoryview] = []
        self.granularity, self.lat0, self.lon0 = 100, 0, 0
        for number, _, value in fields(memoryview(data)):
            if number == 1:
                self.strings = [bytes(v) for n, _, v in fields(value) if n == 1]
            elif number == 2:
                self.groups.append(value)
            elif number == 17:
                self.granularity = value
            elif number in (19, 20):
                offset = value - (1 << 64) if value >> 63 else value
                self.lat0, self.lon0 = (offset, self.lon0) if number == 19 else (self.lat0, offset)

    def degrees(self, numbers: np.ndarray, offset: int) -> np.ndarray:
        return NANO * (offset + self.granularity * numbers.astype(np.float64))

    def nodes(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for group in self.groups:
            single: list[tuple[int, int, int]] = []
            for number, _, value in fields(group):
                if number == 1:
                    one = {n: v for n, kind, v in fields(value) if kind == 0}
                    single.append(tuple(int(signed(np.array([one.get(n, 0)], dtype=np.uint64))[0]) for n in (1, 8, 9)))
                elif number == 2:
                    dense = {n: v for n, kind, v in fields(value) if kind == 2}
                    ids, lat, lon = (np.cumsum(signed(packed(dense.get(n, memoryview(b""))))) for n in (1, 8, 9))
                    yield ids, self.degrees(lat, self.lat0), self.degrees(lon, self.lon0)
            if single:
                ids, lat, lon = (np.array(c, dtype=np.int64) for c in zip(*single))
                yield ids, self.degrees(lat, self.lat0), self.degrees(lon, self.lon0)

    def ways(self) -> Iterator[tuple[int, np.ndarray, dict[str, str]]]:
        wanted = {k: t for k, t in enumerate(self.strings) if t in {x.encode() for x in TAGS}}
        for group in self.groups:
            for number, _, value in fields(group):
                if number != 3:
                    continue
                way, keys, values, refs = 0, (), (), memoryview(b"")
                for n, _, v in fields(value):
                    if n == 1:
                        way = v
                    elif n == 2:
                        keys = packed(v).tolist()
                    elif n == 3:
                        values = packed(v).tolist()
                    elif n == 8:
                        refs = v
                tags = {wanted[k].decode(): self.strings[v].decode("utf-8", "replace") for k, v in zip(keys, values) if k in wanted}
                yield way, np.cumsum(signed(packed(refs))), tags


# ---- writing -------------------------------------------------------------------


def number(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def field(key: int, value: int | bytes) -> bytes:
    return number(key << 3) + number(value) if isinstance(value, int) else number(key << 3 | 2) + number(len(value)) + value


def steps(values: list[int]) -> bytes:
    """Packed zigzag differences."""
    gaps = (b - a for a, b in zip([0, *values], values))
    return b"".join(number(g << 1 if g >= 0 else (-g << 1) - 1) for g in gaps)


def blob(kind: str, data: bytes) -> bytes:
    body = field(2, len(data)) + field(3, zlib.compress(data))
    head = field(1, kind.encode()) + field(3, len(body))
    return len(head).to_bytes(4, "big") + head + body


def node_block(ids: list[int], lats: list[float], lons: list[float]) -> bytes:
    units = lambda degrees: steps([round(d * 1e7) for d in degrees])
    return field(1, field(1, b"")) + field(2, field(2, field(1, steps(ids)) + field(8, units(lats)) + field(9, units(lons))))


def way_block(rows: list[tuple[int, list[int], dict[str, str]]]) -> bytes:
    texts = dict.fromkeys(["", *(x for _, _, tags in rows for pair in tags.items() for x in pair)])
    place = {t: k for k, t in enumerate(texts)}
    one = lambda way, refs, tags: field(1, way) + field(2, b"".join(number(place[k]) for k in tags)) + field(3, b"".join(number(place[v]) for v in tags.values())) + field(8, steps(refs))
    return field(1, b"".join(field(1, t.encode()) for t in texts)) + field(2, b"".join(field(3, one(*r)) for r in rows))


def _write(folder: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{kind}-{task.partitionId():05d}.osm.pbf"
        draft, count = f"{root}/_{name}-{task.taskAttemptId()}", 0
        with store.open_output_stream(draft) as out:
            out.write(blob("OSMHeader", field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes")))
            for batch in batches:
                for at in range(0, len(batch), BLOCK_ROWS):
                    rows = batch.slice(at, BLOCK_ROWS).to_pylist()
                    count += len(rows)
                    if kind == "nodes":
                        out.write(blob("OSMData", node_block(*([r[c] for r in rows] for c in ("id", "lat", "lon")))))
                    else:
                        out.write(blob("OSMData", way_block([(r["way_id"], r["node_refs"], {t: r[t] for t in TAGS if r[t] is not None}) for r in rows])))
        store.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count])], names=["path", "rows"])

    return run


def write_pbf(nodes: DataFrame, ways: DataFrame, folder: str) -> DataFrame:
    """Extracts of nodes and ways, one file per partition: ``path, rows``.  Coordinates keep seven digits.

    A task writes under a name of its own and renames the file when it is whole.
    """
    named = [nodes.select("id", "lat", "lon").mapInArrow(_write(folder, "nodes"), "path string, rows long"), ways.select("way_id", "node_refs", *TAGS).mapInArrow(_write(folder, "ways"), "path string, rows long")]
    return kept(named[0].unionByName(named[1]), "extracts")


# ---- reading -------------------------------------------------------------------


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, inner = pafs.FileSystem.from_uri(path)
            with store.open_input_file(inner) as source:
                found = [(path, at, size) for kind, at, size in blob_places(source, source.size()) if kind == "OSMData"]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["path", "at", "size"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    path = store = source = None
    for batch in batches:
        for p, at, size in zip(*[batch.column(n).to_pylist() for n in ("path", "at", "size")]):
            if p != path:
                store, inner = pafs.FileSystem.from_uri(p)
                source, path = store.open_input_file(inner), p
            yield Block(unpacked(source.read_at(size, at)))


def _read_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        for columns in block.nodes():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "lat", "lon"])


def _read_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        found = list(block.ways())
        if found:
            ids, refs, tags = zip(*found)
            columns = [pa.array(ids, pa.int64()), pa.array([r.tolist() for r in refs], pa.list_(pa.int64())), *[pa.array([t.get(k) for t in tags], pa.string()) for k in TAGS]]
            yield pa.RecordBatch.from_arrays(columns, names=["way_id", "node_refs", *TAGS])


def read_pbf(spark: SparkSession, *paths: str, every_node: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of the extracts: the nodes that some highway refers to, unless ``every_node``."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartitionByRange(max(1, len(paths)), "path")
    places = kept(files.mapInArrow(_places, "path string, at long, size long"), "blobs")
    spread = places.repartition(max(1, min(10_000, places.count())), "path", "at")
    ways = spread.mapInArrow(_read_ways, WAYS).where("highway IS NOT NULL")
    nodes = spread.mapInArrow(_read_nodes, NODES)
    return (nodes if every_node else referenced_nodes(nodes, ways)), ways
