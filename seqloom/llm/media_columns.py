"""Media columns: ISO base media containers as tables of codecs, durations and keyframe byte ranges.

`parse` walks the nested boxes of one container (32-bit, 64-bit and to-the-end sizes), decodes the sample tables of each track
(time-to-sample, sample-to-chunk, sample sizes, chunk offsets, sync samples), and the runs of fragmented files (`moof`), and turns
them into byte ranges. The payload in `mdat` is never decoded. `wrap` writes a container of fixed-size 8-bit samples, so that bytes of any kind can be stored
losslessly and read back through the sample tables alone.

The operator is one pass over the rows in Arrow batches: no shuffle and no state between rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a sample, samples of a chunk, and samples from one sync sample to the next, in what `wrap` writes.
SAMPLE, PER_CHUNK, GROUP = 64, 256, 32
TIMESCALE, SAMPLE_TICKS = 8000, 64
#: Boxes that hold other boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"udta"}
#: Box headers nested deeper than this are not followed.
DEEPEST = 16


class MediaError(ValueError):
    """The bytes are no container that can be read."""


@dataclass
class Track:
    """What the sample tables of one track say. Ranges are [start, end) in the container."""

    codec: str = ""
    kind: str = ""
    number: int = 0
    timescale: int = 0
    duration: int = 0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def keyframes(self) -> np.ndarray:
        """Rows of (start, end) of the sync samples."""
        s = self.starts[self.sync]
        return np.stack([s, s + self.sizes[self.sync]], axis=1)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of the box, start of its body, end) of each box in [start, end)."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise MediaError("a box header is cut short")
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise MediaError(f"box {kind!r} does not fit in what holds it")
        yield kind, at, body, at + size
        at += size


def _table(data: memoryview, at: int, end: int, count: int, kind: str) -> np.ndarray:
    dtype = np.dtype(kind)
    if count < 0 or at + count * dtype.itemsize > end:
        raise MediaError("a sample table is cut short")
    return np.frombuffer(data, dtype, count, at).astype(np.int64)


def _u32(data: memoryview, at: int, end: int) -> int:
    if at + 4 > end:
        raise MediaError("a sample table is cut short")
    return struct.unpack_from(">I", data, at)[0]


def _samples(data: memoryview, found: dict[bytes, tuple[int, int]], track: Track) -> None:
    """Fill in sizes, starts and sync samples from the boxes of `stbl`."""
    for need in (b"stsc", b"stts"):
        if need not in found:
            raise MediaError(f"no {need.decode()} box")
    if b"stsz" in found:
        at, end = found[b"stsz"]
        fixed, count = _u32(data, at + 4, end), _u32(data, at + 8, end)
        if fixed and count > len(data):  # samples of at least a byte each cannot be more than the bytes
            raise MediaError("more samples than bytes")
        track.sizes = np.full(count, fixed, np.int64) if fixed else _table(data, at + 12, end, count, ">u4")
    elif b"stz2" in found:
        at, end = found[b"stz2"]
        bits, count = _u32(data, at + 4, end) & 0xFF, _u32(data, at + 8, end)
        if bits == 4:
            pairs = _table(data, at + 12, end, (count + 1) // 2, "u1")
            track.sizes = np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1)[:count]
        elif bits in (8, 16):
            track.sizes = _table(data, at + 12, end, count, "u1" if bits == 8 else ">u2")
        else:
            raise MediaError("stz2 has an unknown field size")
    else:
        raise MediaError("no sample sizes")
    n = len(track.sizes)

    wide = b"co64" in found
    if not wide and b"stco" not in found:
        raise MediaError("no chunk offsets")
    at, end = found[b"co64" if wide else b"stco"]
    chunks = _table(data, at + 8, end, _u32(data, at + 4, end), ">u8" if wide else ">u4")

    at, end = found[b"stsc"]
    runs = _table(data, at + 8, end, 3 * _u32(data, at + 4, end), ">u4").reshape(-1, 3)
    if n:
        if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
            raise MediaError("chunk runs are out of order")
        reps = np.diff(np.append(np.minimum(runs[:, 0], len(chunks) + 1), len(chunks) + 1))
        per_chunk = np.repeat(runs[:, 1], reps)
        if per_chunk.sum() != n:
            raise MediaError("chunks and sample sizes disagree")
        chunk_of = np.repeat(np.arange(len(chunks)), per_chunk)
        before = np.cumsum(track.sizes) - track.sizes
        first = np.cumsum(per_chunk) - per_chunk
        base = np.zeros(len(chunks), np.int64)
        has = per_chunk > 0
        base[has] = before[first[has]]
        track.starts = chunks[chunk_of] + before - base[chunk_of]
        if track.starts.min() < 0 or (track.starts + track.sizes).max() > len(data):
            raise MediaError("a sample lies outside the container")

    at, end = found[b"stts"]
    times = _table(data, at + 8, end, 2 * _u32(data, at + 4, end), ">u4").reshape(-1, 2)
    if times[:, 0].sum() != n:
        raise MediaError("times and sample sizes disagree")
    track.duration = int((times[:, 0] * times[:, 1]).sum())

    if b"stss" in found:
        at, end = found[b"stss"]
        track.sync = _table(data, at + 8, end, _u32(data, at + 4, end), ">u4") - 1
        if len(track.sync) and (track.sync.min() < 0 or track.sync.max() >= n):
            raise MediaError("a sync sample does not exist")
    else:  # without the box all samples are sync samples
        track.sync = np.arange(n)


@dataclass
class _Run:
    """Samples of one `trun`."""

    start: int
    sizes: np.ndarray
    ticks: int
    sync: np.ndarray


def _fields(data: memoryview, at: int, end: int, flags: int, names: dict[int, str]) -> tuple[dict[int, int], int]:
    """Optional 32-bit (q: 64-bit) fields that the flags announce, by their flag, and where they end."""
    out = {}
    for flag, kind in names.items():
        if flags & flag:
            size = struct.calcsize(kind)
            if at + size > end:
                raise MediaError("a fragment header is cut short")
            out[flag] = struct.unpack_from(kind, data, at)[0]
            at += size
    return out, at


def _fragment(data: memoryview, start: int, parts: list[tuple[bytes, int, int]], base: int, defaults: dict[int, tuple[int, int, int]]) -> tuple[int, list[_Run], int]:
    """(track, runs, end of the data) of one `traf` of the `moof` that begins at `start`; `base` is where its data begins unless
    it says otherwise. Defaults of a track: ticks, size and flags of a sample."""
    header = next(((a, b) for kind, a, b in parts if kind == b"tfhd"), None)
    if header is None:
        raise MediaError("no tfhd box")
    a, b = header
    flags, number = _u32(data, a, b) & 0xFFFFFF, _u32(data, a + 4, b)
    own, _ = _fields(data, a + 8, b, flags, {0x1: ">Q", 0x2: ">I", 0x8: ">I", 0x10: ">I", 0x20: ">I"})
    ticks, size, mark = defaults.get(number, (0, 0, 0))
    ticks, size, mark = own.get(0x8, ticks), own.get(0x10, size), own.get(0x20, mark)
    base = own.get(0x1, start if flags & 0x20000 else base)
    at, runs = base, []
    for kind, a, b in parts:
        if kind != b"trun":
            continue
        flags, n = _u32(data, a, b) & 0xFFFFFF, _u32(data, a + 4, b)
        head, body = _fields(data, a + 8, b, flags, {0x1: ">i", 0x4: ">I"})
        has = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
        if not has and n > len(data):
            raise MediaError("more samples than bytes")
        table = dict(zip(has, _table(data, body, b, n * len(has), ">u4").reshape(n, len(has)).T, strict=True))
        sizes = table.get(0x200, np.full(n, size, np.int64))
        marks = table.get(0x400, np.full(n, mark, np.int64))
        if 0x4 in head and n:
            marks = np.append(head[0x4], marks[1:])
        at = base + head[0x1] if 0x1 in head else at
        runs.append(_Run(at, sizes, int(table[0x100].sum()) if 0x100 in table else n * ticks, (marks & 0x10000) == 0))
        at += int(sizes.sum())
        if runs[-1].start < 0 or at > len(data):
            raise MediaError("a sample lies outside the container")
    return number, runs, at


def _add_runs(track: Track, runs: list[_Run]) -> None:
    for run in runs:
        before, n = np.cumsum(run.sizes) - run.sizes, len(track.sizes)
        track.starts = np.append(track.starts, run.start + before)
        track.sizes = np.append(track.sizes, run.sizes)
        track.sync = np.append(track.sync, n + np.flatnonzero(run.sync))
        track.duration += run.ticks


def read(data: bytes) -> tuple[list[Track], list[str]]:
    """The tracks of a container, and what is wrong with those that cannot be read and are left out. MediaError if it has no
    `moov`, or its boxes do not fit in each other."""
    view = memoryview(data)
    tracks: list[Track] = []
    wrong: list[str] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments: dict[int, list[_Run]] = {}
    seen = False

    def walk(start: int, end: int, depth: int, track: Track | None, found: dict[bytes, tuple[int, int]]) -> None:
        nonlocal seen
        if depth > DEEPEST:
            raise MediaError("boxes are nested too deeply")
        for kind, box, a, b in boxes(view, start, end):
            seen |= kind == b"moov"
            if kind == b"trak":
                own, tables = Track(), {}
                walk(a, b, depth + 1, own, tables)
                try:
                    _samples(view, tables, own)
                    tracks.append(own)
                except MediaError as e:
                    wrong.append(f"track {own.number}: {e}")
            elif kind == b"moof":
                at = box
                for of, _, x, y in boxes(view, a, b):
                    if of == b"traf":
                        number, runs, at = _fragment(view, box, [(k, p, q) for k, _, p, q in boxes(view, x, y)], at, defaults)
                        fragments.setdefault(number, []).extend(runs)
            elif kind in NESTED:
                walk(a, b, depth + 1, track, found)
            elif kind == b"trex":
                defaults[_u32(view, a + 4, b)] = (_u32(view, a + 12, b), _u32(view, a + 16, b), _u32(view, a + 20, b))
            elif track is not None:
                if kind == b"tkhd":
                    track.number = _u32(view, a + (20 if view[a : a + 1] == b"\x01" else 12), b)
                elif kind == b"mdhd":
                    track.timescale = _u32(view, a + (20 if view[a : a + 1] == b"\x01" else 12), b)
                elif kind == b"hdlr":
                    track.kind = bytes(view[a + 8 : min(a + 12, b)]).decode("latin-1")
                elif kind == b"stsd":
                    for codec, _, _, _ in boxes(view, a + 8, b):
                        track.codec = track.codec or codec.decode("latin-1")
                found[kind] = (a, b)

    walk(0, len(view), 0, None, {})
    if not seen:
        raise MediaError("no moov box")
    for track in tracks:
        _add_runs(track, fragments.get(track.number, []))
    return tracks, wrong


def parse(data: bytes) -> list[Track]:
    """The tracks of a container; MediaError also if one of them cannot be read."""
    tracks, wrong = read(data)
    if wrong:
        raise MediaError("; ".join(wrong))
    return tracks


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def wrap(payload: bytes) -> bytes:
    """A container with one track of 8-bit mono audio: samples of SAMPLE bytes, the last one of each container full too.

    The payload's length must be a positive multiple of SAMPLE. Offsets and times have 64 bits only where 32 do not suffice.
    """
    if not payload or len(payload) % SAMPLE:
        raise ValueError(f"the payload's length must be a positive multiple of {SAMPLE}")
    n = len(payload) // SAMPLE
    chunks, rest = divmod(n, PER_CHUNK)
    ticks = n * SAMPLE_TICKS
    wide = ticks >= 1 << 32
    when = ">QQIQ" if wide else ">IIII"

    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    big = len(payload) + 16 >= 1 << 31
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if big else struct.pack(">I4s", len(payload) + 8, b"mdat")
    base = len(head) + len(mdat)

    sound = struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16)
    runs = [(1, PER_CHUNK, 1)] * (chunks > 0) + [(chunks + 1, rest, 1)] * (rest > 0)
    offsets = base + np.arange(chunks + (rest > 0), dtype=np.int64) * PER_CHUNK * SAMPLE
    sync = np.arange(1, n + 1, GROUP)
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", sound)),
        _full(b"stts", struct.pack(">III", 1, n, SAMPLE_TICKS)),
        _full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", SAMPLE, n)),
        _full(b"co64", struct.pack(">I", len(offsets)), offsets.astype(">u8").tobytes())
        if big
        else _full(b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u4").tobytes()),
    )
    minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(when, 0, 0, TIMESCALE, ticks), struct.pack(">HH", 0x55C4, 0), version=wide), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ" if wide else ">IIIII", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=wide, flags=7)
    mvhd = _full(b"mvhd", struct.pack(when, 0, 0, TIMESCALE, ticks), struct.pack(">IH10x", 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=wide)
    return b"".join([head, mdat, payload, _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))])


def read_back(data: bytes, track: Track) -> bytes:
    """The bytes of the track's samples in order, found through its sample tables."""
    if not len(track.starts):
        return b""
    ends = track.starts + track.sizes
    cut = np.flatnonzero(track.starts[1:] != ends[:-1]) + 1
    firsts, lasts = np.append(0, cut), np.append(cut, len(ends)) - 1
    return b"".join(data[track.starts[a] : ends[b]] for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))


TRACKS = "array<struct<codec:string,kind:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<start:long,end:long>>>>"


def media_columns(rows: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """Codec, duration and keyframe byte ranges of containers held in a binary column.

    Returns one row for each row (repeated rows stay repeated): the id as it is, `tracks` (codec, handler kind, timescale,
    duration in ticks, number of samples, keyframes as [start, end) byte ranges) and `error`. Null bytes have null tracks and
    no error; empty bytes, and bytes that cannot be read, have null tracks and say so in `error`; tracks that cannot be read are
    left out of the others and named in `error`; samples of fragments follow those of the tables; a table without rows gives none. The table may have other columns of any name; they are ignored.
    """
    kept = rows.select(F.col(id_col).alias("_id"), F.col(bytes_col).alias("_data"))
    id_type = kept.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tracks, errors = [], []
            for value in batch.column(1):
                data = value.as_py()
                try:
                    got, wrong = (None, []) if data is None else read(data)
                    why = "; ".join(wrong) or None
                except (MediaError, struct.error) as e:
                    got, why = None, str(e)
                errors.append(why)
                tracks.append(got and [{"codec": t.codec, "kind": t.kind, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "keyframes": [{"start": int(a), "end": int(b)} for a, b in t.keyframes()]} for t in got])
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            kind = pa.list_(pa.struct([("codec", pa.string()), ("kind", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(span))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tracks, kind), pa.array(errors, pa.string())], ["_id", "tracks", "error"])

    out = kept.mapInArrow(run, f"_id {id_type}, tracks {TRACKS}, error string")
    return out.withColumnRenamed("_id", id_col) if id_col != "_id" else out


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store whole texts as containers and report what is read back from them.

    For each row (repeated rows stay repeated): the UTF-8 bytes of the text (null: none), padded with zero bytes to a positive
    multiple of SAMPLE, are wrapped by `wrap`; the container is parsed again and the payload fetched through its sample
    tables. Columns: id, n_bytes (without padding), payload_bytes, payload_sha256 and tail_crc32 (of the last 64 bytes) of
    what was read back, media_bytes and media_sha256 of the container, feature (codec, duration and keyframes as text). A text of
    any length is one container, held in memory about four times; one beyond 4 GB would need wider sizes and is an error. An empty
    table gives none; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for value in batch.column(1):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                media = wrap(raw + bytes(-len(raw) % SAMPLE if raw else SAMPLE))
                (track,) = parse(media)
                payload = read_back(media, track)
                keys = track.keyframes()
                feature = f"{track.codec.strip()};{track.duration}/{track.timescale}s;{len(track.sizes)} samples;{len(keys)} keyframes {keys[0, 0]}-{keys[-1, 1]};{hashlib.sha256(keys.astype('<i8').tobytes()).hexdigest()[:16]}"
                row = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if n.endswith("sha256") or n == "feature" else pa.int64()) for n, c in zip(names[1:], cols, strict=True))], names)

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return kept.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` stored as a container and read back."""
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_media_columns": op3_media_columns}
