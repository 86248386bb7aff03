"""Media columns: AVI files of motion JPEG (operator 6).

``encode`` stores bytes as 8-bit samples, without loss: a frame is a baseline JPEG of 24 x 24 blocks of 8 x 8 pixels, and a
sample is the grey value of one block. With a quantiser of 8 a block of one value v has the DC coefficient v - 128 and
no other, so any JPEG decoder gives v for all its pixels. The frame's Huffman table gives the category of a DC difference 9 bits
less its size, so that each block takes 10 bits (with 1 for the end of block) and whole batches are coded by array operations.

``decode`` parses the RIFF chunks, takes the frames from the index (idx1), decodes them, and finds shots: a frame
begins one if the distance of its histogram from the frame's before exceeds ``least``, and the mean plus ``deviations`` standard
deviations of the last ``memory`` distances within shots. ``clips`` gives a row for each shot, with its times. Files of other makers are
decoded too (``jpeg``: baseline frames of any tables, sampling and size); their samples are all grey values, frame by frame.

Null or empty text: one frame of the padding value. Very long texts: a file is in memory as a whole, one at a time. Repeated rows: one output
row each. Empty table: no rows. A file that can't be decoded gives a null payload and an error message, and doesn't affect others. Columns of
docs other than doc_id and text are left out, whatever their names; ``decode`` keeps those of its input.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jpeg import grey_values

SIDE, FPS, PAD = 24, 24, 255
FRAME = SIDE * SIDE
_SCAN = FRAME * 10 // 8


def _code(diff: int) -> int:
    """The 10 bits of a block: category, its bits, end of block."""
    size = abs(diff).bit_length()
    if not size:
        return 0b1111111100
    ones = (1 << (8 - size)) - 1  # the code of category 9 - n is n - 1 ones and a zero
    return (((ones << 1) << size) | (diff if diff > 0 else diff + (1 << size) - 1)) << 1


_CODES = np.array([_code(d) for d in range(-255, 256)], dtype=np.uint64)
_DIFFS = np.full(1024, 9999, dtype=np.int32)
_DIFFS[_CODES.astype(np.int64)] = np.arange(-255, 256)


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + bytes([8] * 64))
    + _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\x00" * (len(data) & 1)


def scans(payload: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes, with stuffing, of each frame of a payload of whole frames."""
    v = payload.reshape(-1, FRAME).astype(np.int16)
    diff = np.empty_like(v)
    diff[:, 0] = v[:, 0] - 128
    np.subtract(v[:, 1:], v[:, :-1], out=diff[:, 1:])
    c = _CODES[diff + 255].reshape(-1, 4)
    words = c[:, 0] << np.uint64(30) | c[:, 1] << np.uint64(20) | c[:, 2] << np.uint64(10) | c[:, 3]
    flat = words.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].ravel()
    ff = np.flatnonzero(flat == 0xFF)
    data = np.insert(flat, ff + 1, 0).tobytes() if len(ff) else flat.tobytes()
    ends = _SCAN * np.arange(1, len(v) + 1)
    ends = (ends + np.searchsorted(ff, ends)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def avi(frames: list[bytes]) -> bytes:
    n, side, most = len(frames), SIDE * 8, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, side, side, 0, 0, 0, 0)
    stream = struct.pack("<4s4sI2H8I4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, most, 10_000, 0, 0, 0, side, side)
    form = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    index, at, chunks = [], 4, [b"movi"]
    for f in frames:
        chunks.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(f)))
        at += len(chunks[-1])
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(chunks)) + _chunk(b"idx1", b"".join(index)))


#: Lists inside lists.
DEPTH = 8


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def _seconds(data: bytes, at: int, end: int) -> float | None:
    """Seconds of a frame, from the first video stream's header; lists that are nested deeper than any maker has them aren't looked into."""
    open_ = [_chunks(data, at, end)]
    while open_:
        name, a, b = next(open_[-1], (None, 0, 0))
        if name is None:
            open_.pop()
        elif name == b"LIST" and len(open_) < DEPTH:
            open_.append(_chunks(data, a + 4, b))
        elif name == b"strh" and data[a : a + 4] == b"vids":
            scale, rate = struct.unpack_from("<2I", data, a + 20)
            if scale and rate:
                return scale / rate
    return None


def frames_of(data: bytes) -> tuple[list[bytes], float]:
    """The frames that the index names, and the seconds of each."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, seconds = 0, b"", None
    for name, a, b in _chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        if name == b"LIST" and data[a : a + 4] == b"movi":
            movi = a
        elif name == b"LIST" and data[a : a + 4] == b"hdrl":
            seconds = _seconds(data, a + 4, b)
        elif name == b"idx1":
            index = data[a:b]
    if not movi or not index:
        raise ValueError("no movi list or no index")
    out = []
    for name, _, at, size in struct.iter_unpack("<4s3I", index):
        # Video chunks; some makers count from the file's beginning instead of the list's. A frame of no bytes repeats the one before.
        if name[2:] in (b"dc", b"db"):
            at += 8 + (movi if data[movi + at : movi + at + 4] == name else 0)
            out.append(data[at : at + size] if size or not out else out[-1])
    if not out:
        raise ValueError("no frames")
    return out, seconds or 1 / FPS


def _scan_of(frame: bytes) -> bytes | None:
    """The entropy-coded bytes, without stuffing, of a frame of this module's form; None for those of other makers."""
    if not frame.startswith(HEADER):
        return None
    scan = frame[len(HEADER) : -2].replace(b"\xff\x00", b"\xff")
    if len(scan) != _SCAN or frame[-2:] != b"\xff\xd9":
        raise ValueError("a scan of another length")
    return scan


def samples(scan_bytes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The samples (frame x block) of scans that follow each other, and which frames have only codes of ``encode``."""
    b = np.frombuffer(scan_bytes, dtype=np.uint8).reshape(-1, 5)
    wide = np.zeros((len(b), 8), dtype=np.uint8)
    wide[:, 3:] = b
    w = wide.view(">u8").ravel().astype(np.uint64)
    codes = np.stack([w >> np.uint64(30), w >> np.uint64(20), w >> np.uint64(10), w], axis=1).astype(np.int64) & 1023
    values = np.cumsum(_DIFFS[codes].reshape(-1, FRAME), axis=1) + 128
    good = ((values >= 0) & (values <= 255)).all(axis=1)
    return values.astype(np.uint8), good


def shot_starts(hist: np.ndarray, memory: int = 8, deviations: float = 2.0, least: float = 0.1) -> list[int]:
    """hist: frame x bin, as shares. The first frame of each shot."""
    starts, recent = [0], []
    for t, d in enumerate((np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2).tolist(), 1):
        limit = least
        if recent:
            mean = sum(recent) / len(recent)
            limit = max(least, mean + deviations * (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 + 1e-9)
        if d > limit:
            starts.append(t)
        else:
            recent = [*recent[1 - memory :], d]
    return starts


def _histograms(values: np.ndarray) -> np.ndarray:
    """Shares of 16 bins in each row of samples."""
    n = len(values)
    bins = (values >> 4).astype(np.int64) + 16 * np.arange(n)[:, None]
    return np.bincount(bins.ravel(), minlength=16 * n).reshape(n, 16) / max(1, values.shape[1])


def _groups(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def encode(rows: DataFrame, batch_bytes: int = 2 << 20) -> DataFrame:
    """rows: ``doc_id, text``. ``doc_id, n_bytes, media``: each text's bytes, padded to whole frames, as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in _groups([len(t) for t in texts], batch_bytes):
                padded = [t + bytes([PAD]) * (-len(t) % FRAME if t else FRAME) for t in texts[a:b]]
                frames = [HEADER + s + b"\xff\xd9" for s in scans(np.frombuffer(b"".join(padded), dtype=np.uint8))]
                files, at = [], 0
                for p in padded:
                    files.append(avi(frames[at : at + len(p) // FRAME]))
                    at += len(p) // FRAME
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


_SHOTS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


def _decoded(frames: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All grey values and the histograms of the frames of any maker."""
    planes = [grey_values(f) for f in frames]
    return b"".join(p.tobytes() for p in planes), np.concatenate([_histograms(p.reshape(1, -1)) for p in planes])


def decode(media: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """media with more columns: ``payload binary, n_frames, shots array<struct<first,last,start_s,end_s>>, error``."""
    own = media.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(own.index("media")).to_pylist()
            for a, b in _groups([len(f or b"") for f in files], batch_bytes):
                payloads, sizes, shots, errors, scans_of = [], [], [], [], []
                # Frames of this module's form are decoded together.
                for f in files[a:b]:
                    try:
                        found, seconds = frames_of(f or b"")
                        scans_of.append((found, seconds, [_scan_of(x) for x in found], None))
                    except (ValueError, IndexError, struct.error) as e:
                        scans_of.append(([], 0.0, [], str(e) or "damaged file"))
                quick = [None not in s and not error for _, _, s, error in scans_of]
                values, good = samples(b"".join(x for (_, _, s, _), q in zip(scans_of, quick, strict=True) if q for x in s))
                hist, at = _histograms(values), 0
                for (found, seconds, s, error), q in zip(scans_of, quick, strict=True):
                    payload, own_hist, k = None, None, len(found)
                    if q:
                        payload, own_hist = values[at : at + k].tobytes(), hist[at : at + k]
                        if not good[at : at + k].all():
                            payload, error = None, "samples beyond 8 bits or unknown codes"
                        at += k
                    elif not error:
                        try:
                            payload, own_hist = _decoded(found)
                        except (ValueError, IndexError, KeyError, struct.error) as e:
                            error = str(e) or "damaged frame"
                    starts = [] if payload is None else shot_starts(own_hist)
                    payloads.append(payload)
                    errors.append(error)
                    sizes.append(0 if payload is None else k)
                    shots.append([{"first": x, "last": y - 1, "start_s": x * seconds, "end_s": y * seconds} for x, y in zip(starts, [*starts[1:], k][: len(starts)], strict=True)])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shots, _SHOTS), pa.array(errors, pa.string())], names=[*own, "payload", "n_frames", "shots", "error"])

    schema = media.schema.simpleString()[7:-1] + ",payload:binary,n_frames:bigint,shots:array<struct<first:int,last:int,start_s:double,end_s:double>>,error:string"
    return media.mapInArrow(run, schema)


def clips(decoded: DataFrame) -> DataFrame:
    """``doc_id, clip, first, last, start_s, end_s``: a row for each shot."""
    return decoded.select("doc_id", F.posexplode("shots").alias("clip", "s")).select("doc_id", "clip", "s.*")


def digests(decoded: DataFrame) -> DataFrame:
    """What op6 returns; its feature has the clips' times."""
    times = F.transform("shots", lambda s: F.format_string("%.3f-%.3f", s["start_s"], s["end_s"]))
    return decoded.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.col("n_frames").cast("string"), F.lit(" frames, clips "), F.array_join(times, ",")).alias("feature"),
        F.size("shots").cast("long").alias("n_clips"),
    )
