"""FLAC media columns: a mono encoder and decoder over whole batches of frames, one numpy step for all frames at a time.

Streams have fixed block sizes of 192 samples and a seek point for every frame, so that frames of many streams are
decoded side by side: sample after sample, every frame's Rice residual is read at its own bit position.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

BLOCK, RATE, DEPTH = 192, 8000, 8
#: Payload bytes that are encoded or decoded side by side; a bit takes a byte while frames are put together.
AT_ONCE = 1 << 20
#: Fixed values of the format: the weights of its fixed predictors on the samples before.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
LPC_PRECISION, LPC_SHIFT, MAX_RICE = 12, 9, 11
_U = np.uint64


def _table(poly: int, width: int) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for i in range(256):
        r = i << (width - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r >> (width - 1) else r << 1) & ((1 << width) - 1)
        out[i] = r
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
#: Leading zeros of 16-bit numbers.
LEADING = 16 - np.frexp(np.arange(1 << 16))[1].astype(np.int64)


def _crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """The checksum of data[start : start + length] for every start, byte by byte side by side."""
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    r, live = np.zeros(len(s), np.int64), len(s)
    for i in range(int(n[0]) if len(n) else 0):
        while live and n[live - 1] <= i:
            live -= 1
        x = r[:live]
        r[:live] = ((x << 8) & ((1 << width) - 1)) ^ table[(x >> (width - 8)) ^ data[s[:live] + i]]
    out = np.empty_like(r)
    out[order] = r
    return out


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers as the format codes them (like UTF-8, up to 6 bytes): bytes and how many count."""
    size = 1 + sum((n >= (1 << k)).astype(np.int64) for k in (7, 11, 16, 21, 26))
    out = np.zeros((len(n), 6), np.uint8)
    for k in range(1, 7):
        at = np.flatnonzero(size == k)
        x = n[at]
        if k == 1:
            out[at, 0] = x
            continue
        out[at, 0] = ((0xFF << (8 - k)) & 0xFF) | (x >> (6 * (k - 1)))
        for j in range(1, k):
            out[at, j] = 0x80 | ((x >> (6 * (k - 1 - j))) & 0x3F)
    return out, size


def _predicted(x: np.ndarray, weights: np.ndarray, shift: int) -> np.ndarray:
    """Residuals of rows x from sample len(weights) on; weights: (order, rows or 1)."""
    n, o = x.shape[1], len(weights)
    p = sum((weights[i][:, None] * x[:, o - 1 - i : n - 1 - i] for i in range(o)), np.zeros((len(x), n - o), x.dtype))
    return x[:, o:] - (p >> shift)


def _rice_bits(zz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter of each row and the bits it needs."""
    bits = np.stack([(zz >> k).sum(axis=1) + zz.shape[1] * (1 + k) for k in range(MAX_RICE + 1)])
    k = bits.argmin(axis=0)
    return k, bits[k, np.arange(zz.shape[0])]


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> None:
    """Write the low n bits of value at bit positions at, one byte for each bit."""
    for j in range(n):
        bits[at + j] = (value >> (n - 1 - j)) & 1


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of rows of BLOCK samples: all bytes, and where each frame begins (one more entry for the end)."""
    x = samples.astype(np.int32)
    f = len(x)
    # Predictors: fixed orders 0 to 4, and a linear one of order 2 from each row's autocorrelation.
    lag = [(x[:, j:] * x[:, : BLOCK - j]).sum(axis=1).astype(float) for j in range(3)]
    det = lag[0] ** 2 - lag[1] ** 2
    safe = np.where(det > 0, det, 1.0)
    a = np.where(det > 0, np.stack([lag[1] * (lag[0] - lag[2]), lag[0] * lag[2] - lag[1] ** 2]) / safe, 0.0)
    limit = 1 << (LPC_PRECISION - 1)
    q = np.clip(np.rint(a * (1 << LPC_SHIFT)), -limit, limit - 1).astype(np.int32)
    residuals = [_predicted(x, np.array(w, np.int32).reshape(-1, 1), 0) for w in FIXED] + [_predicted(x, q, LPC_SHIFT)]
    cost = np.stack([np.abs(r).sum(axis=1) + 8 * (BLOCK - r.shape[1]) + (60 if i == 5 else 0) for i, r in enumerate(residuals)])
    kind = cost.argmin(axis=0)  # 0 to 4 fixed, 5 linear, 6 verbatim, 7 constant
    order = np.where(kind == 5, 2, kind)
    zz = np.zeros((f, BLOCK), np.int32)  # aligned to the sample; the warm-up's columns stay zero
    for i, r in enumerate(residuals):
        at = np.flatnonzero(kind == i)
        zz[at, BLOCK - r.shape[1] :] = np.where(r[at] >= 0, 2 * r[at], -2 * r[at] - 1)
    k, bits = _rice_bits(zz)
    bits -= order * (1 + k)
    body = 8 + DEPTH * order + np.where(kind == 5, 9 + 2 * LPC_PRECISION, 0) + 10 + bits
    kind = np.where(body >= 8 + DEPTH * BLOCK, 6, kind)
    kind = np.where((x == x[:, :1]).all(axis=1), 7, kind)
    body = np.where(kind == 6, 8 + DEPTH * BLOCK, np.where(kind == 7, 8 + DEPTH, body))
    coded, coded_n = _number(numbers)
    head = 4 + coded_n + 1
    size = head + (body + 7) // 8 + 2
    starts = np.zeros(f + 1, np.int64)
    np.cumsum(size, out=starts[1:])
    out = np.zeros(int(starts[-1]) * 8, np.uint8)
    s = starts[:-1]
    at = (s + head) * 8
    name = np.choose(np.minimum(kind, 7), [8, 9, 10, 11, 12, 33, 1, 0])  # fixed values of the format: subframe types
    _put(out, at, name << 1, 8)
    raw = x & ((1 << DEPTH) - 1)
    i = np.flatnonzero(kind == 7)
    _put(out, at[i] + 8, raw[i, 0], DEPTH)
    i = np.flatnonzero(kind == 6)
    if len(i):
        _put(out, at[i][:, None] + 8 + DEPTH * np.arange(BLOCK), raw[i], DEPTH)
    at = at + 8
    for j in range(4):
        i = np.flatnonzero((order > j) & (kind < 6))
        _put(out, at[i] + DEPTH * j, raw[i, j], DEPTH)
    at = at + DEPTH * order
    i = np.flatnonzero(kind == 5)
    if len(i):
        _put(out, at[i], np.full(len(i), LPC_PRECISION - 1), 4)
        _put(out, at[i] + 4, np.full(len(i), LPC_SHIFT), 5)
        for j in range(2):
            _put(out, at[i] + 9 + LPC_PRECISION * j, q[j, i] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
        at[i] += 9 + 2 * LPC_PRECISION
    i = np.flatnonzero(kind < 6)
    if len(i):
        _put(out, at[i] + 6, k[i], 4)  # before it: method 0 and one partition, both zero
        at, zz, k, o = at[i] + 10, zz[i], k[i], order[i]
        high = zz >> k[:, None]
        length = high + 1 + k[:, None]
        length[np.arange(BLOCK) < o[:, None]] = 0
        ends = np.cumsum(length, axis=1) + at[:, None]
        real = length > 0
        ends, zz, k = ends[real], zz[real], np.broadcast_to(k[:, None], real.shape)[real]
        out[ends - 1 - k] = 1
        for b in range(int(k.max(initial=0))):
            w = np.flatnonzero((k > b) & ((zz >> b) & 1 == 1))
            out[ends[w] - 1 - b] = 1
    data = np.packbits(out)
    data[s], data[s + 1] = 0xFF, 0xF8  # fixed values of the format: sync, fixed block size
    data[s + 2] = 0x14  # 192 samples, 8 kHz
    data[s + 3] = 0x02  # one channel, 8 bits
    for j in range(6):
        i = np.flatnonzero(coded_n > j)
        data[s[i] + 4 + j] = coded[i, j]
    data[s + head - 1] = _crc(data, s, head - 1, CRC8, 8)
    check = _crc(data, s, size - 2, CRC16, 16)
    data[s + size - 2], data[s + size - 1] = check >> 8, check & 0xFF
    return data, starts


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of BLOCK; bytes are unsigned samples less 128."""
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    x = (np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int16) - 128).astype(np.int8)
    first = np.cumsum(counts) - counts
    numbers = np.arange(len(x)) - np.repeat(first, counts)
    parts = [encode_frames(x[i : i + AT_ONCE // BLOCK], numbers[i : i + AT_ONCE // BLOCK]) for i in range(0, len(x), AT_ONCE // BLOCK)]
    data = np.concatenate([d for d, _ in parts])
    base = np.cumsum([0] + [len(d) for d, _ in parts])
    starts = np.concatenate([s[:-1] + b for (_, s), b in zip(parts, base, strict=False)] + [base[-1:]])
    out = []
    for a, n in zip(first.tolist(), counts.tolist(), strict=True):
        at, sizes = starts[a : a + n + 1], np.diff(starts[a : a + n + 1])
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += ((RATE << 44) | ((DEPTH - 1) << 36) | (n * BLOCK)).to_bytes(8, "big") + hashlib.md5(x[a : a + n].tobytes()).digest()
        seek = np.zeros(n, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        seek["sample"], seek["offset"], seek["n"] = np.arange(n) * BLOCK, at[:-1] - at[0], BLOCK
        out.append(b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + (18 * n).to_bytes(3, "big") + seek.tobytes() + data[at[0] : at[-1]].tobytes())
    return out


def _blocks(stream: bytes) -> tuple[int, np.ndarray, int, int, bytes, int]:
    """Of a stream: where frames begin, the seek points' offsets, block size, samples, MD5, bits of a sample."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, seek, block, total, md5, depth = 4, None, 0, 0, b"", 0
    while True:
        kind, n = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        d = stream[at + 4 : at + 4 + n]
        if kind & 0x7F == 0:
            word = int.from_bytes(d[10:18], "big")
            block, total, md5, depth = int.from_bytes(d[2:4], "big"), word & ((1 << 36) - 1), d[18:34], ((word >> 36) & 31) + 1
            if (word >> 41) & 7:
                raise ValueError("only streams of one channel are read")
        elif kind & 0x7F == 3:
            seek = np.frombuffer(d, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])["offset"].astype(np.int64)
        at += 4 + n
        if kind & 0x80:
            break
    if seek is None or len(seek) * block != total:
        raise ValueError("a seek point for every frame is needed")
    return at, seek, block, total, md5, depth


def decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, block: int = BLOCK, depth: int = DEPTH) -> np.ndarray:
    """Samples of frames of one block size, side by side. Checksums of headers and frames are verified; a wrong one raises ValueError."""
    f = len(starts)
    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.zeros(len(data) + 8, _U)  # the 8 bytes from each byte on
    for j in range(8):
        words = (words << _U(8)) | wide[j : j + len(words)]
    lead = wide[starts + 4].astype(np.int64)
    coded = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    if ((wide[starts] != 0xFF) | (wide[starts + 1] & 0xFE != 0xF8) | (wide[starts + 3] >> 4 != 0)).any():
        raise ValueError("no frame of one channel where a seek point says so")
    long = np.select([wide[starts + 2] >> 4 == 6, wide[starts + 2] >> 4 == 7], [1, 2], 0)  # the block size may follow
    long = long + np.select([wide[starts + 2] & 15 == 12, (wide[starts + 2] & 15 == 13) | (wide[starts + 2] & 15 == 14)], [1, 2], 0)
    head = 4 + coded + long + 1
    if (_crc(wide, starts, head - 1, CRC8, 8) != wide[starts + head - 1]).any():
        raise ValueError("a frame header's checksum is wrong")
    if (_crc(wide, starts, sizes, CRC16, 16) != 0).any():
        raise ValueError("a frame's checksum is wrong")

    def read(p: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """Up to 32 bits at bit position p."""
        v = words[p >> 3] << (p & 7).astype(_U)
        n = np.asarray(n)
        return np.where(n > 0, (v >> (_U(64) - np.maximum(n, 1).astype(_U))), _U(0)).astype(np.int64)

    def signed(v: np.ndarray, n: int) -> np.ndarray:
        return np.where(v >> (n - 1), v - (1 << n), v)

    p = (starts + head) * 8
    kind = read(p, 8)
    if (kind & 0x81).any():
        raise ValueError("wasted bits aren't read")
    kind >>= 1
    p = p + 8
    x = np.zeros((f, block), np.int64)
    i = np.flatnonzero(kind == 0)
    x[i] = signed(read(p[i], depth), depth)[:, None]
    i = np.flatnonzero(kind == 1)
    for n in range(block if len(i) else 0):
        x[i, n] = signed(read(p[i] + depth * n, depth), depth)
    order = np.select([(kind >= 8) & (kind <= 12), kind >= 32], [kind - 8, kind - 31], 0)
    if (((kind > 1) & (kind < 8)) | ((kind > 12) & (kind < 32))).any():
        raise ValueError("a reserved kind of subframe")
    coded_at = np.flatnonzero(kind >= 8)
    for n in range(int(order.max(initial=0))):
        i = np.flatnonzero(order > n)
        x[i, n] = signed(read(p[i] + depth * n, depth), depth)
    p = p + depth * order
    weights, shift = np.zeros((f, int(order.max(initial=0))), np.int64), np.zeros(f, np.int64)
    for o, w in enumerate(FIXED):
        if o <= weights.shape[1]:
            weights[np.flatnonzero(kind == 8 + o), :o] = w
    i = np.flatnonzero(kind >= 32)
    if len(i):
        precision = read(p[i], 4) + 1
        shift[i] = read(p[i] + 4, 5)
        for n in range(int(order[i].max())):
            w = read(p[i] + 9 + precision * n, precision)
            w = np.where((w >> (precision - 1)) & 1, w - (1 << precision), w)
            weights[i, n] = np.where(order[i] > n, w, 0)
        p[i] += 9 + precision * order[i]
    if len(coded_at):
        x[coded_at] = _residuals(words, p[coded_at], order[coded_at], x[coded_at], block, read)
        for o in np.unique(order[coded_at]):
            i = coded_at[order[coded_at] == o]
            if o:
                y, w, s = np.ascontiguousarray(x[i].T), np.ascontiguousarray(weights[i, :o].T), shift[i]
                for n in range(int(o), block):
                    y[n] += sum(w[j] * y[n - 1 - j] for j in range(o)) >> s
                x[i] = y.T
    return x


def _residuals(words: np.ndarray, p: np.ndarray, order: np.ndarray, x: np.ndarray, block: int, read) -> np.ndarray:
    """Fill in residuals after each row's warm-up samples: partitioned Rice codes, parameters of 4 or 5 bits, escapes."""
    method, parts = read(p, 2), read(p + 2, 4)
    if (method > 1).any():
        raise ValueError("a reserved coding of residuals")
    p = p + 6
    y = np.ascontiguousarray(x.T)
    per, width = block >> parts, 4 + method
    k, raw, escaped = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.zeros(len(p), bool)
    zeros = LEADING
    first = int(order.min())
    for n in range(first, block):
        fresh = np.flatnonzero((order <= n) & ((n % per == 0) | (n == order)))
        if len(fresh):
            k[fresh] = read(p[fresh], width[fresh])
            p[fresh] += width[fresh]
            escaped[fresh] = k[fresh] == (1 << width[fresh]) - 1
            e = fresh[escaped[fresh]]
            raw[e] = read(p[e], 5)
            p[e] += 5
        live = np.flatnonzero((order <= n) & ~escaped) if n < 32 or escaped.any() else slice(None)
        at, kk = p[live], k[live]
        v = words[at >> 3] << (at & 7).astype(_U)
        high = zeros[(v >> _U(48)).astype(np.int64)]
        more = np.flatnonzero(high == 16)
        while len(more):  # long runs of zeros, sixteen at a time
            b = at[more] + high[more]
            z = zeros[((words[b >> 3] << (b & 7).astype(_U)) >> _U(48)).astype(np.int64)]
            high[more] += z
            more = more[z == 16]
        at = at + high + 1
        v = words[at >> 3] << (at & 7).astype(_U)
        low = np.where(kk > 0, v >> (_U(64) - np.maximum(kk, 1).astype(_U)), _U(0)).astype(np.int64)
        value = (high << kk) | low
        y[n, live] = (value >> 1) ^ -(value & 1)
        p[live] = at + kk
        if escaped.any():
            e = np.flatnonzero(escaped & (order <= n))
            v = read(p[e], raw[e])
            y[n, e] = np.where((raw[e] > 0) & (v >> np.maximum(raw[e] - 1, 0) & 1 == 1), v - (1 << raw[e]), v)
            p[e] += raw[e]
    return y.T


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Of every stream the payload (unsigned bytes) and its seek points' offsets; checksums of headers, frames and streams are verified."""
    heads = [_blocks(s) for s in streams]
    if any(h[2] != BLOCK or h[5] != DEPTH for h in heads):
        raise ValueError(f"only blocks of {BLOCK} samples of {DEPTH} bits are read side by side")
    bodies = [np.frombuffer(s, np.uint8)[h[0] :] for s, h in zip(streams, heads, strict=True)]
    base = np.cumsum([0] + [len(b) for b in bodies])
    data = np.concatenate(bodies) if bodies else np.zeros(0, np.uint8)
    starts = np.concatenate([h[1] + b for h, b in zip(heads, base, strict=False)]) if heads else np.zeros(0, np.int64)
    ends = np.append(starts[1:], base[-1])
    samples = np.empty((len(starts), BLOCK), np.int8)
    for i in range(0, len(starts), AT_ONCE // BLOCK):
        s, e = starts[i : i + AT_ONCE // BLOCK], ends[i : i + AT_ONCE // BLOCK]
        samples[i : i + len(s)] = decode_frames(data[s[0] : e[-1]], s - s[0], e - s)
    out, at = [], 0
    for h in heads:
        mine = samples[at : at + len(h[1])]
        at += len(h[1])
        if h[4].strip(b"\0") and hashlib.md5(mine.tobytes()).digest() != h[4]:
            raise ValueError("a stream's checksum is wrong")
        out.append(((mine.view(np.uint8) ^ 0x80).tobytes(), h[1]))
    return out


def _groups(values: list, most: int = 4 * AT_ONCE) -> Iterator[list]:
    """Runs of values of at most so many bytes, one value at least."""
    run, size = [], 0
    for v in values:
        if run and size + len(v) > most:
            yield run
            run, size = [], 0
        run.append(v)
        size += len(v)
    if run:
        yield run


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8, filled up with blanks to a positive multiple of BLOCK; and the length before."""
    data = (text or "").encode("utf-8", "replace")
    return data + b" " * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data)), len(data)


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as a FLAC stream; null and empty texts as one block of blanks. Rows repeat as in the input, an empty table gives no rows, other columns are not looked at."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            padded = [payload(t) for t in b.column(1).to_pylist()]
            media = [m for g in _groups([p for p, _ in padded]) for m in encode(g)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in padded], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


_PLACE = "first_sample: bigint, n_samples: bigint, media_offset: bigint, crc32: bigint"
_PLACES = pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int64()), ("media_offset", pa.int64()), ("crc32", pa.int64())])


def pcm_table(media: DataFrame, id_col: str = "doc_id", blocks: int = 64) -> DataFrame:
    """(id, n_bytes, media_bytes, media_sha256, blocks): each stream decoded to PCM blocks of up to so many frames.

    A block has the sample where it begins, its number of samples, the byte of the stream where its first frame
    begins, its CRC-32 and the samples. A stream whose checksums don't fit raises. Null streams are none: media comes from
    with_media. Rows repeat as in the input; an empty table gives no rows.
    """
    chosen = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    kind = pa.list_(pa.struct([*_PLACES, pa.field("pcm", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            streams, rows = b.column(2).to_pylist(), []
            for g in _groups(streams):
                for m, (pcm, seek) in zip(g, decode(g), strict=True):
                    parts = [(i * BLOCK, int(seek[i]), pcm[i * BLOCK : (i + blocks) * BLOCK]) for i in range(0, len(seek), blocks)]
                    rows.append((len(m), hashlib.sha256(m).hexdigest(), [{"first_sample": at, "n_samples": len(x), "media_offset": off, "crc32": zlib.crc32(x), "pcm": x} for at, off, x in parts]))
            new = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), kind), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *new], names=["id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<{_PLACE}, pcm: binary>>").withColumnRenamed("id", id_col)


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", blocks: int = 64) -> DataFrame:
    """(id, first_sample, n_samples, media_offset, crc32, pcm): pcm_table with one row for each block."""
    return pcm_table(media, id_col, blocks).select(id_col, F.explode("blocks").alias("b")).select(id_col, "b.*")


def read_samples(blocks: list[dict], first: int, n: int) -> bytes:
    """Samples first to first + n of a stream from its block table: the blocks that hold them are found by their offsets, and their CRC-32 is verified."""
    starts = [b["first_sample"] for b in blocks]
    out = []
    for b in blocks[max(0, bisect_right(starts, first) - 1) :]:
        if b["first_sample"] >= first + n:
            break
        if len(b["pcm"]) != b["n_samples"] or zlib.crc32(b["pcm"]) != b["crc32"]:
            raise ValueError(f"the block at sample {b['first_sample']} is damaged")
        out.append(b["pcm"][max(0, first - b["first_sample"]) : first + n - b["first_sample"]])
    return b"".join(out)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each stream, from its PCM blocks, which are written to shared storage and read back by offset.

    Digests of payload and stream, the signal's level, crossings and range as text, and seek: the block table (first
    sample, samples, byte of the stream, CRC-32). Rows repeat as in the input; an empty table gives no rows.
    """
    chosen = stored(pcm_table(media, id_col).withColumnRenamed(id_col, "id"), "pcm-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for blocks in b.column(4).to_pylist():
                blocks.sort(key=lambda x: x["first_sample"])
                digest, n, power, crossings, low, high, last = hashlib.sha256(), 0, 0, 0, 127, -128, None
                for place in blocks:
                    pcm = read_samples(blocks, place["first_sample"], place["n_samples"])
                    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
                    below = x < 0
                    crossings += int((below[1:] != below[:-1]).sum()) + (last is not None and last != bool(below[0]))
                    n, power, low, high, last = n + len(x), power + int((x * x).sum()), min(low, int(x.min())), max(high, int(x.max())), bool(below[-1])
                    digest.update(pcm)
                feature = f"level={power / n:.4f};crossings={crossings};low={low};high={high};blocks={len(blocks)}"
                rows.append((n, digest.hexdigest(), zlib.crc32(read_samples(blocks, n - 16, 16)), feature, [{k: v for k, v in x.items() if k != "pcm"} for x in blocks]))
            size, sha, tail, feature, seek = (pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(_PLACES)), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size, sha, tail, b.column(2), b.column(3), feature, seek], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seek"])

    schema = f"id {chosen.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek array<struct<{_PLACE}>>"
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)
