"""FLAC media columns: frames with Rice-coded residuals of linear predictors, checked, and decoded to PCM blocks.

Frames are coded side by side: a step handles one bit field or one sample of every frame of a
group, so the work is in arrays although a frame itself can only be read in order.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, kept_columns, map_frames, pick, table

#: Samples of a frame; payloads are padded to a multiple of UNIT.
BLOCK, UNIT = 1152, 192
RATE = 8000
#: Frames that are coded side by side.
GROUP = 1024
#: Bits of an LPC coefficient and its shift.
PRECISION, SHIFT = 12, 10
#: Fixed predictors of order 0 to 4 as coefficients of the samples before.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
MAGIC = b"fLaC"


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for byte in range(256):
        r = byte << bits - 8
        for _ in range(8):
            r = (r << 1 ^ (poly if r & top else 0)) & mask
        out.append(r)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def crc16(rows: list[bytes]) -> np.ndarray:
    """Frame checksums of many byte strings, one byte of each a step."""
    size = np.array([len(r) for r in rows])
    order = np.argsort(-size, kind="stable")
    data = np.zeros((int(size.max()), len(rows)), np.uint8)
    for k, i in enumerate(order.tolist()):
        data[: len(rows[i]), k] = np.frombuffer(rows[i], np.uint8)
    active = len(rows) - np.searchsorted(size[order][::-1], np.arange(len(data)), side="right")
    crc = np.zeros(len(rows), np.uint16)
    for row, n in zip(data, active.tolist()):
        c = crc[:n]
        crc[:n] = c << 8 ^ CRC16[(c >> 8) ^ row[:n]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(x: int) -> bytes:
    if x < 0x80:
        return bytes([x])
    n = next(n for n in range(2, 8) if x < 1 << 5 * n + 1)
    tail = [0x80 | x >> 6 * i & 0x3F for i in range(n - 2, -1, -1)]
    return bytes([(0xFF << 8 - n & 0xFF) | x >> 6 * (n - 1), *tail])


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


@functools.lru_cache(50_000)
def frame_header(number: int, samples: int) -> bytes:
    """Header of a mono frame of 8-bit samples, its size in 16 bits, with its checksum."""
    head = b"\xff\xf8\x70\x02" + _utf8_number(number) + (samples - 1).to_bytes(2, "big")
    return head + bytes([_crc8(head)])


def _pack(zeros: np.ndarray, values: np.ndarray, widths: np.ndarray) -> list[bytes]:
    """For each row the bits of its fields: so many zeros, then a value of so many bits, 16 at most."""
    ends = np.cumsum(zeros + widths, axis=1)
    size = (ends[:, -1] + 7) // 8
    base = np.concatenate(([0], np.cumsum(size)))
    at = (ends - widths + base[:-1, None] * 8).ravel()
    byte = at >> 3
    spread = values.ravel() << (24 - (at & 7) - widths.ravel())
    n = int(base[-1]) + 3
    out = sum(np.bincount(byte + i, spread >> 16 - 8 * i & 255, n + 3)[:n] for i in range(3)).astype(np.uint8).tobytes()
    return [out[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def _bodies(x: np.ndarray) -> list[bytes]:
    """Subframes of frames of equal size (rows of samples), each with the predictor of fewest expected bits."""
    frames, n = x.shape
    first = np.diff(x, axis=1)
    second = np.diff(first, axis=1)
    f = x.astype(np.float32)
    r0, r1, r2 = (np.einsum("ij,ij->i", f[:, d:], f[:, : n - d]).astype(float) for d in range(3))
    det = np.maximum(r0 * r0 - r1 * r1, 1e-6)
    a, b = (r1 * r0 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det
    top = (1 << PRECISION - 1) - 1
    coef = np.clip(np.rint(np.column_stack((a, b)) * (1 << SHIFT)), -top, top).astype(np.int32)
    lpc = x[:, 2:] - ((coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> SHIFT)
    choices = [(0, x), (1, first), (2, second), (-2, lpc)]
    mean = np.column_stack([2 * np.abs(r).mean(axis=1) for _, r in choices])
    rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
    bits = n * (rice + 1 + mean / (1 << rice)) + np.array([0, 8, 16, 16 + 9 + 2 * PRECISION])
    best = bits.argmin(axis=1)
    constant, verbatim = (x == x[:, :1]).all(axis=1), bits.min(axis=1) >= 8 * n
    out: list[bytes] = [b""] * frames
    raw = (x & 255).astype(np.uint8)
    for i in np.flatnonzero(constant):
        out[i] = bytes([0, raw[i, 0]])
    for i in np.flatnonzero(verbatim & ~constant):
        out[i] = b"\x02" + raw[i].tobytes()
    for c, (order, residual) in enumerate(choices):
        rows = np.flatnonzero((best == c) & ~constant & ~verbatim)
        if not len(rows):
            continue
        m = len(rows)
        k = rice[rows, c][:, None]
        r = residual[rows].astype(np.int64)
        u = r << 1 ^ r >> 63
        kind = 32 + -order - 1 if order < 0 else 8 + order
        heads = [(np.full(m, kind << 1), 8)] + [(raw[rows, i].astype(np.int64), 8) for i in range(abs(order))]
        if order < 0:
            heads += [(np.full(m, PRECISION - 1 << 5 | SHIFT), 9)] + [(coef[rows, i].astype(np.int64) & (1 << PRECISION) - 1, PRECISION) for i in range(-order)]
        heads += [(np.zeros(m, np.int64), 6), (k[:, 0], 4)]
        values = np.column_stack([h for h, _ in heads] + [1 << k | u & (1 << k) - 1])
        widths = np.column_stack([np.full(m, w) for _, w in heads] + [np.broadcast_to(k + 1, u.shape)])
        zeros = np.column_stack([np.zeros((m, len(heads)), np.int64), u >> k])
        for i, body in zip(rows.tolist(), _pack(zeros, values, widths)):
            out[i] = body
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of byte strings, one unsigned byte a sample; each has a seek point for every frame."""
    places, data, sizes = [], [], []
    for d, p in enumerate(payloads):
        for i in range(0, len(p), BLOCK):
            places.append((d, i))
            sizes.append(min(BLOCK, len(p) - i))
    sizes = np.array(sizes, np.int64)
    frames: list[bytes] = [b""] * len(places)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        for g in range(0, len(rows), GROUP):
            group = rows[g : g + GROUP].tolist()
            x = np.frombuffer(b"".join([payloads[places[r][0]][places[r][1] : places[r][1] + n] for r in group]), np.uint8).reshape(-1, n).astype(np.int32) - 128
            made = [frame_header(places[r][1] // BLOCK, n) + body for r, body in zip(group, _bodies(x))]
            for r, f, c in zip(group, made, crc16(made).tolist()):
                frames[r] = f + c.to_bytes(2, "big")
    of: list[list[bytes]] = [[] for _ in payloads]
    for (d, _), f in zip(places, frames):
        of[d].append(f)
    return [_stream(p, f) for p, f in zip(payloads, of)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    small = min(BLOCK, max(16, len(payload)))
    lengths = [len(f) for f in frames] or [0]
    pcm = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
    info = small.to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
    info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    points = np.zeros(len(frames), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    points["sample"] = np.arange(len(frames)) * BLOCK
    points["offset"] = offsets[: len(frames)]
    points["n"] = [min(BLOCK, len(payload) - i * BLOCK) for i in range(len(frames))]
    seek = points.tobytes()
    return MAGIC + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


def parse(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Samples, digest of the samples, seek points and the place of the first frame of a stream."""
    if stream[:4] != MAGIC:
        raise ValueError("not a FLAC stream")
    at, last, info, seek = 4, False, b"", b""
    while not last:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body = kind >= 128, stream[at + 4 : at + 4 + size]
        info, seek = (body if kind & 127 == 0 else info), (body if kind & 127 == 3 else seek)
        at += 4 + size
    points = np.frombuffer(seek, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    return int.from_bytes(info[10:18], "big") & (1 << 36) - 1, info[18:34], points, at


@functools.lru_cache(50_000)
def _read_header(head: bytes) -> tuple[int, int]:
    """Size of a frame's header and its samples; the header's own checksum is verified."""
    if head[:4] != b"\xff\xf8\x70\x02":
        raise ValueError("unknown frame header")
    first = head[4]
    extra = 0 if first < 0x80 else (first ^ 0xFF).bit_length()
    size = 5 + (7 - extra if extra else 0) + 2
    if _crc8(head[:size]) != head[size]:
        raise ValueError("frame header checksum")
    return size + 1, int.from_bytes(head[size - 2 : size], "big") + 1


class _Bits:
    """Readers at one bit position in each of many frames of a joined buffer."""

    LEADING = np.array([16 - i.bit_length() for i in range(1 << 16)], np.int64)

    def __init__(self, data: bytes, start: np.ndarray):
        b = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        self.window = (b[:-4] << 24 | b[1:-3] << 16 | b[2:-2] << 8 | b[3:-1]).astype(np.int64)
        self.at = start * 8

    def _peek(self, rows) -> np.ndarray:
        at = self.at[rows]
        return self.window[at >> 3] << (at & 7) & 0xFFFFFFFF

    def take(self, rows, width) -> np.ndarray:
        """The next bits, 25 at most."""
        out = self._peek(rows) >> 32 - width
        self.at[rows] += width
        return out

    def unary(self, rows) -> np.ndarray:
        """Zeros before the next one, which is read too."""
        q = self.LEADING[self._peek(rows) >> 16]
        self.at[rows] += q
        if (q == 16).any():
            index = np.arange(len(self.at))[rows]
            open_ = np.flatnonzero(q == 16)
            while len(open_):
                more = self.LEADING[self._peek(index[open_]) >> 16]
                self.at[index[open_]] += more
                q[open_] += more
                open_ = open_[more == 16]
        self.at[rows] += 1
        return q


def _signed(x: np.ndarray, bits: int) -> np.ndarray:
    return x - ((x >> bits - 1) << bits)


def _decode_frames(frames: list[bytes]) -> list[bytes]:
    """Samples of frames as unsigned bytes; both checksums of each frame are verified."""
    if crc16(frames).any():
        raise ValueError("frame checksum")
    heads = [_read_header(f[:16]) for f in frames]
    n = np.array([h[1] for h in heads])
    order = np.argsort(-n, kind="stable")
    n = n[order]
    base = np.concatenate(([0], np.cumsum([len(f) for f in frames])[:-1]))
    bits = _Bits(b"".join(frames), (base + [h[0] for h in heads])[order])
    everyone = np.arange(len(frames))
    kind = bits.take(everyone, 8) >> 1
    s = np.zeros((int(n[0]), len(frames)), np.int64)
    rest = everyone
    for i in np.flatnonzero(kind <= 1).tolist():
        at = int(bits.at[i]) >> 3
        if kind[i] == 0:
            s[: n[i], i] = bits.window[at] >> 24
        else:
            s[: n[i], i] = bits.window[at : at + n[i]] >> 24
    s = _signed(s, 8)
    coded = np.flatnonzero(kind >= 8)
    if len(coded):
        k, count = kind[coded], n[coded]
        order_of = np.where(k >= 32, (k & 31) + 1, k & 7)
        most = int(order_of.max())
        for i in range(most):
            rows = coded[order_of > i]
            s[i, rows] = _signed(bits.take(rows, 8), 8)
        coef, shift = np.zeros((most, len(coded)), np.int64), np.zeros(len(coded), np.int64)
        for o, c in enumerate(FIXED[: most + 1]):
            coef[: len(c), (k < 32) & (order_of == o)] = np.array(c, np.int64)[:, None]
        linear = np.flatnonzero(k >= 32)
        if len(linear):
            width = bits.take(coded[linear], 4) + 1
            shift[linear] = bits.take(coded[linear], 5)
            for i in range(most):
                here = order_of[linear] > i
                raw = bits.take(coded[linear[here]], width[here])
                coef[i, linear[here]] = raw - ((raw >> width[here] - 1) << width[here])
        method = bits.take(coded, 2)
        parts = count >> bits.take(coded, 4)
        until, rice = np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64)
        plain = not order_of.any()
        for i in range(int(count[0])):
            live = int(np.searchsorted(-count, -i, side="left"))
            begins = np.flatnonzero((until[:live] == i) & (i < count[:live]))
            if len(begins):
                rice[begins] = bits.take(coded[begins], 4 + method[begins])
                until[begins] += parts[begins]
            if i >= most:
                rows, at = coded[:live], slice(0, live)
            else:
                at = np.flatnonzero(order_of[:live] <= i)
                rows = coded[at]
                if not len(rows):
                    continue
            u = bits.unary(rows) << rice[at]
            u |= bits.take(rows, rice[at])
            value = u >> 1 ^ -(u & 1)
            if not plain:
                ahead = 0
                for o in range(min(most, i)):
                    ahead = ahead + coef[o, at] * s[i - 1 - o, rows]
                value = value + (ahead >> shift[at])
            s[i, rows] = value
    out: list[bytes] = [b""] * len(frames)
    whole = np.ascontiguousarray((s.T + 128).astype(np.uint8))
    for place, row, size in zip(order.tolist(), whole, n.tolist()):
        out[place] = row[:size].tobytes()
    return out


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks (sample offset, samples) of streams, found by their seek points and verified as a whole."""
    parsed = [parse(s) for s in streams]
    frames, owner = [], []
    for d, (stream, (_, _, points, first)) in enumerate(zip(streams, parsed)):
        ends = [*(points["offset"][1:].astype(np.int64) + first).tolist(), len(stream)]
        for sample, offset, end in zip(points["sample"].tolist(), points["offset"].tolist(), ends):
            frames.append(stream[first + offset : end])
            owner.append((d, sample))
    blocks: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    for g in range(0, len(frames), GROUP):
        for (d, sample), block in zip(owner[g : g + GROUP], _decode_frames(frames[g : g + GROUP])):
            blocks[d].append((sample, block))
    for (count, digest, _, _), b in zip(parsed, blocks):
        pcm = (np.frombuffer(b"".join([x for _, x in b]), np.uint8) ^ 128).tobytes()
        if len(pcm) != count or hashlib.md5(pcm).digest() != digest:
            raise ValueError("stream digest")
    return blocks


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded payload of a text and its size without the padding. Null: as empty."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def features(pcm: bytes) -> str:
    """Mean, root mean square and rate of sign changes of the samples."""
    x = np.frombuffer(pcm, np.uint8).astype(np.float64) - 128
    crossings = np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1]))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zcr={crossings / len(x):.5f}"


def encode_texts(rows: DataFrame) -> DataFrame:
    """Media rows (_id, n_bytes, media) of rows (_id, text): each text's payload as a FLAC stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [payload(t) for t in b["text"]]
            yield pd.DataFrame({"_id": b["_id"], "n_bytes": [n for _, n in made], "media": encode([p for p, _ in made])})

    rows = rows.select("_id", "text")
    return map_frames(rows, run, kept_columns(rows, "text") + "n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Decoded blocks of media rows (.., media): their columns but media, its size and digest, sample_offset, pcm, and whether it is the last.

    The blocks of a stream follow each other in the order of their offsets.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            stored = [bytes(m) for m in b["media"]]
            about = b.drop(columns="media").assign(media_bytes=[len(m) for m in stored], media_sha256=[hashlib.sha256(m).hexdigest() for m in stored])
            decoded = decode(stored)
            out = about.iloc[np.repeat(np.arange(len(b)), [len(x) for x in decoded])]
            flat = [(s, x, i == len(blocks) - 1) for blocks in decoded for i, (s, x) in enumerate(blocks)]
            offsets, pcm, last = zip(*flat) if flat else ((), (), ())
            yield out.assign(sample_offset=np.array(offsets, np.int64), pcm=list(pcm), last=np.array(last, bool))

    return map_frames(media, run, kept_columns(media, "media") + "media_bytes long, media_sha256 string, sample_offset long, pcm binary, last boolean")


def digests(blocks: DataFrame) -> DataFrame:
    """Describe streams by their decoded blocks, which follow each other and are joined here, stream by stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        for b in batches:
            rows = []
            for pcm, last in zip(b["pcm"], b["last"]):
                held.append(bytes(pcm))
                if last:
                    p = b"".join(held)
                    held.clear()
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), features(p)))
            ends = b[b["last"].to_numpy(bool)]
            size, digest, tail, feature = zip(*rows) if rows else ((), (), (), ())
            yield ends.drop(columns=["pcm", "last", "sample_offset"]).assign(payload_bytes=np.array(size, np.int64), payload_sha256=list(digest), tail_crc32=np.array(tail, np.int64), feature=list(feature))

    kept = kept_columns(blocks, "pcm", "last", "sample_offset")
    return map_frames(blocks, run, kept + "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document stored as FLAC, read back and decoded to blocks. Null texts are empty; repeated rows are returned each."""
    docs = pick(table(spark, sf_dir, "documents"), _id="doc_id", text="text")
    media = Scratch(spark, "op3").write(encode_texts(docs), "media", "zstd")
    told = digests(pcm_blocks(media))
    return told.select(F.col("_id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
