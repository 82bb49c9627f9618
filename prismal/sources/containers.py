"""Containers of typed boxes, and simple raster files, as rows. Binary columns come from `binaryFile` or any table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the file format.
SIGNATURE = bytes.fromhex("0000000c4a584c200d0a870a")
FTYP = bytes.fromhex("00000014667479706a786c20000000006a786c20")
CODESTREAM = bytes.fromhex("ff0a")
PNG = bytes.fromhex("89504e470d0a1a0a")

BOXES = "file_id long, ordinal int, type string, raw_size long, contents binary, error string"


def sniff(content: Column) -> Column:
    """codestream, container, not_enough_bytes or invalid, by the first bytes."""
    size, head = F.octet_length(content), F.substring(content, 1, 12)
    prefix = F.when((size == 0) | ((size < 2) & (head == F.lit(CODESTREAM[:1]))), True).when(size < 12, F.substring(F.lit(SIGNATURE), F.lit(1), size.cast("int")) == content).otherwise(False)
    return F.when(F.substring(content, 1, 2) == F.lit(CODESTREAM), "codestream").when(head == F.lit(SIGNATURE), "container").when(prefix, "not_enough_bytes").otherwise("invalid")


def wrap(codestream: Column) -> Column:
    """A container around a codestream: signature, file type, and one codestream box (32-bit length)."""
    size = F.octet_length(codestream) + 8
    return F.concat(F.lit(SIGNATURE), F.lit(FTYP), F.unhex(F.lpad(F.hex(size), 8, "0")), F.lit(b"jxlc"), codestream)


def boxes_of(data: bytes) -> Iterator[tuple[int, str, int, bytes, str | None]]:
    at, n = 0, 0
    while at < len(data):
        if at + 8 > len(data):
            yield n, "", len(data) - at, b"", "truncated header"
            return
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > len(data):
                yield n, kind.decode("latin1"), len(data) - at, b"", "truncated header"
                return
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = len(data) - at
        error = "bad size" if size < head else "past the end" if at + size > len(data) else "file type is not second" if n == 1 and kind != b"ftyp" else None
        yield n, kind.decode("latin1"), size, data[at + head : at + size] if not error else b"", error
        if error in ("bad size", "past the end"):
            return
        at, n = at + size, n + 1


def scan_boxes(files: DataFrame) -> DataFrame:
    """files: file_id, content. One row per box, in order; the first fault of a file ends its rows."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(i, *b) for i, c in zip(pdf["file_id"], pdf["content"], strict=True) for b in boxes_of(bytes(c or b""))]
            yield pd.DataFrame(rows, columns=["file_id", "ordinal", "type", "raw_size", "contents", "error"])

    return files.select("file_id", "content").mapInPandas(run, BOXES)


def codestreams(boxes: DataFrame) -> DataFrame:
    """The codestream of each file: its whole box, or its fragments in order of their indices; null where they aren't 0, 1, ..., last."""
    index = F.conv(F.hex(F.substring("contents", 1, 4)), 16, 10).cast("long")
    parts = boxes.filter(F.col("type").isin("jxlc", "jxlp")).select("file_id", F.when(F.col("type") == "jxlp", index % 2147483648).otherwise(0).alias("i"), F.when(F.col("type") == "jxlp", index >= 2147483648).otherwise(True).alias("last"), F.when(F.col("type") == "jxlp", F.substring("contents", F.lit(5), F.octet_length("contents").cast("int"))).otherwise(F.col("contents")).alias("b"))
    gathered = parts.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("i", "last", "b"))).alias("p"))
    whole = F.forall(F.transform("p", lambda x, k: (x["i"] == k) & (x["last"] == (k == F.size("p") - 1))), lambda ok: ok)
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["b"])), ""))
    return gathered.select("file_id", F.size("p").alias("fragments"), F.when(whole, joined).alias("codestream"))


class Bits:
    """A cursor over bits, least significant first."""

    def __init__(self, data: bytes) -> None:
        self.value, self.size, self.at = int.from_bytes(data, "little"), 8 * len(data), 0

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise EOFError
        out = self.value >> self.at & (1 << n) - 1
        self.at += n
        return out

    def u32(self, *choices: tuple[int, int]) -> int:
        """One of four (bits, offset) codes, chosen by two bits."""
        bits, offset = choices[self.read(2)]
        return self.read(bits) + offset

    def u64(self) -> int:
        kind = self.read(2)
        if kind < 3:
            return (0, 1 + self.read(4) if kind == 1 else 0, 17 + self.read(8) if kind == 2 else 0)[kind]
        out, shift = self.read(12), 12
        while self.read(1):
            if shift == 60:
                return out | self.read(4) << 60
            out |= self.read(8) << shift
            shift += 8
        return out


#: Width over height by ratio code 1 to 7.
RATIOS = ((1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))


def size_header(data: bytes) -> tuple[int, int]:
    """(width, height) of a codestream after its two signature bytes."""
    b = Bits(data[2:32])
    small = b.read(1)
    side = lambda: (b.read(5) + 1) * 8 if small else b.u32((9, 1), (13, 1), (18, 1), (30, 1))
    height = side()
    ratio = b.read(3)
    width = side() if ratio == 0 else height * RATIOS[ratio - 1][0] // RATIOS[ratio - 1][1]
    return width, height


def sizes(streams: DataFrame) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, c in zip(pdf["file_id"], pdf["codestream"], strict=True):
                try:
                    out.append((i, *size_header(bytes(c))))
                except (EOFError, TypeError):
                    out.append((i, None, None))
            yield pd.DataFrame(out, columns=["file_id", "width", "height"]).astype({"width": "Int64", "height": "Int64"})

    return streams.select("file_id", "codestream").mapInPandas(run, "file_id long, width long, height long")


def pgm(width: int, height: int, samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, height) + samples


def read_pnm(data: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, channels, samples) of an 8-bit PGM or PPM file; comments in the header are skipped."""
    fields: list[bytes] = []
    at = 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("header ends early")
        fields.append(data[at:end])
        at = end
    width, height, peak = map(int, fields[1:])
    channels = {b"P5": 1, b"P6": 3}[fields[0]]
    if peak != 255 or len(data) - at - 1 < width * height * channels:
        raise ValueError("not 8 bits, or too short")
    return width, height, channels, data[at + 1 : at + 1 + width * height * channels]


def png(width: int, height: int, samples: bytes) -> bytes:
    """An 8-bit gray PNG, lines unfiltered."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + samples[y * width : (y + 1) * width] for y in range(height))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, channels, samples) of an 8-bit PNG without interlace or palette; checks every CRC."""
    if data[:8] != PNG:
        raise ValueError("no PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("CRC")
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or interlace:
        raise ValueError("unsupported")
    raw, stride, before, out = zlib.decompress(body), width * channels, bytes(width * channels), []
    for y in range(height):
        kind, line = raw[y * (stride + 1)], bytearray(raw[y * (stride + 1) + 1 : (y + 1) * (stride + 1)])
        for k in range(stride):
            a, b, c = line[k - channels] if k >= channels else 0, before[k], before[k - channels] if k >= channels else 0
            guess = a + b - c
            near = min((abs(guess - a), 0, a), (abs(guess - b), 1, b), (abs(guess - c), 2, c))[2]
            line[k] = (line[k] + (0, a, b, (a + b) // 2, near)[kind]) & 255
        before = bytes(line)
        out.append(before)
    return width, height, channels, b"".join(out)


def samples(files: DataFrame) -> DataFrame:
    """files: file_id, content (PGM, PPM or PNG). One row per sample: file_id, y, x, ch, v; unreadable files give none."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in it:
            for i, c in zip(pdf["file_id"], pdf["content"], strict=True):
                data = bytes(c or b"")
                try:
                    w, h, n, s = read_png(data) if data[:8] == PNG else read_pnm(data)
                except (ValueError, KeyError, TypeError, struct.error, zlib.error):
                    continue
                y, x, ch = np.unravel_index(np.arange(w * h * n), (h, w, n))
                yield pd.DataFrame({"file_id": i, "y": y, "x": x, "ch": ch, "v": np.frombuffer(s, "u1").astype("i8")})

    return files.select("file_id", "content").mapInPandas(run, "file_id long, y long, x long, ch long, v long")


def write_pgm(plane: DataFrame) -> DataFrame:
    """plane: img, y, x, v in 0..255. One PGM file per image; a task holds one image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.sort_values(["y", "x"])
        h, w = int(grid["y"].max()) + 1, int(grid["x"].max()) + 1
        return pd.DataFrame({"file_id": [grid["img"].iloc[0]], "content": [pgm(w, h, grid["v"].astype("uint8").to_numpy().tobytes())]})

    return plane.groupBy("img").applyInPandas(run, "file_id long, content binary")
