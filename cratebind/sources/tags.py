"""Title, artist, duration and bit rate of audio files, from parts of their headers; no file is read whole.

ID3v2 (2.2 to 2.4, with ID3v1 where there is none), FLAC, MP4 and WAV. Files are opened on the executors, on any file system that Arrow
knows. A file that cannot be read or understood has no tags; the others go on.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .files import ranges_of

Take = Callable[[int, int], bytes]
SCHEMA = "path string, title string, artist string, duration double, bits_per_second long, size long, mtime double"
#: A tag's text is read up to this many bytes; pictures and the like are skipped.
MOST = 1 << 16

# fixed values: kilobits a second by MPEG layer III index, for MPEG 1 and for MPEG 2 and 2.5; samples a second of MPEG 1
RATES = {1: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], 2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
SAMPLES = [44100, 48000, 32000]


def spread(b: bytes) -> int:
    """A number of seven bits a byte."""
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3_text(data: bytes) -> str | None:
    """The first text of a text frame."""
    if not data:
        return None
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[0], "latin-1")
    found = data[1:].decode(kind, "ignore").split("\0")[0].strip("﻿").strip()
    return found or None


def id3(take: Take, at: int) -> tuple[dict[str, str], int]:
    """Title and artist of the ID3v2 tag at an offset, and where it ends; nothing and the offset itself if there is none."""
    head = take(at, 10)
    if len(head) < 10 or head[:3] != b"ID3":
        return {}, at
    version, flags, end = head[3], head[5], at + 10 + spread(head[6:])
    short = version == 2
    names = {b"TT2": "title", b"TP1": "artist"} if short else {b"TIT2": "title", b"TPE1": "artist"}
    pos, found = at + 10, {}
    if flags & 0x40 and not short:
        extra = take(pos, 4)
        pos += spread(extra) if version == 4 else 4 + int.from_bytes(extra, "big")
    while pos + (6 if short else 10) <= end and len(found) < 2:
        frame = take(pos, 6 if short else 10)
        name = frame[: 3 if short else 4]
        if len(frame) < (6 if short else 10) or not name.strip(b"\0"):
            break
        size = int.from_bytes(frame[3:6], "big") if short else spread(frame[4:8]) if version == 4 else int.from_bytes(frame[4:8], "big")
        pos += len(frame)
        if name in names:
            data = take(pos, min(size, MOST))
            if flags & 0x80 or (version == 4 and frame[9] & 2):
                data = data.replace(b"\xff\0", b"\xff")
            if version == 4 and frame[9] & 1:
                data = data[4:]
            text = id3_text(data)
            if text:
                found[names[name]] = text
        pos += size
    return found, end + (10 if flags & 0x10 else 0)


def id3_last(take: Take, size: int) -> dict[str, str]:
    """Title and artist of an ID3v1 tag."""
    data = take(size - 128, 128) if size >= 128 else b""
    if data[:3] != b"TAG":
        return {}
    both = {"title": data[3:33], "artist": data[33:63]}
    return {k: t for k, v in both.items() if (t := v.split(b"\0")[0].decode("latin-1").strip())}


def mp3(take: Take, size: int) -> dict:
    found, start = id3(take, 0)
    found = found or id3_last(take, size)
    block = take(start, MOST)
    for i in range(len(block) - 4):
        a, b, c, d = block[i : i + 4]
        if a != 255 or b & 0xE0 != 0xE0:
            continue
        version, layer, rate, pitch = b >> 3 & 3, b >> 1 & 3, c >> 4, c >> 2 & 3
        if version == 1 or layer != 1 or rate in (0, 15) or pitch == 3:
            continue
        kind = 1 if version == 3 else 2
        hertz = SAMPLES[pitch] >> (0 if version == 3 else 1 if version == 2 else 2)
        samples, kilobits, mono = 1152 if kind == 1 else 576, RATES[kind][rate], d >> 6 == 3
        bytes_ = size - start - i - (128 if take(size - 128, 3) == b"TAG" else 0)
        side = i + 4 + ((17 if mono else 32) if kind == 1 else (9 if mono else 17))
        frames = None
        if block[side : side + 4] in (b"Xing", b"Info") and block[side + 7] & 1:
            frames = int.from_bytes(block[side + 8 : side + 12], "big")
            if block[side : side + 4] == b"Xing" and block[side + 7] & 2:
                bytes_ = int.from_bytes(block[side + 12 : side + 16], "big")
        elif block[i + 36 : i + 40] == b"VBRI":
            bytes_, frames = struct.unpack(">II", block[i + 46 : i + 54])
        if frames:
            seconds = frames * samples / hertz
            varies = block[side : side + 4] != b"Info"
            return found | {"duration": seconds, "bits": round(bytes_ * 8 / seconds) if varies else kilobits * 1000}
        return found | {"duration": bytes_ * 8 / (kilobits * 1000), "bits": kilobits * 1000}
    return found


def vorbis(data: bytes) -> dict[str, str]:
    """Title and artist of a block of comments."""
    pos = 4 + int.from_bytes(data[:4], "little")
    found: dict[str, str] = {}
    n, pos = int.from_bytes(data[pos : pos + 4], "little"), pos + 4
    for _ in range(n):
        size = int.from_bytes(data[pos : pos + 4], "little")
        if pos + 4 > len(data):
            break
        key, _, value = data[pos + 4 : pos + 4 + size].decode("utf-8", "ignore").partition("=")
        if key.lower() in ("title", "artist") and value:
            found.setdefault(key.lower(), value)
        pos += 4 + size
    return found


def flac(take: Take, size: int) -> dict:
    pos = id3(take, 0)[1]
    if take(pos, 4) != b"fLaC":
        return {}
    pos, found, seconds = pos + 4, {}, None
    while len(head := take(pos, 4)) == 4:
        kind, length = head[0] & 127, int.from_bytes(head[1:], "big")
        if kind == 0:
            packed = int.from_bytes(take(pos + 14, 8), "big")
            hertz, samples = packed >> 44, packed & (1 << 36) - 1
            seconds = samples / hertz if hertz and samples else None
        elif kind == 4:
            found |= vorbis(take(pos + 4, length))
        pos += 4 + length
        if head[0] & 128:
            break
    return found | ({"duration": seconds, "bits": round((size - pos) * 8 / seconds)} if seconds else {})


def boxes(take: Take, pos: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the boxes between two offsets."""
    while len(head := take(pos, 16)) >= 8 and pos < end:
        size, name, skip = int.from_bytes(head[:4], "big"), head[4:8], 8
        if size == 1:
            size, skip = int.from_bytes(head[8:16], "big"), 16
        elif size == 0:
            size = end - pos
        if size < skip:
            return
        yield name, pos + skip, min(end, pos + size)
        pos += size


def inside(take: Take, pos: int, end: int, *names: bytes) -> tuple[int, int] | None:
    """Where the first box of a path of names begins and ends."""
    for name in names:
        there = next(((a, b) for n, a, b in boxes(take, pos, end) if n == name), None)
        if there is None:
            return None
        pos, end = there[0] + (4 if name == b"meta" else 8 if name == b"stsd" else 0), there[1]
    return pos, end


def mp4(take: Take, size: int) -> dict:
    movie = inside(take, 0, size, b"moov")
    if movie is None:
        return {}
    found: dict = {}
    if (head := inside(take, *movie, b"mvhd")) is not None:
        data = take(head[0], 32)
        scale, length = struct.unpack(">IQ", data[20:32]) if data[0] == 1 else struct.unpack(">II", data[12:20])
        if scale:
            found["duration"] = length / scale
    if (items := inside(take, *movie, b"udta", b"meta", b"ilst")) is not None:
        for name, a, b in boxes(take, *items):
            key = {b"\xa9nam": "title", b"\xa9ART": "artist"}.get(name)
            if key and (value := inside(take, a, b, b"data")) is not None:
                text = take(value[0] + 8, min(value[1] - value[0] - 8, MOST)).decode("utf-8", "ignore").strip()
                if text:
                    found[key] = text
    for name, a, b in boxes(take, *movie):
        if name == b"trak" and (entry := inside(take, a, b, b"mdia", b"minf", b"stbl", b"stsd", b"mp4a")) is not None:
            data = take(entry[0] + 28, min(entry[1] - entry[0] - 28, 256))
            at = data.find(b"esds")
            # within the stream's description, its settings follow a mark of 4: kind, flags, buffer, greatest and mean rate
            mark = data.find(b"\x04", at + 8) if at >= 0 else -1
            while mark >= 0 and mark + 1 < len(data):
                pos = mark + 1
                while pos < len(data) and data[pos] & 128:
                    pos += 1
                if len(data) >= pos + 14 and data[pos + 1] == 0x40:
                    found["bits"] = int.from_bytes(data[pos + 10 : pos + 14], "big")
                    break
                mark = data.find(b"\x04", mark + 1)
    return found


def wav(take: Take, size: int) -> dict:
    head = take(0, 12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return {}
    found, pos, rate = {}, 12, None
    while len(head := take(pos, 8)) == 8:
        name, length = head[:4], int.from_bytes(head[4:], "little")
        if name == b"fmt ":
            _, channels, hertz, rate, _, bits = struct.unpack("<HHIIHH", take(pos + 8, 16))
            found["bits"] = channels * hertz * bits
        elif name == b"data" and rate:
            found["duration"] = length / rate
        elif name in (b"id3 ", b"ID3 "):
            found |= id3(take, pos + 8)[0]
        pos += 8 + length + (length & 1)
    return found


READERS = {"mp3": mp3, "flac": flac, "m4a": mp4, "wav": wav}


def tags_of(path: str) -> dict:
    """title, artist, duration, bits of a file, what it tells of them."""
    size, take, close = ranges_of(path)
    try:
        return READERS[path.rpartition(".")[2].lower()](take, size)
    finally:
        close()


def read_tags(listing: DataFrame) -> DataFrame:
    """listing(path, size, mtime) with the tags of each file, nulls where it tells nothing."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, size, mtime in batch[["path", "size", "mtime"]].itertuples(index=False):
                try:
                    found = tags_of(path)
                except Exception:  # noqa: BLE001 - a file that cannot be read has no tags; the others go on
                    found = {}
                rows.append((path, found.get("title"), found.get("artist"), found.get("duration"), found.get("bits"), size, mtime))
            yield pd.DataFrame(rows, columns=["path", "title", "artist", "duration", "bits_per_second", "size", "mtime"]).astype({"bits_per_second": "Int64", "size": "Int64"})

    return listing.select("path", "size", "mtime").mapInPandas(work, SCHEMA)
