"""Media columns in the Ogg container: page checksums, packets from lacing values, logical streams, granule timestamps.

``encode`` stores bytes losslessly as 8-bit samples: two logical streams (OggPCM headers, one channel each) whose packets take
turns in one physical stream.  ``read_pages`` and ``demultiplex`` read any Ogg stream: each page's checksum is verified, pages
that fail are left out and counted, packets are put together from lacing values across pages, streams are told apart by serial
number, and a packet's end time follows from the granule position of the page it ends on.

Nulls: a null text is stored like an empty one; null doc_ids are kept.  Equal texts give equal values.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import arrow_map

BLOCK, RATE, SERIALS, PACKET = 64, 8000, (1, 2), 4096
#: Fixed values of the format: capture pattern, header layout, flags.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MAX_SEGMENTS = 255
NO_GRANULE = -1
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, start and end value 0.

    It is the mirror image of the usual CRC of the mirrored bytes.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def write_page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body)
    page[22:26] = struct.pack("<I", page_checksum(bytes(page)))
    return bytes(page)


class StreamWriter:
    """Pages of one logical stream; a packet is laced into segments of 255 bytes and one shorter."""

    def __init__(self, serial: int):
        self.serial, self.sequence, self.granule = serial, 0, 0
        self.lacing, self.body, self.end = bytearray(), bytearray(), NO_GRANULE
        self.continued = False

    def page(self, flags: int = 0) -> bytes:
        flags |= CONTINUED * self.continued | FIRST * (self.sequence == 0)
        page = write_page(self.serial, self.sequence, self.end, flags, bytes(self.lacing), bytes(self.body))
        self.continued = bool(self.lacing) and self.lacing[-1] == 255
        self.sequence += 1
        self.lacing, self.body, self.end = bytearray(), bytearray(), NO_GRANULE
        return page

    def packet(self, data: bytes, samples: int) -> list[bytes]:
        """Add a packet; returns the pages that became full."""
        full, at = [], 0
        for size in [255] * (len(data) // 255) + [len(data) % 255]:
            if len(self.lacing) == MAX_SEGMENTS:
                full.append(self.page())
            self.lacing.append(size)
            self.body += data[at : at + size]
            at += size
        self.granule += samples
        self.end = self.granule
        return full


def encode(payload: bytes) -> bytes:
    """Store a payload; packets of PACKET bytes go to the two streams in turn."""
    writers = [StreamWriter(s) for s in SERIALS]
    out = []
    for w in writers:  # first pages come before all others
        w.packet(b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, PACKET, 0), 0)
        out.append(w.page())
    for w in writers:
        w.packet(struct.pack("<I", 8) + b"emberlog" + struct.pack("<I", 0), 0)
        out.append(w.page())
    for k in range(0, len(payload), PACKET):
        part = payload[k : k + PACKET]
        out += writers[k // PACKET % 2].packet(part, len(part))
    out += [w.page(LAST) for w in writers]
    return b"".join(out)


@dataclass
class Page:
    serial: int
    sequence: int
    granule: int
    flags: int
    lacing: bytes
    body: bytes


@dataclass
class Stream:
    """One logical stream: its packets, and each one's end in samples (None where no page tells)."""

    packets: list[bytes] = field(default_factory=list)
    ends: list[int | None] = field(default_factory=list)
    lost: int = 0

    def seconds(self, rate: int = RATE) -> list[float | None]:
        return [None if e is None else e / rate for e in self.ends]


def read_pages(data: bytes) -> tuple[list[Page], int]:
    """(pages whose checksum is right, number of captures that were not such pages)."""
    pages, bad, at = [], 0, data.find(CAPTURE)
    while at >= 0:
        if at + HEADER.size > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
        start = at + HEADER.size + n
        lacing = data[at + HEADER.size : start]
        end = start + sum(lacing)
        page = data[at:end]
        if version == 0 and len(lacing) == n and len(page) == end - at and page_checksum(page[:22] + bytes(4) + page[26:]) == crc:
            pages.append(Page(serial, sequence, granule, flags, lacing, data[start:end]))
            at = data.find(CAPTURE, end)
        else:
            bad += 1
            at = data.find(CAPTURE, at + 1)
    return pages, bad


def demultiplex(pages: list[Page]) -> dict[int, Stream]:
    """The logical streams by serial number.  A packet with a missing part is left out and counted as lost."""
    streams: dict[int, Stream] = {}
    state: dict[int, tuple[int, bytearray | None]] = {}  # next sequence number, unfinished packet
    for p in pages:
        stream = streams.setdefault(p.serial, Stream())
        expected, open_packet = state.get(p.serial, (p.sequence, None))
        if p.sequence != expected and open_packet is not None:
            stream.lost += 1
            open_packet = None
        skip = bool(p.flags & CONTINUED) and open_packet is None
        if not p.flags & CONTINUED and open_packet is not None:
            stream.lost += 1
            open_packet = None
        at, first = 0, len(stream.packets)
        for size in p.lacing:
            open_packet = bytearray() if open_packet is None else open_packet
            open_packet += p.body[at : at + size]
            at += size
            if size < 255:
                if skip:
                    stream.lost += 1
                else:
                    stream.packets.append(bytes(open_packet))
                    stream.ends.append(None)
                open_packet, skip = None, False
        if len(stream.packets) > first and p.granule != NO_GRANULE:
            stream.ends[-1] = p.granule
        state[p.serial] = (p.sequence + 1, open_packet if not skip else None)
    for serial, (_, open_packet) in state.items():
        streams[serial].lost += open_packet is not None
    for stream in streams.values():  # sample counts of one-byte samples give the ends between pages' granules
        for k in range(len(stream.packets) - 2, 1, -1):
            if stream.ends[k] is None and stream.ends[k + 1] is not None:
                stream.ends[k] = stream.ends[k + 1] - len(stream.packets[k + 1])
    return streams


def decode(media: bytes) -> tuple[bytes, str]:
    """(payload, features) of what ``encode`` stored."""
    pages, bad = read_pages(media)
    streams = demultiplex(pages)
    audio = [streams.get(s, Stream()).packets[2:] for s in SERIALS]
    turns = [audio[k % 2][k // 2] for k in range(2 * max(map(len, audio))) if k // 2 < len(audio[k % 2])]
    payload = b"".join(turns)
    ends = [s.ends[-1] or 0 for s in streams.values() if s.ends]
    lost = sum(s.lost for s in streams.values())
    packets = sum(len(s.packets) for s in streams.values())
    silent = payload.count(0)
    features = f"streams={len(streams)};pages={len(pages)};bad_pages={bad};packets={packets};lost={lost};samples={sum(ends)};seconds={max(ends, default=0) / RATE:.6f};zeros={silent};min={min(payload, default=0)};max={max(payload, default=0)}"
    return payload, features


def padded(data: bytes, block: int = BLOCK) -> bytes:
    return data + bytes(max(block, -(-len(data) // block) * block) - len(data))


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of ``docs`` (doc_id, text) as an Ogg stream."""

    def rows(ids, texts):
        for doc, raw in zip(ids, texts, strict=True):
            yield doc, len(raw), encode(padded(raw))

    return arrow_map(_bytes(docs), rows, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of the stored bytes of ``media`` (doc_id, n_bytes, media)."""

    def rows(ids, sizes, stored):
        for doc, n, data in zip(ids, sizes, stored, strict=True):
            payload, feature = decode(data)
            yield doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature

    return arrow_map(media.select("doc_id", "n_bytes", "media"), rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
