"""Capture files (pcap, pcapng) as DNS log rows.

Files are cut into byte ranges so that one large capture is read by many tasks. There are no sync
marks: each range guesses its first packet by a chain of plausible headers, decodes from there,
and reports where its last packet ends. The guesses of a file hold if every range starts where
the one before ended (and, in a pcapng, knew the interfaces that hold there).

What else a range leads to is found by walking its headers from where it should have started.
All ranges in question are walked at once, on the assumption that a range ends where it ended
before: chains of packets that begin at different places mostly fall into step. After a few
such rounds the rest of a file is walked in one go. Then the ranges that were guessed wrong are
decoded again, from the right place. So no range is decoded more than twice.

Only a guess asks whether a header is plausible. Reading trusts the lengths in the file: an
oversized or odd packet is a packet like any other. Where a length leads out of the file, the
rest of the file is one unread stretch, which is a row of its own and so counted.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnsloom.functions.flags import HEADER_BITS
from dnsloom.operators.staging import stage
from dnsloom.schema import RAW_SCHEMA

DNS_PORTS = (53, 5353)
# For guesses only: packets are hardly ever longer than this.
_LIKELY_PACKET = 1 << 18
# For guesses only: packets in a row are hardly ever further apart, in seconds.
_LIKELY_GAP = 86_400
# A UDP datagram with its headers is shorter than this; nothing behind it is read.
_FRAME_BYTES = 1 << 17
_MOST_RANGES = 200_000
_CHAIN = 8
# Rounds in which all ranges in question are walked at once.
_WALKS = 3
_BLOCK = 8 << 20
_BATCH = 8192

# File magics -> (byte order, timestamp units per second).
_PCAP_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
_PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
# Pcapng block types that set up (section, interface), and those that hold a
# packet, with the layout of their interface number; a simple packet has none and no time.
_SETUP_BLOCKS = (0x0A0D0D0A, 1)
_SIMPLE_PACKET = 3
_PACKET_BLOCKS = {2: "Hxx", 6: "I"}
# Link types -> (bytes before the network header, offset of the ether type).
_LINK_HEADER = {0: (4, None), 1: (14, 12), 12: (0, None), 14: (0, None), 101: (0, None), 113: (16, 14), 276: (20, 0)}
_IPV6_EXTENSIONS = (0, 43, 60)


def location(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a Spark path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


class _Window:
    """Random access to a file through one buffered block."""

    def __init__(self, path: str, block: int = _BLOCK):
        filesystem, inner = location(path)
        self.file = filesystem.open_input_file(inner)
        self.size = self.file.size()
        self.block = block
        self.start, self.data = 0, b""

    def read(self, offset: int, length: int) -> bytes:
        end = offset + length
        if offset < self.start or end > self.start + len(self.data):
            self.file.seek(offset)
            self.start, self.data = offset, self.file.read(max(length, self.block))
        at = offset - self.start
        return self.data[at : at + length]


@dataclass(frozen=True)
class _Format:
    """Byte order of a capture, and for a pcap its clock and link type.

    In a pcapng (units 0) both belong to interfaces, which `setup` blocks define.
    """

    order: str
    units: int = 0
    link: int = 0

    @property
    def first(self) -> int:
        return 24 if self.units else 0


def _format(window: _Window) -> _Format:
    head = window.read(0, 24)
    if len(head) == 24 and head[:4] in _PCAP_MAGIC:
        order, units = _PCAP_MAGIC[head[:4]]
        return _Format(order, units, struct.unpack(order + "I", head[20:24])[0] & 0xFFFF)
    if head[:4] == _PCAPNG_MAGIC:
        return _Format(_section_order(head))
    raise ValueError("not a capture file")


def _section_order(head: bytes) -> str:
    return "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"


def _next(window: _Window, form: _Format, offset: int) -> tuple[int, _Format] | None:
    """Offset after the packet or block at `offset`, and the format that holds there.

    None if it does not fit into the file, or its length cannot be one.
    """
    head = window.read(offset, 16 if form.units else 12)
    if form.units:
        if len(head) < 16:
            return None
        kept = struct.unpack(form.order + "I", head[8:12])[0]
        end = offset + 16 + kept
    else:
        if len(head) < 12:
            return None
        if head[:4] == _PCAPNG_MAGIC:
            form = _Format(_section_order(head))
        size = struct.unpack(form.order + "I", head[4:8])[0]
        if size < 12:
            return None
        end = offset + (size + 3) // 4 * 4
    return None if end > window.size else (end, form)


def _plausible(window: _Window, form: _Format, offset: int) -> tuple[int, _Format] | None:
    """`_next` if what stands there looks like a packet or block; for guesses."""
    found = _next(window, form, offset)
    if found is None:
        return None
    end, after = found
    if form.units:
        _, fraction, kept, full = struct.unpack(form.order + "IIII", window.read(offset, 16))
        likely = fraction < form.units and 0 < kept <= min(full, _LIKELY_PACKET)
    else:
        likely = window.read(end - 4, 4) == window.read(offset + 4, 4)
    return found if likely else None


def _first_packet(window: _Window, form: _Format, start: int, stop: int) -> int | None:
    """First offset in [start, stop) that begins a chain of plausible packets."""
    step = 1 if form.units else 4
    for offset in range(start, min(stop, window.size - 11), step):
        at, shape, began = offset, form, None
        for _ in range(_CHAIN):
            found = _plausible(window, shape, at)
            if found is not None and form.units:
                seconds = struct.unpack(form.order + "I", window.read(at, 4))[0]
                began = seconds if began is None else began
                if abs(seconds - began) > _LIKELY_GAP:
                    found = None
            if found is None:
                break
            at, shape = found
            if at == window.size:
                break
        if found is not None:
            return offset
    return None


def _block_kind(window: _Window, form: _Format, offset: int) -> int:
    return struct.unpack(form.order + "I", window.read(offset, 4))[0]


def _leading_setup(window: _Window, form: _Format) -> list[int]:
    """Offsets of the setup blocks that a pcapng begins with."""
    setup, offset = [], 0
    while not form.units:
        found = _next(window, form, offset)
        if found is None or _block_kind(window, found[1], offset) not in _SETUP_BLOCKS:
            break
        setup.append(offset)
        offset, form = found
    return setup


class _Range:
    """Reads the packets of one byte range and notes what the next range has to know."""

    def __init__(self, window: _Window, first: int, stop: int, setup: list[int]):
        self.window, self.offset, self.stop = window, first, stop
        self.form = _format(window)
        self.interfaces: list[tuple[int, int, int]] = []
        for offset in setup:
            self.form = _set_up(window, self.form, offset, self.interfaces)
        # Offsets of setup blocks read here, since the last section that begins here.
        self.setup: list[int] = []
        self.section = False
        self.unread = 0

    def walk(self) -> None:
        """Go to the end of the range from header to header."""
        for _ in self.packets(bodies=False):
            pass

    def go_on(self, stop: int) -> None:
        """Take up the range that ends at `stop`, with the interfaces known so far."""
        self.stop, self.setup, self.section = stop, [], False

    def packets(self, bodies: bool = True) -> Iterator[tuple[int, int, int, bytes]]:
        """(offset, ts_us, link type, frame); `unread` bytes at the end could not be read.

        Without `bodies` only setup blocks are looked into, and nothing is returned.
        """
        window = self.window
        while self.offset < min(self.stop, window.size):
            offset = self.offset
            found = _next(window, self.form, offset)
            if found is None:
                self.unread, self.offset = window.size - offset, window.size
                return
            self.offset, self.form = found
            if not bodies and (
                self.form.units or _block_kind(window, self.form, offset) not in _SETUP_BLOCKS
            ):
                continue
            if self.form.units:
                packet = self._record(offset)
            else:
                packet = self._block(offset)
            if packet is not None:
                yield offset, *packet

    def _record(self, offset: int) -> tuple[int, int, bytes]:
        seconds, fraction = struct.unpack(self.form.order + "II", self.window.read(offset, 8))
        ts_us = seconds * 1_000_000 + fraction * 1_000_000 // self.form.units
        length = min(self.offset - offset - 16, _FRAME_BYTES)
        return ts_us, self.form.link, self.window.read(offset + 16, length)

    def _block(self, offset: int) -> tuple[int, int, bytes] | None:
        kind = _block_kind(self.window, self.form, offset)
        if kind in _SETUP_BLOCKS:
            self.form = _set_up(self.window, self.form, offset, self.interfaces)
            if kind != 1:
                self.section, self.setup = True, []
            self.setup.append(offset)
            return None
        if kind not in _PACKET_BLOCKS and kind != _SIMPLE_PACKET:
            return None
        length = min(self.offset - offset - 12, _FRAME_BYTES + 20)
        body = self.window.read(offset + 8, length)
        order = self.form.order
        if kind == _SIMPLE_PACKET:
            full = struct.unpack(order + "I", body[:4])[0]
            link, _, snap = self._interface(0)
            return 0, link, body[4 : 4 + (min(full, snap) if snap else full)]
        which = struct.unpack(order + _PACKET_BLOCKS[kind], body[:4])[0]
        high, low, kept = struct.unpack(order + "III", body[4:16])
        link, units, _ = self._interface(which)
        return (high << 32 | low) * 1_000_000 // units, link, body[20 : 20 + kept]

    def _interface(self, which: int) -> tuple[int, int, int]:
        """Link type, ticks and longest packet; link type -1 for one that nothing defined."""
        return self.interfaces[which] if which < len(self.interfaces) else (-1, 1_000_000, 0)


def _set_up(
    window: _Window, form: _Format, offset: int, interfaces: list[tuple[int, int, int]]
) -> _Format:
    """Apply a setup block: a new section forgets the interfaces, an interface is added."""
    after, form = _next(window, form, offset)
    body = window.read(offset + 8, after - offset - 12)
    if _block_kind(window, form, offset) == 1:
        link, _, snap = struct.unpack(form.order + "HHI", body[:8].ljust(8, b"\0"))
        interfaces.append((link, _ticks(body[8:], form.order), snap))
    else:
        interfaces.clear()
    return form


def _ticks(options: bytes, order: str) -> int:
    """Timestamp units per second of an interface (option 9), a million by default."""
    at = 0
    while at + 4 <= len(options):
        code, length = struct.unpack(order + "HH", options[at : at + 4])
        if code == 9 and length == 1:
            exponent = options[at + 4]
            return 2 ** (exponent & 0x7F) if exponent & 0x80 else 10**exponent
        if code == 0:
            break
        at += 4 + (length + 3) // 4 * 4
    return 1_000_000


def _question_name(message: bytes) -> str | None:
    """Name of the first question with its final dot; None if it breaks off."""
    labels, at, jumps = [], 12, 0
    while at < len(message):
        size = message[at]
        if size == 0:
            return b".".join([*labels, b""]).decode("utf-8", "replace") if labels else "."
        if size >= 0xC0:
            jumps += 1
            if jumps > 32 or at + 1 >= len(message):
                return None
            at = (size & 0x3F) << 8 | message[at + 1]
            continue
        labels.append(message[at + 1 : at + 1 + size])
        at += 1 + size
    return None


def _dns_payload(frame: bytes, link: int, ports: tuple[int, ...]):
    """(addresses or None for IPv6, DNS message) of a frame that is DNS over UDP, else None."""
    if link not in _LINK_HEADER:
        return None
    at, type_at = _LINK_HEADER[link]
    if type_at is not None:
        while frame[type_at : type_at + 2] in (b"\x81\x00", b"\x88\xa8"):
            type_at, at = type_at + 4, at + 4
        if frame[type_at : type_at + 2] not in (b"\x08\x00", b"\x86\xdd"):
            return None
    packet = frame[at:]
    if len(packet) < 20:
        return None
    addresses = None
    if packet[0] >> 4 == 4:
        fragment = (packet[6] & 0x1F) << 8 | packet[7]
        if packet[9] != 17 or fragment:
            return None
        addresses = tuple(".".join(map(str, packet[i : i + 4])) for i in (12, 16))
        udp = packet[(packet[0] & 0x0F) * 4 : max(packet[2] << 8 | packet[3], 20)]
    elif packet[0] >> 4 == 6:
        following, start = packet[6], 40
        while following in _IPV6_EXTENSIONS and start + 2 <= len(packet):
            following, start = packet[start], start + (packet[start + 1] + 1) * 8
        if following != 17:
            return None
        udp = packet[start:]
    else:
        return None
    if len(udp) < 20 or not {udp[0] << 8 | udp[1], udp[2] << 8 | udp[3]} & set(ports):
        return None
    return addresses, udp[8:]


# Rows of packets, of unread stretches (unread_bytes > 0), and of what became of a range
# (stop is set): where it was read from, what it took as set up, and what it found.
_DECODED = pa.schema(
    [("path", pa.string()), ("base", pa.int64()), ("start", pa.int64()), ("attempt", pa.int32())]
    + [("offset", pa.int64()), ("ts_us", pa.int64()), ("source_ip", pa.string())]
    + [("destination_ip", pa.string()), ("query", pa.string())]
    + [(c, pa.int32()) for c in [*HEADER_BITS, "qdcount", "ancount", "nscount", "arcount"]]
    + [("skipped", pa.bool_()), ("unread_bytes", pa.int64())]
    + [("stop", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]
    + [("assumed", pa.list_(pa.int64())), ("setup", pa.list_(pa.int64())), ("section", pa.bool_())]
)
# addresses, name, header bits and counts
_NO_MESSAGE = (None,) * (3 + len(HEADER_BITS) + 4)


def _decode(frame: bytes, link: int, ports: tuple[int, ...]):
    """Row values of one frame after `ts_us`; None if it is not DNS over UDP."""
    found = _dns_payload(frame, link, ports)
    if found is None:
        return None
    addresses, message = found
    if addresses is None:
        return (*_NO_MESSAGE, True)
    word, *counts = struct.unpack(">HHHHH", message[2:12])
    bits = [word >> low & (1 << width) - 1 for low, width in HEADER_BITS.values()]
    name = _question_name(message) if counts[0] else None
    return (*addresses, name or "Unknown", *bits, *counts, False)


def _decode_ranges(ports: tuple[int, ...]):
    """Rows of each range; `first` null: the range guesses it, -1: no packet begins in it."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for job in batch.to_pylist():
                window = _Window(job["path"])
                form = _format(window)
                start, stop, first, setup = (job[k] for k in ("start", "stop", "first", "assumed"))
                if job["attempt"] == 0:
                    setup = _leading_setup(window, form) if start else []
                    first = _first_packet(window, form, start, stop) if start else form.first
                elif first < 0:
                    first = None
                part = _Range(window, stop if first is None else first, stop, setup)
                key = (job["path"], job["base"], start, job["attempt"])
                for offset, ts_us, link, frame in part.packets():
                    values = _decode(frame, link, ports)
                    if values is not None:
                        rows.append((*key, offset, ts_us, *values, 0, *(None,) * 6))
                    elif link not in _LINK_HEADER:
                        unread = max(1, len(frame))
                        rows.append((*key, offset, ts_us, *_NO_MESSAGE, False, unread, *(None,) * 6))
                    if len(rows) >= _BATCH:
                        yield _batch(rows)
                        rows = []
                if part.unread:
                    at = window.size - part.unread
                    rows.append((*key, at, None, *_NO_MESSAGE, False, part.unread, *(None,) * 6))
                last = None if first is None else part.offset
                known = (stop, first, last, setup, part.setup, part.section)
                rows.append((*key, None, None, *_NO_MESSAGE, False, 0, *known))
        if rows:
            yield _batch(rows)

    return decode


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _DECODED, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_DECODED)


def _section_of(assumed: list[int]) -> int:
    """Offset of the section header in force; it decides how headers are read."""
    return assumed[0] if assumed else -1


def _judge(first_only: bool):
    """Of one file's ranges, those that were not guessed right, with the place where they have
    to start (-1: no packet begins there) and the setup that holds there.

    `asked`: what that start leads to is not known yet. Ranges behind such a one are judged as if
    it ended where it did from another start, or else as if the next one was guessed right.
    first_only: ask for the first such range only.
    """

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        guesses, outcomes = [], {}
        for row in rows.sort_values(["start", "attempt"]).itertuples(index=False):
            first = -1 if pd.isna(row.first) else int(row.first)
            if row.attempt == 0:
                guesses.append((row, first, list(row.assumed)))
            if first >= 0:
                ends = int(row.last), list(row.setup), bool(row.section)
                outcomes.setdefault(row.start, {})[first, _section_of(list(row.assumed))] = ends
        out, reached, carried = [], None, []
        for row, first, assumed in guesses:
            due = first if reached is None else reached if reached < row.stop else -1
            known = outcomes.get(row.start, {})
            ends = known.get((due, _section_of(carried)))
            asked = due >= 0 and ends is None
            if asked or due != first or (due >= 0 and assumed != carried):
                out.append((row.path, row.base, row.start, row.stop, 1, due, carried, asked))
            if asked and first_only:
                break
            if due >= 0:
                ends = ends or next(iter(known.values()), None)
                reached = ends[0] if ends else None
                if ends:
                    carried = ends[1] if ends[2] else carried + ends[1]
        return pd.DataFrame(out, columns=[*_columns(_JOB), "asked"])

    return judge


def _walk_ranges(size: int, onward: bool):
    """What the jobs' starts lead to; onward: in all ranges of `size` bytes up to the file's end."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for job in batch.itertuples(index=False):
                window, carried, start, out = _Window(job.path), list(job.assumed), job.start, []
                part = _Range(window, int(job.first), int(job.stop), carried)
                while True:
                    first = part.offset
                    part.walk()
                    found = (part.offset, part.setup, part.section)
                    out.append((job.path, job.base, start, part.stop, 1, first, carried, *found))
                    if not onward or part.offset >= window.size:
                        break
                    carried = part.setup if part.section else carried + part.setup
                    start = part.offset // size * size
                    part.go_on(start + size)
                yield pd.DataFrame(out, columns=_columns(_STATE))

    return walk


_JOB = "path STRING, base BIGINT, start BIGINT, stop BIGINT, attempt INT, first BIGINT, assumed ARRAY<BIGINT>"
_STATE = f"{_JOB}, last BIGINT, setup ARRAY<BIGINT>, section BOOLEAN"


def _read(jobs: DataFrame, tasks: int, ports: tuple[int, ...]) -> DataFrame:
    """Decoded rows of the jobs, dealt out evenly and stored."""
    dealt = jobs.repartitionByRange(max(1, tasks), "base", "start")
    return stage(dealt.mapInArrow(_decode_ranges(ports), _spark_schema()), "capture-rows").df


def _placed(listing: DataFrame) -> DataFrame:
    """path, length, base: the bytes of all files before each one, in path order."""
    parts = listing.repartitionByRange("path").withColumn("part", F.spark_partition_id())
    parts = stage(parts, "capture-files").df
    sizes = parts.groupBy("part").agg(F.sum("length").alias("size"))
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")
    within = F.sum("length").over(Window.partitionBy("part").orderBy("path")) - F.col("length")
    return parts.join(sizes.select("part", before.alias("before")), "part").select(
        "path", "length", (F.col("before") + within).alias("base")
    )


def scan_captures(
    spark: SparkSession,
    path: str,
    *,
    split_bytes: int = 64 << 20,
    ports: tuple[int, ...] = DNS_PORTS,
) -> DataFrame:
    """DNS-over-UDP messages of all capture files under `path`: RAW_SCHEMA, `skipped`, and
    `path`, `offset`, `unread_bytes`.

    Messages without IPv4 addresses are kept as rows with skipped = true and no content, so
    they can be counted. So are packets of an unknown link type and the rest of a file whose
    lengths break off, with the bytes that were not read. seq is the packet's place in all
    files, in path order. A file that is no capture fails the job. Ranges are longer than
    `split_bytes` where there would be more than 200,000 of them.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = stage(_placed(listing.select("path", "length")), "capture-places").df
    total = files.agg(F.sum("length")).first()[0] or 0
    size = max(split_bytes, -(-total // _MOST_RANGES) // 4 * 4)
    last_split = F.floor((F.greatest("length", F.lit(1)) - 1) / F.lit(size))
    ranges = files.select("path", "base", F.explode(F.sequence(F.lit(0), last_split)).alias("n"))
    start = (F.col("n") * F.lit(size)).cast("long")
    first_jobs = ranges.select(
        "path",
        "base",
        start.alias("start"),
        (start + F.lit(size)).alias("stop"),
        F.lit(0).alias("attempt"),
        F.lit(None).cast("long").alias("first"),
        F.lit(None).cast("array<long>").alias("assumed"),
    )
    first_jobs = stage(first_jobs, "capture-ranges")
    decoded = _read(first_jobs.df, first_jobs.rows, ports)
    states = decoded.where("stop is not null").select(*_columns(_STATE))
    many = states.groupBy("path").count().where("count > 1").select("path")
    states, turn = states.join(many, "path", "left_semi"), 0
    while True:
        onward = turn >= _WALKS
        judged = states.groupBy("path").applyInPandas(_judge(onward), f"{_JOB}, asked BOOLEAN")
        judged = stage(judged, "capture-judged").df
        asked = stage(judged.where("asked").drop("asked"), "capture-asked")
        if not asked.rows:
            break
        dealt = asked.df.repartitionByRange(asked.rows, "base", "start")
        walked = stage(dealt.mapInPandas(_walk_ranges(size, onward), _STATE), "capture-walked").df
        states, turn = states.unionByName(walked), turn + 1
    again = stage(judged.drop("asked"), "capture-again")
    if again.rows:
        kept = decoded.join(again.df.select("path", "start"), ["path", "start"], "left_anti")
        decoded = kept.select(*decoded.columns).unionByName(_read(again.df, again.rows, ports))
    seq = F.col("base") + F.col("offset")
    columns = [F.col(f.name) for f in RAW_SCHEMA if f.name != "seq"]
    rows = decoded.where("stop is null")
    return rows.select(seq.alias("seq"), *columns, "skipped", "path", "offset", "unread_bytes")


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _spark_schema() -> str:
    names = {"int64": "BIGINT", "int32": "INT", "string": "STRING", "bool": "BOOLEAN"}
    kinds = {f.name: names.get(str(f.type), "ARRAY<BIGINT>") for f in _DECODED}
    return ", ".join(f"{name} {kind}" for name, kind in kinds.items())


def captured_messages(scan: DataFrame) -> DataFrame:
    """The rows of a scan that can be analysed, as RAW_SCHEMA."""
    read = ~F.col("skipped") & (F.col("unread_bytes") == 0)
    return scan.where(read).select(*RAW_SCHEMA.fieldNames())


def skip_summary(scan: DataFrame) -> DataFrame:
    """messages, skipped, unread, unread_bytes: DNS messages read, those without an IPv4 layer,
    and the packets or rests of files that could not be read."""
    unread = F.col("unread_bytes") > 0
    return scan.agg(
        F.count_if(~F.col("skipped") & ~unread).alias("messages"),
        F.count_if("skipped").alias("skipped"),
        F.count_if(unread).alias("unread"),
        F.coalesce(F.sum("unread_bytes"), F.lit(0)).alias("unread_bytes"),
    )
