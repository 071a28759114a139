"""Writes DNS log rows as pcap files, to have captures to scan."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsloom.functions.flags import HEADER_BITS
from dnsloom.sources.captures import location

PCAP_HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1)


# Client n of the log is 10.0.<n // 256>.<n % 256>, which is no address from n = 65,536 on. Such a
# client goes out as address 10.0.0.0 + n; the log has no others from 10.1.0.0 on.
_CLIENTS = (10, 0)


def wire_address(address: str) -> bytes:
    """The four bytes of an address of the log."""
    first, second, third, fourth = map(int, address.split("."))
    if third < 256 or (first, second) != _CLIENTS:
        return bytes((first, second, third, fourth))
    high, low = divmod(third, 256)
    return bytes((first + high // 256, high % 256, low, fourth))


def log_address(address: Column) -> Column:
    """An address read from a capture as the log has it: undoes `wire_address`."""
    first, second, third, fourth = (
        F.split(address, r"\.").getItem(i).cast("int") for i in range(4)
    )
    high = (first - _CLIENTS[0]) * 256 + second
    client = F.concat_ws(".", *map(F.lit, _CLIENTS), high * 256 + third, fourth)
    return F.when((first >= _CLIENTS[0]) & (high > 0), client).otherwise(address)


def dns_message(row) -> bytes:
    """Header and first question of a RAW_SCHEMA row; no question when qdcount is 0."""
    word = 0
    for name, (low, _) in HEADER_BITS.items():
        word |= int(getattr(row, name)) << low
    counts = [int(getattr(row, c)) for c in ("qdcount", "ancount", "nscount", "arcount")]
    message = struct.pack(">HHHHHH", int(row.seq) & 0xFFFF, word, *counts)
    if counts[0]:
        labels = [x.encode() for x in row.query.rstrip(".").split(".") if x]
        message += b"".join(bytes([len(x)]) + x for x in labels) + b"\0" + struct.pack(">HH", 1, 1)
    return message


def frame(row, *, ipv6: bool = False, tcp: bool = False, port: int = 53) -> bytes:
    """Ethernet frame around the message of `row`."""
    message = dns_message(row)
    ports = (port, 40000) if row.qr else (40000, port)
    transport = struct.pack(">HHHH", *ports, 8 + len(message), 0) + message
    protocol = 6 if tcp else 17
    if ipv6:
        network = struct.pack(">IHBB", 6 << 28, len(transport), protocol, 64) + bytes(32)
        return bytes(12) + b"\x86\xdd" + network + transport
    addresses = wire_address(row.source_ip) + wire_address(row.destination_ip)
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(transport), 0, 0, 64, protocol, 0)
    return bytes(12) + b"\x08\x00" + head + addresses + transport


def packet(ts_us: int, data: bytes) -> bytes:
    return struct.pack("<IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(data), len(data)) + data


# Records that a scan must read past: longer than any real packet, longer than was sent, with
# an impossible fraction, empty. Then the start of a record that the file does not hold.
ODD_RECORDS = [
    struct.pack("<IIII", 1, 0, 300_000, 300_000) + bytes(300_000),
    struct.pack("<IIII", 1, 0, 60, 20) + bytes(60),
    struct.pack("<IIII", 1, 1_000_001, 40, 40) + bytes(40),
    struct.pack("<IIII", 1, 0, 0, 0),
]
CUT_OFF = struct.pack("<IIII", 1, 0, 100, 100) + bytes(10)
_ODD_EVERY = 2000


def write_captures(raw: DataFrame, folder: str, files: int, *, mixed: bool = False) -> None:
    """`raw` as `files` pcap files under `folder`, each in time order.

    Every file has ODD_RECORDS among its packets and breaks off in a record (CUT_OFF).
    mixed: rows with seq divisible by 13 go out over IPv6, by 17 over TCP, by 19 to another
    port, to have packets that a scan must skip or ignore.
    """
    def write(batches) -> Iterator:
        sink, count = None, 0
        for pdf in batches:
            if sink is None:
                filesystem, inner = location(folder)
                filesystem.create_dir(inner)
                sink = filesystem.open_output_stream(f"{inner}/capture-{int(pdf['__file'].iloc[0])}.pcap")
                sink.write(PCAP_HEADER)
            for row in pdf.itertuples(index=False):
                kind = {}
                if mixed:
                    kind = {
                        "ipv6": row.seq % 13 == 0,
                        "tcp": row.seq % 17 == 0,
                        "port": 9953 if row.seq % 19 == 0 else 53,
                    }
                if count % _ODD_EVERY < len(ODD_RECORDS):
                    sink.write(ODD_RECORDS[count % _ODD_EVERY])
                count += 1
                sink.write(packet(int(row.ts_us), frame(row, **kind)))
            yield pdf.iloc[:0][["seq"]]
        if sink is not None:
            sink.write(CUT_OFF)
            sink.close()

    placed = raw.repartitionByRange(files, "ts_us", "seq") if files > 1 else raw.coalesce(1)
    ordered = placed.withColumn("__file", F.spark_partition_id()).sortWithinPartitions("ts_us", "seq")
    ordered.mapInPandas(write, "seq BIGINT").write.format("noop").mode("overwrite").save()
