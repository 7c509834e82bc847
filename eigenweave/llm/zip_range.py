"""Read members of a ZIP file by byte ranges: end record, ZIP64 records, central directory, local headers."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable
from dataclasses import dataclass

#: Signatures and fixed sizes of the format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, END64_SIZE, CENTRAL_SIZE, LOCAL_SIZE, COMMENT_MAX = 22, 20, 56, 46, 30, 65535
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    crc: int
    header: int


class RangeFile:
    """Reads (offset, size) of a local file and counts what it read."""

    def __init__(self, path: str):
        self.fd = os.open(path, os.O_RDONLY)
        self.size = os.fstat(self.fd).st_size
        self.bytes_read = 0

    def __call__(self, offset: int, size: int) -> bytes:
        parts = []
        while size > 0 and (got := os.pread(self.fd, size, offset)):
            parts.append(got)
            offset, size = offset + len(got), size - len(got)
        data = b"".join(parts)
        self.bytes_read += len(data)
        return data

    def close(self) -> None:
        os.close(self.fd)


def directory(read: Callable[[int, int], bytes], size: int) -> dict[str, Member]:
    """The members by name. Raises ValueError where the file is no whole ZIP archive."""
    tail_at = max(0, size - END_SIZE - COMMENT_MAX)
    tail = read(tail_at, size - tail_at)
    k = len(tail)
    while (k := tail.rfind(END, 0, k)) >= 0:  # a comment may hold the signature
        if len(tail) - k >= END_SIZE and struct.unpack_from("<H", tail, k + 20)[0] == len(tail) - k - END_SIZE:
            break
    if k < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    if FULL16 == count or FULL32 in (length, start):
        at = tail_at + k - LOCATOR_SIZE
        locator = read(at, LOCATOR_SIZE) if at >= 0 else b""
        if locator[:4] == LOCATOR64:
            record = read(struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
    data, at, members = read(start, length), 0, {}
    if len(data) != length:
        raise ValueError("central directory is cut off")
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("bad entry in central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, stored, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", data, at + 16)
        (header,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, p = data[at + CENTRAL_SIZE + n_name : at + CENTRAL_SIZE + n_name + n_extra], 0
        while p + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, p)
            if tag == 1:  # ZIP64: 8 bytes for each field that is full, in this order
                wide = [struct.unpack_from("<Q", extra, q)[0] for q in range(p + 4, p + 4 + n - 7, 8)]
                plain = wide.pop(0) if plain == FULL32 else plain
                stored = wide.pop(0) if stored == FULL32 else stored
                header = wide.pop(0) if header == FULL32 else header
            p += 4 + n
        members[name] = Member(name, method, plain, stored, crc, header)
        at += CENTRAL_SIZE + n_name + n_extra + n_comment
    return members


def data_start(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where a stored member's bytes begin; only then can its parts be read by range."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed, not stored")
    head = read(member.header, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + LOCAL_SIZE + n_name + n_extra
