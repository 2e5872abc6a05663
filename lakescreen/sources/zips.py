"""Members of small archives without the cost of a file object for each."""

from __future__ import annotations

import struct
import zipfile
import zlib

#: Sizes and numbers from which on an archive needs other fields.
MOST_BYTES, MOST_MEMBERS = (1 << 32) - 1, (1 << 16) - 1
LOCAL, CENTRAL, END = "<4s5H3L2H", "<4s6H3L5H2L", "<4s4H2LH"


def packed(archive: zipfile.ZipFile, data: bytes, info: zipfile.ZipInfo) -> bytes | None:
    """A member's bytes as they stand in ``data``; None where only ``zipfile`` can tell."""
    if info.flag_bits & ~0x80E or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or data[info.header_offset : info.header_offset + 4] != b"PK\3\4":
        return None
    at = info.header_offset + 30 + sum(struct.unpack_from("<2H", data, info.header_offset + 26))
    held = data[at : at + info.compress_size]
    return held if len(held) == info.compress_size else None


def read(archive: zipfile.ZipFile, data: bytes, info: zipfile.ZipInfo) -> bytes:
    """A member's content; what is damaged or unusual is left to ``zipfile``, which says why."""
    held = packed(archive, data, info)
    if held is not None:
        try:
            content = zlib.decompress(held, -15, max(info.file_size, 1)) if info.compress_type else held
        except zlib.error:
            return archive.read(info)
        if len(content) == info.file_size and zlib.crc32(content) == info.CRC:
            return content
    return archive.read(info)


def write(members: list[tuple[zipfile.ZipInfo, bytes, int, int]]) -> bytes:
    """An archive of members (info, packed bytes, CRC, size), in order, packed as their infos say."""
    out, listed, at = [], [], 0
    for info, held, crc, size in members:
        name = info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437")
        stamp = info.date_time
        when = (stamp[3] << 11 | stamp[4] << 5 | stamp[5] // 2, (stamp[0] - 1980) << 9 | stamp[1] << 5 | stamp[2])
        common = (20, info.flag_bits & 0x806, info.compress_type, *when, crc, len(held), size, len(name))
        out += [struct.pack(LOCAL, b"PK\3\4", *common, 0), name, held]
        listed += [struct.pack(CENTRAL, b"PK\1\2", info.create_system << 8 | 20, *common, 0, len(info.comment), 0, info.internal_attr, info.external_attr, at), name, info.comment]
        at += 30 + len(name) + len(held)
    rows = b"".join(listed)
    if at + len(rows) > MOST_BYTES or len(members) > MOST_MEMBERS:
        raise zipfile.LargeZipFile("larger than four gigabytes or 65535 members")
    return b"".join([*out, rows, struct.pack(END, b"PK\5\6", 0, 0, len(members), len(members), len(rows), at, 0)])


def stored(named: dict[str, str]) -> bytes:
    """A new archive of texts by name, not compressed."""
    each = ((zipfile.ZipInfo(name), text.encode()) for name, text in named.items())
    return write([(info, content, zlib.crc32(content), len(content)) for info, content in each])
