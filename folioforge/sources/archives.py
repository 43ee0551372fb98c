"""ZIP archives of few small parts, in memory, as Office files are: read and written without the objects that ``zipfile`` makes for each part."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from functools import lru_cache

_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")
#: Flags of a part that change nothing here: strength of compression, sizes behind the data, name in UTF-8.
_KNOWN = 0x80E


class Parts:
    """Parts of an archive by name. What is not plain (comments, other methods, extra fields, damage) is left to ``zipfile``, with its results and errors."""

    def __init__(self, content: bytes):
        self.content, self.whole = content, None
        found = self._plain(content)
        if found is None:
            self.whole = zipfile.ZipFile(io.BytesIO(content))
        self.at = found or {}

    @staticmethod
    def _plain(content: bytes) -> dict[str, tuple] | None:
        """name: (method, CRC, packed size, size, place, bytes of the name, end), in order; None if anything is unusual."""
        end = len(content) - _END.size
        if end < 0:
            return None
        mark, disk, first, here, count, size, start, comment = _END.unpack_from(content, end)
        if mark != b"PK\5\6" or disk or first or here != count or count == 0xFFFF or comment or start + size != end:
            return None
        rows, at = [], start
        for _ in range(count):
            if at + _CENTRAL.size > end:
                return None
            mark, _, needs, flags, method, _, _, crc, packed, whole, name, extra, note, part_disk, _, _, place = _CENTRAL.unpack_from(content, at)
            raw = content[at + _CENTRAL.size : at + _CENTRAL.size + name]
            at += _CENTRAL.size + name
            if mark != b"PK\1\2" or needs > 45 or flags & ~_KNOWN or method not in (0, 8) or extra or note or part_disk or not raw.isascii() or b"\0" in raw or max(packed, whole, place) == 0xFFFFFFFF:
                return None
            if rows and place <= rows[-1][5]:
                return None
            rows.append((raw.decode(), method, crc, packed, whole, place, raw))
        ends = [r[5] for r in rows[1:]] + [start]
        found = {r[0]: (*r[1:], e) for r, e in zip(rows, ends)}
        return found if at == end and len(found) == count else None

    @property
    def names(self) -> list[str]:
        return list(self.at) if self.whole is None else self.whole.namelist()

    def __contains__(self, name: str) -> bool:
        return name in self.at if self.whole is None else name in self.whole.NameToInfo

    def read(self, name: str) -> bytes:
        if self.whole is None and (found := self.at.get(name)) is not None:
            method, crc, packed, size, place, raw, end = found
            if place + _LOCAL.size <= end:
                mark, _, flags, _, _, _, _, _, _, length, extra = _LOCAL.unpack_from(self.content, place)
                at = place + _LOCAL.size + length + extra
                if mark == b"PK\3\4" and not flags & ~_KNOWN and at + packed <= end and self.content[place + _LOCAL.size : place + _LOCAL.size + length] == raw:
                    try:
                        data = self.content[at : at + packed]
                        data = zlib.decompressobj(-15).decompress(data, size + 1) if method else data
                    except zlib.error:
                        data = None
                    if data is not None and len(data) == size and zlib.crc32(data) == crc:
                        return data
        with zipfile.ZipFile(io.BytesIO(self.content)) as z:
            return z.read(name)


def _deflate(data: bytes) -> tuple[int, bytes]:
    return zlib.crc32(data), zlib.compress(data, 6, -15)


#: Parts that are the same in every file of a kind are packed once.
_again = lru_cache(64)(_deflate)


def zipped(parts: dict[str, str], deflate: bool = True, again: frozenset[str] = frozenset()) -> bytes:
    """An archive of texts. Parts named in ``again`` are likely to come again; dates are fixed, so equal parts give equal archives."""
    out, central, at = [], [], 0
    for name, text in parts.items():
        data, raw = text.encode(), name.encode()
        crc, packed = (_again if name in again else _deflate)(data) if deflate else (zlib.crc32(data), data)
        fields = 20, 0 if raw.isascii() else 0x800, 8 if deflate else 0, 0, 33, crc, len(packed), len(data), len(raw), 0
        out += [_LOCAL.pack(b"PK\3\4", *fields), raw, packed]
        central += [_CENTRAL.pack(b"PK\1\2", 20, *fields, 0, 0, 0, 0, at), raw]
        at += _LOCAL.size + len(raw) + len(packed)
    size = sum(map(len, central))
    return b"".join([*out, *central, _END.pack(b"PK\5\6", 0, 0, len(parts), len(parts), size, at, 0)])
