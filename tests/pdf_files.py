"""A small writer of PDF files for tests."""

import zlib


def stream(body: bytes, info: str = "") -> bytes:
    return f"<< {info} /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream"


def write(objects: dict[int, bytes], version: bytes = b"%PDF-1.5\n", xref: bool = True) -> bytes:
    out, where = bytearray(version), {}
    for n, body in objects.items():
        where[n] = len(out)
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    if xref:
        at = len(out)
        out += f"xref\n0 {len(where) + 1}\n".encode() + b"".join(f"{where.get(i, 0):010d} 00000 n \n".encode() for i in range(len(where) + 1))
        out += f"trailer\n<< /Size {len(where) + 1} /Root 1 0 R >>\nstartxref\n{at}\n%%EOF\n".encode()
    return bytes(out)


def simple(pages: list[str], image: bytes | None = None, flate: bool = True, **how) -> bytes:
    """Pages of lines; on every page an image of 8-bit grey samples over three quarters of it."""
    n = len(pages)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {n} /MediaBox [0 0 600 800] /Kids [{' '.join(f'{10 + 2 * i} 0 R' for i in range(n))}] >>".encode(), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    drawn = ""
    if image is not None:
        objects[4] = stream(zlib.compress(image), f"/Type /XObject /Subtype /Image /Width {len(image)} /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /FlateDecode")
        drawn = "q 600 0 0 600 0 0 cm /Im1 Do Q\n"
    for i, text in enumerate(pages):
        said = "".join(f"({line.translate({92: r'\\', 40: r'\(', 41: r'\)'})}) Tj T*\n" for line in text.split("\n"))
        body = f"{drawn}BT /F1 12 Tf 14 TL 72 720 Td\n{said}ET".encode("latin-1")
        objects[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /Im1 4 0 R >> >> /Contents {11 + 2 * i} 0 R >>".encode()
        objects[11 + 2 * i] = stream(zlib.compress(body), "/Filter /FlateDecode") if flate else stream(body)
    return write(objects, **how)
