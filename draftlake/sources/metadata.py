"""Metadata sections of drawings: application, preview image, file dependencies, header variables."""

from __future__ import annotations

from draftlake.functions.bits import BitReader, BitsExhausted
from draftlake.sources.container import ContainerError

# The marks around a preview and before the header variables, and the beginnings of images.
PREVIEW_START = bytes.fromhex("1f256d07d43628289d57ca3f9d44102b")
PREVIEW_END = bytes.fromhex("e0da92f82bc9d7d762a835c062bbefd4")
HEADER_START = bytes.fromhex("cf7b1f23fdde38a95f7c68b84e6d335f")
PNG, BMP, BMP_HEADER = b"\x89PNG\r\n\x1a\n", b"BM", 54
KINDS = {1: "header", 2: "bmp", 3: "wmf", 6: "png"}


class Bytes:
    """Little-endian values one behind the other; reading past the end raises."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ContainerError(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(n), "little", signed=signed)

    def text(self, size: int = 2, wide: bool = False) -> str:
        n = self.number(size)
        raw = self.take(2 * n if wide else n)
        return raw.decode("utf-16-le" if wide else "utf-8", "replace").rstrip("\0")


def app_info(data: bytes) -> dict:
    """name, version, comment, product and product_xml; the wide form where the section begins with 2 or 3 and can be read so."""
    if data[:4] in (b"\x02\0\0\0", b"\x03\0\0\0"):
        try:
            r = Bytes(data[4:])
            out = {"name": r.text(wide=True), "product_xml": ""}
            r.number(4)
            r.take(16)
            version = r.text(wide=True)
            r.take(16)
            rest = []
            for gap in (0, 16):
                r.take(gap)
                try:
                    rest.append(r.text(wide=True))
                except ContainerError:
                    rest.append("")
            try:
                version = r.text() or version
            except ContainerError:
                pass
            return out | {"version": version, "comment": rest[0], "product": rest[1]}
        except ContainerError:
            pass
    r = Bytes(data)
    name = r.text()
    r.number(4)
    r.text()
    xml = r.text()
    try:
        version = r.text()
    except ContainerError:
        version = ""
    return {"name": name, "product_xml": xml, "version": version, "comment": "", "product": ""}


def preview(data: bytes) -> dict:
    """overall_size and the images by the directory: bmp (a PNG stands in for a missing one), wmf, header; else the first image found by its beginning."""
    if data[:16] != PREVIEW_START:
        raise ContainerError("preview without its mark")
    r = Bytes(data[16:])
    out: dict = {"overall_size": 0, "bmp": None, "wmf": None, "header": None, "png": None}
    try:
        out["overall_size"] = r.number(4)
        for _ in range(r.number(1)):
            kind, start, size = KINDS.get(r.number(1)), r.number(4), r.number(4)
            if kind and start and size and start + size <= len(data):
                out[kind] = data[start : start + size]
    except ContainerError:
        pass
    out["bmp"] = out["bmp"] or out.pop("png")
    out.pop("png", None)
    if out["bmp"] is None and out["wmf"] is None:
        places = [p for p in (data.find(PNG, 16), data.find(BMP, 16)) if p >= 0]
        places = [p for p in places if data.startswith(PNG, p) or len(data) - p > BMP_HEADER]
        if places:
            end = data.rfind(PREVIEW_END)
            out["bmp"] = data[min(places) : end if end > min(places) else len(data)]
    return out


def file_dependencies(data: bytes) -> list[dict]:
    """Files with the name of their feature, '?' for an index outside of the list."""
    r = Bytes(data)
    features = [r.text(4) for _ in range(_count(r))]
    out = []
    for _ in range(_count(r)):
        f = {k: r.text(4) for k in ("full_filename", "found_path", "fingerprint_guid", "version_guid")}
        f |= {k: r.number(4, True) for k in ("feature_index", "timestamp", "filesize")}
        f |= {"affects_graphics": r.number(2) != 0, "reference_count": r.number(4, True)}
        f["feature"] = features[f["feature_index"]] if 0 <= f["feature_index"] < len(features) else "?"
        out.append(f)
    return out


def _count(r: Bytes) -> int:
    n = r.number(4)
    if n > len(r.data):
        raise ContainerError(f"{n} entries in {len(r.data)} bytes")
    return n


def header_variables(data: bytes, strict: bool = False) -> dict:
    """Mark, size and body of the header section; too short a one is empty or, strictly, an error."""
    if len(data) < 20:
        if strict:
            raise ContainerError("header section cut short")
        return {"valid_mark": False, "size_in_bits": 0, "body": b""}
    return {"valid_mark": data[:16] == HEADER_START, "size_in_bits": int.from_bytes(data[16:20], "little"), "body": data[20:]}


def leading(body: bytes, code: str, n: int) -> list:
    """The first n values of one code, as far as the body goes."""
    r, out = BitReader(body), []
    try:
        for _ in range(n):
            out.append(getattr(r, code)())
    except (BitsExhausted, ValueError):
        pass
    return out
