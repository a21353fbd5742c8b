"""Drawing containers: bytes to tables and tables to bytes.

A file has a common header, a masked header with the place of its page map,
data pages of compressed section parts, and two system pages: the page map
(number and size of each page in file order) and the section map (name, size and
page references of each section). Sections hold the handle index, the class map
and the object stream.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from draftlake.functions import codecs
from draftlake.functions.bits import BitReader, BitsExhausted, BitWriter

# Versions by their magic, and names of sections with their kinds.
VERSIONS = {"AC1014": 14, "AC1015": 2000, "AC1018": 2004, "AC1021": 2007, "AC1024": 2010, "AC1027": 2013, "AC1032": 2018}
PAGED = (2004, 2010, 2013, 2018)
SECTIONS = {
    "AcDb:Header": "header", "AcDb:AuxHeader": "aux_header", "AcDb:Classes": "classes", "AcDb:Handles": "handles", "AcDb:Template": "template", "AcDb:ObjFreeSpace": "obj_free_space",
    "AcDb:AcDbObjects": "objects", "AcDb:RevHistory": "rev_history", "AcDb:SummaryInfo": "summary_info", "AcDb:Preview": "preview", "AcDb:AppInfo": "app_info", "AcDb:AppInfoHistory": "app_info_history",
    "AcDb:FileDepList": "file_dep_list", "AcDb:Security": "security", "AcDb:VBAProject": "vba_project", "AcDb:Signature": "signature",
}
LOCATOR_NAMES = {0: "AcDb:Header", 1: "AcDb:Classes", 2: "AcDb:Handles", 3: "AcDb:ObjFreeSpace", 4: "AcDb:Template"}
FILE_ID = b"AcFssFcAJMB\0"
DATA_PAGE, PAGE_MAP, SECTION_MAP = 0x4163043B, 0x41630E3B, 0x4163003B
FIRST_PAGE = 0x100
SYSTEM = "system_section"
MAX_HANDLES, MAX_CLASSES, HANDLE_BLOCK = 1_000_000, 4096, 2032


class ContainerError(ValueError):
    """A file that can't be read as a drawing; the message says why."""


def version_of(content: bytes) -> tuple[str, int]:
    magic = content[:6].decode("latin-1")
    if not magic.startswith("AC"):
        raise ContainerError("no drawing")
    if magic not in VERSIONS:
        raise ContainerError(f"unsupported version {magic}")
    return magic, VERSIONS[magic]


def common_header(content: bytes) -> dict:
    if len(content) < 0x15:
        raise ContainerError("file shorter than its header")
    magic, _ = version_of(content)
    return {"version": magic, "maint_version": content[0x0B], "image_seeker": int.from_bytes(content[0x0D:0x11], "little"), "codepage": int.from_bytes(content[0x13:0x15], "little")}


def masked_header(content: bytes) -> dict:
    if len(content) < 0xEC:
        raise ContainerError("file shorter than its masked header")
    block = codecs.xor(content[0x80:0xEC], codecs.magic())
    if block[:11] != FILE_ID[:11]:
        raise ContainerError("masked header without its mark")
    names = (("last_page_id", 0x28, 4), ("last_page_end", 0x2C, 8), ("second_header", 0x34, 8), ("gaps", 0x3C, 4), ("pages", 0x40, 4), ("page_map_id", 0x50, 4), ("page_map_addr", 0x54, 8), ("section_map_id", 0x5C, 4), ("page_array_size", 0x60, 4), ("gap_array_size", 0x64, 4), ("crc", 0x68, 4))
    out = {n: int.from_bytes(block[a : a + k], "little") for n, a, k in names}
    out["crc_actual"] = codecs.crc32(block[:0x68] + bytes(4))
    return out


def _system_page(content: bytes, at: int, kind: int) -> bytes:
    if at + 20 > len(content):
        raise ContainerError(f"system page at {at} beyond the file")
    tag, size, packed, how, _ = codecs.words(content[at : at + 20], 5)
    if tag != kind or how != 2:
        raise ContainerError(f"page at {at} has tag {tag:#x} and packing {how}")
    if at + 20 + packed > len(content):
        raise ContainerError(f"system page at {at} beyond the file")
    return codecs.lz77_decompress(content[at + 20 : at + 20 + packed])[:size]


def page_map(content: bytes, header: dict) -> list[dict]:
    data = _system_page(content, header["page_map_addr"] + FIRST_PAGE, PAGE_MAP)
    out, i, at = [], 0, FIRST_PAGE
    while i + 8 <= len(data):
        number, size = struct.unpack_from("<iI", data, i)
        i += 8
        if number < 0:
            if i + 16 > len(data):
                raise ContainerError("gap of the page map cut short")
            i += 16
        out.append({"seq": len(out), "number": number, "size": size, "file_offset": at, "is_gap": number < 0})
        at += size
    return out


def section_map(content: bytes, header: dict, pages: list[dict]) -> list[dict]:
    page = next((p for p in pages if p["number"] == header["section_map_id"]), None)
    if page is None:
        raise ContainerError(f"section map page {header['section_map_id']} not in the page map")
    data = _system_page(content, page["file_offset"], SECTION_MAP)
    if len(data) < 20:
        raise ContainerError("section map cut short")
    out, at = [], 20
    for _ in range(struct.unpack_from("<I", data)[0]):
        if at + 0x60 > len(data):
            raise ContainerError("section of the section map cut short")
        size, n, _, _, packed, number, encrypted = struct.unpack_from("<QIIIIII", data, at)
        name = data[at + 32 : at + 96].split(b"\0")[0].decode("utf-8", "replace")
        at += 0x60
        if at + 16 * n > len(data):
            raise ContainerError(f"page references of {name!r} cut short")
        refs = [dict(zip(("page_number", "data_size", "start_offset"), struct.unpack_from("<IIQ", data, at + 16 * k))) for k in range(n)]
        at += 16 * n
        out.append({"name": name, "size": size, "compressed": packed, "section_id": number, "encrypted": encrypted, "pages": refs})
    return out


def first_page(content: bytes) -> dict | None:
    """What the masked header of the page behind the file's header tells, or None where its tag is no known one."""
    if len(content) < FIRST_PAGE + 32:
        return None
    tag, number, size = codecs.words(codecs.mask_words(content[FIRST_PAGE : FIRST_PAGE + 32], FIRST_PAGE), 3)
    name = {PAGE_MAP: "SystemSection(PageMap)", SECTION_MAP: "SystemSection(SectionMap)", DATA_PAGE: f"DataPage(decomp={number})"}.get(tag)
    return name and {"name": name, "kind": "unknown" if tag == DATA_PAGE else SYSTEM, "offset": FIRST_PAGE + 32, "size": size, "compressed": 2, "encrypted": 1, "pages": []}


def stub_sections(content: bytes, header: dict | None) -> list[dict]:
    """Sections that the headers alone name, with a size of 0, for files whose section map can't be read."""
    if header is None:
        return []
    word = lambda at: int.from_bytes(content[at : at + 4], "little")
    seeker, whole = word(0x0D), len(content)
    known = (
        ("SectionPageMap", SYSTEM, header["page_map_addr"] + FIRST_PAGE, 2, True),
        ("AcDb:SummaryInfo", "summary_info", word(0x20) + 32, 1, word(0x20) != 0),
        ("AcDb:VBAProject", "vba_project", word(0x24) + 32, 1, word(0x24) != 0),
        ("AcDb:Preview", "preview", seeker + 32, 1, 0 < seeker < whole),
        ("SecondHeader", SYSTEM, header["second_header"], 1, 0 < header["second_header"] < whole),
    )
    out = [{"name": n, "kind": kind, "offset": at, "size": 0, "compressed": how, "encrypted": 0, "pages": []} for n, kind, at, how, there in known if there]
    sniffed = first_page(content)
    return out + ([sniffed] if sniffed else [])


def locator_sections(content: bytes) -> list[dict]:
    """Sections of the versions before 2004: records of 9 bytes from 0x19."""
    count = int.from_bytes(content[0x15:0x19], "little")
    if 0x19 + 9 * count > len(content) or count > 64:
        raise ContainerError("locator records beyond the file")
    out = []
    for k in range(count):
        number, seek, size = struct.unpack_from("<BII", content, 0x19 + 9 * k)
        out.append({"name": LOCATOR_NAMES.get(number, f"record {number}"), "size": size, "offset": seek, "compressed": 1, "encrypted": 0, "pages": []})
    return out


def assemble(content: bytes, pages: list[dict], section: dict, limit: int = codecs.MAX_OUTPUT) -> bytes:
    """Payload of a section: its pages unpacked to their places, the rest zero. The declared size is checked first."""
    if section["size"] > limit:
        raise ContainerError(f"section {section['name']!r} over the limit")
    by_number = {p["number"]: p for p in reversed(pages) if not p["is_gap"]}
    out = bytearray(section["size"])
    for ref in section["pages"]:
        page = by_number.get(ref["page_number"])
        if page is None:
            raise ContainerError(f"section {section['name']!r} refers to page {ref['page_number']}, which is missing")
        at = page["file_offset"]
        tag, _, size, whole, _, _, _, _ = codecs.words(codecs.mask_words(content[at : at + 32], at), 8)
        if tag != DATA_PAGE:
            raise ContainerError(f"page {ref['page_number']} has tag {tag:#x}")
        data = content[at + 32 : at + 32 + size]
        if len(data) < size:
            raise ContainerError(f"page {ref['page_number']} beyond the file")
        if section["compressed"] == 2:
            data = codecs.lz77_decompress(data, max_output=max(whole, 1))
        elif section["compressed"] != 1:
            raise ContainerError(f"packing {section['compressed']} of section {section['name']!r}")
        start = ref["start_offset"]
        part = data[: max(0, len(out) - start)]
        out[start : start + len(part)] = part
    return bytes(out)


class Drawing:
    """One file: its header, pages and sections. What fails is told in `status` and `reason`."""

    def __init__(self, content: bytes):
        self.content = content
        self.header = common_header(content)
        self.number = VERSIONS[self.header["version"]]
        self.pages: list[dict] = []
        self.sections: list[dict] = []
        self.status, self.reason = "Full", None
        if self.number in PAGED:
            masked = None
            try:
                masked = masked_header(content)
                self.pages = page_map(content, masked)
                self.sections = [s for s in section_map(content, masked, self.pages) if s["name"]]
                if not self.sections:
                    raise ContainerError("no sections")
            except (ContainerError, codecs.Lz77Error) as e:
                self.status, self.reason = "Fallback", str(e)
                self.sections = stub_sections(content, masked)
        elif self.number == 2007:
            self.status, self.reason = "Deferred", "2007 header"
        else:
            try:
                self.sections = locator_sections(content)
            except ContainerError as e:
                self.status, self.reason = "Fallback", str(e)

    def section(self, name: str, limit: int = codecs.MAX_OUTPUT) -> bytes | None:
        s = next((s for s in self.sections if s["name"] == name), None)
        if s is None:
            return None
        if "offset" in s:
            return self.content[s["offset"] : s["offset"] + s["size"]]
        return assemble(self.content, self.pages, s, limit)


def handle_index(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(seq, handle, offset): blocks behind a big-endian size, with signed deltas that run on across blocks."""
    at = seq = handle = offset = 0
    while at + 2 <= len(data):
        size = int.from_bytes(data[at : at + 2], "big")
        at += 2
        if size == 0:
            return
        if size < 2 or at + size > len(data):
            raise ContainerError(f"block of {size} bytes at {at} of {len(data)}")
        r = BitReader(data[at : at + size - 2])
        at += size
        while r.remaining() >= 8:
            try:
                handle += r.MC()
                offset += r.MC()
            except BitsExhausted:
                break
            if seq >= MAX_HANDLES:
                raise ContainerError("too many handles")
            yield seq, handle, offset
            seq += 1


def write_handle_index(entries: list[tuple[int, int]]) -> bytes:
    out, block, handle, offset = bytearray(), b"", 0, 0

    def flush() -> None:
        nonlocal block
        if block:
            out.extend((len(block) + 2).to_bytes(2, "big") + block + codecs.crc16(block, codecs.SECTION_SEED).to_bytes(2, "little"))
        block = b""

    for h, o in entries:
        w = BitWriter()
        w.MC(h - handle)
        w.MC(o - offset)
        pair = w.bytes()
        if len(block) + len(pair) + 2 > HANDLE_BLOCK:
            flush()
        block += pair
        handle, offset = h, o
    flush()
    return bytes(out) + b"\0\0"


def class_map(data: bytes, version: int) -> list[dict]:
    if len(data) < 25:
        return []
    bits = int.from_bytes(data[16:20], "little")
    r = BitReader(data[24:], version >= 2007)
    if version >= 2007:
        r.B()
    out: list[dict] = []
    while r.at < bits - 32 and r.remaining() >= 64 and len(out) <= MAX_CLASSES:
        try:
            c = {"class_number": r.BSu(), "version": r.BS(), "app_name": r.TV(), "cpp_class_name": r.TV(), "dxf_class_name": r.TV(), "was_a_proxy": r.B(), "item_class_id": r.BSu()}
        except BitsExhausted:
            break
        if not (c["app_name"] or c["cpp_class_name"] or c["dxf_class_name"]):
            break
        out.append(c)
    return out


def write_class_map(classes: list[dict], version: int) -> bytes:
    w = BitWriter(version >= 2007)
    if version >= 2007:
        w.B(False)
    for c in classes:
        w.BSu(c["class_number"])
        w.BS(c["version"])
        for n in ("app_name", "cpp_class_name", "dxf_class_name"):
            w.TV(c[n])
        w.B(c["was_a_proxy"])
        w.BSu(c["item_class_id"])
    body = w.bytes() + bytes(8)
    most = max((c["class_number"] for c in classes), default=0)
    return bytes(16) + (w.size + 32).to_bytes(4, "little") + most.to_bytes(4, "little") + body


def _unsigned_mc(r: BitReader) -> int:
    out = shift = 0
    while True:
        b = r.RC()
        out |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            return out


def type_code(r: BitReader, version: int) -> int:
    if version < 2010:
        return r.BSu()
    tag = r.BB()
    return r.RC() if tag == 0 else r.RC() + 0x1F0 if tag == 1 else r.RS()


def read_object(stream: bytes, at: int, version: int) -> dict | None:
    """The framed record at an offset, with the bit where its body begins; None at the end of the stream."""
    size = shift = used = 0
    while True:
        if at + used + 2 > len(stream):
            return None
        w = int.from_bytes(stream[at + used : at + used + 2], "little")
        used += 2
        size |= (w & 0x7FFF) << shift
        shift += 15
        if not w & 0x8000:
            break
    if size == 0 or at + used + size + 2 > len(stream):
        return None
    raw = stream[at + used : at + used + size]
    r = BitReader(raw)
    if version >= 2010:
        _unsigned_mc(r)
    code = type_code(r, version)
    if version == 2000:
        r.RL()
    handle = r.H()
    return {"stream_offset": at, "size_bytes": size, "type_code": code, "handle": handle, "raw": raw, "body_bit": r.at, "next": at + used + size + 2}


def write_object(code: int, handle: int, body: BitWriter | bytes, version: int) -> bytes:
    w = BitWriter(version >= 2007)
    if version >= 2010:
        w.RC(0)
        if code < 0x100:
            w.BB(0)
            w.RC(code)
        elif 0x1F0 <= code < 0x2F0:
            w.BB(1)
            w.RC(code - 0x1F0)
        else:
            w.BB(2)
            w.RS(code)
    else:
        w.BSu(code)
    if version == 2000:
        w.RL(0)
    w.H({"code": 0, "counter": 0, "value": handle})
    if isinstance(body, BitWriter):
        w.bits(body.word, body.size)
    else:
        w.raw(body)
    raw = w.bytes()
    head = BitWriter()
    head.MS(len(raw))
    return head.bytes() + raw + codecs.crc16(raw, codecs.SECTION_SEED).to_bytes(2, "little")


def objects(stream: bytes, version: int, index: list[tuple[int, int]] | None = None) -> Iterator[dict]:
    """Records by the index, each for itself, or one behind the other; those that fail come with status 'error' or 'skipped'."""
    if index is None:
        at = 4 if version in PAGED else 0
        while at < len(stream):
            try:
                o = read_object(stream, at, version)
            except ValueError as e:
                yield {"stream_offset": at, "status": "error", "reason": str(e)}
                return
            if o is None:
                return
            yield o | {"status": "ok", "reason": None}
            at = o["next"]
        return
    for handle, offset in index:
        try:
            o = read_object(stream, offset, version) if 0 <= offset < len(stream) else None
        except ValueError as e:
            yield {"stream_offset": offset, "handle": {"code": 0, "counter": 0, "value": handle}, "status": "error", "reason": str(e)}
            continue
        if o is None:
            yield {"stream_offset": offset, "handle": {"code": 0, "counter": 0, "value": handle}, "status": "skipped", "reason": "no record there"}
        else:
            yield o | {"status": "ok", "reason": None}


def summary_info(data: bytes) -> dict:
    """Metadata of a drawing: strings as UTF-16 or else as bytes, three raw dates, and key and value pairs."""
    for unicode in (True, False):
        try:
            at = 0

            def text() -> str:
                nonlocal at
                n = int.from_bytes(data[at : at + 2], "little")
                size = 2 * n if unicode else n
                if at + 2 + size > len(data):
                    raise ContainerError("string beyond the section")
                raw = data[at + 2 : at + 2 + size]
                at += 2 + size
                return raw.decode("utf-16-le" if unicode else "latin-1").rstrip("\0")

            out = {k: text() for k in ("title", "subject", "author", "keywords", "comments", "last_saved_by", "revision_number", "hyperlink_base")}
            for k in ("total_edit_time_raw", "create_date_raw", "modified_date_raw"):
                if at + 8 > len(data):
                    raise ContainerError("date beyond the section")
                out[k] = data[at : at + 8]
                at += 8
            n = int.from_bytes(data[at : at + 2], "little")
            at += 2
            out["properties"] = [{"key": text(), "value": text()} for _ in range(n)]
            return out
        except (ContainerError, UnicodeDecodeError):
            continue
    raise ContainerError("summary neither in UTF-16 nor in bytes")


def write_summary_info(info: dict) -> bytes:
    text = lambda s: (len(s.encode("utf-16-le")) // 2 + 1).to_bytes(2, "little") + s.encode("utf-16-le") + b"\0\0"
    out = b"".join(text(info.get(k) or "") for k in ("title", "subject", "author", "keywords", "comments", "last_saved_by", "revision_number", "hyperlink_base"))
    out += b"".join(bytes(info.get(k) or bytes(8)) for k in ("total_edit_time_raw", "create_date_raw", "modified_date_raw"))
    props = info.get("properties") or []
    return out + len(props).to_bytes(2, "little") + b"".join(text(p["key"]) + text(p["value"]) for p in props)


def build(version: int, sections: dict[str, bytes], maint_version: int = 0, codepage: int = 30, page_size: int = 0x7400) -> bytes:
    """A file of the paged family from section payloads, in the order of their names; names must be known ones."""
    return build_with_places(version, sections, maint_version, codepage, page_size)[0]


def build_with_places(version: int, sections: dict[str, bytes], maint_version: int = 0, codepage: int = 30, page_size: int = 0x7400) -> tuple[bytes, dict]:
    """`build`, and where everything was put."""
    if version not in PAGED:
        raise ContainerError(f"files of version {version} can't be written")
    unknown = [n for n in sections if n not in SECTIONS]
    if unknown:
        raise ContainerError(f"unknown sections {unknown}")
    magic = next(m for m, v in VERSIONS.items() if v == version)
    pages: list[tuple[int, bytes]] = []
    described = []
    at = FIRST_PAGE
    for number, name in enumerate(sorted(sections), 1):
        data, refs = sections[name], []
        for start in range(0, len(data), page_size):
            part = data[start : start + page_size]
            packed = 2 if len(data) >= 4 else 1
            body = codecs.lz77_compress(part) if packed == 2 and len(part) >= 4 else part
            if packed == 2 and len(part) < 4:
                packed, body = 2, None
            if body is None:  # a rest of 1 to 3 bytes goes with zeros behind it
                body = codecs.lz77_compress(part + bytes(4 - len(part)))
            head = struct.pack("<8I", DATA_PAGE, number, len(body), max(len(part), 4), start & 0xFFFFFFFF, 0, codecs.rotate_add(body), 0)
            page = codecs.mask_words(head, at) + body
            page += bytes(-len(page) % 32)
            pages.append((len(pages) + 1, page))
            refs.append((len(pages), len(body), start))
            at += len(page)
        described.append((name, len(data), 2 if len(data) >= 4 else 1, number, refs))

    def system(kind: int, data: bytes) -> bytes:
        packed = codecs.lz77_compress(data)
        page = struct.pack("<5I", kind, len(data), len(packed), 2, codecs.page_checksum(packed)) + packed
        return page + bytes(-len(page) % 32)

    info = struct.pack("<5I", len(described), 2, page_size, 0, len(described))
    for name, size, packed, number, refs in described:
        info += struct.pack("<Q6I", size, len(refs), page_size, 1, packed, number, 0) + name.encode()[:63].ljust(64, b"\0")
        info += b"".join(struct.pack("<IIQ", *r) for r in refs)
    section_page = system(SECTION_MAP, info)
    map_id, info_id = len(pages) + 2, len(pages) + 1
    entries = b"".join(struct.pack("<iI", n, len(p)) for n, p in pages) + struct.pack("<iI", info_id, len(section_page))
    map_page = system(PAGE_MAP, entries + struct.pack("<iI", map_id, 0))
    map_page = system(PAGE_MAP, entries + struct.pack("<iI", map_id, len(map_page)))
    body = b"".join(p for _, p in pages) + section_page
    block = bytearray(0x6C)
    block[: len(FILE_ID)] = FILE_ID
    for where, value, n in ((0x28, map_id, 4), (0x2C, FIRST_PAGE + len(body) + len(map_page), 8), (0x40, len(pages) + 2, 4), (0x50, map_id, 4), (0x54, len(body), 8), (0x5C, info_id, 4), (0x60, len(pages) + 2, 4)):
        block[where : where + n] = value.to_bytes(n, "little")
    block[0x68:] = codecs.crc32(bytes(block[:0x68]) + bytes(4)).to_bytes(4, "little")
    head = bytearray(FIRST_PAGE)
    head[:6] = magic.encode()
    head[0x0B] = maint_version
    head[0x13:0x15] = codepage.to_bytes(2, "little")
    head[0x80:0xEC] = codecs.xor(bytes(block), codecs.magic())
    sizes = [(n, len(p)) for n, p in pages] + [(info_id, len(section_page)), (map_id, len(map_page))]
    starts = [FIRST_PAGE + sum(n for _, n in sizes[:i]) for i in range(len(sizes))]
    refs_of = [(name, *r) for name, _, _, _, refs in described for r in refs]
    by_number = {n: s for (n, _), s in zip(sizes, starts)}
    places = {
        "pages": [(i, n, size, start, False) for i, ((n, size), start) in enumerate(zip(sizes, starts))],
        "section_pages": refs_of,
        "first": {name: by_number[refs[0][0]] if refs else 0 for name, _, _, _, refs in described},
        "page_map": starts[-1],
        "first_number": described[0][3] if described else 0,
        "first_size": refs_of[0][2] if refs_of else 0,
    }
    return bytes(head) + body + map_page, places
