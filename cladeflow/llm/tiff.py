"""TIFF media columns: one row per page, decoded; and a lossless text-to-TIFF writer.

The reader walks the image directories of classic TIFF (both byte orders), decodes
strips or tiles stored plain, as PackBits, LZW or deflate, undoes the horizontal
predictor and yields the 8-bit samples of each page in row order.

Defined results: a null or empty media value gives no row; a value that is not a TIFF,
is cut short, is damaged or uses an unsupported feature gives the pages before the fault
and one row with null samples and ``error`` set, so that one bad row never fails a job. A
page's size is held against what its strips can unpack to, and against ``PAGE_BYTES``,
before memory is taken. Repeated rows give repeated rows, null ids are kept, empty tables
give empty ones; columns other than those named play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_FORMATS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}

ROW_BYTES = 192  # 64 pixels of 3 samples
PAGE_BYTES = 1 << 30  # of the largest page that is unpacked
RATIO = {NONE: 1, PACKBITS: 64, LZW: 2731, DEFLATE: 1032, OLD_DEFLATE: 1032}  # most bytes that one stored byte can unpack to


class TiffError(ValueError):
    """The bytes are no TIFF this reader knows."""


# ---------------------------------------------------------------- codecs


def packbits_encode(data: bytes) -> bytes:
    out = bytearray()
    arr = np.frombuffer(data, np.uint8)
    n = len(arr)
    if not n:
        return b""
    starts = np.flatnonzero(np.concatenate(([True], arr[1:] != arr[:-1])))
    lengths = np.diff(np.append(starts, n))
    at = 0

    def literal(lo: int, hi: int) -> None:
        for p in range(lo, hi, 128):
            part = data[p : min(p + 128, hi)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, k in zip(starts[lengths >= 3].tolist(), lengths[lengths >= 3].tolist(), strict=True):
        literal(at, s)
        for p in range(0, k, 128):
            m = min(128, k - p)
            if m == 1:
                out += bytes((0, data[s]))
            else:
                out += bytes((257 - m, data[s]))
        at = s + k
    literal(at, n)
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    parts, at, have, n = [], 0, 0, len(data)
    while have < size and at < n:
        c = data[at]
        if c < 128:
            part = data[at + 1 : at + 2 + c]
            at += 2 + c
        elif c > 128:
            part = data[at + 1 : at + 2] * (257 - c)
            at += 2
        else:
            part, at = b"", at + 1
        parts.append(part)
        have += len(part)
    return b"".join(parts)


def lzw_encode(data: bytes) -> bytes:
    """MSB-first codes of 9 to 12 bits; the width grows one code early, as TIFF asks."""
    acc = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    codes: dict[int, int] = {}  # (code of a string) * 256 + next byte: the longer string's code
    put(256, 9)
    width, following, prefix = 9, 258, -1
    for c in data:
        if prefix < 0:
            prefix = c
            continue
        longer = codes.get(prefix << 8 | c)
        if longer is not None:
            prefix = longer
            continue
        acc, bits = acc << width | prefix, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1
        codes[prefix << 8 | c] = following
        following += 1
        if following == 4094:
            put(256, width)
            codes = {}
            width, following = 9, 258
        elif following >= 1 << width and width < 12:
            width += 1
        prefix = c
    if prefix >= 0:
        put(prefix, width)
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    entries, width, last = list(first), 9, b""
    parts, have = [], 0
    acc = bits = at = 0
    n = len(data)
    while have < size:
        while bits < width:
            if at >= n:
                return b"".join(parts)
            acc, bits, at = acc << 8 | data[at], bits + 8, at + 1
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            entries, width, last = list(first), 9, b""
            continue
        if not last:
            if code > 255:
                raise TiffError("LZW: bad first code")
            part = entries[code]
        else:
            if code < len(entries):
                part = entries[code]
            elif code == len(entries):
                part = last + last[:1]
            else:
                raise TiffError("LZW: code out of range")
            entries.append(last + part[:1])
            if len(entries) >= (1 << width) - 1 and width < 12:
                width += 1
        parts.append(part)
        have += len(part)
        last = part
    return b"".join(parts)


def decode_block(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    else:
        raise TiffError(f"compression {compression}")
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out[:size]


# ---------------------------------------------------------------- reader


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        p = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", data, p)
        form = TYPE_FORMATS.get(kind)
        if form is None or not count:
            continue  # of no known kind, or without a value: as if it were not there
        size = struct.calcsize(order + form) * count
        where = p + 8 if size <= 4 else struct.unpack_from(order + "I", data, p + 8)[0]
        if where + size > len(data):
            raise TiffError("a tag's values lie outside the file")
        tags[tag] = struct.unpack_from(f"{order}{count}{form}", data, where)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _page(data: bytes, tags: dict[int, tuple]) -> tuple[int, int, int, int, bytes]:
    one = lambda t, d: tags.get(t, (d,))[0]
    if WIDTH not in tags or HEIGHT not in tags:
        raise TiffError("no image size")
    w, h, spp = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    if any(b != 8 for b in tags.get(BITS, (1,))):
        raise TiffError("samples are not of 8 bits")
    if one(PLANAR, 1) != 1 and spp > 1:
        raise TiffError("planes are stored apart")
    compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor}")
    tiled = TILE_OFFSETS in tags
    tw, tl = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (w, min(h, one(ROWS_PER_STRIP, h)))
    if min(w, h, spp, tw, tl) < 1:
        raise TiffError("an image without size or samples")
    if compression not in RATIO:
        raise TiffError(f"compression {compression}")
    offsets, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ())
    across, down = -(-w // tw), -(-h // tl)
    if len(offsets) < across * down or len(counts) < across * down:
        raise TiffError("strips or tiles are missing")
    stored = sum(counts[: across * down])
    if min(offsets) < 0 or min(counts) < 0 or stored > len(data) * 16:
        raise TiffError("strips or tiles of impossible sizes")
    unpacked = across * tw * spp * (down * tl if tiled else h)
    if unpacked > min(PAGE_BYTES, RATIO[compression] * (stored + 64)):
        raise TiffError("a page larger than its strips or tiles can hold")
    image = np.empty((h, w * spp), np.uint8)
    for k in range(across * down):
        y, x = k // across * tl, k % across * tw
        rows = tl if tiled else min(tl, h - y)
        if offsets[k] + counts[k] > len(data):
            raise TiffError("a strip or tile lies outside the file")
        block = np.frombuffer(decode_block(data[offsets[k] : offsets[k] + counts[k]], compression, rows * tw * spp), np.uint8).reshape(rows, tw, spp)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        part = block[: h - y, : w - x]
        image[y : y + len(part), x * spp : (x + part.shape[1]) * spp] = part.reshape(len(part), -1)
    return w, h, spp, compression, image.tobytes()


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(width, height, samples, compression, bytes) of each page, in file order."""
    try:
        order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            raise TiffError("no TIFF")
        seen = set()
        while at:
            if at in seen:
                raise TiffError("the directories form a loop")
            seen.add(at)
            tags, at = _directory(data, at, order)
            yield _page(data, tags)
    except TiffError:
        raise
    except (KeyError, IndexError, ValueError, OverflowError, MemoryError, struct.error) as e:
        raise TiffError(f"not readable: {e}") from e


# ---------------------------------------------------------------- writer


def write_tiff(pages: list[np.ndarray], compression: int, *, predictor: bool = False, tile: int = 0, rows_per_strip: int = 64, order: str = "<") -> bytes:
    """A TIFF of RGB pages, each an array (height, width, 3) of bytes; lossless."""
    code = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}[compression]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in pages:
        h, w, spp = image.shape
        if tile:
            grid = [(y, x, tile, tile) for y in range(0, h, tile) for x in range(0, w, tile)]
        else:
            grid = [(y, 0, min(rows_per_strip, h - y), w) for y in range(0, h, rows_per_strip)]
        offsets, counts = [], []
        for y, x, bh, bw in grid:
            part = image[y : y + bh, x : x + bw]
            if part.shape[:2] != (bh, bw):
                part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1]), (0, 0)))
            if predictor:
                part = np.diff(part, axis=1, prepend=np.zeros((bh, 1, spp), np.uint8))
            block = code(np.ascontiguousarray(part).tobytes())
            offsets.append(len(out))
            counts.append(len(block))
            out += block
        tags = [(WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [8] * spp), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [2]), (SAMPLES, "H", [spp])]
        if tile:
            tags += [(TILE_WIDTH, "I", [tile]), (TILE_LENGTH, "I", [tile]), (TILE_OFFSETS, "I", offsets), (TILE_COUNTS, "I", counts)]
        else:
            tags += [(STRIP_OFFSETS, "I", offsets), (ROWS_PER_STRIP, "I", [rows_per_strip]), (STRIP_COUNTS, "I", counts)]
        tags.append((PLANAR, "H", [1]))
        if predictor:
            tags.append((PREDICTOR, "H", [2]))
        entries = []
        for tag, form, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{form}", *values)
            if len(raw) > 4:
                out += bytes(len(out) % 2)
                where = len(out)
                out += raw
                raw = struct.pack(order + "I", where)
            entries.append(struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[form], len(values)) + raw.ljust(4, b"\0"))
        out += bytes(len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def text_to_tiff(data: bytes, page_rows: int = 4096) -> tuple[bytes, int]:
    """(TIFF, length of the padded payload) of a text's bytes.

    Blanks fill the payload up to a positive multiple of 192 bytes: rows of 64 RGB
    pixels, at most ``page_rows`` a page. The storage form follows from the payload's
    CRC alone, so equal texts have equal files: of 8 parts 3 are deflated strips with
    predictor, 2 deflated tiles, 2 PackBits strips and 1 LZW strips with predictor, of
    either byte order.
    """
    size = max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES
    payload = data + b" " * (size - len(data))
    image = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    pages = [image[i : i + page_rows] for i in range(0, len(image), page_rows)]
    form = zlib.crc32(payload) % 16
    order = "<>"[form // 8]
    if form % 8 < 3:
        return write_tiff(pages, DEFLATE, predictor=True, order=order), size
    if form % 8 < 5:
        return write_tiff(pages, DEFLATE, tile=32, order=order), size
    if form % 8 < 7:
        return write_tiff(pages, PACKBITS, order=order), size
    return write_tiff(pages, LZW, predictor=True, order=order), size


# ---------------------------------------------------------------- Spark


PAGES = "page int, width int, height int, samples int, compression int, data binary, error string"


def media_pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of a binary TIFF column: the id and the columns of ``PAGES``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, media in zip(b["id"], b["media"], strict=True):
                media = media.as_py()
                if not media:
                    continue
                out, error = [], None
                try:
                    out.extend(read_pages(media))
                except TiffError as e:
                    error = str(e)
                n = len(out) + bool(error)
                cols = [pa.array([i.as_py()] * n, b.schema.field("id").type), pa.array(range(n), pa.int32())]
                pad = [None] * bool(error)
                cols += [pa.array([p[k] for p in out] + pad, pa.int32()) for k in range(4)]
                cols += [pa.array([p[4] for p in out] + pad, pa.binary()), pa.array([None] * len(out) + [error] * bool(error), pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "page", "width", "height", "samples", "compression", "data", "error"])

    return rows.mapInArrow(run, f"id {kind}, {PAGES}").withColumnRenamed("id", id_col)


def shade(samples: np.ndarray) -> str:
    """A 64-bit average hash of the samples as 16 hexadecimal digits."""
    cut = np.linspace(0, len(samples), 65).astype(int)
    sums = np.concatenate(([0], np.cumsum(samples, dtype=np.int64)))
    means = (sums[cut[1:]] - sums[cut[:-1]]) / np.maximum(1, cut[1:] - cut[:-1])
    bits = means > samples.mean()
    return np.packbits(bits).tobytes().hex()


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int, form string"
FORMS = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits"}


def text_media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a TIFF, read the stored bytes back, and describe both.

    A null text counts as empty; its payload is 192 blanks. Bytes count as they are, UTF-8 or not. One row per input row, whatever
    its id; other columns play no part, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                data = text.as_py() or b""
                media, size = text_to_tiff(data)
                pages = list(read_pages(media))
                back = b"".join(p[4] for p in pages)
                out.append((i, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), shade(np.frombuffer(back, np.uint8)), len(pages), FORMS[pages[0][3]]))
                if len(back) != size:
                    raise TiffError("the payload did not come back")
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return rows.mapInArrow(run, DIGEST)
