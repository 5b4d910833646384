"""TIFF media columns: walk image directories, decode strips and tiles, undo predictors.

`decode_pages` emits one row per page (image directory). Uncompressed, PackBits,
LZW and deflate data are read, in strips or tiles, either byte order, 1, 2, 4, 8,
16 or 32 bits a sample, chunky or planar, with horizontal or floating-point predictors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import sha, slices

# Fixed values of the TIFF 6.0 format: tags, and field types with their sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
SAMPLE_CODE = {1: "u", 2: "i", 3: "f"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: A page whose samples would need more bytes is an error row instead of an allocation.
MAX_PAGE_BYTES = 512 << 20


class TiffError(ValueError):
    """The bytes aren't a TIFF file that can be read."""


def directories(raw: bytes) -> Iterator[dict[int, tuple]]:
    """Every image directory in file order, as {tag: values}; a loop in the chain ends it, a truncated one raises TiffError."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", raw, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", raw, at)
            tags: dict[int, tuple] = {-1: (order,)}
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
                if kind not in TYPE_CODE:
                    continue
                size = TYPE_SIZE[kind] * count
                where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * k)[0]
                if where + size > len(raw):
                    raise TiffError(f"truncated: tag {tag}")
                tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", raw, where)
            (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)
        except struct.error as e:
            raise TiffError(f"truncated: {e}") from e
        yield tags


def unpackbits(data: bytes, size: int) -> bytes:
    """PackBits: a count byte n copies n+1 bytes, or repeats the next byte 257-n times; 128 is skipped."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def packbits(data: bytes) -> bytes:
    """Runs of three or more are packed; the rest is copied in pieces of at most 128."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.flatnonzero(np.diff(a, prepend=int(a[0]) ^ 1))
    size = np.diff(np.append(starts, len(a)))
    long = size >= 3
    out, plain = bytearray(), 0

    def copy(lo: int, hi: int) -> None:
        for i in range(lo, hi, 128):
            part = data[i : min(hi, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, n in zip(starts[long].tolist(), size[long].tolist(), strict=True):
        copy(plain, s)
        e = s + n
        while e - s >= 2:
            n = min(128, e - s)
            out += bytes((257 - n, data[s]))
            s += n
        plain = s
    copy(plain, len(a))
    return bytes(out)


def _widths(first: int, n: int) -> np.ndarray:
    """Bits of the codes first, first+1, ... after a clear code: the table has 258 entries and grows from the second code on; codes widen one entry early."""
    size = 258 + np.maximum(np.arange(first, first + n) - 1, 0)
    return 9 + np.searchsorted((511, 1023, 2047), size, "right")


def _codes(raw: np.ndarray, n_bits: int, at: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to n codes from bit `at` on, the first one being number `first` after a clear code; and the bit after each."""
    width = _widths(first, n)
    ends = at + np.cumsum(width)
    whole = int(np.searchsorted(ends, n_bits, "right"))
    width, ends = width[:whole], ends[:whole]
    byte, bit = (ends - width) >> 3, (ends - width) & 7
    word = raw[byte] << 24 | raw[byte + 1] << 16 | raw[byte + 2] << 8 | raw[byte + 3]
    return word >> (32 - width - bit) & ((1 << width) - 1), ends


def unlzw(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes from 9 to 12 bits, high bit first, widened one code early; 256 clears, 257 ends."""
    raw, n_bits = np.frombuffer(data + b"\0" * 4, np.uint8).astype(np.int64), 8 * len(data)
    head, ends = _codes(raw, n_bits, 0, 0, 1)
    if not len(head) or head[0] == 257 or not size:
        return b""
    if head[0] != 256:
        raise TiffError("LZW data don't begin with a clear code")
    at, seen, out, total = int(ends[0]), 0, [], 0
    plain = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, prev = list(plain), b""
    while total < size:
        codes, ends = _codes(raw, n_bits, at, seen, 4096)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        use = int(stop[0]) if len(stop) else len(codes)
        for code in codes[:use].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and prev:
                entry = prev + prev[:1]
            else:
                raise TiffError("LZW code out of range")
            out.append(entry)
            total += len(entry)
            if prev:
                table.append(prev + entry[:1])
            prev = entry
            if total >= size:
                break
        if not len(codes) or (len(stop) and codes[use] == 257):
            break
        at, seen = int(ends[use if len(stop) else use - 1]), seen + use
        if len(stop):
            table, prev, seen = list(plain), b"", 0
    return b"".join(out)[:size]


def lzw(data: bytes) -> bytes:
    """The other way: words of the table are keyed by (code of the word less its last byte, that byte)."""
    parts, run, table, free = [], [], {}, 258

    def close() -> None:
        """The run's codes, and the clear or end code after them, as bits."""
        width = _widths(0, len(run))
        code = np.array(run, np.int64)
        shift = np.arange(11, -1, -1)
        bits = (code[:, None] >> shift & 1).astype(np.uint8)
        parts.append(bits[shift[None] < width[:, None]])

    parts.append(np.array([1, 0, 0, 0, 0, 0, 0, 0, 0], np.uint8))
    word = data[0] if data else -1
    for byte in data[1:]:
        key = word << 8 | byte
        longer = table.get(key)
        if longer is not None:
            word = longer
            continue
        run.append(word)
        table[key] = free
        free += 1
        if free == 4094:
            run.append(256)
            close()
            run, table, free = [], {}, 258
        word = byte
    if word >= 0:
        run.append(word)
    run.append(257)
    close()
    return np.packbits(np.concatenate(parts)).tobytes()


def _unpack(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data[:size]
    if how in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    if how == LZW:
        return unlzw(data, size)
    if how == PACKBITS:
        return unpackbits(data, size)
    raise TiffError(f"compression {how}")


def _block(raw: bytes, how: int, rows: int, cols: int, spp: int, bits: int, kind: int, order: str, predictor: int) -> tuple[np.ndarray, int]:
    """One strip or tile as rows x cols x spp samples, and how many bytes it lacks (zeros stand in for them)."""
    stride = (cols * spp * bits + 7) // 8
    data = _unpack(raw, how, rows * stride)
    short = rows * stride - len(data)
    if short:
        data += b"\0" * short
    a = np.frombuffer(data, np.uint8).reshape(rows, stride)
    if bits < 8:
        a = np.unpackbits(a, axis=1)[:, : cols * spp * bits].reshape(rows, cols * spp, bits)
        return (a @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8).reshape(rows, cols, spp), short
    size = bits // 8
    if predictor == 3:
        planes = np.cumsum(a.reshape(rows, -1, spp), axis=1, dtype=np.uint8).reshape(rows, size, cols * spp)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, cols, spp), short
    code = SAMPLE_CODE[kind]
    a = np.ascontiguousarray(a).view(f"{order}{code}{size}").reshape(rows, cols, spp)
    if predictor == 2:
        whole = a.astype(f"=u{size}") if code != "f" else a.view(f"{order}u{size}").astype(f"=u{size}")
        a = np.cumsum(whole, axis=1, dtype=whole.dtype)
        a = a if code == "u" else a.view(f"=i{size}" if code == "i" else f"=f{size}")
    return a, short


def pixels(raw: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """The samples of one page, height x width x samples."""
    return _page(raw, tags)[0]


def _page(raw: bytes, tags: dict[int, tuple]) -> tuple[np.ndarray, str | None]:
    """The samples of one page and, if strips or tiles are cut short (the rest is 0), which."""
    one = lambda tag, other: (tags.get(tag) or (other,))[0]
    w, h, spp = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, kind, how, predictor = one(BITS, 1), one(SAMPLE_FORMAT, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    planes, order = (spp if one(PLANAR, 1) == 2 else 1), tags[-1][0]
    if min(w, h, spp) < 1:
        raise TiffError(f"no pixels: {w} x {h} x {spp}")
    kind = 1 if kind == 4 else kind
    if bits not in (1, 2, 4, 8, 16, 32) or kind not in SAMPLE_CODE or (kind == 3 and bits < 16) or (kind == 2 and bits < 8) or len(set(tags.get(BITS) or (1,))) > 1 or len(set(tags.get(SAMPLE_FORMAT) or (1,))) > 1:
        raise TiffError(f"samples of {tags.get(BITS)} bits in format {kind}")
    if predictor not in (1, 2, 3) or (predictor == 2 and bits < 8) or (predictor == 3 and kind != 3):
        raise TiffError(f"predictor {predictor} on {bits} bits in format {kind}")
    if w * h * spp * max(1, bits // 8) > MAX_PAGE_BYTES:
        raise TiffError(f"page of {w} x {h} x {spp} samples is larger than {MAX_PAGE_BYTES} bytes")
    per = 1 if planes > 1 else spp
    tiled = TILE_OFFSETS in tags
    if tiled:
        bw, bh, offsets, counts = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), tags[TILE_OFFSETS], tags.get(TILE_COUNTS, ())
    else:
        bw, bh, offsets, counts = w, min(one(ROWS_PER_STRIP, h), h) or 1, tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ())
    if min(bw, bh) < 1 or bw * bh * per * max(1, bits // 8) > MAX_PAGE_BYTES:
        raise TiffError(f"blocks of {bw} x {bh}")
    across, down = (w + bw - 1) // bw, (h + bh - 1) // bh
    if len(offsets) < across * down * planes or len(counts) < across * down * planes:
        raise TiffError("strips or tiles are missing")
    out = np.zeros((h, w, spp), np.uint8 if bits <= 8 and kind == 1 else np.dtype(f"{SAMPLE_CODE[kind]}{bits // 8}"))
    faults = []
    for k in range(across * down * planes):
        p, at = divmod(k, across * down)
        y, x = at // across * bh, at % across * bw
        rows = bh if tiled else min(bh, h - y)
        b, short = _block(raw[offsets[k] : offsets[k] + counts[k]], how, rows, bw, per, bits, kind, order, predictor)
        if short:
            faults.append(f"{'tile' if tiled else 'strip'} {k} lacks {short} bytes")
        b = b[: h - y, : w - x]
        out[y : y + b.shape[0], x : x + b.shape[1], p : p + per if planes > 1 else spp] = b
    return out, "; ".join(faults[:5]) or None


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """Greyscale or RGB pages of unsigned samples, one image directory each, in strips or tiles."""
    pack = {NONE: bytes, LZW: lzw, PACKBITS: packbits, DEFLATE: lambda d: zlib.compress(d, 1), OLD_DEFLATE: lambda d: zlib.compress(d, 1)}[compression]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    for n, page in enumerate(pages):
        a = page if page.ndim == 3 else page[:, :, None]
        h, w, spp = a.shape
        bh, bw = tile or (min(rows_per_strip, h), w)
        blocks = []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                b = a[y : y + bh, x : x + bw]
                if tile:
                    b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
                blocks.append(pack(b.astype(b.dtype.newbyteorder(order)).tobytes()))
        fields = {WIDTH: (4, (w,)), HEIGHT: (4, (h,)), BITS: (3, (a.dtype.itemsize * 8,) * spp), COMPRESSION: (3, (compression,)), PHOTOMETRIC: (3, (1 if spp == 1 else 2,)), SAMPLES: (3, (spp,)), PREDICTOR: (3, (predictor,))}
        where, sizes = (TILE_OFFSETS, TILE_COUNTS) if tile else (STRIP_OFFSETS, STRIP_COUNTS)
        fields |= {TILE_WIDTH: (4, (bw,)), TILE_HEIGHT: (4, (bh,))} if tile else {ROWS_PER_STRIP: (4, (bh,))}
        fields |= {where: (4, (0,) * len(blocks)), sizes: (4, tuple(map(len, blocks)))}
        head = 2 + 12 * len(fields) + 4
        extra = sum((TYPE_SIZE[k] * len(v) + 1) & ~1 for k, v in fields.values() if TYPE_SIZE[k] * len(v) > 4)
        at = len(out)
        first = at + head + extra
        fields[where] = (4, tuple(first + int(x) for x in np.cumsum([0, *map(len, blocks)])[:-1]))
        end = first + sum(map(len, blocks))
        end += end & 1
        body, tail = struct.pack(order + "H", len(fields)), b""
        for tag in sorted(fields):
            kind, values = fields[tag]
            data = struct.pack(f"{order}{len(values)}{TYPE_CODE[kind]}", *values)
            body += struct.pack(order + "HHI", tag, kind, len(values))
            if len(data) <= 4:
                body += data.ljust(4, b"\0")
            else:
                body += struct.pack(order + "I", at + head + len(tail))
                tail += data + b"\0" * (len(data) & 1)
        out += body + struct.pack(order + "I", end if n + 1 < len(pages) else 0) + tail + b"".join(blocks)
        out += b"\0" * (len(out) & 1)
    return bytes(out)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, tiled boolean, pixels binary, error string"


def decode_pages(files: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of every file: its geometry and its samples as native-endian bytes.

    A null, empty or unreadable file gives one row with page null and the reason in
    `error`; an unreadable page gives a row of its own without pixels, and a page
    with truncated strips or tiles has zeros there and says so in `error`; a chain of
    directories that breaks off ends in a row with page null. Repeated rows each
    give their pages. `keep` names further columns to carry along; they may not be
    called like the columns made here. A file is read whole; its pages leave one at a time.
    """
    kept = [id_col, *keep]
    types = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)

    kinds = (pa.int32(),) * 6 + (pa.bool_(), pa.binary(), pa.string())
    names = [*kept, "page", "width", "height", "samples", "bits", "compression", "tiled", "pixels", "error"]

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column("mg_media"), 1 << 20):
                part = b.slice(lo, hi - lo)
                rows, index, held = [], [], 0

                def batch(part=part):
                    take = pa.array(index, pa.int64())
                    return pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in range(len(kept))), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=names)

                for i, raw in enumerate(part.column("mg_media").to_pylist()):
                    for row in read_pages(raw):
                        rows.append(row)
                        index.append(i)
                        held += len(row[7] or b"")
                        if held > 4 << 20:
                            yield batch()
                            rows, index, held = [], [], 0
                yield batch()

    return files.select(*kept, F.col(media_col).alias("mg_media")).mapInArrow(run, f"{types}, {PAGE_SCHEMA}")


def read_pages(raw: bytes | None) -> Iterator[tuple]:
    """The rows of one file; whatever its bytes are, it ends."""
    none = (None,) * 8
    if raw is None:
        yield (*none, "null")
        return
    n = -1
    try:
        for n, tags in enumerate(directories(raw)):
            try:
                a, fault = _page(raw, tags)
                yield (n, a.shape[1], a.shape[0], a.shape[2], (tags.get(BITS) or (1,))[0], (tags.get(COMPRESSION) or (1,))[0], TILE_OFFSETS in tags, a.astype(a.dtype.newbyteorder("=")).tobytes(), fault)
            except (TiffError, ArithmeticError, LookupError, MemoryError, TypeError, ValueError, struct.error) as e:
                yield (n, None, None, None, None, None, None, None, str(e) or type(e).__name__)
    except TiffError as e:
        yield (*none, str(e))
        return
    if n < 0:
        yield (*none, "no page")


#: How the query stores a text, by a hash of it: every compression in strips and tiles, with and without predictor.
LAYOUTS = [(how, predictor, tile) for how in (PACKBITS, LZW, DEFLATE) for predictor in (1, 2) for tile in (None, (16, 64))]


def texts_as_tiff(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 64) -> DataFrame:
    """Each text's UTF-8 bytes (null: none), padded with zeros to a positive multiple of `width`, as a one-page 8-bit TIFF.

    Compression, predictor and strips or tiles follow the padded bytes' CRC-32 (LAYOUTS), so equal texts make equal files.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column("mg_text"), 1 << 20):
                part = b.slice(lo, hi - lo)
                sizes, media = [], []
                for t in part.column("mg_text").cast(pa.binary()).to_pylist():
                    t = t or b""
                    sizes.append(len(t))
                    t = t.ljust(max(1, -(-len(t) // width)) * width, b"\0")
                    how, predictor, tile = LAYOUTS[zlib.crc32(t) % len(LAYOUTS)]
                    media.append(write_tiff([np.frombuffer(t, np.uint8).reshape(-1, width)], how, predictor, tile=tile))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col), F.col(text_col).alias("mg_text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as TIFF, decode the stored file to pages and digest what was read back.

    One row per row of documents, whatever its id; a null or empty text is 64 zero bytes. Equal texts
    have equal values. Other columns aren't read, so their names don't matter; an empty table gives no row.
    """
    import binascii

    stored = texts_as_tiff(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = decode_pages(stored, keep=("n_bytes", "media"))

    def digest(batches):
        for b in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in slices(whole.column("pixels"), 1 << 20)):
            rows = []
            for px, media, w, h in zip(*(b.column(c).to_pylist() for c in ("pixels", "media", "width", "height")), strict=True):
                a = np.frombuffer(px, np.uint8)
                hist = np.bincount(a, minlength=256)
                p = hist[hist > 0] / len(a)
                feature = f"{w}x{h};mean={a.mean():.6f};entropy={-(p * np.log2(p)).sum():.6f};levels={len(p)}"
                rows.append((len(px), hashlib.sha256(px).hexdigest(), binascii.crc32(px[-64:]), len(media), sha(media), feature))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return pages.mapInArrow(digest, schema)
