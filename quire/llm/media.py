"""Media columns: baseline JPEG files parsed, Huffman-decoded and reduced to DC-only luminance thumbnails
in numpy; dimensions and thumbnail hashes are stored.

`decode` reads any baseline (SOF0) file with Huffman tables, sampling factors and restart intervals of its own
and gives the quantised coefficients of every block. All restart intervals are decoded side by side: one step
looks up 16 bits of each interval in the tables, so that a step costs a few numpy calls whatever their number;
`decoded` does so for many files of equal tables at once.

`encode_payloads` stores bytes losslessly as such coefficients, 64 bytes a block: byte k of a block less 128 is
AC coefficient k for k > 0, and DC is the first byte less 128 plus a sixteenth of the sum of the others (rounded
down), which keeps DC a measure of all 64 bytes and can be undone. DC differences, zero runs and sizes are
Huffman-coded as in any such file; the tables come from Huffman's rule over fixed weights, so that all files
share them. RESTART blocks make a restart interval. Blocks beyond the payload hold zeros.

Nulls and empty texts give a payload of 64 zero bytes. Every row is computed from its own text alone, so repeated
rows agree and an empty table gives no row. Rows are taken in groups of about GROUP bytes; memory is bounded by
that and by the longest text, which is read whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import batched, frugal, text_or_empty

RESTART, GROUP = 4, 1 << 20
DC_SIZES, AC_SIZES = 12, 8
#: JPEG markers.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM, RST0, APP0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE, 0xD0, 0xE0


def zigzag() -> np.ndarray:
    """Natural index of each zigzag position, from the rule of the walk along antidiagonals."""
    cells = sorted(((r + c, (r if (r + c) % 2 else c), r * 8 + c) for r in range(8) for c in range(8)))
    return np.array([x[2] for x in cells])


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


class Huffman:
    """Canonical codes of a DHT table: for each length their number, and the symbols in order."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = counts, symbols

    def listed(self) -> list[tuple[int, int, int]]:
        """(symbol, code, length)."""
        out, code, at = [], 0, 0
        for n, many in enumerate(self.counts, 1):
            for s in self.symbols[at : at + many]:
                out.append((s, code, n))
                code += 1
            at += many
            code <<= 1
        return out

    @lru_cache(16)  # noqa: B019
    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """For each 16 bits the symbol they begin with and its code's length (0: no such code)."""
        symbol, size = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        for s, code, n in self.listed():
            here = slice(code << (16 - n), (code + 1) << (16 - n))
            symbol[here], size[here] = s, n
        return symbol, size

    @lru_cache(16)  # noqa: B019
    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """The code of each symbol and its length."""
        out, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s, code, n in self.listed():
            out[s], size[s] = code, n
        return out, size

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Huffman) and (self.counts, self.symbols) == (other.counts, other.symbols)

    def __hash__(self) -> int:
        return hash((self.counts, self.symbols))


def huffman(weights: dict[int, float]) -> Huffman:
    """Huffman's code for the weights. A symbol of least weight is added and its code, all ones, left out, as the
    format wants."""
    heap = [(w, i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))]
    heap.append((0.0, len(heap), (-1,)))
    heapq.heapify(heap)
    depth, turn = dict.fromkeys([*weights, -1], 0), len(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*x, *y):
            depth[s] += 1
        heapq.heappush(heap, (a + b, turn, (*x, *y)))
        turn += 1
    if max(depth.values()) > 16:
        raise ValueError("weights too far apart for codes of 16 bits")
    depth.pop(-1)
    order = sorted(depth, key=lambda s: (depth[s], -weights[s], s))
    return Huffman(bytes(sum(d == n for d in depth.values()) for n in range(1, 17)), bytes(order))


@lru_cache(1)
def tables() -> tuple[Huffman, Huffman]:
    """The DC and AC tables of stored payloads, from a rule: sizes near 5 (letters) are likeliest, and each zero
    before a coefficient makes it a sixteenth as likely, down to a floor."""
    dc = {s: 2.0 ** -abs(s - 6) for s in range(DC_SIZES)}
    ac = {r << 4 | s: 2.0 ** -abs(s - 5) * max(16.0**-r, 2.0**-8) for r in range(16) for s in range(1, AC_SIZES + 1)}
    return huffman(dc), huffman(ac | {0x00: 2.0**-6, 0xF0: 2.0**-8})


def _coded(blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks' Huffman codes as bytes, unstuffed, a restart interval after another, and the intervals' sizes.
    first: whether a block begins an interval."""
    (dc_code, dc_len), (ac_code, ac_len) = (t.codes() for t in tables())
    size_of = np.frexp(np.arange(4096))[1].astype(np.int32)  # bits of a magnitude
    bits = lambda v, n: v + ((v < 0) * ((1 << n) - 1))
    diff = blocks[:, 0] - np.where(first, 0, np.concatenate([[0], blocks[:-1, 0]])).astype(np.int32)
    size = size_of[np.abs(diff)]
    flat = blocks.reshape(-1)
    there = flat != 0
    there[::64] = False
    at = np.flatnonzero(there)
    value, k, b = flat[at], (at & 63).astype(np.int32), at >> 6
    last = np.empty_like(k)
    last[1:] = k[:-1]
    heads = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])[: len(b)])
    last[heads] = 0
    run, n = k - last - 1, size_of[np.abs(value)]
    symbol = (run & 15) << 4 | n
    times = run >> 4
    end = np.zeros(len(blocks), np.int32)
    end[b] = k  # the last one stays
    open_ = (end < 63).astype(np.int64)
    # Items in order: a block's DC value, each coefficient with the runs of sixteen zeros before it, the block's end.
    before = np.cumsum(open_) - open_
    place = np.arange(len(at)) + b + 1 + before[b]
    far = np.flatnonzero(times)
    if len(far):
        place += np.cumsum(times)
        zeros = np.bincount(b[far], times[far], len(blocks)).astype(np.int64)
    else:
        zeros = np.zeros(len(blocks), np.int64)
    items = 1 + np.bincount(b, minlength=len(blocks)) + zeros + open_
    stop = np.cumsum(items)
    total = int(stop[-1])
    code, length = np.full(total, ac_code[0xF0], np.int64), np.full(total, ac_len[0xF0], np.int64)
    code[place], length[place] = ac_code[symbol] << n | bits(value, n), ac_len[symbol] + n
    code[stop - items], length[stop - items] = dc_code[size] << size | bits(diff, size), dc_len[size] + size
    shut = np.flatnonzero(open_)
    code[stop[shut] - 1], length[stop[shut] - 1] = ac_code[0], ac_len[0]
    # Each interval begins at a byte; what is left of its last byte are ones.
    ends = np.cumsum(length)
    tops = np.flatnonzero(first)
    per = stop[np.append(tops[1:], len(blocks)) - 1]  # items up to each interval's end
    upto = ends[per - 1]
    used = np.diff(upto, prepend=0)
    held = -(-used // 8)
    shift = (np.cumsum(held) - held) * 8 - (upto - used)
    at = ends - length + np.repeat(shift, np.diff(per, prepend=0))
    # In words of 32 bits an item lies in one or two.
    shifted = code << (64 - (at & 31) - length)
    word, n_words = at >> 5, int(held.sum()) // 4 + 2
    out = np.bincount(word, (shifted >> 32) & 0xFFFFFFFF, n_words) + np.bincount(word + 1, shifted & 0xFFFFFFFF, n_words + 1)[:n_words]
    coded = out.astype(np.uint32).astype(">u4").view(np.uint8)[: int(held.sum())].copy()
    coded[np.cumsum(held) - 1] |= ((1 << (held * 8 - used)) - 1).astype(np.uint8)
    return coded, held


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Greyscale baseline JPEG files that hold payloads, whose lengths are positive multiples of 64."""
    if not payloads:
        return []
    shapes, parts, first = [], [], []
    for p in payloads:
        n = len(p) // 64
        cols = max(1, int(np.ceil(np.sqrt(n))))
        rows = -(-n // cols)
        c = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int32) - 128
        c[:, 0] += c[:, 1:].sum(1) >> 4
        parts += [c, np.zeros((rows * cols - n, 64), np.int32)]
        first.append(np.arange(rows * cols) % RESTART == 0)
        shapes.append((rows, cols))
    code, held = _coded(np.concatenate(parts), np.concatenate(first))
    # A byte FF is followed by 00; a restart marker follows each interval but a file's last.
    ends = np.cumsum(held) - 1
    many = np.array([-(-r * c // RESTART) for r, c in shapes])
    finals = np.cumsum(many) - 1
    mark = np.full(len(held), 2)
    mark[finals] = 0
    wide = 1 + (code == 0xFF)
    wide[ends] += mark
    stop = np.cumsum(wide)
    scan = np.zeros(int(stop[-1]), np.uint8)
    scan[stop - wide] = code
    turn = (np.arange(len(held)) - np.repeat(finals + 1 - many, many)) % 8
    marked = np.flatnonzero(mark)
    scan[stop[ends[marked]] - 2], scan[stop[ends[marked]] - 1] = 0xFF, RST0 + turn[marked]
    dht = b"".join(_segment(DHT, bytes([k << 4]) + t.counts + t.symbols) for k, t in enumerate(tables()))
    cuts = [0, *(int(x) for x in stop[ends[finals]])]
    return [
        b"".join(
            (
                bytes((0xFF, SOI)), _segment(COM, b"payload %d" % len(p)), _segment(DQT, b"\x00" + b"\x01" * 64), _segment(SOF0, struct.pack(">BHHBBBB", 8, rows * 8, cols * 8, 1, 1, 0x11, 0)), dht,
                _segment(DRI, struct.pack(">H", RESTART)), _segment(SOS, bytes((1, 1, 0x00, 0, 63, 0))), scan[a:b].tobytes(), bytes((0xFF, EOI)),
            )
        )
        for p, (rows, cols), a, b in zip(payloads, shapes, cuts[:-1], cuts[1:], strict=True)
    ]


def parse(data: bytes) -> dict:
    """Markers up to the scan: size, components, quantisation and Huffman tables, restart interval, and the
    scan's bytes."""
    if data[:2] != bytes((0xFF, SOI)):
        raise ValueError("not a JPEG file")
    out: dict = {"quant": {}, "huffman": {}, "restart": 0, "comments": []}
    at = 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        while data[at + 1] == 0xFF:
            at += 1
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == DQT:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                out["quant"][k] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(int)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == DHT:
            while body:
                counts = body[1:17]
                n = sum(counts)
                out["huffman"][body[0]] = Huffman(counts, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == SOF0:
            bits, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("8-bit samples only")
            out["components"] = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("baseline files only")
        elif marker == DRI:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == COM:
            out["comments"].append(body)
        elif marker == SOS:
            out["scan_components"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = data.rfind(bytes((0xFF, EOI)))
            out["scan"] = data[at : end if end >= at else len(data)]
            return out


def _intervals(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A scan without restart markers and stuffed zeros, and where its intervals begin."""
    raw = np.frombuffer(scan, np.uint8)
    after = np.concatenate([raw[1:], [0]]) if len(raw) else raw
    escape = raw == 0xFF
    mark = escape & (after >= RST0) & (after <= RST0 + 7)
    drop = mark.copy()
    drop[1:] |= mark[:-1] | (escape[:-1] & (raw[1:] == 0))
    kept = np.cumsum(~drop)
    return raw[~drop], np.concatenate([[0], kept[np.flatnonzero(mark)]]).astype(np.int64)


def _side_by_side(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, units: list[tuple[int, Huffman, Huffman]]) -> np.ndarray:
    """The quantised coefficients of all blocks of the intervals, in order. blocks: how many each interval has;
    units: the component and tables of each block of a unit, by turns."""
    found = list(dict.fromkeys(t for _, dc, ac in units for t in (dc, ac)))
    table = np.concatenate([size.astype(np.int32) << 8 | symbol for symbol, size in (t.lookup() for t in found)])
    base = np.array([[found.index(dc) << 16, found.index(ac) << 16] for _, dc, ac in units])
    part, single = np.array([c for c, _, _ in units]), len(units) == 1
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
    word = sum(wide[j : len(wide) - 4 + j] << (32 - 8 * j) for j in range(5))  # 40 bits from each byte on
    first = np.cumsum(blocks) - blocks
    out = np.zeros((int(blocks.sum()), 64), np.int32)
    flat = out.reshape(-1)
    live = np.flatnonzero(blocks > 0)
    at, block, end, k = starts[live] * 8, first[live], first[live] + blocks[live], np.zeros(len(live), np.int64)
    origin, before = first[live], np.zeros((len(live), int(part.max()) + 1), np.int64)
    low = (1 << np.arange(17)) - 1  # all ones of a size
    half = np.where(np.arange(17) > 0, 1 << np.maximum(np.arange(17) - 1, 0), 0)
    while len(at):
        byte = at >> 3
        if int(byte.max()) >= len(word):
            raise ValueError("the scan ends too early")
        bits = (word[byte] << (at & 7)) & 0xFFFFFFFFFF
        dc = k == 0
        turn = 0 if single else (block - origin) % len(units)
        entry = table[(bits >> 24) + np.where(dc, base[turn, 0], base[turn, 1])]
        size, symbol = entry >> 8, entry & 0xFF
        if not size.all():
            raise ValueError("no such Huffman code")
        n = symbol & 15
        size += n
        value = (bits >> (40 - size)) & low[n]
        value -= np.where(value < half[n], low[n], 0)
        at = at + size
        run = np.where(dc, 0, symbol >> 4)
        place = k + run
        stop = (n == 0) & ~dc & (run < 15)
        if int(place.max()) > 63 and (place[~stop] > 63).any():
            raise ValueError("a block has too many coefficients")
        if dc.any():
            lane = np.flatnonzero(dc)
            c = 0 if single else part[turn[lane]]
            before[lane, c] += value[lane]
            value[lane] = before[lane, c]
        # Where nothing is coded the value is 0, and so is what it is written to.
        flat[(block << 6) + np.minimum(place, 63)] = value
        k = np.where(stop, 64, place + 1)
        if int(k.max()) >= 64:
            done = k >= 64
            block, k = block + done, np.where(done, 0, k)
            if (block >= end).any():
                keep = block < end
                at, block, end, k, origin, before = at[keep], block[keep], end[keep], k[keep], origin[keep], before[keep]
    return out


def _layout(p: dict) -> tuple[int, int, list[tuple[int, Huffman, Huffman]], int, int]:
    """Rows and columns of units, the blocks of a unit, and its columns and rows of the first component."""
    comps = p["components"]
    hmax, vmax = max(c[0] for c in comps.values()), max(c[1] for c in comps.values())
    h, v = comps[p["scan_components"][0][0]][:2]
    if len(p["scan_components"]) == 1:  # its blocks row by row, whatever its sampling
        _, dc, ac = p["scan_components"][0]
        wide, high = -(-p["width"] * h // hmax), -(-p["height"] * v // vmax)
        return -(-high // 8), -(-wide // 8), [(0, p["huffman"][dc], p["huffman"][16 + ac])], 1, 1
    units = [(i, p["huffman"][dc], p["huffman"][16 + ac]) for i, (cid, dc, ac) in enumerate(p["scan_components"]) for _ in range(comps[cid][0] * comps[cid][1])]
    return -(-p["height"] // (8 * vmax)), -(-p["width"] // (8 * hmax)), units, h, v


def decoded(files: list[dict]) -> list[np.ndarray]:
    """For parsed files the quantised coefficients of the first component's blocks (zigzag order) in rows of
    blocks: shape (block rows, block columns, 64). Files whose units are alike are decoded together."""
    layouts = [_layout(p) for p in files]
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(layouts):
        groups.setdefault(tuple(x[2]), []).append(i)
    out: list[np.ndarray] = [np.zeros(0)] * len(files)
    for units, members in groups.items():
        data, starts = _intervals(bytes((0xFF, RST0)).join(files[i]["scan"] for i in members))
        sizes = []
        for i in members:
            n = layouts[i][0] * layouts[i][1]
            per = files[i]["restart"] or n
            sizes.append(np.minimum(per, n - np.arange(0, n, per)) * len(units))
        blocks = np.concatenate(sizes)
        if len(blocks) != len(starts):
            raise ValueError("restart markers and intervals differ in number")
        coefficients, at = _side_by_side(data, starts, blocks, list(units)), 0
        for i, s in zip(members, sizes, strict=True):
            rows, cols, _, h, v = layouts[i]
            mine = coefficients[at : at + int(s.sum())].reshape(rows, cols, len(units), 64)[:, :, : h * v]
            out[i] = mine.reshape(rows, cols, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(rows * v, cols * h, 64)
            at += int(s.sum())
    return out


def decode(data: bytes) -> tuple[dict, np.ndarray]:
    """A file parsed, and its coefficients as `decoded` gives them."""
    p = parse(data)
    return p, decoded([p])[0]


def payload_of(p: dict, c: np.ndarray) -> bytes:
    """The bytes that encode_payloads stored."""
    size = next(int(x.split()[1]) for x in p["comments"] if x.startswith(b"payload "))
    c = c.reshape(-1, 64)[: size // 64].copy()
    c[:, 0] -= c[:, 1:].sum(1) >> 4
    return (c + 128).astype(np.uint8).tobytes()


def thumbnail(p: dict, coefficients: np.ndarray) -> np.ndarray:
    """Mean luminance of every block, from its DC coefficient alone: 128 + DC * q / 8, from 0 to 255."""
    q = p["quant"][p["components"][p["scan_components"][0][0]][2]][0]
    return np.clip(128 + coefficients[:, :, 0] * q / 8, 0, 255)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid of means lie above the grid's mean."""
    rows, cols = thumb.shape
    total = np.zeros((rows + 1, cols + 1))
    total[1:, 1:] = thumb.cumsum(0).cumsum(1)
    low = lambda n: np.arange(8) * n // 8
    high = lambda n: np.maximum(-(-(np.arange(8) + 1) * n // 8), low(n) + 1)
    r0, r1, c0, c1 = low(rows), high(rows), low(cols), high(cols)
    s = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    cells = s / np.outer(r1 - r0, c1 - c0)
    return np.packbits(cells > cells.mean() + 1e-9).tobytes().hex()


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def feature(p: dict, coefficients: np.ndarray) -> str:
    """A file's dimensions and its thumbnail's hashes: of its coarse look, and of all its cells."""
    thumb = thumbnail(p, coefficients)
    return f"{p['width']}x{p['height']}:{thumbnail_hash(thumb)}:{zlib.crc32(np.rint(thumb * 8).astype(np.uint16).tobytes()):08x}"


def media_features(docs: DataFrame) -> DataFrame:
    """Per document: its text as a JPEG, read back, with sizes, hashes and the thumbnail's hashes."""

    def rows(ids: list, texts: list[str]) -> list[tuple]:
        payloads = [padded(t) for t in texts]
        stored = encode_payloads([p for p, _ in payloads])
        parsed = [parse(x) for x in stored]
        out = []
        for doc, (_, size), media, p, c in zip(ids, payloads, stored, parsed, decoded(parsed), strict=True):
            back = payload_of(p, c)
            out.append((doc, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(p, c), p["width"], p["height"]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, at, size = [], 0, 0
            ids, texts = list(batch["doc_id"].astype("Int64")), batch["text"].tolist()
            for i, t in enumerate(texts, 1):
                size += 64 + len(t)
                if size >= GROUP or i == len(texts):
                    out += rows(ids[at:i], texts[at:i])
                    at, size = i, 0
            yield pd.DataFrame(out, columns=NAMES).astype({"doc_id": "Int64"})

    batched(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(frugal(run), SCHEMA)
