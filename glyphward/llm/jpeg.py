"""Baseline JPEG in numpy: marker parsing, Huffman decoding of many scans in step, DC-only luminance; and a small encoder.

Decoding keeps the DC coefficients alone: each 8x8 block of the luminance becomes a pixel, its mean.  The scans of many
pictures (each restart interval by itself) advance together, a Huffman symbol of each at a step; when few are left, each is
finished by a loop of its own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ZIGZAG = np.array(
    [
        0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
        35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
    ]
)
#: Fewer scans than this are finished one at a time.
FEW = 24


class Corrupt(ValueError):
    """The bytes are no JPEG, or break off."""


class Unsupported(ValueError):
    """A JPEG, but not of the baseline (or extended Huffman, 8 bit) kind."""


class Picture:
    """Frame data, tables and entropy-coded segments of one file."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.huff: dict[tuple[int, int], bytes] = {}
        self.width = self.height = self.restart = 0
        self.parts: list[tuple[int, int, int, int]] = []  # id, h, v, quantisation table
        self.scans: list[tuple[list[tuple[int, bytes, bytes]], list[bytes], int, int]] = []
        if data[:2] != b"\xff\xd8":
            raise Corrupt("no start of image")
        at = 2
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                break
            mark = data[at + 1]
            if mark == 0xFF:
                at += 1
                continue
            at += 2
            if mark == 0xD9:
                break
            if mark == 0 or mark == 1 or 0xD0 <= mark <= 0xD7:
                continue
            if at + 2 > len(data):
                raise Corrupt("a marker breaks off")
            size = int.from_bytes(data[at : at + 2], "big")
            body = data[at + 2 : at + size]
            if size < 2 or len(body) != size - 2:
                raise Corrupt("a marker breaks off")
            at += size
            if mark == 0xDB:
                self._quant(body)
            elif mark == 0xC4:
                self._huff(body)
            elif mark in (0xC0, 0xC1):
                self._frame(body)
            elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
                raise Unsupported(f"frame type {mark - 0xC0}")
            elif mark == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif mark == 0xDA:
                at = self._scan(data, body, at)
        if not self.scans:
            raise Corrupt("no scan")

    def _quant(self, b: bytes) -> None:
        i = 0
        while i < len(b):
            wide, n = b[i] >> 4, b[i] & 15
            size = 128 if wide else 64
            raw = b[i + 1 : i + 1 + size]
            if len(raw) < size:
                raise Corrupt("a quantisation table breaks off")
            self.quant[n] = np.frombuffer(raw, ">u2" if wide else "u1").astype(np.int64)
            i += 1 + size

    def _huff(self, b: bytes) -> None:
        i = 0
        while i < len(b):
            if i + 17 > len(b):
                raise Corrupt("a Huffman table breaks off")
            n = sum(b[i + 1 : i + 17])
            if i + 17 + n > len(b):
                raise Corrupt("a Huffman table breaks off")
            self.huff[b[i] >> 4, b[i] & 15] = b[i + 1 : i + 17 + n]
            i += 17 + n

    def _frame(self, b: bytes) -> None:
        if len(b) < 6 or len(b) < 6 + 3 * b[5]:
            raise Corrupt("the frame breaks off")
        if b[0] != 8:
            raise Unsupported(f"{b[0]} bits a sample")
        self.height, self.width = int.from_bytes(b[1:3], "big"), int.from_bytes(b[3:5], "big")
        self.parts = [(b[6 + 3 * k], b[7 + 3 * k] >> 4, b[7 + 3 * k] & 15, b[8 + 3 * k]) for k in range(b[5])]
        if not self.width or not self.parts or any(not (h and v and h <= 4 and v <= 4) for _, h, v, _ in self.parts):
            raise Corrupt("the frame is empty")
        if not self.height:
            raise Unsupported("height given after the scan")

    def _scan(self, data: bytes, head: bytes, at: int) -> int:
        if not self.parts or not head or len(head) < 1 + 2 * head[0]:
            raise Corrupt("a scan without frame")
        ids = [p[0] for p in self.parts]
        used = []
        for k in range(head[0]):
            which, t = head[1 + 2 * k], head[2 + 2 * k]
            if which not in ids or (0, t >> 4) not in self.huff or (1, t & 15) not in self.huff:
                raise Corrupt("a scan names what is not there")
            used.append((ids.index(which), self.huff[0, t >> 4], self.huff[1, t & 15]))
        end = at
        while True:  # to the first marker that is no restart and no stuffed byte
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                end = len(data)
                break
            if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 2
            elif data[end + 1] == 0xFF:
                end += 1
            else:
                break
        raw = data[at:end]
        pieces, a = [], 0
        if self.restart:
            i = raw.find(b"\xff")
            while i >= 0 and i + 1 < len(raw):
                if 0xD0 <= raw[i + 1] <= 0xD7:
                    pieces.append(raw[a:i])
                    a = i + 2
                i = raw.find(b"\xff", i + 2)
        pieces.append(raw[a:])
        self.scans.append((used, [p.replace(b"\xff\x00", b"\xff") for p in pieces], self.restart, len(self.scans)))
        return end

    def grid(self, part: int) -> tuple[int, int]:
        """Blocks across and down that hold samples of a component."""
        hmax, vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        _, h, v, _ = self.parts[part]
        return -(-(-(-self.width * h // hmax)) // 8), -(-(-(-self.height * v // vmax)) // 8)


_TABLES: dict[bytes, np.ndarray] = {}


def lookup(spec: bytes) -> np.ndarray:
    """For each 16 bits: code length and symbol; length 0 where no code begins so."""
    table = _TABLES.get(spec)
    if table is None:
        table = np.zeros(1 << 16, np.uint16)
        code, k = 0, 16
        for length in range(1, 17):
            for _ in range(spec[length - 1]):
                a, b = code << (16 - length), (code + 1) << (16 - length)
                if b > 1 << 16:
                    raise Corrupt("a Huffman table is overfull")
                table[a:b] = length << 8 | spec[k]
                code, k = code + 1, k + 1
            code <<= 1
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[spec] = table
    return table


@lru_cache(maxsize=16)
def _as_list(spec: bytes) -> list[int]:
    return lookup(spec).tolist()


@lru_cache(maxsize=64)
def steps(spec: bytes, ac: bool) -> np.ndarray:
    """``lookup`` with what a symbol moves: bits in all, places in the block (64 ends it, 128 breaks off), code length, size."""
    table = lookup(spec).astype(np.int32)
    length, s = table >> 8, table & 255
    size = s & 15 if ac else s
    if ac:
        move = np.where(size > 0, (s >> 4) + 1, np.where(s == 0xF0, 16, 64))
    else:
        move = np.where(s > 15, 128, 1)
        size = np.minimum(size, 15)
    return np.where(length == 0, 128 << 8, (length + size) | move << 8 | length << 16 | size << 24).astype(np.int32)


class _Lane:
    __slots__ = ("bits", "blocks", "ac", "comp", "dc", "fail", "n", "out")

    def __init__(self, bits: bytes, n: int, comp: np.ndarray, dc: list[bytes], ac: list[bytes]):
        self.bits, self.n, self.comp, self.dc, self.ac = bits, n, comp, dc, ac
        self.out = np.zeros(n, np.int64)
        self.fail = False


def _finish(lane: _Lane, bit: int, block: int, k: int, pred: list[int]) -> None:
    """The rest of a scan, symbol by symbol."""
    data = lane.bits + b"\xff" * 16
    last = 8 * len(lane.bits)
    dc = [_as_list(t) for t in lane.dc]
    ac = [_as_list(t) for t in lane.ac]
    comp, out, n = lane.comp.tolist(), lane.out, lane.n
    width = len(comp)
    while block < n:
        c = comp[block % width]
        if k == 0:
            i = bit >> 3
            v = int.from_bytes(data[i : i + 5], "big") >> (8 - (bit & 7)) if i + 5 <= len(data) else 0
            e = dc[c][v >> 16 & 0xFFFF]
            length, s = e >> 8, e & 255
            if not length or s > 15 or bit + length + s > last:
                lane.fail = True
                return
            bit += length
            if s:
                i = bit >> 3
                x = int.from_bytes(data[i : i + 4], "big") >> (32 - (bit & 7) - s) & ((1 << s) - 1)
                pred[c] += x if x >> (s - 1) else x - (1 << s) + 1
                bit += s
            out[block] = pred[c]
            k = 1
        table = ac[c]
        while k < 64:
            i = bit >> 3
            e = table[int.from_bytes(data[i : i + 3], "big") >> (8 - (bit & 7)) & 0xFFFF]
            length, s = e >> 8, e & 255
            bit += length + (s & 15)
            if not length or bit > last:
                lane.fail = True
                return
            if not s & 15:
                if s != 0xF0:
                    break
                k += 16
            else:
                k += (s >> 4) + 1
        block, k = block + 1, 0


def decode_lanes(lanes: list[_Lane]) -> None:
    """Running DC values of every block of every lane, in scan order."""
    if not lanes:
        return
    n = len(lanes)
    specs: dict[bytes, int] = {}
    for lane in lanes:
        for t in lane.dc + lane.ac:
            specs.setdefault(t, len(specs))
    if n < FEW or len(specs) > 64:
        for lane in lanes:
            _finish(lane, 0, 0, 0, [0] * len(lane.dc))
        return
    tables = np.concatenate([steps(t, False) for t in specs] + [steps(t, True) for t in specs])
    pad = b"\xff" * 16
    base = np.cumsum([0] + [len(lane.bits) + 16 for lane in lanes])[:-1].astype(np.int64)
    # a lane that runs off its end is stopped where its block ends, 64 symbols later at most
    raw = np.frombuffer(b"".join(lane.bits + pad for lane in lanes) + b"\xff" * 512, np.uint8)
    word = raw[:-3].astype(np.uint32) << np.uint32(24)
    for k in (1, 2, 3):
        word |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(8 * (3 - k))
    bit, last = base * 8, (base + [len(lane.bits) for lane in lanes]) * 8
    width = max(len(lane.comp) for lane in lanes)
    comp = np.zeros((n, width), np.int64)
    kinds = np.zeros((n, 2, 4), np.int64)
    period, blocks = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, lane in enumerate(lanes):
        comp[i, : len(lane.comp)], period[i], blocks[i] = lane.comp, len(lane.comp), lane.n
        kinds[i, 0, : len(lane.dc)] = [specs[t] << 16 for t in lane.dc]
        kinds[i, 1, : len(lane.ac)] = [specs[t] + len(specs) << 16 for t in lane.ac]
    place = np.cumsum(blocks) - blocks
    diffs = np.zeros(int(blocks.sum()), np.int64)
    failed = np.zeros(n, bool)
    live = np.flatnonzero(blocks > 0)
    lb, lk, lbit, lturn = (np.zeros(len(live), np.int64) for _ in range(4))
    lbit = bit[live]
    ltab, lac = kinds[live, 0, comp[live, 0]], kinds[live, 1, comp[live, 0]]
    llast, lblocks, lplace = last[live], blocks[live], place[live]
    while len(live) >= FEW:
        peek = word[lbit >> 3] << (lbit & 7).astype(np.uint32)  # 25 bits are sure
        e = tables[ltab + (peek >> np.uint32(16))]
        f = np.flatnonzero(lk == 0)
        if len(f):
            ef = e[f]
            at, sf = lbit[f] + (ef >> 16 & 31), (ef >> 24 & 15).astype(np.int64)
            x = (word[at >> 3] << (at & 7).astype(np.uint32)).astype(np.int64) & 0xFFFFFFFF
            v = x >> (32 - sf)
            diffs[lplace[f] + lb[f]] = np.where(sf == 0, 0, np.where(v >> np.maximum(sf - 1, 0), v, v - (1 << sf) + 1))
            ltab[f] = lac[f]
        lbit += e & 255
        lk += e >> 8 & 255
        done = np.flatnonzero(lk >= 64)
        if len(done):
            bad = (lk[done] >= 128) | (lbit[done] > llast[done])
            lk[done] = 0
            lb[done] += 1
            t = lturn[done] + 1
            t[t == period[live[done]]] = 0
            lturn[done] = t
            c = comp[live[done], t]
            ltab[done], lac[done] = kinds[live[done], 0, c], kinds[live[done], 1, c]
            failed[live[done[bad]]] = True
            over = bad | (lb[done] >= lblocks[done])
            if over.any():
                keep = np.ones(len(live), bool)
                keep[done[over]] = False
                live, lb, lk, lbit, lturn, ltab, lac = live[keep], lb[keep], lk[keep], lbit[keep], lturn[keep], ltab[keep], lac[keep]
                llast, lblocks, lplace = llast[keep], lblocks[keep], lplace[keep]
    rest = {int(i): (int(b), int(q), int(p)) for i, b, q, p in zip(live, lb, lk, lbit)}
    for i, lane in enumerate(lanes):
        have = rest[i][0] + (rest[i][1] > 0) if i in rest else lane.n
        d = diffs[place[i] : place[i] + have]
        which = np.resize(lane.comp, lane.n)[:have]
        ends = [0] * len(lane.dc)
        for c in range(len(lane.dc)):
            run = np.cumsum(d[which == c])
            lane.out[:have][which == c] = run
            ends[c] = int(run[-1]) if len(run) else 0
        lane.fail = bool(failed[i])
        if i in rest:
            b, q, p = rest[i]
            _finish(lane, p - int(base[i]) * 8, b, q, ends)


def luminance(files: list[bytes | None]) -> list[tuple[Picture, np.ndarray] | str | None]:
    """Per file: the picture and its thumbnail (a pixel for each 8x8 block), or ``corrupt`` or ``unsupported``; None stays."""
    out: list = []
    lanes: list[_Lane] = []
    jobs: list[tuple[int, Picture, list[_Lane], tuple]] = []
    for data in files:
        if data is None:
            out.append(None)
            continue
        try:
            picture = Picture(data)
            scan = next((s for s in picture.scans if any(c == 0 for c, _, _ in s[0])), None)
            if scan is None or picture.parts[0][3] not in picture.quant:
                raise Corrupt("no luminance")
            used, pieces, every, _ = scan
            if len(used) == 1:
                across, down = picture.grid(used[0][0])
                units, layout = across * down, [0]
            else:
                hmax, vmax = max(p[1] for p in picture.parts), max(p[2] for p in picture.parts)
                across, down = -(-picture.width // (8 * hmax)), -(-picture.height // (8 * vmax))
                units = across * down
                layout = [i for i, (c, _, _) in enumerate(used) for _ in range(picture.parts[c][1] * picture.parts[c][2])]
            every = every or units
            if len(pieces) != -(-units // every):
                raise Corrupt("restart intervals are missing")
            for _, d, a in used:
                lookup(d), lookup(a)
            mine = [
                _Lane(p, len(layout) * min(every, units - i * every), np.array(layout), [d for _, d, _ in used], [a for _, _, a in used])
                for i, p in enumerate(pieces)
            ]
            if sum(lane.n for lane in mine) > 8 * sum(len(p) for p in pieces):  # a block takes two bits at least
                raise Corrupt("the scan is too short")
            lanes += mine
            jobs.append((len(out), picture, mine, (used, across, down, layout)))
            out.append("corrupt")
        except Corrupt:
            out.append("corrupt")
        except Unsupported:
            out.append("unsupported")
    decode_lanes(lanes)
    for at, picture, mine, (used, across, down, layout) in jobs:
        if any(lane.fail for lane in mine):
            continue
        values = np.concatenate([lane.out for lane in mine])
        which = next(i for i, (c, _, _) in enumerate(used) if c == 0)
        gw, gh = picture.grid(0)
        if len(used) == 1:
            dc = values.reshape(down, across)
        else:
            _, h, v, _ = picture.parts[0]
            unit = values.reshape(down, across, len(layout))[:, :, np.array(layout) == which]
            dc = unit.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        q = picture.quant[picture.parts[0][3]][0]
        # the DC coefficient is eight times the block's mean
        out[at] = picture, np.clip((dc[:gh, :gw] * q + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return out


# ---------------------------------------------------------------- encoding


def _spec(counts: str, symbols: list[int]) -> bytes:
    return bytes(int(c) if c.isdigit() else ord(c) - 87 for c in counts) + bytes(symbols)


def _flat(size: int, symbols: list[int]) -> bytes:
    """A Huffman table whose codes all have ``size`` bits."""
    return bytes(len(symbols) if k == size else 0 for k in range(1, 17)) + bytes(symbols)


#: End of block and short runs of small values get short codes; every other symbol takes ten bits.
_SHORT = {0x00: 2, 0x01: 2, 0x02: 3, 0x11: 4, 0x03: 5, 0x21: 6, 0x12: 6}
_DC = _flat(4, list(range(12)))


def _ac_spec() -> bytes:
    counts = [0] * 16
    for n in _SHORT.values():
        counts[n - 1] += 1
    rest = [s for s in [0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)] if s not in _SHORT]
    short = sorted(_SHORT, key=lambda s: (_SHORT[s], s))
    counts[10] += len(rest)
    return bytes(counts) + bytes(short) + bytes(rest)


_AC = _ac_spec()


@lru_cache(maxsize=16)
def _codes(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, k = 0, 16
    value, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            value[spec[k]], size[spec[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return value, size


_DCT = np.array([[(0.5 if u else np.sqrt(0.125)) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def encode_gray(image: np.ndarray, quant: int = 16, restart: int = 0) -> bytes:
    """A baseline JPEG of a grey image (uint8, rows by columns), every coefficient divided by ``quant``."""
    height, width = image.shape
    padded = np.pad(image, ((0, -height % 8), (0, -width % 8)), mode="edge").astype(np.float64) - 128
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    coef = np.rint(_DCT @ blocks @ _DCT.T / quant).astype(np.int64).reshape(-1, 64)[:, ZIGZAG]
    n = len(coef)
    dc = coef[:, 0].copy()
    every = restart or n
    prior = np.concatenate([[0], dc[:-1]])
    prior[::every] = 0
    row, col = np.nonzero(coef[:, 1:])
    value = coef[row, col + 1]
    head = np.ones(len(row), bool)
    head[1:] = row[1:] != row[:-1]
    gap = col - np.where(head, -1, np.concatenate([[0], col[:-1]])) - 1
    ends = np.full(n, -1)
    ends[row] = col  # the last of each row is written last
    # symbols: (block, place in block, symbol, extra bits, number of them)
    zrl = gap >> 4
    at = [np.arange(n), row, np.repeat(row, zrl), np.flatnonzero(ends < 62)]
    order = [np.full(n, -1.0), col + 0.5, np.repeat(col + 0.25, zrl), np.full(len(at[3]), 99.0)]
    size = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    diff = dc - prior
    ds, vs = size(diff), size(value)
    (dv, dl), (av, al) = _codes(_DC), _codes(_AC)
    sym = (gap & 15) << 4 | vs
    bits = [dv[ds], av[sym], np.full(len(at[2]), av[0xF0]), np.full(len(at[3]), av[0])]
    lens = [dl[ds], al[sym], np.full(len(at[2]), al[0xF0]), np.full(len(at[3]), al[0])]
    ext = lambda v, s: np.where(v < 0, v + (1 << s) - 1, v).astype(np.uint64)
    bits[0], lens[0] = bits[0] << ds.astype(np.uint64) | ext(diff, ds), lens[0] + ds
    bits[1], lens[1] = bits[1] << vs.astype(np.uint64) | ext(value, vs), lens[1] + vs
    block = np.concatenate(at)
    turn = np.lexsort((np.concatenate(order), block))
    block, bits_, lens_ = block[turn], np.concatenate(bits)[turn], np.concatenate(lens)[turn].astype(np.int64)
    body = []
    cuts = np.searchsorted(block, np.arange(0, n, every)).tolist() + [len(block)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        size_ = lens_[a:b]
        start = np.cumsum(size_) - size_
        total = int(size_.sum())
        # each symbol (27 bits at most) lies in a 32-bit word and perhaps the next; no bits overlap, so words are sums
        wide = bits_[a:b] << (64 - (start & 31) - size_).astype(np.uint64)
        word = start >> 5
        n_words = total // 32 + 2
        words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n_words)
        words += np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
        raw = bytearray(words.astype(">u4").tobytes()[: (total + 7) // 8])
        if total % 8:
            raw[-1] |= (1 << (8 - total % 8)) - 1
        body.append((b"" if i == 0 else bytes([0xFF, 0xD0 + (i - 1) % 8])) + bytes(raw).replace(b"\xff", b"\xff\x00"))
    seg = lambda mark, payload: bytes([0xFF, mark]) + (len(payload) + 2).to_bytes(2, "big") + payload
    out = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([quant]) * 64)
    out += seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    out += seg(0xC4, bytes([0x00]) + _DC) + seg(0xC4, bytes([0x10]) + _AC)
    if restart:
        out += seg(0xDD, restart.to_bytes(2, "big"))
    return out + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + b"".join(body) + b"\xff\xd9"
