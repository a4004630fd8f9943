"""Progressive JPEG in numpy: a decoder for any such file, and a lossless container of bytes as coefficients."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: The order in which a block's coefficients are coded.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Files that claim to have more pixels count as broken: a few bytes could ask for any amount of memory.
MOST_PIXELS = 1 << 28
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class _Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table


class Frame:
    """What a file's headers say, and its scans: (components, Ss, Se, Ah, Al, Huffman tables, restart interval, coded bytes)."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.quant: dict[int, np.ndarray] = {}
        self.comment = b""
        self.scans: list[tuple] = []
        tables: dict[tuple[int, int], tuple] = {}
        restart, at = 0, 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            if kind == 0xD9:
                return
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    size = 128 if wide else 64
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + size :]
            elif kind == 0xC2:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                self.h, self.v = max(c.h for c in self.parts), max(c.v for c in self.parts)
                self.mw, self.mh = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
                for c in self.parts:
                    c.cols, c.rows = self.mw * c.h, self.mh * c.v  # with padding to whole MCUs
                    c.bw = -(-(-(-self.width * c.h // self.h)) // 8)
                    c.bh = -(-(-(-self.height * c.v // self.v)) // 8)
            elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not progressive with Huffman codes")
            elif kind == 0xC4:
                while body:
                    counts = body[1:17]
                    total = sum(counts)
                    tables[body[0] >> 4, body[0] & 15] = (counts, body[17 : 17 + total])
                    body = body[17 + total :]
            elif kind == 0xDD:
                restart = int.from_bytes(body[:2], "big")
            elif kind == 0xFE:
                self.comment = body
            elif kind == 0xDA:
                k = body[0]
                who = [(next(i for i, c in enumerate(self.parts) if c.ident == body[1 + 2 * j]), body[2 + 2 * j] >> 4, body[2 + 2 * j] & 15) for j in range(k)]
                ss, se, a = body[1 + 2 * k : 4 + 2 * k]
                end = _MARKER.search(data, at)
                stop = end.start() if end else len(data)
                own = [(tables.get((0, d)), tables.get((1, c))) for _, d, c in who]
                self.scans.append(([i for i, _, _ in who], ss, se, a >> 4, a & 15, own, restart, data[at:stop]))
                at = stop

    def check(self) -> None:
        """Raises where the headers don't describe a picture that can be read."""
        if not (self.scans and self.width and self.height and len(self.parts) in (1, 3)) or any(c.table not in self.quant or len(self.quant[c.table]) != 64 or not 1 <= c.h <= 4 or not 1 <= c.v <= 4 or self.h % c.h or self.v % c.v for c in self.parts):
            raise ValueError("no such picture")
        if self.width * self.height > MOST_PIXELS:
            raise ValueError("too many pixels")
        for who, ss, se, ah, al, tables, _, _ in self.scans:
            if not ss <= se < 64 or (ss == 0) != (se == 0) or (ss and len(who) > 1) or (ah and ah != al + 1) or al > 13 or any(t is None for d, a in tables for t in ([] if ss == 0 and ah else [a] if ss else [d])):
                raise ValueError("no such scan")

    def script(self) -> tuple:
        """Files with equal scripts have the same components and scans, and the same codes."""
        return (tuple((c.h, c.v, self.quant[c.table].tobytes()) for c in self.parts), tuple((tuple(s[0]), *s[1:5], tuple(s[5]), s[6]) for s in self.scans))


@lru_cache(maxsize=256)
def _lookup(table: tuple) -> np.ndarray:
    """For each 16 bits that may come next: the code's length * 256 + its symbol; 0 if no code begins so."""
    counts, symbols = table
    out = np.zeros(1 << 16, dtype=np.int32)
    code, k = 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if code >> length or k >= len(symbols):
                raise ValueError("a bad Huffman table")
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Lanes:
    """The coded bytes of one scan of many files. A lane is what stands between two restart markers; all lanes are read in step."""

    def __init__(self, coded: list[bytes]):
        raw = np.frombuffer(b"".join(x + b"\xff\xd0" for x in coded) + b"\x00", dtype=np.uint8)
        high = raw == 0xFF
        after = np.concatenate([raw[1:], [0]])
        mark = high & (after >= 0xD0) & (after <= 0xD7)
        drop = mark.copy()
        drop[1:] |= mark[:-1] | (high[:-1] & (raw[1:] == 0))
        drop[-1] = True
        data = raw[~drop]
        kept = np.cumsum(~drop)
        self.end = kept[mark] * 8
        self.at = np.concatenate([[0], self.end[:-1]])
        files = np.cumsum([len(x) + 2 for x in coded])
        self.file = np.searchsorted(files, np.flatnonzero(mark), side="right")
        w = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
        self.words = (w[:-3] << np.uint32(24)) | (w[1:-2] << np.uint32(16)) | (w[2:-1] << np.uint32(8)) | w[3:]
        self.last = 8 * len(data)
        self.bad = np.zeros(len(coded), dtype=bool)

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """The n bits (16 at most) from each place."""
        shift = (32 - n - (at & 7)).astype(np.uint32)
        return (self.words[np.minimum(at, self.last) >> 3] >> shift).astype(np.int64) & ((1 << n) - 1)

    def take(self, own: np.ndarray, n) -> np.ndarray:
        out = self.peek(self.at[own], n)
        self.at[own] += n
        return out

    def symbol(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        x = codes[self.peek(self.at[own], 16)]
        if not x.all():
            self.bad[self.file[own[x == 0]]] = True
        self.at[own] += x >> 8
        return x & 255

    def signed(self, own: np.ndarray, size: np.ndarray) -> np.ndarray:
        v = self.take(own, size)
        return np.where(v >> np.maximum(size - 1, 0), v, v - (1 << size) + 1)


def _blocks(f: Frame, who: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of a scan as coded: which of its components, and the block's number there; one row for each MCU."""
    if len(who) == 1:
        c = f.parts[who[0]]
        at = (np.arange(c.bh)[:, None] * c.cols + np.arange(c.bw)[None, :]).reshape(-1, 1)
        return np.zeros_like(at), at
    my, mx = np.divmod(np.arange(f.mw * f.mh), f.mw)
    js, ats = [], []
    for j, i in enumerate(who):
        c = f.parts[i]
        for y in range(c.v):
            for x in range(c.h):
                js.append(np.full(len(mx), j))
                ats.append((my * c.v + y) * c.cols + mx * c.h + x)
    return np.stack(js, axis=1), np.stack(ats, axis=1)


def _run_scan(frames: list[Frame], number: int, coefs: list[np.ndarray], starts: list[np.ndarray], maps: dict) -> np.ndarray:
    """Adds one scan of many files of one script to their coefficients (block, place); which files are broken.

    starts says for each component where a file's blocks begin in coefs.
    """
    who, ss, se, ah, al, tables, restart, _ = frames[0].scans[number]
    lanes = _Lanes([f.scans[number][7] for f in frames])
    blocks, units = [], np.empty(len(frames), dtype=np.int64)
    for i, f in enumerate(frames):
        key = (*who, f.width, f.height)
        if key not in maps:
            maps[key] = _blocks(f, who)
        which, at = maps[key]
        units[i] = len(at)
        blocks.append((at + np.array([starts[c][i] for c in who])[which]).reshape(-1))
    block, each = np.concatenate(blocks), which.shape[1]
    pattern = which[0]  # of the components within an MCU
    per_file = -(-units // restart) if restart else np.ones_like(units)
    lanes.bad |= np.bincount(lanes.file, minlength=len(frames)) != per_file
    first = np.searchsorted(lanes.file, np.arange(len(frames)))
    n = np.arange(len(lanes.file)) - first[lanes.file]  # number of a lane in its file
    whole = (np.full_like(units, restart) if restart else units)[lanes.file]
    begin = (np.cumsum(units) - units)[lanes.file] * each + n * whole * each  # its first block
    size = np.minimum(whole, units[lanes.file] - n * whole) * each
    live = np.flatnonzero(~lanes.bad[lanes.file] & (size > 0))
    if ss == 0:
        _dc_scan(lanes, live, begin, size, pattern, block, who, tables, ah, al, coefs)
    else:
        (_ac_refine if ah else _ac_first)(lanes, live, begin, size, block, tables[0][1], ss, se, al, coefs[who[0]])
    lanes.bad[lanes.file[lanes.at > lanes.end]] = True
    return lanes.bad


def _dc_scan(lanes, live, begin, size, pattern, block, who, tables, ah, al, coefs) -> None:
    if ah:  # a bit for each block
        n = size[live]
        lane = np.repeat(live, n)
        k = np.arange(len(lane)) - np.repeat(np.cumsum(n) - n, n)
        bits = lanes.peek(lanes.at[lane] + k, 1) << al
        lanes.at[live] += n
        at, j = block[begin[lane] + k], pattern[k % len(pattern)]
        for c, i in enumerate(who):
            own = j == c
            coefs[i][at[own], 0] |= bits[own].astype(coefs[i].dtype)
        return
    codes = [_lookup(d) for d, _ in tables]
    before = np.zeros((len(lanes.at), len(who)), dtype=np.int64)
    for k in range(int(size[live].max(initial=0))):
        live, j = live[size[live] > k], pattern[k % len(pattern)]
        before[live, j] += lanes.signed(live, np.minimum(lanes.symbol(live, codes[j]), 15))
        coefs[who[j]][block[begin[live] + k], 0] = before[live, j] << al


def _ac_first(lanes, live, begin, size, block, table, ss, se, al, z) -> None:
    codes = _lookup(table)
    pos, b, end, k = lanes.at[live], begin[live], begin[live] + size[live], np.full(len(live), ss)
    while len(live):
        x = codes[lanes.peek(pos, 16)]
        if not x.all():
            lanes.bad[lanes.file[live[x == 0]]] = True
        pos = pos + (x >> 8)
        r, s = (x & 255) >> 4, x & 15
        is_value = s > 0
        v = lanes.peek(pos, s)
        v = np.where(v >> np.maximum(s - 1, 0), v, v - (1 << s) + 1) << al
        at = k + r
        pos += s
        if (over := is_value & (at > se)).any():
            lanes.bad[lanes.file[live[over]]] = True
            at = np.minimum(at, se)
        if is_value.all():
            z[block[b], at] = v
            k = at + 1
        else:
            z[block[b[is_value]], at[is_value]] = v[is_value]
            run = ~is_value & (r < 15)
            k = np.where(run, ss, at + 1)
            n = r * run
            b = b + np.where(run, (1 << n) + lanes.peek(pos, n), 0)
            pos += n
        full = k > se
        if full.any():
            b, k = b + full, np.where(full, ss, k)
        done = b >= end
        if lanes.bad.any():
            done |= lanes.bad[lanes.file[live]]
        if done.any():
            lanes.at[live[done]] = pos[done]
            live, pos, b, end, k = (y[~done] for y in (live, pos, b, end, k))


def _ac_refine(lanes, live, begin, size, block, table, ss, se, al, z) -> None:
    codes, one = _lookup(table), 1 << al
    n = len(lanes.at)
    done, k, left = np.zeros(n, dtype=np.int64), np.full(n, ss), np.zeros(n, dtype=np.int64)
    place = np.arange(ss, se + 1)

    def corrected(own: np.ndarray, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """x with a bit read for each coefficient that isn't zero and inside."""
        some = inside & (x != 0)
        bits = np.where(some, lanes.peek(lanes.at[own][:, None] + np.cumsum(some, axis=1) - some, 1), 0)
        lanes.at[own] += some.sum(axis=1)
        return x + np.sign(x) * (bits * one).astype(x.dtype)

    while len(live):
        own = live[left[live] == 0]
        if len(own):
            rs = lanes.symbol(own, codes)
            r, s = rs >> 4, rs & 15
            ends = (s == 0) & (r < 15)
            left[own[ends]] = (1 << r[ends]) + lanes.take(own[ends], r[ends])
            own, r, s = own[~ends], r[~ends], s[~ends]
        if len(own):
            new = np.where(s > 0, np.where(lanes.take(own, np.minimum(s, 1)), one, -one), 0)
            at = block[begin[own] + done[own]]
            x = z[at, ss : se + 1]
            inside = place >= k[own][:, None]
            zero = inside & (x == 0)
            # the place after r zeros, which takes the new value; there may be none
            hit = zero & (np.cumsum(zero, axis=1) == r[:, None] + 1)
            stop = np.where(hit.any(axis=1), hit.argmax(axis=1), se + 1 - ss)
            x = corrected(own, x, inside & (place - ss < stop[:, None]))
            x[hit] = np.repeat(new, hit.sum(axis=1)).astype(x.dtype)
            z[at, ss : se + 1] = x
            k[own] = stop + ss + 1
            full = own[k[own] > se]
            done[full] += 1
            k[full] = ss
        own = live[(left[live] > 0) & (done[live] < size[live])]
        if len(own):
            at = block[begin[own] + done[own]]
            z[at, ss : se + 1] = corrected(own, z[at, ss : se + 1], place >= k[own][:, None])
            left[own] -= 1
            done[own] += 1
            k[own] = ss
        live = live[done[live] < size[live]]
        if lanes.bad.any():
            live = live[~lanes.bad[lanes.file[live]]]


def coefficients(frames: list[Frame]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of files of one script: the coefficients (block, place) of each component from all scans, blocks of one file after the other, by zigzag place; where each file's begin; and which files are broken."""
    sizes = [np.array([f.parts[c].cols * f.parts[c].rows for f in frames]) for c in range(len(frames[0].parts))]
    starts = [np.append(0, np.cumsum(n)) for n in sizes]
    out = [np.zeros((int(s[-1]), 64), dtype=np.int16) for s in starts]
    bad, maps = np.zeros(len(frames), dtype=bool), {}
    for i in range(len(frames[0].scans)):
        bad |= _run_scan(frames, i, out, starts, maps)
    return out, starts, bad


# --- the container's own files: a restart marker after each block, so they have many lanes

_DC = (bytes([0] * 7 + [1] + [0] * 8), b"\x08")  # one code of eight zero bits: size 8
_AC = (bytes([1] + [0] * 15), b"\x08")  # one code of one zero bit: no zeros skipped, size 8
_END = (bytes([1] + [0] * 15), b"\x00")  # one code of one zero bit: the band ends, what follows are corrections
_Y, _CB, _CR = range(3)


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(cls: int, ident: int, table: tuple) -> bytes:
    return _segment(0xC4, bytes([cls << 4 | ident]) + table[0] + table[1])


def _sos(parts: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p + 1, 0]) for p in parts) + bytes([ss, se, ah << 4 | al]))


_SCANS = [(_Y, 1, 5), (_Y, 6, 63), (_CB, 1, 63), (_CR, 1, 63)]


def _geometry(blocks: int) -> tuple[int, int]:
    """MCUs across and down for so many blocks; an MCU has four of luma and one of each chroma."""
    m = max(1, -(-blocks // 6))
    mw = min(m, 64) if m <= 4096 else min(4095, int(np.ceil(np.sqrt(m))))
    return mw, -(-m // mw)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as a progressive 4:2:0 file that holds it without loss.

    A byte b is a coefficient: 256 + b, or b - 510 for the first of a block. All first scans
    (one bit less) then have values of size 8 only, and refinement scans have one bit for each
    coefficient. Payloads of one geometry are coded together.
    """
    out: list[bytes] = [b""] * len(payloads)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(payloads):
        groups.setdefault(_geometry(len(p) // 64), []).append(i)
    for (mw, mh), own in groups.items():
        step = max(1, (1 << 13) // (mw * mh))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            for i, data in zip(part, _encode_group([payloads[i] for i in part], mw, mh), strict=True):
                out[i] = data
    return out


def _encode_group(payloads: list[bytes], mw: int, mh: int) -> list[bytes]:
    m = mw * mh
    b = np.zeros((len(payloads), m * 6 * 64), dtype=np.uint8)
    for i, p in enumerate(payloads):
        b[i, : len(p)] = np.frombuffer(p, dtype=np.uint8)
    b = b.reshape(len(payloads), m * 6, 64)
    parts = [b[:, : 4 * m], b[:, 4 * m : 5 * m], b[:, 5 * m :]]
    head = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64))
    frame = _segment(0xC2, bytes([8]) + (mh * 16).to_bytes(2, "big") + (mw * 16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    scans: list[tuple[bytes, list[bytes]]] = []
    for c in range(3):
        x = np.zeros((*parts[c].shape[:2], 2), dtype=np.uint8)
        x[:, :, 1] = ((parts[c][:, :, 0].astype(np.int16) - 510) >> 1) + 255
        scans.append((_sos([c], 0, 0, 0, 1), _coded(x)))
    for c, ss, se in _SCANS:
        v = parts[c][:, :, ss : se + 1]
        bits = np.ones((*v.shape, 9), dtype=np.uint8)
        bits[..., 0] = 0
        for k in range(7):
            bits[..., 2 + k] = (v >> (7 - k)) & 1
        scans.append((_sos([c], ss, se, 0, 1), _coded(_packed(bits.reshape(*v.shape[:2], -1)))))
    order = np.concatenate(_mcu_order(mw, mh), axis=1).reshape(-1)
    scans.append((_sos([0, 1, 2], 0, 0, 1, 0), _coded(_packed((b[:, order, 0] & 1).reshape(len(payloads), m, 6)))))
    for c in range(3):
        bits = parts[c] & 1
        bits[:, :, 0] = 0  # the code that ends the band
        scans.append((_sos([c], 1, 63, 1, 0), _coded(_packed(bits))))
    out = []
    for i, p in enumerate(payloads):
        one = [head, _segment(0xFE, b"bytes %d" % len(p)), frame, _dht(0, 0, _DC), _dht(1, 0, _AC), _segment(0xDD, b"\x00\x01")]
        for k, (sos, x) in enumerate(scans):
            if k == 8:
                one.append(_dht(1, 0, _END))
            one += [sos, x[i]]
        out.append(b"".join(one) + b"\xff\xd9")
    return out


def _mcu_order(mw: int, mh: int) -> list[np.ndarray]:
    """The numbers of an MCU's blocks, in luma, then both chroma components, one row for each MCU."""
    m = mw * mh
    return [np.arange(4 * m).reshape(mh, 2, mw, 2).transpose(0, 2, 1, 3).reshape(m, 4), np.arange(4 * m, 5 * m)[:, None], np.arange(5 * m, 6 * m)[:, None]]


def _coded(x: np.ndarray) -> list[bytes]:
    """Each file's bytes (file, unit, byte), with zeros after bytes of ones and restart markers between units."""
    files, units, n = x.shape
    x = x.reshape(-1)
    ones = x == 0xFF
    at = np.arange(len(x)) + np.cumsum(ones) - ones + 2 * (np.arange(len(x)) // n)
    out = np.zeros(len(x) + int(ones.sum()) + 2 * files * units, dtype=np.uint8)
    out[at] = x
    end = at[n - 1 :: n] + 1 + ones[n - 1 :: n]
    out[end] = 0xFF
    out[end + 1] = 0xD0 + np.tile(np.arange(units) % 8, files)
    cut = end[units - 1 :: units]
    return [out[a:b].tobytes() for a, b in zip(np.concatenate([[0], cut[:-1] + 2]).tolist(), cut.tolist(), strict=True)]


def _packed(bits: np.ndarray) -> np.ndarray:
    """The last axis' bits as bytes, filled up with ones."""
    if short := -bits.shape[-1] % 8:
        bits = np.concatenate([bits, np.ones((*bits.shape[:-1], short), dtype=np.uint8)], axis=-1)
    return np.packbits(bits, axis=-1)


#: The inverse cosine transform by rows, scaled by 2^11 and rounded: whole numbers in doubles, so sums are exact in any order.
_IDCT = np.round(np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.5), 1.0) / 2 * 2048)


def _samples(coefs: np.ndarray, quant: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Samples (file, height, width) of coefficients (file, block, place)."""
    d = len(coefs)
    place = np.zeros((d * rows * cols, 64))
    place[:, ZIGZAG] = (coefs * quant).reshape(-1, 64)
    x = np.floor(place.reshape(-1, 8, 8) @ _IDCT.T / 256)
    x = np.floor((_IDCT @ x) / (1 << 14) + 128.5)
    return np.clip(x, 0, 255).astype(np.uint8).reshape(d, rows, cols, 8, 8).transpose(0, 1, 3, 2, 4).reshape(d, rows * 8, cols * 8)


def pixels(f: Frame, coefs: list[np.ndarray]) -> np.ndarray:
    """RGB tensors (file, height, width, 3) of the coefficients of files of one size; chroma is repeated up to full resolution."""
    planes = []
    for c, z in zip(f.parts, coefs, strict=True):
        x = _samples(z.reshape(-1, c.rows * c.cols, 64), f.quant[c.table], c.rows, c.cols)
        planes.append(x.repeat(f.v // c.v, axis=1).repeat(f.h // c.h, axis=2)[:, : f.height, : f.width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=3)
    y, cb, cr = planes[0].astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((*y.shape, 3), dtype=np.uint8)
    half = 1 << 15
    for k, v in enumerate((y + ((91881 * cr + half) >> 16), y - ((22554 * cb + 46802 * cr + half) >> 16), y + ((116130 * cb + half) >> 16))):
        out[..., k] = np.clip(v, 0, 255)
    return out


def decode(files: list[bytes], group: int = 1 << 13):
    """For each file that can be read, in groups of one size: (numbers of the files, frames, coefficients (file, block, place), RGB tensors). Last: (numbers of broken files, None, None, None)."""
    broken, scripts, frames = [], {}, {}
    for i, x in enumerate(files):
        try:
            frames[i] = f = Frame(x)
            f.check()
            scripts.setdefault(f.script(), []).append(i)
        except (ValueError, IndexError, KeyError, AttributeError, StopIteration, ZeroDivisionError):
            broken.append(i)
    for own in scripts.values():
        part, n = [], 0
        for i in [*own, None]:
            size = 0 if i is None else frames[i].mw * frames[i].mh
            if part and (i is None or n + size > group):
                yield from _decoded(part, frames, broken)
                part, n = [], 0
            part, n = [*part, i], n + size
    yield broken, None, None, None


def _decoded(part: list[int], frames: dict[int, Frame], broken: list[int]):
    try:
        z, starts, bad = coefficients([frames[i] for i in part])
    except ValueError:  # a bad table, which all of this script have
        broken += part
        return
    broken += [i for i, b in zip(part, bad.tolist(), strict=True) if b]
    by: dict[tuple, list[int]] = {}
    for k, i in enumerate(part):
        if not bad[k]:
            by.setdefault((frames[i].width, frames[i].height), []).append(k)
    for own in by.values():
        same = [np.stack([c[s[k] : s[k + 1]] for k in own]) for c, s in zip(z, starts, strict=True)]
        yield [part[k] for k in own], [frames[part[k]] for k in own], same, pixels(frames[part[own[0]]], same)


def payload(frame: Frame, coefs: list[np.ndarray]) -> bytes | None:
    """The bytes that encode() stored, from the coefficients (block, place) of a file; None if its comment tells of none."""
    m = re.fullmatch(rb"bytes (\d+)", frame.comment)
    if not m or int(m[1]) > 64 * sum(map(len, coefs)):
        return None
    n = int(m[1])
    z = np.concatenate(coefs, axis=0)
    b = (z - 256).astype(np.uint8)
    b[:, 0] = (z[:, 0] + 510).astype(np.uint8)
    return b.reshape(-1)[:n].tobytes()
