"""The decoder against files that a plain encoder, written for these tests alone, makes symbol by symbol."""

import random

import numpy as np
import pytest

from runloom.llm import jpeg, media

ZIG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def bits_of(v, n):
    return [(v >> (n - 1 - i)) & 1 for i in range(n)] if n else []


def value_bits(v):
    n = abs(v).bit_length()
    return n, bits_of(v if v > 0 else v + (1 << n) - 1, n)


def shifted(v, al):
    return abs(v) >> al if v >= 0 else -(abs(v) >> al)


def symbols_of(blocks, pred_of, ss, se, ah, al):
    """The scan's blocks, in order, as a list of (symbol or None, bits)."""
    out, pred, run, tail = [], {}, 0, []

    def end_of_bands():
        nonlocal run, tail
        if run:
            r = run.bit_length() - 1
            out.append((r << 4, bits_of(run - (1 << r), r) + tail))
        run, tail = 0, []

    for z, who in zip(blocks, pred_of, strict=True):
        if ss == 0:
            if ah:
                out.append((None, [(int(z[0]) >> al) & 1]))
            else:
                v = int(z[0]) >> al
                n, b = value_bits(v - pred.get(who, 0))
                pred[who] = v
                out.append((n, b))
            continue
        v = [shifted(int(x), al) for x in z]
        if not ah:
            zeros = 0
            for k in range(ss, se + 1):
                if not v[k]:
                    zeros += 1
                    continue
                end_of_bands()
                while zeros > 15:
                    out.append((0xF0, []))
                    zeros -= 16
                n, b = value_bits(v[k])
                out.append((zeros << 4 | n, b))
                zeros = 0
            if zeros:
                run += 1
                if run == 0x7FFF:
                    end_of_bands()
            continue
        last = max((k for k in range(ss, se + 1) if abs(v[k]) == 1), default=-1)
        zeros, pending = 0, []
        for k in range(ss, se + 1):
            if not v[k]:
                zeros += 1
                continue
            while zeros > 15 and k <= last:
                end_of_bands()
                out.append((0xF0, pending))
                pending, zeros = [], zeros - 16
            if abs(v[k]) > 1:
                pending.append(abs(v[k]) & 1)
                continue
            end_of_bands()
            out.append((zeros << 4 | 1, [int(v[k] > 0), *pending]))
            zeros, pending = 0, []
        if zeros or pending:
            run, tail = run + 1, tail + pending
            if run == 0x7FFF or len(tail) > 900:
                end_of_bands()
    end_of_bands()
    return out


def codes_of(used):
    """Lengths for the symbols: one of 2 bits, two of 3, four of 5, the rest of 10. All ones is no code."""
    lengths = [2, 3, 3, 5, 5, 5, 5] + [10] * 300
    counts, codes, code, before = [0] * 16, {}, 0, 0
    for s, n in zip(used, lengths, strict=False):
        code <<= n - before
        codes[s], before = (code, n), n
        counts[n - 1] += 1
        code += 1
    return bytes(counts), codes


def packed(bits):
    bits = bits + [1] * (-len(bits) % 8)
    return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def seg(kind, body):
    return bytes([255, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def plain_file(width, height, sampling, coefs, quant, script, restart):
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    mw, mh = -(-width // (8 * hm)), -(-height // (8 * vm))
    out = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes(int(quant[i]) for i in range(64)))
    out += seg(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    if restart:
        out += seg(0xDD, restart.to_bytes(2, "big"))
    for comps, ss, se, ah, al in script:
        if len(comps) > 1:
            mcus = [[(c, (my * sampling[c][1] + y) * mw * sampling[c][0] + mx * sampling[c][0] + x) for c in comps for y in range(sampling[c][1]) for x in range(sampling[c][0])] for my in range(mh) for mx in range(mw)]
        else:
            (c,), (h, v) = comps, sampling[comps[0]]
            bw, bh = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
            mcus = [[(c, y * mw * h + x)] for y in range(bh) for x in range(bw)]
        parts = [mcus[i : i + restart] for i in range(0, len(mcus), restart)] if restart else [mcus]
        coded = [symbols_of([coefs[c][b] for m in p for c, b in m], [c for m in p for c, _ in m], ss, se, ah, al) for p in parts]
        used = sorted({s for p in coded for s, _ in p if s is not None}, key=lambda s: -sum(x == s for p in coded for x, _ in p))
        counts, codes = codes_of(used)
        if used:
            out += seg(0xC4, bytes([(ss > 0) << 4]) + counts + bytes(used))
        out += seg(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([ss, se, ah << 4 | al]))
        data = [packed([b for s, extra in p for b in [*(bits_of(*codes[s]) if s is not None else []), *extra]]) for p in coded]
        out += b"".join(d + (bytes([255, 0xD0 + i % 8]) if i + 1 < len(data) else b"") for i, d in enumerate(data))
    return out + b"\xff\xd9"


def plain_pixels(width, height, sampling, coefs, quant):
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    mw = -(-width // (8 * hm))
    i = np.arange(8)
    basis = np.cos((2 * i[:, None] + 1) * i[None, :] * np.pi / 16) * np.where(i == 0, np.sqrt(0.5), 1) / 2
    planes = []
    for (h, v), zs in zip(sampling, coefs, strict=True):
        cols = mw * h
        plane = np.zeros((len(zs) // cols * 8, cols * 8))
        for b, z in enumerate(zs):
            f = np.zeros(64)
            f[ZIG] = z * quant
            x = basis @ f.reshape(8, 8) @ basis.T + 128
            plane[b // cols * 8 : b // cols * 8 + 8, b % cols * 8 : b % cols * 8 + 8] = np.clip(np.round(x), 0, 255)
        planes.append(np.array([[plane[y * v // vm, x * h // hm] for x in range(width)] for y in range(height)]))
    if len(planes) == 1:
        return np.stack(planes * 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)


FULL = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0)]
GREY = [((0,), 0, 0, 0, 2), ((0,), 0, 0, 2, 1), ((0,), 1, 30, 0, 1), ((0,), 31, 63, 0, 0), ((0,), 1, 30, 1, 0), ((0,), 0, 0, 1, 0)]
CASES = [(37, 21, [(2, 2), (1, 1), (1, 1)], FULL, 0), (40, 9, [(1, 1)] * 3, FULL, 3), (33, 18, [(2, 1), (1, 1), (1, 1)], FULL, 1), (19, 30, [(1, 1)], GREY, 0), (70, 33, [(1, 1)], GREY, 4), (17, 17, [(1, 2), (1, 1), (1, 1)], FULL, 2)]


def picture(rng, width, height, sampling, dense):
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    n = -(-width // (8 * hm)) * -(-height // (8 * vm))
    out = []
    for h, v in sampling:
        z = np.zeros((n * h * v, 64), dtype=int)
        for b in z:
            b[0] = rng.randint(-60, 60)
            for k in range(1, 64):
                if rng.random() < dense:
                    b[k] = rng.choice([-1, 1]) * rng.choice([1, 1, 1, 2, 3, 7, 12])
        out.append(z)
    return out


def visible(width, height, sampling, coefs, script):
    """Blocks beyond the picture's own are coded in scans of several components only."""
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    mw = -(-width // (8 * hm))
    out = []
    for (h, v), z in zip(sampling, coefs, strict=True):
        z, cols = z.copy(), mw * h
        bw, bh = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
        for b in range(len(z)):
            if b % cols >= bw or b // cols >= bh:
                z[b, 1:] = 0
                if len(sampling) == 1:
                    z[b] = 0
        out.append(z)
    return out


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("dense", [0.0, 0.03, 0.5])
def test_decoder_against_a_plain_encoder(case, dense):
    width, height, sampling, script, restart = CASES[case]
    rng = random.Random(case)
    quant = np.array([1 + k // 16 for k in range(64)])
    pictures = [picture(rng, width, height, sampling, d) for d in (dense, dense / 2, 0.9)]
    files = [plain_file(width, height, sampling, p, quant, script, restart) for p in pictures]
    seen = {}
    for part, _frames, z, rgb in jpeg.decode(files):
        for k, i in enumerate(part):
            seen[i] = None if rgb is None else ([c[k] for c in z], rgb[k])
    for i, p in enumerate(pictures):
        want = visible(width, height, sampling, p, script)
        assert all((a == b).all() for a, b in zip(seen[i][0], want, strict=True))
        plain = plain_pixels(width, height, sampling, want, quant)
        assert seen[i][1].shape == (height, width, 3) and np.abs(seen[i][1].astype(float) - plain).max() <= 3.5  # samples may differ by 1: 1 + 1.772 + 0.5
        assert np.abs(seen[i][1].astype(float) - plain).mean() < 0.6


def test_long_runs_of_blocks():
    width, height, rng = 8 * 300, 8 * 200, random.Random(1)  # 60,000 blocks: more than one run of ends may count
    z = np.zeros((300 * 200, 64), dtype=int)
    for b in rng.sample(range(len(z)), 50):
        z[b, rng.randrange(1, 64)] = rng.choice([-5, 1, 3])
    file = plain_file(width, height, [(1, 1)], [z], np.ones(64, dtype=int), GREY, 0)
    got = [x for x in jpeg.decode([file]) if x[1]]
    assert (got[0][2][0][0] == z).all()


def test_own_files_and_broken_ones(spark):
    rng = random.Random(5)
    for n in (64, 128, 64 * 7, 64 * 100, 64 * 3000):
        p = bytes(rng.choice([rng.randrange(256), 255, 0]) for _ in range(n))
        data = jpeg.encode([p, p[::-1]])
        part, frames, z, _ = next(jpeg.decode(data))
        assert part == [0, 1] and [jpeg.payload(frames[k], [c[k] for c in z]) for k in part] == [p, p[::-1]]
    good = jpeg.encode([b"abc" + bytes(61)])[0]
    wrong = [b"", b"\xff\xd8", b"GIF89a", good[:100], good[:-40] + b"\xff\xd9", good.replace(b"\xff\xc2", b"\xff\xc0"), good[:200] + b"\xff\xd3" + good[200:], good.replace(b"\xff\xc4\x00\x14\x10", b"\xff\xc4\x00\x14\x11")]
    rows = [(i, x, "c") for i, x in enumerate([good, None, *wrong, good])] + [(None, good, "c")]
    df = spark.createDataFrame(rows, "doc_id long, media binary, rgb string")
    out = media.read(df).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and got[0].error is None and got[0].payload_bytes == 64 and got[0].feature == got[len(rows) - 2].feature == got[None].feature
    assert got[1].media_bytes is None and got[1].error is None and got[2].error is None
    for i in range(3, 2 + len(wrong)):
        assert got[i].error and got[i].rgb is None and got[i].feature is None and got[i].media_bytes == len(wrong[i - 2]), i
    assert media.read(df.limit(0)).count() == 0
