import hashlib
import random
import struct
import zlib
from fractions import Fraction

from sieveline.llm import media_mpeg as m


def test_round_trip():
    r = random.Random(1)
    for n in (1, 64, 1417, 1418, 5000):
        for data in (r.randbytes(n), b"\xff\xfb\x90\x00" * n, bytes(n)):
            s = m.decode(m.encode(data))
            assert m.payload_of(s) == data
            assert s["crc_bad"] == s["skipped"] == 0 and s["crc_good"] == len(s["offsets"]) + 1


def test_table_and_duration():
    e = m.encode(b"x" * 10_000)
    s = m.decode(e)
    assert s["table"]["frames"] == len(s["offsets"]) and len(s["table"]["toc"]) == 100
    assert s["duration"] == Fraction(1152 * len(s["offsets"]), 32000)
    assert all(m.header(e, at) for at in s["offsets"])
    assert len(e) == s["offsets"][-1] + m.header(e, s["offsets"][-1])[0]


def test_resynchronises_and_counts_damage():
    e = m.encode(bytes(range(250)) * 60)
    starts = m.decode(e)["offsets"]
    damaged = e[: starts[3]] + b"\xff\xfbjunk\xff" + e[starts[3] :]
    s = m.decode(damaged)
    assert s["resyncs"] == 1 and s["skipped"] == 7 and len(s["offsets"]) == len(starts)
    flipped = bytearray(e)
    flipped[starts[2] + 8] ^= 1
    assert m.decode(bytes(flipped))["crc_bad"] == 1
    assert m.decode(b"no audio at all")["offsets"] == [] and m.decode(b"")["duration"] == 0


def test_foreign_tags_and_tables():
    frames = m.encode(b"y" * 3000)
    frames = frames[frames.index(b"\xff\xfa") :]
    v1 = b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + bytes(65)
    s = m.decode(b"ID3\x04\0\0" + m.synchsafe(0) + frames + v1)
    assert s["fields"]["TIT2"] == "Title" and s["table"]["kind"] == "Xing"
    head = frames[:4]
    vbri = head[:1] + bytes([head[1] | 1]) + head[2:4]
    size = m.header(vbri, 0)[0]
    first = (vbri + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 9, 999, 7, 2, 1, 2, 3) + struct.pack(">HH", 10, 20)).ljust(size, b"\0")
    t = m.read_table_frame(first, 0, m.header(first, 0))
    assert t["kind"] == "VBRI" and t["frames"] == 7 and t["toc"] == [10, 20]


def divided(bits):
    """The checksum by long division, from the standard's shift register."""
    c = 0xFFFF
    for b in bits:
        c = (c << 1) & 0xFFFF ^ (0x8005 if c >> 15 ^ int(b) else 0)
    return c


def frame_of(version, layer, kbits, rate, mode, extension, body):
    """A protected frame with a checksum over `covered` leading bits of a body of bits, given by its layout."""
    head = (0x7FF << 21 | version << 19 | (4 - layer) << 17 | kbits << 12 | rate << 10 | mode << 6 | extension << 4).to_bytes(4, "big")
    covered, bits = body
    length = m.header(head, 0)[0]
    bits = bits.ljust(8 * (length - 6), "0")
    crc = divided(f"{int.from_bytes(head[2:], 'big'):016b}" + bits[:covered])
    return head + struct.pack(">H", crc) + int(bits, 2).to_bytes(length - 6, "big")


def test_checksums_of_layers_one_and_two():
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("01") for _ in range(n))
    frames = []
    for mode, ext, n in ((3, 0, 128), (0, 0, 256), (1, 0, 144), (1, 3, 192)):  # mono, stereo, joint with bounds 4 and 16
        frames.append(frame_of(3, 1, 9, 1, mode, ext, (n, noise(1000))))
    # Layer II, mono, 32 kbit/s at 32 kHz: 12 subbands of 4, 4 and ten times 3 bits; three are allocated.
    frames.append(frame_of(3, 2, 1, 2, 3, 0, (38 + 6, "0001" + "0000" + "101" + "000" * 8 + "001" + noise(200))))
    # Stereo, 192 kbit/s at 44.1 kHz: 30 subbands, all of one channel allocated.
    widths = [4] * 11 + [3] * 12 + [2] * 7
    frames.append(frame_of(3, 2, 10, 0, 0, 0, (2 * sum(widths) + 60, "".join("1" * w + "0" * w for w in widths) + noise(400))))
    # Joint stereo with bound 4 at 48 kHz: 27 subbands; the shared ones count for both channels.
    widths = widths[:27]
    frames.append(frame_of(3, 2, 10, 1, 1, 0, (sum(widths) + sum(widths[:4]) + 2 * 54, "".join("1" * w * (2 if i < 4 else 1) for i, w in enumerate(widths)) + noise(400))))
    # MPEG-2, mono: 30 subbands of 4, 3 and 2 bits, none allocated.
    frames.append(frame_of(2, 2, 8, 0, 3, 0, (75, "0" * 75 + noise(200))))
    for f in frames:
        s = m.decode(f * 3)
        assert (s["crc_good"], s["crc_bad"], len(s["offsets"])) == (3, 0, 3), f[:4].hex()
        broken = bytearray(f * 3)
        broken[len(f) + 6] ^= 64
        s = m.decode(bytes(broken))
        assert (s["crc_good"], s["crc_bad"]) == (2, 1), f[:4].hex()


def test_delay_and_padding_are_no_part_of_the_duration():
    e = m.encode(b"z" * 9000)
    at = e.index(b"Xing")
    size = m.header(e, e.index(b"\xff\xfa"))[0]
    plain = m.decode(e)
    frame = e.index(b"\xff\xfa")
    room = next(i for i in sorted(m.FRAMES) if m.FRAMES[i][0] - m.WRITE_HEAD >= 140)
    length, head = m.FRAMES[room]
    table = (head + e[at : at + 116] + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")).ljust(length, b"\0")
    s = m.decode(e[:frame] + table + e[frame + size :])
    assert s["table"]["encoder"] == "LAME3.100" and (s["table"]["delay"], s["table"]["padding"]) == (576, 1000)
    assert s["duration"] == plain["duration"] - Fraction(1576, 32000) and s["samples"] == plain["samples"]


def test_column(odd_docs, odd_rows, no_docs):
    got = sorted(map(tuple, m.store(odd_docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()), key=repr)
    want = []
    for i, t in odd_rows:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want, key=repr)
    assert m.store(no_docs).count() == 0
