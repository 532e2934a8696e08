import hashlib
import random
import zlib

from tandemrank.llm.media import crc16, encode, header_of, pad, payload_of, probe, probe_media, store_texts


def test_round_trip_sizes_and_sync_like_bytes():
    r = random.Random(1)
    for n in (0, 1, 575, 576, 577, 1152, 1153, 5000, 70000):
        data = bytes(r.choice((0xFF, 0xFA, 0xFB, 0xE8, 0xA8, 0xC0, 65)) for _ in range(n))
        stored = encode(pad(data))
        s = probe(stored)
        assert payload_of(stored, s) == pad(data)
        assert (s.bad, s.resyncs, s.skipped, s.table_true, s.tag1) == (0, 0, 0, True, True)
        assert s.samples == 1152 * len(s.seek) and s.checked == len(s.seek) and s.title == "payload"
        assert all(header_of(stored[a : a + 4]) for a in s.seek)


def test_kinds_of_table():
    assert probe(encode(b"a" * 576)).table == "Info" and probe(encode(b"a" * 576 * 3)).table == "Xing"


def test_resynchronises_after_junk_and_damage():
    clean = encode(b"xy" * 576 * 5)
    whole = probe(clean)
    at = whole.seek[2]
    dirty = clean[:at] + b"\xff\xfa\xe8junk" * 9 + clean[at:]
    s = probe(dirty)
    assert s.resyncs == 1 and s.skipped == 63 and payload_of(dirty, s) == payload_of(clean, whole) and not s.table_true
    hurt = bytearray(clean)
    hurt[at + 10] ^= 1
    assert probe(bytes(hurt)).bad == 1
    cut = probe(clean[: at + 100])
    assert len(cut.seek) == 2 and probe(b"").seek == [] and probe(b"\xff" * 500).seek == []


def test_tables_that_do_not_fit_their_frame_are_none():
    low = b"\xff\xf3\x14\xc0"  # 24 bytes of version 2
    assert header_of(low).length == 24
    assert probe(low + bytes(9) + b"Xing" + b"\0\0\0\1" + bytes(3)).table is None
    longer = b"\xff\xf3\x24\xc0"
    n = header_of(longer).length
    assert n < 54 and probe((longer + bytes(32) + b"VBRI" + bytes(60))[:n]).table is None


def test_damaged_streams_never_fail():
    r = random.Random(5)
    clean = encode(b"abc" * 576)
    heads = [bytes((0xFF, r.randrange(0xE0, 256), r.randrange(256), r.randrange(256))) for _ in range(300)]
    for k in range(1500):
        bad = bytearray(clean if k % 2 else b"ID3\x03\x00\x00\0\0\0\x14TIT2" + bytes(r.randrange(256) for _ in range(40)))
        for _ in range(r.randrange(1, 6)):
            at = r.randrange(len(bad))
            put = r.choice([*heads[:50], b"Xing\0\0\0\3", b"Info\0\0\0\xff", b"VBRI", b"TAG", b"ID3\x04\0\0\0\0\0\x7f", bytes([r.randrange(256)])])
            bad[at : at + len(put)] = put
        bad = bytes(bad[: r.randrange(len(bad) + 1)])
        s = probe(bad)
        assert all(0 <= a < len(bad) for a in s.seek)
    for h in heads:
        for cut in range(0, 80, 3):
            for mark in (b"Xing\0\0\0\3", b"VBRI"):
                probe((h + bytes(r.choice((9, 13, 17, 21, 32, 36))) + mark + bytes(40))[: cut + 4])


def test_known_headers_and_checksum():
    h = header_of(b"\xff\xfb\x90\x00")
    assert (h.kbits, h.rate, h.length, h.samples, h.side, h.protected) == (128, 44100, 417, 1152, 32, False)
    assert header_of(b"\xff\xf3\x40\xc0").length == 72 * 32000 // 22050 and header_of(b"\xff\xfd\x80\x00").length == 144 * 128000 // 44100
    assert header_of(b"\xff\xff\x10\xc0").length == 12 * 32000 // 44100 * 4
    for bad in (b"\xff\xe8\x90\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xfe\xfb\x90\x00", b"\xff"):
        assert header_of(bad) is None
    assert crc16(b"123456789") == 0xAEE7


def test_table_of_texts(docs, spark):
    rows = [(1, None), (2, ""), (3, "é" * 400), (3, "é" * 400), (None, "x" * 200_000)]
    got = {(r.doc_id, r.n_bytes): r for r in probe_media(store_texts(docs(rows))).collect()}
    assert len(got) == 4
    for (_, n), r in got.items():
        text = {0: b"", 800: ("é" * 400).encode(), 200_000: b"x" * 200_000}[n]
        assert r.payload_sha256 == hashlib.sha256(pad(text)).hexdigest() and r.tail_crc32 == zlib.crc32(pad(text)[-32:])
        assert r.payload_bytes == len(pad(text)) and r.samples == 1152 * len(r.seek)
    assert probe_media(store_texts(docs([]))).count() == 0
    bare = spark.createDataFrame([(1, 0, None)], "doc_id bigint, n_bytes bigint, media binary")
    assert probe_media(bare).first().payload_bytes == 0
