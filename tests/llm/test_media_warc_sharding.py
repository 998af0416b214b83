import gzip
import hashlib
import heapq
import io
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from loamdex.llm import decontaminate as decontaminate_module, media, sharding, warc
from loamdex.llm.decontaminate import contamination, decontaminate, words_of
from loamdex.llm.registry import OP5_SQL

from .util import AWKWARD, docs


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_audio_round_trip(raw):
    data = media.encode(raw)
    found = media.probe(data)
    padded, n = media.decode(data, found)
    assert n == len(raw) and padded == raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
    frames = len(padded) // 576
    assert found["crc_bad"] == 0 and found["crc_good"] == frames and found["skipped"] == 0
    assert found["duration_us"] == frames * 36_000 and found["vbr"]["frames"] == frames


def test_audio_resynchronises_and_notices_damage():
    data = bytearray(media.encode(bytes(range(256)) * 20))
    whole = media.probe(bytes(data))
    third = whole["frames"][2][0]
    data[third + 6] ^= 1  # side information under the checksum
    broken = bytes(data[: whole["frames"][4][0]]) + b"noise\xff\xf2" + bytes(data[whole["frames"][4][0] :])
    found = media.probe(broken)
    assert found["crc_bad"] == 1 and found["skipped"] == 7 and len(found["frames"]) == len(whole["frames"])
    assert media.probe(b"")["frames"] == [] and media.probe(b"\xff\xf2")["frames"] == []


def test_audio_headers_of_other_layers():
    assert media.header(bytes([0xFF, 0xFB, 0x90, 0x00]))["length"] == 417  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz
    assert media.header(bytes([0xFF, 0xFF, 0x14, 0x00]))["length"] == 32  # MPEG-1 layer I, 32 kbit/s, 48 kHz
    assert media.header(bytes([0xFF, 0xEB, 0x90, 0x00])) is None


def protect(frame, bits):
    """The frame with its checksum over the header's last two bytes and so many bits."""
    value = 0xFFFF
    for i in [*range(16, 32), *range(48, 48 + bits)]:
        top = value >> 15 ^ frame[i // 8] >> 7 - i % 8 & 1
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return frame[:4] + bytes([value >> 8, value & 255]) + frame[6:]


@pytest.mark.parametrize(
    "head, body, bits",
    [
        ("FFFEB400", b"", 256),  # layer I, stereo
        ("FFFEB4C0", b"", 128),  # mono
        ("FFFEB460", b"", 4 * (2 * 12 + 20)),  # joint stereo, bound 12
        ("FFFC84C0", b"\xff" * 26, 11 * 4 + 12 * 3 + 4 * 2 + 27 * 2),  # layer II, 160 kbit/s mono at 48 kHz: 27 subbands, all in use
        ("FFFC84C0", b"\x00" * 26, 11 * 4 + 12 * 3 + 4 * 2),  # none in use
        ("FFFC18C0", b"\xff" * 26, 2 * 4 + 10 * 3 + 12 * 2),  # 32 kbit/s mono at 32 kHz: 12 subbands
        ("FFFCA000", b"\xff" * 60, 2 * (11 * 4 + 12 * 3 + 7 * 2) + 60 * 2),  # 224 kbit/s stereo at 44.1 kHz: 30 subbands
        ("FFF48400", b"\xff" * 60, 2 * (4 * 4 + 7 * 3 + 19 * 2) + 60 * 2),  # MPEG-2
    ],
)
def test_checksums_of_layers_one_and_two(head, body, bits):
    head = bytes.fromhex(head)
    h = media.header(head)
    frame = protect((head + b"\0\0" + body).ljust(h["length"], b"\xa5" if not body else b"\x5a"), bits)
    assert len(frame) == h["length"] and media.crc_ok(frame, h)
    found = media.probe(frame * 3)
    assert (found["crc_good"], found["crc_bad"], len(found["frames"]), found["layer"]) == (3, 0, 3, h["layer"])
    damaged = bytearray(frame * 3)
    damaged[6 + (bits - 1) // 8] ^= 0x80 >> (bits - 1) % 8
    assert media.probe(bytes(damaged))["crc_bad"] >= 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=40), st.sampled_from([bytes.fromhex(x) for x in ("FFF2D8C4", "FFFB9000", "FFFF1400", "FFFC84C0", "FFF30800", "494433030000")] + [b"Xing", b"Info", b"VBRI", b"TAG", b"TXXX", b"\0" * 9, b"\0" * 32, b"\xff" * 8])), max_size=12))
def test_probe_never_raises(parts):
    data = b"".join(parts)
    found = media.probe(data)
    media.decode(data, found)
    assert sum(n for _, n in found["frames"]) <= len(data)


def test_tables_and_tags_cut_short(spark):
    streams = [bytes.fromhex("FFF308C4") + b"\0" * 9 + b"Xing" + b"\0" * 7, bytes.fromhex("FFF318C4").ljust(36, b"\0") + b"VBRI" + b"\xff" * 8]
    text = b"\0n_bytes\0many"
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    streams += [b"ID3\x03\0\0" + bytes([0, 0, 0, len(tag)]) + tag, b"ID3", b"", None]
    rows = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(streams)], "doc_id long, media binary")
    got = media.audio_features(rows).collect()
    assert len(got) == len(streams) and {r.n_bytes for r in got} == {None}


def test_audio_query(spark):
    rows = media.audio_features(media.stored_audio(docs(spark, AWKWARD))).collect()
    assert media.audio_features(media.stored_audio(docs(spark, AWKWARD).limit(0))).count() == 0
    want = defaultdict(list)
    for i, t in AWKWARD:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want[i].append((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32))
    assert got == want


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


PAGES = [(5, "http://a/", "x" * 100), (3, "http://b/ c", "x" * 100), (4, None, "x" * 99), (1, "u", "x" * 99), (2, "v", None), (6, "w", ""), (7, "é", "é\r\n\r\n" * 40_000), (8, "z", "é\r\n\r\n" * 40_000), (3, "again", "x" * 100)]


@pytest.mark.parametrize("broadcast", [10, 1])
def test_warc_round_trip(spark, broadcast):
    got = sorted(tuple(r) for r in warc.archive(pages(spark, PAGES), chunk_bytes=1000, broadcast=broadcast).collect())
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        first = min(j for j, _, x in PAGES if (x or "") == (h or ""))
        revisit = len(raw) >= 100 and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=lambda x: x[:4])
    assert warc.archive(pages(spark, PAGES).limit(0)).count() == 0


def test_revisits_are_held_against_their_responses(spark):
    rows = [(1, 200, "d", "response", None), (2, 200, "d", "revisit", 1), (3, 200, "e", "revisit", 1), (4, 7, "d", "revisit", 1), (5, 200, "d", "revisit", 2)]
    records = spark.createDataFrame(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    assert sorted(map(tuple, warc.mismatched(records).collect())) == [(1, "d", 7), (1, "e", 200), (2, "d", 200)]


def test_warc_files(spark, tmp_path):
    rows = warc.write_records(pages(spark, PAGES), chunk_bytes=700).orderBy("record", "chunk_no").collect()
    assert max(len(r.data) for r in rows) < 2000
    n = warc.export(((r.record, bytes(r.data)) for r in rows), str(tmp_path / "a.warc.gz"))
    assert n == len(PAGES)
    with gzip.open(tmp_path / "a.warc.gz") as f:
        again = list(warc.read_file(f, 500))
    back = warc.read_records(spark.createDataFrame(again, "record long, chunk_no int, last boolean, data binary, payload_sha256 string"))
    assert sorted(map(str, back.collect())) == sorted(map(str, warc.archive(pages(spark, PAGES)).collect()))
    with pytest.raises(ValueError):
        list(warc.read_file(io.BytesIO(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort")))


def plain_heap(sizes, shards):
    """Loads of LPT by a heap of (load, shard), group by group."""
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.integers(1, 300)), max_size=8, unique_by=lambda x: x[0]), st.integers(1, 7))
def test_schedule_equals_a_plain_heap(classes, shards):
    schedule, loads = sharding.Schedule(shards), [0] * shards
    for size, n in sorted(classes, reverse=True):
        dealt = schedule.deal(size, n)
        assert sum(k for _, k in dealt) == n
        for s, k in dealt:
            loads[s] += size * k
    assert loads == plain_heap([size for size, n in classes for _ in range(n)], shards)


def test_shard(spark):
    rows = [*AWKWARD, *((100 + i, f"text {i % 37} " * (i % 11 + 1)) for i in range(400))]
    got = sharding.shard(docs(spark, rows), shards=5).collect()
    assert len(got) == len(rows)
    where, slots = defaultdict(set), defaultdict(list)
    size = {i: len((t or "").encode()) + 16 for i, t in rows}
    text = {i: t or "" for i, t in rows}
    for r in got:
        where[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r.size == size[r.doc_id] and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs(spark, rows).limit(0)).count() == 0


def test_shard_with_many_sizes_equals_a_plain_heap(spark):
    sizes = [*range(1, 5601), *[40] * 300, *[9000] * 3]
    rows = [(i, f"{i:x}".ljust(n, "-")) for i, n in enumerate(sizes)]
    copies = [(10_000 + i, "a hot text") for i in range(2500)]
    loads = defaultdict(int)
    for r in sharding.shard(docs(spark, rows + copies), shards=7).collect():
        loads[r.shard] += r.size
    groups = [len(t) + 16 for _, t in rows] + [26 * 2500]
    assert [loads[s] for s in range(7)] == plain_heap(groups, 7)


def brute(text, items, width=10):
    words = words_of((text or "").encode())
    hit, own = set(), set()
    for i, t in items:
        w = words_of((t or "").encode())
        n = min(width, len(w))
        for a in range(len(w) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[a : a + n]:
                    hit |= set(range(p, p + n))
                    own.add(str(i))
    return len(words), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)


BENCH = [(10, "one two three"), (9, "A b c d e f g h i j k l, ÉTÉ été"), (11, "ünï"), (12, None), (13, ""), (14, "one two three")]


def test_decontamination_against_brute_force(spark):
    rows = [*AWKWARD, (20, "x a B c-d e f g h i j k L yy"), (21, "a b c d e f g h i"), (22, "zero one  TWO.three one two three four")]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    want = sorted((str(i), *brute(t, BENCH)) for i, t in rows)
    for block in (1 << 20, 8):
        got = contamination(docs(spark, rows), bench, block_bytes=block).drop("spans").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want
    kept = decontaminate(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if not brute(t, BENCH)[-1])
    cut = {r.doc_id: r.text for r in decontaminate(docs(spark, rows), bench, remove="spans").collect()}
    assert cut[22] == "zero  four" and cut[20] == "x  yy" and cut[21] == "a b c d e f g h i" and cut[1] is None
    assert contamination(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_long_items_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(decontaminate_module, "PIECE", 7)
    long = " ".join(f"w{i}" for i in range(40))
    bench = [(1, long), (2, "w3 w4"), (3, long + " tail")]
    rows = [(1, long), (2, " ".join(f"w{i}" for i in range(4, 17))), (3, "w5 w6 w7"), (4, "x w3 w4 y w3"), (5, "w38 w39")]
    want = [(i, *brute(t, bench)) for i, t in rows]
    items = spark.createDataFrame(bench, "item_id long, text string")
    df = docs(spark, rows).withColumnsRenamed({"lang": "spans", "source": "row", "n_tokens": "contaminated", "shard": "items"})
    for block in (1 << 20, 60):
        assert sorted(tuple(r) for r in contamination(df, items, block_bytes=block).drop("spans").collect()) == want
        kept = decontaminate(df, items, remove="spans", block_bytes=block)
        assert kept.columns == df.columns and {r.doc_id: r.text for r in kept.collect()} == {1: "", 2: "", 3: "w5 w6 w7", 4: "x  y w3", 5: "w38 w39"}


def test_a_block_is_compact():
    import pickle

    rng = np.random.default_rng(1)
    words = np.array([b"".join([b"w", str(i).encode()]) for i in range(20_000)], object)
    items = [(str(i), b" ".join(rng.choice(words, 300))) for i in range(1000)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(decontaminate_module.Windows(items), protocol=5)) < 5 * size


def test_benchmark_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "red green blue"), (None, "zinc iron"), (7, "green blue"), (8, "tin")], "item_id long, text string")
    rows = [(1, "a red green blue b"), (2, "zinc iron, red green blue"), (3, "tin"), (4, "none")]
    sha = {x: hashlib.sha256(x.encode()).hexdigest() for x in ("", "7", "8")}
    want = [(1, 5, 3, 2, sha["7"], True), (2, 5, 5, 2, sha["7"], True), (3, 1, 1, 1, sha["8"], True), (4, 1, 0, 0, sha[""], False)]
    for block in (1 << 20, 8):
        got = contamination(docs(spark, rows), bench, block_bytes=block).drop("spans").collect()
        assert sorted(tuple(r) for r in got) == want
    con = pytest.importorskip("duckdb").connect()
    con.execute("create table documents as select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in rows) + ") t(doc_id, text)")
    con.execute("create table benchmark as select * from (values (null, 'red green blue'), (null, 'zinc iron'), (7, 'green blue'), (8, 'tin')) t(item_id, text)")
    assert sorted(con.execute(OP5_SQL).fetchall()) == want
