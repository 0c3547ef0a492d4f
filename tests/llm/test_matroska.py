import random
import zlib

from quarrylog.llm import matroska as mk

from .conftest import corpus, make


def test_round_trip(spark, awkward):
    rows = corpus() + [(700, "x" * 70000)]
    got = mk.digest(mk.read_back(mk.store(make(spark, rows)))).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        payload = mk.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len((texts[r.doc_id] or "").encode()), len(payload), zlib.crc32(payload[-64:]))
    assert mk.store(awkward).count() == awkward.count() and mk.store(make(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"junk")), (3, 0, bytearray())], "doc_id long, n_bytes long, media binary")
    assert [r.payload for r in mk.read_back(odd).orderBy("doc_id").collect()] == [None, b"", b""]


def test_lacing():
    rng = random.Random(1)
    for lacing in (mk.NO_LACING, mk.XIPH, mk.FIXED, mk.EBML_LACING):
        for _ in range(30):
            sizes = [rng.randrange(0, 1000) for _ in range(1 if lacing == mk.NO_LACING else rng.randint(2, 9))]
            sizes = [40] * 5 if lacing == mk.FIXED else sizes
            body = mk.block_body(1, -7, [bytes(n) for n in sizes], lacing)
            assert [n for _, n in mk.frames(body, 4, len(body), lacing)] == sizes


def test_packets_and_cues(spark):
    data = mk.write(mk.padded("a" * 100_000))
    media = mk.parse(data)
    assert media.doc_type == "matroska" and media.unreadable is None and media.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert [p.timestamp for p in media.packets] == [i * 64_000_000 for i in range(len(media.packets))]
    assert [c[2] for c in media.cues] == media.clusters and len(media.clusters) > 1
    rows = mk.packets(spark.createDataFrame([(1, bytearray(data)), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.start, r["size"], r.timestamp_ns) for r in rows] == [(p.start, p.size, p.timestamp) for p in media.packets]


def test_unknown_sizes_block_groups_and_damage():
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, mk.block_body(1, 3, [b"abc"], 0)) + mk.whole(mk.BLOCK_DURATION, 5) + mk.element(mk.REFERENCE, b"\x01"))
    cluster = mk.CLUSTER.to_bytes(4, "big") + b"\xff" + mk.whole(mk.TIMESTAMP, 10) + group
    data = mk.element(mk.EBML, mk.element(mk.DOC_TYPE, b"webm")) + mk.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    media = mk.parse(data)
    assert [(p.timestamp, p.size, p.keyframe, p.cluster) for p in media.packets] == [(13_000_000, 3, False, 0), (13_000_000, 3, False, 1)]
    whole = mk.write(bytes(64) * 40)
    for cut in range(0, len(whole), 97):
        assert len(mk.parse(whole[:cut]).packets) <= len(mk.parse(whole).packets)
