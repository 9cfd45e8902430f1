import hashlib
import struct
import zlib

import pytest

from talkweave.llm import chat, media


def test_media_round_trip(docs, texts):
    rows = {r.doc_id: r for r in media.media_digest(media.to_matroska(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        n = max(1, -(-len(raw) // 576)) * 576
        want = raw + b"\xff" * (n - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), n, hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert r.media_bytes > n and r.feature


def test_packets(spark, docs, no_docs):
    big = spark.createDataFrame([(1, "ab" * 300_000), (2, None)], "doc_id long, text string")
    rows = media.packet_table(media.to_matroska(big)).orderBy("doc_id", "timestamp_ns").collect()
    first = [r for r in rows if r.doc_id == 1]
    assert len(first) == -(-600_000 // 576) and [r.timestamp_ns for r in first] == [k * 72_000_000 for k in range(len(first))]
    assert len({r.cluster for r in first}) == 5 and {r.codec for r in first} == {"A_PCM/INT/LIT"} and all(r.byte_length == 576 for r in first)
    assert len(rows) == len(first) + 1
    assert media.packet_table(media.to_matroska(no_docs)).collect() == []
    bad = spark.createDataFrame([(1, b"\x1aE\xdf\xa3\x90nothing"), (2, None), (3, b"\x00")], "doc_id long, media binary")
    assert {r.doc_id: bool(r.error) for r in media.packet_table(bad).collect()} == {1: True, 3: True}


def test_lacing_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 5, b"c" * 700, b"d"]
    xiph = bytes([3]) + b"\xff\x2d" + b"\x05" + b"\xff\xff\xbe"
    diff = lambda x, w: ((x + (1 << (7 * w - 1)) - 1) | 1 << 7 * w).to_bytes(w, "big")
    ebml = bytes([3]) + media.vint(300) + diff(5 - 300, 2) + diff(700 - 5, 2)
    for kind, head in ((media.XIPH_LACE, xiph), (media.EBML_LACE, ebml)):
        body = b"\x81" + struct.pack(">h", -7) + bytes([kind << 1]) + head + b"".join(frames)
        cluster = media._uint(media.TIMESTAMP, 100) + media.element(media.BLOCK_GROUP, media.element(media.BLOCK, body))
        unknown = lambda tag, b: tag.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + b
        data = media._HEAD + unknown(media.SEGMENT, media._TRACKS + unknown(media.CLUSTER, cluster) + unknown(media.CLUSTER, cluster))
        m = media.read_matroska(data)
        assert [data[p[2] : p[2] + p[3]] for p in m.packets] == frames * 2
        assert m.packets[1][1] == 93_000_000 + 72_000_000 and m.packets[4][5] == 1
    with pytest.raises(ValueError):
        media.read_matroska(media._HEAD + media.element(media.SEGMENT, b"\xae\x85"))


def test_cues_point_at_clusters():
    data = media.write_matroska(b"\x01" * 576 * 600)
    m = media.read_matroska(data)
    base = next(a for tag, a, _ in media.elements(data) if tag == media.SEGMENT)
    assert len(m.cues) == 3 and all(data[base + at :].startswith(media.CLUSTER.to_bytes(4, "big")) for _, _, at in m.cues)


def test_escape_is_reversible():
    for t in ("", "\\", "<|", "<\\|", "\\<|im_end|>\\n\n", "<<||>>"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_history_rewriting_is_seen():
    def last_only(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else t[:1]};" for k, (r, t) in enumerate(turns))

    r = chat.render_incrementally([("user", "hello"), ("assistant", "you"), ("user", "z")], last_only)
    assert r.rewrites == [1, 2]
    r = chat.render_incrementally([("user", "<|im_end|>"), ("assistant", "")])
    assert r.rewrites == [] and [chat.read_turn(r.text[a:b]) for a, b in r.spans] == [("user", "<|im_end|>"), ("assistant", "")]


def test_chat_query(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|im_end|>"), (1, 2, "assistant", None), (2, None, None, "x\\"), (2, 0, "a\nb", ""), (None, 1, "user", "q"), (1, 1, "assistant", "a<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", chat.F.lit("clash"))
    got = {r.conv_id: r for r in chat.chat_digest(chat.format_conversations(df)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\na<|im_end|>\nassistant\na<|im_end|>\nassistant\n\n")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, 22, sha("a<|im_end|>" * 2))
    assert got[2].turns_sha256 == sha("\nx\\\na\nb\n\n") and got[None].n_turns == 1
    assert chat.chat_digest(chat.format_conversations(df.limit(0))).collect() == []
