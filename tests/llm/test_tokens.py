import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from talkweave.llm import bpe, packing


@pytest.fixture(scope="module")
def word_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte_ids():
    import tiktoken

    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda x: e.encode_ordinary(x or "")


def test_pieces_hold_the_tokenizers_ids(spark, docs, texts, word_ids):
    rows = defaultdict(list)
    for r in packing.token_pieces(docs, capacity=512).collect():
        rows[r.doc_id].append(r)
    for i, t in [*enumerate(texts), (None, "the null id")]:
        want = [*word_ids(t), 1]
        got = sorted(rows[i], key=lambda r: r.piece)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist() == want
        assert [r.start for r in got] == list(range(0, len(want), 512))
        assert all(r.length == 512 for r in got[:-1]) and all(r.ids_crc32 == zlib.crc32(r.ids) for r in got)


def test_special_tokens_in_texts_are_the_tokenizers(word_ids):
    encode = packing.WordEncoder(packing.WORD_TOKENIZER)
    texts = ["x <|endoftext|> y", "x<|ENDOFTEXT|>y", "A<|startoftext|>\tB  ", "<|ENDOFTEXT|>", "<|endoftext|>" * 3, "plain"]
    assert encode.by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [word_ids(x) for x in texts]


def test_another_kind_of_tokenizer_encodes_whole_texts(tmp_path, texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    t = Tokenizer(models.BPE(vocab, []))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.save(str(tmp_path / "t.json"))
    encode, some = packing.WordEncoder(str(tmp_path / "t.json")), [x or "" for x in texts]
    assert not encode.by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(some)] == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_packing_fills_sequences_without_gaps(spark, docs):
    rows = packing.pack_documents(docs, capacity=512).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 512) + 2


def test_open_bins_match_a_plain_best_fit():
    r = np.random.default_rng(3)
    bins, free = packing.OpenBins(100, 8), {}
    for n in r.integers(1, 101, 3000).tolist():
        got, offset = bins.place(n)
        fits = [f for f in free.values() if f >= n]
        if fits:
            assert free[got] == min(fits)
        else:
            assert got not in free
            free[got] = 100
        assert offset == 100 - free[got]
        free[got] -= n
        if not free[got]:
            del free[got]
        if len(free) > 8:
            least = min(free.values())
            shut = [b for b, f in free.items() if f == least and b not in {x for at in bins.at for x in at}]
            assert len(shut) == 1
            del free[shut[0]]
        assert sorted(free) == sorted(x for at in bins.at for x in at)


def test_packing_no_rows(no_docs):
    assert packing.pack_documents(no_docs).collect() == []


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (64, 3), (1000, 200), (32768, 1024)])
def test_bpe_equals_whole_text_encoding(docs, texts, byte_ids, chunk, overlap):
    short, long = bpe.encode(docs, chunk=chunk, overlap=overlap)
    rows = {r.doc_id: r for f in (short, long) for r in bpe.digest(f).collect()}
    assert len(rows) == len(texts) + 1
    for i, t in enumerate(texts):
        want = byte_ids(t)
        assert rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_no_rows(no_docs):
    short, long = bpe.encode(no_docs)
    assert bpe.digest(short).collect() == [] == bpe.digest(long).collect()


def test_bpe_decodes_pieces(spark, docs, texts):
    got = {}
    for f in bpe.encode(docs, chunk=64, overlap=16):
        for r in bpe.decode(f).orderBy("doc_id", "piece").collect():
            got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.bytes)
    assert all(got[i] == (t or "").encode() for i, t in enumerate(texts))


def test_a_long_text_without_boundaries_is_read_in_proportion(spark):
    """Pieces join to the text, end at true boundaries, and a stretch of one letter is read about as often as it grows by half."""
    import time

    import public_tokenizers

    letters = "x" * 2_000_000
    text = "some words, then " + letters + " and others. " * 150_000
    df = spark.createDataFrame([(0, "0", text)], "n int, k string, t string")
    began = time.time()
    got = [r.t for r in bpe.pieces(df.select("k", "t"), public_tokenizers.PATTERN, 32_768, 1_024).orderBy("piece").collect()]
    assert "".join(got) == text and time.time() - began < 40
    ends = set(bpe.token_ends(text, public_tokenizers.PATTERN))
    at = 0
    for piece in got:
        at += len(piece)
        assert at in ends
    assert len(got) > 10 and max(map(len, got)) < 2 * len(letters)
