"""Byte-level BPE by overlapping chunks, and decoding to raw bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import keyed_text, restore_key

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _bytes_by_id(path: str) -> list[bytes]:
    return [x for x, _ in sorted(_ranks(path).items(), key=lambda x: x[1])]


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


def token_ends(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of ``text``, read from its start."""
    import regex

    return [m.end() for m in regex.finditer(pattern, text)]


def _by_doc(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows of sorted batches, each with a flag for the first one of its document."""
    last = None
    for b in batches:
        for row in b.itertuples(index=False, name=None):
            yield row[0] != last, row
            last = row[0]


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(d, k, c, last, t): overlapping chunks of texts that are longer than one chunk; d numbers the rows."""
    n = F.ceil(F.length("t") / chunk).cast("int")
    return docs.withColumn("d", F.monotonically_increasing_id()).select("d", "k", "t", F.explode(F.sequence(F.lit(0), n - 1)).alias("c"), n.alias("n")).select(
        "d", "k", "c", (F.col("c") == F.col("n") - 1).alias("last"),
        F.substring("t", F.col("c") * chunk + 1, F.lit(chunk + overlap)).alias("t"),
    )


def pieces(docs: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(d, k, piece, t): texts longer than a chunk, cut at true pre-token boundaries.

    Chunks are pre-tokenised in parallel. Matching reads on from a boundary without
    looking back, so once a boundary of a chunk is also one of the next chunk, the two
    agree from there on: that is the cut. Where no boundary is shared within the
    overlap, the two chunks stay together, are read again as one text from the last
    cut, and the next seam is tried with the boundaries of that reading; what is held is read again
    each time it has grown by half, so a long stretch without boundaries takes time in proportion. A text is put
    in order in one task as a stream of its chunks; the pieces then spread again.
    """
    def ends(batches):
        for b in batches:
            heads, tails = [], []
            for text, last in zip(b["t"], b["last"]):
                e = [0, *token_ends(text, pattern)]
                heads.append(np.array([x for x in e if x < overlap], "int32"))
                # the last token may go on beyond the chunk
                tails.append(np.array([] if last else [x - chunk for x in e[:-1] if x >= chunk], "int32"))
            yield b.assign(head=heads, tail=tails)

    def stitch(batches):
        rows, parts, piece = [], None, 0
        for first, (d, k, _, last, text, head, chunk_tail) in _by_doc(batches):
            if first:
                parts, piece = None, 0
            if parts is None:
                parts, n, tail, read = [text], len(text), chunk_tail, len(text)
            else:
                # what is held ends with the overlap that text begins with
                seam = np.intersect1d(tail, head)
                if len(seam):
                    cut, held = int(seam[0]), "".join(parts)
                    rows.append((d, k, piece, held[: len(held) - min(overlap, len(text)) + cut]))
                    piece += 1
                    parts, tail = [text[cut:]], chunk_tail
                    n = read = len(parts[0])
                else:
                    parts.append(text[overlap:])
                    n, tail = n + len(parts[-1]), np.array([], "int32")
                    if not last and 2 * n >= 3 * read:
                        held, read = "".join(parts), n
                        parts, seam_at = [held], n - (len(text) - chunk)
                        tail = np.array([x - seam_at for x in token_ends(held, pattern)[:-1] if x >= seam_at], "int32")
            if last:
                rows.append((d, k, piece, "".join(parts)))
            if len(rows) >= 64:
                yield pd.DataFrame(rows, columns=["d", "k", "piece", "t"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["d", "k", "piece", "t"])

    return (
        _chunks(docs, chunk, overlap)
        .mapInPandas(ends, "d long, k string, c int, last boolean, t string, head array<int>, tail array<int>")
        .repartition("d")
        .sortWithinPartitions("d", "c")
        .mapInPandas(stitch, "d long, k string, piece int, t string")
    )


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str = RANKS,
    pattern: str = public_tokenizers.PATTERN,
    chunk: int = 32_768,
    overlap: int = 1_024,
) -> tuple[DataFrame, DataFrame]:
    """(id, piece, ids) of texts of one chunk and of longer ones.

    A null text counts as empty and has one piece without ids. In the second frame the
    pieces of a row lie in one partition in their order, as ``digest`` reads them. Rows
    are kept apart whatever their ids, so repeated and null ids give a result each.
    """
    src = keyed_text(docs, id_col, text_col)

    def run(batches):
        enc = _encoding(ranks, pattern)
        for b in batches:
            for a in range(0, len(b), 512):
                part = b.iloc[a : a + 512]
                ids = [np.array(enc.encode_ordinary(t), "int32") for t in part["t"]]
                yield part.drop(columns="t").assign(ids=ids)

    short = src.where(F.length("t") <= chunk).select("k", F.lit(0).alias("piece"), "t").mapInPandas(run, "k string, piece int, ids array<int>")
    long = (
        pieces(src.where(F.length("t") > chunk), pattern, chunk, overlap)
        .repartition("d", "piece")
        .mapInPandas(run, "d long, k string, piece int, ids array<int>")
        .repartition("d")
        .sortWithinPartitions("d", "piece")
        .drop("d")
    )
    return restore_key(short, docs, id_col), restore_key(long, docs, id_col)


def decode_bytes(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, id_col: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """(id, piece, ids, bytes): the raw bytes of each piece; a piece may end inside a character."""

    def run(batches):
        table = _bytes_by_id(ranks)
        for b in batches:
            yield b.assign(bytes=[decode_bytes(x, table) for x in b["ids"]])

    out = encoded.select(F.col(id_col).cast("string").alias("k"), "piece", "ids").mapInPandas(
        run, "k string, piece int, ids array<int>, bytes binary"
    )
    return restore_key(out, encoded, id_col)


def digest(encoded: DataFrame, id_col: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """n_tokens and digests of the ids and of the decoded bytes of each document, whose pieces must be together and in order."""

    columns = ["k", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        table = _bytes_by_id(ranks)
        key, n, ids_sha, text_sha = None, 0, None, None
        for b in batches:
            rows = []
            for k, piece, ids in b.itertuples(index=False, name=None):
                if piece == 0:
                    if ids_sha:
                        rows.append((key, n, ids_sha.hexdigest(), text_sha.hexdigest()))
                    key, n, ids_sha, text_sha = k, 0, hashlib.sha256(), hashlib.sha256()
                n += len(ids)
                ids_sha.update(np.asarray(ids, "<u4").tobytes())
                text_sha.update(decode_bytes(ids, table))
            yield pd.DataFrame(rows, columns=columns)
        if ids_sha:
            yield pd.DataFrame([(key, n, ids_sha.hexdigest(), text_sha.hexdigest())], columns=columns)

    out = encoded.select(F.col(id_col).cast("string").alias("k"), "piece", "ids").mapInPandas(
        run, "k string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return restore_key(out, encoded, id_col)
