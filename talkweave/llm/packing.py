"""Best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import keyed_text, restore_key, saved, text_batches

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> dict[int, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in own)}


_BYTE_CHARS = _byte_chars()


def _ids_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return pack(f"<{len(ids)}I", *ids)


def _normal(word: str) -> str:
    word = unicodedata.normalize("NFC", word)
    # a capital sigma's lower case depends on its place in the word, but not here
    return "".join(c.lower() for c in word) if "\u03a3" in word else word.lower()


_PROBES = ["The  quick,\tbrown\nfox's it'LL . .. a.b, 12 3x", "\u00c9t\u00e9 e\u0301t\u00c9\u00a0\u03a3\u03b1\u03a3 \u4e2d\u6587 \U0001f600", " lead  trail, "]


class WordEncoder:
    """Ids of whole texts, as the tokenizer's ``encode`` gives without special tokens of its own.

    For a tokenizer that lower-cases and drops white space between its pre-tokens, every
    blank-separated word is treated alike wherever it stands, so each distinct word is
    encoded once and the texts are put together from a table of at most ``most_words``
    words. A single ``.`` or ``,`` after letters is a pre-token of its own, which keeps
    the table small. Texts that hold an added token (such as ``<|endoftext|>``, which
    becomes its id), and all texts of another kind of tokenizer, are encoded as a whole.
    """

    def __init__(self, path: str, most_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word, self.most_words, self.words = True, most_words, {"": b""}
        self.tokenizer.encode_special_tokens = True
        probe = ["the", "wordings", "\u00e9t\u00e9", "e\u0301t", "\u00c9", "stra\u00dfe", "\u03a3\u03b1\u03c2\u03a3", "\u4e2d\u6587"]
        self.direct = self._letters([_normal(w) for w in probe]) == self._whole(probe)
        self.by_word = self.direct and self(_PROBES) == [np.array(x, "<u4").tobytes() for x in self._whole(_PROBES)]

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[list[int]]:
        """Ids of normalised words of letters, each of which is one pre-token: merged by the model."""
        merge = self.tokenizer.model.tokenize
        return [[x.id for x in merge(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS))] for w in words]

    def _learn(self, words: list[str], at_once: int = 2000) -> None:
        letters, rest = [], []
        for w in words:
            plain = w if w.isascii() else _normal(w)
            (letters if self.direct and plain.isalpha() else rest).append((w, plain))
        for some, ids, k in ((letters, self._letters, 1), (rest, self._whole, 0)):
            for a in range(0, len(some), at_once):
                part = some[a : a + at_once]
                self.words.update((w[0], _ids_bytes(x)) for w, x in zip(part, ids([w[k] for w in part])))

    def _as_they_are(self, texts: list[str]) -> list[bytes]:
        self.tokenizer.encode_special_tokens = False
        out = [np.array(x, "<u4").tobytes() for x in self._whole(texts)]
        self.tokenizer.encode_special_tokens = True
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return self._as_they_are(texts)
        split = [_ascii_lower(t).replace("\n", " ").split(" ") for t in texts]
        every = set().union(*split)
        new = every.difference(self.words)
        if len(self.words) + len(new) > self.most_words:
            # the words learned first are the frequent ones
            self.words = dict(islice(self.words.items(), self.most_words // 2))
            new = every.difference(self.words)
        ends = {w: w[:-1] for w in new if w[-1] in ".," and w[:-1].isalpha()}
        whole = (new - ends.keys()) | {w for w in ends.values() if w not in self.words} | ({".", ","} - self.words.keys())
        self._learn(list(whole))
        self.words.update((w, self.words[stem] + self.words[w[-1]]) for w, stem in ends.items())
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        special = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        for i, ids in zip(special, self._as_they_are([texts[i] for i in special])):
            out[i] = ids
        return out


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker."""
    return WordEncoder(path)


def _ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = WORD_TOKENIZER,
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids) of every document; without ids, if only their places are wanted.

    Ids are those of the tokenizer's ``encode`` without special tokens of its own; one that
    stands in a text is its id. A null text counts as empty; an empty text is the end id alone. Only documents
    longer than ``capacity`` are cut. Repeated rows give repeated pieces, a null id
    is kept, and further columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()
    columns = ["k", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer)
        for b in batches:
            keys, at = b["k"].tolist(), 0
            for texts in text_batches(b["t"].tolist(), 256):
                rows = []
                for key, raw in zip(keys[at : at + len(texts)], encode(texts)):
                    raw += end
                    for n, start in enumerate(range(0, len(raw), 4 * capacity)):
                        x = raw[start : start + 4 * capacity]
                        rows.append((key, n, start // 4, len(x) // 4, zlib.crc32(x), x)[: len(columns)])
                at += len(texts)
                yield pd.DataFrame(rows, columns=columns)

    schema = "k string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return restore_key(keyed_text(docs, id_col, text_col).mapInPandas(cut, schema), docs, id_col)


class OpenBins:
    """Open bins in a bitset: bit f is set while some open bin has exactly f free places.

    The best fit for a piece is the lowest set bit at or above its length. Beyond
    ``most`` open bins the fullest one (the lowest set bit) is closed.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.at, self.open, self.opened = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        self.open -= 1
        bins = self.at[free]
        b = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        return b

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``length`` places."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            b, free = self.opened, self.capacity
            self.opened += 1
        left = free - length
        if left:
            if not self.at[left]:
                self.bits |= 1 << left
            self.at[left].append(b)
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return b, self.capacity - free


def best_fit_pack(
    pieces: DataFrame,
    length_col: str = "length",
    order: tuple[str, ...] = ("doc_id", "piece"),
    capacity: int = 4096,
    open_bins: int = 16384,
    pieces_per_task: int = 50_000,
) -> DataFrame:
    """``pieces`` with sequence_id and offset: bounded-space online best fit.

    Each task packs a stream of about ``pieces_per_task`` pieces, longest first, and
    holds at most ``open_bins`` bins, so memory does not depend on the input and the
    number of tasks follows it. ``pieces`` should be a stored table, as it is counted
    first. Lengths must be from 1 to ``capacity``. Ties are put in the order of
    ``order``; equal rows are interchangeable. An empty table gives an empty table.
    """
    tasks = max(1, -(-pieces.count() // pieces_per_task))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            put = [bins.place(n) for n in b[length_col].tolist()]
            yield b.assign(sequence_id=[base + s for s, _ in put], offset=[o for _, o in put])

    return (
        pieces.repartition(tasks)
        .sortWithinPartitions(F.col(length_col).desc(), *order)
        .mapInPandas(pack, schema)
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **tokenizing) -> DataFrame:
    """Pieces of all documents with their places, without the ids."""
    capacity = tokenizing.get("capacity", 4096)
    pieces = saved(token_pieces(docs, id_col, text_col, with_ids=False, **tokenizing), "pieces")
    return best_fit_pack(pieces, order=(id_col, "piece"), capacity=capacity)
