"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from talkweave.llm.common import held_out, keyed_text, restore_key, text_batches

UPPER, LOWER, OTHER_LETTER, DIGIT, SPACE, PUNCTUATION, SYMBOL, ELSE = range(8)
FEATURES = (
    "length", "words", "upper", "digits", "punctuation", "symbols", "nonascii", "word_length", "repeated_line",
    "stops", "shouts", "bars", "marks_per_word", "changes", "same_char", "line_share", "repeated_words",
)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Character class of every code point of the first plane."""
    kinds = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Lo": OTHER_LETTER, "Lm": OTHER_LETTER, "N": DIGIT, "Z": SPACE, "P": PUNCTUATION, "S": SYMBOL}
    out = np.full(65_536, ELSE, "u1")
    for c in range(65_536):
        k = unicodedata.category(chr(c))
        out[c] = kinds.get(k, kinds.get(k[0], ELSE))
    out[[9, 10, 11, 12, 13]] = SPACE
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, lines of each text, characters of every line) of whole texts."""
    lines = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in lines])
    flat = [x for per in lines for x in per]
    # every line with the line feed after it, so that none is empty
    codes = np.frombuffer("".join(f"{x}\n" for x in flat).encode("utf-32-le"), "<u4")
    size = np.array([len(x) for x in flat])
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(flat) else np.zeros(0, "i8")
    kind = np.where(codes < 65_536, _classes()[np.minimum(codes, 65_535)], OTHER_LETTER)
    total = lambda flags: np.add.reduceat(flags.astype("i4"), starts)
    n = np.maximum(size, 1)
    space = kind == SPACE
    words = total(np.concatenate([~space[:1], ~space[1:] & space[:-1]]))
    letters = np.maximum(total(kind <= OTHER_LETTER), 1)
    marks = (kind == PUNCTUATION) | (kind == SYMBOL)
    # before every text stands a line feed, before the first one too: a text's features don't depend on those beside it
    same = np.concatenate([codes[:1] == 10, codes[1:] == codes[:-1]])
    changed = np.concatenate([kind[:1] != SPACE, kind[1:] != kind[:-1]])
    stop = (codes == 46) | (codes == 44)
    again = []
    for per in lines:
        seen: dict[str, int] = {}
        for x in per:
            seen[x] = seen.get(x, 0) + 1
        again += [seen[x] if x else 1 for x in per]
    repeats = [1 - len(set(w)) / len(w) if (w := x.split()) else 0 for x in flat]
    share = size / np.maximum(np.repeat(np.add.reduceat(size, np.concatenate([[0], np.cumsum(counts)[:-1]])), counts), 1)
    w = np.maximum(words, 1)
    columns = (
        np.log1p(size), np.log1p(words), total(kind == UPPER) / letters, total(kind == DIGIT) / n, total(kind == PUNCTUATION) / n, total(kind == SYMBOL) / n,
        total(codes > 127) / n, size / w, np.log(again), total(stop) / w, total(codes == 33) / w, total(codes == 124) / w, total(marks) / w,
        total(changed) / n, total(same & ~space) / n, share, repeats,
    )
    return np.stack(columns, 1).astype("f4"), counts, size


@dataclass
class LineCRF:
    """Two states, bad (0) and good (1); scores of good over bad are sums of table entries.

    edges: bin limits of each feature. own, before, after: a weight for each feature
    and bin of the line itself and of its neighbours. first, last: for lines without a
    neighbour. stay: pair scores, by state and next state. slope, offset: calibration.
    """

    edges: list[np.ndarray]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    ends: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)


def _neighbours(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line has one before it, and one after it."""
    n = int(counts.sum())
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
    last[np.cumsum(counts) - 1] = True
    return ~first, ~last


def unary(m: LineCRF, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    f = np.arange(bins.shape[1])
    has_before, has_after = _neighbours(counts)
    u = m.own[f, bins].sum(1) + m.ends[0] * ~has_before + m.ends[1] * ~has_after
    b, a = m.before[f, bins].sum(1), m.after[f, bins].sum(1)
    u[1:] += np.where(has_before[1:], b[:-1], 0)
    u[:-1] += np.where(has_after[:-1], a[1:], 0)
    return u


def marginals(u: np.ndarray, counts: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of every line, expected pairs by state and next state): forward-backward over all texts at once.

    Texts are ordered by their number of lines, so that step t works on those which have
    a line t. Forward and backward values are log-odds of good over bad.
    """
    order = np.argsort(-counts, kind="stable")
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    n, longest = counts[order], int(counts.max()) if len(counts) else 0
    alive = np.searchsorted(-n, -np.arange(1, longest + 1), "right")
    fore, back = np.empty_like(u), np.zeros_like(u)
    through = lambda x, p: np.logaddexp(p[0, 1], x + p[1, 1]) - np.logaddexp(p[0, 0], x + p[1, 0])
    for t in range(longest):
        at = starts[: alive[t]] + t
        fore[at] = u[at] + (through(fore[at - 1], pair) if t else 0)
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        ahead = u[at + 1] + back[at + 1]
        back[at] = through(ahead, pair.T)
        joint = np.stack([np.full(len(at), pair[0, 0]), ahead + pair[0, 1], fore[at] + pair[1, 0], fore[at] + ahead + pair[1, 1]])
        joint = np.exp(joint - joint.max(0))
        expected += (joint / joint.sum(0)).sum(1).reshape(2, 2)
    return _sigmoid(fore + back), expected


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def aggregate(p: np.ndarray, counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean of P(good) over the lines of each text, weighted by their characters (an empty line as one)."""
    w, starts = np.maximum(size, 1).astype("f8"), np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.add.reduceat(p * w, starts) / np.add.reduceat(w, starts)


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(texts: list[str], labels: np.ndarray, **settings) -> LineCRF:
    """A CRF for texts labelled 1 (good) or 0."""
    return fit_lines(*line_features(texts), labels, **settings)


def fit_lines(x: np.ndarray, counts: np.ndarray, size: np.ndarray, labels: np.ndarray, bins: int = 12, steps: int = 150, rounds: int = 2, l2: float = 2.0, rate: float = 0.1) -> LineCRF:
    """A CRF for documents labelled 1 (good) or 0, given as ``line_features`` gives them.

    Lines start with their document's label. After a round of training, lines of bad
    documents which the field takes for good become good, except the least likely ones
    that make up half of the text. Likelihood gradients are forward-backward expectations,
    followed by Adam. Last, the documents' log-odds are calibrated on their labels.
    """
    qs = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, k], qs)) for k in range(x.shape[1])]
    shape = (x.shape[1], bins + 1)
    m = LineCRF(edges, np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(2), np.zeros((2, 2)))
    b, doc = m.bins(x), np.repeat(np.arange(len(counts)), counts)
    has_before, has_after = _neighbours(counts)
    share = np.array([1 / max(1, (labels == k).sum()) for k in (0, 1)])[labels.astype(int)] * len(labels) / 2
    y = labels[doc].astype("f8")
    flat, width = b + np.arange(shape[0]) * shape[1], shape[0] * shape[1]
    table = lambda w: np.bincount(flat.ravel(), np.repeat(w, shape[0]), width).reshape(shape)
    moved = lambda g, by: np.concatenate([g[1:], [0]]) if by < 0 else np.concatenate([[0], g[:-1]])
    for r in range(rounds):
        state = [np.zeros(width * 3 + 6), np.zeros(width * 3 + 6)]
        real = np.zeros((2, 2))
        np.add.at(real, (y[:-1][has_after[:-1]].astype(int), y[1:][has_after[:-1]].astype(int)), 1)
        for step in range(1, steps + 1):
            p, expected = marginals(unary(m, b, counts), counts, m.pair)
            g = (y - p) * share[doc] / np.repeat(np.sqrt(counts), counts)
            parts = (
                table(g) - l2 * m.own / 10, table(moved(g * has_before, -1)) - l2 * m.before / 10, table(moved(g * has_after, 1)) - l2 * m.after / 10,
                np.array([(g * ~has_before).sum(), (g * ~has_after).sum()]) - l2 * m.ends, real - expected - l2 * m.pair,
            )
            grad = np.concatenate([q.ravel() for q in parts])
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad * grad
            by = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            a = 0
            for part in (m.own, m.before, m.after, m.ends, m.pair):
                part += by[a : a + part.size].reshape(part.shape)
                a += part.size
        if r + 1 < rounds:
            p, _ = marginals(unary(m, b, counts), counts, m.pair)
            order = np.lexsort((p, doc))
            upto = np.cumsum(size[order]) - size[order]
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            held = np.empty(len(p))
            held[order] = (upto - np.repeat(upto[starts], counts)) / np.maximum(np.repeat(np.add.reduceat(size, starts), counts), 1)
            y = np.where((labels[doc] == 0) & (p > 0.5) & (held > 0.5), 1.0, labels[doc].astype("f8"))
    s = _logit(aggregate(marginals(unary(m, b, counts), counts, m.pair)[0], counts, size))
    # the score 0.5 is where the classes, as frequent as in the sample, are equally likely
    a, c = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * s + c)
        w = q * (1 - q) + 1e-6
        h = np.array([[(w * s * s).sum() + 1.0, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
        da, dc = np.linalg.solve(h, np.array([((labels - q) * s).sum() - 1.0 * (a - 1), (labels - q).sum()]))
        a, c = a + da, c + dc
    m.slope, m.offset = float(max(a, 0.05)), float(c)
    return m


def score_texts(m: LineCRF, texts: list[str]) -> np.ndarray:
    x, counts, size = line_features(texts)
    p, _ = marginals(unary(m, m.bins(x), counts), counts, m.pair)
    return _sigmoid(m.slope * _logit(aggregate(p, counts, size)) + m.offset)


def score_all(m: LineCRF, texts: list[str]) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(score_texts(m, part) for part in text_batches(texts))])


def _sample_lines(batches):
    """(k, y, x, size): features and characters of the lines of each text, so that the driver gets no texts and makes no features."""
    for b in batches:
        at = 0
        for part in text_batches(b["t"].tolist(), 64, 1 << 18):
            x, counts, size = line_features(part)
            ends = np.cumsum(counts)[:-1]
            made = {"x": [v.tobytes() for v in np.split(x, ends)], "size": [v.astype("i8").tobytes() for v in np.split(size, ends)]}
            yield pd.DataFrame({"k": b["k"].iloc[at : at + len(part)].array, "y": b["y"].iloc[at : at + len(part)].array, **made})
            at += len(part)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_per_class: int = 1500, longest: int = 1 << 17
) -> LineCRF:
    """A model from a sample of at most ``most_per_class`` labelled documents of each class that aren't held out.

    The sample is the documents whose hashed ids are smallest, so it is the same in every
    run; one row of each, of those with at most ``longest`` characters, which bounds its rows and bytes. Scores are then
    moved by how much more frequent a class is among all labels than in the sample, so that 0.5 means the same at every size.
    Rows with null ids, texts or labels, and ids with different labels, teach nothing.
    With no labelled documents, or one class only, all features have weight zero.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z")
    taught = [known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(most_per_class).select(id_col, "y") for y in (0, 1)]
    ids = taught[0].unionByName(taught[1])
    texts = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= longest)).select(id_col, F.col(text_col).alias("t")).join(F.broadcast(ids), id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    lines = texts.groupBy(id_col, "y").agg(F.min("t").alias("t")).select(F.col(id_col).alias("k"), F.col("y").cast("int").alias("y"), "t").mapInPandas(_sample_lines, f"k {kind}, y int, x binary, size binary")
    rows = lines.orderBy("k").select("y", "x", "size").toPandas()
    if rows["y"].nunique() < 2:
        return fit(["a", "a"], np.array([0, 1]))
    x, size = np.frombuffer(b"".join(rows.pop("x")), "f4").reshape(-1, len(FEATURES)), rows.pop("size")
    m = fit_lines(x, size.str.len().to_numpy() // 8, np.frombuffer(b"".join(size), "i8"), rows["y"].to_numpy())
    n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    m.offset += math.log(n[1] / n[0]) - math.log((rows["y"] == 1).sum() / (rows["y"] == 0).sum())
    return m


def score(docs: DataFrame, model: LineCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; null texts count as one empty line."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"k": b["k"].array, "score": score_all(model, b["t"].tolist())})

    return restore_key(keyed_text(docs, id_col, text_col).mapInPandas(run, "k string, score double"), docs, id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that the classifier rejects (score under 0.5)."""
    return keep_scored(docs, train(docs, labels, id_col, text_col), text_col)


def keep_scored(docs: DataFrame, model: LineCRF, text_col: str = "text", least: float = 0.5) -> DataFrame:
    @pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(score_all(model, texts.tolist()))

    return docs.where(of(F.coalesce(text_col, F.lit(""))) >= least)
