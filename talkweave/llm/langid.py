"""Language identification by sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm.common import discard, held_out, keyed_text, restore_key, saved

_BLOCK = 1 << 20


def ngram_counts(text: str, buckets: int, longest: int = 3) -> np.ndarray:
    """Counts of the hashed n-grams of 1 to ``longest`` characters of a whole text, lower-cased, with a space at either end."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4").astype("u4")
    out = np.zeros(buckets, "i8")
    shift = np.uint32(32 - (buckets - 1).bit_length())
    for a in range(0, len(codes), _BLOCK):
        # the n-grams that begin in this block
        part = codes[a : a + _BLOCK + longest - 1]
        h = np.zeros(len(part), "u4")
        for n in range(longest):
            h = (h[: len(part) - n] * np.uint32(0x01000193) + part[n:] + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
            begun = h[:_BLOCK]
            out += np.bincount((begun ^ (begun >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> shift, minlength=buckets)
    return out


@dataclass
class LanguageModel:
    """weights: float32, a row for each bucket; a row for the bias last."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0


def tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of unit length."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, buckets: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, seed: int = 5) -> np.ndarray:
    """Weights after follow-the-regularised-leader passes; l1 and l2 make the elastic net."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))
    order = np.random.default_rng(seed)

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, buckets), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss on rows that the weights weren't fitted on."""
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    return float(min(grid, key=loss)) if len(y) else 1.0


def document_frequencies(docs: DataFrame, text_col: str, buckets: int) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each bucket occurs; counted over every row."""

    def run(batches):
        df, n = np.zeros(buckets + 1, "i8"), 0
        for b in batches:
            for t in b["t"]:
                df[:-1] += ngram_counts(t, buckets) > 0
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": at, "n": df[at]})

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t")).mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets + 1, "i8")
    out[rows["bucket"]] = rows["n"]
    return int(out[-1]), out[:-1]


def language_sample(known: DataFrame, most: int) -> DataFrame:
    """(h, t, y) of at most ``most`` different texts of each language, those with the smallest hashes; known: (t, y).

    Copies of a text count once. A first cut by hash, from the number of each language's
    texts, leaves few more than that, so that no task orders a whole language.
    """
    hashed = known.select("t", "y", F.xxhash64("t").alias("h"))
    sizes = hashed.groupBy("y").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    share = F.col("h").cast("double") + 2.0**63 <= F.greatest(1.5 * most / F.col("n"), F.lit(0.0)) * 2.0**64
    few = hashed.join(F.broadcast(sizes), "y").where(share).groupBy("y", "h").agg(F.min("t").alias("t"))  # a row a language
    return few.withColumn("nth", F.row_number().over(Window.partitionBy("y").orderBy("h"))).where(F.col("nth") <= most).select("h", "t", "y")


def _counted(buckets: int):
    """(h, y, at, n, size): the buckets of a text's n-grams and their counts, as bytes: at most ``buckets`` of them, however long the text."""

    def run(batches):
        for b in batches:
            found = [ngram_counts(t, buckets) for t in b["t"]]
            at = [np.flatnonzero(c) for c in found]
            yield pd.DataFrame({
                "h": b["h"], "y": b["y"], "at": [a.astype("<i4").tobytes() for a in at], "n": [c[a].astype("<f8").tobytes() for c, a in zip(found, at)], "size": [len(a) for a in at],
            })

    return run


def _dense(at: bytes, n: bytes, buckets: int) -> np.ndarray:
    out = np.zeros(buckets)
    out[np.frombuffer(at, "<i4")] = np.frombuffer(n, "<f8")
    return out


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 15, most_docs: int = 1500, most_entries: int = 1 << 24,
) -> LanguageModel:
    """A model from the rows that aren't held out and whose text and language aren't null.

    Document frequencies cover all of those rows, and so do the languages. Weights are fitted on at
    most ``most_docs`` different texts of each language, those with the smallest hashes, long ones like short ones; every fifth of
    these sets the temperature instead. The driver gets their n-gram counts, made in tasks. All languages share ``most_entries`` counts:
    a language gives texts in order of their hashes as long as its share lasts, and its first one in any case.
    With no rows at all, the model knows no language.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    total, df = document_frequencies(known, text_col, buckets)
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = known.select(F.col(text_col).alias("t"), F.col(lang_col).alias("y"))
    each = max(1, most_entries // max(1, rows.select("y").distinct().count()))
    counted = saved(language_sample(rows, most_docs).mapInPandas(_counted(buckets), "h long, y string, at binary, n binary, size int"), "counts")
    so_far = Window.partitionBy("y").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)  # of at most ``most_docs`` rows
    fit = counted.select("h", "y", "size").withColumn("sum", F.sum("size").over(so_far)).where((F.col("sum") <= each) | (F.col("sum") == F.col("size")))
    sample = counted.join(fit.select("h", "y"), ["h", "y"]).select("h", "y", "at", "n").toPandas().sort_values(["h", "y"], ignore_index=True)
    discard(counted)
    labels = sorted(sample["y"].unique())
    if not labels:
        return LanguageModel([], idf, np.zeros((buckets + 1, 0), "f4"))
    y = sample["y"].map({x: k for k, x in enumerate(labels)}).to_numpy()
    rows = [tfidf(_dense(a, n, buckets), idf) for a, n in zip(sample["at"], sample["n"])]
    rest = np.arange(len(rows)) % 5 == 4
    w = fit_ftrl([r for r, q in zip(rows, rest) if not q], y[~rest], len(labels), buckets)
    logits = np.array([x @ w[at] + w[-1] for (at, x), q in zip(rows, rest) if q]).reshape(-1, len(labels))
    return LanguageModel(labels, idf, w.astype("f4"), fit_temperature(logits, y[rest]))


def predict_text(m: LanguageModel, text: str) -> tuple[str, float]:
    if not m.labels or not any(map(str.isalpha, text)):
        return "und", 0.0
    at, x = tfidf(ngram_counts(text, len(m.idf)), m.idf)
    p = softmax((x @ m.weights[at] + m.weights[-1]) / m.temperature)
    k = int(p.argmax())
    return m.labels[k], float(p[k])


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest learned language and its calibrated probability.

    ``und`` with score 0 where a text is null or has no letter, or nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets x languages

    def run(batches):
        m = shared.value
        for b in batches:
            got = [predict_text(m, t) for t in b["t"]]
            yield pd.DataFrame({"k": b["k"].array, "lang_pred": [x for x, _ in got], "score": [s for _, s in got]})

    return restore_key(keyed_text(docs, id_col, text_col).mapInPandas(run, "k string, lang_pred string, score double"), docs, id_col)
