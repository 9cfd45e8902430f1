import random

import pytest

HARD = [
    None, "", " ", "\n\n", "a", "The the, THE. it's   ok x", "été ́x café", "x" * 5000, "中文字符 123 \U0001f600\U0001f600",
    "<|endoftext|> <|im_end|>", "tab\tsep\x0bv\x0cf\x1cq", "ΣΑΣ İI", " lead", "trail  ", "!!, ... ,a. b.,", "\x00nul",
]


@pytest.fixture(scope="session")
def texts():
    r = random.Random(7)
    alphabet = "abcdefgh ABC,.'\néß中5 \t!"
    out = list(HARD)
    out += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 400))) for _ in range(60)]
    out += [" ".join(r.choice(["the", "of", "and,", "Thing.", "it's", "été"]) for _ in range(9000))]
    return out + out[5:9]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Hard and random texts, a null id, and extra columns whose names operators use inside."""
    rows = [(i, t, "x", 1, b"z") for i, t in enumerate(texts)] + [(None, "the null id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, k string, piece int, ids binary").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
