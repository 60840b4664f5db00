import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, sequence_id int, n_dropped string"


def prose(seed: int, n: int) -> str:
    """Sentences of invented words; equal seeds give equal texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ré", "tu", "sen", "dor"]) for _ in range(r.randint(1, 3)))
    return " ".join(word() + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def corpus() -> list[tuple]:
    """Exact and near copies, shared lines and passages, nulls, empty, short and very long texts, repeated rows."""
    texts = [None, "", "   \n\t\n", "one", "four words are here", "a b c d e", "日本語 の テキスト", "\n\n", "x" * 5000, "na " * 900]
    base = prose(1, 300)
    texts += [base] * 4
    for k in range(12):  # near copies: a few words changed
        words = base.split(" ")
        r = random.Random(100 + k)
        for _ in range(r.randint(1, 6)):
            words[r.randrange(len(words))] = f"changed{r.randint(0, 9)}"
        texts.append(" ".join(words))
    shared = "This line stands in many of the documents here."
    passage = prose(2, 60)
    for k in range(30):
        texts.append("\n".join([prose(10 + k, 40), shared.upper() if k % 3 else f"  {shared}\t", passage if k % 4 == 0 else "", prose(50 + k, 20)]))
    texts.append(prose(3, 30_000))  # very long
    texts += [prose(200 + k, 80) for k in range(20)]
    rows = [(3 * k, t, ["en", "fr", None, "de"][k % 4], ["a", "a", "b", None][k % 4] if k % 7 else "c", None, "own", k, k, "x") for k, t in enumerate(texts)]
    return [*rows, rows[12], (None, "text without an id and with some words in it", "en", "a", 1, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def unique(docs):
    """The documents with ids, each once."""
    return docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
