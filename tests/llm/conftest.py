import random

import pytest

LETTERS = [chr(c) for c in range(97, 123)]


def word(rng):
    return "".join(rng.choice(LETTERS[:12]) for _ in range(rng.randint(2, 7)))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars): prose, copies, near copies, shared passages, and the odd cases."""
    rng = random.Random(7)
    vocabulary = [word(rng) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", "\n"]) for _ in range(n)).replace("\n ", "\n")
    texts = [prose(rng.randint(5, 220)) for _ in range(40)]
    passage = prose(70).replace("\n", " ")
    texts += [f"{prose(30)} {passage} {prose(20)}" for _ in range(6)]
    texts += [texts[3], texts[3], texts[4] + " added words here", texts[5].upper()]
    base = prose(400).split(" ")
    for i in range(5):
        near = list(base)
        near[17 * (i + 1)] = "changed"
        texts.append(" ".join(near))
    texts += [None, "", " \t\n ", "one", "two words", "ünï cödé " * 40, "same line\nsame line\n" * 30, "a b c " * 5000]
    texts += [f"password = abc{i}def99 and token:xyz" for i in range(3)] + ["AKIA" + "Q" * 16 + " é " + "0123456789abcdef" * 2, "token=a secret=token:abcdefgh"]
    out = [(i, t, ["en", "de", None][i % 3], ["s0", "s1"][i % 2], len(t or "")) for i, t in enumerate(texts)]
    out += [out[2], (None, "no id " + passage, "en", "s0", 5), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, shape)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named like those the operators make."""
    import pyspark.sql.functions as F

    names = ["rid", "did", "node", "key", "seed", "block", "kept", "distance", "hit", "items", "n_words", "component", "level", "words"]
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
