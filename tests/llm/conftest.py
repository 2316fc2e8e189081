import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta house river stone cloud green north quiet table seven under voice light paper grass night money".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)) + "."


@pytest.fixture(scope="session")
def rows():
    """Prose with copies, near copies, shared passages, and the odd cases."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    base = [prose(rng, rng.randrange(60, 160)) for _ in range(24)]
    texts = base + base[:4] + [base[0].replace(" ", "  ", 3), base[1].replace(" ", "\n")]
    texts += [f"{t} {passage} {prose(rng, 20)}" for t in base[5:9]]
    for t in base[10:14]:
        w = t.split()
        w[7] = "changed"
        texts.append(" ".join(w))
    texts += ["", " \t\n", "word", "two words", "x" * 3000, "Größe über naïve café 日本語 😀 " * 30, "| a | b | c\n" * 30, "a b c " * 40]
    out = [(k, t, ("en", "de", None)[k % 3], ("s1", "s2", "s3", None)[k % 4] if k % 2 else "s1", len(t)) for k, t in enumerate(texts)]
    out += [(900, None, "en", "s9", None), (None, base[2], "en", "s1", 1), (None, None, None, None, None), out[3], out[3]]
    return out


@pytest.fixture
def docs(spark, rows):
    """With a column that operators use themselves in their results."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({"kept": F.lit("mine"), "shard": F.lit("mine"), "score": F.lit("mine"), "size": F.lit("mine"), "n_words": F.lit("mine")})


@pytest.fixture
def none(docs):
    return docs.where("false")
