import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed=1, n=120):
    """Texts with copies, near copies, shared passages, repeats, nulls, empties, and odd characters."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "ea", "ti", "é", "ß", "The", "x"]) for _ in range(rnd.randint(1, 4)))
    passage = " ".join(word() for _ in range(30))
    texts = []
    for i in range(n):
        kind = rnd.randrange(12)
        base = " ".join(word() for _ in range(rnd.randint(1, 90)))
        if kind == 0 and texts:
            base = rnd.choice(texts)
        elif kind in (1, 2) and texts:
            w = (rnd.choice(texts) or "").split(" ")
            if len(w) > 40:
                w[rnd.randrange(len(w))] = "changed"
            base = " ".join(w)
        elif kind == 3:
            base = base + "\n" + passage + "\t" + word()
        elif kind == 4:
            base = "\n".join([base] * 3)
        texts.append(base)
    texts += [None, "", "", " \t\n", "one", "one", "a b c d", "a b c d", "▁ <|endoftext|> 🤖  x", "same " * 40, "x" * 5000, passage * 1, "  lead and  trail  "]
    return [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s1", "s2", None]), None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
