import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from colweave.llm.shipping import ship  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def shipped(spark):
    return ship(spark)


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


#: Null, empty, blank and letterless texts, ties, repeated rows, a null id, a text far longer than the rest.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "!!! 123 ..."),
    (5, "one two"),
    (6, "one two"),
    (6, "one two"),
    (None, "no id here at all"),
    (8, "Été 中文 \U0001f600 naïve text"),
    (9, sentence(random.Random(5), 60_000)),
    (10, "<|endoftext|> is only a string"),
]


#: Extra columns of the odd rows: names that operators give to their own columns, and a type that cannot be compared.
EXTRA = {
    "lang_pred": ("string", "x"),
    "Score": ("double", 1.0),
    "component_id": ("string", "c"),
    "a.b": ("string", "d"),
    "n_words": ("string", "e"),
    "leaks": ("string", "f"),
    "kept": ("string", "g"),
    "toxicity": ("string", "h"),
    "c0": ("int", 4),
    **{name: ("string", f"own {name}") for name in ("block", "shard", "node", "id", "digest", "i0", "o0", "row", "part", "rest", "text_hash", "seq", "learned_", "word", "bucket", "rank")},
    "m": ("map<string,int>", {"k": 1}),
}


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns."""
    kinds = ", ".join(f"`{name}` {kind}" for name, (kind, _) in EXTRA.items())
    return spark.createDataFrame([(i, t, *(v for _, v in EXTRA.values())) for i, t in ODD], f"doc_id bigint, text string, {kinds}")


def extras_are_kept(rows, *replaced: str) -> bool:
    """Every extra column has its own value in all rows; `replaced` are outputs of the operator of the same name."""
    gone = {name.lower() for name in replaced}
    left = {name: value for name, (_, value) in EXTRA.items() if name.lower() not in gone}
    return bool(rows) and all(r[name] == value for r in rows for name, value in left.items())


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    """A small corpus with exact and near copies and shared passages, over short words."""
    rng = random.Random(3)
    passage = sentence(rng, 50)
    texts = [sentence(rng, rng.choice([3, 8, 30, 60, 120])) for _ in range(120)]
    texts += texts[:15]
    for t in texts[20:45]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{sentence(rng, 20)}\n{passage}  {sentence(rng, 25)}" for _ in range(12)]
    texts += ["De " * 90, "a b c d e f g h i j", "A B c d e f g h i j", "a b c d e f g h i k"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return spark.createDataFrame(small, "doc_id bigint, text string").repartition(5)
