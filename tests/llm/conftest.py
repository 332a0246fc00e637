import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of a to in that is was for on as with by at from this be or it he".split()


def prose(seed: int, words: int, line: int = 12) -> str:
    rng = random.Random(seed)
    made = [f"{rng.choice(WORDS)}{rng.randrange(900)}" if rng.random() < 0.5 else rng.choice(WORDS) for _ in range(words)]
    return "\n".join(" ".join(made[k : k + line]) for k in range(0, len(made), line))


def edited(text: str, seed: int, edits: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


AWKWARD = [
    (900, None),
    (901, ""),
    (902, " \t\r\n\x0b\x0c "),
    (903, "one"),
    (904, "ONE Two"),
    (905, "Ünïcode ÉCOLE straße 中文 пример   \xa0 end\x1cof"),
    (906, "x" * 50_000),
    (907, "\n\n\n"),
    (908, "\x00 nul �"),
]


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) as a documents table, with an extra column that clashes with results."""

    def made(rows, partitions=3):
        full = [(d, t, None, None, None, "extra", 0.5, True) for d, t in rows]
        schema = f"{DOCS}, predicted string, score double, kept boolean"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return made
