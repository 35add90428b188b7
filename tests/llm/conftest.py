import random

import pytest

LANGS = {"aa": "tra lo mi sen dor vel kar ton".split(), "bb": "zug wer pim nok lat hib sof rud".split()}


def prose(rng, n, lang="aa"):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with results."""
    rng = random.Random(7)
    a, b = prose(rng, 120), prose(rng, 60)
    rows = [
        (0, a), (1, None), (2, ""), (3, " \n\t "), (4, a), (4, a), (5, a.upper()), (6, b + " " + a), (None, a), (7, "one"), (8, "x" * 5000), (9, "word " * 400), (10, prose(rng, 4000)), (11, "é漢字 ☃ " * 30), (12, a + " " + prose(rng, 3)), (None, None), (13, "four words are here"), (14, "four words are here"),
    ]
    full = [(i, t, "en", None, 1, True, 0.5, "z") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, component_id string")
