"""Small tables that hold every edge case, for the tests of this folder."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, predicted int, label int, rep long, id string, declared string, host string"
WORDS = "the of and to in river stone garden window market silver morning letter travel kitchen bridge winter yellow forest music doctor island paper engine mirror castle summer village pocket rocket planet basket candle ribbon shadow thunder velvet walnut zebra anchor".split()


def text_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90) or "") for _ in range(n))


def rows(texts: list, first: int = 0) -> list[tuple]:
    """Rows of SCHEMA, with columns that clash with those operators make."""
    return [(first + i, t, ["en", "de", None][i % 3], [None, "src.example.com", "a.org"][i % 3], len(t or ""), 0.5, False, 7, 3, -1, "x", "zz", "h") for i, t in enumerate(texts)]


def edge_texts() -> list:
    long = text_of(random.Random(5), 30_000)
    return [None, "", " \n\t ", "word", "Word", "two words", "two words", long, "€ 😀 ünïcode ", "A\nA\nA\n", "\x00\x1f", "x" * 50_000, None, "  lead and trail  "]


def edge_docs(spark):
    """Edge texts, then a repeated row and a row without an id."""
    all_rows = rows(edge_texts())
    return spark.createDataFrame([*all_rows, all_rows[5], (None, "two words", None, None, None, None, None, None, None, None, None, None, None)], SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
