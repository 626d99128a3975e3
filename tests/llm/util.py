"""Frames of the tests of this folder."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, component string, score string, part string, tree int, row int, a int, b int, marks string, start string"


def docs(spark, rows):
    """Documents (id, text) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "x", "x", "x", "x", 1, 1, 1, 1, "x", "x") for i, t in rows], DOCS)


def prose(rnd: random.Random, words: int) -> str:
    return " ".join("".join(rnd.choice(["ba", "de", "lo", "mi", "nu", "ra", "sé"]) for _ in range(rnd.randrange(1, 5))) for _ in range(words))


#: Null, empty, blank, without letters, repeated rows and ids, a long text, a null id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "12 !? 34"), (5, "one word"), (5, "one word"), (None, "no id here"), (6, "x" * 30_000), (7, "ÄÖ ß é \u2028 z")]
