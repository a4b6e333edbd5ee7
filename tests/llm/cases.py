"""Small document tables with the awkward cases, shared by the tests here."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward_texts() -> list[str | None]:
    """Nulls, empties, blanks, one very long text, copies, near copies, ties."""
    long_one, base = words(1, 30_000), words(2, 120)
    near = [" ".join(w if i != 20 + 7 * k else f"edit{k}" for i, w in enumerate(base.split())) for k in range(6)]
    return [None, "", " \t\n", "x", "one two three four", long_one, long_one, base, base, base.upper(), *near, words(3, 50), words(4, 60), None, ""]


def documents(spark, texts: list[str | None] | None = None, clash: bool = True):
    texts = awkward_texts() if texts is None else texts
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:  # columns with the names that operators use inside
        for name in ("_k", "_text", "size", "keep_id", "node", "unit", "kept", "label", "_p", "_words", "rank", "copies"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
