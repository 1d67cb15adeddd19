from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, n_chars long, node string, bucket int, length long, n long, rank int, band int"
#: Extra columns whose names operators use inside.
EXTRA = ("xx", 3, "node", 7, 8, 9, 10, 11)


def docs_of(spark, rows):
    """A documents table with clashing extra columns; rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", len(t) if t else 0, *EXTRA[2:4], *EXTRA[4:8])[:10] for i, t in rows], DOCS)


def words(seed: int, n: int, size: int = 3000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size):x}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "none at all here"), (6, "ж" * 50 + " \x85  é́ \U0001f600"), (7, words(7, 30_000)), (8, "a\r\nb\x0bc\x0cd")]
