"""Rows that every operator has to stand: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix potions in old stone towers near cold rivers"
ROWS = [
    (None, None), (None, "no id"), (1, WORDS), (2, WORDS.upper()), (3, WORDS), (3, WORDS), (4, ""), (5, None), (6, "   \n\t "),
    (7, (WORDS + ". ") * 700), (8, "one"), (9, "two words"), (10, WORDS + " tail"), (11, "é" * 300), (12, "x" * 150), (12, "other text of the same id"),
    (13, "<|endoftext|> <|startoftext|> ok"), (-14, "日本語 текст ﬁ İ Σας 🙂"), (15, "a\x00b"),
]


def documents(spark, rows=None, clash: bool = True):
    """Documents of odd rows, with a column whose name each operator uses for something else."""
    rows = ROWS if rows is None else rows
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if clash:
        for name in ("keep_id", "score", "pii", "fingerprint", "norm", "h", "d", "tie", "v", "id", "n", "edge", "first", "part", "key"):
            df = df.selectExpr("*", f"'clash' as {name}")
    return df
