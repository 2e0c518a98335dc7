"""Small documents with the cases that every operator must handle."""

import random

LETTERS = "abc dé\n Ωß,.!'19漢字\t▁  <s> |# ́ \x1c\x85\r"

FIXED = [
    None,
    "",
    " ",
    "\n",
    "   \n \n",
    "plain words, and more words.",
    "plain words, and more words.",
    "  two  spaces\n\nand lines \n",
    "it's don't we'll THE <|endoftext|> </s> <unk>",
    "漢字かな交じり文 Ünïcode é \U0001f600\U0001f600",
    "x" * 700,
    "tab\tand nbsp em\x1csep\x85nel",
    "▁literal ▁▁mark",
    "nul\x00 in \x00 a text",
]


def texts(n: int = 60, seed: int = 7) -> list[str | None]:
    r = random.Random(seed)
    return FIXED + ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 120))) for _ in range(n)] + [" ".join(r.choice(["the", "of", "tion", "er", "ing."]) for _ in range(6000))]


def frame(spark, values, ids=None):
    """doc_id and text, with other columns whose names clash with results."""
    ids = ids or range(len(values))
    rows = [(i, v, "x", None, 1, -1) for i, v in zip(ids, values, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string, start int, score int")
