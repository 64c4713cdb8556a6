"""Small corpora for the tests of the pipeline's operators."""

from __future__ import annotations

import random

WORDS = [a + b for a in "ka lo mi su te ra vo ni".split() for b in ("", "n", "ro", "sti", "lande", "quo")]

#: Columns that share names with those the operators use inside.
CLASHING = "doc_id long, text string, id string, source string, lang string, score string, n int, run string, token string, words int"


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(n))


def corpus(seed: int, size: int = 120) -> list[tuple[int, str | None]]:
    """Documents with copies, near copies, shared passages, and every kind of odd text."""
    rnd = random.Random(seed)
    passage, line = sentence(rnd, 30), sentence(rnd, 14)
    texts: list[str | None] = []
    for i in range(size):
        kind = rnd.random()
        if texts and kind < 0.15:
            text = rnd.choice(texts)
            text = text and rnd.choice([text, text.replace(" ", "  "), text.replace(" ", "\n")])
        elif texts and kind < 0.45:
            words = (rnd.choice(texts) or "a b").split() or ["x"]
            for _ in range(rnd.randrange(1, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(WORDS)
            text = " ".join(words)
        elif kind < 0.6:
            text = f"{sentence(rnd, rnd.randrange(20))} {passage}\n{sentence(rnd, rnd.randrange(20))}"
        elif kind < 0.7:
            text = f"{sentence(rnd, 8)}\n{line}\n{sentence(rnd, 5)}"
        else:
            text = sentence(rnd, rnd.randrange(1, 120))
        texts.append(text)
    texts += [None, "", " ", "\n\t", "one", "One", "one two", "one two three", "ünïcödé Ünï \x0b wörds", "a\x00b c", "é" * 3000 + " x " * 500]
    numbers = rnd.sample(range(10 * len(texts)), len(texts))
    return list(zip(numbers, texts))


def frame(spark, rows):
    """The rows with columns of clashing names, over several partitions."""
    wide = [(i, t, "other", f"src{(i or 0) % 3}", "en", "0.5", 3, "r", "t", 1) for i, t in rows]
    return spark.createDataFrame(wide, CLASHING).repartition(3)
