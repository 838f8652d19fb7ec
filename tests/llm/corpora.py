"""Small corpora with planted cases, and plain definitions to compare with."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def prose(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """Prose, copies, near copies, shared passages, empty, short, long and odd texts."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randrange(5, 200)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5]]
    for base in (texts[7], texts[9], texts[7]):
        w = base.split()
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(5)]
    texts += [None, "", " \n\t ", "one", "one two", "ONE Two", "é", "ñandú über 東京 text", "a" * 300, "ab " * 200]
    texts += ["x y z " * 60, prose(rng, 3000), " nb sp", "tail  ", "\x1cfs\x1f us", "line one\r\nline two\n"]
    rows = [(i * 3, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def odd(spark, rows):
    """The same with columns whose names operators use themselves, and null ids."""
    from pyspark.sql import functions as F

    df = frame(spark, [*rows, (None, "text without an id", "en", "s1", 18), (None, None, None, None, None)])
    clash = ["score", "node", "batch", "key", "ids", "words", "bucket", "sketch", "kept", "label", "row", "meta", "rank"]
    return df.select("*", *[F.lit(i).alias(name) for i, name in enumerate(clash)])


def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))
