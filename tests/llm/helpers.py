from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
#: Extra columns whose names operators use inside.
EXTRA = "id string, ids string, fp string, block string, score string, bucket string, data string, source string, lang string, v string, n string, tokens string, key string"
EXTRAS = len(EXTRA.split(","))


def documents(spark, rows, text="text", kind="long", source=None, parts=3):
    """A table of (doc_id, text) rows with clashing extra columns; source is set where it is given."""
    names = [c.split()[0] for c in EXTRA.split(", ")]
    full = []
    for i, (key, body) in enumerate(rows):
        extra = [f"x{i % 2}"] * EXTRAS
        if source is not None:
            extra[names.index("source")] = source[i]
        full.append((key, body, *extra))
    return spark.createDataFrame(full, f"doc_id {kind}, {text} string, {EXTRA}").repartition(parts)


def prose(seed, n=40):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


#: Nulls, empty and blank texts, one word, other scripts, a very long text, exact repeats, repeated rows, a null id.
EDGE = [
    (1, None), (2, ""), (3, " \t\n  "), (4, "word"), (5, "Zürich naïve 漢字 \U0001f600 Ωmega ٣٤"), (6, prose(1, 6000)), (7, prose(2)), (8, prose(2)), (7, prose(2)), (7, prose(2)),
    (None, "no id here"), (None, None), (9, "a b\r\nc\x0bd\x85e"), (10, "<|endoftext|> x <|endoftext|>"), (11, "x" * 5000), (12, "  lead and trail  "), (13, "don't we'll I'm 1234567 --- !!!"),
]
