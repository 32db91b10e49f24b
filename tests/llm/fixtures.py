"""A small corpus with every odd case: nulls, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, size string, doc int, h double, root string, n_lines int, quality_grade string, page int"


def corpus(seed: int = 1, n: int = 160) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    out = []
    passage = text(80)
    for i in range(n):
        body = text(rng.randint(1, 150)) + "\n" + text(rng.randint(3, 60))
        if i % 9 == 4:
            body = out[rng.randrange(len(out))][1]
        elif i % 9 == 7 and out:
            w = (out[rng.randrange(len(out))][1] or "x").split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            body = " ".join(w)
        elif i % 11 == 5:
            body = body + " " + passage + " " + text(20)
        if i % 4 == 0:
            body = "All rights reserved by nobody.\n" + body
        out.append((i * 3, body, "en", f"s{i % 12}"))
    out += [(1000, None, "en", "s1"), (1001, "", None, None), (1002, " \t\n \r\n", "en", "s2"), (1003, text(20_000), "en", None), (1004, "é́ ß中文 😀", "fr", "s3"), (1005, "x", "en", "s4")]
    out += [out[3], out[3], (None, text(30), "en", "s5"), (None, None, None, None)]
    return out


def frame(spark, rows=None):
    rows = corpus() if rows is None else rows
    return spark.createDataFrame([(a, b, c, d, len(b or ""), "r", 1, "s", 2, 0.5, "t", 3, "q", 4) for a, b, c, d in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
