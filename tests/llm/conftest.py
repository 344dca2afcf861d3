from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, d string, salt string, h string, id string, fp string, part string, keep_id string, rank string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    r = random.Random(1)
    words = ["alpha", "Beta", "gamma", "DELTA", "épée", "ß", "x1", "42", "日本", "don't"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    long_line = "this line of more than forty characters stands in many documents"
    rows = []
    for i in range(40):
        body = say(r.randint(1, 80))
        if i % 4 == 0:
            body += f"\n  {long_line.upper() if i % 8 else long_line} \n" + say(5)
        rows.append((i, body))
    rows += [(100, None), (101, ""), (102, "   \t\n "), (103, "SAME text"), (104, "same TEXT"), (105, "same text"), (105, "same text"), (None, "same text"), (106, "word " * 9000 + "end"), (107, "w" * 20000), (108, "123 456"), (None, None), (109, "😀 á İstanbul \x1c\x00 end"), (0, rows[0][1]), (110, rows[1][1] + " tail")]
    return spark.createDataFrame([(i, t, None if i in (3, None) else ("en", "fr")[i % 2], None, None, *"abcdefghi") for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
