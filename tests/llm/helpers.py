"""Small tables for the training-data tests."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names clash with what operators use inside, or with each other but for case.
ODD = "doc_id bigint, text string, TEXT string, copies int, k1 string, id string, `__c0` int, score double, n_chars bigint"


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)


def odd(spark, rows):
    spark.conf.set("spark.sql.caseSensitive", "true")
    return spark.createDataFrame([(i, t, "x", 1, "k", None, 2, 0.5, 3) for i, t in rows], ODD)


def prose(seed, n, words=400):
    """n made-up words from a fixed vocabulary with a long tail."""
    r = random.Random(seed)
    vocab = [f"w{chr(97 + k % 26)}{k}" for k in range(words)]
    return " ".join(vocab[min(int(r.paretovariate(0.7)) - 1, words - 1) if r.random() < 0.5 else r.randrange(words)] for _ in range(n))


HARD = [(None, "no id here"), (1, None), (2, ""), (3, " \n\t\n "), (4, "same text"), (4, "same text"), (5, "same text"), (6, "!!! ???"), (7, "x"), (8, "é ß 中文 🙂"), (9, "long " * 20_000)]
