"""Rows for the pipeline's tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_and_tables(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=14))
    rows = []
    for k in range(60):
        t = " ".join(rng.choices(words, k=60))
        if k % 6 == 0:
            t += " vile" + "abc"[k % 3]
        if k == 7:
            t = f"{t} {passage} {t[:40]}"
        rows.append((k, t, "en", f"s{k % 4}", len(t)))
    rows += [(100, rows[1][1], "en", "s1", None), (101, None, None, None, None), (102, "", "en", "s2", 0), (None, "without an id", "en", "s3", 13)]
    documents = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 0, int(k % 6 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    return documents, labels, spark.createDataFrame([(1, passage)], "item_id long, text string"), passage
