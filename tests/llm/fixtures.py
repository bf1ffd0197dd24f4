"""Documents with the awkward cases, and columns whose names clash."""
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row long, key string, word string, score double, fp long, "
          "block string, held int, _id string, z string, x double, n long, cell int, coarse int, next_text string, b int, g string, r string, shard int")
EXTRA = (7, "k", "w", 0.5, 1, "blk", 2, "i", "z", 1.5, 9, 3, 4, "nt", 5, "g", "r", 6)


def frame(spark, rows, parts=3):
    """rows: (doc_id, text)."""
    full = [(i, t, None, "s", None if t is None else len(t), *EXTRA) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.repartition(parts) if rows else df


LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(6000))
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (3, ""), (4, None), (5, " \t\n "), (6, LONG), (None, "no id here at all"), (None, None),
    (7, "one"), (8, "élan vital Ünïcode \U0001f600 text\u00a0with\u2003odd spaces"), (9, "a" * 3000),
]


def empty(spark):
    return frame(spark, [(1, "x")]).filter("doc_id < 0")
