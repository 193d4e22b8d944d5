"""Small fixtures shared by the tests of the corpus operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in rows], DOCS)


def sentence(k, n=60, salt="w"):
    """n words drawn by a fixed rule from k: texts of different k share few shingles."""
    return " ".join(f"{salt}{(k * 7919 + i * i * 31 + i * 17) % 997}x{(k + i) % 89}" for i in range(n))


def save(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


EMPTY = [(1, None, "a"), (2, "", "a"), (3, "   \n", None), (4, "!!", "b")]
