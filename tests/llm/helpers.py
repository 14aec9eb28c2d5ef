"""A small documents table with the awkward rows every operator must take."""

LONG = " ".join(f"word{i % 97}x{i % 89}" for i in range(6000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, "!!! ... ---", "de", None),
    (5, LONG, "en", "a"),
    (6, "The quick brown fox jumps over the lazy dog near the river bank.", "en", None),
    (6, "The quick brown fox jumps over the lazy dog near the river bank.", "en", None),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund am Fluß.", "de", "c"),
    (7, "İstanbul'da   ΣΑΣ ½ ² <|endoftext|> naïve é", "fr", "c"),
    (8, "un deux trois quatre", "fr", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, row long, size string, length int, n int, key int"


def documents(spark, rows=ROWS):
    """Columns beyond the usual ones have names that operators use inside."""
    return spark.createDataFrame([(*r, 9, "x", 9, 9, 9) for r in rows], SCHEMA)


def relayout(spark, monkeypatch, *modules):
    """Let files be cut and dealt differently after every table that the modules write."""
    from tidemark.llm import common

    sizes, real = iter([200, 4096, 1 << 20, 900, 64 << 20, 300] * 200), common.written

    def written(df):
        out = real(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(next(sizes)))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return out

    for m in (common, *modules):
        if hasattr(m, "written"):
            monkeypatch.setattr(m, "written", written)
