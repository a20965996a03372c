"""Small document tables with the cases every operator must take."""

LONG = "word " * 40_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """Rows of (doc_id, text[, lang[, source]]); `extra` adds columns whose names operators use."""
    full = [(i, t, *(list(r) + ["en", "src1"][len(r) :]), len(t or "")) for i, t, *r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for name in ("score", "kept", "id", "key", "n", "t", "component_id", "_text", "rejected", "removed", "epoch"):
            df = df.withColumn(name, df["doc_id"] * 0)
    return df


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "same text here"), (5, "same text here"), (6, "same text here"),
    (7, "été 123 ß"), (8, "12 34 !!"), (None, "text without id"), (9, "\x00odd\x1f\u2028 bytes \U0001f600"),
]
