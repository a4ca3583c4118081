"""Small frames with the columns of ``documents``."""


def frame(spark, rows, lang="en", source="s"):
    """rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else lang, r[3] if len(r) > 3 else source, len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
