"""Small fixtures with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, shard string"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); the extra columns clash with result names on purpose."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None, "clash", "clash") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


AWKWARD = [(1, None), (2, ""), (3, "a"), (4, "one two three"), (5, "one two three"), (5, "one two three"), (None, "no id"), (6, "Ünï çødé " * 50), (7, "long words " * 9000), (8, "\t \n"), (9, "x\x00y \x01 z <|endoftext|> é H̱")]
