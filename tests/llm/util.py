"""Small inputs that hold the awkward cases."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, k_id long, size long, term string"
LONG = " ".join(f"word{i % 977} und" for i in range(30_000))


def rows():
    base = "The quick brown fox jumps over the lazy dog and runs to the river bank in the early morning light of May."
    texts = [
        (1, base), (2, base), (3, base + " Extra."), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one two three"), (9, LONG), (None, base), (None, "other words here for once"),
        (10, "x" * 50_000), (11, "mail me at ann.lee@example.org or +1 (555) 123-4567, card 4111 1111 1111 1111, ip 10.0.0.1"), (11, "a second row of the same id"), (12, "ünï cödé ß 漢字 كلمة 😀"), (2, base),
    ]
    return [(i, t, ["en", "de", None][k % 3], ["s1", None, "s2"][k % 3], len(t or ""), 7, 0.5, 9, 1, "z") for k, (i, t) in enumerate(texts)]


def documents(spark):
    return spark.createDataFrame(rows(), DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)
