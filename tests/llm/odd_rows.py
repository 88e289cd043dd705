"""Rows with what real tables may hold (see conftest)."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, code long, norm string, row long, n int, ids string, score double, doc string, at long")
LONG = "many words in a long line " * 9000
SOLID = "x9" * 40000


def rows_of(texts):
    """(doc_id, text, lang, source) with the other columns filled in."""
    return [(i, t, lang, src, None, 1, 2, "n", 3, 4, "ids", 0.5, "d", 5) for i, t, lang, src in texts]


ODD = rows_of([
    (1, "one two three four five six", "en", "a"), (2, "one  two\tthree four five six", "en", "a"),
    (3, None, "en", "a"), (4, "", None, "b"), (5, "   ", "en", None), (6, " ", None, None), (None, "no identifier here", "en", "b"),
    (None, "no identifier here", "en", "b"), (None, None, None, None), (7, "again", "en", "a"), (7, "again", "en", "a"),
    (8, LONG, "en", "b"), (9, SOLID, None, "b"), (10, "Ünïcödé 漢字 😀 text\x00", "de", "c"), (11, "!!! ***", "de", "c"),
    (12, LONG + "end", "en", "b"), (7, "same identifier, other text", "en", "a")])
