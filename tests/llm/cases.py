"""Rows with everything that can be odd about a table of documents."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, h string, id string, size string, `a b` string"


def odd_documents():
    texts = [
        (1, "Hello World this is a text"), (2, "hello world THIS is a text"), (3, None), (4, ""), (5, "   \n\t "), (6, "É é ß straße"), (7, "é É ß straße"),
        (8, "word " * 3000), (8, "word " * 3000), (9, "WORD " * 3000), (10, "one"), (None, "no id"), (None, None), (11, "12345 !!! 678"),
        (12, "the mit license and the apache license, cc by, GNU General  Public\nLicense"), (13, "a" * 9000 + " b"), (14, "a" * 9000 + " c"), (15, "ÀB\x00\x1f x"),
    ]
    rows = []
    for k, (i, t) in enumerate(texts):
        rows.append((i, t, ["en", "fr", None][k % 3], ["s1", "s2", None][k % 3], None if k % 4 == 0 else k, "x", "y", "z", None, "w"))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
