"""Small tables with the cases that every operator must handle."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with the names of the operators' own results.
EXTRA = DOCS + ", n_lines long, score double, shared array<int>, label string"


def odd_documents(spark, ddl=EXTRA):
    long_line = "Eine sehr lange Zeile ohne Ende " * 3000
    rows = [
        (1, "The same words of a text that repeats itself, word for word.\nSecond line here.", "en", "a", 1),
        (2, "The same words of a text that repeats itself, word for word.\nSecond line here.", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, "\n\n \t\r\n", "de", "b", 4),
        (6, long_line, "de", "b", len(long_line)),
        (7, "x", "en", "", 1),
        (8, "12345 !!! ###", None, "c", 9),
        (9, "<|endoftext|> J̌ café café 你好 \U0001f600 don't İ ΣΣ", "fr", "c", 9),
        (9, "a row that repeats another row's id", "en", "c", 9),
        (None, "a row without an id, which says nothing new at all", "en", "c", 9),
        (10, "SECOND LINE HERE.  \nsecond line here.", "en", "a", 1),
        (10, "SECOND LINE HERE.  \nsecond line here.", "en", "a", 1),
    ]
    return spark.createDataFrame([(*r, 7, 0.5, [1], "q") for r in rows], ddl)


def empty_documents(spark):
    return spark.createDataFrame([], EXTRA)
