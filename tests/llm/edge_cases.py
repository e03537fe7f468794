"""Rows and column names that every operator has to bear."""

#: Null and empty texts, white space only, ties, repeated rows, null ids, odd characters and a long text.
EDGE = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, "one two", "en"), (4, "one two", "en"), (5, "one two", "fr"),
    (None, "no id here", "en"), (None, "no id here", "en"), (6, "é漢🙂 a\x00b \x1c c d e  two  spaces\n\nend ", "en"), (7, "word " * 30_000, "en"),
    (8, "x" * 50_000, "en"), (-9, "negative id <|endoftext|> it's 1,234.5", "de"),
]
#: Different texts under null and repeated ids.
SAME_IDS = [(None, "first of two rows that have no id at all", "en"), (None, "second row without any id is another text", "en"),
            (5, "fifth document as it was written once", "en"), (5, "another document that also calls itself five", "fr"), (7, "seven stands alone in this small table", "en")]
#: Columns that operators make themselves, as extra ones.
CLASH = ["ids", "fp", "n_words", "kept", "spans", "_w", "_d", "_row", "part", "score", "repeats", "copy", "a"]
