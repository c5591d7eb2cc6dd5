"""A small table with what the operators have to cope with, and an empty one; clashing columns included."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, recipe string, spans string, shard int, count long"

LONG = "Word by word the text goes on and on, line after line. " * 4000
NEAR = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 12

ROWS = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "one", "en", "b"), (5, "one two", "en", "b"), (6, LONG, "en", "c"), (7, LONG, "en", "c"),
    (8, NEAR, "en", "d"), (9, NEAR + "end", "en", "d"), (10, NEAR + "stop here", "en", "d"), (10, NEAR + "stop here", "en", "d"), (11, "Ünï çødé ﬁ 😀 text\x00here", "de", "e"),
    (None, "no id, but text", None, None), (None, None, None, None), (12, "12345 --- 67890", None, "f"), (13, "one", "fr", "b"), (14, "ONE", "fr", "b"),
    (15, "Write to a.b@example.com or 10.0.0.255, card 4111 1111 1111 1111, call +1 (375) 555-4393.", "en", "g"),
]


def table(spark, rows=ROWS):
    full = [(i, t, la, s, None if t is None else len(t), 7, "x", "y", 3, 9) for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)
