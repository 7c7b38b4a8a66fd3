"""Small tables with the awkward cases every operator must survive."""

PASSAGE = " ".join(f"shared{i}" for i in range(60))
EXTRA = "kept string, component_id string, batch string, n_words string"


def awkward(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, clashing columns."""
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again today"),
        (2, "the quick brown fox jumps over the lazy dog again and again today"),
        (2, "the quick brown fox jumps over the lazy dog again and again today"),
        (3, None), (4, ""), (5, " \t\n "), (6, "One"), (7, "one"),
        (8, f"intro a b c {PASSAGE} outro d e f"), (9, f"other start {PASSAGE} other end x y z"),
        (10, PASSAGE), (11, long), (None, f"no id {PASSAGE}"), (None, None),
        (12, "mail ann.lee@mail.example.com or +1 (974) 555-3436 from 10.20.30.40, card 4111 1111 1111 1111."),
        (13, "é ü 漢字 \U0001F600 naïve façade <|endoftext|> don't 123  4"),
        (14, "x" * 30_000), (15, "same same same " * 400),
    ]
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows],
                                 f"doc_id long, text string, {EXTRA}")


def nothing(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")
