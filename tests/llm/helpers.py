"""Small inputs with the cases every operator must handle."""

import contextlib
import random

#: Columns whose names clash with what operators add or use inside.
CLASHING = (
    "size", "source_size", "target", "copies", "taken", "n_words", "n_hit", "hits", "item_ids", "contaminated", "score", "predicted", "n_lines", "n_removed", "deduped",
    "n_bytes", "n_spans", "kept", "cleaned", "host", "path", "rule", "verdict", "key", "line", "said", "place", "gone", "cut", "comp", "class", "stays", "id", "n", "c0", "c1", "c7",
    "w", "h", "t", "copy", "spans", "raw", "fits", "values", "__values", "__deal", "__large_values", "__dl_id", "__dl_doc", "__dl_gone", "__dl_class", "__dl_copy", "__dl_source", "word_chars", "lost_chars",
)


@contextlib.contextmanager
def settings(spark, wanted: dict):
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def near_copies(rng: random.Random, n: int, families: int, words: int = 60) -> list[str]:
    """Texts in families: copies with a few words changed, and unrelated ones."""
    bases = [sentence(rng, words).split() for _ in range(families)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 8))):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        out.append(" ".join(w))
    return out


def odd_rows() -> list[tuple]:
    """(doc_id, text): nulls, empties, ties and repeats."""
    long = "lorem ipsum dolor " * 4000
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "a b c d e f g"), (7, "x"), (None, "a b c d e f g"), (None, None), (8, long), (9, long)]


def frame(spark, rows, extra=True):
    """doc_id, text, lang, source, n_chars and, with ``extra``, clashing columns."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t, "en", None if (i or 0) % 3 == 0 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("clash") for c in CLASHING}) if extra else docs
