"""Small awkward inputs, and the rules said plainly in Python."""

import random
import re
import zlib

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("row", "words", "score", "size", "recipe", "fp", "key", "gone_id", "plan", "copy", "toxic", "kept", "times")


def awkward():
    rng = random.Random(5)
    syllables = ["the", "er", "on", "tion", "é", "ß", "and", "re", "ou", "ing"]

    def prose(n):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))

    base = prose(220)
    near = base.split()
    near[100] = "changed"
    repeated = "the same five words here " * 40
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", None, None, 1), (4, "One", "en", "b", 3),
        (5, base, "en", "a", 9), (6, base.upper(), "fr", "b", 9), (7, base, "en", None, 9), (8, " ".join(near), "en", "c", 9),
        (9, repeated, "en", "c", 9), (10, prose(30) + "\n" + "line\n" * 9 + "\n\n", "en", "c", 9),
        (11, "É é ΑΒΓ αβγ  İ ß ſ \u00a0x\u2003y\u0085z", "de", "d", 4), (12, prose(60000), "en", "d", 9),
        (13, "x" * 70000, "en", "d", 9), (None, prose(20), "en", "e", 9), (15, prose(20), None, "e", None),
        (16, "a # b * c $ d % e & f | g < h > i", "en", "a", 1), (17, "<|endoftext|> in <|endoftext|><|endoftext|> text", "en", "a", 1),
        (18, "l'été don't I'll we're 123 4567 !!??  \n\n  \t tab", "fr", "b", 1), (19, prose(300), "en", "a", 9),
        (20, "one two three", "en", "b", 1), (21, "one two three four", "en", "b", 1), (22, "one two", "en", "b", 1),
        (19, prose(10), "en", "zz", 9),
    ]
    rows += [(100 + i, base, "en", "a", 9) for i in range(40)]
    rows += [rows[4], rows[4]]  # repeated rows
    return rows


def frame(spark, rows, extra=False, fields=FIELDS):
    df = spark.createDataFrame(rows, fields).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns])
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(doc_id, n):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def normal(rows):
    return sorted((tuple(r) for r in rows), key=repr)
