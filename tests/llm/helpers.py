"""Small tables with the awkward cases that every operator is held against."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from which one you were her all she there would their we him been has when who will no more if out so".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "ly", "ing", "er"]) for _ in range(n)) + "."


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    out = [(i, prose(r, r.randint(5, 120)), r.choice(["en", "de"]), r.choice(["a", "b"]), 0) for i in range(n)]
    out += [(1000, None, "en", "a", None), (1001, "", None, None, 0), (1002, " \n\t ", "en", None, 3), (None, "no id here", "en", "a", 10)]
    out += [(1003, out[3][1], "en", "a", 0), (1003, out[3][1], "en", "a", 0), (1004, "x" * 5000, "de", "a", 0), (1005, prose(r, 6000), "en", "b", 0)]
    out += [(1006, "é漢字 😀 ñandú\r\nÜber\x0bstraße \xa0 nbsp", "es", "b", 0)]
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOC)


def clashing(df):
    """df with columns that have names the operators make."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("score", "kept", "fp", "n_words", "pool", "distance", "d2", "ids", "spans", "length", "start", "component_id", "held_out", "key", "cell", "tiles")})
