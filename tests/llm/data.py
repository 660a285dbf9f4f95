"""Small tables with the awkward cases every corpus operator must take."""
import random

WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "and", "Été", "größe", "naïve", "日本"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents():
    """(doc_id, text, lang, source, n_chars) rows: nulls, empties, copies, near copies, shared passages, long texts."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t, "en", f"src{i % 3}"))
    rows += [(100, base[3], "en", "src1"), (101, base[3], "fr", None), (102, base[3], "en", "src1")]
    for k in range(6):
        w = base[5].split()
        w[k * 3] = f"edit{k}"
        rows.append((110 + k, " ".join(w), "en", "src0"))
    for k in range(8):
        rows.append((130 + k, prose(rng, 40) + " " + passage + " " + prose(rng, 20), "en", "src2"))
    rows += [(150, None, "en", "src0"), (151, "", "en", "src1"), (152, "  \n\t ", "en", None),
             (153, "one", "en", "src0"), (154, "a b c d", "en", "src0"), (155, "a b c d", "en", "src0"),
             (156, "x y z v w " * 30, "en", "src2"), (157, "y" * 5000, "en", "src2"),
             (158, prose(rng, 9000), "en", "src0"), (159, "é" * 150 + " " + "ö" * 149, "de", "src0"),
             (160, "A! B!! " * 40, "en", "src1"), (161, "line one here\n" * 12, "en", "src1"),
             (162, base[7].upper(), "en", "src0"), (None, base[9] + " tail", "en", "src0"),
             (163, "%%% ### " * 30, "en", "src1"), (164, "nbsp\xa0joined words \x1c odd", "en", "src1")]
    rows += [(20, base[20], "en", "src2"), (165, prose(rng, 70), "en", "src2")]
    return [(d, t, la, s, None if t is None else len(t)) for d, t, la, s in rows]


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, parts=4):
    rows = documents() if rows is None else rows
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    return df.repartition(parts) if rows else df


def clashing(df):
    """The table with more columns, named like those that operators use inside."""
    from pyspark.sql import functions as F
    for c in ("n_words", "kept", "_row", "id", "node", "size", "spans", "copies", "text_hash", "label", "rate"):
        df = df.withColumn(c, F.lit("clash"))
    return df
