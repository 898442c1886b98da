"""Small awkward tables for the operators' tests."""

import os
import random

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or add.
CLASHING = (
    "key part guest fp component lo hi at removed lines_removed spans ids n_tokens decoded fingerprint "
    "size shard slot bucket piece score lang_pred n_words _key _cell _t"
).split()

LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(20_000))


def texts():
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "se") for b in ("rn", "lop", "dax", "fi", "gum")]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = line(60)
    base = [line(80) for _ in range(4)]
    found = [None, "", " \n\t ", "a", "A b", "a b c", LONG, *base, *base, base[0].upper(), base[1] + " extra", passage]
    found += [f"{line(5)}\n{passage}\n{line(6)}" for _ in range(4)]
    found += [f"{t} mail me@example.com or +1 (437) 555-0689 from 10.0.0.1" for t in base]
    return found


def documents(spark, extra=False):
    """Nulls in every column, empty, blank, short and very long texts, copies, repeated rows and ids."""
    found = texts()
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t) if t else None) for i, t in enumerate(found)]
    rows += [rows[7], rows[7], (None, found[8], None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(-1) for c in CLASHING})
    return df


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def have_data():
    return os.path.isdir(SMALL)


def small(spark, name="documents", sf=SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet")
