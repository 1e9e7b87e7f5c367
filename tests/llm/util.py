"""Small fixtures that every operator must bear: nulls, empties, long texts, ties, repeated rows, clashing names."""

import duckdb
import pandas as pd
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def docs_of(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [
    (1, "The cat sat on the mat.\nAnother line that is rather long and has many words in it today."),
    (2, None), (3, ""), (4, " \t\n"), (5, "One"), (5, "One"), (None, "one two three four five six"),
    (7, "The cat sat on the mat.\r\nIt's NOT the café's naïve ΣΑΣ; 12345 ½ 你好 🙂 we're <|endoftext|> they'll x"),
    (8, "word " * 30_000), (9, "x" * 20_000), (10, "The  cat sat\ton the mat. \n"), (11, "The cat sat on the mat."),
]


def with_clashes(df):
    """The same rows with more columns, named as the operators name their own."""
    from pyspark.sql import functions as F

    for name in ("size", "h", "row", "bucket", "digest", "pos", "words", "fingerprint", "u", "v", "k", "component", "score", "n", "m"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def duck(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toArrow() if hasattr(df, "toArrow") else df)
    return con.sql(sql).df()


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    norm = lambda rows: sorted(map(repr, [tuple(int(x) if isinstance(x, (bool, int)) or isinstance(x, float) and x == int(x) else x for x in r) for r in rows]))
    rows = lambda f: [tuple(None if pd.isna(x) else (round(float(x), 6) if isinstance(x, float) else x) for x in r) for r in f[cols].astype(object).itertuples(index=False)]
    assert norm(rows(a)) == norm(rows(b))


#: Ids beyond 2^53, which a float can't tell apart, beside a null.
BIG = 2**62 + 12345
