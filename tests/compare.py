"""Row sets of a Spark query and its SQL, compared by value."""


def rows(df):
    out = []
    cols = sorted(df.columns)
    for r in df[cols].itertuples(index=False):
        out.append(tuple(None if v is None or v != v else (round(float(v), 5) + 0.0 if isinstance(v, float) else str(v)) for v in r))
    return cols, sorted(out, key=str)


def same(spark_df, duck_df):
    (ca, a), (cb, b) = rows(spark_df), rows(duck_df)
    assert ca == cb
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 * (1 + abs(q))) or str(p) == str(q) for p, q in zip(x, y)), (x, y)
