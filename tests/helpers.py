import math

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    """Column names, and rows as sorted tuples with plain values."""
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False, name=None):
        out = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                out.append(None)
            elif isinstance(v, float):
                out.append(round(v, 6))
            else:
                out.append(v.item() if hasattr(v, "item") else v)
        rows.append(tuple(out))
    return list(frame.columns), sorted(rows, key=repr)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
