"""Small frames and their rows."""

from tabframe import Frame


def frame(spark, rows, schema):
    return Frame.of(spark.createDataFrame(rows, schema))


def rows(value):
    """Rows of a frame or DataFrame as sorted tuples, NULL first."""
    df = value.df if hasattr(value, "df") else value
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))


def ordered(value):
    return [tuple(r) for r in value.df.collect()]


def placed(value):
    """Rows of a frame in position order, checking that positions are dense."""
    got = sorted(tuple(r) for r in value.positions().collect())
    assert [r[0] for r in got] == list(range(len(got)))
    return [r[1:] for r in got]
