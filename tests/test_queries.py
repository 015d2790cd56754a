"""Every query of the point operators against its SQL, on the smallest tables."""

import datetime
import decimal
import math

import pytest
from pyspark.sql import functions as F

from pointlake.operators.filters import FILTERS
from pointlake.operators.transforms import TRANSFORMS
from pointlake.plans import catalogue
from pointlake.plans.point_cases import FILTER_CASES, TRANSFORM_CASES, points_sql
from pointlake.schema import lineitem_points


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.5g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def close(a, b):
    """Equal, but for what rounding makes of real numbers."""
    return all(x == y or _near(x, y) for x, y in zip(a, b, strict=True))


def _near(x, y):
    try:
        return math.isclose(float(x), float(y), rel_tol=1e-4)
    except ValueError:
        return False


def chunks(names, n):
    names = sorted(names)
    return [names[i : i + n] for i in range(0, len(names), n)]


@pytest.mark.parametrize("names", chunks(FILTER_CASES, 30), ids=lambda n: n[0])
def test_filters(spark, duck, sf_dir, names):
    points = lineitem_points(spark, sf_dir)
    got = points.agg(*[F.sum(F.when(FILTERS[n](*FILTER_CASES[n][0]), F.col("xi").cast("long") * 7 + F.col("zi"))).alias(n) for n in names]).first()
    sums = ", ".join(f"CAST(sum(CAST(xi AS BIGINT) * 7 + zi) FILTER ({FILTER_CASES[n][1]}) AS BIGINT)" for n in names)
    assert tuple(got) == duck.execute(points_sql(f"SELECT {sums} FROM pts")).fetchone()


@pytest.mark.parametrize("names", chunks(TRANSFORM_CASES, 12), ids=lambda n: n[0])
def test_transforms(spark, duck, sf_dir, names):
    points = lineitem_points(spark, sf_dir)
    for name in names:
        args, exprs = TRANSFORM_CASES[name]
        key = F.col("source_file").cast("long") + 1
        got = TRANSFORMS[name](points, *args).agg(*[F.sum(F.col(c).cast("double") * key).alias(c) for c in exprs]).first()
        sums = ", ".join(f"sum(CAST({e} AS DOUBLE) * (CAST(source_file AS BIGINT) + 1))" for e in exprs.values())
        want = duck.execute(points_sql(f"SELECT {sums} FROM pts")).fetchone()
        assert tuple(got) == pytest.approx(want, rel=1e-9), name


OTHERS = sorted(set(catalogue.ORACLE_SQL) - set(FILTER_CASES) - set(TRANSFORM_CASES))


@pytest.mark.parametrize("name", OTHERS)
def test_query(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall())
    assert len(got) == len(want)
    assert all(close(a, b) for a, b in zip(got, want, strict=True))


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
