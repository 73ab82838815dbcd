import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from areaweave.functions import geometry as g  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def no_auto_broadcast(spark):
    """Spark's own size check off, so that a join without a hint really shuffles."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def box(x0, y0, x1, y1):
    return [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]]


def frame(spark, rows, columns):
    """Rows with a last column (gtype, srid, parts) or None become a geometry table."""
    data = []
    for *values, geom in rows:
        data.append((*values, None if geom is None else (geom[0], geom[1], geom[2])))
    return spark.createDataFrame(data, f"{columns}, geom {g.GEOMETRY_SQL}")


def polygon(parts, srid=4326):
    return ("Polygon" if len(parts) == 1 else "MultiPolygon", srid, parts)


def line(*points, srid=4326):
    return ("LineString", srid, [[list(points)]])


def point(x, y, srid=4326):
    return ("Point", srid, [[[(x, y)]]])


def one(df, expression):
    return df.select(F.expr(expression).alias("v")).head()["v"]
