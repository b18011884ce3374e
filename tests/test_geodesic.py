"""Geodesics on the ellipsoid against integrals, known distances and each other."""

from __future__ import annotations

import numpy as np
import pytest

from meridia.functions import geodesy as D


def test_known_distances():
    #: Half the equator's antipodal geodesic runs over the pole; the quarter meridian.
    quarter = 10001965.729
    assert D.inverse(0, 0, 0, 90)[0] == pytest.approx(quarter, abs=0.01)
    assert D.inverse(0, 0, 180, 0)[0] == pytest.approx(2 * quarter, abs=0.01)
    assert D.inverse(0, 0, 1, 0)[0] == pytest.approx(np.radians(1) * D.A, abs=1e-6)
    assert D.inverse(0, 0, 179.5, 0.5)[0] == pytest.approx(19936288.579, abs=0.01)  # a pair that Vincenty's steps fail on


def test_there_and_back():
    rng = np.random.default_rng(1)
    lon, lat, far, azimuth = rng.uniform(-180, 180, 400), rng.uniform(-85, 85, 400), rng.uniform(1, 1.9e7, 400), rng.uniform(0, 360, 400)
    x, y, end = D.direct(lon, lat, azimuth, far)
    metres, start, last = D.inverse(lon, lat, x, y)
    assert np.allclose(metres, far, atol=1e-3)
    turn = lambda a, b: np.abs((a - b + 180) % 360 - 180)
    assert (turn(start, azimuth) * np.sin(far / 6.37e6) < 1e-5).all() and (turn(last, end) * np.sin(far / 6.37e6) < 1e-5).all()
    assert np.allclose(D.inverse(x, y, lon, lat)[0], metres, atol=1e-6)


def test_near_antipodes_by_direct():
    rng = np.random.default_rng(2)
    lon, lat = rng.uniform(-180, 180, 100), rng.uniform(-80, 80, 100)
    x, y = lon + 180 + rng.uniform(-0.6, 0.6, 100), -lat + rng.uniform(-0.6, 0.6, 100)
    metres, start, _ = D.inverse(lon, lat, x, y)
    u, v, _ = D.direct(lon, lat, start, metres)
    gap = D.inverse(u, v, x, y)[0]
    assert np.isfinite(metres).all() and gap.max() < 0.5 and metres.max() <= 20003931.5


def test_columns(spark):
    df = spark.createDataFrame([(0.0, 0.0, 90.0, 0.0), (0.0, 50.0, 10.0, 60.0), (None, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    rows = df.select(D.geodesic_inverse("a", "b", "c", "d").alias("i"), D.geodesic_interpolate("a", "b", "c", "d", 0.5).alias("m"), D.vincenty("a", "b", "c", "d").alias("v")).collect()
    assert rows[0]["i"]["azimuth1"] == pytest.approx(90) and rows[0]["m"]["lon"] == pytest.approx(45) and rows[1]["v"] == rows[1]["i"]["distance"]
    half = D.inverse(0, 50, rows[1]["m"]["lon"], rows[1]["m"]["lat"])[0]
    assert half == pytest.approx(rows[1]["v"] / 2, abs=1e-3)
    assert rows[2]["v"] is None or np.isnan(rows[2]["v"])
    end = df.limit(1).select(D.geodesic_direct("a", "b", 90, 1000).alias("p")).first()["p"]
    assert end["lon"] == pytest.approx(np.degrees(1000 / D.A))
