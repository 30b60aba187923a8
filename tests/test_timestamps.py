import datetime as dt
import zoneinfo

import numpy as np

from marlstone.operators.timestamps import ROUNDS, expectation_maximisation, fit_mixture, normalise_timestamps


def us(*a, tz="UTC"):
    return (dt.datetime(*a, tzinfo=zoneinfo.ZoneInfo(tz)).astimezone(dt.timezone.utc) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


CASES = [
    ("2024-03-01T10:00:00Z", "Europe/Oslo", "dmy", us(2024, 3, 1, 10)),
    ("2024-03-01 10:00", "Europe/Oslo", "dmy", us(2024, 3, 1, 10, tz="Europe/Oslo")),
    ("2024-03-01T10:00:00.123456789Z", None, None, us(2024, 3, 1, 10, 0, 0, 123456)),
    ("2024-03-01T10:00:00+05:30[Asia/Kolkata]", "Europe/Oslo", None, us(2024, 3, 1, 4, 30)),
    ("2024-08-04 08:19:18 Europe/Oslo", "America/New_York", "mdy", us(2024, 8, 4, 6, 19, 18)),
    ("03/04/2024 07:05", "Europe/Oslo", "dmy", us(2024, 4, 3, 7, 5, tz="Europe/Oslo")),
    ("03/04/2024 7:05 PM", "America/New_York", "mdy", us(2024, 3, 4, 19, 5, tz="America/New_York")),
    ("3. desember 2025 kl. 05.46", "Europe/Oslo", "dmy", us(2025, 12, 3, 5, 46, tz="Europe/Oslo")),
    ("27/Dec/25 12:18 AM", "Europe/Oslo", "dmy", us(2025, 12, 27, 0, 18, tz="Europe/Oslo")),
    ("Apr 2, 2026 6:33:23 PM CEST", "Europe/Oslo", "dmy", us(2026, 4, 2, 16, 33, 23)),
    ("1742887278", None, None, 1742887278_000000),
    ("1742887278123", None, None, 1742887278_123000),
    ("20240629", "Europe/Oslo", "dmy", us(2024, 6, 29, tz="Europe/Oslo")),
    ("2024-10-27 02:30:00", "Europe/Oslo", "dmy", us(2024, 10, 27, 0, 30)),  # repeated hour: the first pass
    ("2024-03-31 02:30:00", "Europe/Oslo", "dmy", us(2024, 3, 31, 1, 30)),  # skipped hour: the offset before
    ("soon", None, None, None), ("", None, None, None), (None, None, None, None), ("4 days ago", None, None, None), ("0000-00-00", None, None, None), ("31/02/2024 10:00", "UTC", "dmy", None), ("x" * 5000, None, None, None),
]


def test_instants(spark):
    rows = [(i, v, "s", z, o, "clash") for i, (v, z, o, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:1], "id int, v string, s string, z string, o string, epoch_us string")
    got = normalise_timestamps(df, "v", "s", "z", "o", ["id"]).collect()
    assert len(got) == len(rows) + 1
    by = {r["id"]: r for r in got}
    for i, (v, _, _, expected) in enumerate(CASES):
        assert by[i]["epoch_us"] == expected, (v, by[i])
    assert by[13]["clock"] == "overlap" and by[14]["clock"] == "gap"
    assert normalise_timestamps(df.limit(0), "v", "s", "z", "o", ["id"]).count() == 0


def test_undeclared_order_is_learnt(spark):
    rows = [("a", f"{d:02d}/03/2024 10:00") for d in range(13, 28)] + [("a", "05/04/2024 10:00"), ("b", "05/04/2024 10:00")]
    got = normalise_timestamps(spark.createDataFrame(rows, "s string, v string"), "v", "s", keep=["s", "v"]).filter("v = '05/04/2024 10:00'").collect()
    by = {r["s"]: r for r in got}
    assert by["a"]["epoch_us"] == us(2024, 4, 5, 10) and not by["a"]["ambiguous"]
    assert by["b"]["ambiguous"]


def test_fit_prefers_evidence():
    post = fit_mixture(np.array([10.0, 1.0]), np.array([[1, 0], [1, 1]], float), np.array([1.0, 1.0]))
    assert post[1, 0] > 0.99


def test_evidence_outweighs_the_prior(spark):
    """An undeclared year-day-month source: what only that order can read decides what both can."""
    rows = [("a", f"2024-{d:02d}-{m:02d}") for d in range(13, 29) for m in range(1, 13)] * 10 + [("a", "2024-05-04")] * 10 + [("b", "2024-05-04")]
    got = normalise_timestamps(spark.createDataFrame(rows, "s string, v string"), "v", "s", keep=["s", "v"]).filter("v = '2024-05-04'").distinct().collect()
    by = {r["s"]: r for r in got}
    assert by["a"]["format"] == "year-day-month" and by["a"]["epoch_us"] == us(2024, 4, 5) and not by["a"]["ambiguous"]
    assert by["b"]["format"] == "iso" and not by["b"]["ambiguous"]


def test_mixed_evidence_is_ambiguous(spark):
    rows = [("a", f"{d:02d}/03/2024 10:00") for d in range(13, 23)] + [("a", f"03/{d:02d}/2024 10:00") for d in range(13, 23)] + [("a", "05/04/2024 10:00")] * 5
    got = normalise_timestamps(spark.createDataFrame(rows, "s string, v string"), "v", "s", keep=["v"]).filter("v = '05/04/2024 10:00'").collect()
    assert len(got) == 5 and all(r["ambiguous"] and abs(r["posterior"] - 0.5) < 1e-6 for r in got)


def test_the_declared_order_is_a_mask(spark):
    rows = [("03/25/2024", "dmy"), ("03/04/2024", "dmy")] + [(f"03/{d}/2024", "dmy") for d in range(13, 29)]
    got = {r["v"]: r for r in normalise_timestamps(spark.createDataFrame([(v, o, "s") for v, o in rows], "v string, o string, s string"), "v", "s", order="o", keep=["v"]).collect()}
    assert got["03/25/2024"]["epoch_us"] == us(2024, 3, 25) and got["03/04/2024"]["epoch_us"] == us(2024, 4, 3) and not got["03/04/2024"]["ambiguous"]


def test_the_fit_converges():
    masks = np.array([[1, 0], [1, 1]], float)
    for n, near in ((1_000.0, 1e-5), (1e6, 1e-4), (1e9, 1e-2)):  # at a billion, steps near the precision of floats
        pi, took = expectation_maximisation(np.array([1.0, n]), masks, np.array([0.1, 0.1]))
        assert took <= ROUNDS and abs(pi[0] - 1.1 / 1.2) < near
    rng = np.random.default_rng(0)
    for _ in range(20):  # the same as many plain steps
        masks, counts, alpha = (rng.random((6, 4)) < 0.5).astype(float), rng.integers(1, 50, 6).astype(float), rng.random(4) + 0.05
        masks[:, 0] = np.maximum(masks[:, 0], masks.sum(1) == 0)
        pi = alpha / alpha.sum()
        for _ in range(20_000):
            w = masks * pi
            pi = (counts[:, None] * w / w.sum(1, keepdims=True)).sum(0) + alpha
            pi /= pi.sum()
        assert np.abs(expectation_maximisation(counts, masks, alpha)[0] - pi).max() < 1e-5
    post = fit_mixture(np.array([9_000.0, 10.0]), np.array([[0, 1], [1, 1]], float), np.array([1.0, 1e-6]))
    assert post[1, 1] > 0.999
