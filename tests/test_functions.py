import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from cohortloom.config import CohortRanges, Settings
from cohortloom.functions import bands as B
from cohortloom.functions import clean as C
from cohortloom.functions import court as X
from cohortloom.functions import grids as G
from cohortloom.functions import names as N
from cohortloom.functions import rates as R
from cohortloom.functions.special import beta_reg, gamma_upper


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Luka Dončić", "luka doncic"), ("Kevin Porter Jr.", "kevin porter"), ("D'Angelo Russell", "dangelo russell"),
        ("P.J. Tucker", "pj tucker"), ("Nenê Hilário", "nene"), ("Robert Williams III", "robert williams"), (None, ""), ("  ", ""),
        ("Karl-Anthony Towns", "karl anthony towns"),
    ],
)
def test_names(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "n string")
    assert df.select(N.normalize_name("n").alias("x")).first()["x"] == want


@pytest.mark.parametrize(
    "a,b,low,high",
    [
        ("St. John's", "Saint John's", 85, 100), ("Kansas St.", "Kansas State", 85, 100), ("UConn", "Connecticut", 85, 100),
        ("Kansas", "Kansas State", 0, 99), ("University of Texas", "Texas", 85, 100), ("", "Texas", 0, 0),
    ],
)
def test_schools(spark, a, b, low, high):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert low <= df.select(N.school_similarity("a", "b").alias("x")).first()["x"] <= high


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_and_blocking_keys_lose_no_pair():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeno ") for _ in range(rng.randint(1, 14))).strip() or "a" for _ in range(160)]
    words += [w[:-1] + "x" for w in words[:40] if len(w) > 3]
    for t in (70, 75, 85, 92):
        keys = {w: set(N._pair_keys(w, t)) for w in words}
        for a in words:
            for b in words:
                r = N._ratio(a, b)
                assert abs(r - 200 * slow_lcs(a, b) / (len(a) + len(b))) < 1e-9
                if r >= t:
                    assert keys[a] & keys[b], (t, a, b, r)


def test_token_set_ratio():
    assert N._set_ratio("pooh richardson", "richardson") == 100
    assert N._set_ratio("a b", "c d") < 40
    assert N._set_ratio("", "x") == 0


def test_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in ["1,234", "$9,757,440", ".442", "+8.6", "", "abc", "1d", None, "-3"]], "s string")
    got = [r["x"] for r in rows.select(C.parse_number("s").alias("x")).collect()]
    assert got == [1234.0, 9757440.0, 0.442, 8.6, None, None, None, None, -3.0]
    assert one(spark, C.feet_inches(F.lit("6-9"))) == 81
    assert one(spark, C.end_year(F.lit("1999-00"))) == 2000
    assert one(spark, C.span_label(F.lit(2000))) == "1999-00"
    assert one(spark, C.trailing_parenthesis(F.lit("Real Club (Spain)"))) == "Spain"
    assert one(spark, C.trailing_parenthesis(F.lit("Town (CA)"))) is None


def test_transforms_keep_null(spark):
    null = F.lit(None).cast("double")
    for f in (R.to_log, R.to_sqrt, R.from_log, R.from_sqrt):
        assert one(spark, f(null)) is None
        assert one(spark, f(F.lit(-4.0))) == 0
    assert abs(one(spark, R.from_log(R.to_log(F.lit(2.5)))) - 2.5) < 1e-12


def test_bands(spark):
    got = [one(spark, B.recruit_group(F.lit(v).cast("double"))) for v in (1, 10, 11, 25, 100, 101, None)]
    assert got == ["RSCI 1-10", "RSCI 1-10", "RSCI 11-25", "RSCI 11-25", "RSCI 51-100", "Unranked", "Unranked"]
    assert one(spark, B.digitize(F.lit(5), [5, 14])) == 1
    assert one(spark, B.digitize(F.lit(5), [5, 14], right_closed=True)) == 0
    assert one(spark, B.honour(F.lit(10), F.lit(0), F.lit(0), F.lit(0))) == "Legend"
    assert one(spark, B.honour(F.lit(1), F.lit(2), F.lit(0), F.lit(0))) == "Superstar"
    assert one(spark, B.career_status(F.lit(2), F.lit(True))) == "Career Grade (retired)"
    assert one(spark, B.career_status(F.lit(0), F.lit(True))) == "Projection"
    assert one(spark, B.career_status(F.lit(8), F.lit(False))) == "Career Grade"


def test_cdf_with_point_mass(spark):
    grid = F.array(*[F.lit(v) for v in [0.0] * 6 + [0.1 * i for i in range(1, 14)]])
    assert abs(one(spark, G.cdf(grid, F.lit(0.0))) - 0.30) < 1e-9
    assert one(spark, G.cdf(grid, F.lit(-1.0))) == 0
    assert one(spark, G.cdf(grid, F.lit(99.0))) == 1
    assert abs(one(spark, G.pit(grid, F.lit(0.0))) - 0.15) < 0.02
    assert one(spark, G.cdf(grid, F.lit(None).cast("double"))) is None


def test_crps_close_to_normal_closed_form(spark):
    d = NormalDist()
    q = F.array(*[F.lit(d.inv_cdf(t)) for t in G.LEVELS])
    y = 0.3
    exact = y * (2 * d.cdf(y) - 1) + 2 * d.pdf(y) - 1 / math.sqrt(math.pi)
    assert abs(one(spark, G.crps(F.lit(y), q)) - exact) < 0.03
    assert one(spark, G.pinball(F.lit(1.0), F.lit(0.0), 0.9)) == pytest.approx(0.9)
    assert one(spark, G.pinball(F.lit(0.0), F.lit(1.0), 0.9)) == pytest.approx(0.1)


def test_grid_tools(spark):
    q = F.array(*[F.lit(float(i)) for i in range(1, 20)])
    tp = one(spark, G.tier_probabilities(q, [2.0, 5.0, 9.0, 12.0, 18.0]))
    assert abs(sum(tp) - 1) < 1e-12 and min(tp) >= 0
    b = one(spark, G.blend([q, F.array_repeat(F.lit(0.0), 19)], [1, 3]))
    assert b[3] == 1.0
    assert one(spark, G.expected_value(F.array_repeat(F.lit(2.0), 19))) == pytest.approx(2.0)
    s = one(spark, G.shrink_floor(q, F.lit(0.0), F.lit(0.7)))
    assert s[4] == pytest.approx(3.5) and s[5] == 6.0
    lo, hi = (one(spark, c) for c in G.wilson(F.lit(8.0), F.lit(10.0)))
    assert 0.49 < lo < 0.5 and 0.94 < hi < 0.95


def test_zones(spark):
    def z(d, dx, dy, three):
        return one(spark, X.zone(F.lit(d), F.lit(dx), F.lit(dy), F.lit(three)))

    assert z(3.0, 1.0, 2.0, False) == "rim" and z(4.0, 1.0, 2.0, False) == "short_mid" and z(14.0, 1.0, 2.0, False) == "long_mid"
    assert z(22.0, 21.0, 3.0, True) == "corner_three" and z(24.0, 2.0, 23.0, True) == "above_break_three"
    assert one(spark, X.shot_kind(F.lit("TipShot"), F.lit("tip dunk"), F.lit(2))) == "dunk"


def test_special():
    assert gamma_upper(1, 2) == pytest.approx(math.exp(-2))
    assert gamma_upper(0.5, 1.920729) == pytest.approx(0.05, abs=1e-4)
    assert beta_reg(2, 3, 0.4) == pytest.approx(0.5248)


def test_settings():
    r = CohortRanges((1996, 2017), (2018, 2025), (2026, 2026))
    assert len(r.years()) == 31
    Settings(r, 2025)
    with pytest.raises(ValueError):
        CohortRanges((1996, 2018), (2018, 2025), (2026, 2026))
    with pytest.raises(ValueError):
        Settings(r, 2025, horizon=0)
