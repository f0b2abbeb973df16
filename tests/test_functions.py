"""Distribution functions against published values, closed forms and one another; formulas and designs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubelark.functions import formula as M
from cubelark.functions import special as S


@pytest.mark.parametrize("z, p", [(0.0, 0.5), (1.959963984540054, 0.025), (6.0, 9.865876450376946e-10), (10.0, 7.619853024160495e-24)])
def test_normal_tail(z, p):
    assert S.norm_sf(z) == pytest.approx(p, rel=1e-12)
    assert S.norm_isf_log(math.log(p)) == pytest.approx(z, abs=1e-9)


def test_far_normal_tails_stay_finite():
    for z in (31.0, 50.0, 200.0, 3000.0):
        assert S.norm_isf_log(float(S.norm_logsf(z))) == pytest.approx(z, rel=1e-9)


@given(st.floats(-30, 30), st.sampled_from([1.0, 2.0]))
@settings(max_examples=60, deadline=None)
def test_t_closed_forms(t, df):
    want = 1 - 2 / math.pi * math.atan(abs(t)) if df == 1 else 1 - abs(t) / math.sqrt(2 + t * t)
    assert S.t_two_sided(t, df) == pytest.approx(want, abs=1e-11)


@pytest.mark.parametrize("t, df, p", [(2.228138852, 10, 0.05), (2.042272456, 30, 0.05), (3.169272667, 10, 0.01)])
def test_t_table(t, df, p):
    assert S.t_two_sided(t, df) == pytest.approx(p, rel=1e-7)


@pytest.mark.parametrize("x, df, p", [(3.841458820694124, 1, 0.05), (23.20925115895436, 10, 0.01), (124.34211340400407, 100, 0.05)])
def test_chi_squared_table(x, df, p):
    assert S.chi2_sf(x, df) == pytest.approx(p, rel=1e-10)
    assert S.chi2_isf(p, df) == pytest.approx(x, rel=1e-9)


def test_f_is_the_square_of_t_and_ends_are_right():
    for t, df in ((0.3, 5), (2.5, 17), (9.0, 40)):
        assert S.f_sf(t * t, 1, df) == pytest.approx(float(S.t_two_sided(t, df)), rel=1e-10)
    assert S.f_sf(0.0, 3, 4) == 1
    assert np.isnan(S.t_sf(np.nan, 3)) and np.isnan(S.chi2_sf(np.nan, 2))
    assert S.chi2_sf(0.0, 3) == 1 and S.chi2_isf(1.0, 3) == 0


def test_t_to_z_keeps_sign_and_far_tails():
    z = S.t_to_z(np.array([-3.0, 3.0, 400.0]), np.array([12.0, 12.0, 200.0]))
    assert z[0] == -z[1] and math.isfinite(z[2]) and z[2] > 30
    assert S.norm_sf(z[1]) == pytest.approx(float(S.t_sf(3.0, 12.0)), rel=1e-10)


def test_alternatives():
    assert S.tail_p(1.0, "greater") + S.tail_p(1.0, "less") == pytest.approx(1)
    assert S.tail_p(1.0, "anything") == S.tail_p(-1.0)


ROWS = [{"id": "a", "g": "x", "h": "u", "age": 1.0}, {"id": "b", "g": "y", "h": "v", "age": 2.0}, {"id": "c", "g": "z", "h": "u", "age": 4.0}]


def test_formula_terms_and_coding():
    d = M.design(ROWS, "id", "~ g + age")
    assert d.terms == ["(Intercept)", "gy", "gz", "age"] and d.matrix.tolist() == [[1, 0, 0, 1], [1, 1, 0, 2], [1, 0, 1, 4]]
    assert M.design(ROWS, "id", "~ 0 + g").terms == ["gx", "gy", "gz"]
    assert M.design(ROWS, "id", "~ g - 1").terms == ["gx", "gy", "gz"]
    assert M.design(ROWS, "id", "~ h * age").terms == ["(Intercept)", "hv", "age", "hv:age"]
    assert M.design(ROWS, "id", "~ g", {"g": ["z", "y", "x"]}).terms == ["(Intercept)", "gy", "gx"]
    assert M.design(ROWS, "id", "~ 1").terms == ["(Intercept)"]


def test_formula_errors_and_missing_covariates():
    for bad in ("y ~ g", "~ log(age)", "~ nothing", "~ g - age"):
        with pytest.raises(ValueError):
            M.design(ROWS, "id", bad)
    rows = [*ROWS, {"id": "d", "g": None, "h": "v", "age": 3.0}]
    with pytest.raises(ValueError, match="d"):
        M.design(rows, "id", "~ g")
    left = M.design(rows, "id", "~ g", na_action="exclude")
    assert left.subjects == ["a", "b", "c"] and left.dropped == ["d"]


def test_estimability():
    x = np.array([[1, 1, 0], [1, 1, 0], [1, 0, 1.0]])
    assert M.estimable(x, np.array([0, 1, -1.0])) and not M.estimable(x, np.array([0, 1.0, 0]))
