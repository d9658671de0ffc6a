"""Tail probabilities against published values."""

import math

import pytest

from keepwell.functions import dist


@pytest.mark.parametrize("x,df,p", [(3.841458820694124, 1, 0.05), (9.487729036781154, 4, 0.05),
                                    (23.209251158954356, 10, 0.01), (0.0, 3, 1.0)])
def test_chi_square(x, df, p):
    assert dist.chi2_sf(x, df) == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize("t,df,p", [(2.2281388519649385, 10, 0.05), (12.706204736432095, 1, 0.05),
                                    (2.7874358136769706, 25, 0.01)])
def test_student(t, df, p):
    assert dist.t_sf2(t, df) == pytest.approx(p, rel=1e-9)


def test_f_and_normal():
    assert dist.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, rel=1e-9)
    assert dist.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-14)
    assert dist.normal_quantile(0.8) == pytest.approx(0.8416212335729143, abs=1e-14)
    assert dist.normal_sf2(1.959963984540054) == pytest.approx(0.05, rel=1e-12)
    assert dist.normal_sf(10) == pytest.approx(7.61985302416052e-24, rel=1e-9)


def test_fisher_tea_table():
    odds, p = dist.fisher_2x2(3, 1, 1, 3)
    assert odds == 9 and p == pytest.approx(34 / 70)
    assert dist.fisher_2x2(8, 2, 1, 5)[1] == pytest.approx(0.03496503496503495, rel=1e-9)
    assert math.isinf(dist.fisher_2x2(5, 0, 1, 4)[0])
