"""Kernels against plain scalar forms, and models against what must hold."""

import math

import numpy as np
import pytest

from freshet.functions import distributions, kernels
from freshet.operators import statistics


def forcing(n=800, seed=0):
    draw = np.random.default_rng(seed)
    day = np.arange(n) % 365 + 1
    temp = 12 * np.sin(2 * np.pi * (day - 110) / 365) + 4 + draw.normal(0, 2, n)
    return temp, draw.gamma(0.4, 8, n), np.maximum(0, temp) / 5, day


def test_gr4j_closes_its_water_balance_without_exchange():
    temp, rain, pet, day = forcing(3000)
    params = np.array([[300.0, 0.0, 60.0, 1.9], [120.0, 0.0, 20.0, 3.4]])
    flow = kernels.gr4j(rain, np.zeros_like(rain), params)
    assert np.isfinite(flow).all() and (flow >= 0).all()
    assert flow.sum(axis=0) == pytest.approx(np.full(2, rain.sum()), rel=0.05)
    alone = kernels.gr4j(rain, pet, params[:1])
    assert np.allclose(kernels.gr4j(rain, pet, params)[:, :1], alone)


def test_unit_hydrographs_add_up_to_one():
    for double in (False, True):
        ordinates = kernels._unit_hydrograph(np.array([0.7, 2.3, 9.0]), 20 * (1 + double), double)
        assert np.allclose(ordinates.sum(axis=1), 1)


def test_snow_keeps_the_water():
    temp, rain, _, _ = forcing()
    years = np.repeat(np.arange(3), 365)[: len(temp)]
    water, pack = kernels.cema_neige(temp, rain, years, np.array([[0.5, 4.0, 0.0], [0.1, 2.0, 1.0]]))
    assert np.allclose(water.sum(axis=0) + pack[-1], rain.sum())
    assert (water >= 0).all() and (pack >= -1e-9).all()


def test_hbv():
    temp, rain, pet, day = forcing()
    base = [2.0, 0.1, 250, 0.2, 0.15, 0.05, 0.7, 3.0, 1.5, 120.0, 1.0, 0.0, 5.0, 0.7, 0.05, 0.1]
    flow = kernels.hbv(temp, rain, pet, day, np.array([base, [*base[:7], 1.0, *base[8:]]]))
    assert np.isfinite(flow).all() and (flow >= 0).all()
    wet = kernels.hbv(temp, rain * 3, pet, day, np.array([base]))
    assert wet.sum() > flow[:, 0].sum()


def test_butterworth_of_order_two():
    b, a = kernels.butterworth(2, 0.5)
    assert np.allclose(b, [0.29289322, 0.58578644, 0.29289322]) and np.allclose(a, [1, 0, 0.17157288], atol=1e-8)
    assert kernels.linear_filter(b, a, np.ones(60))[-1] == pytest.approx(1)


def test_lyne_hollick_against_a_plain_loop():
    draw = np.random.default_rng(1)
    q = draw.gamma(1, 5, 90)

    def one_pass(x, alpha):
        quick = [x[0]]
        for i in range(1, len(x)):
            quick.append(alpha * quick[-1] + 0.5 * (1 + alpha) * (x[i] - x[i - 1]))
        return np.array([v if f < 0 else v - f for v, f in zip(x, quick)])

    x = np.concatenate((q[30:0:-1], q, q[-2:-32:-1]))
    base = one_pass(one_pass(one_pass(x, 0.95)[::-1], 0.95)[::-1], 0.95)[30:-30].clip(0)
    index, found = kernels.lyne_hollick(q, np.array([0.95]))
    assert np.allclose(found, base) and index[0] == pytest.approx(base.mean() / q.mean())
    short, _ = kernels.lyne_hollick(q[:10], np.array([0.9, 0.98]))
    assert (short >= 0).all()


def test_ward_finds_separate_groups():
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(c, 0.1, (n, 3)) for c, n in ((0, 20), (5, 30), (9, 7))])
    labels = kernels.ward_labels(x, 3)
    assert [len(set(labels[a:b])) for a, b in ((0, 20), (20, 50), (50, 57))] == [1, 1, 1] and len(set(labels)) == 3


def test_clipped_area():
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1)])
    assert kernels.clipped_area(square, 0.25, -1, 0.75, 0.5) == pytest.approx(0.25)
    assert kernels.clipped_area(square, 2, 2, 3, 3) == 0
    triangle = np.array([(0, 0), (2, 0), (0, 2)])
    assert sum(kernels.clipped_area(triangle, i, j, i + 1, j + 1) for i in range(2) for j in range(2)) == pytest.approx(2)


def test_distributions():
    assert distributions.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert distributions.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert distributions.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert distributions.chi2_sf(1.0, 2) == pytest.approx(math.exp(-0.5))


def test_detectors_on_a_step():
    x = np.concatenate((np.zeros(60), np.ones(60))) + np.random.default_rng(3).normal(0, 0.05, 120)
    at = [i for i, _, _ in statistics.binary_segmentation_points(x, 10, 1)]
    assert at and abs(at[0] - 60) <= 1
    assert any(abs(i - 60) < 20 for i, _, _ in statistics.mean_shift_points(x))
    assert list(statistics.cusum_points(x[:5])) == []


def test_smoothing_takes_a_spike_away():
    x = np.sin(np.arange(366) / 366 * 2 * np.pi) + 2
    spiked = x.copy()
    spiked[100] += 10
    assert np.abs(kernels.smoothed_cycle(spiked) - x).max() < 0.05
