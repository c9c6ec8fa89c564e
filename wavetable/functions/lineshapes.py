"""Line shapes fitted to windows of many series at once.

A damped Gauss-Newton step (Levenberg-Marquardt) is taken for all rows of a batch together; each row keeps its own damping,
accepts only steps that lower its squared error, stays inside its bounds, and stops on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

STEPS = 200
GAUSS = 2.0 * np.sqrt(2.0 * np.log(2.0))  # full width at half maximum of a Gaussian with sigma 1


def lorentz(t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """height * g^2 / ((x - x0)^2 + g^2) + base and its derivatives; t: rows of (height, x0, g, base)."""
    a, x0, g, c = (t[:, i, None] for i in range(4))
    u = x - x0
    q = g * g / (u * u + g * g)
    slope = 2 * a * q * q * u / (g * g)
    return a * q + c, np.stack([q, slope, 2 * a * q * (1 - q) / g, np.ones_like(q)], axis=2)


def voigt_like(t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """height * (eta * Lorentz + (1 - eta) * Gauss) + slope * x + base; t: rows of (height, x0, sigma, g, eta, slope, base)."""
    a, x0, s, g, e, b, c = (t[:, i, None] for i in range(7))
    u = x - x0
    q = g * g / (u * u + g * g)
    h = np.exp(-0.5 * (u / s) ** 2)
    mix = e * q + (1 - e) * h
    along = a * (e * 2 * q * q * u / (g * g) + (1 - e) * h * u / (s * s))
    parts = [mix, along, a * (1 - e) * h * u * u / s**3, a * e * 2 * q * (1 - q) / g, a * (q - h), np.broadcast_to(x, u.shape), np.ones_like(u)]
    return a * mix + b * x + c, np.stack(parts, axis=2)


def damped_fit(shape: Callable, x: np.ndarray, y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parameters, root mean square error, whether the fit came to rest) for rows of ``y`` on the axis ``x``."""
    theta = np.clip(start, low, high)
    error = ((y - shape(theta, x)[0]) ** 2).sum(1)
    damping, rest = np.full(len(y), 1e-2), np.zeros(len(y), bool)
    live = np.arange(len(y))
    for _ in range(steps):
        f, jac = shape(theta[live], x)
        # a parameter at its bound that would leave it is held
        pull = np.einsum("nmp,nm->np", jac, y[live] - f)
        stuck = ((theta[live] <= low) & (pull < 0)) | ((theta[live] >= high) & (pull > 0))
        jac = np.where(stuck[:, None, :], 0.0, jac)
        pull = np.where(stuck, 0.0, pull)
        square = np.einsum("nmp,nmq->npq", jac, jac)
        size = np.einsum("npp->np", square)
        diagonal = damping[live, None] * size + np.where(size > 0, 1e-12 * size, 1.0)
        move = np.linalg.solve(square + diagonal[:, :, None] * np.eye(square.shape[1]), pull[:, :, None])[:, :, 0]
        tried = np.clip(theta[live] + move, low, high)
        now = ((y[live] - shape(tried, x)[0]) ** 2).sum(1)
        better = now < error[live]
        gain = (error[live] - now) / np.maximum(error[live], 1e-300)
        done = (better & (gain < 1e-12)) | (~better & (damping[live] > 1e8)) | (error[live] < 1e-24 * np.maximum((y[live] ** 2).sum(1), 1e-300))
        theta[live[better]], error[live[better]] = tried[better], now[better]
        damping[live] = np.where(better, np.maximum(damping[live] / 5, 1e-12), damping[live] * 4)
        rest[live[done]] = True
        live = live[~done]
        if not len(live):
            break
    return theta, np.sqrt(error / y.shape[1]), rest


@dataclass(frozen=True)
class Shape:
    """A line shape with its report."""

    columns: tuple[str, ...]
    points: int  # fewest points of a window that can be fitted
    run: Callable  # (x, y, centre, window, width) -> values, success


def _fit_lorentz(x, y, centre, window, width):
    base, top = np.percentile(y, 5, axis=1), np.percentile(y, 95, axis=1)
    up = y.max(1) - base >= top - y.min(1)
    c = np.where(up, base, top)
    a = np.where(up, y.max(1) - base, y.min(1) - top)
    n = len(y)
    start = np.stack([a, np.full(n, centre), np.full(n, width / 2), c], axis=1)
    low, high = np.array([-np.inf, centre - window, 0.5, -np.inf]), np.array([np.inf, centre + window, window, np.inf])
    t, rmse, ok = damped_fit(lorentz, x, y, start, low, high)
    return np.stack([t[:, 1], t[:, 0], 2 * t[:, 2], np.pi * t[:, 0] * t[:, 2], t[:, 3], rmse], axis=1), ok


def _fit_voigt(x, y, centre, window, width):
    base, top = np.percentile(y, 10, axis=1), np.percentile(y, 90, axis=1)
    up = y.max(1) - base >= top - y.min(1)
    c = np.where(up, base, top)
    a = np.where(up, y.max(1) - base, y.min(1) - top)
    n = len(y)
    start = np.stack([a, np.zeros(n), np.full(n, max(2.0, width / GAUSS)), np.full(n, max(2.0, width / 2)), np.full(n, 0.5), np.zeros(n), c], axis=1)
    low = np.array([-np.inf, -window, 1.5, 1.5, 0.0, -np.inf, -np.inf])
    high = np.array([np.inf, window, 30.0, 30.0, 1.0, np.inf, np.inf])
    t, rmse, ok = damped_fit(voigt_like, x - centre, y, start, low, high)  # centred: slope and base are independent
    a, x0, s, g, e, b, c = t.T
    fwhm = e * 2 * g + (1 - e) * GAUSS * s
    area = a * (e * np.pi * g + (1 - e) * s * np.sqrt(2 * np.pi))
    return np.stack([x0 + centre, a, fwhm, s, g, e, b, c - b * centre, area, rmse], axis=1), ok


SHAPES = {
    "lorentz": Shape(("centre", "height", "fwhm", "area", "base", "rmse"), 5, _fit_lorentz),
    "voigt": Shape(("centre", "height", "fwhm", "sigma", "gamma", "eta", "slope", "base", "area", "rmse"), 7, _fit_voigt),
}


def fit_windows(x: np.ndarray, axis: np.ndarray, centre: float, window: float, width: float, shape: str) -> np.ndarray:
    """The shape's columns and success (1 or 0) per row of ``x``; NaN where the window is too short, a value is not finite, or the fit finds no rest."""
    kind = SHAPES[shape]
    mask = (axis >= centre - window) & (axis <= centre + window)
    out = np.full((len(x), len(kind.columns) + 1), np.nan)
    out[:, -1] = 0.0
    if mask.sum() < kind.points:
        return out
    y = x[:, mask]
    able = np.flatnonzero(np.isfinite(y).all(1))
    if len(able):
        values, ok = kind.run(axis[mask], y[able], centre, window, width)
        out[able[ok], :-1], out[able[ok], -1] = values[ok], 1.0
    return out
