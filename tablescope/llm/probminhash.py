"""ProbMinHash signatures of weighted shingles.

Each distinct shingle is a Poisson process whose rate is its weight; every
arrival falls on a random register, and a register keeps the shingle that
arrives first. Two texts agree on a register with the probability Jaccard
similarity of their weighted shingles. Arrivals of one shingle come in
order of time, so a shingle is done as soon as its time passes the latest
first arrival of all registers (early termination)."""

from __future__ import annotations

import numpy as np

from .shingles import mixed

#: Registers in a band, and bands. At similarity 0.8 a pair misses every
#: band with probability (1 - 0.8 ** 6) ** 40, 5 in a million.
ROWS, BANDS = 6, 40

_U = np.uint64
_ROUND, _SLOT, _BAND = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)


def signature(items: np.ndarray, weights: np.ndarray, registers: int = ROWS * BANDS) -> np.ndarray:
    """For each register, the item that arrives first. ``items``: distinct 64-bit hashes, at least one."""
    first, who = np.full(registers, np.inf), np.zeros(registers, _U)
    clock, live, come = np.zeros(len(items)), np.arange(len(items)), 0
    while len(live):
        # few items get several arrivals at a time: about as many in all as fill the registers
        step = max(1, 3 * registers // len(live))
        seeds = mixed(items[live][:, None] + _ROUND * np.arange(come + 1, come + step + 1, dtype=_U))
        waits = -np.log1p(-((seeds >> _U(11)).astype(np.float64) / 2.0 ** 53)) / weights[live][:, None]
        at = clock[live][:, None] + np.cumsum(waits, axis=1)
        slot = (mixed(seeds ^ _SLOT) % _U(registers)).astype(np.int64).ravel()
        times, owner = at.ravel(), np.repeat(items[live], step)
        np.minimum.at(first, slot, times)
        won = times == first[slot]
        who[slot[won]] = owner[won]
        clock[live], come = at[:, -1], come + step
        live = live[clock[live] < first.max()]
    return who


def band_keys(who: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per band, the band's number in it."""
    bands = who.reshape(-1, rows)
    total = np.arange(1, len(bands) + 1, dtype=_U)
    for j in range(rows):
        total = mixed(total * _BAND + bands[:, j])
    return total.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Exact plain Jaccard and probability Jaccard of two sorted distinct
    items-and-counts pairs."""
    (x, u), (y, v) = a, b
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    plain = len(both) / (len(x) + len(y) - len(both))
    # J_P = sum over common d of 1 / sum over all e of max(u_e / u_d, v_e / v_d)
    u_of, v_of = u[i].astype(float), v[j].astype(float)
    order = np.argsort(u_of / v_of, kind="stable")
    ratio, cu, cv = (u_of / v_of)[order], u_of[order], v_of[order]
    only_x, only_y = u.sum() - u_of.sum(), v.sum() - v_of.sum()
    # max(u_e/u_d, v_e/v_d) is u_e/u_d exactly where e's ratio u/v is at least d's
    sum_u = np.append(np.cumsum(cu[::-1])[::-1], 0.0) + only_x
    sum_v = np.append(0.0, np.cumsum(cv)) + only_y
    at = np.searchsorted(ratio, ratio, side="left")
    return plain, float(np.sum(1.0 / (sum_u[at] / cu + sum_v[at] / cv)))
