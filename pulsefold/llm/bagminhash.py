"""BagMinHash: weighted minwise signatures of multisets from hierarchical Poisson processes.

The weight axis of each element is cut into dyadic ranges (0,1], (1,2], (2,4], ... Each range carries a Poisson
process whose rate is its width; a point has a time, a register and, drawn by halving the range, a level. A
multiset in which the element has weight w sees the points at levels up to w. A register keeps its earliest
time, so two multisets agree in a register with the probability of their weighted Jaccard similarity. A process
ends once its time exceeds all registers of its text, so few points are made beyond the first of each element.
"""

from __future__ import annotations

import numpy as np

from .kernels import mixed

_U = np.uint64
_STEP, _OTHER = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """(n, registers) times; rows without elements stay infinite. (doc, element) are distinct pairs, weight >= 1."""
    times = np.full(n * registers, np.inf)
    ranges = np.ceil(np.log2(weight)).astype(np.int64) + 1  # of each element
    at = np.repeat(np.arange(len(doc)), ranges)
    k = np.arange(len(at)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    width = np.where(k > 1, _U(1) << np.maximum(k - 1, 0).astype(_U), _U(1))
    below = np.where(k > 0, width, _U(0))  # the range is (below, below + width]
    seed = mixed(element[at] + k.astype(_U) * _OTHER)
    reach = weight[at].astype(_U) - below  # levels of the range that the weight covers
    row = doc[at]
    x = np.zeros(len(at))
    step = 0  # of each process
    while len(x):
        step = (step + int(_STEP)) % (1 << 64)
        r = mixed(seed + _U(step))
        x = x - np.log(((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        s = mixed(r ^ _OTHER)
        register = (s >> _U(40)).astype(np.int64) % registers
        # halving the range log2(width) times picks one of its levels
        seen = (s & (width - _U(1))) < reach
        np.minimum.at(times, row[seen] * registers + register[seen], x[seen])
        # past the first points, the largest register bounds what can still matter
        going = x < times.reshape(n, registers).max(axis=1)[row]
        x, seed, width, reach, row = x[going], seed[going], width[going], reach[going], row[going]
    return times.reshape(n, registers)


def bands(times: np.ndarray, rows: int) -> np.ndarray:
    """(n, bands) hashes of `rows` registers each."""
    n, registers = times.shape
    keys = mixed(times.view(_U)).reshape(n, registers // rows, rows)
    out = np.zeros((n, registers // rows), _U)
    for i in range(rows):
        out = mixed(out * _STEP + keys[:, :, i])
    return out
