import numpy as np
import pytest

from graphloom.llm import packing


def brute(lengths, capacity, rule, w):
    """Every open bin scored for every piece."""
    left, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for b, have in enumerate(left):
            if all(h >= x for h, x in zip(have, need, strict=True)):
                x, h = [n / c for n, c in zip(need, capacity, strict=True)], [n / c for n, c in zip(have, capacity, strict=True)]
                parts = [w[k] * x[k] * h[k] if rule == "dot" else w[k] * (h[k] - x[k]) ** 2 for k in range(3)]
                s = parts[0] + parts[1] + parts[2]
                if best is None or s < best[0]:
                    best = (s, b)
        if best is None:
            left.append(capacity)
        b = len(left) - 1 if best is None else best[1]
        out[i] = (b, capacity[0] - left[b][0])
        left[b] = tuple(h - x for h, x in zip(left[b], need, strict=True))
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("rule", ["dot", "norm"])
@pytest.mark.parametrize("weights", [(1.0, 0.05, 0.25), (0.1, 3.0, 1.0)])
@pytest.mark.parametrize("capacity", [(64, 64, 64 * 64), (64, 4, 64 * 64), (64, 5, 40 * 40), (64, 3, 64 * 48)])
def test_choice_against_brute_force(rule, weights, capacity):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 41, 400)
    got = packing.best_fit(lengths, *capacity, rule, weights)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == brute(lengths.tolist(), capacity, rule, weights)


def test_more_bins_than_the_first_room():
    lengths = np.concatenate([np.full(3000, 40), np.arange(3000) % 24 + 1])
    bins, offsets = packing.best_fit(lengths, 64, 2, 64 * 64)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == brute(lengths.tolist(), (64, 2, 64 * 64), "dot", (1.0, 0.05, 0.25))
