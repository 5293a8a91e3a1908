"""The string kernel of the toxicity machine against an enumeration of gapped subsequences."""

import random
from itertools import combinations

import numpy as np
import pytest

from granula.llm import toxicity


def enumerated(part):
    """Weight of each three letters that stand in order within a span, gaps and signs between them allowed."""
    out = {}
    for at in combinations(range(len(part)), 3):
        wide = at[2] - at[0]
        found = tuple(part[k] for k in at)
        if wide < toxicity.SPAN and all(found):
            out[found] = out.get(found, 0.0) + toxicity.DECAY ** (wide + 1)
    return out


def code(found):
    return found[0] * 1024 + found[1] * 32 + found[2]


@pytest.fixture(scope="module")
def parts():
    rng = random.Random(4)
    return [toxicity.letters("".join(rng.choices("abcde1-*é", k=rng.randint(1, 24))).encode()) for _ in range(300)] + [b"", b"\1", b"\1\2", b"\1\2\3", b"\1" * 24]


def test_features_are_all_gapped_subsequences(parts):
    row, found, weight = toxicity.features(toxicity._padded(parts))
    own = {}
    for r, c, w in zip(row.tolist(), found.tolist(), weight.tolist(), strict=True):
        own.setdefault(r, {})[c] = w
    for k, part in enumerate(parts):
        assert own.get(k, {}) == pytest.approx({code(f): w for f, w in enumerated(part).items()})


def test_the_kernel_is_the_cosine_of_these_weights(parts):
    some = [p for p in parts if len(enumerated(p)) > 0][:60]
    dense = toxicity._dense(some).astype(float)
    for i, j in combinations(range(len(some)), 2):
        a, b = enumerated(some[i]), enumerated(some[j])
        norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        assert dense[i] @ dense[j] == pytest.approx(sum(v * b.get(k, 0.0) for k, v in a.items()) / norm, abs=1e-5)


def test_margins_are_the_weighted_features(parts):
    rng = np.random.default_rng(2)
    letters = np.array([all((c >> s) & 31 for s in (0, 5, 10)) for c in range(32768)])
    weights = np.where(letters, rng.random(32768), 0.0)  # positive, so that every unit with a subsequence counts
    machine = toxicity.Machine(weights, -0.25, np.zeros(5))
    for part, margin in zip(parts, machine.margins(parts), strict=True):
        found = enumerated(part)
        norm = sum(v * v for v in found.values()) ** 0.5
        assert margin == pytest.approx(-0.25 + (sum(weights[code(f)] * v for f, v in found.items()) / norm if found else 0.0))


def test_long_units_count_by_their_strongest_window(parts):
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(rng.random(32768), 0.0, np.zeros(5))
    long = bytes(rng.integers(1, 27, 100).tolist())
    assert machine.margins([long])[0] == pytest.approx(max(machine.margins(toxicity._windows(long))))
