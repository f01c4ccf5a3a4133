"""Keys under which the sets of the Jaccard join meet."""

import numpy as np
import pytest

from shelfmark.llm import jaccard

BOUNDS = jaccard.size_classes()


def of(draw, n):
    return np.sort(draw.integers(0, 1 << 63, n, dtype=np.uint64))


@pytest.mark.parametrize("percent", [80, 85, 50])
def test_linked_sets_share_a_key(percent):
    draw = np.random.default_rng(percent)
    for k in range(1500):
        # as unlike as linked sets may be, shared between both sides or not
        n = int(draw.integers(1, 60) if k % 2 else draw.integers(60, 700))
        common = -(-n * percent // 100) + int(draw.integers(0, 2)) * int(draw.integers(0, n // 10 + 1))
        common = min(common, n)
        own = int(draw.integers(0, n - common + 1))
        both, x, y = of(draw, common), of(draw, own), of(draw, n - common - own)
        one, two = np.sort(np.concatenate([both, x])), np.sort(np.concatenate([both, y]))
        assert 100 * common >= percent * n
        if jaccard.digest_of(one) != jaccard.digest_of(two):
            assert np.intersect1d(jaccard.part_keys(one, BOUNDS, percent), jaccard.part_keys(two, BOUNDS, percent)).size


@pytest.mark.parametrize("percent, n, most", [(80, 700, 400), (80, 475, 400), (85, 300, 100)])
def test_unlike_sets_with_a_passage_in_common_hardly_meet(percent, n, most):
    draw = np.random.default_rng(7)
    passage = of(draw, 25)
    sets = [np.sort(np.concatenate([passage, of(draw, n - 25)])) for _ in range(200)]
    keys = np.concatenate([np.unique(jaccard.part_keys(s, BOUNDS, percent)) for s in sets])
    times = np.unique(keys, return_counts=True)[1]
    assert times[times > 1].sum() < most
