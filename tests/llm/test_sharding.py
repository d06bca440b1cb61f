"""Differencing against a plain one, small optima by trial of all; shards against their rules."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from wardline.llm import sharding


def plain(sizes, ways):
    """Largest differencing with lists of members; returns the spread."""
    parts = [[(s, [i])] + [(0, [])] * (ways - 1) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][0] - p[-1][0], reverse=True)
        a, b, *parts = parts
        parts.append(sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return parts[0][0][0] - parts[0][-1][0]


def spread(sizes, subsets, ways):
    sums = np.bincount(subsets, weights=sizes, minlength=ways)
    return int(sums.max() - sums.min())


@pytest.mark.parametrize("ways", [2, 3, 5])
def test_differencing_is_the_plain_one(ways):
    r = random.Random(ways)
    for n in (1, 2, 3, 7, 40):
        sizes = r.sample(range(1, 100_000), n)  # without ties any implementation combines the same
        assert spread(sizes, sharding.differenced(np.array(sizes), ways), ways) == plain(sizes, ways)


def test_differencing_beats_the_greedy_and_nears_the_optimum():
    r = random.Random(2)
    better = 0
    for _ in range(20):
        sizes = [r.randint(1, 1000) for _ in range(9)]
        best = min(spread(sizes, np.array(x), 2) for x in product((0, 1), repeat=9))
        bins = [0, 0]
        for s in sorted(sizes, reverse=True):
            bins[bins.index(min(bins))] += s
        got = spread(sizes, sharding.differenced(np.array(sizes), 2), 2)
        assert best <= got
        better += got <= abs(bins[0] - bins[1])
    assert better >= 15


def checked(rows, out, shards):
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in rows)
    of_text, slots, sums = {}, defaultdict(list), Counter({s: 0 for s in range(shards)})
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add(t or "")
    for r in out:
        slots[r.shard].append((r.slot, -1 if r.doc_id is None else r.doc_id))
        sums[r.shard] += r.size
        assert (r.size, r.text_crc32) in {(len(t.encode()) + 16, zlib.crc32(t.encode())) for t in texts[r.doc_id]}
        assert of_text.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    for got in slots.values():
        assert [s for s, _ in sorted(got)] == list(range(len(got))) and [d for _, d in sorted(got)] == sorted(d for _, d in got)
    return sums


@pytest.mark.parametrize(("block", "most"), [(8192, 16384), (512, 1000), (128, 400)])
def test_shards_are_even_and_keep_groups(documents, odd_rows, block, most):
    r = random.Random(3)
    rows = [x for x in odd_rows if x[0] != 3] + [(i, "é" * int(r.lognormvariate(5, 1)) + str(i), "en", "s") for i in range(100, 2500)]
    rows += [(i, "a copy of many", "en", "s") for i in range(5000, 5600)]
    out = sharding.shard(documents(rows, clash=True).repartition(6), shards=8, block=block, most=most).collect()
    sums = checked(rows, out, 8)
    assert max(sums.values()) - min(sums.values()) < 0.001 * sum(sums.values()) / 8
    again = sharding.shard(documents(rows).repartition(3), shards=8, block=block, most=most).collect()
    assert {(x.doc_id, x.size, x.shard) for x in out} == {(x.doc_id, x.size, x.shard) for x in again}


def test_group_larger_than_a_shard_stays_whole(documents):
    rows = [(i, "x" * 500, "en", "s") for i in range(400)] + [(1000 + i, f"own text {i}", "en", "s") for i in range(700)]
    sums = checked(rows, sharding.shard(documents(rows), shards=4, block=64, most=128).collect(), 4)
    assert max(sums.values()) == 400 * 516 and max(list(sorted(sums.values()))[:3]) - min(sums.values()) < 40


def test_hot_text_is_not_shuffled_by_its_key(documents):
    """The groups with more than a thousandth of the rows are joined by broadcast."""
    rows = [(i, "hot" if i % 3 == 0 else f"own {i}", "en", "s") for i in range(3000)]
    plan = sharding.shard(documents(rows))
    assert plan.filter("size = 19").select("shard").distinct().count() == 1 and plan.count() == 3000


def test_few_rows(documents, odd_rows):
    assert sharding.shard(documents([])).count() == 0
    checked(odd_rows, sharding.shard(documents(odd_rows)).collect(), 40)
