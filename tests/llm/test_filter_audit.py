"""Merged lists against sets; the audit against a plain count over rows."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest

from wardline.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("seed", range(30))
def test_merged_lists_are_those_of_sets(seed):
    r = random.Random(seed)
    draw = lambda: sorted(r.sample(range(r.choice([40, 400, 5000])), r.randint(0, 40)))
    lists, minus = [draw() for _ in range(r.randint(0, 5))], [draw() for _ in range(r.randint(0, 4))]
    got = filter_audit.merged([np.array(x, np.int64) for x in lists], [np.array(x, np.int64) for x in minus], stride=r.choice([1, 3, 512]))
    assert got.tolist() == sorted(set().union(*lists) - set().union(*minus))


def test_gallop_finds_the_first_place():
    ids = np.array([2, 3, 5, 8, 13, 21, 34])
    for at in range(8):
        for bound in range(40):
            assert filter_audit.gallop(ids, at, bound) == max(at, int(np.searchsorted(ids, bound)))


def brute(docs, labels):
    """docs: (doc_id, text, lang) rows."""
    firsts = {}
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = {}
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, hit in zip("ABCDE", [
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            re.search(r"[#$%&*|]", t) is not None, i is not None and firsts[t] < i], strict=True) if hit}
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                now = [r for r in rows if f in r[0] and not r[0] & gone]
                redundant = sum(f in r[0] and bool(r[0] & gone) for r in rows)
                gone = gone | {f}
                kept = sum(not r[0] & gone for r in rows)
                shapley[f] += len(now)
                out[part, "".join(order), step] = [
                    kept, len(now), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in now), sum(r[2] for r in now)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def rows_of(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in df.collect()}


@pytest.mark.parametrize("batch", [65_536, 7])
def test_audit_is_the_plain_count(spark, documents, odd_rows, batch, monkeypatch):
    monkeypatch.setattr(filter_audit, "BATCH", batch)
    r = random.Random(5)
    text = lambda: " ".join(r.choice(["a", "bb", "Ccc", "d#", "EE", "f"]) + str(r.randint(0, 400)) for _ in range(r.choice([3, 190, 230])))
    pool = [text() for _ in range(40)]
    rows = odd_rows + [(i, r.choice(pool), r.choice(["en", "fr", None]), "s") for i in range(10, 150)]
    rows += [(11, rows[-1][1], "en", "s"), (None, rows[-1][1], "en", "s")]
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 150, 2)] + [(12, 0, 1), (12, 1, None), (None, 1, 1)]
    labels = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(batch, 10_000)))
    try:
        got = rows_of(filter_audit.audit(documents(rows, clash=True).repartition(5), spark.createDataFrame(labels, LABELS)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute([(i, t, lang) for i, t, lang, _ in rows], labels)


def test_empty_tables(spark, documents):
    assert filter_audit.audit(documents([]), spark.createDataFrame([], LABELS)).count() == 0
    got = rows_of(filter_audit.audit(documents([(1, "A#", None, None)]), spark.createDataFrame([], LABELS)))
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 0, 0, 0, 40]  # first of A, C and D in a third of the orders
