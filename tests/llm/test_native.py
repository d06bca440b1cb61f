"""Secret scans, quality rules and decontamination against independent SQL and Python."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle_check import compare
from wardline.llm import decontam, quality_rules, queries, secrets, text

PROSE = "the of and to in is that for it was on are as with his they at be this from".split()


def sql_of(path):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    return con


@pytest.fixture()
def hand_made(spark, documents, odd_rows):
    r = random.Random(5)
    lines = [" ".join(r.choice(PROSE) + r.choice("abcdef") for _ in range(9)) for _ in range(400)]
    rows = list(odd_rows)
    for i in range(120):
        own = [lines[(3 * i + k) % 400] for k in range(3)]
        common = ["Subscribe to our newsletter 24 now"] * (i % 2)
        rows.append((100 + i, "\n".join([*own, *common]), "en", "hot" if i % 3 else "cold"))
    rows += [(300, "Subscribe to our newsletter 7 now\nhello there", "en", "hot"), (301, "a b c d e f g h a b c d e f g h a b c d e f g h", "en", "hot")]
    items = [(1, " ".join(f"item{k}" for k in range(30))), (2, None), (3, ""), (4, "only three words"), (5, " ".join(f"item{k}" for k in range(30)))]
    body = " ".join(f"item{k}" for k in range(30))
    rows += [
        (400, "before it " + body + " after it", "en", "hot"), (401, "x " + body.replace("item20", "other"), "en", "hot"),
        (402, " ".join(body.split()[:14]) + " tail", "en", "hot"), (403, "said ONLY three   words here", "en", "cold"),
        (404, "x " + body.replace("item29", "other"), "en", "hot"),
    ]
    return documents(rows), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("name", ["op1_secrets", "op3_quality_rules", "op4_decontaminate"])
def test_against_sql(spark, as_dir, hand_made, name):
    docs, items = hand_made
    path = as_dir(documents=docs, benchmark=items)
    ok, message = compare(queries.QUERIES[name](spark, path), sql_of(path), queries.ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", ["op1_secrets", "op3_quality_rules", "op4_decontaminate"])
def test_empty_tables(spark, as_dir, hand_made, name):
    docs, items = hand_made
    assert queries.QUERIES[name](spark, as_dir(documents=docs.limit(0), benchmark=items)).count() == 0
    if name == "op4_decontaminate":
        assert queries.QUERIES[name](spark, as_dir(documents=docs, benchmark=items.limit(0))).count() == 0


def test_failing_match_uses_up_its_text(documents):
    got = secrets.scan(documents([(1, 'password=key="abcdef1"', None, None)])).select(secrets.listed(("assign",)).alias("s")).first().s
    assert got == ""


def entropy(window):
    return -sum(window.count(c) / len(window) * math.log2(window.count(c) / len(window)) for c in set(window))


def test_windows_are_those_of_a_plain_count(spark):
    r = random.Random(3)
    c = secrets.CLASSES[2]
    values = ["".join(r.choice(c.alphabet[: r.choice([4, 12, 30, 66])]) for _ in range(r.randint(20, 60))) for _ in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.is_hot(F.col("v"), c).alias("hot")).collect()
    for row in got:
        best = max(entropy(row.v[i : i + c.width]) for i in range(len(row.v) - c.width + 1))
        assert row.hot == (best >= c.bits), (row.v, best)
    assert 0 < sum(row.hot for row in got) < 200


def test_allow_list(documents):
    texts = ["q9Zx8Lk2Vb7Nm4Wp1Rt6 ok", "MY-EXAMPLE-q9Zx8Lk2Vb7Nm4Wp1Rt6", "antidisestablishmentarianismfoo", "123e4567-e89b-12d3-a456-426614174000"]
    rows = secrets.scan(documents([(i, t, None, None) for i, t in enumerate(texts)])).select("doc_id", F.size("spans_mixrun").alias("n")).collect()
    assert {x.doc_id: x.n for x in rows} == {0: 1, 1: 0, 2: 0, 3: 0}


def test_redaction_keeps_columns_and_other_text(documents, odd_rows):
    docs = documents(odd_rows, clash=True)
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == len(odd_rows)
    by = {x.doc_id: x.text for x in out.filter("doc_id in (3, 6, 7)").collect()}
    assert by[6] == "x" and by[7] == 'key [secret]" é𝒳 [secret]' and by[3].endswith(" [secret]")


def test_cleaned_drops_lines_and_keeps_first(documents):
    own = lambda i: " ".join(chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + k) * 3 for k in range(26))
    rows = [(i, own(i) + "\nthe same old line", "en", "s") for i in range(60)]
    out = {x.doc_id: x.text for x in quality_rules.cleaned(documents(rows, clash=True)).collect()}
    assert len(out) == 60 and [i for i, t in out.items() if "same old" in t] == [0]


def test_limit_of_the_pipeline_does_not_grow_with_the_host(documents):
    own = lambda i: "\n".join(" ".join(f"{'abcdefghij'[i // 10**j % 10]}w{'xyz'[k]}{j}" for j in range(8)) for k in range(3))
    for size in (200, 3200):  # 1 % of the larger host are 32 documents
        rows = [(i, own(i) + "\nthe same old line" * (i < 30), "en", "s") for i in range(size)]
        out = {x.doc_id: x.text for x in quality_rules.cleaned(documents(rows)).collect()}
        assert len(out) == size and [i for i, t in out.items() if "same old" in t] == [0]


def test_much_boilerplate_is_found_in_few_pages(documents):
    """60 pages with ten shared lines and one of their own: each counts, though most have the lowest and highest hash in common."""
    shared = [f"menu {a} of the site goes here" for a in "abcdefghij"]
    own = lambda i: " ".join("abcdefgh"[i % 8] + "abcdefgh"[i // 8] + chr(97 + k) * 3 for k in range(26))
    rows = [(i, "\n".join([*shared, own(i)]), "en", "s") for i in range(60)]
    out = {x.doc_id: x.text for x in quality_rules.cleaned(documents(rows), quality_rules.WHOLE).collect()}
    left = quality_rules.common_lines(quality_rules.line_rows(documents(rows).withColumn("_row", F.col("doc_id")), quality_rules.WHOLE), quality_rules.WHOLE)
    assert left.count() == 10 and [i for i, text in out.items() if "menu" in text] == [0]
    same = [(i, rows[0][1], "en", "s") for i in range(60)]
    assert quality_rules.cleaned(documents(same)).count() == 60


def test_only_texts_with_lines_to_remove_are_shuffled(documents):
    """The rest is judged where it is read: its side of the union has no exchange."""
    own = lambda i: " ".join(chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + k) * 3 for k in range(26))
    rows = [(i, own(i) + "\nthe same old line" * (i % 2), "en", "s") for i in range(120)]
    docs = documents(rows)
    some, none = text.parted(quality_rules.with_row_key(docs), "_row", quality_rules.with_row_key(docs.filter("doc_id % 2 = 1")).select("_row"))
    assert {x.doc_id for x in some.collect()} >= set(range(1, 120, 2)) and some.count() + none.count() == 120 and none.count() > 50
    assert "Exchange hashpartitioning" not in none._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    out = {x.doc_id: x.text for x in quality_rules.cleaned(docs).collect()}
    assert len(out) == 120 and [i for i, t in out.items() if "same old" in t] == [1]


def test_copies_do_not_make_a_line_common(documents):
    text = "\n".join(f"line {k} " + " ".join(f"w{k}x{j}" for j in range(8)) for k in range(5))
    out = quality_rules.judge(documents([(i, text, "en", "s") for i in range(80)])).filter("kept")
    assert out.count() == 80


def test_hamming_blocks_lose_no_pair_within_the_radius(spark):
    r = random.Random(1)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(63)
        b = a
        for bit in r.sample(range(63), r.randint(0, decontam.RADIUS)):
            b ^= 1 << bit
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a long, b long")
    hit = df.select(F.size(F.array_intersect(decontam.blocks(F.col("a")), decontam.probes(F.col("b")))).alias("n"))
    assert hit.filter("n = 0").count() == 0


def test_clean_removes_only_documents_with_items(hand_made):
    docs, items = hand_made
    """One word changed inside costs five of 26 shingles: 21 of 31 are alike, under 80 %. At the end it costs one: 25 of 27."""
    left = {x.doc_id for x in decontam.clean(docs, items).collect()}
    assert not left & {400, 403, 404} and {401, 402} <= left and {100, 3, 6} <= left


def test_items_are_told_apart_by_their_words(spark, documents):
    """Two texts under one id, two without an id, one text under two ids."""
    said = lambda a: " ".join(f"{a}{k}" for k in range(30))
    items = spark.createDataFrame([(1, said("a")), (1, said("b")), (None, said("c")), (None, said("d")), (2, said("e")), (3, said("e"))], "item_id long, text string")
    docs = documents([(i, f"before {said(a)} after", "en", "s") for i, a in enumerate("abcde")] + [(9, said("f"), "en", "s")])
    got = sorted((x.doc_id, x.item_id) for x in decontam.leaks(docs, items).fillna(-1).collect())
    assert got == [(0, 1), (1, 1), (2, -1), (3, -1), (4, 2), (4, 3)]
    assert [x.doc_id for x in decontam.clean(docs, items).collect()] == [9]


def test_simhash_is_the_weighted_vote(spark):
    row = spark.createDataFrame([(["a b c", "dd ee f", "a b c"],)], "s array<string>").select(
        decontam.simhash(F.col("s")).alias("h"), F.transform("s", lambda x: F.xxhash64(x)).alias("x")).first()
    want = 0
    for b in range(64):
        if sum(w if (h >> b) & 1 else -w for h, w in zip(row.x, (5, 7, 5), strict=True)) > 0:
            want |= 1 << b
    assert row.h % 2**64 == want
