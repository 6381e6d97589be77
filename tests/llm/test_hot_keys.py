"""Joins that spread hot keys give what plain joins give; long rows, null ids; recall on short lines."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from ionweave.llm import op1_line_dedup as o1
from ionweave.llm import op7_license as o7
from ionweave.llm import op8_mixing as o8
from ionweave.llm import op9_exact_dedup as o9
from ionweave.llm import op10_warc as o10
from ionweave.llm import shared


def same_rows(df):
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def copies(spark):
    """Texts of which some occur once, some often; sources and lines likewise; null ids and texts."""
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(9))
    often, rare = [line() for _ in range(3)], [line() for _ in range(30)]
    rows = []
    for k in range(90):
        text = "\n".join([often[k % 3], rare[k % 30], often[0][:-1] + rng.choice("xyz"), "mit license"])
        rows.append((k if k % 17 else None, text if k % 4 else often[1], f"s{min(k % 7, 3)}" if k % 9 else None))
    rows += [(200 + k, None, "s0") for k in range(4)] + [(7, rows[7][1], rows[7][2])] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


@pytest.mark.parametrize("op", [o1.line_dedup, o8.mix, o9.exact_dedup])
def test_hot_keys_change_nothing(spark, copies, monkeypatch, op):
    plain = same_rows(op(copies))
    monkeypatch.setattr(shared, "HOT_LEAST", 1)
    assert shared.join_counted is not None and same_rows(op(copies)) == plain and plain


def test_hot_payloads_change_nothing(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h/{k}", None if k % 11 == 0 else f"<p>{k % 5 if k % 3 else k}</p>") for k in range(60)], "page_id long, url string, html string")
    plain = same_rows(o10.classify(pages))
    monkeypatch.setattr(shared, "HOT_LEAST", 1)
    assert same_rows(o10.classify(pages)) == plain


def test_lines_without_ids_come_last(spark):
    rows = [(None, "one line that many have\nx"), (5, "one line that many have"), (None, "a line of nobody else at all")]
    got = {(r.doc_id, r.line_no, r.keep_id, r.keep_line_no, r.n_lines, r.kept) for r in o1.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 0, 5, 0, 2, False), (5, 0, 5, 0, 2, True), (None, 1, None, 1, 1, True), (None, 0, None, 0, 1, True)}


def test_very_long_texts(spark):
    long = "word " * 600_000
    df = spark.createDataFrame([(1, long + "mit license"), (2, long.replace(" ", "\t") + "mit  license"), (3, "mit license")], "doc_id long, text string")
    got = {r.doc_id: r for r in o9.exact_dedup(df).collect()}
    assert [got[k].keep_id for k in (1, 2, 3)] == [1, 1, 3]
    found = {r.doc_id: r for r in o7.license_scan(df).collect()}
    assert [found[k].n_words for k in (1, 2, 3)] == [600_002, 600_002, 2] and all("mit" in found[k].base_labels for k in (1, 2, 3))


def test_members_of_open_groups_are_dealt_once(spark, monkeypatch):
    """Lines of large groups that their leaders left open come once to a block, not once for each 32 of the group."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    body = letters(120)
    rows = [(k, body[: 20 + k % 100] + letters(16) + body[20 + k % 100 :]) for k in range(300)]
    seen, blocks = [], o1.blocks

    def noted(large, *a):
        seen.append((large.count(), blocks(large, *a).count()))
        return blocks(large, *a)

    monkeypatch.setattr(o1, "blocks", noted)
    o1.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert max(n for n, _ in seen) > 100 and all(dealt == n for n, dealt in seen)


def test_filter_of_hashes_loses_none(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("xxhash64(id) AS leaf", "id AS item")
    keys = rows.where("item % 50 = 0").select("leaf")
    want = {r.item for r in rows.where("item % 50 = 0").collect()}
    got = {r.item for r in shared.maybe_among(rows, keys, "leaf").collect()}
    assert want <= got and len(got) < 450
    monkeypatch.setattr(shared, "FILTER_WORDS", 1)  # a full bitmap: rows get through, none is lost
    assert want <= {r.item for r in shared.maybe_among(rows, keys, "leaf").collect()}


def test_bands_of_one_item_are_not_joined(spark, monkeypatch):
    """Bands that no other item has stay out of the join with the shared ones."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = [letters(80) for _ in range(400)]
    seen, joined = [], o1.join_counted

    def noted(rows, keyed, on, *a):
        if on == ["leaf"] and "weight" in rows.columns:
            seen.append(rows.count())
        return joined(rows, keyed, on, *a)

    monkeypatch.setattr(o1, "join_counted", noted)
    got = o1.line_dedup(spark.createDataFrame([*enumerate(texts), (900, texts[5] + "x")], "doc_id long, text string")).where("NOT kept").collect()
    assert [(r.doc_id, r.keep_id) for r in got] == [(900, 5)]
    assert seen and max(seen) < 400  # of 401 items with 8 bands each


def test_lines_that_stay_alone_are_not_joined(spark, monkeypatch):
    """Lines that surely have no other like them stay out of the join with the components."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = [letters(80) for _ in range(400)]
    seen, joined = [], o1.join_counted

    def noted(rows, keyed, on, *a):
        if on == ["h1", "h2"]:
            seen.append(rows.count())
        return joined(rows, keyed, on, *a)

    monkeypatch.setattr(o1, "join_counted", noted)
    got = o1.line_dedup(spark.createDataFrame([*enumerate(texts), (900, texts[5] + "x"), (901, texts[6]), (902, " \n")], "doc_id long, text string")).collect()
    assert len(got) == 402 and [(r.doc_id, r.keep_id, r.n_lines) for r in got if not r.kept] == [(900, 5, 2), (901, 6, 2)]
    assert seen and max(seen) < 20  # of 402 lines, four have another


def test_marks_of_keys_lose_none(spark):
    rows = spark.range(20_000).selectExpr("id AS item")
    keys = rows.where("item % 50 = 0")
    want = {r.item for r in keys.collect()}
    got = {r.item for r in shared.maybe_items(rows, keys).collect()}
    assert want <= got and len(got) < 450
    assert shared.maybe_items(rows, keys.limit(0)).count() == 0
    hashed = rows.selectExpr("item", "xxhash64(item) AS h")
    marked = shared.marked_among(hashed, hashed.where("item % 50 = 0"), "h", "maybe").collect()
    assert len(marked) == 20_000 and {r.item for r in marked if r.maybe} == got


def test_recall_on_short_lines(spark):
    """Pairs of lines of 9 to 40 shingles at a similarity of 0.8 and more, each pair alone: nearly all are found."""
    rng = random.Random(11)
    rows, pairs = [], []
    for k in range(3000):
        n = rng.randint(9, 40)
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n + 7))
        changed = rng.randint(1, max(1, n // 9))  # shingles that a change of the character so far from the end touches
        b = a[: len(a) - changed] + "#" + a[len(a) - changed + 1 :]
        x, y = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (a, b))
        if len(x & y) >= 0.8 * len(x | y):
            rows += [(2 * k, a), (2 * k + 1, b)]
            pairs.append((2 * k, 2 * k + 1))
    got = {r.doc_id: r.keep_id for r in o1.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = sum(got[b] == a for a, b in pairs) / len(pairs)
    print("recall", len(pairs), recall)
    assert len(pairs) > 2000 and recall >= 0.97 and all(got[a] == a for a, _ in pairs)
