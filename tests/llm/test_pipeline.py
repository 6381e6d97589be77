"""The corpus pipeline against the operators applied one after another, and its wiring."""

import random
import re
from collections import Counter

import corpus_pipeline as cp
from ionweave.llm import op3_toxicity as o3
from ionweave.llm.shared import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages(spark, tmp_path):
    rng = __import__("random").Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    clean = [" ".join(word() for _ in range(60)) for _ in range(60)]
    leak = " ".join(word() for _ in range(15))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i].replace(" ", "  ", 1), "en", "s0", 0) for i in range(5)]
    rows += [(200 + i, clean[i + 10] + " more", "en", "s1", 0) for i in range(5)]
    rows += [(300 + i, clean[i][:20] + f" {leak} " + word(), "en", "s2", 0) for i in range(3)]
    rows += [(400 + i, " ".join(word() for _ in range(30)) + " vilescum " + word(), "en", "s0", 0) for i in range(40)]
    rows += [(None, None, None, None, None), (7, clean[7], "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 400)) for i in [*range(60), *range(400, 440)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/{len(left)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(left)}")
        left.append({r.doc_id for r in docs.collect()})
    assert left[0] == {r[0] for r in rows if r[0] is None or r[0] < 400}
    assert left[1] == left[0] - set(range(100, 105))
    assert left[2] == left[1] - set(range(200, 205))
    assert left[3] == left[2] - set(range(300, 303))
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((i is None, i) for i in left[3])
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES][0] == "toxicity" and o3 is not None


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, toxic, items):
    """The rows that the first four stages leave, by plain Python; ``toxic`` judges a text."""
    rows = [r for r in rows if not toxic(r[1])]
    space = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(space(r[1]), r)
    rows = list(first.values())
    ids = Counter(r[0] for r in rows)
    order = sorted(rows, key=lambda r: (r[0] is None or ids[r[0]] > 1, r[0] if r[0] is not None and ids[r[0]] == 1 else 0))

    def shingles(t):
        w = [x.translate(LOWER) for x in space(t).split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(r[1]) for r in order], list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    rows = [r for k, r in enumerate(order) if root[k] == k]
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate(LOWER))
    windows = {tuple(w[i : i + 10]) for w in map(words, items) for i in range(max(1, len(w) - 9) if w else 0)}
    lengths = {len(w) for w in windows}
    hit = lambda ws: any(tuple(ws[i : i + n]) in windows for n in lengths for i in range(len(ws) - n + 1))
    return [r for r in rows if not hit(words(r[1]))]


def test_rows_against_brute_force(spark, tmp_path):
    """Null ids, shared ids, rows equal in all columns, copies that differ in white space, near copies among
    rows without ids, a very long text, ties and a column that clashes with the operators' own."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [" ".join(word() for _ in range(50)) for _ in range(25)]
    leak = " ".join(word() for _ in range(12))
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(base)]
    rows += [(1, "same text here", "en", "s0", 0), (None, "same text here", "en", "s0", 0), (None, "same  text  here", "en", "s0", 0), (None, "unique one", None, None, None)]
    rows += [(5, "another text of id five", "en", "s0", 0), (6, base[6], "en", "s0", 0), (6, base[6], "en", "s0", 0), (30, base[7], "en", "s1", 1), (30, base[8] + " more", "en", "s1", 1)]
    rows += [(None, base[9] + " tail", "en", "s2", 0), (None, base[10] + "\n", "en", "s2", 0), (None, None, None, None, None), (40, "", "en", "s0", 0), (41, " \t", "en", "s0", 0), (42, "  ", None, None, 0)]
    rows += [(50, f"{word()} {leak} {word()}", "en", "s0", 0), (None, leak.upper().replace(" ", "--"), "en", "s0", 0), (51, "vilescum " * 3 + base[3], "en", "s1", 0), (None, "vilescum " * 3 + base[4], "en", "s1", 0)]
    rows += [(60, " ".join(word() for _ in range(30_000)), "en", "s0", 0), (61, base[11].upper(), "en", "s0", 0)]
    rows += [(100 + i, " ".join(word() for _ in range(30)) + " vilescum vilescum " + word(), "en", "s0", 0) for i in range(40)]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' AS _key", "1 AS predicted", "2 AS row", "3 AS kept")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in [*range(5, 25), *range(100, 140)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    score = o3.Scorer(o3.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).score
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    want = brute(rows, lambda t: score(t)[0] >= 0.5, [leak, None])
    key = lambda r: (r[0] is None, r[0] or 0, " ".join((r[1] or "").split()))
    got = sorted((key(r) for r in docs.collect()))
    assert got == sorted(map(key, want)) and len(got) == len(set(got))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in cp.run(spark, str(tmp_path)).collect()) == [g[:2] for g in got]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def workers(plan, above=0):
    """The most Python steps that one task of a plan runs, one after another."""
    if "AdaptiveSparkPlan" in plan.nodeName():
        return workers(plan.initialPlan(), above)
    above = 0 if "Exchange" in plan.nodeName() else above + (plan.nodeName() == "MapInArrow")
    kids = plan.children()
    return max([above, *(workers(kids.apply(k), above) for k in range(kids.size()))])


def test_a_task_holds_one_worker(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    docs = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en", "s0", 0) for i, t in enumerate(docs + [f"{t} more" for t in docs])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    most, keep = [], Scratch.keep

    def noted(self, df, name):
        most.append(workers(df._jdf.queryExecution().executedPlan()))
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", noted)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = cp.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == list(range(40))
    assert max(most) == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_entry_lists_them():
    import __spark_entry__ as e

    names = e.queries()
    for k in range(1, 11):
        assert sum(n.startswith(f"op{k}_") for n in names) == 1
    assert "pipeline" in names
