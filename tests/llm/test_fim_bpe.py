"""Fill-in-the-middle and byte-pair encoding against brute-force versions, SQL and the library."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ionweave.llm import op11_fim, op12_bpe

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
URL = f"file://{PATH}"
ODD = [None, "", " ", "\n\t ", "a", " a ", "a<P>b", "<<S", "x <", "<|endoftext|>", "<|startoftext|>A<|endoftext|>", "<|ENDOFTEXT|>", "İ É é ﷺ ſ", "a b\x1cc\x85d", "漢字 😀", "don't I'LL", "one two  three\n\nfour ", "one two  three\n\nfour "]


def plain_fim(doc_id, text, seed=42, percent=50, spm=80):
    """The contract, with a list of units."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < spm:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@pytest.fixture(scope="module")
def odd_rows():
    long = "lorem ipsum\tdolor  " * 60_000
    rows = list(enumerate([*ODD, long, "a" * 300_000, " " * 100_000 + "x"]))
    return rows + [(None, "with no id at all here"), (7, "another text of id seven"), (7, "another text of id seven")]


def test_fim_odd_rows(spark, odd_rows):
    docs = spark.createDataFrame([(i, t, "x", t) for i, t in odd_rows], "doc_id long, text string, n string, output string")
    for percent in (50, 100):
        out = op11_fim.transform(docs, percent=percent).withColumn("back", op11_fim.restored(F.col("form"), F.col("output")))
        got = sorted(((r[0], *r[1:]) for r in out.collect()), key=repr)
        want = sorted(((i, *plain_fim(i, t, percent=percent), t or "") for i, t in odd_rows), key=repr)
        assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert op11_fim.transform(docs.where("false")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x0bab<é", max_size=40), st.integers(0, 50), st.integers(0, 50))
def test_cuts_are_those_of_a_list_of_units(text, a, b):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = op11_fim.count_units(text)
    assert n == len(units)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    assert op11_fim.cuts(text, low, high) == (len("".join(units[:low])), len("".join(units[:high])))


def test_fim_marks_are_regex_safe(spark):
    docs = spark.createDataFrame([(i, "some words to be cut (here) [or] there") for i in range(20)], "doc_id long, text string")
    marks = ("(", "[x]", "|m|")
    out = op11_fim.transform(docs.replace("(", ""), marks=("(p)", "[x]", "|m|"), percent=100, spm_percent=50)
    back = out.select(op11_fim.restored(F.col("form"), F.col("output"), ("(p)", "[x]", "|m|")).alias("t"), "form").collect()
    assert {r.t for r in back} == {"some words to be cut (here) [or] there"} and {r.form for r in back} == {"psm", "spm"}
    assert {r.form for r in op11_fim.transform(docs, marks=marks, percent=100).collect()} == {"plain"}


def test_fim_query_is_its_sql(spark):
    got = op11_fim.op11_fill_in_middle(spark, SMALL)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{SMALL}/documents.parquet'")
    want = con.sql(op11_fim.SQL)
    assert got.columns == want.columns
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(want.fetchall())
    assert {r[2] for r in rows} == {"plain", "psm", "spm"} and len({r[0] for r in rows}) == spark.read.parquet(f"{SMALL}/documents.parquet").count()


@pytest.fixture(scope="module")
def both():
    text = open(PATH, encoding="utf8").read()
    return Tokenizer.from_file(PATH), op12_bpe.Encoder(text), op12_bpe.Decoder(text)


def same(both, text):
    library, encoder, decoder = both
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), np.int32).tolist() == want, text[:80]
    assert decoder.decode(np.array(want, np.int32))[:-1].decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="abcdeinghs ", max_size=60), st.text(alphabet=" aA'<|>endofstarx0!éÀ́̀İ\n", max_size=40), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", " ", "aa", "ing", "'ll", "́", "haha"]), max_size=20).map("".join)))
def test_encoder_is_the_library(both, text):
    same(both, text)


def test_encoder_on_pieces_of_the_vocabulary(both):
    rng = random.Random(5)
    strings = [s.replace("</w>", "") for s in both[0].get_vocab()]
    for _ in range(3000):
        same(both, "".join(rng.choice(strings) for _ in range(rng.randint(1, 6))))


def test_encoder_on_long_words_and_texts(both):
    for text in ["a" * 3000, "ab" * 2000, "!" * 2000, "x yz\t" * 100_000, "word " * 60_000 + "a" * 2000, " " * 600_000 + "a", "0" * 5000, "<|endoftext|>" * 2000]:
        same(both, text)


def test_each_position_dies_once(both, monkeypatch):
    """Work follows the length of a word, also where longest matches mislead."""
    encoder = both[1]
    asked = []

    class Counted(op12_bpe.Kept):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    monkeypatch.setattr(encoder, "pairs", Counted(encoder.pairs.make))
    sizes = []
    for n in (2000, 4000):
        asked.clear()
        encoder.encode_word("abcdefghij" * (n // 10))
        sizes.append(len(asked))
    assert sizes[1] < 2.2 * sizes[0] and sizes[0] < 10 * 2000


def test_tables_that_are_full_change_nothing(spark, monkeypatch, both):
    monkeypatch.setattr(op12_bpe, "TABLE_ENTRIES", 3)
    monkeypatch.setattr(op12_bpe, "RUN_CHARS", 5)
    monkeypatch.setattr(op12_bpe, "RUN_IDS", 2)
    for t in (both[1].plain_words, both[1].chunks, both[1].pairs):
        t.clear()
        t.before.clear()
    for text in ["the quick brown fox jumps over the lazy dog", "a  b\n\nccc dddd eeeee", "incomprehensibilities notwithstanding"] * 2:
        same(both, text)


def test_bpe_odd_rows(spark, odd_rows, both):
    docs = spark.createDataFrame([(i, t, 1, t) for i, t in odd_rows], "doc_id long, text string, id int, ids string")
    out = op12_bpe.decode(op12_bpe.encode(docs, URL), URL)
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in out.collect()), key=repr)
    want = []
    for i, t in odd_rows:
        ids = both[0].encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, both[0].decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert op12_bpe.decode(op12_bpe.encode(docs.where("false"), URL), URL).count() == 0


def test_decode_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x", {"k": 1}), (2, [], "y", None), (3, [320, 49407], None, {})], "decoded int, ids array<int>, `a.b` string, m map<string,int>")
    rows = op12_bpe.decode(df, URL, out_col="text").collect()
    assert [(r[0], r["text"], r["a.b"], r["m"]) for r in rows] == [(1, "", "x", {"k": 1}), (2, "", "y", None), (3, "a</w> <|endoftext|>", None, {})]
    with pytest.raises(Exception, match="not in the vocabulary"):
        op12_bpe.decode(spark.createDataFrame([([1, 60000],)], "ids array<int>"), URL).collect()


def test_bpe_query(spark, both):
    rows = {r.doc_id: tuple(r)[1:] for r in op12_bpe.op12_bpe(spark, SMALL).collect()}
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(rows) == len(texts)
    for k, t in texts.items():
        ids = both[0].encode(t or "", add_special_tokens=False).ids
        assert rows[k] == (len(ids), sha(" ".join(map(str, ids))), sha(both[0].decode(ids, skip_special_tokens=False)))


def test_files_of_another_kind_are_refused(spark):
    text = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf8").read()
    with pytest.raises(ValueError):
        op12_bpe.Encoder(text)
