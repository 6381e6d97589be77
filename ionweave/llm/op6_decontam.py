"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Every window of ten consecutive item words (or the whole item, if it is shorter) is a pattern. A word
of the benchmark is coded as two characters, of two alphabets of about the root of the vocabulary's
size, so no node has more children than that, and a pattern has 20 nodes whatever its words. A
document is normalised and coded once (words that no item has are one code of their own) and scanned
once; each match is mapped back to its words and to the code points of the original text.

The automaton is built once, on the driver, and broadcast as built; a Python worker loads it once.
Its size is checked first: ``most_words`` item words take at most about 0.8 KB each. A benchmark of
more words is cut by a hash of its items into parts below the bound, which are collected, built
and let go one after another; each further part is a further scan, and the result is the same.

Defined cases: null or empty texts have no words; items without words are never found; items with
the same words are all reported; repeated rows are judged each; a null item id is reported as the
text "null"; an empty benchmark or an empty table gives no hits or no rows; other columns,
whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import pieces, table

WINDOW = 10
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


#: Code of the words that no item has.
OTHER = "\0\0"
#: A word in a text that isn't lower-cased yet, as a pattern of Java.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Finder:
    """The automaton of all windows of some items: ``codes`` of words, and for each pattern its
    number of words and the numbers of its items in ``names``."""

    def __init__(self, items: Iterable[tuple[str, str | None]]) -> None:
        import ahocorasick

        self.names: list[str] = []
        texts: list[list[str]] = []
        for name, text in items:
            self.names.append(name)
            texts.append(words_of(text))
        vocabulary = sorted({w for words in texts for w in words})
        side = math.isqrt(len(vocabulary)) + 1
        self.codes = {w: chr(1 + k // side) + chr(1 + side + k % side) for k, w in enumerate(vocabulary)}
        self.owners: list[list[int]] = []
        self.lengths: list[int] = []
        auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, words in enumerate(texts):
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                part = words[i : i + WINDOW]
                pattern = "".join(map(self.codes.__getitem__, part))
                at = auto.get(pattern, -1)
                if at < 0:
                    auto.add_word(pattern, len(self.owners))
                    self.owners.append([k])
                    self.lengths.append(len(part))
                elif self.owners[at][-1] != k:
                    self.owners[at].append(k)
        self.auto = auto if self.owners else None
        if self.auto:
            auto.make_automaton()

    def matches(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(place of the last code, pattern) of all matches."""
        return self.auto.iter("".join(map(self.codes.get, words, repeat(OTHER)))) if self.auto and words else iter(())


def scan(text: str | None, finder: Finder):
    """(words, hit flags, names of found items) of one whole text."""
    w = words_of(text)
    cover = np.zeros(len(w) + 1, np.int64)
    patterns: set[int] = set()
    for end, k in finder.matches(w):
        last = end // 2
        cover[last - finder.lengths[k] + 1] += 1
        cover[last + 1] -= 1
        patterns.add(k)
    return w, np.cumsum(cover)[:-1] > 0, {finder.names[i] for k in patterns for i in finder.owners[k]}


def spans(text: str, hit: np.ndarray) -> list[list[int]]:
    """Runs of hit words as code points of the original text, end exclusive."""
    at = [m.span() for m in WORD.finditer(text.translate(UPPER))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [[at[a][0], at[b - 1][1]] for a, b in zip(edge[::2], edge[1::2], strict=True)]


def finders(benchmark: DataFrame, item_col: str, text_col: str, most_words: int) -> list[Broadcast]:
    """Broadcast automata of the benchmark: one, if it has at most ``most_words`` words."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    words = items.agg(F.sum(F.regexp_count("text", F.lit(ANY_CASE)))).first()[0] or 0
    parts = -(-words // most_words) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    # A broadcast is a file: the driver holds one automaton at a time.
    return [items.sparkSession.sparkContext.broadcast(Finder(map(tuple, items.where(part == k).toLocalIterator()))) for k in range(parts)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_words: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (array of found item ids, sorted),
    spans (array of [start, end) in code points), contaminated."""
    parts = finders(benchmark, item_col, item_text_col, most_words)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = df.schema["id"].dataType
    one = T.StructType([T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])
    more = len(parts) > 1
    if more:
        one.add("text", T.StringType()).add("hit", T.BinaryType())
        df = df.select("id", "text", F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    for shared in parts:

        def step(batches, shared=shared, more=more):
            finder = shared.value
            for batch in batches:
                rows = []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    w, hit, found = scan(text, finder)
                    if more:
                        found |= set(batch.column("items")[i].as_py() or ())
                        if (before := batch.column("hit")[i].as_py()) is not None:
                            hit = hit | np.frombuffer(before, bool)
                    rows.append([len(w), int(hit.sum()), sorted(found), spans(text, hit) if hit.any() else [], text, hit.tobytes()])
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.string(), pa.binary()]
                n = 6 if more else 4
                arrays = [pa.array(c, k) for c, k in zip(cols[:n], kinds[:n], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", "n_words", "n_hit", "items", "spans", "text", "hit"][: n + 1])

        df = df.mapInArrow(step, one)
    return df.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_words: int = 500_000) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns; a row is judged by
    its own text. Each automaton is one filter; it leaves a text at its first match."""
    at = docs.columns.index(text_col)
    for shared in finders(benchmark, item_col, item_text_col, most_words):

        def run(batches, shared=shared):
            finder = shared.value
            for batch in pieces(batches):
                yield batch.filter(pa.array([next(finder.matches(words_of(t)), None) is None for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS s FROM bw),
lens AS (SELECT DISTINCT n FROM pat),
pos AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
m AS (SELECT pos.doc_id, pos.n, pos.i, pat.item_id FROM pos JOIN d ON d.doc_id = pos.doc_id JOIN pat ON pat.n = pos.n AND pat.s = array_to_string(d.w[pos.i:pos.i+pos.n-1], ' ')),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
