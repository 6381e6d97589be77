"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word is a run of symbols (bytes, the last one marked as the end of the word). One Aho-Corasick
automaton of all tokens gives, in one scan of the word, the longest token at each position. The encoder
takes it if it is compatible with the token before, and its longest proper prefix that is a token if
not; where no prefix is left, the position is marked as dead and the token before it gives way. Each
position dies once, so the work is linear in the word's length.

Two tokens are compatible if the merges, applied to both strings in a row, leave just these two. A
merge across their border needs a piece at the right edge of the first and one at the left edge of
the second that are whole at the same time; both edges' pieces are tables made from the merges, and
answers are kept in a table of pairs. A row of tokens is what the merges make of a word if and only if
all neighbours are compatible, since tokens are merged in the order of their ids (which is checked).

Where the longest tokens in a row, which the automaton gives at once, are compatible, they are the answer;
only other words need the search.

Normalisation and the cut into words are those of the tokenizer's file, by its library. No word holds
white space, so a text is cut at it and each chunk handled alone. Chunks of common Latin letters, digits
and marks, where both steps are lower case and one pattern, are cut without the library. The ids of
short words and chunks are kept in bounded tables. Special tokens in a text are tokens, as the library has it.

Decoding joins the tokens' strings with blanks, as the file names no decoder: one gather from a single
buffer of all strings, by a table of offsets.

Defined cases: null and empty texts, and texts of white space alone, have no ids, and no ids give the
empty text; a null array decodes to the empty text, a null or unknown id in one raises; very long texts are read in runs of ``RUN_CHARS`` and
only a chunk without any white space is handled whole; repeated rows are encoded each; an empty table
gives an empty result; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import pieces, table

#: Entries after which a worker forgets those that it hasn't used since, and the characters up to which a word is kept.
TABLE_ENTRIES, WORD_CHARS = 100_000, 64
#: Characters of a text that are cut into chunks at once.
RUN_CHARS = 1 << 18
#: Ids that are decoded at once.
RUN_IDS = 1 << 18
#: The largest vocabulary file that is broadcast.
MAX_FILE = 64 << 20
WHITE = re.compile(r"[ \t\n\r]+")
# The words of the file's pattern, its cut of texts of PLAIN characters in lower case. PLAIN are those that
# normalisation leaves but for their case, one by one: no marks that compose, no other white space.
PLAIN = re.compile("[ \t\n\r\x21-\x7e¡«»¿\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]*+")
PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017e]+|[0-9]|[!-/:-@\\[-`{-~¡«»¿]+")
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NEVER = 1 << 40


class Kept(dict):
    """The answers of ``make``, of which the last used are kept: at most twice ``TABLE_ENTRIES``."""

    def __init__(self, make) -> None:
        self.make, self.before = make, {}

    def __missing__(self, key):
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
        if type(key) is not str or len(key) <= WORD_CHARS:
            if len(self) >= TABLE_ENTRIES:
                self.before = dict(self)
                self.clear()
            self[key] = got
        return got


class Encoder:
    """The tables of one tokenizer file (BPE with words' ends marked, over byte symbols)."""

    def __init__(self, text: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(text)
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.end or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("the encoder takes byte-pair vocabularies with a mark of words' ends alone")
        if spec["decoder"] is not None or spec["post_processor"] is not None or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("the file names a decoder, a post-processor or added tokens of another kind")
        self.normalize, self.words = made.normalizer.normalize_str, made.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        vocab: dict[str, int] = model["vocab"]
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * n
        for s, i in (vocab | self.special).items():
            self.strings[i] = s
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: A pair's id is the token that it makes; ids grow in the order of the merges.
        self.merged = {(vocab[a], vocab[b]): vocab[a + b] for a, b in pairs}
        order = list(self.merged.values())
        if order != sorted(set(order)) or any(m <= max(p) for p, m in self.merged.items()):
            raise ValueError("tokens must be made once, in the order of their ids, of tokens before them")
        parts = {m: p for p, m in self.merged.items()}
        #: Symbols as characters: the marked form of a byte is another character than the byte.
        self.marked = {s: chr(0xE000 + k) for k, s in enumerate(sorted({s[: -len(self.end)] for s in vocab if s.endswith(self.end) and len(s) == len(self.end) + 1}))}
        symbols = [self.as_symbols(s) for s in self.strings]
        self.length = [len(s) for s in symbols]
        # Pieces at both edges of a token, with the id of the token that each of them goes into.
        self.right: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.left: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.pairs = Kept(lambda p: not self._crossed(*p, NEVER))
        usable = [False] * n
        for i in sorted(vocab.values()):
            self.right[i] = self.left[i] = [(i, NEVER)]
            usable[i] = True
            if i in parts:
                a, b = parts[i]
                # The token stands for its string only if no other merge crosses the border of its parts first.
                usable[i] = usable[a] and usable[b] and not self._crossed(a, b, i)
                self.right[i] = [(i, NEVER), (b, i), *((x, up) for x, up in self.right[b][1:])]
                self.left[i] = [(i, NEVER), (a, i), *((x, up) for x, up in self.left[a][1:])]
        ids = {symbols[i]: i for i in vocab.values() if usable[i]}
        self.shorter = [-1] * n
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            self.automaton.add_word(s, i)
            self.shorter[i] = next((ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in ids), -1)
        self.automaton.make_automaton()
        cut = [x["pattern"].get("Regex") for x in spec["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        steps = [x["type"] for x in spec["normalizer"].get("normalizers", [])]
        #: Whether PLAIN texts are cut by PLAIN_WORD.
        self.has_plain = cut == [PLAIN_PATTERN] and steps == ["NFC", "Replace", "Lowercase"]
        self.plain_words, self.chunks = Kept(self._plain_word), Kept(self._chunk)

    def as_symbols(self, s: str) -> str:
        if s.endswith(self.end) and len(s) > len(self.end):
            s = s[: -len(self.end)]
            return s[:-1] + self.marked[s[-1]]
        return s

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of an id under ``before`` joins a right piece of ``a`` with a left piece of ``b``
        while both are there: of equal merges the one further left comes first."""
        for x, x_up in self.right[a]:
            for y, y_up in self.left[b]:
                m = self.merged.get((x, y))
                if m is not None and m < x_up and m <= y_up and m < before:
                    return True
        return False

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word, given as byte characters."""
        s = word[:-1] + self.marked[word[-1]]
        pairs, length, shorter = self.pairs, self.length, self.shorter
        straight = [i for _, i in self.automaton.iter_long(s)]
        good = 1
        for p in zip(straight, straight[1:]):
            if not pairs[p]:
                break
            good += 1
        if good >= len(straight):
            return straight
        n = len(s)
        longest = [-1] * n
        for end, i in self.automaton.iter(s):
            at = end + 1 - length[i]
            # Matches that start at a position come in the order of their ends: the last is the longest.
            longest[at] = i
        alive = bytearray(b"\1") * (n + 1)
        # The search starts where the straight row breaks.
        out = straight[:good]
        at = sum([length[i] for i in out])
        token = shorter[straight[good]]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0 and not (alive[at + length[token]] and (last < 0 or pairs[last, token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = 0
                out.pop()
                at -= length[last]
                token = shorter[last]
        return out

    def _chunk(self, chunk: str) -> bytes:
        ids = array("i")
        at = 0
        for m in [*self.specials.finditer(chunk), None]:
            part = chunk[at : m.start() if m else len(chunk)]
            if part:
                for word, _ in self.words(self.normalize(part)):
                    ids.extend(self.encode_word(word))
            if m:
                ids.append(self.special[m[0]])
                at = m.end()
        return ids.tobytes()

    def _plain_word(self, word: str) -> bytes:
        parts = [word] if word.isascii() else [w for w, _ in self.words(word)]
        return array("i", [i for w in parts for i in self.encode_word(w)]).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.plain_words.__getitem__, PLAIN_WORD.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as 32-bit integers."""
        out = []
        for run in runs(text):
            if not self.has_plain:
                out += map(self.chunks.__getitem__, WHITE.split(run))
                continue
            # Plain stretches up to a white space are cut at once, and what isn't plain is cut out as a chunk.
            at = 0
            while at < len(run):
                end = PLAIN.match(run, at).end()
                if end < len(run):
                    end = max(at, *(run.rfind(c, at, end) + 1 for c in " \t\n\r"))
                if end > at:
                    part = run[at:end]
                    if self.specials.search(part):
                        out += map(self.chunks.__getitem__, WHITE.split(part))
                    else:
                        out.append(self._plain(part))
                if end < len(run):
                    m = WHITE.search(run, end)
                    stop = m.start() if m else len(run)
                    out.append(self.chunks[run[end:stop]])
                    end = stop
                at = end
        return b"".join(out)


def runs(text: str) -> Iterator[str]:
    """A text in runs of about ``RUN_CHARS``, cut at white space."""
    at = 0
    while len(text) - at > RUN_CHARS:
        m = WHITE.search(text, at + RUN_CHARS)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


class Decoder:
    """All tokens' strings in one buffer, a blank after each, and where each begins."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        every = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: s for s, i in every.items()}
        parts = [(by_id[i] + " ").encode() if i in by_id else b"" for i in range(max(by_id) + 1)]
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids, with a blank at its end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.at) - 1):
            raise ValueError("an id is not in the vocabulary")
        out = []
        for k in range(0, len(ids), RUN_IDS):
            part = ids[k : k + RUN_IDS]
            start, size = self.at[part], self.at[part + 1] - self.at[part]
            before = np.cumsum(size) - size
            out.append(self.data[np.repeat(start - before, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(out)


def vocabulary(spark: SparkSession, path: str) -> str:
    """A tokenizer file, read by Spark; raises beyond ``MAX_FILE``, as its text is broadcast."""
    size = spark.read.format("binaryFile").load(path).select("length").first()[0]
    if size > MAX_FILE:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_FILE} are broadcast")
    return spark.read.text(path, wholetext=True).first()[0]


_made: dict = {}


def _tables(kind: type, shared):
    """The tables of a broadcast file, made once a worker."""
    if _made.get(kind, (None,))[0] != shared.value:
        _made[kind] = (shared.value, kind(shared.value))
    return _made[kind][1]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ids (array of int)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(spark, path))
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        made = _tables(Encoder, shared)
        for batch in pieces(batches):
            ids = [made.encode(t.as_py()) for t in batch.column("text")]
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) >> 2 for x in ids])]).astype(np.int32))
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(at, flat)], ["id", "ids"])

    out = df.mapInArrow(run, T.StructType([df.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return out.select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows of ``encoded`` with all their columns, and the text of their ids as ``out_col``."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(spark, path))
    at = encoded.columns.index(ids_col)
    df = encoded.toDF(*(f"c{k}" for k in range(len(encoded.columns))))

    def run(batches):
        made = _tables(Decoder, shared)
        for batch in pieces(batches):
            lists = batch.column(at)
            texts = [made.decode(np.asarray(pc.fill_null(x.values, -1)) if x.is_valid else np.zeros(0, np.int32))[:-1] for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField("decoded", T.StringType())])).toDF(*encoded.columns, out_col)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"file://{public_tokenizers.path('word_bpe_49k.json')}"
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
