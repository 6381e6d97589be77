"""Secret scans with a linear-chain conditional random field.

All tokens of a text are one chain: runs of word characters and ``+/.-``, and single marks. Each is
tagged begin (B), inside (I) or outside (O) of a secret by Viterbi. Features: the token's shape, the
two tokens before it and the one after it, and features of the file. Emissions are sums of table
rows, one gather an offset; where a token's margin for O is larger than all that neighbours could
make up for, O is the best tag whatever they are, so the exact best path is searched in the rest alone.

The model is trained here, by maximum likelihood (forward-backward, Adam), on ``TRAIN_CHAINS``
invented texts from a seeded generator; nothing of the corpus goes into it, so its size and cost
are fixed. The three base patterns are always reported; chains add spans of kind ``crf``: the parts
of what they tag that no base span covers and that hold a letter or digit.

Defined cases: null and empty texts have no spans (the digest of the empty text); very long texts
are scanned whole, in time that follows their length; several spans at one start are ordered by
kind; repeated rows are scanned each; an empty table gives an empty result; other columns,
whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import functools
import random
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

# The base patterns of the contract, their least lengths and the order of kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")

HEX_LONG = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"[\w+/](?:[\w+/.-]*[\w+/])?|[^\w\s]")
O, B, I = range(3)
TRAIN_CHAINS, EPOCHS, SEED = 2000, 60, 4711
#: Tokens after which a worker forgets the table rows it has made.
TABLE_ENTRIES = 200_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' whole matches, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # A run of this class is matched whole, so its length can be asked for at once.
    out += [(*m.span(), "hex") for m in HEX_LONG.finditer(text)]
    return out


VOWELS = str.maketrans("", "", "aeiouyAEIOUYáéíóúàèìòùâêîôûäëïöü")


def signature(s: str) -> tuple:
    """What a token's own features follow from."""
    n = len(s)
    if s.isalpha():
        plain = s.islower() or s.isupper() or s.istitle()
        bumps = 0 if plain else min(sum(a.islower() and b.isupper() for a, b in zip(s, s[1:], strict=False)), 4)
        return (min(n, 48) // 4, "word" if s.islower() else "upper" if s.isupper() else "title" if plain else "mixed", bumps, (n - len(s.translate(VOWELS))) * 5 // n, min(len(set(s)), 24) // 3, "", 0, 0, 0, 0, False)
    if n == 1:
        return (0, "digit" if s.isdigit() else f"mark={s}", 0, 0, 0, "", 0, 0, 0, 0, False)
    kinds = (any(c.isdigit() for c in s), any(c.islower() for c in s), any(c.isupper() for c in s), not s.isalnum())
    turns = min(sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False)), 6)
    bumps = min(sum(a.islower() and b.isupper() for a, b in zip(s, s[1:], strict=False)), 4)
    form = "hex" if n > 15 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "numeric" if re.fullmatch("[0-9._/+-]+", s) else ""
    dots, slashes, dashes = (min(s.count(c), 3) for c in "./-")
    return (min(n, 48) // 4, str(kinds), bumps, (n - len(s.translate(VOWELS))) * 5 // n, min(len(set(s)), 24) // 3, form, turns, dots, slashes, dashes, bool(re.match("[A-Za-z]{2,4}[_-]", s)))


def shape(sig: tuple) -> list[str]:
    """Features of a token alone."""
    names = ("len", "kinds", "bumps", "vowels", "distinct", "form", "turns", "dots", "slashes", "dashes", "lead")
    return [*(f"{n}={v}" for n, v in zip(names, sig, strict=True)), f"kinds={sig[1]},{sig[0] // 2}", f"len={sig[0]},{sig[4]}", "bias"]


def near(s: str, offset: int) -> tuple[str, str]:
    """Features that a token gives to the one ``offset`` places after it."""
    return f"{offset}:{s.lower()}", f"{offset}:{'mark' if not s[0].isalnum() else 'long' if len(s) > 15 else 'word' if s.isalpha() else 'mixed'} "


OFFSETS = (1, 2, -1)


def file_features(text: str) -> list[str]:
    code = sum(text.count(c) for c in "{};=") / max(1, len(text))
    digits = sum(text.count(c) for c in "0123456789") / max(1, len(text))
    return [f"file_code={min(int(code * 100), 4)}", f"file_digits={min(int(digits * 20), 4)}"]


def chain_features(tokens: list[str], file: list[str]) -> list[list[str]]:
    at = lambda i: tokens[i] if 0 <= i < len(tokens) else None
    return [[*shape(signature(t)), *(f for o in OFFSETS if (n := at(i - o)) is not None for f in near(n, o)), *file] for i, t in enumerate(tokens)]


def invented(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A short invented text and the spans of its secrets."""
    pick = rng.choice
    parts = pick((("th", "er", "an", "re", "on", "la", "de", "ing"), ("ción", "ue", "os", "ar", "mi", "la"), ("sch", "ung", "ei", "ver", "ü", "be"), ("eau", "é", "tion", "oi", "re")))
    word = lambda: "".join(pick(parts) for _ in range(rng.randint(1, 6)))
    some = lambda chars, a, b: "".join(pick(chars) for _ in range(rng.randint(a, b)))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    case = pick((str, str, str, str.title, str.upper))
    marks = pick((("", "", "", ",", "."), ("", "", "", ",", "."), ("!!", ".!!", "!"), ("$$$", "&&&", "***", "%%%", "###", ".%%%"), ("", "*", "#", "?", ";")))
    some_words = lambda n: " ".join(case(word()) + pick(marks) for _ in range(n))
    text, spans = some_words(rng.randint(2, 10)), []
    if rng.random() < 0.45:
        secret = pick((
            lambda: some(dig + "abcdef", 28, 64), lambda: some(low + up + dig + "+/", 24, 60) + pick(("", "=", "==")), lambda: some(low + up + dig, 18, 48), lambda: some(low + up, 16, 40),
            lambda: pick(("sk_live_", "ghp_", "xoxb-", "pk_test_", "key-")) + some(low + up + dig, 20, 40), lambda: some(low + up + dig + "_-", 20, 44) + pick(low), lambda: some(low + up + dig, 5, 9) + pick("!$#%&*") + some(low + up + dig, 5, 9),
        ))()
        intro = pick(("key", "auth", "bearer", "credential", "credentials", "private", "pwd", "access", "client", "authorization", "pass", "login", word(), word()))
        text += f" {case(intro)}{pick((' ', ': ', ' = ', '=', ' \"', ' is ', ':'))}"
        if rng.random() < 0.15 and len(secret) > 24 and secret[12].isalnum() and secret[11].isalnum():
            secret = f"{secret[:12]}\n{secret[12:]}"
        spans.append((len(text), len(text) + len(secret)))
        text += secret
    else:
        other = pick((
            lambda: some(dig, 4, 17), lambda: f"{some('12', 4, 4)}-{some('01', 2, 2)}-{some('012', 2, 2)}", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: f"+{some(dig, 2, 2)}-{some(dig, 3, 3)}-{some(dig, 6, 8)}",
            lambda: f"+1 ({some(dig, 3, 3)}) {some(dig, 3, 3)}-{some(dig, 4, 4)}", lambda: f"{word()}.{rng.randint(1, 99)}@{word()}{rng.randint(1, 9)}.{pick(('com', 'org'))}", lambda: f"{word()}{word()}{word()}{word()}",
            lambda: f"{word()}{some(dig, 1, 4)}.{pick(('png', 'html', 'txt', 'com'))}", lambda: f"http://www.{word()}.com/{word()}/{some(dig, 1, 5)}", lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}-beta{rng.randint(1, 9)}",
            lambda: f"{word()}{word()}{some(dig, 1, 3)}", lambda: f"/{word()}/{word()}/{some(dig, 1, 6)}", lambda: f"{word()}-{word()}-{some(dig, 1, 4)}", lambda: f"{word()}{word().title()}{word().title()}", lambda: (word() + word() + word()).upper(), lambda: f"{some(dig, 1, 3)},{some(dig, 3, 3)}.{some(dig, 2, 2)}",
            lambda: f"{some(up, 2, 3)} {some(up, 2, 2)}-{some(up, 2, 3)} {some(dig, 1, 1)}.{some(dig, 1, 1)}", lambda: f"{some(up, 2, 4)}-{some(up + dig, 2, 4)}", lambda: " ".join([f"{word()}.{word()}"] * 3), lambda: f"{some(up, 3, 5)}{some(dig, 2, 3)}",
        ))()
        text += f" {case(pick(('the', 'key', 'call', 'page', 'access', 'pass', word(), word())))}{pick((' ', ': ', ' ', ' = '))}{other}"
    return f"{text}{pick((' ', ', ', '. ', chr(34) + ' '))}{some_words(rng.randint(1, 8))}", spans


def examples(n: int, seed: int):
    """(features of each token, tags) of invented texts."""
    rng = random.Random(seed)
    for _ in range(n):
        text, secrets = invented(rng)
        tags, last, tokens = [], None, []
        for m in TOKEN.finditer(text):
            inside = next((s for s in secrets if s[0] < m.end() and m.start() < s[1]), None)
            tags.append(O if inside is None else I if inside == last else B)
            last = inside
            tokens.append(m.group())
        yield chain_features(tokens, file_features(text)), tags


@functools.cache
def trained(n: int = TRAIN_CHAINS, epochs: int = EPOCHS, seed: int = SEED) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature numbers, emission weights (features x 3) and transition weights (3 x 3)."""
    data = list(examples(n, seed))
    seen = Counter(f for feats, _ in data for fs in feats for f in fs)
    index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= 5))}
    length, width = max(len(t) for _, t in data), max(len(fs) for feats, _ in data for fs in feats)
    x = np.full((len(data), length, width), len(index))
    y = np.zeros((len(data), length), int)
    on = np.zeros((len(data), length), bool)
    for i, (feats, tags) in enumerate(data):
        for t, (fs, tag) in enumerate(zip(feats, tags, strict=True)):
            ks = [index[f] for f in fs if f in index]
            x[i, t, : len(ks)] = ks
            y[i, t], on[i, t] = tag, True
    w, tr = np.zeros((len(index) + 1, 3)), np.zeros((3, 3))
    state = [np.zeros_like(v) for v in (w, w, tr, tr)]
    for epoch in range(1, epochs + 1):
        gw, gt = gradient(x, y, on, w, tr)
        for v, g, m, s in ((w, gw, state[0], state[1]), (tr, gt, state[2], state[3])):
            g = g / len(data) + 1e-4 * v
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.2 * (m / (1 - 0.9**epoch)) / (np.sqrt(s / (1 - 0.99**epoch)) + 1e-8)
        w[-1] = 0
    return index, w, tr


#: I may only follow B or I; a chain starts after an O.
BAN = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]])


def gradient(x, y, on, w, tr):
    """Gradient of the negative log-likelihood, by forward-backward over all chains at once."""
    emit = w[x].sum(2)
    t1 = tr + BAN
    n, length, _ = emit.shape
    lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
    fwd, bwd = np.zeros((n, length, 3)), np.zeros((n, length, 3))
    fwd[:, 0] = emit[:, 0] + t1[O]
    for t in range(1, length):
        step = lse(fwd[:, t - 1, :, None] + t1[None], 1) + emit[:, t]
        fwd[:, t] = np.where(on[:, t, None], step, fwd[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = lse(t1[None] + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        bwd[:, t] = np.where(on[:, t + 1, None], step, 0)
    z = lse(fwd[:, -1], 1)
    p = np.exp(fwd + bwd - z[:, None, None]) * on[:, :, None]
    true = np.eye(3)[y] * on[:, :, None]
    diff = p - true
    gw = np.stack([np.bincount(x.ravel(), np.broadcast_to(diff[:, :, k, None], x.shape).ravel(), len(w)) for k in range(3)], 1)
    gt = np.zeros((3, 3))
    gt[O] += diff[:, 0].sum(0)
    for t in range(1, length):
        pair = np.exp(fwd[:, t - 1, :, None] + t1[None] + (emit[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]) * on[:, t, None, None]
        gt += pair.sum(0) - np.einsum("ni,nj->ij", true[:, t - 1], true[:, t])
    return gw, gt


def viterbi(emit: np.ndarray, tr: np.ndarray, more: bool = False) -> list[int]:
    """The best path after an O; with ``more``, one that goes on with an O."""
    t1 = tr + BAN
    best, back = emit[0] + t1[O], []
    for e in emit[1:]:
        step = best[:, None] + t1
        back.append(step.argmax(0))
        best = step.max(0) + e
    tags = [int((best + t1[:, O] * more).argmax())]
    for k in reversed(back):
        tags.append(int(k[tags[-1]]))
    return tags[::-1]


def slack(tr: np.ndarray) -> float:
    """What transitions can lose at most when a token's tag B or I is made O; a following I becomes B."""
    t1, worst = tr + BAN, 0.0
    for p in (O, B, I):
        for x in (B, I):
            if (p, x) == (O, I):
                continue
            into = t1[p, x] - t1[p, O]
            worst = max(worst, into, *(into + t1[x, n] - t1[O, n] for n in (O, B)))
            follow = into + t1[x, I] - t1[O, B]
            worst = max(worst, follow, *(follow + t1[I, m] - t1[B, m] for m in (O, B, I)))
    return float(worst)


class Tagger:
    """Emissions from tables of one row a token, and the best path."""

    def __init__(self, model) -> None:
        self.index, self.w, self.tr = model
        self.slack = slack(self.tr)
        self.clear()

    def clear(self) -> None:
        # Code 0 of no token stands for the empty sum.
        self.ids = {None: 0}
        self.codes = [array("i", [0]) for _ in range(1 + len(OFFSETS))]
        self.known = [{None: 0} for _ in self.codes]
        self.sums_of = [[np.zeros(3)] for _ in self.codes]
        self.tables = [np.zeros((1, 3)) for _ in self.codes]

    def sums(self, features_) -> np.ndarray:
        return self.w[[self.index[f] for f in features_ if f in self.index]].sum(0)

    def code(self, k: int, key, features_) -> int:
        """Number of a sum of weights of table ``k``."""
        known = self.known[k]
        if key not in known:
            known[key] = len(known)
            self.sums_of[k].append(self.sums(features_(key)))
        return known[key]

    def add(self, t: str) -> None:
        self.ids[t] = len(self.ids)
        self.codes[0].append(self.code(0, signature(t), shape))
        for k, o in enumerate(OFFSETS, 1):
            self.codes[k].append(self.code(k, tuple(f for f in near(t, o) if f in self.index), list))

    def emissions(self, tokens: list[str], file: list[str]) -> np.ndarray:
        if len(self.ids) > TABLE_ENTRIES:
            self.clear()
        ids = [*map(self.ids.get, tokens)]
        if None in ids:
            for t in {t for t, k in zip(tokens, ids, strict=True) if k is None}:
                self.add(t)
            self.tables = [np.stack(v) if len(v) != len(t) else t for v, t in zip(self.sums_of, self.tables, strict=True)]
            ids = [*map(self.ids.get, tokens)]
        at = np.array(ids)
        codes = [np.frombuffer(c, np.int32) for c in self.codes]
        emit = self.tables[0][codes[0][at]] + self.sums(file)
        for k, o in enumerate(OFFSETS, 1):
            other = np.zeros_like(at)
            if o > 0:
                other[o:] = at[:-o]
            else:
                other[:o] = at[-o:]
            emit += self.tables[k][codes[k][other]]
        return emit

    def tags(self, emit: np.ndarray) -> dict[int, int]:
        """Tags other than O of the best path, by token."""
        gain = emit[:, 1:].max(1) - emit[:, O]
        follow = np.zeros(len(emit))
        follow[:-1] = np.maximum(emit[1:, I] - emit[1:, B], 0)
        may = np.flatnonzero(gain + follow + self.slack >= 0)
        out = {}
        for part in np.split(may, np.flatnonzero(np.diff(may) > 1) + 1) if len(may) else ():
            # What follows the stretch, if anything, is O.
            path = viterbi(emit[part[0] : part[-1] + 1], self.tr, part[-1] + 1 < len(emit))
            out |= {int(k): t for k, t in zip(part, path, strict=True) if t != O}
        return out

    def spans(self, text: str) -> list[list[int]]:
        tokens = TOKEN.findall(text)
        tags = self.tags(self.emissions(tokens, file_features(text))) if tokens else {}
        found: list[list[int]] = []
        if tags:
            for k, m in enumerate(TOKEN.finditer(text)):
                if (tag := tags.get(k)) == B:
                    found.append([m.start(), m.end()])
                elif tag == I:
                    found[-1][1] = m.end()
        return found


def outside(found: list, covered: list) -> list[tuple[int, int]]:
    """The parts of the ``found`` spans, which don't overlap, that no ``covered`` span has; both sorted."""
    parts: list[tuple[int, int]] = []
    k, reach = 0, 0
    for a, b in found:
        at = max(a, reach)
        while k < len(covered) and covered[k][0] < b:
            if at < covered[k][0]:
                parts.append((at, covered[k][0]))
            reach = max(reach, covered[k][1])
            at = max(at, reach)
            k += 1
        if at < b:
            parts.append((at, b))
    return parts


def scan(text: str | None, tagger: Tagger) -> list[tuple[int, int, str]]:
    """All spans of a whole text, by start and then kind."""
    text = text or ""
    out = base_spans(text)
    more = outside(tagger.spans(text), sorted((a, b) for a, b, _ in out))
    out += [(a, b, "crf") for a, b in more if any(map(str.isalnum, text[a:b]))]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and spans (array of start, end, kind, text)."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("secret", pa.string())]))
    model = docs.sparkSession.sparkContext.broadcast(trained())  # of a fixed size

    def run(batches):
        tagger = Tagger(model.value)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append([{"start": a, "end": b, "kind": k, "secret": text[a:b]} for a, b, k in scan(text, tagger)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "spans"])

    out = df.mapInArrow(run, f"id {dict(df.dtypes)['id']}, spans array<struct<start:bigint,end:bigint,kind:string,secret:string>>")
    return out.withColumnRenamed("id", id_col)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
