"""Fill-in-the-middle transformation with a two-pass streaming matcher.

A text is a sequence of units: white space with the word after it, or white space at the end. The
first pass over a text's lazy match iterator counts the units. Two draws, keyed by the seed and the
row's id, give the ranks of two units; the second pass advances a new iterator to the smaller rank
and then on to the larger, and stops there. No list of units is ever made: beyond the text and the
output, a row takes the same memory whatever its length.

The draws (``sha2`` of seed and id), the form, and the way back from an output to its text are column
expressions; only the matcher is Python, over Arrow batches cut into small pieces. Nothing is shuffled.

Defined cases: a null text is the empty text, and an empty text is plain with 0 units; a text of white
space alone is one unit; a text that holds a mark is plain, so that every output can be undone; a very
long text is one row like any other; a null id draws as the id of no characters; rows that share an id
draw alike, each over its own text; an empty table gives an empty result; other columns, whatever their
names, are neither read nor returned.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import pieces, table

# Fixed values of the contract: the units of a text, and the marks before prefix, suffix and middle.
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
MARKS = ("<P>", "<S>", "<M>")


def count_units(text: str) -> int:
    """First pass: how many units a text has."""
    n = 0
    for _ in UNIT.finditer(text):
        n += 1
    return n


def cuts(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: the code points where the first ``low`` and the first ``high`` units end."""
    units = UNIT.finditer(text)
    ends = [0, 0]
    done = 0
    for k, rank in enumerate((low, high)):
        ends[k] = ends[0]
        while done < rank:
            ends[k] = next(units).end()
            done += 1
    return ends[0], ends[1]


def _drawn(id_col: str, seed: int) -> list[Column]:
    """Four draws of a row: the first four groups of eight digits of the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row per row of ``docs``: id, n, form (plain, psm or spm), prefix_chars, middle_chars, output.

    ``percent`` of the texts are rearranged, ``spm_percent`` of these with the suffix first."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = _drawn(id_col, seed)
    plain = (text == "") | (h3 % 100 >= percent)
    for m in marks:
        plain = plain | F.contains(text, F.lit(m))
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    df = docs.select(F.col(id_col).alias("id"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    kept = ["id", "form"]
    numbers = [T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")]
    schema = T.StructType([df.schema["id"], T.StructField("form", T.StringType()), *numbers, T.StructField("output", T.StringType())])
    before, after, between = marks

    def run(batches):
        for batch in pieces(batches):
            n, first, second, out = [], [], [], []
            for t, f, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "form", "h1", "h2")), strict=True):
                units = count_units(t)
                n.append(units)
                if f == "plain":
                    first.append(None)
                    second.append(None)
                    out.append(t)
                    continue
                low, high = sorted((a % (units + 1), b % (units + 1)))
                i, j = cuts(t, low, high)
                first.append(i)
                second.append(j - i)
                if f == "psm":
                    out.append("".join((before, t[:i], after, t[j:], between, t[i:j])))
                else:
                    out.append("".join((after, t[j:], before, t[:i], between, t[i:j])))
            made = [pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "n", "prefix_chars", "middle_chars", "output"])

    done = df.mapInArrow(run, schema)
    return done.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. No mark overlaps itself or another, and a text that is
    rearranged holds none, so the marks found from the left are those that were put in."""
    part = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks), -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
r AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS r1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS r2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
       WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(r1, r2)], '') AS a, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS b, array_to_string(u[greatest(r1, r2) + 1:n], '') AS c FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
