"""Fill-in-middle samples: a text cut in three, with its middle moved to the end behind markers.

Cuts are counted in units (code points, or pieces of words, numbers and white space). A text is
stored as the maximal runs of one character class: characters that take equally many bytes and, where
units are longer than one character, are of one kind. Each run has its first byte, the number of
units before it, and the bytes of a unit. The byte at which a cut falls is then arithmetic: a binary
search over the units finds the run, and the units left of the cut inside it times their bytes
give the rest. Texts stay bytes throughout and are never taken apart into characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import arrow, shared

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that are encoded at a time.
_SEGMENT = 1 << 20
_LETTER, _DIGIT, _SPACE, _OTHER = range(4)


@dataclass(frozen=True)
class Units:
    """Characters of each kind that make a unit; the last unit of a run may be shorter, and 0 takes the whole run.

    The default is a unit for each code point. Bytes beyond ASCII count as letters.
    """

    letters: int = 1
    digits: int = 1
    spaces: int = 1
    others: int = 1

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By leading byte: the kind (0 where units are single characters, which need none) and the characters of a unit."""
        kinds = np.full(256, _OTHER, np.int64)
        kinds[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
        kinds[48:58] = _DIGIT
        kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
        steps = np.array([self.letters, self.digits, self.spaces, self.others])[kinds]
        return np.where(steps == 1, 0, kinds + 1), steps


CODE_POINTS = Units()
#: As tokenisers cut before they merge: words and white space whole, digits by three.
PIECES = Units(letters=0, digits=3, spaces=0, others=1)


@dataclass(frozen=True)
class Runs:
    """Maximal runs of a character class: first byte, units before the run, bytes of a unit."""

    starts: np.ndarray
    before: np.ndarray
    widths: np.ndarray
    n: int
    n_bytes: int

    def offset(self, cut: int) -> int:
        """The byte after the first `cut` units."""
        if cut >= self.n:
            return self.n_bytes
        run = int(np.searchsorted(self.before, cut, side="right")) - 1
        return int(self.starts[run] + (cut - self.before[run]) * self.widths[run])


def encode(data: bytes, units: Units = CODE_POINTS) -> Runs:
    """The class runs of UTF-8 bytes. A character is a leading byte with all continuation bytes after it."""
    kind_of, step_of = units.tables()
    starts, classes, leads = [], [], []
    begin = 0
    while begin < len(data):
        end = min(begin + _SEGMENT, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        part = np.frombuffer(data, np.uint8, end - begin, begin)
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        if not len(lead) or lead[0]:
            lead = np.insert(lead, 0, 0)  # a stray continuation byte at the front
        wide = np.diff(lead, append=len(part))
        byte = part[lead]
        code = wide * 8 + kind_of[byte]
        change = np.flatnonzero(code[1:] != code[:-1]) + 1
        change = np.insert(change, 0, 0)
        if classes and classes[-1][-1] == code[0]:
            change = change[1:]  # the run goes on over the border of segments
        starts.append(lead[change] + begin)
        classes.append(code[change] if len(change) else classes[-1][-1:])
        leads.append(step_of[byte[change]])
        begin = end
    if not starts:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, 0, 0)
    first, steps = np.concatenate(starts), np.concatenate(leads)
    wide = np.concatenate([c[: len(s)] for c, s in zip(classes, starts)]) // 8
    lengths = np.diff(first, append=len(data))
    widths = np.where(steps == 0, lengths, steps * wide)
    counts = -(-lengths // widths)
    before = np.cumsum(counts) - counts
    return Runs(first, before, widths, int(counts.sum()), len(data))


@dataclass(frozen=True)
class Rule:
    """Shares of the forms in hundredths, a salt for the draws, and the units of the cuts."""

    salt: str = "1:"
    transformed: int = 90
    suffix_first: int = 20
    units: Units = CODE_POINTS


def _draws(salt: str, key: object) -> list[int]:
    digest = hashlib.sha256(f"{salt}{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def sample(key: object, data: bytes, rule: Rule = Rule()) -> dict:
    """n, form, prefix_chars, middle_chars (units; null if plain) and output of one text."""
    runs = encode(data, rule.units)
    h1, h2, h3, h4 = _draws(rule.salt, key)
    marked = any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE))
    if not data or marked or h3 % 100 >= rule.transformed:
        return {"n": runs.n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": data}
    a, b = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
    left, right = runs.offset(a), runs.offset(b)
    prefix, middle, suffix = data[:left], data[left:right], data[right:]
    if h4 % 100 < rule.suffix_first:
        form, output = "spm", b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle))
    else:
        form, output = "psm", b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle))
    return {"n": runs.n, "form": form, "prefix_chars": a, "middle_chars": b - a, "output": output}


def fill_in_middle(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of `docs` (doc_id, text; other columns are ignored).

    A null text is empty; an empty text, and one that holds a marker, is plain. Draws depend on
    doc_id alone, so repeated rows come out alike; a null doc_id draws as an empty one. Rows stay where
    they lie: no shuffle. An empty table gives an empty result.
    """

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            yield {"doc_id": row["doc_id"], **sample(row["key"], row["data"], rule)}

    source = docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    ddl = arrow.schema(docs.schema["doc_id"], "n long, form string, prefix_chars long, middle_chars long, output binary")
    return arrow.map_rows(source, run, ddl, rows=64).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from; by its markers alone."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, 4, 2**31 - 1)
        one = F.substring_index(body, first, 1)
        rest = F.substring(body, F.length(one) + 4, F.lit(2**31 - 1))
        two = F.substring_index(rest, second, 1)
        return one, two, F.substring(rest, F.length(two) + 4, F.lit(2**31 - 1))

    prefix, suffix, middle = parts(SUFFIX, MIDDLE)
    later, earlier, between = parts(PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(earlier, between, later)).otherwise(output)


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(shared.table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def oracle(rule: Rule = Rule()) -> str:
    """DuckDB SQL for `op11_middle`, with its own cutting by code points."""
    draw = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{rule.salt}' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), c AS (
  SELECT *, least({draw(0)} % (n + 1), {draw(1)} % (n + 1)) AS a, greatest({draw(0)} % (n + 1), {draw(1)} % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {draw(2)} % 100 >= {rule.transformed} THEN 'plain'
      WHEN {draw(3)} % 100 < {rule.suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
