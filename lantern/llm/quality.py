"""Quality rules with thresholds that adapt to each language and source.

Measures of every document go into quantile sketches, one for each language, source and measure.
A sketch is a histogram over integer buckets of bounded relative width (1/32), so two sketches
merge by adding counts, in any order and with the same result each time. Sketches of a language's
sources merge into the language's, and those into the corpus's. To each sketch `prior` documents
spread like those of the next wider one are added (a source's language, a language's corpus), so
that thresholds of a small group lean on the wider one and those of a large group are its own.

A document is rejected when a measure lies beyond its group's fence: `spread` times the distance
of the quartiles (or a least distance, where the quartiles nearly meet) beyond the outer quartile.
The sketches become a table of thresholds, and the filter is a join with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.llm import arrow, shared

#: Characters that count as symbols (fixed by the contract of the operator).
SYMBOLS = "#*$%&|<>"

#: Each measure: its column, the side that is bad, and the least quartile distance that counts.
#: Ratios are in parts of 10,000; `word_length` is in hundredths of a character.
MEASURES = {
    "symbols": ("high", 100),
    "capitals": ("high", 500),
    "dup_lines": ("high", 1000),
    "repeats": ("high", 1000),
    "word_length": ("both", 50),
}

#: A document's weight in a sketch that leans on a wider one: shares of a document are whole numbers.
SCALE = 1000

_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


@dataclass(frozen=True)
class Rules:
    spread: float = 3.0
    prior: int = 50  # documents of the wider group that are added to a group's own
    min_words: int = 50  # base rule
    max_repeat_percent: int = 50  # base rule


def text_counts(text: str | None) -> dict:
    """The counts of one text; a null text has no words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # on exactly the six ASCII white-space characters
    lines = [line for line in data.split(b"\n") if line.strip()]
    n = len(words)
    repeated = 0
    if n > 3:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        if len(numbers) < n:
            repeated = _repeated_words(ids, len(numbers))
    return {
        "n_words": n,
        "word_chars": len(text) - sum(text.count(c) for c in shared.SPACES),
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "n_lines": len(lines),
        "n_capitals": sum(1 for w in text.split() if len(w) > 1 and w.isupper()),
    }


def _repeated_words(ids: np.ndarray, vocabulary: int) -> int:
    """How many words lie in a window of three that occurs twice or more."""
    pairs = ids[:-2] * vocabulary + ids[1:-1]
    _, pair = np.unique(pairs, return_inverse=True)
    _, window, seen = np.unique(pair * vocabulary + ids[2:], return_inverse=True, return_counts=True)
    twice = seen[window] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= twice
    return int(covered.sum())


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` and the counts of its text."""
    return arrow.extend(docs, keep, "text", text_counts, _COUNTS)


def _measures() -> dict[str, Column]:
    part = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 10_000 / F.col(b))).otherwise(0).cast("long")
    return {
        "symbols": part("n_symbols", "word_chars"),
        "capitals": part("n_capitals", "n_words"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"),
        "word_length": F.when(F.col("n_words") > 0, F.floor(F.col("word_chars") * 100 / F.col("n_words"))).otherwise(0).cast("long"),
    }


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def bucket(value: Column) -> Column:
    """Lower end of the value's bucket: values keep their six leading binary digits."""
    width = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - 6, F.lit(0))).cast("long")
    return value - value % width


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketches of all groups, built where the rows are."""
    measures = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in _measures().items()]))
    rows = counts.select("lang", "source", measures.alias("m")).select("lang", "source", "m.measure", bucket(F.col("m.value")).alias("bucket"))
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _leaning(own: DataFrame, keys: list[str], wider: DataFrame, wider_keys: list[str], rules: Rules) -> DataFrame:
    """`own` (keys, measure, bucket, w) and `prior` documents of `wider` (wider_keys, measure, bucket, w) for each group."""
    of = lambda names: Window.partitionBy(*names, "measure")
    share = F.floor(F.lit(rules.prior * SCALE) * F.col("w") / F.sum("w").over(of(wider_keys))).cast("long")
    wider = wider.select(*[F.col(k).alias(f"_{k}") for k in wider_keys], F.col("measure").alias("_measure"), "bucket", share.alias("w"))
    same = F.col("measure") == F.col("_measure")
    for k in wider_keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    lent = own.select(*keys, "measure").distinct().join(wider, same).select(*keys, "measure", "bucket", "w")
    return own.unionByName(lent).groupBy(*keys, "measure", "bucket").agg(F.sum("w").alias("w"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, q1, q3) of sketches (keys, measure, bucket, w); at most some hundred buckets a window."""
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("_upto", F.sum("w").over(upto)).withColumn("_all", F.sum("w").over(group))
    at = lambda percent: F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * percent, F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(at(25).alias("q1"), at(75).alias("q3"))


def thresholds(counts: DataFrame, rules: Rules) -> DataFrame:
    """One row for each language and source of `counts`: `low_<measure>` and `high_<measure>`."""
    sketch = shared.staged(sketches(counts), "quality-sketches")
    merged = lambda *keys: sketch.groupBy(*keys, "measure", "bucket").agg((F.sum("n") * SCALE).alias("w"))
    by_lang = _leaning(merged("lang"), ["lang"], merged(), [], rules)
    own = quartiles(_leaning(merged("lang", "source"), ["lang", "source"], by_lang, ["lang"], rules), ["lang", "source"])
    least = F.create_map(*[F.lit(x) for k, (_, d) in MEASURES.items() for x in (k, d)])
    reach = F.lit(rules.spread) * F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")])
    fences = own.select("lang", "source", "measure", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    columns = [F.max(F.when(F.col("measure") == k, F.col(end))).alias(f"{end}_{k}") for k in MEASURES for end in ("low", "high")]
    return fences.groupBy("lang", "source").agg(*columns)


def verdict(counts: DataFrame, fences: DataFrame, rules: Rules) -> DataFrame:
    """Join `counts` (with any further columns) with the thresholds and add base_failed and kept."""
    limits = fences.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counts.join(shared.small(limits), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    outlier = F.lit(False)
    for name, value in _measures().items():
        outlier = outlier | F.coalesce(value > F.col(f"high_{name}"), F.lit(False))
        if MEASURES[name][0] == "both":
            outlier = outlier | F.coalesce(value < F.col(f"low_{name}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed(rules)).withColumn("kept", ~F.col("base_failed") & ~outlier).drop("_lang", "_source", *[c for c in limits.columns if c not in ("_lang", "_source")])


def judge_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Counts and verdict of every row of `docs` (doc_id, lang, source, text; others are ignored).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    lang, source. A null text has no words and fails the base rules. Null languages and sources are
    groups of their own. Repeated rows are judged one by one. An empty table gives an empty result.
    """
    counts = shared.staged(counted(docs, ["doc_id", "lang", "source"]), "quality-counts")
    fences = shared.staged(thresholds(counts, rules), "quality-thresholds")
    return verdict(counts, fences, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` (lang, source, text and any others) that the rules keep, with all their columns.

    Texts are read twice, once for the thresholds and once for the filter, and never shuffled as
    long as the table of thresholds is small. Null and empty texts go, since they fail the base
    rules; repeated rows are judged one by one; an empty table stays empty. Further columns are
    carried along, whatever their names.
    """
    narrow = shared.staged(counted(docs.select("lang", "source", "text"), ["lang", "source"]), "quality-counts")
    fences = shared.staged(thresholds(narrow, rules), "quality-thresholds")
    held = shared.packed(docs).select("_row", "_row.lang", "_row.source", "_row.text")
    return verdict(counted(held, ["_row", "lang", "source"]), fences, rules).filter("kept").select("_row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(shared.table(spark, sf_dir, "documents"))
