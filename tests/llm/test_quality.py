"""Quality rules: counts against plain Python, thresholds against sorted values, odd rows."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lantern.llm import quality


def plain_counts(text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x1c\xa0#é", max_size=60))
def test_counts(text):
    got = quality.text_counts(text)
    assert tuple(got[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_counts(text)


def words(rng, n, symbols=0.0):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(5)) + ("$$$" if rng.random() < symbols else "") for _ in range(n))


def test_thresholds_follow_the_group(spark):
    rng = random.Random(1)
    rows = [(i, "en", "prose", words(rng, 120)) for i in range(120)]
    rows += [(1000 + i, "en", "code", words(rng, 120, 0.5)) for i in range(120)]
    rows += [(2000, "en", "prose", words(rng, 120, 0.5)), (2001, "de", "prose", words(rng, 120)), (2002, None, None, words(rng, 120)), (2003, "en", "prose", None), (2004, "en", "prose", ""), (2005, "en", "prose", "x y z " * 60), (2006, "en", "prose", words(rng, 40_000)), (7, "en", "prose", words(rng, 120))]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, lang string, source string, text string, kept int")
    out = {r.doc_id: r for r in quality.judge_documents(frame).collect()}
    assert len(rows) == quality.judge_documents(frame).count()
    lost = {i for i, r in out.items() if not r.kept}
    assert {2000, 2003, 2004, 2005} <= lost and not lost & {2001, 2002, 2006} and len(lost) <= 8
    assert {i for i, r in out.items() if r.base_failed} == {2003, 2004, 2005}
    good = quality.keep_good(frame)
    assert good.columns == frame.columns and sorted(r.doc_id for r in good.collect()) == sorted(r[0] for r in rows if r[0] not in lost)
    assert quality.judge_documents(frame.limit(0)).count() == 0


def test_buckets_are_narrow_and_in_order(spark):
    values = [*range(3000), 10_000, 123_456, 2**40 + 12345]
    frame = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b"))
    rows = sorted((r.v, r.b) for r in frame.collect())
    assert all(b <= v <= b * 33 / 32 + 1 for v, b in rows) and [b for _, b in rows] == sorted(b for _, b in rows)


@pytest.mark.parametrize("n", [4, 101, 1000])
def test_sketches_give_quartiles(spark, n):
    rng = random.Random(n)
    values = sorted(rng.randrange(60) for _ in range(n))
    sketch = spark.createDataFrame([("m", v, values.count(v)) for v in set(values)], "measure string, bucket long, w long")
    row = quality.quartiles(sketch, []).first()
    assert (row.q1, row.q3) == (values[-(-n // 4) - 1], values[-(-3 * n // 4) - 1])


def judge(rows, rules=quality.Rules()):
    """Brute force for the query: (base_failed, kept) of each (doc_id, lang, source, text), sketches as plain counters."""

    def low(v):
        width = 1 << max(v.bit_length() - 6, 0)
        return v - v % width

    def measures(text):
        n_words, chars, symbols, dup, repeated = plain_counts(text)
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        capitals = sum(len(w) > 1 and w.isupper() for w in (text or "").split())
        part = lambda a, b: a * 10_000 // b if b else 0
        return {"symbols": part(symbols, chars), "capitals": part(capitals, n_words), "dup_lines": part(dup, len(lines)), "repeats": part(repeated, n_words), "word_length": chars * 100 // n_words if n_words else 0}, n_words, repeated

    def sketch(told, m):
        out = {}
        for values in told:
            out[low(values[m])] = out.get(low(values[m]), 0) + quality.SCALE
        return out

    def leaning(own, wider):
        out, total = dict(own), sum(wider.values())
        for b, w in wider.items():
            out[b] = out.get(b, 0) + rules.prior * quality.SCALE * w // total
        return out

    def quartile(told, percent):
        upto, total = 0, sum(told.values())
        for b in sorted(told):
            upto += told[b]
            if upto * 100 >= total * percent:
                return b

    told = {i: (lang, source, *measures(text)) for i, lang, source, text in rows}
    fences = {}
    for m, (_, least) in quality.MEASURES.items():
        every = sketch([t[2] for t in told.values()], m)
        for lang, source in {t[:2] for t in told.values()}:
            of_lang = leaning(sketch([t[2] for t in told.values() if t[0] == lang], m), every)
            own = leaning(sketch([t[2] for t in told.values() if t[:2] == (lang, source)], m), of_lang)
            q1, q3 = quartile(own, 25), quartile(own, 75)
            reach = rules.spread * max(q3 - q1, least)
            fences[lang, source, m] = q1 - reach, q3 + reach
    out = {}
    for i, (lang, source, values, n_words, repeated) in told.items():
        failed = n_words < 50 or 100 * repeated > 50 * n_words
        beyond = any(v > fences[lang, source, m][1] or quality.MEASURES[m][0] == "both" and v < fences[lang, source, m][0] for m, v in values.items())
        out[i] = failed, not failed and not beyond
    return out


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "text").collect()]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.op1_quality(spark, sf).collect()}
    assert got == judge(rows) and 0 < sum(k for _, k in got.values()) < len(rows)


def test_labels_of_the_table(spark):
    """Junk that is labelled is rejected, good text is kept."""
    sf = "/root/testdata/sf0.01"
    judged = quality.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    shares = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[0] <= 0.02 and shares[1] >= 0.98
