"""Verdicts: salvage of a model's answer, derived fields, display classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNREADABLE = "uleselig modell-svar"  # fixed value: the reason of a verdict that could not be read


def clamp_score(value: Column) -> Column:
    """An integer from 0 to 10; anything else is 0."""
    number = F.coalesce(value.try_cast("int"), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(10), number))


def is_none(value: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(value, F.lit("")), F.lit("none"))) == "none"


def bucket(ccir: Column, cnr: Column, score: Column) -> Column:
    """skip without a requirement; read for the first tier or from 7 on; else maybe."""
    urgent = F.coalesce(cnr == "I", F.lit(False)) | (F.coalesce(score, F.lit(0)) >= 7)
    return F.when(is_none(ccir), "skip").when(urgent, "read").otherwise("maybe")


def event_cnr(cnr: Column) -> Column:
    return F.when(cnr == "none", "Routine").otherwise(cnr)


def event_bucket(value: Column) -> Column:
    return F.when(value == "read", "keep").otherwise(value)


def stored_bucket(value: str) -> str:
    """The stored word for a bucket that is asked for in either vocabulary."""
    return "read" if value == "keep" else value


def salvage(raw: Column) -> Column:
    """Struct (ccir, cnr, pmesii, tessoc, score, why, bucket) from a model's answer.

    A code fence is opened, then the outermost braces are read as JSON. What can't be read gives
    the verdict `none` with a fixed reason. Without a requirement there are no tags either.
    """
    fenced = F.element_at(F.split(raw, "```"), 2)
    inner = F.when(raw.contains("```"), F.trim(F.regexp_replace(fenced, "^[json]+", ""))).otherwise(F.trim(raw))
    braces = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    # In an array, since the parser would overlook what follows a whole value.
    value = F.try_parse_json(F.when(braces != "", F.concat(F.lit("["), braces, F.lit("]"))))
    read = lambda name, kind="string": F.try_variant_get(value, f"$[0].{name}", kind)
    ok = value.isNotNull() & F.coalesce(F.schema_of_variant(value).startswith("ARRAY<OBJECT"), F.lit(False))
    ccir = F.when(ok, F.coalesce(read("ccir"), F.lit("none"))).otherwise("none")
    tag = lambda name: F.when(~ok | (F.lower(ccir) == "none"), "none").otherwise(F.coalesce(read(name), F.lit("none")))
    cnr = F.when(ok, F.coalesce(read("cnr"), F.lit("none"))).otherwise("none")
    score = F.when(ok, clamp_score(read("score"))).otherwise(0)
    why = F.when(ok, read("why")).otherwise(UNREADABLE)
    return F.struct(
        ccir.alias("ccir"), cnr.alias("cnr"), tag("pmesii").alias("pmesii"), tag("tessoc").alias("tessoc"),
        score.alias("score"), why.alias("why"), bucket(ccir, cnr, score).alias("bucket"),
    )


def entities(raw: Column) -> Column:
    """Array of (name, type) from a model's list of entities: fences and prose around it are dropped,
    names are distinct but for case (the first one stays), and unknown types become MISC."""
    braces = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    items = F.from_json(F.nullif(braces, F.lit("")), "array<struct<name:string,type:string>>", {"mode": "PERMISSIVE"})
    named = F.filter(F.coalesce(items, F.array().cast("array<struct<name:string,type:string>>")), lambda e: F.coalesce(F.trim(e["name"]), F.lit("")) != "")
    lower = F.transform(named, lambda e: F.lower(F.trim(e["name"])))
    first = F.filter(named, lambda e, i: F.array_position(lower, F.lower(F.trim(e["name"]))) == i + 1)
    kind = lambda e: F.when(e["type"].isin("PER", "ORG", "LOC", "GPE", "MISC"), e["type"]).otherwise("MISC")
    return F.transform(first, lambda e: F.struct(F.trim(e["name"]).alias("name"), kind(e).alias("type")))


def score_class(score: Column) -> Column:
    return F.when(score >= 8, "hot").when(score >= 6, "warm").otherwise("cool")


def bar_width(score: Column) -> Column:
    return F.least(F.lit(100), score * 10)


def tokens(text: Column) -> Column:
    """Rough number of a model's tokens in a text."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")
