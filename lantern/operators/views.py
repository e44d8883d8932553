"""Picture views: filters over enriched items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import text as T
from lantern.functions import verdict
from lantern.plans import taxonomy


def title_case(value: Column) -> Column:
    """Trimmed, each word capitalised, '' for null; tags compare in this form."""
    return F.initcap(F.lower(F.trim(F.coalesce(value, F.lit("")))))


def ccir_of(value: Column) -> Column:
    return F.upper(F.trim(F.coalesce(value, F.lit(""))))


def kept(items: DataFrame) -> DataFrame:
    """Items with a requirement."""
    return items.filter(~verdict.is_none(F.col("ccir")))


def cop(items: DataFrame) -> DataFrame:
    """Common operational picture: own requirements in three domains."""
    return items.filter(ccir_of(F.col("ccir")).isin(*taxonomy.COP_IDS) & title_case(F.col("pmesii")).isin(*taxonomy.COP_DOMAINS))


def cip(items: DataFrame) -> DataFrame:
    """Common intelligence picture: priority requirements with a threat actor in three domains."""
    threat = ~F.lower(title_case(F.col("tessoc"))).isin("", "none")
    return items.filter(threat & ccir_of(F.col("ccir")).startswith("PIR-") & title_case(F.col("pmesii")).isin(*taxonomy.CIP_DOMAINS))


def _min_score(params: dict[str, str]) -> list[Column]:
    try:
        return [F.coalesce(F.col("score"), F.lit(0)) >= int(params["min_score"])] if "min_score" in params else []
    except (TypeError, ValueError):
        return []


def crp(items: DataFrame, params: dict[str, str] | None) -> DataFrame:
    """User-chosen picture: all of the given comma lists (ccir, pmesii, tessoc) and the least score.

    No parameters keep everything; a least score that is no number is ignored.
    """
    params = params or {}
    wanted = lambda name, f: [f(v.strip()) for v in params[name].split(",")]
    tests = _min_score(params)
    if "ccir" in params:
        tests.append(ccir_of(F.col("ccir")).isin(*wanted("ccir", str.upper)))
    for name in ("pmesii", "tessoc"):
        if name in params:
            tests.append(title_case(F.col(name)).isin(*wanted(name, str.title)))
    return items.filter(reduce(Column.__and__, tests)) if tests else items


def links(items: DataFrame, params: dict[str, str] | None = None, columns: tuple[str, ...] = ("title", "summary", "body")) -> DataFrame:
    """Items whose text holds a URL, whatever their requirement; a least score counts."""
    haystack = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    tests = [haystack.rlike(T.URL_PATTERN), *_min_score(params or {})]
    return items.filter(reduce(Column.__and__, tests))


def view(items: DataFrame, name: str | None, params: dict[str, str] | None = None) -> DataFrame:
    """Dispatch by name; no name keeps everything, an unknown one is an error."""
    if name is None:
        return items
    views = {"cop": cop, "cip": cip, "crp": lambda i: crp(i, params), "links": lambda i: links(i, params)}
    if name.lower() not in views:
        raise ValueError(f"unknown view: {name!r} (expected {', '.join(views)})")
    return views[name.lower()](items)


def strict(items: DataFrame) -> DataFrame:
    return items.filter(F.col("score") >= 8)


def routine(items: DataFrame) -> DataFrame:
    """Items without a requirement and tier; a null tier doesn't count."""
    return items.filter(verdict.is_none(F.col("ccir")) & F.lower("cnr").isin("none", ""))


def vault_keep(items: DataFrame, without_mail: bool = False) -> DataFrame:
    """Items for the vault: score 8 or a requirement, mail left out on demand."""
    rows = items.filter((F.coalesce(F.col("score"), F.lit(0)) >= 8) | ~verdict.is_none(F.col("ccir")))
    return rows.filter(~F.coalesce(F.col("url"), F.lit("")).rlike("^(imap|gmail|pop3)://")) if without_mail else rows


def needs_translation(items: DataFrame, column: str = "title", skip: tuple[str, ...] = ("en", "no", "und")) -> DataFrame:
    """Items whose text is there and in a language that isn't read as it is."""
    return items.filter((F.trim(F.coalesce(F.col(column), F.lit(""))) != "") & ~F.lower(F.coalesce(F.col("lang"), F.lit("und"))).isin(*skip))
