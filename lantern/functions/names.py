"""Entity names: canonical keys and noise."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that are chrome of mails and platforms.
NOISE_NAMES = ("github", "github actions", "black", "medium")
DOMAIN_PATTERN = r"^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$"


def normalize_name(name: Column) -> Column:
    """The key of a name: lower case, no punctuation, no trailing run of `'` and `s`, single spaces.

    A single word of plain letters is its own key, which spares most names all but one look.
    """
    out = F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w\s'-]+", "")
    out = F.regexp_replace(out, "['s]+$", "")
    return F.when(name.rlike("^[a-z0-9]*[a-rt-z0-9]$"), name).otherwise(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")))


def is_noise(name: Column, own_names: Iterable[str] = ()) -> Column:
    """Whether a name is a bare domain or on the list of noise; `own_names` extend the list."""
    listed = [normalize_name(F.lit(n)) for n in (*NOISE_NAMES, *own_names)]
    return F.lower(F.trim(name)).rlike(DOMAIN_PATTERN) | normalize_name(name).isin(*listed)
