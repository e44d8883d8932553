"""The registry of information requirements: a small fixed dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Requirement:
    id: str
    title: str
    cop: bool  # part of the common operational picture
    active: bool = True


# Fixed values, in the order in which reports show them.
REQUIREMENTS = (
    Requirement("PIR-1", "Russland / Ukraina", False),
    Requirement("PIR-2", "Nordområdene & Arktis", False),
    Requirement("PIR-3", "NATO & europeisk sikkerhet", True),
    Requirement("PIR-4", "Hybrid- & cybertrusler", False),
    Requirement("PIR-5", "Stormaktsrivalisering", False),
    Requirement("PIR-6", "OSINT & etterforskning", False),
    Requirement("SIR-1", "Midtøsten & US-Iran", False),
    Requirement("SIR-2", "Sport — VM 2026 (FIFA)", True, active=False),
    Requirement("SIR-3", "NATO-toppmøtet i Ankara", True, active=False),
    Requirement("FFIR-1", "Norsk forsvar & sikkerhetspolitikk", True),
    Requirement("FFIR-2", "Norsk politikk & samfunn", True),
    Requirement("FFIR-3", "Egen teknologikapabilitet", True),
    Requirement("FFIR-4", "Frontier AI & LLM-landskap", True),
)
ACTIVE = tuple(r for r in REQUIREMENTS if r.active)
ACTIVE_IDS = tuple(r.id for r in ACTIVE)
COP_IDS = tuple(r.id for r in ACTIVE if r.cop)
COP_DOMAINS = ("Political", "Military", "Infrastructure")
CIP_DOMAINS = ("Information", "Military", "Economic")


def requirement(id: str) -> Requirement:
    for r in REQUIREMENTS:
        if r.id == id:
            return r
    raise KeyError(id)


def kind(id: str) -> str:
    """`pir`, `sir` or `ffir`."""
    return id.partition("-")[0].lower()


def title(id: str | None) -> str:
    """What reports show for an id; unknown ids stand for themselves."""
    return next((r.title for r in REQUIREMENTS if r.id == id), id or "")


def dimension(spark: SparkSession) -> DataFrame:
    """(ord, ccir, title, cop, kind) of the active requirements."""
    rows = [(i, r.id, r.title, r.cop, kind(r.id)) for i, r in enumerate(ACTIVE)]
    return spark.createDataFrame(rows, "ord int, ccir string, title string, cop boolean, kind string")


def quick_reference() -> str:
    """One line for each active requirement, as prompts carry it."""
    return "\n".join(f"{r.id} {r.title}" for r in ACTIVE)


def id_enum() -> str:
    """The values a model may give for a requirement."""
    return "|".join((*ACTIVE_IDS, "none"))


def active_examples(examples: DataFrame) -> DataFrame:
    """The examples (ids: array) whose ids are all active."""
    return examples.filter(F.forall("ids", lambda i: i.isin(*ACTIVE_IDS)))
