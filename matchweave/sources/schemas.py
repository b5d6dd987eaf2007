"""Source tables of a linked health-record study, with the types fixed at load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

DEATHS = "person long, death_date date, death_date_valid string, sex int, organisation string, age int"
DIAGNOSES = "provider string, spell long, episode int, diag_num int, code string"
EPISODES = (
    "provider string, spell long, episode int, start_date date, end_date date, age int, "
    "diag_codes string, operation string"
)
SPELLS = (
    "provider string, spell long, person long, sex string, residence string, admit_date date, "
    "admit_method string, discharge_date date, discharge_method string, "
    "discharge_destination string, admit_specialty string, discharge_specialty string"
)
PERSONS = "person long, register_id long, birth_date date, death_date date, sex int"
ADDRESSES = "person long, start_date date, end_date date, quintile int"
REGISTRATIONS = "person long, start_date date, end_date date"
GP_EVENTS = (
    "person long, practice long, local_num long, sex int, birth_date date, category string, "
    "event_date date, code_version string, code string, value double, episode string, sequence int"
)
GP_PATIENTS = "person long, practice long, local_num long, opt_out string"
CODES = "code string, description string"

SCHEMAS: dict[str, str] = {
    "deaths": DEATHS,
    "diagnoses": DIAGNOSES,
    "episodes": EPISODES,
    "spells": SPELLS,
    "persons": PERSONS,
    "addresses": ADDRESSES,
    "registrations": REGISTRATIONS,
    "gp_events": GP_EVENTS,
    "gp_patients": GP_PATIENTS,
    "event_codes": CODES,
    "diagnosis_codes": CODES,
}


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def columns_of(name: str) -> list[str]:
    return schema_of(name).fieldNames()


def missing_columns(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Table -> expected columns it lacks (a table that is absent lacks them all)."""
    lacking = {}
    for name in SCHEMAS:
        present = tables[name].columns if name in tables else []
        absent = [c for c in columns_of(name) if c not in present]
        if absent:
            lacking[name] = absent
    return lacking
