"""Contracts of the tables: fixed columns, checked by name and type."""

from __future__ import annotations

from pyspark.sql import DataFrame

RAW_ENVELOPE = "source_type string, source_external_key string, source_job_id string, source_url string, fetched_at timestamp, payload variant"
CANDIDATE = (
    "title_original string, company_name string, description_text string, description_html string, locations_raw array<string>, "
    "employment_type string, posted_at timestamp, expires_at timestamp, apply_url string, source_job_id string, source_type string, "
    "source_external_key string"
)
CANDIDATE_COLUMNS = tuple(f.split()[0] for f in CANDIDATE.split(", "))
ENVELOPE_COLUMNS = tuple(f.split()[0] for f in RAW_ENVELOPE.split(", "))


def assert_contract(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the contract's columns, in its order; anything missing, unknown or of another type is an error."""
    want = dict(f.rsplit(" ", 1) for f in ddl.split(", "))
    have = dict(df.dtypes)
    missing, unknown = set(want) - set(have), set(have) - set(want)
    wrong = {c: (have[c], want[c]) for c in set(want) & set(have) if have[c] != want[c]}
    if missing or unknown or wrong:
        raise ValueError(f"missing {sorted(missing)}, unknown {sorted(unknown)}, other types {wrong}")
    return df.select(*want)
