"""Source-shaped payloads to one source-neutral candidate; rows that cannot be normalised carry an error instead."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import collapse_ws, html_to_text, parse_epoch, parse_iso_ts, unescape
from tidewell.schemas import CANDIDATE_COLUMNS

from .envelopes import text_at, trimmed_at

P = "payload"
KEYS = ("source_job_id", "source_type", "source_external_key")


def _list(path: str, v: str | Column = P) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _present(a: Column) -> Column:
    return F.filter(a, lambda s: s.isNotNull() & (s != ""))


def _one(c: Column) -> Column:
    return F.filter(F.array(c), lambda s: s.isNotNull() & (s != ""))


def _place(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


@dataclass
class Fields:
    """Where a source type keeps the candidate's fields: Columns over the payload, and what to call those that must be there.

    ``encoded`` is HTML whose entities are to be decoded, ``html`` such that is not; ``plain`` is the text where the source gives it.
    """

    title: Column
    locations: Column
    posted: Column
    apply: Column
    company: Column | None = None
    from_source: bool = True
    encoded: Column | None = None
    html: Column | None = None
    plain: Column | None = None
    employment: Column | None = None
    expires: Column | None = None
    labels: tuple[str, str] = ("title", "company_name")


def greenhouse() -> Fields:
    places = _present(F.transform(F.split(text_at(P, "$.location.name"), ";"), lambda s: F.trim(s)))
    return Fields(
        title=trimmed_at(P, "$.title"), company=trimmed_at(P, "$.company_name"), from_source=False, encoded=text_at(P, "$.content"),
        locations=F.coalesce(places, F.array().cast("array<string>")), apply=F.col("source_url"),
        posted=F.coalesce(parse_iso_ts(text_at(P, "$.first_published")), parse_iso_ts(text_at(P, "$.updated_at"))),
    )


def lever() -> Fields:
    every = _present(F.transform(_list("$.categories.allLocations"), lambda x: F.trim(text_at(x, "$"))))
    main = trimmed_at(P, "$.categories.location")
    kind = F.schema_of_variant(F.try_variant_get(P, "$.createdAt", "variant"))
    created = F.when(kind == "STRING", parse_iso_ts(text_at(P, "$.createdAt"))).when(
        kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), parse_epoch(F.try_variant_get(P, "$.createdAt", "double"))
    )
    return Fields(
        title=trimmed_at(P, "$.text"), encoded=text_at(P, "$.description"), plain=collapse_ws(text_at(P, "$.descriptionPlain")),
        locations=F.when(main.isNull() | F.array_contains(every, main), every).otherwise(F.concat(F.array(main), every)),
        employment=trimmed_at(P, "$.categories.commitment"), posted=created, apply=F.coalesce(text_at(P, "$.applyUrl"), F.col("source_url")), labels=("text", "company_name"),
    )


def ashby() -> Fields:
    others = F.transform(_list("$.secondaryLocations"), lambda x: F.trim(F.coalesce(text_at(x, "$"), text_at(x, "$.location"))))
    return Fields(
        title=trimmed_at(P, "$.title"), encoded=text_at(P, "$.descriptionHtml"), plain=collapse_ws(text_at(P, "$.descriptionPlain")),
        locations=F.array_distinct(F.concat(_one(trimmed_at(P, "$.location")), _present(others))), employment=trimmed_at(P, "$.employmentType"),
        posted=parse_iso_ts(text_at(P, "$.publishedAt")), apply=F.coalesce(text_at(P, "$.applyUrl"), F.col("source_url")),
    )


def workable() -> Fields:
    place = lambda x: _place(trimmed_at(x, "$.city"), F.coalesce(trimmed_at(x, "$.region"), trimmed_at(x, "$.state")), trimmed_at(x, "$.country"))
    listed = F.array_distinct(_present(F.transform(_list("$.locations"), place)))
    flat = _one(_place(*[trimmed_at(P, f"$.{c}") for c in ("city", "state", "country")]))
    return Fields(
        title=trimmed_at(P, "$.title"), encoded=F.when(trimmed_at(P, "$.description").isNotNull(), text_at(P, "$.description")),
        locations=F.when(F.size(listed) > 0, listed).otherwise(flat), employment=trimmed_at(P, "$.employment_type"),
        posted=parse_iso_ts(F.coalesce(trimmed_at(P, "$.published_on"), trimmed_at(P, "$.created_at"))),
        apply=F.coalesce(text_at(P, "$.application_url"), F.col("source_url")),
    )


def _name(v: Column | str, path: str) -> Column:
    """A string, or an object's name."""
    return F.coalesce(trimmed_at(v, path), trimmed_at(v, f"{path}.name"))


def _ld_places(path: str) -> Column:
    """The places of a value, or of a list of values; lists may lie in lists, down to the fourth."""
    items = F.filter(F.array(F.try_variant_get(P, path, "variant")), lambda x: x.isNotNull())
    for _ in range(4):
        items = F.flatten(F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))))
    address = lambda x: _place(*[_name(x, f"$.address.{c}") for c in ("addressLocality", "addressRegion", "addressCountry")])
    has_address = lambda x: F.schema_of_variant(F.try_variant_get(x, "$.address", "variant")).startswith("OBJECT")
    return F.transform(items, lambda x: F.coalesce(trimmed_at(x, "$"), F.when(has_address(x), address(x)).otherwise(trimmed_at(x, "$.name"))))


def jsonld() -> Fields:
    text = trimmed_at(P, "$.description")
    html = F.when(F.contains(text, F.lit("<")), text)
    kinds = _present(F.transform(_list("$.employmentType"), lambda x: trimmed_at(x, "$")))
    return Fields(
        title=trimmed_at(P, "$.title"), company=_name(P, "$.hiringOrganization"), html=html, plain=F.when(html.isNull(), text),
        locations=F.array_distinct(_present(F.concat(_ld_places("$.jobLocation"), _ld_places("$.applicantLocationRequirements")))),
        employment=F.coalesce(trimmed_at(P, "$.employmentType"), F.nullif(F.array_join(kinds, ", "), F.lit(""))),
        posted=parse_iso_ts(text_at(P, "$.datePosted")), expires=parse_iso_ts(text_at(P, "$.validThrough")), apply=trimmed_at(P, "$.url"), labels=("title", "hiringOrganization"),
    )


#: The connector surface: a source type's fields. Add an entry to support another source.
REGISTRY: dict[str, Callable[[], Fields]] = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "workable": workable, "generic-jsonld": jsonld}


def dispatch_by_type(envelopes: DataFrame, sources: DataFrame | None, registry: dict[str, Callable[[], Fields]] | None = None) -> DataFrame:
    """Every envelope by its type's fields, in one pass: the twelve columns and ``error`` (null where nothing needed is missing).

    Boards whose postings do not name the company take it from the source table, joined once. An unknown type is an error row.
    """
    made = {kind: f() for kind, f in (registry or REGISTRY).items()}
    kind = F.col("source_type")
    rows = envelopes
    if sources is not None:
        names = sources.select("source_type", "source_external_key", F.nullif(F.trim("company_name"), F.lit("")).alias("_company"))
        rows = rows.join(names, ["source_type", "source_external_key"], "left")
    else:
        rows = rows.withColumn("_company", F.lit(None).cast("string"))

    def pick(get, type_: str) -> Column:
        """The field of the row's own type."""
        out = F.when(F.lit(False), F.lit(None).cast(type_))
        for k, f in made.items():
            if get(f) is not None:
                out = out.when(kind == k, get(f))
        return out

    company = lambda f: f.company if not f.from_source else F.col("_company") if f.company is None else F.coalesce(f.company, F.col("_company"))
    kept = [c for c in ("source_id", "fetched_at", "requisition_id") if c in envelopes.columns]
    rows = rows.select(
        *KEYS, *kept, pick(lambda f: f.title, "string").alias("title_original"), pick(company, "string").alias("company_name"),
        pick(lambda f: f.encoded, "string").alias("_encoded"), pick(lambda f: f.html, "string").alias("_html"), pick(lambda f: f.plain, "string").alias("_plain"),
        pick(lambda f: f.locations, "array<string>").alias("locations_raw"), pick(lambda f: f.employment, "string").alias("employment_type"),
        pick(lambda f: f.posted, "timestamp").alias("posted_at"), pick(lambda f: f.expires, "timestamp").alias("expires_at"), pick(lambda f: f.apply, "string").alias("apply_url"),
        pick(lambda f: F.lit(f.labels[0]), "string").alias("_title_label"), pick(lambda f: F.lit(f.labels[1]), "string").alias("_company_label"),
    )
    rows = rows.withColumn("description_html", F.coalesce(unescape("_encoded"), "_html"))
    # where the source gives the text, none is made of the HTML
    rows = rows.withColumn("description_text", F.coalesce("_plain", html_to_text(F.when(F.col("_plain").isNull(), F.col("description_html")))))
    missing = lambda c, label: F.when(F.col(c).isNull(), F.concat(F.lit("missing "), label))
    problem = F.coalesce(F.when(F.col("_title_label").isNull(), "no connector"), missing("title_original", "_title_label"), missing("company_name", "_company_label"))
    return rows.select(*CANDIDATE_COLUMNS, *kept, problem.alias("error"))


def _of(kind: str, rows: DataFrame, sources: DataFrame | None) -> DataFrame:
    return dispatch_by_type(rows.withColumn("source_type", F.lit(kind)), sources)


def normalize_greenhouse(rows: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    return _of("greenhouse", rows, sources)


def normalize_lever(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return _of("lever", rows, sources)


def normalize_ashby(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return _of("ashby", rows, sources)


def normalize_workable(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return _of("workable", rows, sources)


def normalize_jsonld(rows: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    return _of("generic-jsonld", rows, sources)


def normalize_with_quarantine(envelopes: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, errors): the second has the key columns, status ``error`` and the message."""
    rows = dispatch_by_type(envelopes, sources)
    bad = rows.where("error is not null").select(*KEYS, F.lit("error").alias("processing_status"), F.col("error").alias("processing_error"))
    return rows.where("error is null").drop("error"), bad
