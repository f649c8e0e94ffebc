"""Typed facts from posting text, and grounding of facts that a model proposed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .geo import any_of, infer_work_mode
from .text import _col, blank_to_null, let, plain_items, plain_text, text_map


def parse_salary(text: Column | str) -> Column:
    """struct(salary_min, salary_max, salary_currency, salary_period) of the first kind of amount found, or null.

    An amount that is no number (commas alone) is null instead of an error.
    """
    c = _col(text)
    group = lambda pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    lakhs = lambda s: F.rint(s.cast("double") * 100000).cast("long")
    rupees = lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("long")
    period = lambda s: F.when(F.lower(s).startswith("month"), "month").otherwise("year")

    def amount(low: Column, high: Column | None, per: Column) -> Column:
        if high is None:
            low, high = low, F.lit(None).cast("long")
        else:
            low, high = F.least(low, high), F.greatest(low, high)
        return F.struct(low.alias("salary_min"), high.alias("salary_max"), F.lit("INR").alias("salary_currency"), per.alias("salary_period"))

    year = F.lit("year")
    return (
        F.when(c.rlike(fixed.LPA_RANGE), amount(lakhs(group(fixed.LPA_RANGE, 1)), lakhs(group(fixed.LPA_RANGE, 2)), year))
        .when(c.rlike(fixed.LPA_SINGLE), amount(lakhs(group(fixed.LPA_SINGLE, 1)), None, year))
        .when(c.rlike(fixed.RUPEE_RANGE), amount(rupees(group(fixed.RUPEE_RANGE, 1)), rupees(group(fixed.RUPEE_RANGE, 2)), period(group(fixed.RUPEE_RANGE, 3))))
        .when(c.rlike(fixed.RUPEE_SINGLE), amount(rupees(group(fixed.RUPEE_SINGLE, 1)), None, period(group(fixed.RUPEE_SINGLE, 2))))
    )


def normalize_employment(c: Column | str) -> Column:
    value = _col(c)
    token = F.regexp_replace(F.lower(value), "[^a-z]", "")
    return F.when(value.isin(*fixed.EMPLOYMENT_TYPES), value).otherwise(text_map(fixed.EMPLOYMENT)[token])


def _string(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _strings(v: Column, path: str) -> Column:
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.slice(F.filter(F.transform(items, lambda x: _string(x, "$")), lambda s: s.isNotNull()), 1, 20)


def _number(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double"))


LISTS = ("skills", "responsibilities", "requirements", "nice_to_have", "benefits")


def coerce_facts(response: Column | str) -> Column:
    """A model's text as typed facts; null where it is no JSON object. Wrong types become null or are left out of lists."""
    body = F.trim(F.regexp_replace(F.trim(_col(response)), r"(?i)^```(?:json)?\s*|\s*```$", ""))
    return let(F.try_parse_json(body), _typed_facts)


def _typed_facts(v: Column) -> Column:
    allowed = lambda path, values: let(_string(v, path), lambda s: F.when(s.isin(*values), s))
    facts = F.struct(
        *[_string(v, f"$.{n}").alias(n) for n in ("summary", "role_category", "experience_label", "description_text")],
        allowed("$.work_mode", fixed.WORK_MODES).alias("work_mode"),
        allowed("$.employment_type", fixed.EMPLOYMENT_TYPES).alias("employment_type"),
        _number(v, "$.experience_min_years").alias("experience_min_years"),
        *[_strings(v, f"$.{n}").alias(n) for n in LISTS],
    )
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), facts)


def mentioned(skill: Column, source: Column | str) -> Column:
    """The skill's words stand in the text as a run of whole words."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    needle = squeeze(skill)
    return (needle != "") & F.contains(F.concat(F.lit(" "), squeeze(_col(source)), F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def ground_skills(skills: Column | str, source: Column | str, plain: bool = False) -> Column:
    """At most twenty skills, as plain text, that the text mentions; ``plain``: the skills are plain text already."""
    return F.slice(F.filter(_col(skills) if plain else plain_items(skills), lambda s: mentioned(s, source)), 1, 20)


def dropped_skills(skills: Column | str, source: Column | str, plain: bool = False) -> Column:
    return F.filter(_col(skills) if plain else plain_items(skills), lambda s: ~mentioned(s, source))


def _number_text(n: Column) -> Column:
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))


def number_in_text(n: Column, source: Column | str) -> Column:
    """The number is written with no digit next to it."""
    pattern = F.concat(F.lit(r"(?<!\d)"), F.replace(_number_text(n), F.lit("."), F.lit(r"\.")), F.lit(r"(?!\d)"))
    return F.rlike(_col(source), pattern)


def ground_experience(years: Column | str, label: Column | str, source: Column | str) -> Column:
    """struct(experience_min_years, experience_label): an unwritten number takes its label with it; the label is plain text."""
    years, label = _col(years), plain_text(label)
    unwritten = years.isNotNull() & ~number_in_text(years, source)
    numbers = F.regexp_extract_all(label, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    good = F.forall(numbers, lambda s: number_in_text(s.cast("double"), source))
    return F.struct(
        F.when(~unwritten, years).alias("experience_min_years"), F.when(~unwritten & good, label).alias("experience_label")
    )


def mode_is_written(mode: Column, source: Column | str) -> Column:
    low = F.lower(_col(source))
    return (
        F.when(mode == "hybrid", any_of(low, ("hybrid",)))
        .when(mode == "remote", any_of(low, ("remote", "work from home")))
        .when(mode == "onsite", any_of(low, fixed.ONSITE_WRITTEN))
        .otherwise(F.lit(False))
    )


def ground_mode(proposed: Column | str, current: Column | str, text: Column | str, city: Column | str, relevance: Column | str) -> Column:
    proposed = _col(proposed)
    return F.coalesce(infer_work_mode(current, text, city, relevance), F.when(mode_is_written(proposed, text), proposed))


def employment_is_written(kind: Column, source: Column | str) -> Column:
    low = F.lower(_col(source))
    out = F.lit(False)
    for name, phrases in fixed.EMPLOYMENT_WRITTEN.items():
        out = out | ((kind == name) & any_of(low, phrases))
    return F.coalesce(out, F.lit(False))


def ground_employment(proposed: Column | str, current: Column | str, text: Column | str) -> Column:
    proposed = _col(proposed)
    return F.coalesce(normalize_employment(current), F.when(employment_is_written(proposed, text), proposed))


def leftover_text(text: Column | str, *lists: Column | str) -> Column:
    """Prose that the lists do not cover: dropped where three quarters of its words occur in them."""
    cleaned = _col(text)
    blob = F.lower(F.concat_ws(" ", *[F.concat_ws(" ", _col(x)) for x in lists]))
    words = F.split(F.lower(F.trim(cleaned)), r"\s+")
    covered = F.size(F.filter(words, lambda w: F.contains(blob, w))) / F.size(words)
    return F.when(blob == "", cleaned).when(covered < 0.75, cleaned)


def lines(items: Column | str, limit: int = 500, most: int = 20, plain: bool = False) -> Column:
    """The first ``most`` items that have any text, as plain text, each cut at ``limit``."""
    return F.slice(F.transform(_col(items) if plain else plain_items(items), lambda s: F.substring(s, 1, limit)), 1, most)


def short(c: Column | str, limit: int) -> Column:
    return F.substring(blank_to_null(c), 1, limit)


def scrubbed(columns: dict[str, str], schema) -> dict[str, Column]:
    """Plain text for string fields and the strings of list fields, without those that have none; other fields as they are."""
    return {name: scrub(F.col(name), schema[name].dataType) for name in columns}


def scrub(c: Column, kind: T.DataType) -> Column:
    """A value without markup; the fields of a struct one by one."""
    if isinstance(kind, T.StringType):
        return plain_text(c)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return plain_items(c)
    if isinstance(kind, T.StructType):
        return F.struct(*[scrub(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return c


def experience_years(c: Column | str) -> Column:
    return _col(c).cast("decimal(6,2)")
