"""Places and relevance as Columns: the cascade is one ``when`` chain over literal patterns, no UDF."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import _col, blank_to_null, let, normalize_location, text_map, with_aliases


def phrase_pattern(phrases) -> str:
    """Any of the phrases as whole words, longer ones first; without phrases a pattern that nothing fits."""
    if not phrases:
        return "(?!)"
    ordered = sorted(set(phrases), key=lambda p: (-len(p), p))
    return r"\b(?:" + "|".join(re.escape(p).replace(r"\ ", " ").replace(r"\-", "-") for p in ordered) + r")\b"


@dataclass(frozen=True)
class Places:
    """The names by which a place is known as one in India, in lower case, and older names of cities."""

    states: tuple[str, ...] = tuple(fixed.STATES)
    cities: tuple[str, ...] = tuple(fixed.CITIES)
    aliases: tuple[tuple[str, str], ...] = tuple(fixed.LOCATION_ALIASES.items())


PLACES = Places()
CITY, STATE = phrase_pattern(PLACES.cities), phrase_pattern(PLACES.states)
EXCLUDED, REMOTE_INDIA = phrase_pattern(fixed.INDIA_EXCLUSIONS), phrase_pattern(fixed.REMOTE_INDIA_PHRASES)
US_ONLY, REMOTE = phrase_pattern(fixed.US_ONLY_PHRASES), phrase_pattern(fixed.REMOTE_SIGNALS)
FOREIGN = phrase_pattern((*fixed.FOREIGN_COUNTRIES, *fixed.FOREIGN_CITIES, *fixed.US_STATES))


def phrase_match(c: Column | str, phrases) -> Column:
    return _col(c).rlike(phrase_pattern(phrases))


def normalize_country_code(c: Column | str) -> Column:
    code = F.upper(F.trim(_col(c)))
    code = F.coalesce(text_map(fixed.COUNTRY_CODES)[code], code)
    return F.when(code.rlike("^[A-Z]{2}$"), code)


def split_place(locations: Column | str) -> Column:
    """struct(city, state, country) of the first location only; a last part that names India is the country."""
    parts = F.filter(F.transform(F.split(F.get(_col(locations), 0), ","), lambda p: F.trim(p)), lambda p: p != "")
    home = F.lower(F.get(parts, F.size(parts) - 1)).isin("india", "in", "bharat")
    rest = F.when(home, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.struct(F.get(rest, 0).alias("city"), F.get(rest, 1).alias("state"), F.when(home, F.lit("IN")).alias("country"))


def classify_relevance(locations: Column | str, title: Column | str, description: Column | str, country: Column | str | None = None, strict_country: bool = False, places: Places = PLACES) -> Column:
    """One of five labels; the first rule that holds decides. ``strict_country`` leaves a bare country code IN aside; ``places`` may
    come from dimension files (``raw.places``)."""
    city, state, aliases = phrase_pattern(places.cities), phrase_pattern(places.states), dict(places.aliases)
    code = normalize_country_code(F.lit(None).cast("string") if country is None else country)
    home = F.lit(False) if strict_country else F.coalesce(code == "IN", F.lit(False))

    def by_text(loc: Column, text: Column, excluded: Column) -> Column:
        foreign = (code.isNotNull() & (code != "IN")) | loc.rlike(FOREIGN)
        return let(
            foreign,
            lambda far: F.when(loc.rlike(r"\bindia\b") & ~excluded, "india")
            .when(~far & ~excluded & loc.rlike(state), "india")
            .when(~excluded & text.rlike(REMOTE_INDIA), "remote_india")
            .when(excluded | far | text.rlike(US_ONLY), "not_india")
            .when(loc.rlike(REMOTE) | text.rlike(REMOTE), "unknown_remote")
            .otherwise("unknown"),
        )

    def by_place(loc: Column) -> Column:
        text = with_aliases(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (loc, _col(title), _col(description))]), aliases)
        return F.when(home | loc.rlike(city), "india").otherwise(let(text, lambda t: let(t.rlike(EXCLUDED), lambda excluded: by_text(loc, t, excluded))))

    return let(with_aliases(F.concat_ws(" ", _col(locations)), aliases), by_place)


def is_publishable(relevance: Column | str) -> Column:
    return _col(relevance).isin(*fixed.PUBLISHED)


def work_mode_from_location(locations: Column | str) -> Column:
    text = F.lower(F.concat_ws(" ", _col(locations)))
    return F.when(F.contains(text, F.lit("hybrid")), "hybrid").when(F.contains(text, F.lit("remote")), "remote")


def any_of(text: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def infer_work_mode(current: Column | str, text: Column | str, city: Column | str, relevance: Column | str) -> Column:
    low, rel = F.lower(F.coalesce(_col(text), F.lit(""))), _col(relevance)
    return (
        F.when(_col(current).isin(*fixed.WORK_MODES), _col(current))
        .when(any_of(low, ("hybrid",)), "hybrid")
        .when(any_of(low, ("remote", "work from home")) | (rel == "remote_india"), "remote")
        .when(any_of(low, fixed.ONSITE_WRITTEN), "onsite")
        .when((F.coalesce(_col(city), F.lit("")) != "") & (rel == "india"), "onsite")
    )


def fill_state(city: Column | str, state: Column | str) -> Column:
    code, named = blank_to_null(state), text_map(fixed.CITY_STATES)[F.lower(blank_to_null(city))]
    known = F.when(F.length(code) <= 3, text_map(fixed.STATE_CODES)[F.lower(code)])
    return F.when(code.isNotNull(), F.coalesce(known, code)).otherwise(named)


def locations_match(left: Column | str, right: Column | str, normalized: bool = False) -> Column:
    """Equal, or a shared token that names a place and the smaller token set within the larger."""
    a, b = (_col(left), _col(right)) if normalized else (normalize_location(left), normalize_location(right))
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda t: t != "")) for c in (a, b))
    shared = F.array_intersect(x, y)
    place = F.array_except(shared, F.array(*[F.lit(t) for t in fixed.GENERIC_LOCATION_TOKENS]))
    return (a == b) | ((F.size(place) > 0) & (F.size(shared) == F.least(F.size(x), F.size(y))))
