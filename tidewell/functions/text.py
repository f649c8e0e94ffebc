"""Scalar text, URL and hash functions as Columns; only entity decoding leaves the JVM (Arrow batches)."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def joined_tokens(c: Column | str) -> Column:
    return F.array_join(tokens(c), " ")


def normalize_company(c: Column | str) -> Column:
    """Tokens without trailing legal suffixes; the leading blank in the pattern keeps the first token."""
    return F.regexp_replace(joined_tokens(c), f"( ({'|'.join(fixed.COMPANY_SUFFIXES)}))+$", "")


normalize_title = joined_tokens


def fuzzy_title(c: Column | str) -> Column:
    spelt = text_map(fixed.TITLE_ABBREVIATIONS)
    return F.array_join(F.transform(tokens(c), lambda t: F.coalesce(spelt[t], t)), " ")


def with_aliases(c: Column | str, aliases: dict[str, str] = fixed.LOCATION_ALIASES) -> Column:
    """Lower case, with older names of cities replaced as whole words; a text without any is left alone by a plain search."""

    def replaced(low: Column) -> Column:
        there = reduce(lambda a, b: a | b, [F.contains(low, F.lit(name)) for name in aliases])
        return F.when(there, reduce(lambda acc, kv: F.regexp_replace(acc, rf"\b{re.escape(kv[0])}\b", kv[1]), aliases.items(), low)).otherwise(low)

    return let(F.lower(_col(c)), replaced) if aliases else F.lower(_col(c))


def normalize_location(c: Column | str) -> Column:
    return joined_tokens(with_aliases(c))


def normalize_requisition(c: Column | str) -> Column:
    return F.coalesce(joined_tokens(c), F.lit(""))


def requisition_key(company: Column | str, requisition: Column | str) -> Column:
    """company|requisition, or null where there is no requisition."""
    token = normalize_requisition(requisition)
    return F.when(token != "", F.concat_ws("|", normalize_company(company), token))


def normalize_url(c: Column | str) -> Column:
    """Scheme and host required; tracking parameters, fragment and trailing slashes dropped; lower case.

    Escapes that cannot be decoded are kept as they are written.
    """
    # scheme://host[path][?query][#fragment], cut once by pattern so that odd characters do not void the url
    cut = F.regexp_replace(F.trim(_col(c)), r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", "\x1f$1\x1f$2\x1f$3\x1f$4")
    return let(F.split(cut, "\x1f"), lambda parts: F.when((F.size(parts) == 5) & (F.get(parts, F.lit(0)) == ""), _cleaned(parts)))


def _cleaned(parts: Column) -> Column:
    """A URL from its parts: nothing, scheme, host, path, query."""
    part = lambda i: F.get(parts, F.lit(i))
    decode = lambda s: F.coalesce(F.try_url_decode(s), s)
    value = lambda p: F.when(F.contains(p, F.lit("=")), decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.lit(""))
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda p: p != ""), lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("key"), value(p).alias("value")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["key"]).isin(*fixed.TRACKING_PARAMS))
    # form encoding that leaves ~ as it is and escapes *
    encode = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(encode(p["key"]), F.lit("="), encode(p["value"]))), "&")
    whole = let(query, lambda q: F.concat(part(1), F.lit("://"), part(2), part(3), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))))
    return F.lower(F.regexp_replace(whole, "/+$", ""))


def token_fingerprint(c: Column | str) -> Column:
    long = F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.coalesce(F.array_join(F.sort_array(F.array_distinct(long)), " "), F.lit(""))


fuzzy_fingerprint = token_fingerprint


def exact_fingerprint(company: Column | str, title: Column | str, location: Column | str, requisition: Column | str) -> Column:
    parts = [normalize_company(company), normalize_title(title), normalize_location(location), normalize_requisition(requisition)]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def hash_payload(variant: Column | str) -> Column:
    """Digest of the payload's JSON with sorted keys (a variant prints them in order)."""
    return F.sha2(F.to_json(_col(variant)), 256)


#: Strings, or lists, that are Python objects at once.
ITEMS_AT_ONCE = 256


def by_slices(column: pa.Array, use: Callable[[list], list], kind: pa.DataType) -> pa.Array:
    """``use`` of the values, a few at a time: no whole batch becomes Python objects."""
    if column.null_count == len(column):
        return pa.nulls(len(column), kind)
    return pa.concat_arrays([pa.array(use(column.slice(lo, ITEMS_AT_ONCE).to_pylist()), kind) for lo in range(0, len(column), ITEMS_AT_ONCE)])


@F.arrow_udf(T.StringType())
def unescape(s: pa.Array) -> pa.Array:
    """HTML entities decoded; of an Arrow batch only some texts at once are Python objects, and none if there is no ampersand."""
    if not pc.any(pc.match_substring(s, "&")).as_py():
        return s
    return by_slices(s, lambda items: [None if x is None else html.unescape(x) for x in items], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def unescape_all(s: pa.Array) -> pa.Array:
    """HTML entities decoded in every string of a list; nulls of a list are left out."""
    return by_slices(s, lambda lists: [None if x is None else [html.unescape(y) for y in x if y is not None] for x in lists], pa.list_(pa.string()))


def plain_items(c: Column | str) -> Column:
    """The strings of a list as plain text, in order, without those that have none; one Arrow call a list."""
    bare = F.transform(unescape_all(_col(c)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " ")))
    return F.filter(bare, lambda x: x != "")


def collapse_ws(c: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(_col(c), r"\s+", " ")), F.lit(""))


def strip_tags(c: Column | str) -> Column:
    """Markup without scripts, styles, comments and tags, white space collapsed; entities are left as they are."""
    bare = F.regexp_replace(_col(c), r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    bare = F.regexp_replace(bare, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    return collapse_ws(F.regexp_replace(bare, r"<[^>]*>", " "))


def html_to_text(c: Column | str) -> Column:
    return collapse_ws(unescape(strip_tags(c)))


def plain_text(c: Column | str) -> Column:
    """Decode first, then drop tags: what was escaped markup goes too."""
    return collapse_ws(F.regexp_replace(unescape(_col(c)), "<[^>]+>", " "))


def parse_iso_ts(c: Column | str) -> Column:
    """ISO-8601 text as a timestamp; text without a zone is UTC (the session's zone is to be UTC); null if it is none."""
    s = F.trim(_col(c))
    basic = F.when(s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd")))
    return F.coalesce(basic, F.when(s.rlike(r"^\d{4}-\d{2}"), s.try_cast("timestamp")))


def parse_epoch(c: Column) -> Column:
    """A number of seconds, or of milliseconds where it is above 1e10."""
    n = c.cast("double")
    return F.timestamp_millis(F.when(n > 1e10, n).otherwise(n * 1000).cast("long"))


def iso_z(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def contains_text(column: Column | str, needle: Column | str) -> Column:
    """Literal, case-insensitive: no character of the needle is a wildcard."""
    return F.contains(F.lower(_col(column)), F.lower(F.lit(needle) if isinstance(needle, str) else needle))


def normalized_input_text(title: Column | str, location: Column | str, description: Column | str) -> Column:
    both = F.concat_ws("\n", *[F.coalesce(_col(c), F.lit("")) for c in (title, location, description)])
    return F.lower(F.trim(F.regexp_replace(both, r"\s+", " ")))


def cache_key(task: str, version: str, text: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(task), F.lit(version), _col(text)), 256)


def structure_hash(title: Column | str, description: Column | str, city: Column | str, url: Column | str) -> Column:
    parts = [F.coalesce(_col(c), F.lit("")) for c in (title, description, city, url)]
    return F.sha2(F.concat_ws("\n", F.lit(fixed.STRUCTURE_VERSION), *parts), 256)


def job_location(city: Column | str, state: Column | str, country: Column | str, limit: int | None = None) -> Column:
    """Non-blank parts joined by ", "; null where there is none."""
    whole = F.nullif(F.concat_ws(", ", *[blank_to_null(c) for c in (city, state, country)]), F.lit(""))
    return whole if limit is None else F.substring(whole, 1, limit)


def prompt_text(title, company, city, state, country, employment, mode, description) -> Column:
    """The request text for one posting; the description is cut at the limit."""
    blank = lambda c: F.coalesce(_col(c), F.lit(""))
    place = F.concat_ws(", ", *[F.nullif(_col(c), F.lit("")) for c in (city, state, country)])
    # The labels of the request, which decide cache keys.
    return F.format_string(
        "TITLE: %s\nCOMPANY: %s\nLOCATION: %s\nEMPLOYMENT: %s\nWORK MODE: %s\nPOSTING:\n%s\n",
        blank(title), blank(company), place, blank(employment), blank(mode), F.substring(blank(description), 1, fixed.DESCRIPTION_LIMIT),
    )


def experience_label(low: Column | str, high: Column | str) -> Column:
    """"a-b years" or "a years"; a lower bound of 0 counts as none."""
    low, high = _col(low), _col(high)
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0+$", "")
    one = F.coalesce(F.when(low != 0, low), high)
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(number(low), F.lit("–"), number(high), F.lit(" years"))).when(
        one.isNotNull(), F.concat(number(one), F.lit(" years"))
    )
