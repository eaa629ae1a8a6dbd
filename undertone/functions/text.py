"""Functions over strings, maps, JSON, time and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from undertone.functions.pointwise import _c, half_up


def slug(x) -> Column:
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "-")


def valid_id(x) -> Column:
    return _c(x).rlike("^[A-Za-z0-9_-]{1,128}$")


def truncated(x, n: int) -> Column:
    return F.substring(_c(x), 1, n)


def normal_email(x) -> Column:
    """Trimmed and lower-cased, or null: 5 to 254 characters, one @ with text on both sides, a dotted domain, no spaces."""
    e = F.lower(F.trim(_c(x)))
    return F.when(F.length(e).between(5, 254) & e.rlike(r"^[^@ \t\r\n]+@[^@ \t\r\n.]+(\.[^@ \t\r\n.]+)+$"), e)


def escape_html(x) -> Column:
    out = _c(x)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def css_colour(x, otherwise: str = "#888888") -> Column:
    return F.when(_c(x).rlike("^#[0-9a-fA-F]{3}$|^#[0-9a-fA-F]{6}$"), _c(x)).otherwise(F.lit(otherwise))


def output_name(x, suffix: str = "_processed", extension: str = ".wav") -> Column:
    return F.concat(F.regexp_replace(_c(x), r"\.[^./]+$", ""), F.lit(suffix + extension))


def clock(seconds) -> Column:
    """m:ss"""
    s = F.floor(_c(seconds))
    return F.format_string("%d:%02d", F.floor(s / 60).cast("bigint"), F.pmod(s, F.lit(60)).cast("bigint"))


def clock_tenths(seconds) -> Column:
    """m:ss.s"""
    tenths = half_up(F.pmod(_c(seconds), F.lit(60.0)) * 10).cast("bigint")
    return F.format_string("%d:%02d.%d", F.floor(_c(seconds) / 60).cast("bigint"), F.floor(tenths / 10).cast("bigint"), F.pmod(tenths, F.lit(10)))


def cache_key(name, size, modified, params: Column) -> Column:
    """name:size:time:parameters, the parameters (a map) as JSON in order of their names."""
    entries = F.array_sort(F.map_entries(params))
    return F.concat_ws(":", _c(name), _c(size).cast("string"), _c(modified).cast("string"), F.to_json(F.map_from_entries(entries)))


def days_left(expires, now) -> Column:
    """Whole days until a time in seconds, a started day counting; none once past."""
    return F.greatest(F.lit(0).cast("bigint"), F.ceil((_c(expires) - _c(now)) / 86400))


def json_bytes(x: Column) -> Column:
    return F.octet_length(F.to_json(x))


def allowed(m: Column, names) -> Column:
    """A map without the keys that aren't named."""
    return F.map_filter(m, lambda k, _: k.isin(*names))


def same_origin(url, host: str) -> Column:
    return F.coalesce(F.try_parse_url(_c(url), F.lit("HOST")) == F.lit(host), F.lit(False))


def safe_redirect(url, origin: str) -> Column:
    """The address to go to: a path at the origin, or an address at the same origin; null for any other."""
    u = _c(url)
    own = F.lower(F.regexp_extract(u, "^[a-zA-Z]+://[^/?#]+", 0)) == origin
    return F.when(u.startswith("/") & ~u.startswith("//"), F.concat(F.lit(origin), u)).when(own, u)


def digest_samples(samples: Column) -> Column:
    """SHA-256 of samples as written numbers, comma separated."""
    return F.sha2(F.array_join(F.transform(samples, lambda v: v.cast("string")), ","), 256)


#: Other names of stored models.
ALIASES = {"vad": "silero_vad", "silero": "silero_vad", "df": "deepfilter", "dns": "dns2_conformer_small", "dns2": "dns2_conformer_small", "ecapa": "ecapa_tdnn", "noise": "noise_classifier", "classifier": "noise_classifier"}


def canonical(key, aliases=None) -> Column:
    """The name an alias stands for; others stay."""
    pairs = [F.lit(x) for kv in (aliases or ALIASES).items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), _c(key)), _c(key))


def palette_slot(first_seen_rank, colours: int = 8) -> Column:
    return F.pmod(_c(first_seen_rank) - 1, F.lit(colours))


def saved_session(column) -> Column:
    """A saved session as a struct of params (name to number) and meta (name to text, empty if there is none); null for what is
    malformed or has no object of params. Params that aren't numbers are null."""
    kind = "struct<params: map<string,string>, meta: map<string,string>>"
    parsed = F.from_json(column, kind, {"mode": "PERMISSIVE"})
    shape = F.get_json_object(column, "$.params")
    params = F.transform_values(parsed["params"], lambda k, v: v.try_cast("double"))
    meta = F.coalesce(parsed["meta"], F.create_map().cast("map<string,string>"))
    return F.when(F.get_json_object(column, "$").isNotNull() & shape.startswith("{") & parsed["params"].isNotNull(), F.struct(params.alias("params"), meta.alias("meta")))
