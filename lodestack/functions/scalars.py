"""Scalar expressions over sizes, times, speeds and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions import fixed

#: What is withheld from logs, in this order.
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}"
SECRET = r"""(?i)\b(api[_-]?key|token|password|passwd|secret|cookie|authorization|credential|bearer)\b(\s*[:=]\s*|['"]?\s*:\s*['"]?)([^,\s'"}]{6,}|['"][^'"]{6,}['"])"""

DAY = 86_400


def format_bytes(c: Column) -> Column:
    """"512 B", "1.50 KB", "12.3 MB", "123 GB": steps of 1024, fewer decimals for larger numbers."""
    c = F.greatest(c.cast("double"), F.lit(0.0))
    out = F.format_string("%.0f B", c)
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        x = c / float(1024**k)
        shown = lambda digits: F.format_string(f"%.{digits}f {unit}", F.bround(x, digits))  # noqa: B023, E731  half to even
        text = F.when(x >= 100, shown(0)).when(x >= 10, shown(1)).otherwise(shown(2))
        out = F.when(c >= 1024**k, text).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """HH:MM:SS, or "Unknown" for null, NaN and negative numbers."""
    s = F.bround(seconds.cast("double")).cast("long")
    text = F.concat_ws(":", *[F.lpad(F.when(F.length(x) > 2, x).otherwise(x), F.greatest(F.length(x), F.lit(2)), F.lit("0")) for x in ((s / 3600).cast("long").cast("string"), F.floor(s % 3600 / 60).cast("string"), (s % 60).cast("string"))])
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (seconds < 0), "Unknown").otherwise(text)


def ewma(values: Column, alpha: float) -> Column:
    """The smoothed value after the last of an array: a bad sample counts as 0, a previous value that isn't positive starts anew."""
    a = min(1.0, max(0.01, alpha))
    good = lambda x: F.when(x.isNull() | F.isnan(x) | (x < 0), 0.0).otherwise(x)
    return F.aggregate(values, F.lit(0.0), lambda done, x: F.when(done <= 0, good(x)).otherwise(a * good(x) + (1 - a) * done))


def eta(remaining: Column, speed: Column, samples: Column) -> Column:
    """Seconds left, or null: fewer than 3 samples, no speed, or more than a year."""
    left = remaining / F.when(speed > 0, speed)
    return F.when((samples >= 3) & (remaining >= 0) & (left <= 365 * DAY), left)


def redact(c: Column) -> Column:
    """Text with bearer tokens and the values of secret keys withheld."""
    return F.regexp_replace(F.regexp_replace(c, BEARER, "Bearer __REDACTED__"), SECRET, "$1$2__REDACTED__")


def redaction_hits(c: Column) -> Column:
    return F.regexp_count(c, F.lit(BEARER)) + F.regexp_count(F.regexp_replace(c, BEARER, "Bearer __REDACTED__"), F.lit(SECRET))


def project_score(payload: Column) -> Column:
    """How much a JSON variant looks like a project: the better of the object and its ``app`` object; 4 and more is one, what is no object scores 0."""

    def score(base: str) -> Column:
        own = F.try_variant_get(payload, base, "map<string,variant>")
        keys = F.map_keys(own)
        is_list = lambda name: F.coalesce(F.startswith(F.schema_of_variant(F.try_element_at(own, F.lit(name))), F.lit("ARRAY")), F.lit(False))
        among = lambda names: F.size(F.array_intersect(keys, F.array(*map(F.lit, names))))
        lists = [F.when(is_list(n), p).otherwise(0) for n, p in (("rows", 3), ("backpack", 2), ("groups", 1))]
        return F.when(own.isNotNull(), 3 * among(fixed.IMAGE_FIELDS) + among(fixed.PROJECT_FIELDS) + lists[0] + lists[1] + lists[2]).otherwise(0)

    return F.coalesce(F.greatest(score("$"), score("$.app")), F.lit(0))


def project_text_score(c: Column) -> Column:
    """The same by names followed by a colon in the first 300,000 characters of a text, in any case of letters: 3 a picture's field, 1 another."""
    names = F.regexp_extract_all(F.substring(c, 1, 300_000), F.lit(r"""(?i)(?<![A-Za-z0-9_$])["\\']?([A-Za-z]+)["\\']?\s*:"""), 1)
    found = F.array_distinct(F.transform(names, F.lower))
    among = lambda names: F.size(F.array_intersect(found, F.array(*[F.lit(n.lower()) for n in names])))
    return F.coalesce(3 * among(fixed.IMAGE_FIELDS) + among(fixed.PROJECT_TEXT_FIELDS), F.lit(0))


def is_project_text(c: Column) -> Column:
    """Whether a text is or holds a project: parsed JSON by its object's score; a text in braces that isn't JSON never; other text by its names."""
    trimmed = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    braced = F.startswith(trimmed, F.lit("{")) & F.endswith(trimmed, F.lit("}"))
    parsed = F.try_parse_json(c)
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    return F.coalesce(F.when(F.coalesce(c, F.lit("")) == "", False).when(braced & parsed.isNull(), False).when(is_object, project_score(parsed) >= 4).otherwise(project_text_score(c) >= 4), F.lit(False))


def update_reason(etag: tuple[Column, Column], modified: tuple[Column, Column], length: tuple[Column, Column]) -> Column:
    """"ETag, Last-Modified, size a→b" of what differs where both sides say something."""
    differ = lambda x: (F.coalesce(x[0], F.lit("")) != "") & (F.coalesce(x[1], F.lit("")) != "") & (x[0] != x[1])
    return F.concat_ws(", ", F.when(differ(etag), "ETag"), F.when(differ(modified), "Last-Modified"), F.when(differ(length), F.concat(F.lit("size "), length[0], F.lit("→"), length[1])))


def identity_length(content_range: Column, content_length: Column) -> Column:
    """The total after the slash of a Content-Range, else the Content-Length."""
    total = F.regexp_extract(content_range, r"/(\d+)\s*$", 1)
    return F.coalesce(F.when(total != "", total), content_length)
