"""URL parts as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site(url: Column) -> Column:
    """Host in lower case without a leading ``www.`` and without port; null where there is no host."""
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


_PARTS = r"^(?:[^:/?#]+:)?(?://([^/?#]*))?([^?#]*)"


def display_url(url: Column) -> Column:
    """Host and path, without scheme, query and fragment."""
    return F.concat(F.regexp_extract(url, _PARTS, 1), F.regexp_extract(url, _PARTS, 2))


def unquoted(url: Column) -> Column:
    """Percent-decoded as far as possible: ``+`` and malformed escapes stay, bytes that are no UTF-8 become U+FFFD."""
    parts = F.split(url, "%")

    def code(part: Column) -> Column:
        escape = F.regexp_like(part, F.lit("(?s)^[0-9A-Fa-f]{2}.*$"))
        return F.when(escape, F.concat(F.substring(part, 1, 2), F.hex(F.encode(part.substr(F.lit(3), F.length(part)), "UTF-8")))).otherwise(F.concat(F.lit("25"), F.hex(F.encode(part, "UTF-8"))))

    codes = F.concat(F.hex(F.encode(F.get(parts, F.lit(0)), "UTF-8")), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts))), code), ""))
    # decoded where it is needed only: texts without a percent sign pass
    return F.when(F.contains(url, F.lit("%")), F.make_valid_utf8(F.unhex(codes).cast("string"))).otherwise(url)


def fallback_title(url: Column) -> Column:
    """Last part of the path in words, or the host."""
    tail = F.regexp_extract(F.regexp_replace(F.regexp_extract(url, _PARTS, 2), "/+$", ""), "([^/]*)$", 1)
    words = F.array_join(F.transform(F.filter(F.split(F.translate(unquoted(tail), "-_", "  "), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), " ")
    return F.when(tail == "", F.regexp_extract(url, _PARTS, 1)).otherwise(words)
