"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of what is not a page.
SKIPPED = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".zip", ".mp4", ".svg", ".ico")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def clean(url: Column) -> Column:
    """Without fragment and query."""
    return F.substring_index(without_fragment(url), "?", 1)


def https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def allowed(url: Column, host: str, strict_host: bool = False) -> Column:
    """http or https, no skipped extension, and a host that begins as ``host`` (a regular expression) or, strictly,
    is such a one."""
    bare = clean(url)
    path = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$", 1))
    skipped = F.lit(False)
    for e in SKIPPED:
        skipped = skipped | path.endswith(e)
    return bare.rlike(f"^https?://{host}" + ("(?:/|$)" if strict_host else "")) & ~skipped


def _without_dots(url: Column) -> Column:
    """The . and .. segments of a path taken out; .. at the top is dropped."""
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.substring(url, F.length(origin) + 1, F.length(url))
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    parts = F.split(path, "/")
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when((origin != "") & path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(origin, F.array_join(ended, "/"), F.substring(rest, F.length(path) + 1, F.length(rest)))).otherwise(url)


def resolve(base: Column, href: Column) -> Column:
    """An absolute, scheme-relative, host-relative or path-relative link against its page, with . and .. worked out."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(clean(base), r"(?<=[^/:])/[^/]*$", "/")
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.substring_index(base, ":", 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#") | href.startswith("?"), F.concat(clean(base), href))
        .when(folder == origin, F.concat(origin, F.lit("/"), href))
        .otherwise(F.concat(folder, href))
    )
    return _without_dots(joined)


def links(base: Column, html: Column, host: str | None = None) -> Column:
    """The distinct cleaned https targets of a page's links, of ``host`` (a regular expression) alone if one is given."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    targets = F.array_distinct(F.transform(found, lambda h: https(clean(resolve(base, h)))))
    return targets if host is None else F.filter(targets, lambda t: allowed(t, host))


def aliases(url: Column) -> Column:
    """A URL under both schemes."""
    return F.array(F.regexp_replace(url, "^https://", "http://"), https(url))
