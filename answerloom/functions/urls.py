"""URL columns: kind of source, resolving references, host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom import fixed_values as V
from answerloom.functions.text import contains_any, ends_with_any

# scheme, authority, path, query, fragment (RFC 3986, appendix B)
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def source_kind(url: Column) -> Column:
    """The reader a URL needs; the first rule that fits."""
    low = F.lower(url)
    return (
        F.when(url.endswith(".pdf"), "pdf")
        .when(url.endswith(".zip"), "zip")
        .when(ends_with_any(url, V.TABULAR_SUFFIXES), "file")
        .when(ends_with_any(low, V.AUDIO_SUFFIXES), "audio")
        .when(ends_with_any(low, V.IMAGE_SUFFIXES), "image")
        .when(url.contains("/api/") | url.endswith("/data"), "api")
        .otherwise("page")
    )


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def is_data_link(href: Column) -> Column:
    return contains_any(F.lower(href), V.PROCESSABLE_EXTENSIONS)


def _without_dots(segments: Column) -> Column:
    """Path segments after applying ``.`` and ``..``."""

    def step(done: Column, segment: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return (
            F.when(segment == "..", up).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_in_dots = F.try_element_at(segments, F.lit(-1)).isin(".", "..")
    return F.when(ends_in_dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept)


def resolve_url(base: Column, ref: Column) -> Column:
    """A reference made absolute against the address of its page."""
    scheme, authority, path, query, fragment = [F.regexp_extract(ref, _PARTS, i) for i in range(1, 6)]
    b_scheme, b_authority, b_path, b_query = [F.regexp_extract(base, _PARTS, i) for i in range(1, 5)]
    root = F.concat(b_scheme, F.lit("://"), b_authority)

    folder = F.split(b_path, "/")
    folder = F.when(F.try_element_at(folder, F.lit(-1)) != "", F.slice(folder, F.lit(1), F.size(folder) - 1)).otherwise(
        folder
    )
    joined = F.concat(folder, F.split(path, "/"))
    # Doubled slashes in the middle of a relative path count once.
    inner = F.filter(joined, lambda s, i: (s != "") | (i == 0) | (i == F.size(joined) - 1))
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(inner)
    full = F.regexp_replace(F.array_join(_without_dots(segments), "/"), "^/?", "/")
    return (
        F.when(ref == "", base)
        .when(scheme != "", ref)
        .when(authority != "", F.concat(b_scheme, F.lit(":"), ref))
        .when(path == "", F.concat(root, b_path, F.when(query != "", query).otherwise(b_query), fragment))
        .otherwise(F.concat(root, full, query, fragment))
    )


def default_submit_url(page: Column, submit: Column) -> Column:
    """Where to send an answer: the given address, made absolute, else ``/submit`` of the page's host."""
    root = F.concat(F.regexp_extract(page, _PARTS, 1), F.lit("://"), F.regexp_extract(page, _PARTS, 2))
    return (
        F.when(submit.isNull() | (submit == ""), F.concat(root, F.lit("/submit")))
        .when(submit.startswith("/"), F.concat(root, submit))
        .otherwise(submit)
    )
