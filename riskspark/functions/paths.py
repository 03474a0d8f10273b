"""Path predicates and globs as Column expressions."""

from pyspark.sql import Column, functions as F

from riskspark import fixed_values as fv
from riskspark.functions.regex import java


def norm_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^/+", "")


def extension(path: Column) -> Column:
    """Text after the last dot of the file name, '' if there is none."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.([^.]*)$", 1)


def is_source(path: Column) -> Column:
    return extension(path).isin(fv.SOURCE_EXTENSIONS)


def is_scannable(path: Column) -> Column:
    return F.lower(extension(path)).isin(fv.SOURCE_EXTENSIONS + ["sql"])


def is_secret_target(path: Column) -> Column:
    return F.lower(extension(path)).isin(fv.SECRET_SCAN_EXTENSIONS)


def in_dirs(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def in_source_tree(path: Column) -> Column:
    """Source files minus declarations, tests and build output."""
    return (
        is_source(path)
        & ~path.rlike(r"\.d\.ts\z")
        & ~path.rlike(r"\.(?:test|spec)\.js\z")
        & ~in_dirs(path, fv.TREE_IGNORED_DIRS)
    )


def is_migration(path: Column) -> Column:
    return path.rlike(r"(?:^|/)supabase/migrations/(?:.*/)?[^/]*\.sql\z") & ~in_dirs(path, ["node_modules"])


def is_manifest(path: Column) -> Column:
    return path.rlike(r"(?:^|/)package\.json\z") & ~in_dirs(path, fv.TREE_IGNORED_DIRS)


def is_test_path(path: Column) -> Column:
    return norm_path(path).rlike(r"(?i)\.(?:test|spec)\.js\z")


def quote(text: Column) -> Column:
    """Escape regex metacharacters of a column value."""
    return F.regexp_replace(text, r"([.+?^${}()|\[\]\\])", r"\\$1")


def ignore_pattern_regex(pattern: Column) -> Column:
    """Ignore-path pattern to one anchored regex (NULL for an empty pattern)."""
    p = norm_path(pattern)
    literal = quote(F.replace(p, F.lit("*"), F.lit("\u0001")))
    starred = F.replace(literal, F.lit("\u0001"), F.lit(".*"))
    return (
        F.when(p == "", F.lit(None).cast("string"))
        .when(p.endswith("/"), F.concat(F.lit("^"), F.replace(literal, F.lit("\u0001"), F.lit("\\*")), F.lit("[\\s\\S]*\\z")))
        .when(p.contains("*"), F.concat(F.lit("^"), starred, F.lit("\\z")))
        .otherwise(F.concat(F.lit("^(?:[\\s\\S]*/)?"), literal, F.lit("(?:/[\\s\\S]*)?\\z")))
    )


def matches_ignore(path: Column, pattern: Column) -> Column:
    """The infix form needs a directory on the left and a child on the right."""
    p, x = norm_path(path), norm_path(pattern)
    plain = (p == x) | p.startswith(F.concat(x, F.lit("/"))) | p.contains(F.concat(F.lit("/"), x, F.lit("/")))
    return F.coalesce(
        F.when(x == "", F.lit(False))
        .when(x.endswith("/"), p.startswith(x))
        .when(x.contains("*"), F.rlike(p, ignore_pattern_regex(x)))
        .otherwise(plain),
        F.lit(False),
    )


def glob_regex(pattern: Column) -> Column:
    """Target glob to regex: ``**`` crosses segments, ``*`` does not."""
    p = F.replace(norm_path(pattern), F.lit("**"), F.lit("\u0001"))
    p = F.replace(p, F.lit("*"), F.lit("\u0002"))
    p = F.replace(quote(p), F.lit("\u0002"), F.lit("[^/]*"))
    return F.concat(F.lit("^"), F.replace(p, F.lit("\u0001"), F.lit(".*")), F.lit("\\z"))


def matches_target(path: Column, pattern: Column) -> Column:
    p, x = norm_path(path), norm_path(pattern)
    return F.coalesce(
        F.when(x == "", F.lit(False))
        .when(x.contains("*"), F.rlike(p, glob_regex(x)))
        .otherwise((p == x) | p.startswith(F.concat(x, F.lit("/")))),
        F.lit(False),
    )


def is_frontend(path: Column) -> Column:
    return path.startswith("app/") | path.startswith("pages/")


def is_pages_api(path: Column) -> Column:
    return path.startswith("pages/api/")


def is_app_api(path: Column) -> Column:
    return path.startswith("app/api/")


def is_backend_api(path: Column) -> Column:
    return path.rlike(r"(?:^|/)api/")


def route_class(path: Column) -> Column:
    return (
        F.when(is_pages_api(path), "pages-api")
        .when(is_app_api(path), "app-api")
        .when(is_backend_api(path), "generic-api")
        .when(is_frontend(path), "frontend")
        .otherwise("other")
    )


def has_use_server(content: Column) -> Column:
    return content.contains("use server") & F.regexp_replace(content, "^﻿", "").rlike(java(r"(?:^|[\n;{])\s*[\"']use server[\"']\s*;?"))


def ssrf_target(path: Column, content: Column) -> Column:
    return is_backend_api(path) | path.rlike(r"\.server\.(?:js|jsx|ts|tsx)\z") | has_use_server(content)


def has_use_client(content: Column) -> Column:
    text = F.regexp_replace(content, "^﻿", "")
    return content.contains("use client") & text.rlike(java(r"^\s*(?:(?:\/\/[^\n]*|\/\*[\s\S]*?\*\/)\s*)*[\"']use client[\"']\s*;?").replace(")*[", ")*+[", 1))


def is_client_component(path: Column, content: Column) -> Column:
    return (
        F.when(path.startswith("pages/"), ~is_pages_api(path))
        .when(path.startswith("app/"), has_use_client(content))
        .otherwise(F.lit(False))
    )


def watch_ignored(path: Column, tripwire_prefix: str = ".tripwire") -> Column:
    """Hidden segments (which covers any dot-named tripwire file), build and test folders, tests."""
    name = F.element_at(F.split(path, "/"), -1)
    return (
        path.rlike(r"(?:^|[/\\])\.")
        | in_dirs(path, fv.WATCH_IGNORED_DIRS)
        | name.startswith(tripwire_prefix)
        | name.rlike(r"(?i)\.(?:spec|test)\.[cm]?[jt]sx?\z")
    )


def watch_source(path: Column) -> Column:
    return ~watch_ignored(path) & F.lower(extension(path)).isin(fv.WATCHED_EXTENSIONS)


def is_local_dev_url(value: Column) -> Column:
    """Host is a loopback name.  The host is what follows the last '@' of the authority."""
    v = F.trim(value)
    full = F.when(v.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), v).otherwise(F.concat(F.lit("http://"), v))
    authority = F.regexp_extract(full, r"^[^:]+://([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*\z", "")
    return F.coalesce((v != "") & host.rlike(java(fv.LOCAL_HOST)), F.lit(False))
