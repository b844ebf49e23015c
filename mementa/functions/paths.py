"""Path, classification and identifier expressions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from mementa import constants as K


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, even where the optimizer merges projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(value: Column | str) -> Column:
    """Lower-case A-Z only, leaving other letters as they are."""
    return F.translate(_col(value), string.ascii_uppercase, string.ascii_lowercase)


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def _clean_root(root: Column | str) -> Column:
    return F.regexp_replace(_col(root), "/+$", "")


def path_within(path: Column | str, root: Column | str) -> Column:
    """Component-wise prefix test: /lib holds /lib/x and /lib, not /library."""
    p, r = _col(path), _clean_root(root)
    return (p == r) | p.startswith(F.concat(r, F.lit("/")))


def resolved(path: Column | str) -> Column:
    """Path without ``.``, ``..`` and empty components, links left alone.

    As for an operating system, ``/..`` is ``/``; what a relative path climbs above its start stays as leading ``..``.
    """
    p = _col(path)
    absolute = p.startswith("/")
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))

    def step(done: Column, x: Column) -> Column:
        inside = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        return (
            F.when(x != "..", F.concat(done, F.array(x)))
            .when(inside, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(absolute, done)
            .otherwise(F.concat(done, F.array(x)))
        )

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folded = F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))
    # most paths have nothing to resolve
    closed = F.concat(p, F.lit("/"))
    plain = ~(closed.contains("//") | closed.contains("/./") | closed.contains("/../") | closed.startswith("./") | closed.startswith("../"))
    return F.when(plain, p).otherwise(folded)


def relative_path(path: Column | str, root: Column | str) -> Column:
    """Path below ``root``; the full path when it lies elsewhere."""
    p, r = _col(path), _clean_root(root)
    return (
        F.when(p == r, F.lit(""))
        .when(p.startswith(F.concat(r, F.lit("/"))), F.substr(p, F.length(r) + 2))
        .otherwise(p)
    )


def extension(path: Column | str) -> Column:
    """Lower-cased text after the last dot; NULL without a dot or with only a leading one."""
    name = base_name(path)
    return F.when(
        name.rlike(r"(?s)^.+\.[^.]*$") & (name != ".."), ascii_lower(F.substring_index(name, ".", -1))
    )


def file_stem(path: Column | str) -> Column:
    name = base_name(path)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(
        name
    )


def media_category(ext: Column | str) -> Column:
    e = ascii_lower(ext)
    return (
        F.when(e.isin(K.PHOTO_EXTENSIONS), "photo")
        .when(e.isin(K.VIDEO_EXTENSIONS), "video")
        .when(e.isin(K.MUSIC_EXTENSIONS), "music")
        .when(e.isin(K.DOCUMENT_EXTENSIONS), "documents")
    )


def classify(rel_path: Column | str, ext: Column | str) -> Column:
    """Extension first, then a leading category folder, else ``other``."""
    lead = ascii_lower(F.substring_index(_col(rel_path), "/", 1))
    return F.coalesce(media_category(ext), F.when(lead.isin(K.CATEGORIES), lead), F.lit("other"))


def source_of(rel_path: Column | str) -> Column:
    """Second path component when at least three exist, else ``local``."""
    parts = F.split(_col(rel_path), "/", -1)
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(F.lit("local"))


def storage_path(destination: Column | str, content_hash: Column | str, ext: Column | str) -> Column:
    """Content-addressed location ``dest/objects/<first two>/<hash>[.ext]``."""
    h = _col(content_hash)
    suffix = F.when(F.length(_col(ext)) > 0, F.concat(F.lit("."), _col(ext))).otherwise(F.lit(""))
    return F.concat(
        _clean_root(destination), F.lit("/objects/"), F.substring(h, 1, 2), F.lit("/"), h, suffix
    )


def objects_root(path: Column | str) -> Column:
    """Nearest ancestor folder named ``objects`` (the path itself counts), NULL if none."""
    root = F.regexp_extract(_col(path), r"(?s)^(.*/objects|objects)(?:/.*)?$", 1)
    return F.when(F.length(root) > 0, root)


def is_duplicate_named(rel_path: Column | str) -> Column:
    return F.lower(base_name(rel_path)).startswith("duplicate")


def shorten_path(path: Column | str) -> Column:
    p = _col(path)
    parts = F.filter(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    return (
        F.when(F.coalesce(p, F.lit("")) == "", F.lit("Not selected yet"))
        .when(F.size(parts) <= 3, p)
        .otherwise(F.concat(F.lit(".../"), F.array_join(F.slice(parts, -3, 3), "/")))
    )


def needs_thumbnail(category: Column | str, ext: Column | str) -> Column:
    return (_col(category) == "photo") & F.coalesce(
        ascii_lower(ext).isin(K.NON_WEB_PHOTO_EXTENSIONS), F.lit(False)
    )


def uuid5(name: Column | str) -> Column:
    """RFC 4122 version-5 identifier in the URL namespace, from built-in functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(K.URL_NAMESPACE_HEX)), F.encode(_col(name), "UTF-8")))
    # variant bits: the top two bits of the 17th hex digit become 10
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def backup_id(adapter: Column | str, source_path: Column | str) -> Column:
    return uuid5(F.concat(_col(adapter), F.lit(":"), _col(source_path)))


def run_id(backup: Column | str, token: Column | str) -> Column:
    """Identifier of one import run; the caller supplies the unique token."""
    return uuid5(F.concat(F.lit("run:"), _col(backup), F.lit(":"), _col(token).cast("string")))


def redact(value: Column | str) -> Column:
    """Keep only the last four characters of a trimmed identifier."""
    t = F.regexp_replace(_col(value), r"(?U)^\s+|\s+$", "")
    return F.when(F.octet_length(t) <= 4, F.lit("[redacted]")).otherwise(
        F.concat(F.lit("[redacted:"), F.right(t, F.lit(4)), F.lit("]"))
    )


def backup_timestamp(label: Column | str) -> Column:
    """``..._20250102030405`` becomes ``2025-01-02T03:04:05``; NULL for another shape."""
    digits = F.regexp_extract(_col(label), r"_(\d{14})$", 1)
    return F.when(
        F.length(digits) == 14,
        F.regexp_replace(digits, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", r"$1-$2-$3T$4:$5:$6"),
    )


def message_db_format(name: Column | str) -> Column:
    n = _col(name)
    return (
        F.when(n.endswith(".crypt15"), "crypt15").when(n.endswith(".crypt14"), "crypt14").otherwise("unknown")
    )


def is_message_db_file(name: Column | str) -> Column:
    return ascii_lower(name).rlike(r"(?s)^(msgstore|wa\.db).*|.*\.crypt1[245]$")
