"""Identifiers and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import fixed_values as fv
from threadloom.functions.text import empty_if_null, file_stem, null_if_empty, strip


def _trim_slashes(c: Column) -> Column:
    return F.regexp_replace(c, r"/+\z", "")


def id_from_url(c: Column) -> Column:
    """What follows the last ``list/``, with email read as message."""
    tail = _trim_slashes(F.element_at(F.split(empty_if_null(c), "list/"), -1))
    return F.replace(tail, F.lit("email"), F.lit("message"))


def typed_id_from_url(c: Column) -> Column:
    """``thread/…`` or ``message/…``; null for any other address."""
    last = lambda sep: _trim_slashes(F.element_at(F.split(c, sep), -1))
    return (
        F.when(F.contains(c, F.lit("/thread/")), F.concat(F.lit("thread/"), last("/thread/")))
        .when(F.contains(c, F.lit("/email/")), F.concat(F.lit("message/"), last("/email/"))))


def list_name_from_url(c: Column) -> Column:
    return F.split_part(F.element_at(F.split(empty_if_null(c), "/list/"), -1),
                        F.lit("/"), F.lit(1))


def library_from_path(c: Column) -> Column:
    """The path part after the first ``en`` that has one."""
    parts = F.split(c, "/")
    at = F.array_position(parts, "en").cast("int")
    return F.when((at > 0) & (at < F.size(parts)), F.element_at(parts, at + 1)
                  ).otherwise("unknown")


def title_prefix(title: Column, text: Column) -> Column:
    return F.when(empty_if_null(title) != "",
                  F.concat(F.lit("Title: "), title, F.lit("\n\n"), text)).otherwise(text)


def chunk_record_id(base: Column, start_index: Column, text: Column) -> Column:
    """Hash of the document id with the chunk's place, or with its text."""
    by_place = F.concat_ws("_", base, start_index.cast("string"))
    by_text = F.concat_ws("_", base, F.substring(text, 1, 50),
                          F.length(text).cast("string"))
    return F.md5(F.when(start_index.isNotNull(), by_place).otherwise(by_text))


def local_chunk_id(url: Column, ordinal: Column) -> Column:
    return F.concat(F.md5(url), F.lit("-"), F.format_string("%03d", ordinal.cast("int")))


def paper_number(c: Column) -> Column:
    return F.coalesce(*[
        null_if_empty(strip(F.regexp_extract(c, f"(?i){p}", 1)))
        for p in fv.PAPER_NUMBER_PATTERNS])


def paper_id(url: Column, path: Column, number: Column) -> Column:
    from_url = null_if_empty(F.regexp_extract(url, r"/([PN]\d{4}[A-Z]?\d*)", 1))
    return F.coalesce(
        F.concat(F.lit(fv.PAPER_PREFIX), number),
        F.concat(F.lit(fv.PAPER_PREFIX), from_url),
        null_if_empty(url),
        F.concat(F.lit(fv.PAPER_PREFIX), file_stem(path)))


def author_site(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for part, site in reversed(fv.AUTHOR_SITES):
        out = F.when(F.contains(F.lower(c), F.lit(part)), site).otherwise(out)
    return F.coalesce(out, F.lit(fv.DEFAULT_SITE))


def reference_url(namespace: Column, doc_id: Column, url: Column, team: Column,
                  channel: Column) -> Column:
    """Address to cite a result by."""
    return (
        F.when(namespace == "mailing", F.concat(
            F.lit(fv.MAIL_ADDRESS), doc_id, F.lit("/")))
        .when(namespace == "slack", F.concat(
            F.lit(fv.CHAT_ADDRESS), team, F.lit("/"), channel, F.lit("/p"),
            F.replace(doc_id, F.lit("."), F.lit(""))))
        .when(namespace == "wg21", F.coalesce(
            null_if_empty(url), F.concat(F.lit(fv.PAPER_ADDRESS), doc_id)))
        .otherwise(F.coalesce(null_if_empty(url), doc_id)))
