"""Keyword search over agreements: what is searched, the excerpt shown, and the export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.money import col, strip

# Metadata and fields that are searched, in order; bounds of the excerpt; parts of the export's file name.
SEARCHED = (
    "doc_id", "file_name", "folder", "status", "source", "mime_type", "parser_id", "classify_mode", "review_reason", "agreement_id", "requestor", "agreement_type", "agreement_sub_type",
    "business_function", "entity", "start_date", "end_date",
)
FLAGS = ("auto_renew", "perpetual")
EXCERPT, BEFORE, AFTER, SLUG = 2000, 80, 400, 40
HEADER = ("agreement_id", "requestor", "agreement_type", "agreement_sub_type", "business_function", "entity", "start_date", "end_date", "auto_renew", "perpetual")
EXPORTED = (
    "file_name", "mime_type", "source", "folder", "status", "parser_id", "parser_version", "confidence", "page_count", "classify_mode", "needs_confirm", "review_reason", "uploaded_at", "processed_at",
    "archived_at",
)


def _field_lists(fields: DataFrame) -> DataFrame:
    """``doc_id, fields``: the fields of a document, some ten, in the order of their keys."""
    item = F.struct("key", "label", "value", "confidence")
    return fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("fields"))


def haystack(docs: DataFrame) -> Column:
    """Lower-case text that a keyword is searched in: metadata, flags in words, text, and the fields' keys, labels and values."""
    parts = [F.col(c).cast("string") for c in SEARCHED if c in docs.columns]
    parts += [F.when(F.col(c), "yes true").when(~F.col(c), "no false") for c in FLAGS if c in docs.columns]
    own = F.array(*parts, F.col("text"))
    of_fields = F.flatten(F.transform(F.coalesce("fields", F.expr("filter(array(named_struct('key', '', 'label', '', 'value', '', 'confidence', 0)), x -> false)")), lambda f: F.array(f["key"], f["label"], f["value"])))
    return F.lower(F.array_join(F.filter(F.concat(own, of_fields), lambda p: F.coalesce(strip(p), F.lit("")) != ""), "\n"))


def matching(docs: DataFrame, fields: DataFrame, keyword: str | None, folder: str | None = None, status: str | None = None) -> DataFrame:
    """Documents, with their ``fields``, that hold the keyword; all of them for a blank one.

    ``fields``: ``doc_id, key, label, value, confidence``.
    """
    out = docs
    for name, value in (("folder", folder), ("status", status)):
        out = out if value is None else out.where(F.col(name) == value)
    out = out.join(_field_lists(fields), "doc_id", "left")
    word = (keyword or "").strip().lower()
    return out.where(haystack(out).contains(word)) if word else out


def excerpt(text: Column | str, keyword: str) -> Column:
    """Text around the first place of the keyword, else from the start, clipped; null for a blank text."""
    word = keyword.strip().lower()
    clip = lambda t: F.when(F.length(t) > EXCERPT, F.concat(F.substring(t, 1, EXCERPT), F.lit("…"))).otherwise(t)

    def around(t: Column) -> Column:
        if not word:
            return clip(t)
        at = F.instr(F.lower(t), word) - 1
        start, end = F.greatest(at - BEFORE, F.lit(0)), F.least(F.length(t), at + len(word) + AFTER)
        piece = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(t, start + 1, end - start), F.when(end < F.length(t), "…").otherwise(""))
        return F.when(at < 0, clip(t)).otherwise(clip(piece))

    return let(strip(col(text)), lambda t: F.when(t != "", around(t)))


def export_rows(matches: DataFrame, keyword: str) -> DataFrame:
    """``id``, metadata, ``header``, ``fields`` and ``text_excerpt`` of each match; storage keys and digests are left out."""
    header = F.struct(*(F.col(c) for c in HEADER if c in matches.columns))
    return matches.select(F.col("doc_id").alias("id"), *(c for c in EXPORTED if c in matches.columns), header.alias("header"), "fields", excerpt("text", keyword).alias("text_excerpt"))


def export_name(keyword: Column | str, exported_at: Column | str) -> Column:
    """File name of an export: the keyword as a slug and the day."""
    word, when = (F.lit(x) if isinstance(x, str) else x for x in (keyword, exported_at))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(word), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, SLUG)
    day = let(F.substring(when, 1, 10), lambda d: F.when(d == "", "export").otherwise(d))
    return let(slug, lambda s: F.when(s != "", F.concat(F.lit("people-docs-"), s, F.lit("-"), day, F.lit(".json"))).otherwise(F.concat(F.lit("people-docs-search-"), day, F.lit(".json"))))


def save_export(matches: DataFrame, keyword: str, exported_at: str, root: str) -> tuple[str, int]:
    """Write the matches as JSON lines and a head with keyword, time and their number; gives the folder and the number."""
    spark, seen = matches.sparkSession, Observation("matches")
    name = spark.range(1).select(export_name(keyword.strip(), exported_at)).first()[0]
    folder = f"{root.rstrip('/')}/{name}"
    export_rows(matches, keyword).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{folder}/docs")
    head = spark.createDataFrame([(keyword.strip(), exported_at, seen.get["n"])], "keyword string, exportedAt string, matchCount bigint")
    head.coalesce(1).write.mode("overwrite").json(f"{folder}/head")
    return folder, seen.get["n"]
