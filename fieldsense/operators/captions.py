"""Labels of recordings from their captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsense.functions.text import named_codes
from fieldsense.operators.dedupe import conflicting

# Words of sentences that only compare, and where a caption's sentences end.
COMPARISON = r"(?i)\b(?:compare|similar|same as|identical|unlike|resembl)"
SENTENCE_END = r"(?<=[.!?)])\s+"


def said(caption: Column, names: dict[str, str]) -> Column:
    """The species codes that each sentence names, without sentences that compare."""
    told = F.filter(F.split(F.coalesce(caption, F.lit("")), SENTENCE_END), lambda s: ~s.rlike(COMPARISON))
    return F.transform(told, lambda s: named_codes(s, names))


def assign_labels(recordings: DataFrame, names: dict[str, str], overrides: DataFrame | None = None) -> DataFrame:
    """recordings (recording_id, code, url, caption) -> recording_id, url, label, label_source, needs_review, secondary.

    names: species code by name. The page's species is the label unless the first sentence names exactly one other; if it
    names several others and not the page's, the page's stays and needs review. Species named anywhere else are
    secondary. overrides (file, label, secondary) come last, by the URL's file name. Recordings of one URL that end with
    different labels need review.
    """
    heard = recordings.select("recording_id", "code", "url", said(F.col("caption"), names).alias("__said"))
    opening = F.coalesce(F.get("__said", F.lit(0)), F.array().cast("array<string>"))
    others = F.when(F.array_contains(opening, F.col("code")), F.array().cast("array<string>")).otherwise(opening)
    judged = heard.withColumn("__others", others).withColumn("label", F.when(F.size("__others") == 1, F.get("__others", F.lit(0))).otherwise(F.col("code")))
    out = judged.select(
        "recording_id", "url", "label", F.when(F.col("label") != F.col("code"), "caption").otherwise("page").alias("label_source"),
        (F.size("__others") > 0).alias("needs_review"), F.array_except(F.flatten("__said"), F.array("label")).alias("secondary"),
    )
    if overrides is not None:
        fixed = overrides.select(F.col("file").alias("__file"), F.col("label").alias("__label"), F.coalesce("secondary", F.array().cast("array<string>")).alias("__secondary"))
        name = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
        out = out.join(fixed, name == F.col("__file"), "left")
        is_fixed = F.col("__file").isNotNull()
        out = out.select(
            "recording_id",
            "url",
            F.coalesce("__label", "label").alias("label"),
            F.when(is_fixed, "override").otherwise(F.col("label_source")).alias("label_source"),
            (F.col("needs_review") & ~is_fixed).alias("needs_review"),
            F.coalesce("__secondary", "secondary").alias("secondary"),
        )
    return conflicting(out, "url", "label").withColumn("needs_review", F.col("needs_review") | F.col("conflict")).drop("conflict")
