"""Problem 1: languages of documents and of the passages of mixed ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm import langid
from papyrine.plans.layout import spread

#: Labelled sentences of each language that the classifier is fitted on, at most (the smallest sample_id first).
MAX_SAMPLES = 700

# Spellings of language labels.
LABELS = {
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "alemão", "tedesco", "duits"],
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés", "inglês", "inglese", "engels"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "niederländisch", "néerlandais", "neerlandés", "neerlandês", "holandés", "holandês", "olandese"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "espanhol", "spagnolo", "spaans"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "francês", "francese", "frans"],
    "it": ["it", "ita", "italian", "italiano", "italienisch", "italien", "italiaans"],
    "pt": ["pt", "por", "portuguese", "português", "portugues", "portugiesisch", "portugais", "portugués", "portoghese", "portugees"],
}


def fit(samples: DataFrame) -> langid.LanguageModel:
    """Fits the hierarchical classifier on a bounded sample of labelled rows (``lang``, ``text``), the same bound for each language."""
    first = Window.partitionBy("lang").orderBy("sample_id", "text")
    rows = samples.where(F.col("lang").isin(*langid.LANGS) & F.col("text").isNotNull()).withColumn("n", F.row_number().over(first)).where(F.col("n") <= MAX_SAMPLES)
    return langid.train([(r.lang, r.text) for r in rows.orderBy("sample_id", "text").select("lang", "text").collect()])


def label_code(label):
    """Two-letter code that a label names in any usual spelling (case, region, name), else null."""
    base = F.regexp_replace(F.lower(F.trim(label)), r"[-_](?:[a-z]{2}|[a-z]{4}|[0-9]{3})$", "")
    pairs = [F.lit(x) for code, names in LABELS.items() for n in names for x in (n, code)]
    return F.element_at(F.create_map(*pairs), base)


def language_segments(documents: DataFrame, model: langid.LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, label, segments, seg_no, lang, confidence, first_char, end_char): the maximal stretches of one language.

    Null and wordless texts give no row. A stretch has at least ``langid.MIN_WORDS``
    words. Texts are taken whole whatever their length; repeated rows are each done;
    other columns are ignored.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    label = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    source = spread(documents.select(F.col(key).cast("long").alias("doc_id"), label.alias("label"), F.col(text).alias("text")).where("text is not null"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                found = langid.stretches_many(m, part["text"].tolist())
                rows = [(d, x, len(segments), *s) for d, x, segments in zip(part["doc_id"], part["label"], found) for s in segments]
                yield pd.DataFrame(rows, columns=["doc_id", "label", "segments", "seg_no", "lang", "confidence", "first_char", "end_char"])

    return source.mapInPandas(run, "doc_id long, label string, segments int, seg_no int, lang string, confidence double, first_char int, end_char int")


def wrong_labels(segments: DataFrame) -> DataFrame:
    """Segments of documents whose label does not name their one language, or that hold several."""
    code = label_code(F.col("label"))
    return segments.where((F.col("segments") > 1) | code.isNull() | (code != F.col("lang")))
