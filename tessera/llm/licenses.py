"""License scans by diagonal voting.

1. Every run of GRAM words of every text is hashed and joined with the places of such runs in the templates.  A
   match at word i of the text and word p of the template votes for the diagonal i - p.
2. Votes are summed by text, template and diagonal.  Diagonals of one template that are a few words apart are merged:
   between them the text has a few words more or less than the template.
3. A merged span with enough votes for the template to be there is verified on the words: the share of the
   template's words that stand on one of the span's diagonals must reach ``least``.  How many votes that takes follows
   from ``least``: a word that differs spoils at most GRAM runs.

Templates without slack are phrases: they are found where all their words stand consecutively.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import Words, slices, windows
from .store import beside, park


class Template(NamedTuple):
    label: str
    text: str
    #: Counted as a phrase: consecutive words, each place for itself.
    phrase: bool = False


#: Phrases and their labels.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Notices that public licenses ask for or begin with.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mit", "released under the mit license"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    Template("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
TEMPLATES = PHRASES + NOTICES
GRAM, LEAST = 3, 0.8
#: Diagonals of a template of n words are merged if they are n // SLACK words apart.
SLACK = 8
#: Words are runs of letters and digits, and of characters beyond ASCII.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def slack_of(t: Template) -> int:
    return 0 if t.phrase else len(t.text.split()) // SLACK


def votes_needed(t: Template, least: float, gram: int = GRAM) -> int:
    """Fewest runs that a span shares with the template if the share of equal words is ``least`` (1 for phrases)."""
    n = len(t.text.split())
    differ = 0 if t.phrase else math.floor(n * (1 - least) + 1e-9)
    return max(1, n - gram + 1 - gram * differ)


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, NOT_WORD, fold=True)


def template_hashes(templates: tuple[Template, ...]) -> list[np.ndarray]:
    """The hashes of each template's words."""
    out = []
    for t in templates:
        raw = t.text.encode()
        out.append(_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes())
    return out


def _grams(docs: DataFrame, gram: int) -> DataFrame:
    """(_id, _raw, _place, _gram): all runs of ``gram`` words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raws = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j, data, offsets in slices(b.column(2)):
                w = _words(data, offsets)
                runs = windows(w.hashes(), gram)
                row = np.repeat(np.arange(j - i), w.count)
                at = np.flatnonzero(row[gram - 1 :] == row[: len(runs)])
                own = row[at]
                cols = (ids[i:j][own], raws[i:j][own], (at - w.bounds[own]).astype(np.int32), runs[at].view(np.int64))
                for k in range(0, len(at), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in cols], names=["_id", "_raw", "_place", "_gram"])

    return docs.mapInArrow(run, "_id long, _raw long, _place int, _gram long")


def _counted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [_words(data, offsets).count for _, _, data, offsets in slices(b.column(2))]
            n = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(0), b.column(1), n], names=["_doc", "_id", "_raw", "_n"])

    kind = docs.schema["_doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"_doc {kind}, _id long, _raw long, _n long")


def _spans(docs: DataFrame, templates: tuple[Template, ...], least: float, gram: int) -> DataFrame:
    """(_id, _raw, _template, _diagonals): merged diagonals with enough votes."""
    hashes = template_hashes(templates)
    places = [(int(h), k, p, slack_of(templates[k]), votes_needed(templates[k], least, gram)) for k, words in enumerate(hashes) for p, h in enumerate(windows(words, gram).view(np.int64))]
    known = docs.sparkSession.createDataFrame(places, "_g long, _template int, _p int, _slack int, _need int")
    hits = _grams(docs, gram).join(beside(known, len(places)), F.col("_gram") == F.col("_g"))
    # Rows that repeat an id and a text vote for the same places.
    doc = ["_id", "_raw", "_template", "_slack", "_need"]
    voted = hits.groupBy(*doc, (F.col("_place") - F.col("_p")).alias("_diagonal")).agg(F.collect_set("_p").alias("_at"))
    line = Window.partitionBy("_id", "_raw", "_template").orderBy("_diagonal")
    new = (F.col("_diagonal") - F.lag("_diagonal").over(line) > F.col("_slack")).cast("int")
    merged = voted.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("_span", F.sum("_new").over(line))
    spans = merged.groupBy(*doc, "_span").agg(F.collect_list("_diagonal").alias("_diagonals"), F.size(F.array_distinct(F.flatten(F.collect_list("_at")))).alias("_votes"))
    return park(spans.where("_votes >= _need").select("_id", "_raw", "_template", "_diagonals"))


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """_id and _raw name a row's text; a null id counts as the least long there, which costs nothing: an answer depends on the text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = F.xxhash64(F.col(id_col)) if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint") else F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    return docs.select(own.alias("_id"), F.xxhash64(body).alias("_raw"), body.alias("_text"), F.col(id_col).alias("_doc"))


def _verified(keyed: DataFrame, templates: tuple[Template, ...], least: float, gram: int) -> DataFrame:
    """(_id, _raw, template, first, last, share, label, phrase, passage) of verified spans; ``last`` is the last word."""
    spans = _spans(keyed, templates, least, gram)
    names = spans.select("_id", "_raw").distinct()
    names = beside(names.select(F.col("_id").alias("_i"), F.col("_raw").alias("_r")), spans.count())
    # Only texts with a span travel, one row for each id and text.
    held = keyed.join(names, (F.col("_id") == F.col("_i")) & (F.col("_raw") == F.col("_r")), "left_semi")
    texts = held.groupBy("_id", "_raw").agg(F.max("_text").alias("_text"))
    asked = spans.groupBy(F.col("_id").alias("_i"), F.col("_raw").alias("_r")).agg(F.collect_list(F.struct("_template", "_diagonals")).alias("_spans"))
    hashes, words = template_hashes(templates), [t.text.split() for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column(2)):
                w = _words(data, offsets)
                h, raw, out = w.hashes(), data.tobytes(), []
                for r in range(i, j):
                    low = int(w.bounds[r - i])
                    own = h[low : int(w.bounds[r - i + 1])]
                    for span in b.column(3)[r].as_py():
                        k = span["_template"]
                        first, last, share = align(own, hashes[k], span["_diagonals"])
                        if share < (1 if templates[k].phrase else least) - 1e-9:
                            continue
                        begin, end = int(w.start[low + first]), int(w.end[low + last])
                        # Phrases are held against the words themselves.
                        if templates[k].phrase and [raw[w.start[x] : w.end[x]].lower().decode() for x in range(low + first, low + last + 1)] != words[k]:
                            continue
                        out.append((b.column(0)[r].as_py(), b.column(1)[r].as_py(), k, first, last, share, raw[begin:end].decode()))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["_id", "_raw", "template", "first", "last", "share", "passage"])

    joined = texts.join(asked, (F.col("_id") == F.col("_i")) & (F.col("_raw") == F.col("_r"))).select("_id", "_raw", "_text", "_spans")
    found = joined.mapInArrow(run, "_id long, _raw long, template int, first long, last long, share double, passage string")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("template") + 1)
    return park(found.withColumn("label", of([t.label for t in templates])).withColumn("phrase", of([t.phrase for t in templates])))


def align(words: np.ndarray, template: np.ndarray, diagonals: list[int]) -> tuple[int, int, float]:
    """(first and last word of the text that stand on a diagonal, share of the template's words that do)."""
    held, low, high = np.zeros(len(template), bool), len(words), -1
    for d in diagonals:
        p = np.arange(max(0, -d), min(len(template), len(words) - d))
        p = p[words[p + d] == template[p]]
        if len(p):
            held[p] = True
            low, high = min(low, d + int(p[0])), max(high, d + int(p[-1]))
    return low, high, float(held.sum()) / len(template)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST, gram: int = GRAM) -> DataFrame:
    """The places where templates stand: id, template (its number), label, phrase, first and last word, share, passage.

    Rows that repeat an id and a text share their spans, which come once.  See :func:`scan_licenses` for the rest.
    """
    keyed = _keyed(docs, id_col, text)
    found = _verified(keyed, templates, least, gram).withColumnsRenamed({"_id": "_i", "_raw": "_r"})
    same = (F.col("_id") == F.col("_i")) & (F.col("_raw") == F.col("_r"))
    names = keyed.join(beside(found.select("_i", "_r").distinct(), found.count()), same, "left_semi").select("_id", "_raw", "_doc").distinct()
    return names.join(found, same).select(F.col("_doc").alias(id_col), "template", "label", "phrase", "first", "last", "share", "passage")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST, gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of letters, digits and characters beyond ASCII, A-Z as a-z, numbered from 0.  n_base counts all places of
    phrases, overlapping ones too; first_word and last_word are the smallest and largest start of one.  base_labels are the
    phrases' labels, labels those of all verified spans, both distinct, sorted and joined by commas (empty where there
    are none).  score: the greatest share of a template's words that a verified span holds (1 for a phrase), else 0.

    Null and empty texts have no words; texts of any length are scanned whole.  Repeated rows get the same answer each, also
    those with a null id.  Templates must have at least ``gram`` words.  An empty table gives no rows; other columns are ignored.
    """
    if any(len(t.text.split()) < gram for t in templates):
        raise ValueError(f"templates need at least {gram} words")
    keyed = _keyed(docs, id_col, text)
    found = _verified(keyed, templates, least, gram)
    base = lambda c: F.when(F.col("phrase"), F.col(c))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    answers = found.groupBy(F.col("_id").alias("_i"), F.col("_raw").alias("_r")).agg(F.count(base("label")).alias("_base"), F.min(base("first")).alias("_first"), F.max(base("first")).alias("_last"), joined(base("label")).alias("_base_labels"), joined("label").alias("_labels"), F.max("share").alias("_score"))
    # Parked, the answers have a known size, and copies that all ask for one answer are a skewed join, which Spark splits.
    out = _counted(keyed).join(park(answers), (F.col("_id") == F.col("_i")) & (F.col("_raw") == F.col("_r")), "left")
    none = F.lit("")
    return out.select(F.col("_doc").alias(id_col), F.col("_n").alias("n_words"), F.coalesce("_base", F.lit(0).cast("long")).alias("n_base"), F.col("_first").alias("first_word"), F.col("_last").alias("last_word"), F.coalesce("_base_labels", none).alias("base_labels"), F.coalesce("_labels", none).alias("labels"), F.round(F.coalesce("_score", F.lit(0.0)), 6).alias("score"))
