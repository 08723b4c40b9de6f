"""Which words of a recognised page a search marks: substring matches over a line's words, phrases included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCR_LINES = "array<struct<text:string,words:array<struct<text:string,x:double,y:double,width:double,height:double>>>>"


def full_text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda line: line["text"]), "\n")


def from_json(text: Column) -> Column:
    """Stored lines; none gives an empty list."""
    return F.coalesce(F.from_json(text, OCR_LINES), F.array().cast(OCR_LINES))


def rescale(lines: Column, scale: float) -> Column:
    """Boxes of a page that was read at another size."""
    box = lambda w: F.struct(w["text"].alias("text"), *[(w[k] / scale).alias(k) for k in ("x", "y", "width", "height")])
    return F.transform(lines, lambda line: F.struct(line["text"].alias("text"), F.transform(line["words"], box).alias("words")))


def padded(words: Column, share: float = 0.2) -> Column:
    """Boxes as they are drawn: larger on every side by a share of the word's height."""
    more = lambda w: w["height"] * share
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), (w["x"] - more(w)).alias("x"), (w["y"] - more(w)).alias("y"), (w["width"] + 2 * more(w)).alias("width"), (w["height"] + 2 * more(w)).alias("height")))


def outline_words(lines: DataFrame, terms: list[str], keys: list[str], words: str = "words") -> DataFrame:
    """Adds ``marked``: zero-based places of the words that a match of any term overlaps.

    Each row is one line with an array of words.  The line is rebuilt with one space between words, so a
    phrase may span words but not lines; overlapping matches all count; terms of one character don't.
    """
    needles = [t.lower() for t in terms if len(t) >= 2]
    low = F.transform(F.col(words), lambda w: F.lower(w))
    text = F.array_join("_low", " ")
    # Offset of each word in the rebuilt line.
    ends = F.aggregate("_low", F.array().cast("array<int>"), lambda acc, w: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) + 1 + F.length(w))))
    found = F.array().cast("array<struct<s:int,e:int>>")
    for n in needles:
        places = F.sequence(F.lit(1), F.greatest(F.length("_line"), F.lit(1)))
        found = F.concat(found, _matches(places, n))
    marked = F.filter(F.sequence(F.lit(0), F.size("_low") - 1), lambda i: F.exists("_found", lambda m: (m["s"] < F.element_at("_ends", i + 1)) & (m["e"] > F.element_at("_ends", i + 1) - F.length(F.element_at("_low", i + 1)))))
    # Exploding one struct keeps what it holds from being computed anew inside each lambda.
    held = lines.withColumn("_low", low).where(F.size("_low") > 0).withColumn("_once", F.explode(F.array(F.struct("_low", text.alias("_line"), ends.alias("_ends")))))
    held = held.select(*keys, words, "_once._low", "_once._line", "_once._ends").where(reduce(lambda a, n: a | F.contains(F.col("_line"), F.lit(n)), needles, F.lit(False)))
    held = held.withColumn("_found", F.explode(F.array(found)))
    return held.where(F.size("_found") > 0).select(*keys, words, marked.alias("marked"))


def _matches(places: Column, needle: str) -> Column:
    """(s, e) of every place where the needle stands in the line."""
    hits = F.filter(places, lambda i: F.substr(F.col("_line"), i, F.lit(len(needle))) == needle)
    spans = F.transform(hits, lambda i: F.struct((i - 1).cast("int").alias("s"), (i - 1 + len(needle)).cast("int").alias("e")))
    return F.when(F.contains(F.col("_line"), F.lit(needle)), spans).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
