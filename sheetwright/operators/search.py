"""Substring search for many terms by trigram postings.

Postings say in which field of which chemical three characters follow each other. A term is looked up by its rarest
trigrams only, so common ones are hardly ever read; what has all of them is verified against the texts. The result is
what ``contains`` finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.functions.text import lower_tr

#: Trigrams by which a term is looked up, at most.
RAREST = 3


def _grams(text: Column) -> Column:
    size = F.greatest(F.length(text) - 2, F.lit(0))
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(3))))


def _texts(chemicals: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(id, field, text): the fields in Turkish lower case."""
    each = F.array(*[F.struct(F.lit(i).alias("field"), lower_tr(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("text")) for i, f in enumerate(fields)])
    return chemicals.select(F.col(key).alias("id"), F.explode(each).alias("t")).select("id", "t.*").where("text <> ''")


def postings(chemicals: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(gram, id, field): the index of the texts. It may be written, and read for any number of searches."""
    return _texts(chemicals, fields, key).select(F.explode(_grams(F.col("text"))).alias("gram"), "id", "field")


def _rarest(grams: DataFrame, holders: DataFrame, most: int) -> DataFrame:
    """The rows of ``grams`` (term, gram) with the ``most`` rarest grams of each term in ``holders``, and how many of them hold it."""
    known = grams.select("gram").distinct()
    counts = holders.join(known, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    ranked = grams.join(counts, "gram", "left").fillna(0, ["n"]).withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy("n", "gram")))
    return ranked.where(F.col("place") <= most)


def candidates(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id, field) that hold the rarest trigrams of a term of three characters or more."""
    asked = terms.select("term", lower_tr(F.trim("term")).alias("low")).where(F.length("low") >= 3).distinct()
    grams = asked.select("term", F.explode(_grams(F.col("low"))).alias("gram"))
    rare = _rarest(grams, index, RAREST).withColumn("wanted", F.count("*").over(Window.partitionBy("term")))  # grams of one term
    return rare.join(index, "gram").groupBy("term", "id", "field").agg(F.count("*").alias("has"), F.first("wanted").alias("wanted")).where("has = wanted").select("term", "id", "field")


def _scanned(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id) without an index: texts meet the terms whose rarest trigram they hold, and are compared where they meet."""
    asked = terms.select("term", lower_tr(F.trim("term")).alias("low")).where(F.length("low") >= 3).distinct()
    grams = asked.select("term", "low", F.explode(_grams(F.col("low"))).alias("gram"))
    held = texts.select("id", "text", F.explode(_grams(F.col("text"))).alias("gram"))
    rare = _rarest(grams, held.select("gram"), 1).where("n > 0").select("term", "low", "gram")
    return held.join(rare, "gram").where(F.contains(F.col("text"), F.col("low"))).select("term", "id")


def search_terms(chemicals: DataFrame, terms: DataFrame, fields: list[str], index: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(term, id): the chemicals of which a field holds a term, by Turkish lower case, each once.

    ``terms`` has a column ``term``; surrounding blanks don't count, null and blank terms find nothing here. ``index`` is
    what ``postings`` gave for the same chemicals and fields. Terms of one or two characters have no trigrams: the few
    that there can be are compared with every text.
    """
    texts = _texts(chemicals, fields, key)
    low = lower_tr(F.trim("term"))
    if index is None:
        found = _scanned(texts, terms)
    else:
        found = candidates(index, terms).join(texts, ["id", "field"]).where(F.contains(F.col("text"), low)).select("term", "id")
    short = terms.select("term", low.alias("low")).where("length(low) between 1 and 2").distinct()
    near = texts.join(short, F.contains(texts["text"], short["low"])).select("term", "id")
    return found.unionByName(near).distinct()
