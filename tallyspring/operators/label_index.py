"""An inverted index of labels: postings by word, a list of words for prefixes, both kept up with the labels.

``postings``, ``matching`` and ``found`` are the operators over any rows. Over a lake's tables, ``put_accounts`` writes
labels and their index, and ``search`` reads the buckets of the words that it is asked for: postings lie in hash buckets
of the word, and the list of words in buckets of its first two letters. Words are runs of letters, digits and ``_``
in lower case, as written, without stemming.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspring.operators import deltas
from tallyspring.schemas import table_schema

ACCOUNTS, POSTINGS, WORDS = "known_accounts", "label_postings", "label_words"
#: Letters of a word that tell its bucket in the list of words.
STEM = 2


def words_of(text: Column) -> Column:
    """The distinct words of a text; none for a null."""
    return F.coalesce(F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")), F.array().cast("array<string>"))


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, id) once for each word of a text."""
    return df.select(F.explode(words_of(F.col(text_col))).alias("word"), F.col(id_col).alias("id"))


def with_stem(words: DataFrame) -> DataFrame:
    return words.select(F.substring("word", 1, STEM).alias("stem"), "word").distinct()


def terms_table(spark: SparkSession, terms: list[str]) -> DataFrame:
    """(term, word, is_prefix) of what is asked for: words, or beginnings of words that end in ``*``."""
    told = [(i, t.lower().removesuffix("*"), t.endswith("*")) for i, t in enumerate(terms)]
    return spark.createDataFrame(told, "term int, word string, is_prefix boolean")


def matching(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(term, word): the words that a term stands for. A prefix finds its words in the list, by a range of words."""
    exact = terms.filter("NOT is_prefix").select("term", "word")
    starts = terms.filter("is_prefix").select("term", F.col("word").alias("start"))
    # as many terms as were asked for, so they go to each task that reads words
    return exact.unionByName(words.join(F.broadcast(starts), F.col("word").startswith(F.col("start"))).select("term", "word"))


def found(entries: DataFrame, wanted: DataFrame, at_least: int) -> DataFrame:
    """Ids with at least so many of the terms; an id with several words of a term has it once.

    A word that very many texts have isn't a group of its own: the groups are ids.
    """
    hits = entries.join(wanted, "word").groupBy("id").agg(F.count_distinct("term").alias("n_terms"))
    return hits.filter(F.col("n_terms") >= at_least).select("id")


def _read(spark: SparkSession, folder: str, table: str, keys: DataFrame) -> DataFrame:
    """A table's rows in the buckets of some keys; the buckets are bounded in number."""
    chunks = [r[0] for r in deltas.placed(keys, table).select(deltas.CHUNK).distinct().collect()]
    at = deltas.layout(spark, folder, table)
    for part in (at.bases, at.rows, at.deletes):
        for chunk in [c for c in part if c not in chunks]:
            del part[chunk]
    return deltas.read(spark, folder, table, at)


def _fits(term: str) -> Callable[[Column], Column]:
    word = term.lower().removesuffix("*")
    return lambda w: w.startswith(word) if term.endswith("*") else w == word


def search(spark: SparkSession, folder: str, terms: list[str], *, every: bool = True) -> DataFrame:
    """Known accounts whose label has all of the terms, or any of them; a term that ends in ``*`` is a beginning of words.

    No terms find nothing, and neither does a term without a letter. What the postings tell is held against the labels,
    so entries of a label that has changed since don't show.
    """
    asked = terms_table(spark, terms)
    starts = asked.filter("is_prefix")
    words = deltas.read(spark, folder, WORDS).limit(0)
    if any(t.endswith("*") for t in terms):
        short = any(t.endswith("*") and len(t) - 1 < STEM for t in terms)
        words = deltas.read(spark, folder, WORDS) if short else _read(spark, folder, WORDS, starts.select(F.substring("word", 1, STEM).alias("stem")))
    wanted = matching(asked, words.select("word").distinct())
    wanted = wanted.filter("word <> ''").persist()
    try:
        entries = _read(spark, folder, POSTINGS, wanted.select("word")).select("word", F.col("address").alias("id"))
        least = len(terms) if every else 1
        ids = found(entries, wanted, max(least, 1)).select(F.col("id").alias("address")).persist()
        try:
            accounts = _read(spark, folder, ACCOUNTS, ids).join(ids, "address", "left_semi").drop(deltas.CHUNK)
            has = [F.exists(words_of(F.col("label")), _fits(t)) for t in terms]
            told = F.array_size(F.filter(F.array(*has), lambda x: x)) >= max(least, 1) if has else F.lit(False)
            return accounts.filter(told)
        finally:
            ids.unpersist()
    finally:
        wanted.unpersist()


def put_accounts(accounts: DataFrame, folder: str) -> None:
    """Adds known accounts, or puts them in place of those with their addresses, and keeps the index up.

    Of several rows of one address the newest counts (by updated_at, then by the order of their JSON); a null address is
    left out. New entries are written first, then the labels, then what no label has any more is taken back: a crash in
    between leaves entries that searches pass over, and no label without its entries. A replay ends in the same state.
    """
    spark = accounts.sparkSession
    columns = [f.name for f in table_schema(ACCOUNTS).fields]
    newest = Window.partitionBy("address").orderBy(F.desc_nulls_last("updated_at"), F.to_json(F.struct(*columns)))
    new = accounts.filter("address IS NOT NULL").select(*columns).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n").persist()
    try:
        old = deltas.touched(spark, folder, ACCOUNTS, new.select("address"))
        before, after = (postings(df, "address", "label").withColumnRenamed("id", "address").persist() for df in (old, new))
        gone = before.join(after, ["word", "address"], "left_anti").persist()
        gone.count()  # read before the labels change
        deltas.put(after, folder, POSTINGS)
        stems = with_stem(after).persist()
        there = _read(spark, folder, WORDS, stems.select("stem").distinct())
        deltas.commit(stems.join(there, ["stem", "word"], "left_anti"), folder, WORDS)
        deltas.put(new, folder, ACCOUNTS)
        deltas.commit(spark.createDataFrame([], table_schema(POSTINGS)), folder, POSTINGS, deletes=gone)
        for df in (before, after, gone, stems):
            df.unpersist()
    finally:
        new.unpersist()
