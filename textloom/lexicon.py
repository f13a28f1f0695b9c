"""The dictionary: tables of tokens, word senses, categories and tags, and the small inline rule tables.

A lexicon is a folder of Parquet tables (see the README). Exact duplicate rows count once; of a token id that was
deleted and loaded again the load that is alive counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.errors import LoadError
from textloom.sources import read_table, table_path

TABLES = ("pos_tags", "categories", "lexicon_tokens", "lexicon_pos")

#: Words that stand for something else: contractions, number words, units of time, weekdays, months. Our own lists.
CONTRACTIONS = {
    "don't": "do not", "doesn't": "does not", "didn't": "did not", "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not", "won't": "will not", "wouldn't": "would not", "can't": "can not", "couldn't": "could not",
    "shouldn't": "should not", "mustn't": "must not", "haven't": "have not", "hasn't": "has not", "hadn't": "had not", "i'm": "i am", "i've": "i have", "i'll": "i will", "i'd": "i would", "you're": "you are", "you've": "you have", "you'll": "you will",
    "we're": "we are", "we've": "we have", "we'll": "we will", "they're": "they are", "they've": "they have", "they'll": "they will", "it's": "it is", "that's": "that is", "there's": "there is", "let's": "let us", "he's": "he is", "she's": "she is",
}
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
MONTHS = "january february march april may june july august september october november december".split()
DATE_UNITS = ("day", "week", "month", "year", "decade", "century")
TIME_UNITS = ("second", "minute", "hour")
ORDINAL_SUFFIXES = ("st", "nd", "rd", "th")


def preprocess_rows() -> list[tuple[str, str, str]]:
    """Rows ``word, tag, value`` of the look-up before the dictionary."""
    rows = [(w, "|contraction|", v) for w, v in CONTRACTIONS.items()]
    rows += [(w, "|num|", str(i)) for i, w in enumerate(NUMBER_WORDS)]
    rows += [(w, "|day_of_week|", w) for w in WEEKDAYS] + [(w, "|month|", w) for w in MONTHS]
    rows += [(p, tag, u) for units, tag in ((DATE_UNITS, "|date_period|"), (TIME_UNITS, "|time_period|")) for u in units for p in (u, "centuries" if u == "century" else u + "s")]
    return rows + [(s, "|ordinal|", s) for s in ORDINAL_SUFFIXES] + [("s", "|date_period|", "s")]


def distinct_stream(stream: DataFrame, *columns: str) -> DataFrame:
    """Token rows with ``columns`` (all by default), each key once: of several deliveries the first, of those at one time
    that of the least hash of these columns, so that all values are of one delivery.

    One shuffle by input serves the deduplication and all windows over an input behind it. Only the columns named are read.
    """
    rest = [c for c in columns or stream.columns if c not in ("input_id", "seq")]
    kept = stream.select("input_id", "seq", "ingested_at", *(c for c in rest if c != "ingested_at"))
    first = F.min_by(F.struct(*rest), F.struct("ingested_at", F.xxhash64(*rest)))
    return kept.repartition("input_id").groupBy("input_id", "seq").agg(first.alias("_")).select("input_id", "seq", "_.*")


@dataclass
class Lexicon:
    spark: SparkSession
    base: str
    pos_tags: DataFrame
    categories: DataFrame
    tokens: DataFrame
    senses: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, base: str) -> Lexicon:
        """Reads all tables of a folder; LoadError if one is missing."""
        try:
            found = {t: read_table(spark, base, t) for t in TABLES}
        except Exception as e:
            raise LoadError(f"no lexicon in {base}: {e}") from e
        alive = found["lexicon_tokens"].where("deleted_at is null")
        latest = Window.partitionBy("token_id").orderBy(F.col("loaded_at").desc())
        tokens = alive.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
        senses = found["lexicon_pos"].select("word", "ord", "pos", "token_id").distinct()
        return cls(spark, base, found["pos_tags"], found["categories"].where("deleted_at is null"), tokens, senses)

    def save(self, base: str) -> None:
        """Writes all tables as Parquet."""
        from textloom.errors import SaveError

        try:
            for name, df in (("pos_tags", self.pos_tags), ("categories", self.categories), ("lexicon_tokens", self.tokens), ("lexicon_pos", self.senses)):
                df.write.mode("overwrite").parquet(table_path(base, name))
        except Exception as e:
            raise SaveError(f"cannot write to {base}: {e}") from e

    def meta(self, language: str = "en", version: tuple[int, int, int] = (1, 0, 0), author: str = "") -> DataFrame:
        """One row of metadata with a hash of the senses, independent of their order."""
        digest = F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.col("h")))), 256)
        parts = self.senses.groupBy(F.pmod(F.xxhash64("word"), F.lit(64)).alias("part")).agg(F.bit_xor(F.xxhash64("word", "ord", "pos", "token_id")).cast("string").alias("h"))
        return parts.agg(digest.alias("sha256")).select(F.lit(".".join(map(str, version))).alias("version"), F.lit(language).alias("language"), F.lit(author).alias("author"), "sha256")

    def preprocess(self) -> DataFrame:
        return self.spark.createDataFrame(preprocess_rows(), "word string, tag string, value string")

    def phrases(self) -> DataFrame:
        """``phrase, n, mwe_type, token_id``: the dictionary's entries of several words, which serve both views."""
        words = F.split(F.trim(F.lower("word")), r"\s+")
        own = self.tokens.where(F.col("word").contains(" ")).select(F.array_join(words, " ").alias("phrase"), F.size(words).alias("n"), F.lit("both").alias("mwe_type"), "token_id").where("n >= 2")
        return own.groupBy("phrase", "n", "mwe_type").agg(F.min("token_id").alias("token_id"))

    def default_senses(self) -> DataFrame:
        """``word, pos, token_id, potential_pos``: the first sense of each word, and all its tags in order."""
        return self.senses.groupBy("word").agg(F.min_by("pos", "ord").alias("pos"), F.min_by("token_id", "ord").alias("token_id"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos"))), lambda s: s["pos"]).alias("potential_pos"))
