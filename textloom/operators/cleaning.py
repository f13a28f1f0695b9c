"""From text to words and their shapes, without Python in the executors' hot path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Symbols peeled off words, as a character class.
SPECIALS = r"~`!@#$%&*()\-_+\[\]{}\\|;:'\",.<>"
NEWLINE = "|NL|"


def clean(text: Column) -> Column:
    """Text without symbols that lead lines, with a marker after each line, in printable ASCII."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.concat(F.trim(F.regexp_replace(x, r"^[-_=#@!]+", " ")), F.lit(f" {NEWLINE}")))
    return F.regexp_replace(F.array_join(lines, " "), r"[^\x20-\x7E]", "")


def words_of(text: Column) -> Column:
    """The words of the cleaned text: split at single spaces, no empty words, without the last marker."""
    ws = F.filter(F.split(clean(text), " "), lambda w: w != "")
    return F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0)))


def clean_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, word``: one row per word; null texts have none."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(words_of(F.col(text))).alias("pos", "word"))


_NUMBER = r"^[-+$]?[0-9,]*[0-9][0-9,]*(?:[.^*/:][0-9,]*)?$"


def shape(word: Column) -> Column:
    """A struct of a word's parts and kind.

    ``prefix`` holds the symbols before a word, ``suffix`` all that is behind its last letter or digit, in source order, ``core`` what is left, ``is_possessive`` whether a
    final 's was taken off; ``kind`` is newline, symbol, time, decade, number, number_unit or word; ``number`` and
    ``unit`` belong to decades and numbers with a unit.
    """
    head = F.regexp_extract(word, rf"^([{SPECIALS}]*?)(?:[-+$](?=[0-9])|[^{SPECIALS}]|$)", 1)
    body = F.substring(word, F.length(head) + 1, F.length(word))
    tail = F.regexp_extract(body, r"([^A-Za-z0-9]*)$", 1)
    core = F.substring(body, F.lit(1), F.length(body) - F.length(tail))
    possessive = core.rlike("'s$") & (F.length(core) > 2)
    bare = F.when(possessive, F.substring(core, F.lit(1), F.length(core) - 2)).otherwise(core)
    time = bare.rlike(r"^(?:[0-9]|[01][0-9]|2[0-3]):[0-5][0-9]$") & ~bare.rlike("^0:")
    decade = bare.rlike(r"^(?:[0-9]0|[12][0-9][0-9]0)s$")
    number = bare.rlike(_NUMBER)
    with_unit = bare.rlike(r"^[-+$]?[0-9][0-9.,]*[A-Za-z]+$")
    kind = F.when(word == NEWLINE, "newline").when(bare == "", "symbol").when(time, "time").when(decade, "decade").when(number, "number").when(with_unit, "number_unit").otherwise("word")
    split = decade | with_unit
    return F.struct(
        F.when(word == NEWLINE, "").otherwise(head).alias("prefix"),
        F.when(word == NEWLINE, word).otherwise(bare).alias("core"),
        F.when(word == NEWLINE, "").otherwise(tail).alias("suffix"),
        possessive.alias("is_possessive"),
        kind.alias("kind"),
        F.when(split, F.regexp_extract(bare, r"^([-+$]?[0-9][0-9.,]*)", 1)).alias("number"),
        F.when(split, F.regexp_extract(bare, r"([A-Za-z]+)$", 1)).alias("unit"),
    )


def parts(words: DataFrame, key: str) -> DataFrame:
    """``key, pos, sub, part, token_type, is_possessive``: symbols before a word, its core, symbols behind it, in source order."""
    s = words.where(F.col("word") != NEWLINE).select(key, "pos", shape(F.col("word")).alias("s"))

    def chars(c: Column) -> Column:
        return F.filter(F.split(c, ""), lambda x: x != "")

    def part(x: Column, kind: str, possessive: Column) -> Column:
        return F.struct(x.alias("part"), F.lit(kind).alias("token_type"), possessive.alias("is_possessive"))

    all_ = F.concat(
        F.transform(chars(F.col("s.prefix")), lambda x: part(x, "prefix", F.lit(False))),
        F.when(F.col("s.core") == "", F.array()).otherwise(F.array(part(F.col("s.core"), "word", F.col("s.is_possessive")))),
        F.transform(chars(F.col("s.suffix")), lambda x: part(x, "suffix", F.lit(False))),
    )
    return s.select(key, "pos", F.posexplode(all_).alias("sub", "p")).select(key, "pos", "sub", "p.part", "p.token_type", "p.is_possessive")


def peel(words: DataFrame, key: str) -> DataFrame:
    """``key, pos, sub, part, token_type``: see ``parts``."""
    return parts(words, key).drop("is_possessive")


def expand(parts: DataFrame, preprocess: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, pos, sub, subsub, part, tag, value`` and the columns ``keep``: contractions split into their words, other special words tagged."""
    hit = parts.join(F.broadcast(preprocess.select(F.col("word").alias("_w"), "tag", "value")), F.lower("part") == F.col("_w"), "left")
    own = F.when(F.col("tag") == "|contraction|", F.split("value", " ")).otherwise(F.array("part"))
    return hit.select(key, "pos", "sub", F.posexplode(own).alias("subsub", "part"), "tag", F.when(F.col("tag") != "|contraction|", F.col("value")).alias("value"), *keep)


def special_tokens(words: DataFrame, preprocess: DataFrame, key: str) -> DataFrame:
    """``key, pos, core, tag, value, unit``: words that are numbers, times, periods or special words.

    Plain numbers are |num|, times |time|, decades |date_period|; a number with letters takes the tag of its letters if
    the look-up has them; other words take the tag of the look-up, contractions aside.
    """
    s = words.select(key, "pos", shape(F.col("word")).alias("s")).select(key, "pos", "s.core", "s.kind", "s.number", "s.unit")
    special = preprocess.where("tag <> '|contraction|'").select(F.col("word").alias("_w"), F.col("tag").alias("_tag"), F.col("value").alias("_value"))
    asked = F.when(F.col("kind") == "number_unit", F.col("unit")).when(F.col("kind") == "word", F.lower("core"))
    hit = s.withColumn("_ask", asked).join(special, F.col("_ask") == F.col("_w"), "left")
    tag = F.when(F.col("kind") == "number", "|num|").when(F.col("kind") == "time", "|time|").when(F.col("kind") == "decade", "|date_period|").otherwise(F.col("_tag"))
    value = F.when(F.col("kind").isin("number", "time"), F.col("core")).when(F.col("kind").isin("decade", "number_unit"), F.col("number")).otherwise(F.col("_value"))
    return hit.withColumn("tag", tag).where("tag is not null").select(key, "pos", "core", "tag", value.alias("value"), "unit")
