"""What the core's queries share: tables read once, and the SQL that stands for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.lexicon import Lexicon, distinct_stream
from textloom.sources import read_table


def stream(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The token stream, each token once; name the columns that are needed, else all are read."""
    return distinct_stream(read_table(spark, d, "token_stream"), *columns)


def inputs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ``input_id, original``."""
    return read_table(spark, d, "tokenized_input").select("input_id", "original").distinct()


def lexicon(spark: SparkSession, d: str) -> Lexicon:
    return Lexicon.load(spark, d)


def tag(c: str = "pos"):
    return F.coalesce(F.upper(c), F.lit("FW"))


STREAM = "stream AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY input_id, seq ORDER BY ingested_at) AS rn FROM token_stream) WHERE rn = 1)"
TOK = "tok AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY loaded_at DESC) AS rn FROM lexicon_tokens WHERE deleted_at IS NULL) WHERE rn = 1)"
LEX = "lex AS (SELECT DISTINCT word, ord, pos, token_id FROM lexicon_pos)"
SENSE = "sense AS (SELECT word, arg_min(pos, ord) AS pos, arg_min(token_id, ord) AS token_id, list(pos ORDER BY ord, pos) AS potential_pos FROM lex GROUP BY word)"
CATS = "cats AS (SELECT * FROM categories WHERE deleted_at IS NULL)"


def words_sql(source: str, key: str, text: str) -> str:
    """CTEs ``cleaned`` and ``words`` over a query that gives key and text."""
    return rf"""cleaned AS (SELECT {key}, list_filter(string_split(regexp_replace(array_to_string(list_transform(string_split({text}, chr(10)),
      lambda l: trim(regexp_replace(l, '^[-_=#@!]+', ' ')) || ' |NL|'), ' '), '[^\x20-\x7E]', '', 'g'), ' '), lambda w: w <> '') AS ws FROM ({source}) WHERE {text} IS NOT NULL),
words AS (SELECT {key}, CAST(i - 1 AS INT) AS pos, ws[i] AS word FROM (SELECT {key}, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM cleaned))"""


INPUT_WORDS = words_sql("SELECT DISTINCT input_id, original FROM tokenized_input", "input_id", "original")


def values_sql(rows, columns: str) -> str:
    """A VALUES list."""

    def one(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({columns})"
