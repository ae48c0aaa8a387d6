"""A lexicon as tables that users bring: lexemes, contractions, and joining them to tokens.

lexemes: (lexeme, normal, pos array<string>, lemma, is_stop); contractions: (text, parts array<struct<value, normal,
lemma, pos>>). Both are looked up in lower case where the token as it stands is not found. A table of up to ``SMALL``
rows goes to all tasks; a larger one is joined by value, like any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import annotate as A

#: Rows of a table that may be sent to all tasks.
SMALL = 100_000
PART = "array<struct<value:string,normal:string,lemma:string,pos:string>>"


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def expand(tokens: DataFrame, contractions: DataFrame) -> DataFrame:
    """tokens (doc_id, idx, value, ...) with contractions in their parts: part counts from 0 within a token, and normal,
    lemma and pos are those of the part, null for other tokens. Only the first part keeps spaces, if there are any.

    Of contractions with one text the greatest parts are taken. Null values stay as they are.
    """
    known = contractions.groupBy(F.lower("text").alias("_text")).agg(F.max(F.col("parts").cast(PART)).alias("_parts")).filter(F.size("_parts") > 0)
    whole = F.array(F.struct(F.col("value").alias("value"), *(F.lit(None).cast("string").alias(c) for c in ("normal", "lemma", "pos")))).cast(PART)
    rows = tokens.join(_sent(known), F.lower("value") == F.col("_text"), "left").withColumn("_parts", F.coalesce("_parts", whole))
    others = [c for c in tokens.columns if c not in ("value", "spaces", "normal", "lemma", "pos")]
    rows = rows.select(*others, *(["spaces"] if "spaces" in tokens.columns else []), F.posexplode("_parts").alias("part", "_p"))
    spaces = [F.when(F.col("part") == 0, F.col("spaces")).otherwise("").alias("spaces")] if "spaces" in tokens.columns else []
    return rows.select(*others, *spaces, "part", "_p.value", "_p.normal", "_p.lemma", "_p.pos")


def annotate(tokens: DataFrame, lexemes: DataFrame) -> DataFrame:
    """tokens (value, ...) with normal, lemma, pos, is_stop and is_oov by the lexicon.

    A value that the lexicon lacks in its own case takes the lower-cased lexeme's entry; where that is a noun or an
    adjective, it is a name. pos is the only tag of a lexeme, null if it has several; unknown words have the tag of
    annotate.pos_of, are their own lemma and in lower case their own normal. Values are looked up once each.
    """
    one = F.when(F.size("pos") == 1, F.element_at("pos", 1))
    known = lexemes.groupBy(F.col("lexeme").alias("_lexeme")).agg(F.max(F.struct(F.col("normal").alias("normal"), F.col("lemma").alias("lemma"), one.alias("pos"), F.col("is_stop").alias("is_stop"))).alias("_own"))
    values = tokens.select("value").distinct()
    table = _sent(known)
    found = values.join(table, F.col("value") == F.col("_lexeme"), "left").select("value", F.col("_own").alias("_as"))
    found = found.join(table, F.lower("value") == F.col("_lexeme"), "left").select("value", "_as", F.col("_own").alias("_low"))
    tag = F.when(F.col("_as").isNotNull(), F.col("_as.pos")).when(F.col("_low").isNotNull(), F.when(F.col("_low.pos").isin("NOUN", "ADJ"), "PROPN").otherwise(F.col("_low.pos"))).otherwise(A.pos_of(F.col("value")))
    either = lambda name: F.coalesce(f"_as.{name}", f"_low.{name}")
    found = found.select("value", F.coalesce(either("normal"), F.lower("value")).alias("normal"), F.coalesce(either("lemma"), F.col("value")).alias("lemma"), tag.alias("pos"), F.coalesce(either("is_stop"), F.lit(False)).alias("is_stop"), (F.col("_as").isNull() & F.col("_low").isNull()).alias("is_oov"))
    return tokens.drop("normal", "lemma", "pos", "is_stop", "is_oov").join(found, tokens["value"].eqNullSafe(found["value"])).drop(found["value"])
