"""Records that differ in spacing, case, punctuation or order of labelled fields only.

Byte-identical rows are collapsed first, with counts; only the distinct survivors are made canonical; the full
canonical texts are grouped again and the counts summed. Both groupings combine on the map side, so a text that
holds a third of the rows arrives as one row per map task.

Canonical text
    * a leading list number (digits and '.' or ')') isn't part of the text;
    * case is folded by way of upper case, and all but letters and digits is left out;
    * a form is a text that begins with 'label:' or 'label =' and has two or more such fields, parted by ';', '|' or line
      ends. Its canonical text is the sorted list of its fields, each the label and the value without their marks.
Defined results
    * null texts and texts without letters or digits belong to no group;
    * ties: the smallest key stands for its group; its spelling stands for the record;
    * repeated rows count as copies; a key that occurs twice is one copy;
    * an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import cut

#: Spaces beyond ASCII.
_WIDE = "\u00a0\u2007\u200b\u202f\ufeff"
#: Fixed by the task: what opens a list entry.
LIST_NUMBER = rf"^[\s{_WIDE}]*\d+[.)]"
#: A field opens at the start of a text, or after a separator, with a label of one to three words and a mark.
_LABEL = r"\p{L}[\p{L}\p{M}]*(?:[ _-]\p{L}[\p{L}\p{M}]*){0,2}"
_FIELD = rf"[;|\r\n]+[^\p{{L}}\p{{N}};|\r\n]*({_LABEL}[\s{_WIDE}]*[:=])"
_FORM = rf"^[^\p{{L}}\p{{N}}]*{_LABEL}[\s{_WIDE}]*[:=]"


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.upper(text)), r"[^\p{L}\p{N}]+", "")


def canonical(text: Column) -> Column:
    """The canonical text of a text; empty where there is no letter or digit."""
    body = F.regexp_replace(text, LIST_NUMBER, "")
    fields = F.split(F.regexp_replace(body, _FIELD, "\x01$1"), "\x01")
    pair = lambda f: F.concat(folded(F.regexp_extract(f, "^[^:=]*", 0)), F.lit("\x02"), folded(F.regexp_extract(f, "(?s)[:=](.*)$", 1)))
    form = F.concat_ws("\x03", F.array_sort(F.transform(fields, pair)))
    return F.when(body.rlike(_FORM) & (F.size(fields) > 1), form).otherwise(folded(body))


def spellings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(text, n_rows, first_key) of each byte-identical text."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
    return rows.groupBy("text").agg(F.count("*").alias("n_rows"), F.min("key").alias("first_key"))


def collapse(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per record: (canonical, first_key, text of that key, n_copies, n_spellings)."""
    own = spellings(df, key, text).withColumn("canonical", canonical(F.col("text"))).filter(F.col("canonical") != "")
    return own.groupBy("canonical").agg(
        F.min("first_key").alias("first_key"), F.min_by("text", "first_key").alias("text"), F.sum("n_rows").alias("n_copies"), F.count("*").alias("n_spellings")
    )


def _name(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text: what rows and texts meet by, so that long texts don't travel with every row."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("t"), text).alias("t2")]


def copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(first_id, copy_id): each key but the smallest of every record that has several.

    The texts are made canonical once and kept by the names of their spellings; spellings of records with one row are dropped
    before the rows are joined, by the name of their byte-identical text (128 bits; equal canonical texts are compared whole). Rows of one
    hot text meet a single row there, so that adaptive execution may split them over tasks as it likes.
    """
    own = spellings(df, key, text).select(*_name(F.col("text")), canonical(F.col("text")).alias("canonical"), "first_key", "n_rows").filter(F.col("canonical") != "")
    own = cut(own)
    groups = own.groupBy("canonical").agg(F.min("first_key").alias("first_id"), F.sum("n_rows").alias("n")).filter("n > 1").drop("n")
    of_text = own.select("t1", "t2", "canonical").join(groups, "canonical").select("t1", "t2", "first_id")
    rows = df.filter(F.col(key).isNotNull() & F.col(text).rlike(r"[\p{L}\p{N}]")).select(F.col(key).alias("copy_id"), *_name(F.col(text)))
    return rows.join(of_text, ["t1", "t2"]).filter("copy_id <> first_id").select("first_id", "copy_id")
