"""Problem 6: duplicates hidden by formatting, by commutative multiset hashing of normalised fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_unique
from ..plans.storage import Scratch
from .words import multiset_hash, normal_text, once, same_multiset


def fingerprints(df: DataFrame, id_col: str = "row_id", string_col: str = "string", *extra: str) -> DataFrame:
    """(id, norm, fp1, fp2, extra...) of rows whose string holds a word. Nulls and strings without letter or digit are left out."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(string_col).alias("_s"), *(F.col(c).alias(f"_x_{c}") for c in extra)).where(F.col("_s").isNotNull())
    rows = once(rows, "norm", normal_text("_s")).drop("_s").where(F.col("norm") != "")
    words = F.split("norm", " ")
    return rows.withColumns({"fp1": multiset_hash(words, 1), "fp2": multiset_hash(words, 2)})


def collapsed(df: DataFrame, id_col: str = "row_id", string_col: str = "string", count_col: str = "count") -> DataFrame:
    """One record for each set of rows with the same words: (keep_id, norm, copies, total).

    keep_id is the smallest id, norm its normal text, copies the number of rows, total the sum of count (a null counts 1).
    Rows without any word are no copies of one another and are left out. A hot set is counted by partial aggregation.
    """
    return _counted(fingerprints(df, id_col, string_col, count_col), "norm", F.col(f"_x_{count_col}")).select("fp1", "fp2", "keep_id", "norm", "copies", "total")


def _same(a: str, b: str) -> Column:
    """Whether two normal texts hold the same words equally often."""
    return (F.col(a) == F.col(b)) | same_multiset(F.split(a, " "), F.split(b, " "))


def _counted(rows: DataFrame, what: str, count: Column) -> DataFrame:
    """One row for each fingerprint of rows (_id, fp1, fp2, what): keep_id, the kept row's what, copies, total.

    Every row is compared with the kept one of its set, words or fields as multisets; where they differ it fails by name, before
    anything is counted together.
    """
    scratch = Scratch(rows.sparkSession)
    rows = scratch.write(rows)  # read twice below
    sets = rows.groupBy("fp1", "fp2").agg(F.min("_id").alias("keep_id"), F.min_by(what, "_id").alias("kept"), F.count("*").alias("copies"), F.sum(F.coalesce(count, F.lit(1))).alias("total"))
    sets = scratch.write(sets)
    both = join_unique(rows.select("fp1", "fp2", what), sets.where("copies > 1").drop("total"), ["fp1", "fp2"], "copies", scratch=scratch)
    same = _same(what, "kept") if dict(rows.dtypes)[what] == "string" else (F.col(what) == F.col("kept")) | same_multiset(F.col(what), F.col("kept"))
    clash = both.where(~same).agg(F.min("keep_id")).first()[0]
    if clash is not None:
        raise ValueError(f"fingerprints collide at id {clash}")
    scratch.drop(rows)
    return sets.withColumnRenamed("kept", what)


def collapsed_records(df: DataFrame, fields: list[str], id_col: str = "row_id", count_col: str = "count") -> DataFrame:
    """One record for each set of rows whose fields are the same but for their formatting: (keep_id, fields, copies, total).

    A record is the multiset of its (field name, normal text) pairs, hashed without regard to the order of the fields; a field
    that is null or holds no word is not there. keep_id is the smallest id, fields its pairs, total the sum of count (a null
    counts 1). Records without any field are left out.
    """
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), normal_text(F.col(f).cast("string")).alias("value")) for f in fields))
    rows = once(df.select(F.col(id_col).alias("_id"), F.col(count_col).alias("_n"), pairs.alias("_p")), "_p", F.col("_p"))
    rows = rows.select("_id", "_n", F.filter("_p", lambda p: F.coalesce(p["value"], F.lit("")) != "").alias("fields")).where(F.size("fields") > 0)
    rows = rows.withColumns({"fp1": multiset_hash(F.col("fields"), 1), "fp2": multiset_hash(F.col("fields"), 2)})
    return _counted(rows, "fields", F.col("_n")).select("keep_id", "fields", "copies", "total")


def copies_found(df: DataFrame, id_col: str = "row_id", string_col: str = "string") -> DataFrame:
    """(keep_id, row_id): the smallest id of each set of two or more rows with the same words, with each other id.

    Fingerprints of 2 x 64 bits group the rows; then every row's words are compared with those of the kept row, as multisets
    and without sorting. Should two different multisets ever share a fingerprint the query fails by name instead of joining them.
    The heaviest sets are joined by broadcast of their one kept row, so no task holds a hot set.
    """
    rows = Scratch(df.sparkSession).write(fingerprints(df, id_col, string_col))  # read three times below
    sets = rows.groupBy("fp1", "fp2").agg(F.min("_id").alias("keep_id"), F.min_by("norm", "_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")
    both = join_unique(rows, sets, ["fp1", "fp2"], "copies").where("_id != keep_id")
    checked = F.when(_same("norm", "kept"), F.col("_id")).otherwise(F.raise_error(F.concat(F.lit("fingerprints collide: "), F.col("norm"), F.lit(" / "), F.col("kept"))).cast("long"))
    return both.select("keep_id", checked.alias("row_id"))
