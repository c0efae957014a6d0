"""A guard against notes that leak into outgoing fields: shared passages, found by winnowed fingerprints and then verified word by word.

Of every run of `window` fingerprints of k words the least is kept, so two texts that share window + k - 1 words share a kept fingerprint: nothing as long as a passage
can slip through, and phrases shorter than one never count. Fingerprints of all notes meet those of all fields as a set; only fields and notes with a hit are looked at in full.
No note is ever paired with a field: what they share is counted by passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a passage, and of a fingerprint.
PASSAGE, K = 8, 5


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(column: str, n: int, of) -> Column:
    """of(n elements) at every place of an array; none in shorter ones. A column and no expression: a lambda would work that out anew at each place."""
    none = F.sequence(F.lit(1), F.lit(1))
    at = F.when(F.size(column) >= n, F.sequence(F.lit(1), F.size(column) - n + 1)).otherwise(F.slice(none, F.lit(1), F.lit(0)))
    return F.transform(at, lambda i: of(F.slice(F.col(column), i, F.lit(n))))


def fingerprints(rows: DataFrame, words_: str, alias: str, k: int = K, passage: int = PASSAGE) -> DataFrame:
    """rows plus the least hash of every `passage - k + 1` in a row, each once; none in texts shorter than a passage."""
    hashed = rows.withColumn("_h", _grams(words_, k, lambda g: F.xxhash64(F.array_join(g, " "))))
    return hashed.withColumn(alias, F.array_distinct(_grams("_h", passage - k + 1, F.array_min))).drop("_h")


def leaks(notes: DataFrame, outgoing: DataFrame, note: str, key: str, field: str, passage: int = PASSAGE, k: int = K) -> DataFrame:
    """outgoing's rows plus leaked: how many different passages (runs of `passage` words) of the field stand in some note, and one of them, `example`.

    A field is clean where leaked is 0. key tells outgoing's rows apart. Null and short texts are clean and leak nothing.
    """
    own = notes.select(words(F.col(note)).alias("_w")).where(F.size("_w") >= passage)
    out = outgoing.select(F.col(key).alias("_key"), words(F.col(field)).alias("_w")).where(F.size("_w") >= passage)
    # Outer, as before an inner explode the optimiser puts a filter on the array's size and pushes all that makes it up into the lambdas.
    unfolded = lambda df, array, name: df.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())
    prints = lambda df: unfolded(fingerprints(df, "_w", "_fs", k, passage), F.col("_fs"), "_f")
    asked = prints(out).select("_key", "_f")
    named = own.withColumn("_note", F.sha2(F.array_join("_w", " "), 256))
    hits = prints(named).select("_note", "_f").join(asked.select("_f").distinct(), "_f", "left_semi")
    # Texts with a hit only, and of them all passages: equal hashes are no proof.
    suspects = asked.join(hits.select("_f").distinct(), "_f", "left_semi").select(F.col("_key").alias("_hit")).distinct()
    suspects = out.join(suspects, F.col("_key") == F.col("_hit"), "left_semi")
    touched = named.join(hits.select(F.col("_note").alias("_hit")).distinct(), F.col("_note") == F.col("_hit"), "left_semi").select("_w")
    said = lambda df: unfolded(df, F.array_distinct(_grams("_w", passage, lambda g: F.array_join(g, " "))), "_p")
    shared = said(suspects).select("_key", "_p").join(said(touched).select("_p").distinct(), "_p", "left_semi")
    counted = shared.groupBy("_key").agg(F.count(F.lit(1)).alias("leaked"), F.min("_p").alias("example"))
    return outgoing.join(counted, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("leaked", F.coalesce("leaked", F.lit(0)).cast("long"))
