"""Exact duplicates, with very frequent texts taken out of the shuffle.

Each text is normalised and digested once into a narrow written table (id, row number, digest). A Misra-Gries summary
(Spark's mergeable frequent-item sketch: a fixed number of counters, lowered together when they run out) runs over the
digests in two levels of merging and names the candidates. They are counted exactly; the winners, those that hold at least one
row in ``WINNERS``, are ``WINNERS`` rows at most by that very condition, so they are broadcast and their rows find
their group without leaving the map task. What remains has no digest of that share and takes one ordinary shuffle by digest.

Only DataFrame functions are used. Defined cases: a NULL text is empty; texts are equal when they are identical after every run of
white space has become one space; the smallest id of a group stays, NULL ids come last, and of rows that repeat an id the first in
the order of reading stays (so ``kept`` is true once a group); an empty table gives an empty result; other columns are
ignored by :func:`assign` and all returned by :func:`keep_one`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import staged
from ..functions.lineage import cut

#: Runs of these count as one space.
SPACE = r"[\x20\x09-\x0D]+"
#: Counters of the summary: it errs by about 3.5 rows in ``COUNTERS``, well under a winner's share.
COUNTERS = 8192
#: A winner holds at least one row in so many.
WINNERS = 512
#: Summaries are merged in so many tasks first, then in one.
MERGES = 64

ORACLE = """
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""


def digest(text: str):
    """Lower-case hex SHA-256 of the normalised text."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " "), 256)


def frequent(rows: DataFrame, total: int, counters: int = COUNTERS, winners: int = WINNERS) -> DataFrame:
    """The digests that hold at least one row in ``winners`` (and two at least), counted exactly: digest, first row, size."""
    short = F.conv(F.substring("_sha", 1, 15), 16, 10).cast("bigint")
    parts = rows.select(short.alias("_short"), (F.spark_partition_id() % MERGES).alias("_part")).groupBy("_part").agg(F.expr(f"approx_top_k_accumulate(_short, {counters})").alias("_s"))
    named = parts.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(_s, {counters})").alias("_s")).select(F.explode(F.expr(f"approx_top_k_estimate(_s, {min(2 * winners, counters)})")).alias("_e"))
    candidates = rows.join(F.broadcast(named.select(F.col("_e.item").alias("_short"))), short == F.col("_short"), "left_semi")
    counted = candidates.groupBy("_sha").agg(F.min(_order()).alias("_first"), F.count(F.lit(1)).alias("_size"))
    return counted.where((F.col("_size") >= 2) & (F.col("_size") * winners >= total))


def _order():
    return F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))


def _groups(rows: DataFrame, total: int, counters: int, winners: int) -> DataFrame:
    """Each row with the first row and the size of its group."""
    heavy = F.broadcast(cut(frequent(rows, total, counters, winners)))
    light = rows.join(heavy, "_sha", "left_anti")
    same = Window.partitionBy("_sha")
    return rows.join(heavy, "_sha").select("_id", "_row", "_sha", "_first", "_size").unionByName(
        light.select("_id", "_row", "_sha", F.min(_order()).over(same).alias("_first"), F.count(F.lit(1)).over(same).alias("_size"))
    )


def _decided(rows: DataFrame, counters: int, winners: int) -> DataFrame:
    seen = Observation()
    table = staged(rows.observe(seen, F.count(F.lit(1)).alias("n")), "digests")
    return _groups(table, int(seen.get.get("n") or 0), counters, winners)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, winners: int = WINNERS) -> DataFrame:
    """A row for each document: its id, the id that stays for its text, the size of the group, whether this row stays, the digest."""
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), digest(text_col).alias("_sha"))
    made = _decided(rows, counters, winners)
    kept = F.col("_row") == F.col("_first.row")
    return made.select(F.col("_id").alias(id_col), F.col("_first.id").alias("keep_id"), F.col("_size").alias("group_size"), kept.alias("kept"), F.col("_sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, winners: int = WINNERS) -> DataFrame:
    """The documents without exact duplicates. They are written once with a row number, which then decides."""
    number = "_row"
    while number in docs.columns:
        number += "_"
    whole = staged(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = whole.select(F.col(id_col).alias("_id"), F.col(number).alias("_row"), digest(text_col).alias("_sha"))
    stays = _decided(rows, counters, winners).where(F.col("_row") == F.col("_first.row")).select(F.col("_row").alias(number))
    return whole.join(stays, number, "left_semi").select(*docs.columns)
