"""Exactly-once slices of a journal against an append-only ledger, in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ledger_check(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """rows with `verdict`: by uid (replay if the content is the same, else uid_conflict), then statement, then warn-only rows, else new."""
    hard, soft = ledger.where("not warn_only"), ledger.where("warn_only")
    by_uid = hard.groupBy("uid").agg(F.max_by("content_hash", F.coalesce("journal_line", F.lit(-1))).alias("_h"), F.lit(True).alias("_u"))
    by_stmt = hard.select("stmt_key").distinct().withColumn("_s", F.lit(True))
    warn_uid, warn_stmt = soft.select("uid").distinct().withColumn("_wu", F.lit(True)), soft.select("stmt_key").distinct().withColumn("_ws", F.lit(True))
    joined = rows.join(by_uid, "uid", "left").join(by_stmt, "stmt_key", "left").join(warn_uid, "uid", "left").join(warn_stmt, "stmt_key", "left")
    verdict = F.when(F.col("_u") & (F.col("_h") == F.col("content_hash")), "replay").when(F.col("_u"), "uid_conflict").when(F.col("_s"), "stmt_conflict").when(F.col("_wu") | F.col("_ws"), "warn").otherwise("new")
    return joined.withColumn("verdict", verdict).select(*rows.columns, "verdict")


def first_come(rows: DataFrame, order: str) -> DataFrame:
    """rows(uid, stmt_key, ...) with _took: whether a reader that goes through them in order would take them, being the first of their uid and of their statement.

    Rows that are first by both are taken, and what shares a key with them falls away; where a uid stands under several
    statements a row may be first only after that, so it goes on until no row is left. One round does in common journals.
    """
    open_, taken = rows, None
    while True:
        firsts = [open_.groupBy(k).agg(F.min(order).alias(f"_{k}")) for k in ("uid", "stmt_key")]
        met = open_.join(firsts[0], "uid").join(firsts[1], "stmt_key")
        now = met.where((F.col(order) == F.col("_uid")) & (F.col(order) == F.col("_stmt_key"))).select(*rows.columns)
        taken = now if taken is None else taken.unionByName(now)
        open_ = open_.join(now.select("uid"), "uid", "left_anti").join(now.select("stmt_key"), "stmt_key", "left_anti").select(*rows.columns)
        if open_.isEmpty():
            return rows.join(taken.select(order, F.lit(True).alias("_took")), order, "left").withColumn("_took", F.coalesce("_took", F.lit(False)))


def judged(journal: DataFrame, ledger: DataFrame, order: str) -> DataFrame:
    """journal(order, uid, stmt_key, content_hash) with verdict and accepted, read in order against the ledger and against the rows accepted before.

    A row that repeats one accepted before it is classed against that row: by uid first (replay if the content is the same,
    else uid_conflict), then by statement (stmt_conflict).
    """
    checked = ledger_check(journal, ledger)
    open_ = first_come(checked.where("verdict in ('new', 'warn')"), order)
    taken = open_.where("_took")
    seen = open_.join(taken.select("uid", F.col("content_hash").alias("_h"), F.col(order).alias("_at")), "uid", "left")
    before = F.coalesce(F.col("_at") < F.col(order), F.lit(False))
    intra = F.when(F.col("_took"), F.col("verdict")).when(before & (F.col("_h") == F.col("content_hash")), "replay").when(before, "uid_conflict").otherwise("stmt_conflict")
    blocked = checked.where("verdict not in ('new', 'warn')").withColumn("accepted", F.lit(False))
    return blocked.unionByName(seen.withColumn("verdict", intra).select(*journal.columns, "verdict", F.col("_took").alias("accepted")))


def cut_slice(journal: DataFrame, ledger: DataFrame, size: int, order: str = "line_no") -> DataFrame:
    """journal(line_no, uid, stmt_key, content_hash) with `verdict` and `accepted`, up to the line that fills the slice.

    Rows that the ledger blocks are out; of the rest a row counts if it is the first of its uid and of its statement among
    those that count; the first `size` of them are the slice. Later lines are not returned. With fewer than `size` nothing is
    accepted and every line is returned. Callers abort on a uid_conflict among the rows returned.
    """
    rows = judged(journal, ledger, order)
    # The slice takes `size` lines, a setting: ordering and limiting them is a top-k, not a sort of the journal.
    taken = rows.where("accepted").select(order).orderBy(order).limit(size)
    edge = taken.agg(F.max(order).alias("_through"), F.count(F.lit(1)).alias("_n"))
    full = F.col("_n") >= size
    out = rows.crossJoin(F.broadcast(edge)).where(~full | (F.col(order) <= F.col("_through")))  # one row
    return out.withColumn("accepted", full & F.col("accepted")).select(*journal.columns, "verdict", "accepted")


def conflicts(sliced: DataFrame, policy: str = "skip") -> DataFrame:
    """Rows that abort a slice: uid conflicts always, statement conflicts under `abort`."""
    return sliced.where(F.col("verdict").isin("uid_conflict", *(["stmt_conflict"] if policy == "abort" else [])))


def append_rows(accepted: DataFrame, batch: str, source: str, now_iso: str) -> DataFrame:
    """Accepted rows in the ledger's shape."""
    return accepted.where("accepted").select("uid", "stmt_key", "content_hash", F.lit(batch).alias("batch"), F.lit(batch).alias("batch_label"), F.lit(source).alias("source_journal"), F.col("line_no").cast("long").alias("journal_line"), F.lit(now_iso).alias("sliced_at"), F.lit(False).alias("warn_only"))


def in_flight(states: DataFrame) -> DataFrame:
    """(lowest unfinished batch, highest batch number)."""
    return states.agg(F.min(F.when(~F.col("state").isin("READY", "FROZEN"), F.col("batch_no"))).alias("in_flight"), F.max("batch_no").alias("highest"))


def intra_previous(journal: DataFrame) -> DataFrame:
    """Each line with the line before it of the same statement."""
    return journal.withColumn("previous_line", F.lag("line_no").over(Window.partitionBy("stmt_key").orderBy("line_no")))
