"""Raw rows to canonical records: field precedence, provenance, quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BAND_HI, BAND_LO, JUNK_MARKERS, MISDIRECTION_SHARE, PROVENANCES, TRUTH_POLICIES
from ..functions.text import arxiv_from_link, elision_signals
from ..identity import dedup_key, gate_uid, ingest_uid

# Which field holds the statement, by reader.
STATEMENT_FIELDS = {
    "ingest": ("statement", "question", "prompt", "problem"),
    "gate": ("statement", "question", "prompt"),
    "scrape": ("statement", "question", "problem"),
    "first_judge": ("statement", "problem", "question"),
}


def column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """df's column, or null where it has none."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def first_of(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """The first of the fields that is neither null nor empty."""
    return F.coalesce(*[F.nullif(column(df, n), F.lit("")) for n in names]).cast(kind)


def to_int(c: Column) -> Column:
    """A whole number's text, or a number cut towards zero; anything else is 0."""
    return F.coalesce(F.when(F.trim(c.cast("string")).rlike(r"^[+-]?\d+$"), c.cast("string").try_cast("int")), F.lit(0))


def apply_column_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Give source columns their canonical names, unless a column of that name is there."""
    return df.withColumns({to: F.col(of) for to, of in mapping.items() if of in df.columns and to not in df.columns})


def provenance(df: DataFrame, override: str | None = None, infer_from: str = "family") -> Column:
    """Override, else a known stored value, else computed for rows with `infer_from`, extracted without."""
    if override is not None:
        if override not in PROVENANCES:
            raise ValueError(f"unknown provenance {override!r}; allowed: {PROVENANCES}")
        return F.lit(override)
    stored = column(df, "provenance")
    return F.when(stored.isin(*PROVENANCES), stored).when(F.nullif(column(df, infer_from), F.lit("")).isNotNull(), "computed").otherwise("extracted")


def truth_policy(df: DataFrame, source: Column, override: str | None = None) -> Column:
    if override is not None:
        if override not in TRUTH_POLICIES:
            raise ValueError(f"unknown truth policy {override!r}; allowed: {TRUTH_POLICIES}")
        return F.lit(override)
    stored = column(df, "truth_policy")
    return F.when(stored.isin(*TRUTH_POLICIES), stored).when(source == "computed", "trusted").when(source == "extracted", "extracted").otherwise("unknown")


def label_of(pass_at_k: Column, share: Column, stored: Column | None = None, unknown: str = "other", also: Sequence[str] = ()) -> Column:
    """A stored label of the four (and `also`), else by the pass rate's place in the band and the wrong answers' agreement."""
    derived = (
        F.when(pass_at_k.isNull(), unknown)
        .when(pass_at_k > BAND_HI, "solved")
        .when(pass_at_k >= BAND_LO, "band")
        .when(F.coalesce(share, F.lit(0.0)) >= MISDIRECTION_SHARE, "misdirection")
        .otherwise("collapse")
    )
    return derived if stored is None else F.when(stored.isin("band", "misdirection", "solved", "collapse", *also), stored).otherwise(derived)


def truth_strings(df: DataFrame) -> Column:
    """A non-empty list as it stands, else truth and answer; empty entries go."""
    pair = F.filter(F.array(column(df, "truth"), column(df, "answer")), lambda x: x.isNotNull() & (x != ""))
    if "truth_strings" not in df.columns:
        return pair
    listed = F.filter("truth_strings", lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size("truth_strings") > 0, listed).otherwise(pair)


def to_records(df: DataFrame, source: Column, order: Sequence[str], provenance_override: str | None = None, policy_override: str | None = None, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Raw rows -> the problem schema; `order` is the read order that numbers rid from 0.

    rid is the one global ordinal of the model: it needs all rows in order, so it is left to `with_rid` where a caller wants
    it; here rid is null.
    """
    df = apply_column_map(df, mapping or {})
    statement = F.coalesce(first_of(df, STATEMENT_FIELDS["ingest"]), F.lit(""))
    kept = provenance(df, provenance_override)
    rate, share = column(df, "pass_at_k").try_cast("double"), F.coalesce(column(df, "top_wrong_share").try_cast("double"), F.lit(0.0))
    counts = {"n_correct": ("n_correct", "correct"), "n_wrong": ("n_wrong", "wrong", "wrong_complete"), "n_degenerate": ("n_degenerate", "degenerate")}
    return df.select(
        *order,
        ingest_uid(source, statement).alias("uid"),
        source.alias("source"),
        kept.alias("provenance"),
        statement.alias("statement"),
        truth_strings(df).alias("truth_strings"),
        F.coalesce(column(df, "answer_value"), column(df, "answer")).alias("answer_value"),
        F.nullif(column(df, "tier"), F.lit("")).alias("tier"),
        F.nullif(column(df, "family"), F.lit("")).alias("family"),
        truth_policy(df, kept, policy_override).alias("truth_policy"),
        label_of(rate, share, column(df, "label")).alias("label"),
        rate.alias("pass_at_k"),
        *[to_int(next((F.col(n) for n in names if n in df.columns), F.lit(None))).alias(out) for out, names in counts.items()],
        first_of(df, ("modal_wrong", "top_wrong_value")).alias("modal_wrong"),
        share.alias("top_wrong_share"),
    )


def stated_provenance(df: DataFrame) -> Column:
    """The stored provenance in lower case if it is a known one, else unknown; computed is never inferred."""
    stored = F.lower(F.trim(F.coalesce(column(df, "provenance"), F.lit(""))))
    return F.when(stored.isin(*PROVENANCES), stored).otherwise("unknown")


def truths(df: DataFrame) -> Column:
    """Answers of a record: truth_strings as a list, a JSON list or one string; else the distinct ones of its answer fields. Empty ones go."""
    fields = F.array_distinct(F.array_compact(F.array(*[F.nullif(column(df, n), F.lit("")) for n in ("truth", "answer", "gold_answer", "answer_value")])))
    if "truth_strings" not in df.columns:
        return fields
    if dict(df.dtypes)["truth_strings"].startswith("array"):
        return F.when(F.col("truth_strings").isNotNull(), F.filter("truth_strings", lambda x: x != "")).otherwise(fields)
    text = F.trim("truth_strings")
    listed = F.when(F.startswith(text, F.lit("[")), F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), "array<string>"))
    return F.when(listed.isNotNull(), F.filter(listed, lambda x: x != "")).when(text != "", F.array(text)).otherwise(fields)


def params(df: DataFrame, family: Column) -> Column:
    """Parameters as JSON: an object in `params`, else one in `detail` for rows with a family, else null."""
    held = lambda c: F.when(F.startswith(F.coalesce(F.schema_of_variant(F.try_parse_json(c)), F.lit("")), F.lit("OBJECT")), F.trim(c))
    return F.coalesce(held(column(df, "params")), F.when(family.isNotNull(), held(column(df, "detail"))))


def first_judge_rows(df: DataFrame) -> DataFrame:
    """Raw rows -> what the first judge reads: unknown provenance and source stay unknown, a missing uid is made of source and statement."""
    source = F.coalesce(first_of(df, ("source", "dataset")), F.lit("unknown"))
    statement = F.coalesce(first_of(df, STATEMENT_FIELDS["first_judge"]), F.lit(""))
    kept = F.lower(F.coalesce(column(df, "provenance"), F.lit("unknown")))
    return df.select(
        F.coalesce(F.nullif(column(df, "uid"), F.lit("")), gate_uid(source, statement)).alias("uid"), source.alias("source"), statement.alias("statement"),
        F.when(kept.isin(*PROVENANCES), kept).otherwise("unknown").alias("provenance"), F.nullif(F.lower(column(df, "truth_policy")), F.lit("")).alias("truth_policy"),
        *[column(df, n).alias(n) for n in ("answer", "family", "tier", "pass_at_k", "n_correct", "n_wrong", "n_degenerate")],
    )


def second_judge_rows(df: DataFrame, default_source: str = "unknown") -> DataFrame:
    """Raw rows -> what the second judge reads. Of several fields the first that is neither null nor empty counts; a missing rate comes of the counts."""
    source = F.coalesce(first_of(df, ("source",)), F.lit(default_source))
    statement = F.coalesce(first_of(df, STATEMENT_FIELDS["ingest"]), F.lit(""))
    family = F.nullif(column(df, "family"), F.lit(""))
    counts = {"n_correct": ("n_correct", "correct"), "n_wrong": ("n_wrong", "wrong", "wrong_complete"), "n_degenerate": ("n_degenerate", "degenerate")}
    n = {out: to_int(first_of(df, names)) for out, names in counts.items()}
    total = n["n_correct"] + n["n_wrong"] + n["n_degenerate"]
    rate = F.coalesce(first_of(df, ("pass_at_k", "pass_rate")).try_cast("double"), F.round(n["n_correct"] / F.nullif(total, F.lit(0)), 6))
    share = first_of(df, ("top_wrong_share",)).try_cast("double")
    return df.select(
        F.coalesce(F.nullif(column(df, "uid"), F.lit("")), ingest_uid(source, statement)).alias("uid"), source.alias("source"), statement.alias("statement"), truths(df).alias("truth_strings"),
        first_of(df, ("answer_value", "answer", "gold_answer", "truth")).alias("answer_value"), F.nullif(column(df, "tier"), F.lit("")).alias("tier"), family.alias("family"), params(df, family).alias("params"),
        stated_provenance(df).alias("provenance"), label_of(rate, share, column(df, "label"), "unknown", ("drop",)).alias("label"), rate.alias("pass_at_k"), *[c.alias(k) for k, c in n.items()],
        first_of(df, ("modal_wrong", "top_wrong_value")).alias("modal_wrong"), share.alias("top_wrong_share"),
    )


def inject_uid(df: DataFrame) -> DataFrame:
    """Rows with a uid keep it; the others get one of source and statement."""
    made = gate_uid(column(df, "source"), first_of(df, STATEMENT_FIELDS["gate"]))
    return df.withColumn("uid", F.coalesce(F.nullif(column(df, "uid"), F.lit("")), made))


def unresolved_refs(has_external: Column, resolved: Column, unresolved: Column) -> Column:
    """External references stand and either some are unresolved or none is resolved; resolved, unresolved: counts."""
    return F.coalesce(has_external, F.lit(False)) & ((F.coalesce(unresolved, F.lit(0)) > 0) | (F.coalesce(resolved, F.lit(0)) == 0))


def quarantine(df: DataFrame, order: str, guard: str = "off") -> DataFrame:
    """df with statement, dedup_key, quarantine_reason and duplicate: the first kept row of a normalised statement wins.

    Only rows that are kept register their statement, so a quarantined row never shadows a later good one.
    """
    if guard not in ("off", "advisory", "strict"):
        raise ValueError(f"unknown guard {guard!r}")
    statement = first_of(df, STATEMENT_FIELDS["scrape"])
    flagged = unresolved_refs(column(df, "has_external_refs", "boolean"), column(df, "n_resolved", "int"), column(df, "n_unresolved", "int"))
    reason = F.when(statement.isNull(), "missing statement")
    if guard == "strict":
        reason = reason.when(flagged, "[quality-guard] unresolved external refs in source")
    rows = df.withColumn("statement", statement).withColumn("dedup_key", dedup_key(statement)).withColumn("quarantine_reason", reason).withColumn("guard_flagged", flagged & F.lit(guard == "advisory"))
    kept = F.col("quarantine_reason").isNull()
    # The first good row by an aggregate and a join: a statement that a third of the rows share is no window of one task.
    firsts = rows.where(kept).groupBy("dedup_key").agg(F.min(order).alias("_first"))
    joined = rows.join(firsts, "dedup_key", "left")
    return joined.withColumn("duplicate", F.coalesce(kept & (F.col(order) > F.col("_first")), F.lit(False))).drop("_first")


def canonical(df: DataFrame, source: str, families: Sequence[str], default_family: str = "extracted") -> DataFrame:
    """Kept candidates -> canonical columns, with warnings; truth stands in for a missing answer."""
    answer, truth = F.nullif(column(df, "answer"), F.lit("")), F.nullif(column(df, "truth"), F.lit(""))
    shown = F.coalesce(answer, truth)
    other = F.when(answer.isNotNull() & (truth != answer), truth)
    arxiv = F.coalesce(F.nullif(column(df, "arxiv_id"), F.lit("")), arxiv_from_link(column(df, "link")))
    kept = provenance(df, infer_from="generated")
    warnings = F.array_compact(F.array(F.when(shown.rlike("|".join(JUNK_MARKERS)), F.lit("answer carries macro residue")), F.when(arxiv.isNull(), F.lit("no arxiv_id"))))
    return df.select(
        F.lit(source).alias("source"), kept.alias("provenance"), truth_policy(df, kept).alias("truth_policy"), "statement",
        F.coalesce(F.nullif(column(df, "family"), F.lit("")), F.lit(families[0] if len(families) == 1 else default_family)).alias("family"),
        shown.alias("answer"), other.alias("truth"), arxiv.alias("arxiv_id"), warnings.alias("warnings"), elision_signals(F.col("statement")).alias("elision_signals"),
    )


def paper_pool(df: DataFrame, order: str) -> DataFrame:
    """First row of each paper (identifier, else link), then first of each normalised title; empty titles never collapse."""
    arxiv = F.coalesce(F.nullif(column(df, "arxiv_id"), F.lit("")), arxiv_from_link(column(df, "link")))
    rows = df.withColumn("arxiv_id", arxiv).withColumn("_key", F.coalesce(arxiv, F.nullif(column(df, "link"), F.lit("")))).where("_key is not null")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(order))).where("_r = 1")
    title = dedup_key(column(rows, "title"))
    rows = rows.withColumn("_title", F.when(title == "", F.concat(F.lit("\x00"), F.col("_key"))).otherwise(title))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("_title").orderBy(order))).where("_r = 1").drop("_r", "_title", "_key")


def with_rid(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """rid: place in read order, gapless from 0, by a range sort and each partition's offset (no task orders all rows)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(before), "_part").withColumn("rid", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
