"""Range, interval and as-of joins, and the matching of proofs with results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ADJACENCY_GAP, EGRESS_USD_PER_GB
from ..functions.text import PROOF_TARGET, classify_proof, first_label, guess_number


def is_new_style(arxiv_id: Column) -> Column:
    return arxiv_id.rlike(r"^[0-9]{4}\.[0-9]{5,6}$")


def id_key(arxiv_id: Column) -> Column:
    """Sort key of a new-style identifier: month text, then number."""
    return F.struct(F.substring_index(arxiv_id, ".", 1).alias("yymm"), F.substring_index(arxiv_id, ".", -1).cast("int").alias("n"))


def range_join(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str, width: int) -> DataFrame:
    """points with each range that holds them, ends included, by an equi-join on cells of `width`.

    A range is listed under every cell that it touches, a point under its own, so neither side is broadcast nor scanned by the
    other. Ranges many times wider than a cell cost a row for each cell.
    """
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return points.withColumn("_cell", F.floor(F.col(point) / width)).join(cells, "_cell").where(F.col(point).between(F.col(lo), F.col(hi))).drop("_cell")


def ranges_that_hold(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str) -> DataFrame:
    """ranges that hold a point, ends included, each once; places are whole numbers from 0 to 2^60.

    A range is cut into blocks of 2^k places that begin at a multiple of 2^k, two of each size at most; a point lies in one block of each
    size that there is. They meet by an equi-join, and blocks that have a point are told apart first: no pairs are made,
    however many ranges and points share a place and however wide the ranges are.
    """
    sizes = f"sequence(0, cast(log2({hi} - {lo} + 1) as int) + 1)"  # one more, as the logarithm is rounded
    first, last = f"shiftright({lo} + shiftleft(1L, k) - 1, k)", f"shiftright({hi} + 1, k)"
    odd = f"{first} < {last} and {first} & 1 = 1", f"{first} < {last} and {last} & 1 = 1"
    block = lambda when, at: f"if({when}, struct(k as _k, {at} as _at), null)"
    blocks = f"filter(flatten(transform({sizes}, k -> array({block(odd[0], first)}, {block(odd[1], last + ' - 1')}))), b -> b is not null)"
    cut = ranges.where(f"{lo} <= {hi}").withColumns({lo: F.col(lo).cast("long"), hi: F.col(hi).cast("long")}).withColumn("_b", F.explode(F.expr(blocks))).select(*ranges.columns, "_b._k", "_b._at")
    held = points.select(F.col(point).cast("long").alias("_p")).distinct().crossJoin(F.broadcast(cut.select("_k").distinct()))  # 61 sizes at most
    held = held.select("_k", F.expr("shiftright(_p, _k)").alias("_at")).distinct()
    return cut.join(held.hint("merge"), ["_k", "_at"], "left_semi").select(*ranges.columns).distinct()


def as_of_forward(left: DataFrame, right: DataFrame, keys: list[str], at: str, before: str) -> DataFrame:
    """left with the nearest right row of its key at or after `at`, null if none; right's place is `before`.

    One union and one running window from the end: no pairs are made. Place ties on the right take the first row by all fields.
    """
    held = F.struct(F.col(before).alias("_at"), *[F.col(c) for c in right.columns if c not in keys and c != before])
    r = right.groupBy(*keys, F.col(before).alias("_p")).agg(F.min(held).alias("_r")).withColumn("_side", F.lit(0))
    lefts = left.withColumn("_l", F.struct(*left.columns)).select(*keys, F.col(at).alias("_p"), "_l").withColumn("_side", F.lit(1))
    both = r.unionByName(lefts, allowMissingColumns=True)
    ahead = Window.partitionBy(*keys).orderBy(F.col("_p").desc(), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_n", F.last("_r", ignorenulls=True).over(ahead)).where("_side = 1").select("_l.*", F.col("_n._at").alias(before), *[F.col(f"_n.{c}") for c in right.columns if c not in keys and c != before])


def select_chunks(manifest: DataFrame, year: int, month: int | None = None) -> DataFrame:
    yy = f"{year % 100:02d}"
    return manifest.where(F.startswith("yymm", F.lit(yy))) if month is None else manifest.where(F.col("yymm") == f"{yy}{month:02d}")


def chunks_for_ids(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Manifest rows, in the order of their ordinal where they have one, whose range holds a wanted new-style identifier.

    The key of a month and number is one integer, so a range that straddles months is a plain range.
    """
    code = lambda c: F.substring_index(c, ".", 1).cast("long") * 1_000_000 + F.substring_index(c, ".", -1).cast("long")
    ok = is_new_style(F.col("first_item")) & is_new_style(F.col("last_item"))
    ranges = manifest.where(ok).withColumn("_lo", code(F.col("first_item"))).withColumn("_hi", code(F.col("last_item"))).where("_hi >= _lo")
    points = wanted.where(is_new_style(F.col("arxiv_id"))).select(code(F.col("arxiv_id")).alias("_id")).distinct()
    hit = ranges_that_hold(points, ranges.select("filename", "_lo", "_hi"), "_id", "_lo", "_hi").select("filename").distinct()
    kept = manifest.join(hit, "filename", "left_semi")
    return kept.orderBy("ordinal") if "ordinal" in manifest.columns else kept


def rollup(manifest: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return manifest.agg(F.count(F.lit(1)).alias("chunk_count"), total.alias("total_bytes")).withColumn("egress_usd", F.bround(F.col("total_bytes") / 1e9 * EGRESS_USD_PER_GB, 6))


def ids_for(index: DataFrame, category: str, yymm: str, primary_only: bool = False) -> DataFrame:
    member = F.col("primary_category") == category if primary_only else F.array_contains("categories", category)
    return index.where(F.startswith("arxiv_id", F.lit(yymm)) & member).select("arxiv_id").orderBy("arxiv_id")


def ids_in_scope(index: DataFrame, chunks: DataFrame, category: str, primary_only: bool = False, most: int | None = None) -> DataFrame:
    """Identifiers of a category in the months of some chunks, months in the chunks' order, each once; `most` takes the first so many.

    chunks(yymm, ordinal); an identifier begins with its month.
    """
    months = chunks.groupBy("yymm").agg(F.min("ordinal").alias("_m"))
    member = F.col("primary_category") == category if primary_only else F.array_contains("categories", category)
    rows = index.where(member).withColumn("yymm", F.substring("arxiv_id", 1, 4)).join(months, "yymm")
    first = rows.groupBy("arxiv_id").agg(F.min("_m").alias("_m")).orderBy("_m", "arxiv_id")
    return (first if most is None else first.limit(most)).select("arxiv_id")


def match_proofs(theorems: DataFrame, proofs: DataFrame, starts: DataFrame) -> DataFrame:
    """(uid, start, method, confidence, multi_proof, proof_class) for each theorem(uid, arxiv_id, start, end, body_raw).

    proofs(arxiv_id, start, end, body_raw, opt_arg); starts(arxiv_id, start): every result environment. A proof whose option
    names this theorem's label wins, then its number, then one inside the theorem, then the nearest after it and before the
    next result; proofs that name another theorem count only for that. Joined by paper, which bounds the pairs.
    """
    named = theorems.withColumn("label", first_label(F.col("body_raw"))).withColumn("number", guess_number(first_label(F.col("body_raw"))))
    following = as_of_forward(named.select("uid", "arxiv_id", "end"), starts.select("arxiv_id", F.col("start").alias("next_start")), ["arxiv_id"], "end", "next_start").select("uid", "next_start")
    named = named.join(following, "uid")
    p = proofs.select("arxiv_id", F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("body_raw").alias("p_body"), "opt_arg")
    first_target = F.try_element_at(F.filter(F.transform(F.split(F.nullif(F.regexp_extract("opt_arg", PROOF_TARGET, 1), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))
    p = p.withColumn("_target", first_target).withColumn("_number", F.when(F.col("_target").isNull(), F.nullif(F.regexp_extract("opt_arg", r"\d+(?:\.\d+)*", 0), F.lit(""))))
    pairs = named.join(p, "arxiv_id")
    by_label = F.coalesce(F.col("_target") == F.col("label"), F.lit(False))
    by_number = F.coalesce(F.col("_number") == F.col("number"), F.lit(False))
    elsewhere = (F.col("_target").isNotNull() & ~by_label) | (F.col("_number").isNotNull() & F.col("number").isNotNull() & ~by_number)
    nested = ~elsewhere & (F.col("p_start") > F.col("start")) & (F.col("p_end") <= F.col("end"))
    after = ~elsewhere & (F.col("p_start") >= F.col("end")) & (F.col("next_start").isNull() | (F.col("p_start") < F.col("next_start")))
    rank = F.when(by_label, 1).when(by_number, 2).when(nested, 3).when(after, 4)
    ranked = pairs.withColumn("_rank", rank).where("_rank is not null")
    best = ranked.groupBy("uid").agg(F.min(F.struct("_rank", "p_start", "p_body", "end")).alias("b"), F.count(F.lit(1)).alias("n"))
    method = F.element_at(F.array(*[F.lit(m) for m in ("proof_of_label", "proof_of_number", "nested", "adjacency")]), F.col("b._rank"))
    near = F.col("b.p_start") - F.col("b.end") <= ADJACENCY_GAP
    confidence = F.when(F.col("b._rank") == 2, "medium").when((F.col("b._rank") == 4) & ~near, "medium").otherwise("high")
    return best.select("uid", F.col("b.p_start").alias("start"), method.alias("method"), confidence.alias("confidence"), (F.col("n") > 1).alias("multi_proof"), classify_proof(F.col("b.p_body")).alias("proof_class"))
