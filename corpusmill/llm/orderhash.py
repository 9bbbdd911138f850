"""Order MinHash fingerprints, in DataFrame expressions only.

A text's k-mers of words are numbered by occurrence, so that a repeated k-mer counts each time, and hashed with their
number into one of `BINS` bins. In each bin the `TUPLE` least stay, are put back into text order and hashed together.
Two texts agree in a bin only if the same k-mers are least there and stand in the same order, so the share of agreeing
bins falls with edit distance, block moves included, not only with the set of k-mers.

Each step is an array of 64-bit integers, packed so that a primitive sort does the grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bins (a power of two up to 64), k-mers of a tuple, words of a k-mer.
BINS, TUPLE, K = 64, 2, 2
#: Bits of a k-mer's place in the text (no string has more words than 2**30), of its own hash, and of its numbered hash, as packed.
PLACE, KMER, NUMBERED = 30, 33, 27
#: Bytes of text aimed at in a bucket of neighbouring ids, and buckets at most, which bounds what is broadcast of them.
BUCKET_BYTES, MOST_BUCKETS = 512 << 10, 65_536
#: Copies of one row that a task makes.
COPIES = 100_000


def _kmers(words: str, k: int) -> str:
    """Hash of each k-mer; a text of fewer words has one; a text of none has none."""
    gram = ", ".join(f"get({words}, i + {j})" for j in range(k))
    return f"if(size({words}) = 0, cast(array() as array<bigint>), transform(sequence(0, greatest(size({words}) - {k}, 0)), i -> xxhash64({gram})))"


def with_components(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """df with `out`: array<int>, for each bin that holds a k-mer  bin * 65536 + 16 bits of its tuple's hash, bins ascending."""
    low = lambda bits: (1 << bits) - 1
    w, h, s, n, q = (f"_{out}_{c}" for c in "whsnq")
    kin = lambda back: f"i >= {back} and shiftrightunsigned(get({s}, i - {back}), {PLACE}) = shiftrightunsigned(x, {PLACE})"
    steps = ", ".join(str(1 << b) for b in range(PLACE - 1, -1, -1))
    seen = f"if({kin(1)}, aggregate(array({steps}), 0, (t, d) -> if({kin('t - d')}, t + d, t)), 0)"
    numbered = f"xxhash64(shiftrightunsigned(x, {PLACE}), {seen})"
    per_bin = BINS.bit_length() - 1
    top = PLACE + NUMBERED
    df = df.withColumn(w, F.expr(f"filter(split(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"))
    df = df.withColumn(h, F.expr(_kmers(w, k))).drop(w)
    df = df.withColumn(s, F.expr(f"sort_array(transform({h}, (x, i) -> shiftleft(x & {low(KMER)}L, {PLACE}) | i))")).drop(h)
    df = df.withColumn(n, F.expr(f"sort_array(transform(transform({s}, (x, i) -> struct({numbered} as h, x & {low(PLACE)}L as p)), y -> shiftleft(y.h & {BINS - 1}L, {top}) | shiftleft(shiftrightunsigned(y.h, {per_bin}) & {low(NUMBERED)}L, {PLACE}) | y.p))")).drop(s)
    least = f"filter({n}, (x, i) -> i < {TUPLE} or shiftright(get({n}, i - {TUPLE}), {top}) <> shiftright(x, {top}))"
    df = df.withColumn(q, F.expr(f"sort_array(transform({least}, x -> shiftleft(shiftright(x, {top}), {top}) | shiftleft(x & {low(PLACE)}L, {NUMBERED}) | (shiftright(x, {PLACE}) & {low(NUMBERED)}L)))")).drop(n)
    same = lambda j: f"i >= {j} and shiftright(get({q}, i - {j}), {top}) = shiftright(x, {top})"
    parts = ", ".join(f"if({same(j)}, get({q}, i - {j}) & {low(NUMBERED)}L, null)" for j in range(TUPLE - 1, 0, -1))
    last = f"i = size({q}) - 1 or shiftright(get({q}, i + 1), {top}) <> shiftright(x, {top})"
    tuple_ = f"if({last}, cast(shiftleft(shiftright(x, {top}), 16) | (xxhash64({parts}{', ' if parts else ''}x & {low(NUMBERED)}L) & 65535L) as int), null)"
    return df.withColumn(out, F.expr(f"filter(transform({q}, (x, i) -> {tuple_}), x -> x is not null)")).drop(q)


def fingerprint(components: str):
    """Six hexadecimal digits for each bin that holds a k-mer: its number, then its tuple's hash."""
    return F.expr(f"array_join(transform({components}, x -> lower(lpad(hex(x), 6, '0'))), '')")


def likeness(a: str, b: str):
    """Share of agreeing bins among those that either text fills; 1 for two empty texts."""
    bins = f"size(array_union(transform({a}, x -> shiftright(x, 16)), transform({b}, x -> shiftright(x, 16))))"
    return F.expr(f"if(size({a}) = 0 and size({b}) = 0, 1D, size(array_intersect({a}, {b})) / {bins})")


def parse_fingerprint(column: str) -> str:
    """SQL for the components of a fingerprint string."""
    return f"transform(sequence(1, greatest(length({column}) div 6, 1)), i -> cast(conv(nullif(substring({column}, 6 * i - 5, 6), ''), 16, 10) as int))"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, fingerprint) per row. Null and blank texts have the empty fingerprint. Extra columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return with_components(rows, "_text", "_c", k).select("doc_id", fingerprint("_c").alias("fingerprint"))


def _buckets(ids: DataFrame) -> DataFrame:
    """ids(k, tie, bytes) -> one row (bi, bt): the least (k, tie) of each bucket but the first, from a bounded sample of ids."""
    rows, size = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n = max(1, min(MOST_BUCKETS, size // BUCKET_BYTES))
    share = int(min(1.0, 16 * n / max(rows, 1)) * (1 << 30))
    drawn = ids.where(F.pmod(F.xxhash64("k", "tie"), F.lit(1 << 30)) < share)
    held = drawn.agg(F.expr("array_sort(collect_list(struct(k, tie)))").alias("a"))
    cuts = held.select(F.expr(f"if({n} < 2 or size(a) < {n}, cast(array() as array<struct<k:bigint,tie:bigint>>), transform(sequence(1, {max(n - 1, 1)}), i -> a[cast(cast(i as bigint) * size(a) div {n} as int)]))").alias("c"))
    return materialize(cuts.select(F.col("c.k").alias("bi"), F.col("c.tie").alias("bt")), "cuts")


def _dealt(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows(k, tie, ...) with _bucket: how many cuts are at or below, found by halving."""
    steps = ", ".join(str(1 << b) for b in range(MOST_BUCKETS.bit_length() - 1, -1, -1))
    below = "t + d <= size(bi) and (bi[t + d - 1] < k or (bi[t + d - 1] = k and bt[t + d - 1] <= tie))"
    return rows.crossJoin(F.broadcast(cuts)).withColumn("_bucket", F.expr(f"aggregate(array({steps}), 0, (t, d) -> if({below}, t + d, t))")).drop("bi", "bt")  # cuts is one row


def with_next(rows: DataFrame, columns: list[str], ids: DataFrame, derive=lambda df: df) -> DataFrame:
    """derive(rows) with `_next`, a struct of the columns of the row after it by (k, tie); the first row's after the last.

    rows and ids have k and tie, never null. Rows are dealt to buckets of neighbours, so no task orders the whole table; the
    first row of each bucket also stands, as a copy, at the end of the bucket before it.
    """
    cuts = _buckets(ids)
    dealt = _dealt(rows, cuts)
    firsts = _dealt(ids, cuts).groupBy("_bucket").agg(F.min(F.struct("k", "tie")).alias("f"))
    before = F.coalesce(F.lag("_bucket").over(Window.orderBy("_bucket")), F.max("_bucket").over(Window.partitionBy()))  # MOST_BUCKETS rows at most
    firsts = materialize(firsts.select("f.k", "f.tie", before.alias("_before")), "firsts")
    copies = dealt.join(F.broadcast(firsts), ["k", "tie"]).withColumn("_bucket", F.col("_before")).drop("_before")
    both = derive(dealt.withColumn("_copy", F.lit(0)).unionByName(copies.withColumn("_copy", F.lit(1))))
    ahead = F.lead(F.struct(*columns)).over(Window.partitionBy("_bucket").orderBy("_copy", "k", "tie"))
    return both.withColumn("_next", ahead).where("_copy = 0").drop("_copy", "_bucket")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (of code points, rounded down) replaced by as many from the start of the next
    document by id; the first follows the last. Null texts are empty. Rows of one id are ordered by text hash, null ids
    stand where the least id would; of rows that repeat each other all but the last are followed by their like. A table of
    one row is its own next; an empty table gives no rows. Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("tie"))
    ids = materialize(rows.select("k", "tie", F.octet_length("text").cast("long").alias("bytes")), "ids")
    most = ids.groupBy("k", "tie").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    if most > 1:  # rows that repeat each other go through as one
        rows = rows.groupBy("k", "tie").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    rows = with_next(rows, ["text", "c"], ids, lambda df: with_components(df, "text", "c", k))
    if most > 1:
        last = rows.withColumn("q", F.explode(F.expr(f"sequence(0L, copies div {COPIES})")))
        last = last.repartition("k", "tie", "q") if most > COPIES else last
        last = last.withColumn("p", F.explode(F.expr(f"sequence(1L, least({COPIES}L, copies - q * {COPIES}L))"))).where(f"q * {COPIES}L + p <= copies")
        rows = last.withColumn("_next", F.when(F.expr("q = 0 and p = 1"), F.col("_next")).otherwise(F.struct("text", "c"))).drop("q", "p")
    rows = rows.withColumn("n", F.char_length("text")).withColumn("_cut", F.expr("n div 4").cast("int"))
    rows = rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.expr("concat(substring(text, 1, n - _cut), substring(_next.text, 1, _cut))").alias("edit"), "c", F.col("_next.c").alias("cn"))
    rows = with_components(rows, "edit", "ce", k)
    return rows.select("doc_id", "n_chars", F.sha2("edit", 256).alias("edited_sha256"), fingerprint("c").alias("fingerprint"), fingerprint("ce").alias("edited_fingerprint"), likeness("c", "ce").alias("near_edited"), likeness("c", "cn").alias("near_next"))


def op4_orderhash(spark, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
