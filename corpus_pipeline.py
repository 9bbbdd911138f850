"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run() writes
each stage's rows to the shared folder and reads them back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, nearcopies, packing, simhash, substring, toxicity
from corpusmill.llm.common import discard, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones, does not call toxic.

    Null and empty texts have no words and stay; labels of documents that are not there are ignored.
    """
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.categories())
    scored = toxicity.score(docs.withColumns({f"_cm_{c}": F.col(c) for c in docs.columns if c != "text"}), chain)
    return scored.where("not is_toxic").select(*[F.col("text") if c == "text" else F.col(f"_cm_{c}").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document: that with the smallest id, null ids last; of rows that repeat it, one.

    Near duplicates share four fifths or more of their five-word shingles, or are chained by such texts. Blank texts are one group.
    """
    kept = materialize(simhash.representatives(nearcopies.near_copies(docs)), "kept")
    number = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    wanted = kept.select(number(F.col("doc_id")).alias("_cm_d"), F.col("text_hash").alias("_cm_t"), F.col("rows").alias("_cm_n"))
    keyed = docs.withColumns({"_cm_d": number(F.col("doc_id")), "_cm_t": F.xxhash64("text")})
    joined = keyed.join(wanted.hint("shuffle_hash"), ["_cm_d", "_cm_t"])
    if kept.where("rows > 1").isEmpty():
        return joined.select(*docs.columns)
    once = joined.where("_cm_n = 1").select(*docs.columns)
    return once.unionByName(joined.where("_cm_n > 1").dropDuplicates(["_cm_d", "_cm_t"]).select(*docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of passages of 35 words or more that stand anywhere else too; n_chars follows.

    Texts that lose nothing are left as they are, white space included; a text that loses all its words stays as an empty one.
    """
    cut = substring.cut_repeats(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    columns = {"text": text, "n_chars": F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return cut.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a benchmark item.

    Null and empty texts align with nothing and stay, as do repeated rows and rows without an id; of an empty table nothing is left.
    """
    keyed = docs.withColumn("_cm_key", F.xxhash64("doc_id", "text"))  # rows without an id are told apart by their text
    leaks = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_cm_key")
    leaks = materialize(leaks.select(F.col("doc_id").alias("_cm_key")).distinct(), "leaks")
    return keyed.join(leaks.hint("shuffle_hash"), "_cm_key", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id; repeated rows are packed each; an empty table gives no rows.
    """
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Trained weights, token ids and a packing plan are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # of what an earlier stage wrote; the documents themselves are no table of ours
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # its pieces are written
    return packed
