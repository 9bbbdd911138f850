"""Atom feeds, source manifests and harvested metadata pages, from XML text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..identity import collapse
from ..schemas import MANIFEST


def _text(name: str) -> Column:
    return collapse(F.coalesce(F.col(name).cast("string"), F.lit("")))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Feed entries -> papers; entries without an identifier go."""
    schema = "id string, title string, summary string, published string, primary_category struct<_term:string>, category array<struct<_term:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema(schema).load(path)
    arxiv = F.regexp_replace(F.regexp_extract("id", r"/abs/(.+)$", 1), r"v\d+$", "")
    return rows.select(
        F.nullif(arxiv, F.lit("")).alias("arxiv_id"), _text("id").alias("link"), _text("title").alias("title"), _text("summary").alias("abstract"),
        F.coalesce("primary_category._term", F.lit("")).alias("primary_category"), F.transform("category", lambda c: c["_term"]).alias("categories"), _text("published").alias("published"),
    ).where("arxiv_id is not null")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entries with ordinal; a missing field is an error that names it."""
    fields = [f.split() for f in MANIFEST.split(", ")]
    tag = {"size_bytes": "size"}
    schema = ", ".join(f"`{tag.get(n, n)}` string" for n, _ in fields)
    rows = spark.read.format("xml").option("rowTag", "file").schema(schema).load(path)
    need = lambda n: F.coalesce(F.col(tag.get(n, n)), F.raise_error(F.lit(f"manifest entry without {tag.get(n, n)}")).cast("string"))
    return rows.select(*[F.trim(need(n)).cast(t).alias(n) for n, t in fields], F.monotonically_increasing_id().alias("ordinal"))


def read_harvest(spark: SparkSession, path: str) -> DataFrame:
    """Metadata records -> (arxiv_id, categories, primary_category, title): the first category is the primary one."""
    schema = "metadata struct<arXiv:struct<id:string,title:string,categories:string,created:string>>"
    rows = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", "true").schema(schema).load(path)
    m = F.col("metadata.arXiv")
    kinds = F.filter(F.split(F.coalesce(m["categories"], F.lit("")), r"\s+"), lambda c: c != "")
    return rows.where(m["id"].isNotNull()).select(F.trim(m["id"]).alias("arxiv_id"), kinds.alias("categories"), F.try_element_at(kinds, F.lit(1)).alias("primary_category"), collapse(m["title"]).alias("title"))


def resumption_token(page: Column) -> Column:
    """The token that a page ends with; null on the last page."""
    return F.nullif(F.trim(F.regexp_extract(page, r"(?s)<resumptionToken[^>]*>(.*?)</resumptionToken>", 1)), F.lit(""))


def candidates(papers: DataFrame) -> DataFrame:
    """Abstract, else title, as the statement; papers with neither go."""
    statement = F.coalesce(F.nullif(F.col("abstract"), F.lit("")), F.nullif(F.col("title"), F.lit("")))
    return papers.withColumn("statement", statement).where("statement is not null").withColumn("provenance", F.lit("extracted"))


def _begins(prefix: str) -> Column:
    return F.exists("categories", lambda x: F.startswith(x, F.lit(prefix)))


def in_window(papers: DataFrame, categories: list[str], since: str | None = None) -> DataFrame:
    """Papers of a category, or of an archive written as name.*, submitted on or after a day."""
    has = F.lit(False)
    for c in categories:
        has = has | (_begins(c[:-1]) if c.endswith(".*") else F.array_contains("categories", c))
    return papers.where(has & (F.lit(True) if since is None else F.col("published") >= since))
