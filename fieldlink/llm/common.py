"""What the operators share: the input view, written tables, ASCII lower-casing, components."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlink.session import ensure_checkpoint_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (doc_id, text), a null text read as empty; other columns, whatever their names, stay out."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while a column has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Cuts the lineage: later jobs, and retries after a lost executor, start
    from the written files.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected links ``(u, v)``: rows ``(node, root)``.

    ``root`` is the smallest node of the component; nodes without a link to
    another node do not appear. Every round replaces each node's parents by its
    smallest one and then jumps over one generation, so long chains shorten
    by halves. All steps are map-side combined aggregates and joins. AQE splits
    a hot node of a join only if the other side is not an aggregate of the same
    stage, so the aggregates are written before they are joined; each round is
    written out too.
    """
    up = (edges.where("u <> v")
          .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    up = staged(up, "links")
    for _ in range(rounds):
        low = staged(up.groupBy("u").agg(F.min("v").alias("p")), "links")
        hooked = up.join(low, "u")
        # u -> p; the other parents v of u -> p as well.
        flat = hooked.select(
            F.explode(F.array(F.struct("u", F.col("p").alias("v")), F.struct(F.col("v").alias("u"), F.col("p").alias("v")))).alias("e")
        ).select("e.*").where("u <> v").distinct()
        flat = staged(flat, "links")
        parent = staged(flat.groupBy("u").agg(F.min("v").alias("pp")), "links")
        jumped = flat.join(parent.withColumnRenamed("u", "x"), F.col("v") == F.col("x"), "left")
        # An edge to a node that has a parent itself is not final yet; keep that node's own edges too.
        nxt = staged(jumped.select("u", F.coalesce("pp", "v").alias("v"), F.col("pp").isNotNull().alias("moved")), "links")
        tally = nxt.groupBy("u").agg(F.count("*").alias("n"), F.max("moved").alias("m")).agg(
            F.max(F.col("n") > 1).alias("many"), F.max("m").alias("moved")).first()
        up = nxt.select("u", "v")
        if not (tally["many"] or tally["moved"]):
            return up.select(F.col("u").alias("node"), F.col("v").alias("root"))
        up = staged(up.where("u <> v").distinct(), "links")
    raise RuntimeError("components did not settle")
