"""Queries of problem 3: the most similar vectors of every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.neighbours import greedy_search, neighbour_graph, nodes_of, ranked, searched, usable_vectors
from strataloom.session import write_shared
from strataloom.sources.tables import table

K, LEAST_COSINE = 10, 0.90


def _parts(spark: SparkSession, folder: str):
    usable = write_shared(usable_vectors(table(spark, folder, "vectors")))
    nodes = nodes_of(usable)
    return usable, nodes, neighbour_graph(nodes)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which one is among the other's ten most similar, with a cosine of at least 0.90."""
    near = ranked(*_parts(spark, folder), k=K, least=LEAST_COSINE)
    return near.select(F.least("vector_id", "neighbour_id").alias("vector_id_a"), F.greatest("vector_id", "neighbour_id").alias("vector_id_b")).distinct()


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar vectors of every vector, ranked."""
    return ranked(*_parts(spark, folder), k=K).withColumn("cosine", F.round("cosine", 6))


def p3_search(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy search for every vector whose number is divisible by 100: its ten most similar vectors but itself."""
    usable, nodes, graph = _parts(spark, folder)
    number = F.regexp_extract("vector_id", r"(\d+)\D*$", 1).cast("bigint")
    asked = usable.filter(number % 100 == 0).dropDuplicates(["vector_id"]).select(F.col("vector_id").alias("query"), "grp", "small", "vec")
    hits = greedy_search(graph, nodes, usable, asked, K + 1)  # one more, as the query's own vector is a node
    return searched(usable, nodes, hits, K).withColumn("cosine", F.round("cosine", 6))


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_search": p3_search}

#: Exact by comparing all pairs of a collection.
ORACLES = {
    "p3_found": """
        WITH v AS (SELECT DISTINCT vector_id, collection_name, dimension, embedding::DOUBLE[] AS e FROM vectors
            WHERE embedding IS NOT NULL AND len(embedding) = dimension AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        r AS (SELECT a.vector_id AS a, b.vector_id AS b, list_cosine_similarity(a.e, b.e) AS c, row_number() OVER (PARTITION BY a.vector_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vector_id) AS rank
            FROM v a JOIN v b ON a.collection_name = b.collection_name AND a.dimension = b.dimension AND a.vector_id <> b.vector_id)
        SELECT DISTINCT least(a, b) AS vector_id_a, greatest(a, b) AS vector_id_b FROM r WHERE rank <= 10 AND c >= 0.90""",
}
