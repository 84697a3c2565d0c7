"""Connected components of a link table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.staging import shuffled, staged


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node with a link; component: its smallest reachable node.

    Alternates two steps until nothing changes: every node links its larger neighbours to
    its smallest neighbour (large star), then its smaller ones (small star). The number of
    rounds grows with the logarithm of the longest path. Each step is one aggregation and
    one join on the node, both of which Spark splits or pre-aggregates when a node is hot;
    each round is staged in the shared folder, so lost executors cost one round at most.
    The driver sees one digest per round, and no table is broadcast: links compress well, so
    small files may hold many. Null ends are ignored, loops and repeated links
    change nothing, and an empty table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    edges = staged(
        links.select(
            F.greatest(F.col(left), F.col(right)).alias("a"),
            F.least(F.col(left), F.col(right)).alias("b"),
        )
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (a != b))
        .distinct(),
        "links",
    )

    def digest(table: DataFrame) -> tuple:
        return tuple(
            table.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
            ).first()
        )

    seen = digest(edges)
    while seen[0]:
        both = edges.select("a", "b").union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = (
            both.where(b > a)
            .join(shuffled(least), "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(shuffled(low), "a")
            .select(
                F.when(b == F.col("low"), a).otherwise(b).alias("a"), F.col("low").alias("b")
            )
            .where(a != b)
            .distinct()
        )
        edges = staged(small, "links")
        now = digest(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)


def shared_ids(rows: DataFrame, id_column: str, node_column: str) -> DataFrame:
    """Links (a, b) between the nodes of rows that repeat an id.

    ``rows`` map ids to nodes; null ids and rows without a node link nothing. The ids are
    counted by one aggregation; only repeated ones are joined back.
    """
    known = rows.where(F.col(id_column).isNotNull() & F.col(node_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(node_column).alias("b")
    )
    several = known.groupBy("id").agg(F.min("b").alias("a"), F.max("b").alias("_high")).where("a < _high")
    return known.join(shuffled(several.select("id", "a")), "id").select("a", "b").distinct()
