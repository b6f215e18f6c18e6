"""Routing graphs as GraphML and GraphViz text. Rows are made in Spark and streamed to one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInputError
from ..operators import graph as G

ALL = 127


def _name(v: str) -> F.Column:
    return F.concat(F.lit("n"), F.col(f"{v}.id").cast("string"), F.when(F.col(f"{v}.inv"), "i").otherwise(""))


def _edges(g: G.Graph, mask: int, cost_id: int) -> DataFrame:
    return g.view(mask, cost_id).select(_name("src").alias("a"), _name("dst").alias("b"), G.relation_name(F.col("relation")).alias("kind"), "relation", "cost", "cost_id")


def graphml(g: G.Graph, path: str, mask: int = ALL, cost_id: int = 0) -> None:
    if not path:
        raise InvalidInputError("a file needs a name")
    e = _edges(g, mask, cost_id)
    nodes = e.select(F.col("a").alias("n")).union(e.select("b")).distinct().orderBy("n")
    text = e.select("a", "b", F.format_string('<edge source="%s" target="%s"><data key="info">%s</data><data key="cost">%s</data></edge>', "a", "b", "kind", F.col("cost").cast("string")).alias("t")).orderBy("a", "b", "t")
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="info" for="edge" attr.name="info" attr.type="string"/>\n<key id="cost" for="edge" attr.name="cost" attr.type="double"/>\n<graph edgedefault="directed">\n')
        for r in nodes.toLocalIterator():
            f.write(f'<node id="{r.n}"/>\n')
        for r in text.toLocalIterator():
            f.write(r.t + "\n")
        f.write("</graph>\n</graphml>\n")


def graphviz(g: G.Graph, path: str, mask: int = ALL, cost_id: int = 0) -> None:
    """Neighbours that can't be changed to and conflicts carry no weight."""
    if not path:
        raise InvalidInputError("a file needs a name")
    colour = F.lit("black")
    for k, v in G.COLOURS.items():
        colour = F.when(F.col("relation") == k, v).otherwise(colour)
    weight = F.when(F.col("relation").isin(G.ADJACENT_LEFT, G.ADJACENT_RIGHT, G.CONFLICTING), "").otherwise(F.concat(F.lit(", weight="), F.col("cost").cast("string")))
    rows = _edges(g, mask, cost_id).select(F.concat("a", F.lit(" -> "), "b", F.lit(' [label="'), "kind", F.lit('", color="'), colour, F.lit('"'), weight, F.lit(", cost_id="), F.col("cost_id").cast("string"), F.lit("];")).alias("t"))
    with open(path, "w", encoding="utf-8") as f:
        f.write("digraph G {\n")
        for r in rows.orderBy("t").toLocalIterator():
            f.write(r.t + "\n")
        f.write("}\n")
