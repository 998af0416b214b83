"""The entity graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loamdex.functions.text import sanitize_id, sanitize_relation

MENTIONS = "MENTIONS"


def last_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key by `order`, as an aggregate that combines before the shuffle: a hub is one row per task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def ingest(extractions: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """extractions (by, path, entities: array<struct<name,type,description>>, relationships: array<struct<source,target,relation,description>>) to nodes and edges.

    Entities with one id are one node; the last path's type and description win. Endpoints of relations become nodes by name alone."""
    none = F.lit(None).cast("string")
    documents = extractions.select(*by, sanitize_id(F.col("path")).alias("node_id"), F.lit("Document").alias("label"), none.alias("name"), F.lit("document").alias("type"), none.alias("description"), "path").dropDuplicates([*by, "node_id"])
    found = extractions.select(*by, "path", F.explode("entities").alias("e")).select(*by, "path", sanitize_id(F.col("e.name")).alias("node_id"), "e.name", "e.type", "e.description")
    related = extractions.select(*by, "path", F.explode("relationships").alias("r")).select(*by, "path", "r.*")
    ends = related.select(*by, "path", F.explode(F.array("source", "target")).alias("name")).select(*by, "path", sanitize_id(F.col("name")).alias("node_id"), "name", none.alias("type"), none.alias("description"))
    entities = found.withColumn("known", F.lit(1)).unionByName(ends.withColumn("known", F.lit(0)))
    entities = last_per(entities.withColumnRenamed("path", "seen_in"), [*by, "node_id"], [F.col("known").alias("_k"), F.col("seen_in").alias("_p"), F.col("name").alias("_n")])
    entities = entities.select(*by, "node_id", F.lit("Entity").alias("label"), "name", "type", "description", none.alias("path"))
    mentions = found.select(*by, sanitize_id(F.col("path")).alias("src"), F.col("node_id").alias("dst"), F.lit(MENTIONS).alias("rel_type"), none.alias("description"), F.col("path").alias("source_doc"))
    relations = related.select(*by, sanitize_id(F.col("source")).alias("src"), sanitize_id(F.col("target")).alias("dst"), sanitize_relation(F.col("relation")).alias("rel_type"), "description", F.col("path").alias("source_doc"))
    edges = last_per(mentions.unionByName(relations), [*by, "src", "dst", "rel_type", "source_doc"], [F.coalesce("description", F.lit("")).alias("_d")])
    return documents.unionByName(entities), edges


def merge(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, replaced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of knowledge bases (column kb) after documents (kb, path) were replaced or removed: their nodes and edges go, new ones come;
    an entity that is named again takes its new values."""
    kept_nodes = nodes.join(replaced.select("kb", "path").distinct().withColumn("label", F.lit("Document")), ["kb", "path", "label"], "left_anti").select(*nodes.columns)
    kept_nodes = kept_nodes.join(new_nodes.select("kb", "node_id", "label"), ["kb", "node_id", "label"], "left_anti").select(*nodes.columns)
    kept_edges = edges.join(replaced.select("kb", F.col("path").alias("source_doc")).distinct(), ["kb", "source_doc"], "left_anti").select(*edges.columns)
    return kept_nodes.unionByName(new_nodes.select(*nodes.columns)), kept_edges.unionByName(new_edges.select(*edges.columns))


def remove_document(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (path) go with their edges, those of relations they were the source of included; entities stay."""
    ids = paths.select(sanitize_id(F.col("path")).alias("node_id"))
    kept = nodes.join(ids.withColumn("label", F.lit("Document")), ["node_id", "label"], "left_anti").select(*nodes.columns)
    return kept, edges.join(paths.select(F.col("path").alias("source_doc")).distinct(), "source_doc", "left_anti").select(*edges.columns)


def matching_entities(nodes: DataFrame, query: str) -> DataFrame:
    """Entities whose lower-cased name holds any word of the query."""
    words = query.lower().split()
    names = F.lower(F.col("name"))
    match = F.lit(False)
    for w in words:
        match = match | names.contains(w)
    return nodes.where((F.col("label") == "Entity") & match)


def _names_near(found: DataFrame, nodes: DataFrame, edges: DataFrame, by: list[str], most: int | None) -> DataFrame:
    """(by, node_id, names): names of entities one relation away from found ones (by, node_id), in either direction; `most`: the first so many.

    Pairs are made distinct before they are gathered."""
    links = edges.where(F.col("rel_type") != MENTIONS).select(*by, "src", "dst")
    both = links.unionByName(links.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both.join(found.select(*by, F.col("node_id").alias("src")), [*by, "src"], "left_semi").distinct()
    names = nodes.where(F.col("label") == "Entity").select(*by, F.col("node_id").alias("dst"), "name")
    near = near.join(names, [*by, "dst"]).select(*by, F.col("src").alias("node_id"), "name").distinct()
    if most is not None:
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "node_id").orderBy("name"))).where(F.col("_r") <= most)
    return near.groupBy(*by, "node_id").agg(F.sort_array(F.collect_list("name")).alias("names"))


def search(nodes: DataFrame, edges: DataFrame, query: str, limit: int | None = 10, hops: int = 0, decay: float = 0.5, by: tuple[str, ...] = (), related: int | None = None) -> DataFrame:
    """(by, path, score, related_entities) of documents that mention a matching entity; each document once.

    hops: also those that mention entities so many relations away, their score multiplied by `decay` per hop.
    by: columns that keep graphs apart. Only the documents that are returned have their related entities looked up; related: at most so
    many of them by name, 0: none."""
    by = list(by)
    found = matching_entities(nodes, query).select(*by, "node_id", F.lit(1.0).alias("score"))
    if hops:
        links = edges.where(F.col("rel_type") != MENTIONS).select(*by, "src", "dst")
        both = links.unionByName(links.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        for _ in range(hops):
            further = both.join(found.withColumnRenamed("node_id", "src"), [*by, "src"]).select(*by, F.col("dst").alias("node_id"), (F.col("score") * decay).alias("score"))
            found = found.unionByName(further).groupBy(*by, "node_id").agg(F.max("score").alias("score"))
    mentions = edges.where(F.col("rel_type") == MENTIONS).select(*by, "src", F.col("dst").alias("node_id"))
    best = mentions.join(found, [*by, "node_id"]).groupBy(*by, "src").agg(F.max("score").alias("score"), F.min("node_id").alias("node_id"))
    documents = nodes.where(F.col("label") == "Document").select(*by, F.col("node_id").alias("src"), "path")
    best = best.join(documents, [*by, "src"]).groupBy(*by, "path").agg(F.max("score").alias("score"), F.min("node_id").alias("node_id"))
    if limit:
        best = best.orderBy(F.desc("score"), *by, "path").limit(limit)
    near = _names_near(best.select(*by, "node_id").distinct(), nodes, edges, by, related) if related != 0 else None
    out = best.withColumn("names", F.lit(None).cast("array<string>")) if near is None else best.join(near, [*by, "node_id"], "left")
    out = out.select(*by, "path", "score", F.coalesce("names", F.array().cast("array<string>")).alias("related_entities"))
    return out.orderBy(F.desc("score"), *by, "path") if limit else out


def neighbours(nodes: DataFrame, edges: DataFrame, query: str, related: int | None = None) -> DataFrame:
    """(node_id, name, neighbours): names of the entities one relation away, in either direction."""
    found = matching_entities(nodes, query).select("node_id", "name")
    return found.join(_names_near(found, nodes, edges, [], related).withColumnRenamed("names", "neighbours"), "node_id")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count."""
    return nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))
