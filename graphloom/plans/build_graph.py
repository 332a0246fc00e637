"""The whole job: interactions in, graph folders out.

    spark-submit --py-files graphloom.zip graphloom/plans/build_graph.py a <csv folder> <output folder>

``a`` and ``b`` are the two stand-in sources, ``text`` builds the graph of alike texts. Any other table
is built with ``build_graph(from_columns(...))``.
"""

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.bipartite import bipartite_edges
from graphloom.operators.clean import accepted, dedupe_latest, reject_report
from graphloom.operators.nodes import node_features, node_index, node_labels, number_keys
from graphloom.operators.relations import (
    Relation,
    co_item,
    co_user,
    pairs,
    rating_within_days,
    same_month,
    same_rating,
    text_overlap,
    union_members,
    union_pairs,
    with_members,
)
from graphloom.operators.summary import graph_summary
from graphloom.scratch import materialize
from graphloom.sources.csv import read_csv
from graphloom.sources.interactions import interactions_a_csv, interactions_b_csv
from graphloom.sources.store import Run

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def all_relations(events: DataFrame, graded: DataFrame | None = None) -> dict[str, Relation]:
    """Every relation built from interactions, by the name it has in the store.

    ``graded``, the last row of each user and item, has each user's item once, so relations by these
    two or by the grade come from it, most of them without another distinct; months come from
    the events. It is written to scratch first, as five relations read it.
    """
    graded = materialize(dedupe_latest(events), "graded") if graded is None else graded
    return {
        "co_user": co_user(graded, once=True),
        "co_item": co_item(graded, once=True),
        "same_rating": same_rating(graded, once=True),
        "same_month": same_month(events),
        "rating_7d": rating_within_days(graded, 7, True, once=True),
        "rating_7d_global": rating_within_days(graded, 7, False),
    }


def build_graph(
    interactions: DataFrame,
    dataset: str,
    out: str,
    bad_rows: DataFrame | None = None,
    with_pairs: tuple[str, ...] = (),
) -> Run:
    """Write the tables of one dataset under ``out``, as one run of the store.

    ``rejects``; ``nodes`` with a dense ``nid`` per node type, whatever type the keys have; and, with
    users and items as ``nid``, ``interactions`` (the last row per user and item), ``features``,
    ``bipartite``, ``members`` of all relations, ``edges`` with all pairs of the relations named in
    ``with_pairs`` (for sparse ones), and ``summary``. The input is read once.
    """
    run = Run(interactions.sparkSession, out, dataset)
    rows = materialize(interactions, "interactions")
    run.write(reject_report(rows, dataset, bad_rows), "rejects")
    events = accepted(rows)
    index = run.write(node_index(events), "nodes", ["ntype"])
    events = materialize(number_keys(events, index), "events")
    graded = run.write(dedupe_latest(events), "interactions")
    relations = {name: with_members(r) for name, r in all_relations(events, graded).items()}
    run.write(node_features(events), "features")
    bipartite = run.write(bipartite_edges(events), "bipartite")
    run.write(union_members(relations), "members", ["relation"])
    if with_pairs:
        run.write(union_pairs({name: pairs(relations[name]) for name in with_pairs}), "edges", ["relation"])
    run.write(graph_summary(events, bipartite, relations), "summary")
    run.finish()
    return run


def build_text_graph(documents: DataFrame, labels: DataFrame, dataset: str, out: str) -> Run:
    """Write the texts of a dataset with their labels and classes, and the edges between classes."""
    run = Run(documents.sparkSession, out, dataset)
    found = text_overlap(documents)
    name = F.lit(dataset).alias("dataset")
    texts = node_labels(documents, labels).join(found.classes, "doc_id", "left").select(name, "*")
    run.write(texts, "texts")
    run.write(union_pairs({"text_overlap": found.pairs.select(name, "*")}), "edges", ["relation"])
    run.finish()
    return run


def main(source: str, csv_dir: str, out: str) -> None:
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if source == "text":
        documents = read_csv(spark, f"{csv_dir}/documents", DOCUMENTS).rows
        labels = read_csv(spark, f"{csv_dir}/labels", LABELS, multiline=False).rows
        build_text_graph(documents, labels, source, out)
        return
    read, sparse = {
        "a": (interactions_a_csv, ("co_user", "co_item", "same_rating", "same_month", "rating_7d")),
        "b": (interactions_b_csv, ()),
    }[source]
    table = read(spark, csv_dir)
    build_graph(table.rows, source, out, table.bad, sparse)


if __name__ == "__main__":
    main(*sys.argv[1:])
