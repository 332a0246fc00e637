
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from graphloom.functions import rating_from_quantity  # noqa: E402
from graphloom.operators import bipartite, clean, nodes, relations  # noqa: E402
from graphloom.operators.components import components  # noqa: E402
from graphloom.operators.knn import knn_edges  # noqa: E402
from graphloom.operators.pagerank import pagerank  # noqa: E402
from graphloom.operators.split import time_at, time_split  # noqa: E402
from graphloom.operators.counts import PRECISION, member_pairs, neighbours  # noqa: E402
from graphloom.operators.summary import graph_summary  # noqa: E402
from graphloom.operators.topk import topk_neighbours  # noqa: E402
from graphloom.plans.build_graph import (  # noqa: E402
    all_relations,
    build_graph,
    build_text_graph,
)
from graphloom.scratch import materialize, scratch_path  # noqa: E402
from graphloom.sources import interactions as inter  # noqa: E402
from graphloom.sources.csv import read_csv, write_csv  # noqa: E402
from graphloom.sources.store import Run, read_relation, read_table  # noqa: E402
from graphloom.streaming import edges as stream  # noqa: E402

try:  # the corpus operators may be left out of an installation
    import corpus_pipeline
    from graphloom.llm import queries as llm
except ImportError:
    corpus_pipeline = llm = None

SPARSE = ("co_user", "co_item", "same_rating", "same_month", "rating_7d")
CORE = 20
ROUNDS = 10  # of the registered PageRank, the same in its SQL
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _a(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(inter.interactions_a(spark, sf_dir))


def _b(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(inter.interactions_b(spark, sf_dir))


def _csv_copy(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """The tables as CSV folders in scratch space."""
    root = scratch_path(spark, "csv")
    for name in names:
        write_csv(_table(spark, sf_dir, name), f"{root}/{name}")
    return root


def _csv_back(name: str, schema: str) -> Query:
    return lambda spark, sf_dir: read_csv(
        spark, f"{_csv_copy(spark, sf_dir, name)}/{name}", schema
    ).rows


def _csv_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a customer that is no number in every urgent one."""
    path = scratch_path(spark, "csv")
    broken = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("c"), "o_custkey"))
    orders = _table(spark, sf_dir, "orders")
    write_csv(orders.withColumn("o_custkey", F.coalesce(broken, F.col("o_custkey").cast("string"))), path)
    table = read_csv(spark, path, inter.ORDERS, multiline=False)
    return table.rows.select(F.lit("good").alias("kind")).unionByName(
        table.bad.select(F.lit("bad").alias("kind"))
    ).groupBy("kind").agg(F.count("*").alias("n"))


def _write_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions as intermediate CSV, read back."""
    path = scratch_path(spark, "csv")
    write_csv(inter.interactions_a(spark, sf_dir), path)
    schema = "dataset string, u bigint, i bigint, r int, ts timestamp_ntz"
    return read_csv(spark, path, schema, multiline=False).rows


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source A with customers and parts known by name only."""
    joined = (
        _table(spark, sf_dir, "lineitem")
        .join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("grade", rating_from_quantity(F.col("l_quantity")))
    )
    columns = {"u": "c_name", "i": "p_name", "r": "grade", "ts": "o_orderdate"}
    return inter.from_columns(joined, "a", columns)


def _number_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = materialize(_named(spark, sf_dir), "named")
    return nodes.number_keys(names, nodes.node_index(names))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources in one table."""
    return inter.interactions_a(spark, sf_dir).unionByName(inter.interactions_b(spark, sf_dir))


def _reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.reject_report(inter.interactions_a(spark, sf_dir), "a").unionByName(
        clean.reject_report(inter.interactions_b(spark, sf_dir), "b")
    )


def _reject_report_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source A with every kind of bad row: open orders have no customer, some grades are 6."""
    joined = _table(spark, sf_dir, "lineitem").join(
        _table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    dirty = inter.canonical(
        joined,
        "dirty",
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")),
        F.col("l_partkey"),
        F.ceil(F.col("l_quantity") / 10) + F.col("l_linenumber") % 2,
        F.col("o_orderdate"),
    )
    return clean.reject_report(dirty, "dirty")


def _graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inter.interactions_a(spark, sf_dir)
    out = scratch_path(spark, "store")
    run = Run(spark, out, "a")
    parts = {"same_month": relations.same_month(a), "rating_7d": relations.rating_within_days(a)}
    run.write(relations.union_members(parts), "members", ["relation"])
    run.finish()
    return read_relation(spark, out, "members", "a", "same_month")


def _rating_7d(interactions: DataFrame, same_item: bool = True) -> relations.Relation:
    """Equal grades within a week; grades are those of the last row of a user and item."""
    return relations.rating_within_days(clean.dedupe_latest(interactions), 7, same_item, once=True)


def _member_pairs(interactions: DataFrame) -> DataFrame:
    """Members and related pairs of them, per key of the relations within a week."""
    graded = materialize(clean.dedupe_latest(interactions), "graded")
    parts = []
    for name, same_item in (("rating_7d", True), ("rating_7d_global", False)):
        relation = relations.with_members(relations.rating_within_days(graded, 7, same_item, once=True))
        key = F.concat_ws(":", *relation.keys[1:]).alias("key")
        found = member_pairs(relation)
        parts.append(found.select("dataset", F.lit(name).alias("relation"), key, "members", "pairs"))
    return parts[0].unionByName(parts[1])


def _neighbour_estimates(interactions: DataFrame) -> DataFrame:
    """Users by items: their counted neighbours, and whether the estimate is within four standard errors."""
    relation = relations.with_members(relations.co_user(interactions))
    ends = F.explode(F.array("src", "dst")).alias("node")
    counted = relations.pairs(relation).select("dataset", ends).groupBy("dataset", "node").agg(F.count("*").alias("counted"))
    both = neighbours(relation).join(counted, ["dataset", "node"], "left").fillna(0, ["counted"])
    near = F.abs(F.col("neighbours") - F.col("counted")) <= 4 * 1.04 / 2 ** (PRECISION / 2) * F.col("counted")
    return both.select("dataset", "node", "counted", near.alias("near"))


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of each whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return knn_edges(vectors, 10, 50).withColumn("distance", F.round("distance", 6))


def _pagerank(interactions: DataFrame) -> DataFrame:
    ranks = pagerank(relations.co_user(interactions), rounds=ROUNDS, tolerance=0.0)
    return ranks.withColumn("rank", F.round("rank", 9))


def _stream_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source B as a stream of four files in no order; the edges when all are read."""
    root = scratch_path(spark, "stream")
    events = inter.interactions_b(spark, sf_dir)
    events.repartition(4, F.xxhash64("u", "i", "ts")).write.parquet(f"{root}/in")
    stream.follow_edges(stream.event_files(spark, f"{root}/in"), f"{root}/out", f"{root}/state")
    return stream.edges_now(spark, f"{root}/out")


def _stream_daily_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source B as a stream of three files in order of time; the edges of the days that were closed."""
    root = scratch_path(spark, "stream")
    events = inter.interactions_b(spark, sf_dir)
    cuts = [F.lit(time_at(events, percent)).cast("timestamp_ntz") for percent in (33, 66)]
    part = F.when(F.col("ts") <= cuts[0], 0).when(F.col("ts") <= cuts[1], 1).otherwise(2)
    for n in range(3):
        events.where(part == n).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream.follow_daily_edges(stream.event_files(spark, f"{root}/in"), f"{root}/out", f"{root}/state")
    return spark.read.schema(stream.DAILY).parquet(f"{root}/out")


def _members(interactions: DataFrame) -> DataFrame:
    return relations.union_members(all_relations(interactions))


def _summary(interactions: DataFrame) -> DataFrame:
    return graph_summary(interactions, bipartite.bipartite_edges(interactions), all_relations(interactions))


def _build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on the CSV files of source B; the summary it wrote."""
    table = inter.interactions_b_csv(spark, _csv_copy(spark, sf_dir, "events"))
    out = scratch_path(spark, "graph")
    build_graph(table.rows, "b", out, table.bad)
    return read_table(spark, out, "summary", "b")


def _build_graph_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on the CSV files of source A, with pairs; the edges it wrote, as raw keys."""
    table = inter.interactions_a_csv(spark, _csv_copy(spark, sf_dir, "orders", "lineitem"))
    out = scratch_path(spark, "graph")
    build_graph(table.rows, "a", out, table.bad, SPARSE)
    edges, index = read_table(spark, out, "edges", "a"), read_table(spark, out, "nodes", "a")
    ntype = F.when(F.col("relation") == "co_item", "item").otherwise("user")
    for end in ("src", "dst"):
        names = index.select(F.col("ntype").alias("t"), F.col("nid").alias(end), F.col("key").alias(f"{end}_key"))
        edges = edges.withColumn("t", ntype).join(names, ["t", end])
    # ids rank the keys, so the smaller end stays the smaller one
    return edges.select("dataset", "relation", F.col("src_key").alias("src"), F.col("dst_key").alias("dst"), "w")


def _build_graph_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on keys that are text; the user-item edges it wrote, in ids."""
    out = scratch_path(spark, "graph")
    build_graph(_named(spark, sf_dir), "a", out)
    return read_table(spark, out, "bipartite", "a")


def _build_text_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text job; the edges it wrote."""
    out = scratch_path(spark, "graph")
    build_text_graph(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "t", out)
    return read_table(spark, out, "edges", "t").select("dataset", "relation", "src", "dst", "w")


def _text(spark: SparkSession, sf_dir: str) -> relations.TextOverlap:
    return relations.text_overlap(_table(spark, sf_dir, "documents"))


def _union_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = all_relations(inter.interactions_a(spark, sf_dir))
    found = {name: relations.pairs(built[name]) for name in SPARSE}
    found["text_overlap"] = _text(spark, sf_dir).pairs.select(F.lit("a").alias("dataset"), "*")
    return relations.union_pairs(found)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: every user's five nearest users by shared items, source A."""
    return queries()["topk_neighbours"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return _graph_queries() | (llm.queries() | {"pipeline": corpus_pipeline.run} if llm else {})


def _graph_queries() -> dict[str, Query]:
    edges = bipartite.bipartite_edges
    return {
        "read_csv_strict": _csv_back("documents", DOCUMENTS),
        "read_csv_pages": _csv_back("pages", PAGES),
        "read_csv_bad_rows": _csv_bad_rows,
        "write_csv": _write_csv,
        "interactions_a": _a(lambda a: a),
        "interactions_b": _b(lambda b: b),
        "interactions_a_csv": lambda spark, sf_dir: inter.interactions_a_csv(
            spark, _csv_copy(spark, sf_dir, "orders", "lineitem")
        ).rows,
        "interactions_b_csv": lambda spark, sf_dir: inter.interactions_b_csv(
            spark, _csv_copy(spark, sf_dir, "events")
        ).rows,
        "reject_report": _reject_report,
        "reject_report_dirty": _reject_report_dirty,
        "dedupe_latest": _a(clean.dedupe_latest),
        "dedupe_latest_b": _b(clean.dedupe_latest),
        "node_index": _a(nodes.node_index),
        "number_keys": _number_keys,
        "bipartite_edges": _a(edges),
        "bipartite_edges_b": _b(edges),
        "node_degrees": _a(lambda a: nodes.node_degrees(edges(a))),
        "min_degree": _a(lambda a: bipartite.items_with_degree(edges(a), 30)),
        "min_degree_edges": _a(lambda a: bipartite.min_degree(edges(a), 30)),
        "k_core": _a(lambda a: bipartite.k_core(edges(a), CORE)),
        "graph_store": _graph_store,
        "graph_summary": _a(_summary),
        "graph_summary_b": _b(_summary),
        "graph_summary_ab": lambda spark, sf_dir: _summary(_both(spark, sf_dir)),
        "members_a": _a(_members),
        "members_b": _b(_members),
        "members_ab": lambda spark, sf_dir: _members(_both(spark, sf_dir)),
        "dedupe_latest_ab": lambda spark, sf_dir: clean.dedupe_latest(_both(spark, sf_dir)),
        "rel_co_user": _a(lambda a: relations.pairs(relations.co_user(a))),
        "rel_co_user_b": _b(lambda b: relations.co_user(b).members),
        "rel_co_item": _a(lambda a: relations.pairs(relations.co_item(a))),
        "rel_co_item_b": _b(lambda b: relations.co_item(b).members),
        "rel_same_rating": _a(lambda a: relations.pairs(relations.same_rating(clean.dedupe_latest(a), once=True))),
        "rel_same_month": _a(lambda a: relations.pairs(relations.same_month(a))),
        "rel_same_month_b": _b(lambda b: relations.same_month(b).members),
        "rel_rating_7d": _a(lambda a: relations.pairs(_rating_7d(a))),
        "rel_rating_7d_global": _a(lambda a: _rating_7d(a, same_item=False).members),
        "member_pairs": _a(_member_pairs),
        "neighbour_estimates": _a(_neighbour_estimates),
        "knn_edges": _knn,
        "pagerank_co_user_b": _b(_pagerank),
        "time_split": _a(time_split),
        "time_split_b": _b(time_split),
        "stream_bipartite_edges": _stream_edges,
        "stream_daily_edges": _stream_daily_edges,
        "components_co_user_b": _b(lambda b: components(relations.co_user(b))),
        "components_same_month": _a(lambda a: components(relations.same_month(a))),
        "components_rating_7d": _a(lambda a: components(_rating_7d(a))),
        "rel_text_overlap": lambda spark, sf_dir: _text(spark, sf_dir).pairs,
        "text_classes": lambda spark, sf_dir: _text(spark, sf_dir).classes,
        "topk_neighbours": _a(lambda a: topk_neighbours(relations.co_user(a))),
        "topk_neighbours_b": _b(lambda b: topk_neighbours(relations.co_user(b))),
        "union_relations": _union_relations,
        "node_features": _a(nodes.node_features),
        "node_features_b": _b(nodes.node_features),
        "node_labels": lambda spark, sf_dir: nodes.node_labels(
            _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
        ),
        "build_graph": _build_graph,
        "build_graph_a": _build_graph_a,
        "build_graph_text_keys": _build_graph_text_keys,
        "build_text_graph": _build_text_graph,
    }


_A = """
    SELECT 'a' AS dataset, o_custkey AS u, l_partkey AS i,
           CAST(ceil(l_quantity / 10) AS INTEGER) AS r, CAST(o_orderdate AS TIMESTAMP) AS ts
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

_B = """
    SELECT 'b' AS dataset, user_id AS u,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS i,
           CAST(NULL AS INTEGER) AS r, CAST(ts AS TIMESTAMP) AS ts
    FROM events"""

_AB = f"{_A} UNION ALL {_B}"

_NAMED = """
    SELECT 'a' AS dataset, dense_rank() OVER (ORDER BY c_name) - 1 AS u,
           dense_rank() OVER (ORDER BY p_name) - 1 AS i,
           CAST(ceil(l_quantity / 10) AS INTEGER) AS r, CAST(o_orderdate AS TIMESTAMP) AS ts
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"""

_DIRTY = """
    SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS u, l_partkey AS i,
           CAST(ceil(l_quantity / 10) + l_linenumber % 2 AS INTEGER) AS r
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

_CLASSES = """
    SELECT doc_id, tokens, min(doc_id) OVER (PARTITION BY tokens) AS class_id FROM (
        SELECT doc_id, list_sort(list_distinct(list_filter(
                   string_split(lower(text), ' '), lambda t: t <> ''))) AS tokens FROM documents)
    WHERE len(tokens) > 0"""

_TEXT = f"""
    WITH c AS (SELECT DISTINCT class_id AS id, tokens FROM ({_CLASSES})),
    t AS (SELECT id, len(tokens) AS n, unnest(tokens) AS token FROM c)
    SELECT a.id AS src, b.id AS dst, count(*) AS w
    FROM t a JOIN t b ON a.token = b.token AND a.id < b.id
    GROUP BY a.id, b.id, a.n, b.n HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 50"""


def _members_sql(source: str, columns: str) -> str:
    """Distinct rows of the columns, without nulls."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns.split(", "))
    return f"SELECT DISTINCT {columns} FROM ({source}) s WHERE {known}"


def _share_sql(source: str, keys: str, node: str) -> str:
    both = f"dataset, {keys}"
    return f"""
    WITH x AS ({_members_sql(source, f"{both}, {node}")})
    SELECT dataset, p.{node} AS src, q.{node} AS dst, count(*) AS w
    FROM x p JOIN x q USING ({both}) WHERE p.{node} < q.{node} GROUP BY dataset, p.{node}, q.{node}"""


def _with_month(source: str) -> str:
    return f"""
    SELECT dataset, u, i, CAST(year(ts) * 100 + month(ts) AS INTEGER) AS month FROM ({source}) t"""


def _with_day(source: str) -> str:
    return f"""
    SELECT dataset, u, i, r, CAST(date_diff('day', TIMESTAMP '1970-01-01', ts) AS INTEGER) AS day
    FROM ({source}) t"""


def _days_sql(source: str, keys: str) -> str:
    return f"""
    WITH x AS ({_members_sql(_with_day(source), f"dataset, {keys}, u, day")})
    SELECT DISTINCT dataset, a.u AS src, b.u AS dst, CAST(1 AS BIGINT) AS w
    FROM x a JOIN x b USING (dataset, {keys})
    WHERE a.u < b.u AND b.day BETWEEN a.day - 7 AND a.day + 7"""


def _split_sql(source: str) -> str:
    return f"""
    WITH s AS ({source}),
    c AS (SELECT min(ts) AS cut FROM (
              SELECT ts, count(*) OVER (ORDER BY ts) AS k, count(*) OVER () AS n FROM s WHERE ts IS NOT NULL)
          WHERE k * 100 >= n * 80)
    SELECT s.*, CASE WHEN ts <= cut THEN 'train' WHEN (u, i) IN (SELECT (u, i) FROM s, c WHERE ts <= cut) THEN 'known'
                     WHEN ts > cut THEN 'test' END AS part
    FROM s, c"""


def _components_sql(members: str, pairs: str) -> str:
    """Labels that go along the pairs until no smaller one comes, from the members and the pairs of a relation."""
    return f"""
    WITH RECURSIVE n AS (SELECT DISTINCT dataset, u AS node FROM ({members})),
    p AS MATERIALIZED ({pairs}),
    e AS MATERIALIZED (SELECT dataset, src AS a, dst AS b FROM p UNION ALL SELECT dataset, dst, src FROM p
                       UNION ALL SELECT dataset, node, node FROM n),
    r AS (SELECT dataset, node, node AS component, 0 AS round, true AS moved FROM n
          UNION ALL
          SELECT * FROM (
              SELECT dataset, node, best, round + 1, bool_or(best < component) OVER () FROM (
                  SELECT r.dataset, e.a AS node, min(r.component) AS best,
                         min(CASE WHEN e.a = e.b THEN r.component END) AS component, max(r.round) AS round
                  FROM r JOIN e ON r.dataset = e.dataset AND r.node = e.b WHERE r.moved GROUP BY r.dataset, e.a)))
    SELECT dataset, node, component FROM r WHERE round = (SELECT max(round) FROM r)"""


def _topk_sql(source: str) -> str:
    return f"""
    WITH x AS (SELECT DISTINCT dataset, u, i FROM ({source}) s),
    p AS (SELECT dataset, a.u AS node, b.u AS neighbour, count(*) AS w
          FROM x a JOIN x b USING (dataset, i) WHERE a.u <> b.u GROUP BY dataset, a.u, b.u)
    SELECT * FROM (
        SELECT dataset, node, CAST(row_number() OVER (
                   PARTITION BY dataset, node ORDER BY w DESC, neighbour) AS INTEGER) AS rank,
               neighbour, w FROM p) WHERE rank <= 5"""


def _pairs_sql(source: str) -> dict[str, str]:
    """The sparse relations as pairs; grades are those of the last row of a user and item."""
    last = _dedupe_sql(source)
    return {
        "co_user": _share_sql(source, "i", "u"),
        "co_item": _share_sql(source, "u", "i"),
        "same_rating": _share_sql(last, "i, r", "u"),
        "same_month": _share_sql(_with_month(source), "i, month", "u"),
        "rating_7d": _days_sql(last, "i, r"),
    }


def _edges_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT dataset, '{name}' AS relation, src, dst, w FROM ({sql})"
        for name, sql in _pairs_sql(source).items()
    )


RELATIONS = ("co_user", "co_item", "same_rating", "same_month", "rating_7d", "rating_7d_global")


def _all_members_sql(source: str) -> str:
    last, month = _dedupe_sql(source), _with_month(source)
    none = "CAST(NULL AS INTEGER)"
    parts = [
        ("co_user", "CAST(i AS VARCHAR)", "u", none, _members_sql(source, "dataset, i, u")),
        ("co_item", "CAST(u AS VARCHAR)", "i", none, _members_sql(source, "dataset, u, i")),
        ("same_rating", "concat(i, ':', r)", "u", none, _members_sql(last, "dataset, i, r, u")),
        ("same_month", "concat(i, ':', month)", "u", none, _members_sql(month, "dataset, i, month, u")),
        ("rating_7d", "concat(i, ':', r)", "u", "day", _members_sql(_with_day(last), "dataset, i, r, u, day")),
        ("rating_7d_global", "CAST(r AS VARCHAR)", "u", "day", _members_sql(_with_day(last), "dataset, r, u, day")),
    ]
    return " UNION ALL ".join(
        f"SELECT dataset, '{name}' AS relation, {key} AS key, {node} AS node, {day} AS day FROM ({sql})"
        for name, key, node, day, sql in parts
    )


def _summary_sql(source: str) -> str:
    names = ", ".join(f"('{name}')" for name in RELATIONS)
    return f"""
    WITH s AS MATERIALIZED ({source}),
    m AS MATERIALIZED ({_all_members_sql("SELECT * FROM s")}),
    z AS (SELECT dataset, relation, key, count(DISTINCT node) AS d FROM m GROUP BY ALL),
    p AS MATERIALIZED (SELECT p.dataset, p.relation, p.node AS a, q.node AS b, count(*) AS n
                       FROM m p JOIN m q USING (dataset, relation, key)
                       WHERE p.node < q.node AND (p.day IS NULL OR abs(p.day - q.day) <= 7) GROUP BY ALL),
    t AS (SELECT dataset, relation, count(DISTINCT node) AS touched
          FROM (SELECT dataset, relation, unnest([a, b]) AS node FROM p) GROUP BY ALL),
    c AS (SELECT dataset, relation, count(*) AS pairs, sum(n) AS pair_key_count FROM p GROUP BY ALL),
    b AS (SELECT DISTINCT dataset, u, i FROM s),
    bi AS (SELECT dataset, i, count(*) AS d FROM b GROUP BY ALL),
    n AS (SELECT dataset, count(DISTINCT u) AS users, count(DISTINCT i) AS items FROM s GROUP BY ALL),
    st AS (SELECT dataset, relation, count(*) AS keys, sum(d) AS members, max(d) AS largest FROM z GROUP BY ALL
           UNION ALL SELECT dataset, 'bipartite_edges', count(*), sum(d), max(d) FROM bi GROUP BY ALL),
    r AS (SELECT dataset, col0 AS relation, CASE col0 WHEN 'co_item' THEN items ELSE users END AS nodes,
                 CASE col0 WHEN 'co_item' THEN items * (items - 1) / 2 ELSE users * (users - 1) / 2 END AS possible,
                 0 AS all_touched, 0 AS all_pairs
          FROM (VALUES {names}), n
          UNION ALL SELECT dataset, 'bipartite_edges', users + items, users * items, users + items, members
          FROM n JOIN st USING (dataset) WHERE relation = 'bipartite_edges')
    SELECT dataset, relation, nodes, CAST(coalesce(touched, all_touched) AS BIGINT) AS touched,
           CAST(nodes - coalesce(touched, all_touched) AS BIGINT) AS isolated,
           CAST(coalesce(keys, 0) AS BIGINT) AS keys, CAST(coalesce(members, 0) AS BIGINT) AS members,
           CAST(coalesce(largest, 0) AS BIGINT) AS largest,
           CAST(coalesce(pair_key_count, all_pairs) AS BIGINT) AS pair_key_count,
           CAST(coalesce(pairs, all_pairs) AS BIGINT) AS pairs, true AS exact,
           CASE WHEN possible > 0 THEN round(CAST(coalesce(pairs, all_pairs) AS DOUBLE) / possible, 9)
                ELSE 0.0::DOUBLE END AS density
    FROM r LEFT JOIN st USING (dataset, relation) LEFT JOIN t USING (dataset, relation)
    LEFT JOIN c USING (dataset, relation)"""


def _features_sql(source: str) -> str:
    return f"""
    SELECT dataset, u, count(*) AS events, count(DISTINCT i) AS items,
           round(avg(r), 6) AS r_mean, round(stddev_samp(r), 6) AS r_stddev,
           count(DISTINCT CAST(ts AS DATE)) AS active_days,
           min(ts) AS first_ts, max(ts) AS last_ts
    FROM ({source}) s GROUP BY dataset, u"""


def _bipartite_sql(source: str) -> str:
    return f"""
    SELECT dataset, u, i, count(*) AS w, min(ts) AS first_ts, max(ts) AS last_ts
    FROM ({source}) s GROUP BY dataset, u, i"""


def _dedupe_sql(source: str) -> str:
    return f"""
    SELECT dataset, u, i, r, ts FROM (
        SELECT *, row_number() OVER (PARTITION BY dataset, u, i ORDER BY ts DESC, r DESC NULLS LAST) AS n
        FROM ({source}) s) WHERE n = 1"""


def _reject_sql(source: str, dataset: str) -> str:
    return f"""
    SELECT '{dataset}' AS dataset, x.reason, count(y.reason) AS n
    FROM (VALUES ('null_key'), ('bad_rating'), ('superseded')) x(reason) LEFT JOIN (
        SELECT CASE WHEN u IS NULL OR i IS NULL THEN 'null_key'
                    WHEN r NOT BETWEEN 1 AND 5 THEN 'bad_rating'
                    WHEN row_number() OVER (
                        PARTITION BY u, i, coalesce(r BETWEEN 1 AND 5, true)) > 1
                    THEN 'superseded' END AS reason
        FROM ({source}) s) y ON x.reason = y.reason GROUP BY x.reason"""


def oracle_sql() -> dict[str, str]:
    return _graph_sql() | (llm.oracle_sql() if llm else {})


def _graph_sql() -> dict[str, str]:
    return {
        "read_csv_strict": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "read_csv_pages": "SELECT page_id, url, html FROM pages",
        "read_csv_bad_rows": """
            SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'bad' ELSE 'good' END AS kind,
                   count(*) AS n FROM orders GROUP BY kind""",
        "write_csv": _A,
        "interactions_a": _A,
        "interactions_b": _B,
        "interactions_a_csv": _A,
        "interactions_b_csv": _B,
        "reject_report": f"{_reject_sql(_A, 'a')} UNION ALL {_reject_sql(_B, 'b')}",
        "reject_report_dirty": _reject_sql(_DIRTY, "dirty"),
        "dedupe_latest": _dedupe_sql(_A),
        "dedupe_latest_b": _dedupe_sql(_B),
        "node_index": f"""
            WITH k AS (SELECT DISTINCT 'user' AS ntype, u AS key FROM ({_A}) s
                       UNION SELECT DISTINCT 'item', i FROM ({_A}) s)
            SELECT 'a' AS dataset, ntype, key,
                   row_number() OVER (PARTITION BY ntype ORDER BY key) - 1 AS nid FROM k""",
        "number_keys": _NAMED,
        "bipartite_edges": _bipartite_sql(_A),
        "bipartite_edges_b": _bipartite_sql(_B),
        "node_degrees": f"""
            SELECT dataset, 'user' AS ntype, u AS key, count(DISTINCT i) AS neighbours,
                   count(*) AS events FROM ({_A}) s GROUP BY dataset, u
            UNION ALL
            SELECT dataset, 'item', i, count(DISTINCT u), count(*) FROM ({_A}) s
            GROUP BY dataset, i""",
        "min_degree": f"""
            SELECT dataset, i, count(DISTINCT u) AS users FROM ({_A}) s
            GROUP BY dataset, i HAVING count(DISTINCT u) >= 30""",
        "min_degree_edges": f"""
            SELECT * FROM ({_bipartite_sql(_A)}) b WHERE i IN
                (SELECT i FROM ({_A}) s GROUP BY i HAVING count(DISTINCT u) >= 30)""",
        "k_core": f"""
            WITH RECURSIVE e AS (
                SELECT 0 AS round, u, i, count(*) OVER (PARTITION BY u) AS du,
                       count(*) OVER (PARTITION BY i) AS di
                FROM (SELECT DISTINCT u, i FROM ({_A}) s)
                UNION ALL
                SELECT round + 1, u, i, count(*) OVER (PARTITION BY u),
                       count(*) OVER (PARTITION BY i)
                FROM (SELECT *, count(*) FILTER (least(du, di) < {CORE}) OVER () AS low FROM e)
                WHERE least(du, di) >= {CORE} AND low > 0)
            SELECT 'a' AS dataset, u, i FROM e
            WHERE round = (SELECT max(round) FROM e) AND least(du, di) >= {CORE}""",
        "graph_store": f"""
            SELECT dataset, 'same_month' AS relation, concat(i, ':', month) AS key, u AS node,
                   CAST(NULL AS INTEGER) AS day
            FROM ({_members_sql(_with_month(_A), "dataset, i, month, u")})""",
        "graph_summary": _summary_sql(_A),
        "graph_summary_b": _summary_sql(_B),
        "graph_summary_ab": _summary_sql(_AB),
        "members_a": _all_members_sql(_A),
        "members_b": _all_members_sql(_B),
        "members_ab": _all_members_sql(_AB),
        "dedupe_latest_ab": _dedupe_sql(_AB),
        "rel_co_user": _share_sql(_A, "i", "u"),
        "rel_co_user_b": _members_sql(_B, "dataset, i, u"),
        "rel_co_item": _share_sql(_A, "u", "i"),
        "rel_co_item_b": _members_sql(_B, "dataset, u, i"),
        "rel_same_rating": _share_sql(_dedupe_sql(_A), "i, r", "u"),
        "rel_same_month": _share_sql(_with_month(_A), "i, month", "u"),
        "rel_same_month_b": _members_sql(_with_month(_B), "dataset, i, month, u"),
        "rel_rating_7d": _days_sql(_dedupe_sql(_A), "i, r"),
        "rel_rating_7d_global": _members_sql(_with_day(_dedupe_sql(_A)), "dataset, r, u, day"),
        "member_pairs": f"""
            WITH m AS ({_all_members_sql(_A)}),
            z AS (SELECT dataset, relation, key, count(*) AS members FROM m WHERE day IS NOT NULL GROUP BY ALL),
            n AS (SELECT dataset, relation, key, count(*) AS pairs FROM m p JOIN m q USING (dataset, relation, key)
                  WHERE p.node < q.node AND abs(p.day - q.day) <= 7 GROUP BY ALL)
            SELECT dataset, relation, key, members, coalesce(pairs, 0) AS pairs
            FROM z LEFT JOIN n USING (dataset, relation, key)""",
        "neighbour_estimates": f"""
            WITH p AS ({_share_sql(_A, "i", "u")})
            SELECT 'a' AS dataset, node, count(o) AS counted, true AS near
            FROM (SELECT DISTINCT u AS node FROM ({_A}) s) LEFT JOIN
                 (SELECT src AS node, dst AS o FROM p UNION ALL SELECT dst, src FROM p) USING (node) GROUP BY node""",
        "knn_edges": """
            SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM (
                SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM (
                    SELECT a.vec_id AS src, b.vec_id AS dst,
                           list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance
                    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0))
            WHERE rank <= 10""",
        "pagerank_co_user_b": f"""
            WITH RECURSIVE p AS ({_share_sql(_B, "i", "u")}),
            e AS MATERIALIZED (SELECT src AS a, dst AS b, w FROM p UNION ALL SELECT dst, src, w FROM p),
            t AS MATERIALIZED (SELECT a, sum(w) AS total FROM e GROUP BY a),
            n AS MATERIALIZED (SELECT DISTINCT u AS node, count(DISTINCT u) OVER () AS n FROM ({_B}) s),
            r AS (SELECT node, CAST(1 AS DOUBLE) / n AS rank, 0 AS round FROM n
                  UNION ALL
                  SELECT e.b, CAST(0.15 AS DOUBLE) / max(n.n) + CAST(0.85 AS DOUBLE) * sum(r.rank * e.w / t.total), max(r.round) + 1
                  FROM r JOIN e ON r.node = e.a JOIN t ON t.a = e.a JOIN n ON n.node = e.b
                  WHERE r.round < {ROUNDS} GROUP BY e.b)
            SELECT 'b' AS dataset, node, round(rank, 9) AS rank FROM r WHERE round = {ROUNDS}""",
        "time_split": _split_sql(_A),
        "time_split_b": _split_sql(_B),
        "stream_bipartite_edges": _bipartite_sql(_B),
        "stream_daily_edges": f"""
            SELECT dataset, CAST(ts AS DATE) AS day, u, i, count(*) AS w FROM ({_B}) s
            WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""",
        "components_co_user_b": _components_sql(_members_sql(_B, "dataset, i, u"), _share_sql(_B, "i", "u")),
        "components_same_month": _components_sql(
            _members_sql(_with_month(_A), "dataset, i, month, u"), _share_sql(_with_month(_A), "i, month", "u")
        ),
        "components_rating_7d": _components_sql(
            _members_sql(_with_day(_dedupe_sql(_A)), "dataset, i, r, u, day"), _days_sql(_dedupe_sql(_A), "i, r")
        ),
        "rel_text_overlap": _TEXT,
        "text_classes": f"SELECT doc_id, class_id FROM ({_CLASSES})",
        "topk_neighbours": _topk_sql(_A),
        "topk_neighbours_b": _topk_sql(_B),
        "union_relations": f"""{_edges_sql(_A)} UNION ALL
            SELECT 'a', 'text_overlap', src, dst, w FROM ({_TEXT})""",
        "node_features": _features_sql(_A),
        "node_features_b": _features_sql(_B),
        "node_labels": """
            SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l
            ON d.doc_id = l.doc_id""",
        "build_graph": _summary_sql(_B),
        "build_graph_a": _edges_sql(_A),
        "build_graph_text_keys": f"""
            SELECT 'a' AS dataset, u, i, count(*) AS w, min(ts) AS first_ts, max(ts) AS last_ts
            FROM ({_NAMED}) s GROUP BY u, i""",
        "build_text_graph": f"""
            SELECT 't' AS dataset, 'text_overlap' AS relation, src, dst, w FROM ({_TEXT})""",
    }
