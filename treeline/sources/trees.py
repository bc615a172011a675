"""Trees, graphs and logs made from the driver's tables.

Any parent-child data is a forest of node rows. A file is one customer, one
conversation or one document, so that no file grows with the corpus. Built
trees are written to the shared folder once per session and input folder, as a
node store would keep them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.operators.labels import label_paths, parse_sources
from treeline.storage import cut, listing, read, spread

#: What was built, with the state that its input folder was in.
_stored: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}

#: The order of an order's lines: the key's line number alone is not unique.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """build's table, written once per session and input folder; anew when the folder's tables have changed."""
    key, state = (spark.sparkContext.applicationId, sf_dir, name), listing(spark, sf_dir)
    if key not in _stored or _stored[key][0] != state:
        _stored[key] = state, cut(build(spark, sf_dir), name)
    return _stored[key][1]


def _plain(rows: DataFrame) -> DataFrame:
    """What label_paths doesn't make of the node columns: all nodes are named and well formed."""
    return rows.withColumns({"is_named": F.lit(True), "is_error": F.lit(False)})


def commerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a customer: region > nation > customer > order > lineitem, with their keys.

    The first order of a customer and the first line of an order stand in the
    field `head`, customer and nation in fields of these names.
    """
    return stored(spark, sf_dir, "t-com", _commerce)


def _commerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")
    orders = read(spark, sf_dir, "orders").join(customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_custkey", "o_orderkey", "o_orderpriority")
    lines = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER), "l_orderkey").withColumn("line_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))
    lines = lines.select("l_orderkey", "line_no", "l_returnflag").join(orders.select("o_custkey", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    none = F.lit(None)

    def rows(df, kind, text, custkey, orderkey=none, line=none, depth=0):
        own = [F.lit(0)] * min(depth + 1, 3) + [none] * max(0, 2 - depth)
        return df.select(
            custkey.cast("string").alias("file_id"), F.lit(kind).alias("kind"), F.col(text).alias("text"), custkey.cast("bigint").alias("custkey"), orderkey.cast("bigint").alias("orderkey"), line.cast("int").alias("line_no"),
            *(c.cast("int").alias(f"l{i}") for i, c in enumerate(own)),
        )

    key = F.col("c_custkey")
    every = rows(customer, "region", "r_name", key, depth=0)
    every = every.unionByName(rows(customer, "nation", "n_name", key, depth=1)).unionByName(rows(customer, "customer", "c_mktsegment", key, depth=2))
    every = every.unionByName(rows(orders, "order", "o_orderpriority", F.col("o_custkey"), F.col("o_orderkey"), depth=3))
    every = every.unionByName(rows(lines, "lineitem", "l_returnflag", F.col("o_custkey"), F.col("o_orderkey"), F.col("line_no"), depth=4))
    labelled = label_paths(every, ["l0", "l1", "l2", "orderkey", "line_no"], ["kind", "text", "custkey", "orderkey", "line_no"])
    field = F.when(F.col("kind").isin("nation", "customer"), F.col("kind")).when(F.col("kind").isin("order", "lineitem") & (F.col("child_idx") == 0), F.lit("head"))
    return _plain(labelled).withColumn("field", field)


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a conversation: conversation > turns, whose kind is the role."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        turns = read(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn"), F.col("role").alias("kind"), "text")
        tops = turns.select("conv_id").distinct().select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("conversation").alias("kind"), F.lit(None).cast("string").alias("text"))
        every = tops.unionByName(turns).select(F.col("conv_id").cast("string").alias("file_id"), "conv_id", "turn", "kind", "text", F.lit(0).alias("l0"))
        return _plain(label_paths(every, ["l0", "turn"], ["conv_id", "turn", "kind", "text"]))

    return stored(spark, sf_dir, "t-conv", build)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, doc_id, line, text, start_char, end_char) of every line of the documents; lines count from 0."""
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    size = F.length("text")
    end = F.sum(size + 1).over(Window.partitionBy("doc_id").orderBy("line")) - 1
    return docs.select(F.col("doc_id").cast("string").alias("file_id"), "doc_id", "line", "text", (end - size).cast("bigint").alias("start_char"), end.cast("bigint").alias("end_char"))


def line_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as document > line nodes, enough columns for rules over lines."""
    rows = lines(spark, sf_dir).select("file_id", "doc_id", (F.col("line") + 1).alias("pre"), F.lit("line").alias("kind"), "text", F.col("line").alias("start_line"))
    return _plain(rows).withColumn("field", F.lit(None).cast("string"))


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, language, content) of the pages; path is the URL without scheme and query."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file_id"), path.alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table of the parsed pages."""
    return stored(spark, sf_dir, "t-html", lambda s, d: parse_sources(page_sources(s, d)))


def prop_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("file_id"), F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.lit("json").alias("language"), F.col("props").alias("content"))


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table of the events' parsed props."""
    return stored(spark, sf_dir, "t-json", lambda s, d: parse_sources(prop_sources(s, d)))


# --- graphs and logs --------------------------------------------------------


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(node_id, node_type, name) and (source_id, target_id, edge_type, weight): who contains, uses and supplies what."""
    region, nation, customer, supplier, part, orders, lineitem = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    kinds = [(region, "region", "r_regionkey", "r_name"), (nation, "nation", "n_nationkey", "n_name"), (customer, "customer", "c_custkey", "c_name"), (supplier, "supplier", "s_suppkey", "s_name"), (part, "part", "p_partkey", "p_name"), (orders, "order", "o_orderkey", "o_orderpriority")]
    nodes = None
    for df, kind, key, name in kinds:
        one = df.select(_id(kind, key).alias("node_id"), F.lit(kind).alias("node_type"), F.col(name).alias("name"))
        nodes = one if nodes is None else nodes.unionByName(one)
    ends = [
        (nation, "region", "n_regionkey", "nation", "n_nationkey", "Contains"), (customer, "nation", "c_nationkey", "customer", "c_custkey", "Contains"), (supplier, "nation", "s_nationkey", "supplier", "s_suppkey", "Contains"),
        (orders, "customer", "o_custkey", "order", "o_orderkey", "Contains"), (lineitem, "order", "l_orderkey", "part", "l_partkey", "Uses"), (lineitem, "part", "l_partkey", "supplier", "l_suppkey", "DependsOn"),
    ]
    edges = None
    for df, a, a_key, b, b_key, kind in ends:
        one = df.select(_id(a, a_key).alias("source_id"), _id(b, b_key).alias("target_id"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight")).distinct()
        edges = one if edges is None else edges.unionByName(one)
    return nodes, edges


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an operation log."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("operation_type"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"), "user_id", F.col("ts").alias("timestamp"), "event_id")


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a lineage log: a user is a node, a view is served from the cache."""
    key = F.col("props")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("node_id"), F.col("event_id").alias("operation_id"), F.col("event_type").alias("operation_type"), F.sha2(key, 256).alias("input_hash"), F.sha2(F.concat(key, F.col("event_type")), 256).alias("output_hash"),
        F.col("ts").alias("executed_at"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"), (F.col("event_type") == "view").alias("cache_hit"),
    )


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents as (file_id, content): the second edits all German ones and drops a source."""
    docs = read(spark, sf_dir, "documents")
    edited = F.when(F.col("lang") == "de", F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").alias("file_id"), F.col("text").alias("content")), docs.where("source <> 'src3'").select(F.col("doc_id").alias("file_id"), edited.alias("content"))


def order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the orders as symbols (name, signature): open ones are new, low ones are gone, filled ones changed."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), "o_orderpriority", "o_orderstatus")
    old = orders.where("o_orderstatus <> 'O'").select("name", F.col("o_orderpriority").alias("signature"))
    new = F.when(F.col("o_orderstatus") == "F", F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority"))
    return old, orders.where("o_orderpriority <> '5-LOW'").select("name", new.alias("signature"))


def part_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small Python source for each part: it defines a function and calls that of the part numbered by its size."""
    key, size, name = (F.coalesce(c, F.lit("null")) for c in ("key", "size", "name"))
    head, definition, call = F.lit("import json\nfrom parts.part_"), F.lit("\n\n\ndef part_"), F.lit("\n    return part_")
    text = F.concat(head, size, F.lit(" import part_"), size, definition, key, F.lit("(a, b=1):\n    # "), name, call, size, F.lit("(a, [b, 2])\n"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_size").cast("string").alias("size"), F.col("p_name").alias("name"))
    return rows.select(F.col("key").alias("file_id"), F.concat(F.lit("parts/part_"), "key", F.lit(".py")).alias("path"), F.lit("python").alias("language"), text.alias("content"))


def pair_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON list of two numbers for each part: its size, and the number in its brand."""
    text = F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(", "), F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("]"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file_id"), F.concat(F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"), F.lit("json").alias("language"), text.alias("content"))
