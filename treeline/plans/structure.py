"""Rules over trees: kinds, positions, relations, composites, bindings, traversals and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import labels, scan, structural
from treeline.plans.registry import query
from treeline.sources import trees
from treeline.storage import spread

KEYS = ["kind", "custkey", "orderkey", "line_no"]

#: The commerce tree by its keys: customers c, their orders o by position, their lines l.
WITH = """WITH c AS (SELECT c_custkey AS ck, c_mktsegment AS t, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT ck, o_orderkey AS ok, o_orderpriority AS t, row_number() OVER (PARTITION BY ck ORDER BY o_orderkey) AS pos FROM orders JOIN c ON o_custkey = ck),
l AS (SELECT ck, ok, l_returnflag AS t, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) AS INT) AS ln,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN o ON l_orderkey = ok)
"""
_CUST = "SELECT 'customer' AS kind, c.ck AS custkey, CAST(NULL AS BIGINT) AS orderkey, CAST(NULL AS INT) AS line_no FROM c"
_ORDER = "SELECT 'order' AS kind, o.ck AS custkey, o.ok AS orderkey, CAST(NULL AS INT) AS line_no FROM o"
_LINE = "SELECT 'lineitem' AS kind, l.ck AS custkey, l.ok AS orderkey, l.ln AS line_no FROM l"
_UP = " JOIN o ON l.ok = o.ok JOIN c ON l.ck = c.ck"

URGENT = {"kind": "order", "regex": "^1-URGENT"}
RETURNED = {"kind": "lineitem", "regex": "^R$"}
UTILS = {"urgent": URGENT, "returned": RETURNED, "bad": {"all": [{"matches": "returned"}, {"inside": {"matches": "urgent"}}]}}


def _rule(name: str, spec: dict, sql: str) -> None:
    @query(name, WITH + sql)
    def run(spark, sf_dir) -> DataFrame:
        return structural.select(trees.commerce(spark, sf_dir), spec, UTILS).select(*KEYS)


_rule("kind_filter", {"kind": "order"}, _ORDER)
_rule("regex_filter", {"kind": "order", "regex": "^[12]-"}, _ORDER + " WHERE regexp_matches(t, '^[12]-')")
_rule("nth_child", {"kind": "lineitem", "nthChild": 2}, _LINE + " WHERE ln = 2")
_rule("nth_child_anb", {"kind": "order", "nthChild": "2n+1"}, _ORDER + " WHERE pos % 2 = 1")
_rule("nth_child_falling", {"kind": "order", "nthChild": "-n+3"}, _ORDER + " WHERE pos <= 3")
_rule("nth_child_reverse", {"kind": "lineitem", "nthChild": {"position": 1, "reverse": True}}, _LINE + " WHERE ln = n")
_rule("nth_child_of_rule", {"kind": "lineitem", "nthChild": {"position": 1, "ofRule": {"regex": "^R$"}}}, _LINE + " WHERE t = 'R' AND ln = (SELECT min(x.ln) FROM l x WHERE x.ok = l.ok AND x.t = 'R')")
_rule("inside_parent", {"kind": "lineitem", "inside": URGENT}, _LINE + " JOIN o ON l.ok = o.ok WHERE o.t = '1-URGENT'")
_rule("inside_end", {**RETURNED, "inside": {"kind": "customer", "regex": "BUILDING", "stopBy": "end"}}, _LINE + " JOIN c ON l.ck = c.ck WHERE l.t = 'R' AND c.t = 'BUILDING'")
_rule("inside_stop_rule", {"kind": "lineitem", "inside": {"regex": "^(1-URGENT|BUILDING|EUROPE)$", "stopBy": {"kind": "customer"}}}, _LINE + _UP + " WHERE o.t = '1-URGENT' OR c.t = 'BUILDING'")
_rule("inside_field", {"kind": "lineitem", "inside": {"kind": "customer", "field": "head", "stopBy": "end"}}, _LINE + " JOIN o ON l.ok = o.ok WHERE o.pos = 1")
_rule("inside_parent_field", {"kind": "lineitem", "inside": {"kind": "order", "field": "head"}}, _LINE + " WHERE ln = 1")
_rule("has_child", {"kind": "order", "has": RETURNED}, _ORDER + " WHERE EXISTS (SELECT 1 FROM l WHERE l.ok = o.ok AND l.t = 'R')")
_rule("has_end", {"kind": "customer", "has": {**RETURNED, "stopBy": "end"}}, _CUST + " WHERE EXISTS (SELECT 1 FROM l WHERE l.ck = c.ck AND l.t = 'R')")
_rule("has_stop_rule", {"kind": "customer", "has": {**RETURNED, "stopBy": URGENT}}, _CUST + " WHERE EXISTS (SELECT 1 FROM l JOIN o ON l.ok = o.ok WHERE l.ck = c.ck AND l.t = 'R' AND o.t <> '1-URGENT')")
_rule("has_field", {"kind": "customer", "has": {**RETURNED, "field": "head", "stopBy": "end"}}, _CUST + " WHERE EXISTS (SELECT 1 FROM l JOIN o ON l.ok = o.ok WHERE o.ck = c.ck AND o.pos = 1 AND l.t = 'R')")
_rule("has_field_stop_rule", {"kind": "customer", "has": {**RETURNED, "field": "head", "stopBy": URGENT}}, _CUST + " WHERE EXISTS (SELECT 1 FROM l JOIN o ON l.ok = o.ok WHERE o.ck = c.ck AND o.pos = 1 AND l.t = 'R' AND o.t <> '1-URGENT')")
_rule("precedes_sibling", {"kind": "order", "precedes": {**URGENT, "stopBy": "end"}}, _ORDER + " WHERE EXISTS (SELECT 1 FROM o x WHERE x.ck = o.ck AND x.pos > o.pos AND x.t = '1-URGENT')")
_rule("rule_all", {"all": [URGENT, {"has": RETURNED}]}, _ORDER + " WHERE t = '1-URGENT' AND EXISTS (SELECT 1 FROM l WHERE l.ok = o.ok AND l.t = 'R')")
_rule("rule_any", {"any": [URGENT, RETURNED]}, _ORDER + " WHERE t = '1-URGENT' UNION ALL " + _LINE + " WHERE t = 'R'")
_rule("rule_not", {"kind": "order", "not": {"has": RETURNED}}, _ORDER + " WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.ok = o.ok AND l.t = 'R')")
_rule("rule_matches_util", {"matches": "bad"}, _LINE + " JOIN o ON l.ok = o.ok WHERE l.t = 'R' AND o.t = '1-URGENT'")


@query("kind_error", """SELECT event_id, '!' AS text, CAST(position('!' IN props || '!') - 1 AS INT) AS start_char FROM events""")
def kind_error(spark, sf_dir):
    """What the parser can't understand: a mark behind each of the events' props."""
    sources = trees.prop_sources(spark, sf_dir).withColumn("content", F.concat("content", F.lit("!")))
    found = structural.select(labels.parse_sources(sources), {"kind": "ERROR"})
    return found.select(F.col("file_id").cast("bigint").alias("event_id"), "text", "start_char")


@query("match_all_none", WITH + "SELECT 5 AS n_kinds, (SELECT 3 * count(*) FROM c) + (SELECT count(*) FROM o) + (SELECT count(*) FROM l) AS n_all, CAST(0 AS BIGINT) AS n_none")
def match_all_none(spark, sf_dir):
    nodes = trees.commerce(spark, sf_dir)
    every = structural.select(nodes, {"not": {"all": []}}).select(F.lit(1).alias("none"), F.lit(None).cast("string").alias("kind"))
    all_ = structural.select(nodes, {"all": []}).select(F.lit(0).alias("none"), "kind")
    return every.unionByName(all_).agg(F.count_distinct("kind").cast("int").alias("n_kinds"), F.sum(1 - F.col("none")).alias("n_all"), F.sum("none").alias("n_none"))


@query("nearest_ancestor_binding", WITH + "SELECT l.ck AS custkey, l.ok AS orderkey, l.ln AS line_no, CASE WHEN o.t = '1-URGENT' THEN 'order' ELSE 'customer' END AS ancestor_kind FROM l" + _UP + " WHERE l.t = 'R' AND (o.t = '1-URGENT' OR c.t = 'BUILDING')")
def nearest_ancestor_binding(spark, sf_dir):
    nodes = trees.commerce(spark, sf_dir)
    above = {"any": [URGENT, {"kind": "customer", "regex": "BUILDING"}]}
    found = structural.nearest_ancestor(nodes, RETURNED, above, keep=("custkey", "orderkey", "line_no"))
    up = structural.select(nodes, above).select("file_id", F.col("pre").alias("ancestor_pre"), F.col("kind").alias("ancestor_kind"))
    key = ["file_id", "ancestor_pre"]
    return spread(found, *key).join(spread(up, *key), key).select("custkey", "orderkey", "line_no", "ancestor_kind")


@query("first_descendant_binding", WITH + "SELECT ck AS custkey, min(ok) AS orderkey, CAST(min_by(ln, ok * 1000 + ln) AS INT) AS line_no FROM l WHERE t = 'R' GROUP BY ck")
def first_descendant_binding(spark, sf_dir):
    nodes = trees.commerce(spark, sf_dir)
    found = structural.first_descendant(nodes, {"kind": "customer"}, RETURNED)
    low = nodes.select("file_id", F.col("pre").alias("descendant_pre"), "custkey", "orderkey", "line_no")
    return found.join(low, ["file_id", "descendant_pre"]).select("custkey", "orderkey", "line_no")


_NODES = """, n AS (SELECT 'region' AS kind, ck AS custkey, CAST(NULL AS BIGINT) AS orderkey, CAST(NULL AS INT) AS line_no, 0 AS depth FROM c
UNION ALL SELECT 'nation', ck, NULL, NULL, 1 FROM c UNION ALL SELECT 'customer', ck, NULL, NULL, 2 FROM c
UNION ALL SELECT 'order', ck, ok, NULL, 3 FROM o UNION ALL SELECT 'lineitem', ck, ok, ln, 4 FROM l)
SELECT kind, custkey, orderkey, line_no, CAST(row_number() OVER (PARTITION BY custkey ORDER BY {}) - 1 AS INT) AS position FROM n"""


def _order(name: str, order: str, by: str) -> None:
    @query(name, WITH + _NODES.format(by))
    def run(spark, sf_dir):
        return structural.traversal(trees.commerce(spark, sf_dir), order).select(*KEYS, F.col("position").cast("int").alias("position"))


_order("preorder", "pre", "orderkey NULLS FIRST, line_no NULLS FIRST, depth")
_order("postorder", "post", "orderkey NULLS LAST, line_no NULLS LAST, depth DESC")
_order("levelorder", "level", "depth, orderkey, line_no")


@query("outermost_matches", WITH + _ORDER + " WHERE t = '1-URGENT' UNION ALL " + _LINE + " JOIN o ON l.ok = o.ok WHERE l.t = 'R' AND o.t <> '1-URGENT'")
def outermost_matches(spark, sf_dir):
    return structural.outermost(structural.select(trees.commerce(spark, sf_dir), {"any": [URGENT, RETURNED]})).select(*KEYS)


@query("first_match", WITH + "SELECT ck AS custkey, min(ok) AS orderkey FROM o WHERE t = '1-URGENT' GROUP BY ck")
def first_match(spark, sf_dir):
    return structural.first_match(structural.select(trees.commerce(spark, sf_dir), URGENT)).select("custkey", "orderkey")


@query("tree_labels", WITH + "SELECT ck AS custkey, ok AS orderkey, CAST(pos - 1 AS INT) AS child_idx, CAST((SELECT count(*) FROM l WHERE l.ok = o.ok) AS BIGINT) AS below FROM o")
def tree_labels(spark, sf_dir):
    orders = trees.commerce(spark, sf_dir).where("kind = 'order'")
    return orders.select("custkey", "orderkey", "child_idx", (F.col("end_pre") - F.col("pre")).cast("bigint").alias("below"))


# --- conversations: siblings ------------------------------------------------

_T = "SELECT conv_id, turn FROM (SELECT *, lead(role) OVER w AS next, lag(role) OVER w AS prev FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) t "
USER, REPLY = {"kind": "user"}, {"kind": "assistant"}


def _turns(name: str, spec: dict, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return structural.select(trees.talk(spark, sf_dir), spec).select("conv_id", "turn")


_turns("precedes_next", {**USER, "precedes": REPLY}, _T + "WHERE role = 'user' AND next = 'assistant'")
_turns("follows_prev", {**USER, "follows": REPLY}, _T + "WHERE role = 'user' AND prev = 'assistant'")
_turns("precedes_end", {**USER, "precedes": {**REPLY, "stopBy": "end"}}, _T + "WHERE role = 'user' AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = t.conv_id AND x.turn > t.turn AND x.role = 'assistant')")
_turns("follows_end", {**USER, "follows": {"regex": "(?i)\\bthe\\b", "stopBy": "end"}}, _T + "WHERE role = 'user' AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = t.conv_id AND x.turn < t.turn AND regexp_matches(x.text, '(?i)\\bthe\\b'))")
_turns(
    "follows_stop_rule", {"follows": {"any": [USER, {"kind": "system"}], "regex": "[ae]", "stopBy": REPLY}},
    _T + "WHERE EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = t.conv_id AND x.turn < t.turn AND x.role IN ('user', 'system') AND regexp_matches(x.text, '[ae]')"
    " AND NOT EXISTS (SELECT 1 FROM conversations y WHERE y.conv_id = t.conv_id AND y.turn > x.turn AND y.turn < t.turn AND y.role = 'assistant'))",
)


@query("sibling_links", "SELECT conv_id, turn, lead(turn) OVER w AS next_turn, lag(turn) OVER w AS prev_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def sibling_links(spark, sf_dir):
    nodes = trees.talk(spark, sf_dir)
    rows = structural.siblings(nodes).where("parent >= 0")
    for way in ("next", "prev"):
        to = nodes.select("file_id", F.col("pre").alias(f"{way}_pre"), F.col("turn").alias(f"{way}_turn"))
        rows = rows.join(to, ["file_id", f"{way}_pre"], "left")
    return rows.select("conv_id", "turn", "next_turn", "prev_turn")


# --- scans of many rules ----------------------------------------------------

LINE_RULES = {
    "digits": {"regex": "[0-9]"}, "double-space": {"regex": "[^ ]  +[^ ]"}, "long-line": {"regex": "^.{400}"}, "mail": {"regex": "[A-Za-z0-9_.]+@[A-Za-z0-9_.]+"}, "repeat": {"all": [{"regex": "[.]$"}, {"follows": {"regex": "^[A-Z].*[.]$"}}, {"regex": "the"}]},
}
LINE_LEVELS = {"digits": "info", "double-space": "warning", "long-line": "off", "mail": "error", "repeat": "hint"}
LINE_MESSAGES = {"digits": "a number", "mail": "an address in a $KIND"}

_LINES = """WITH li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, line, 'digits' AS rule_id, 'info' AS severity, 'a number' AS message FROM li WHERE regexp_matches(t, '[0-9]')
UNION ALL SELECT doc_id, line, 'double-space', 'warning', '' FROM li WHERE regexp_matches(t, '[^ ]  +[^ ]')
UNION ALL SELECT doc_id, line, 'mail', 'error', 'an address in a line' FROM li WHERE regexp_matches(t, '[A-Za-z0-9_.]+@[A-Za-z0-9_.]+'))
"""


def _findings(spark, sf_dir):
    rules = {k: v for k, v in LINE_RULES.items() if k != "repeat"}
    return scan.scan_nodes(trees.line_nodes(spark, sf_dir), rules, LINE_LEVELS, LINE_MESSAGES).select(F.col("file_id").cast("bigint").alias("doc_id"), "file_id", F.col("start_line").cast("bigint").alias("line"), "rule_id", "severity", "message")


@query("rule_scan", _LINES + "SELECT * FROM f")
def rule_scan(spark, sf_dir):
    return _findings(spark, sf_dir).drop("file_id")


@query("findings_by_rule", _LINES + "SELECT rule_id, count(*) AS n, count(DISTINCT doc_id) AS files FROM f GROUP BY rule_id")
def findings_by_rule(spark, sf_dir):
    return scan.counts_by_rule(_findings(spark, sf_dir))


@query("findings_rollup", _LINES + "SELECT source, severity, rule_id, count(*) AS n, CAST(CASE WHEN grouping(source) = 1 THEN 7 WHEN grouping(severity) = 1 THEN 3 WHEN grouping(rule_id) = 1 THEN 1 ELSE 0 END AS BIGINT) AS level FROM f JOIN documents USING (doc_id) GROUP BY ROLLUP (source, severity, rule_id)")
def findings_rollup(spark, sf_dir):
    docs = trees.read(spark, sf_dir, "documents").select("doc_id", "source")
    return scan.rollup(_findings(spark, sf_dir).join(docs, "doc_id"), "source", "severity", "rule_id")




@query("suppression_line", _LINES + ", m AS (SELECT DISTINCT doc_id, line + 1 AS line FROM li WHERE contains(t, 'the')) SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = f.doc_id AND m.line = f.line)")
def suppression_line(spark, sf_dir):
    """Any line with "the" hides what is found on the next one."""
    found = _findings(spark, sf_dir)
    return scan.suppress(found, _marks(spark, sf_dir)).drop("file_id")


def _marks(spark, sf_dir):
    rows = trees.lines(spark, sf_dir).select("file_id", F.col("line").cast("bigint").alias("line"), "text")
    return scan.suppression_comments(rows, "the").withColumn("rule_id", F.lit(None).cast("string"))


@query("suppression_unused", _LINES + "SELECT DISTINCT doc_id, line + 1 AS line FROM li WHERE contains(t, 'the') AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = li.doc_id AND f.line = li.line + 1)")
def suppression_unused(spark, sf_dir):
    return scan.unused(_findings(spark, sf_dir), _marks(spark, sf_dir)).select(F.col("file_id").cast("bigint").alias("doc_id"), "line").distinct()


GLOBS = {"blog": (["blog.*/**"], []), "english": (["**/en/*"], ["www.**"]), "everything": ([], []), "one-letter": (["m.*/{de,fr}/?", "m.*/{de,fr}/??"], [])}


@query(
    "rule_globs",
    "WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages) SELECT page_id, 'blog' AS rule_id FROM p WHERE regexp_matches(path, '^blog\\.[^/]*/.*$')"
    " UNION ALL SELECT page_id, 'english' FROM p WHERE regexp_matches(path, '^(?:.*/)?en/[^/]*$') AND NOT starts_with(path, 'www.') UNION ALL SELECT page_id, 'everything' FROM p"
    " UNION ALL SELECT page_id, 'one-letter' FROM p WHERE regexp_matches(path, '^m\\.[^/]*/(de|fr)/[^/]{1,2}$')",
)
def rule_globs(spark, sf_dir):
    pages = trees.page_sources(spark, sf_dir).select(F.col("file_id").cast("bigint").alias("page_id"), "path")
    held = F.array(*(F.when(scan.applies_col(F.col("path"), *g), F.lit(name)) for name, g in GLOBS.items()))
    return pages.select("page_id", F.explode(F.filter(held, lambda x: x.isNotNull())).alias("rule_id"))
