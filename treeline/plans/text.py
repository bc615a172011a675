"""Parsed texts: HTML, JSON and code, string functions, patterns, rewriting and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.functions import transforms as tf
from treeline.operators import labels, rewrite, rules, scan, structural, symbols
from treeline.plans.registry import query
from treeline.sources import languages, trees
from treeline.storage import read


def _page_id(df):
    return df.withColumn("page_id", F.col("file_id").cast("bigint"))


# --- HTML and JSON ----------------------------------------------------------


@query("html_links_in_nav", """SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href="[^"]*"')) AS href FROM pages""")
def html_links_in_nav(spark, sf_dir):
    """The flagship: link targets inside navigation bars."""
    nav = {"kind": "element", "has": {"kind": "start_tag", "has": {"kind": "tag_name", "regex": "^nav$"}}}
    found = structural.select(trees.pages(spark, sf_dir), {"kind": "attribute", "regex": "^href=", "inside": {**nav, "stopBy": "end"}})
    return _page_id(found).select("page_id", F.col("text").alias("href"))


@query("html_tag_count", "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY page_id, tag")
def html_tag_count(spark, sf_dir):
    """A rule over the pages where they are parsed: no table of all their nodes is written or sorted for it."""
    found = scan.matches(trees.page_sources(spark, sf_dir), {"tag": {"kind": "tag_name", "inside": {"kind": "start_tag"}}})
    return _page_id(found).groupBy("page_id", F.lower("text").alias("tag")).agg(F.count("*").alias("n"))


@query("html_comments", "SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->')) AS comment FROM pages")
def html_comments(spark, sf_dir):
    return _page_id(structural.select(trees.pages(spark, sf_dir), {"kind": "comment"})).select("page_id", F.col("text").alias("comment"))


_EMBEDDED = """WITH e AS (SELECT page_id, 'javascript' AS language, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.+?)</script', 1)) AS t FROM pages
UNION ALL SELECT page_id, 'css', unnest(regexp_extract_all(html, '(?s)<style[^>]*>(.+?)</style', 1)) FROM pages)
"""


@query("html_embedded_lang", _EMBEDDED + "SELECT page_id, language, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM e GROUP BY page_id, language")
def html_embedded_lang(spark, sf_dir):
    found = _page_id(labels.embedded_ranges(trees.pages(spark, sf_dir)))
    return found.groupBy("page_id", "language").agg(F.count("*").alias("n"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))


@query("html_embedded_calls", "SELECT page_id, unnest(regexp_extract_all(html, 'track\\([^)]*\\)')) AS call FROM pages")
def html_embedded_calls(spark, sf_dir):
    """Calls in the pages' scripts, parsed in place."""
    found = scan.matches(trees.page_sources(spark, sf_dir), {"call": {"kind": "call_expression"}}, embedded="javascript")
    return found.select(F.split("file_id", "#")[0].cast("bigint").alias("page_id"), F.col("text").alias("call"))


@query("json_pairs", "SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_pairs(spark, sf_dir):
    nodes = trees.props(spark, sf_dir)
    pairs = structural.select(nodes, {"kind": "pair"}).select("file_id", F.col("pre").alias("parent"))
    parts = structural.with_text(nodes.where("field IN ('key', 'value')"), nodes).join(pairs, ["file_id", "parent"])
    pick = lambda f: F.max(F.when(F.col("field") == f, F.regexp_replace("text", '^"|"$', "")))
    return parts.groupBy("file_id", "parent").agg(pick("key").alias("key"), pick("value").alias("value")).select(F.col("file_id").cast("bigint").alias("event_id"), "key", "value")


@query("range_match", """SELECT event_id, regexp_extract(props, '"[a-z]"') AS text FROM events WHERE regexp_matches(props, '^\\{"[a-z]"')""")
def range_match(spark, sf_dir):
    nodes = trees.props(spark, sf_dir)
    found = structural.select(nodes, {"kind": "string", "range": {"start": {"line": 0, "column": 1}, "end": {"line": 0, "column": 4}}})
    return structural.with_text(found, nodes).select(F.col("file_id").cast("bigint").alias("event_id"), "text")


@query("node_spans", "SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, CAST(length(html) AS BIGINT) AS chars, CAST(len(string_split(html, chr(10))) AS BIGINT) AS lines FROM pages WHERE html <> ''")
def node_spans(spark, sf_dir):
    """The root spans its whole source, in bytes, characters and lines."""
    return _page_id(trees.pages(spark, sf_dir).where("parent < 0")).select("page_id", F.col("end_byte").cast("bigint").alias("bytes"), F.col("end_char").cast("bigint").alias("chars"), (F.col("end_line") + 1).cast("bigint").alias("lines"))


@query("file_summary", "SELECT event_id, CAST(11 AS BIGINT) AS n_nodes, CAST(10 AS BIGINT) AS n_edges, CAST(1 AS BIGINT) AS n_lines FROM events")
def file_summary(spark, sf_dir):
    return symbols.file_summary(trees.props(spark, sf_dir)).select(F.col("file_id").cast("bigint").alias("event_id"), "n_nodes", "n_edges", "n_lines")


@query("parse_rejected", "SELECT page_id, CASE WHEN html IS NULL THEN 'no content' WHEN html = '' THEN 'empty' ELSE 'too large' END AS why FROM pages WHERE html IS NULL OR strlen(html) NOT BETWEEN 1 AND 5000")
def parse_rejected(spark, sf_dir):
    """Sources over a size limit of 5,000 bytes, here low enough to have some."""
    return _page_id(labels.rejected_sources(trees.page_sources(spark, sf_dir), 5000)).select("page_id", F.col("error.message").alias("why"))


# --- languages --------------------------------------------------------------

_SUFFIX = {"ECONOMY": ".py", "STANDARD": ".TSX", "PROMO": ".tar.gz", "LARGE": ".h", "MEDIUM": ".rs", "SMALL": ""}
_PATHS = "SELECT p_partkey, replace(p_name, ' ', '/') || CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SUFFIX.items()) + " ELSE '.yml' END AS path FROM part"
_EXTENSIONS = ", ".join(f"('{e}', '{lang}')" for e, lang in languages.pairs())


def _paths(spark, sf_dir):
    suffix = F.lit(".yml")
    for k, v in _SUFFIX.items():
        suffix = F.when(F.col("p_type") == k, v).otherwise(suffix)
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), suffix).alias("path"))


@query("lang_detect", f"WITH p AS ({_PATHS}), e(extension, language) AS (VALUES {_EXTENSIONS}) SELECT p_partkey, path, language FROM p LEFT JOIN e ON lower(regexp_extract(path, '\\.([^./]+)$', 1)) = extension")
def lang_detect(spark, sf_dir):
    return languages.with_language(_paths(spark, sf_dir)).select("p_partkey", "path", "language")


@query("path_ext", f"WITH p AS ({_PATHS}) SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension, count(*) AS n FROM p GROUP BY 1")
def path_ext(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy(languages.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n"))


# --- string functions -------------------------------------------------------

_NAME = "p_brand || '_' || p_name || p_type"
_WORDS = f"WITH w AS (SELECT p_partkey, list_filter(string_split_regex(regexp_replace({_NAME}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[_ ]'), lambda x: x <> '') AS w FROM part) SELECT p_partkey, "
_CAP = "upper(x[1:1]) || lower(x[2:])"


def _names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("_"), "p_name", "p_type").alias("name"))


def _case(name: str, to: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return _names(spark, sf_dir).select("p_partkey", tf.convert_col(F.col("name"), to).alias("out"))


_case("fn_case_lower", "lowerCase", f"SELECT p_partkey, lower({_NAME}) AS out FROM part")
_case("fn_case_upper", "upperCase", f"SELECT p_partkey, upper({_NAME}) AS out FROM part")
_case("fn_case_capitalize", "capitalize", f"SELECT p_partkey, upper(({_NAME})[1:1]) || ({_NAME})[2:] AS out FROM part")
_case("fn_case_snake", "snakeCase", _WORDS + "array_to_string(list_transform(w, lambda x: lower(x)), '_') AS out FROM w")
_case("fn_case_kebab", "kebabCase", _WORDS + "array_to_string(list_transform(w, lambda x: lower(x)), '-') AS out FROM w")
_case("fn_case_pascal", "pascalCase", _WORDS + f"array_to_string(list_transform(w, lambda x: {_CAP}), '') AS out FROM w")
_case("fn_case_camel", "camelCase", _WORDS + f"array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN lower(x) ELSE {_CAP} END), '') AS out FROM w")


@query("fn_split_words", _WORDS + "array_to_string(w, '|') AS out, CAST(len(w) AS BIGINT) AS n FROM w")
def fn_split_words(spark, sf_dir):
    words = tf.split_words_col(F.col("name"))
    return _names(spark, sf_dir).select("p_partkey", F.array_join(words, "|").alias("out"), F.size(words).cast("bigint").alias("n"))


@query("fn_substring", f"SELECT p_partkey, substr({_NAME}, 2, greatest(length({_NAME}) - 2, 0)) AS middle, right({_NAME}, 3) AS tail, '' AS empty, {_NAME} AS clamped FROM part")
def fn_substring(spark, sf_dir):
    c = F.col("name")
    return _names(spark, sf_dir).select("p_partkey", tf.substring_col(c, 1, -1).alias("middle"), tf.substring_col(c, -3).alias("tail"), tf.substring_col(c, 4, 2).alias("empty"), tf.substring_col(c, 0, 999).alias("clamped"))


@query("fn_replace", f"SELECT p_partkey, regexp_replace({_NAME}, '([a-z]+)#([0-9]+)', '\\2-\\1x', 'g') AS out FROM part")
def fn_replace(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", tf.replace_col(F.col("name"), "([a-z]+)#([0-9]+)", "$2-${1}x").alias("out"))


@query("fn_message", "SELECT p_partkey, 'part ' || p_name || ' of ' || p_brand || ' is $ODD' AS message FROM part")
def fn_message(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    return df.select("p_partkey", tf.template_col("part $NAME of $BRAND is $ODD", {"NAME": F.col("p_name"), "BRAND": F.col("p_brand")}).alias("message"))


@query("fn_ascii_hash", "SELECT doc_id, strlen(text) = length(text) AS is_ascii, sha256(text) AS content_hash FROM documents")
def fn_ascii_hash(spark, sf_dir):
    from treeline.operators.versions import content_hash

    return read(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text") == F.length("text")).alias("is_ascii"), content_hash("text").alias("content_hash"))


@query("fn_span_relations", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity <= l_tax * 1000 AND l_tax * 1000 <= l_quantity + 5 AS inside, l_quantity <= l_tax * 1000 + 5 AND l_tax * 1000 <= l_quantity + 5 AS overlaps FROM lineitem")
def fn_span_relations(spark, sf_dir):
    a, b = F.col("l_quantity"), F.col("l_tax") * 1000
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", symbols.span_contains(a, a + 5, b, b).alias("inside"), symbols.span_overlaps(a, a + 5, b, b + 5).alias("overlaps"))


@query("char_column", "WITH p AS (SELECT doc_id, substr(text, 1, strpos(text, '.') - 1) AS before FROM documents WHERE strpos(text, '.') > 0) SELECT doc_id, CAST(len(string_split(before, chr(10))) - 1 AS BIGINT) AS line, CAST(length(list_last(string_split(before, chr(10)))) AS BIGINT) AS col FROM p")
def char_column(spark, sf_dir):
    """Line and column, in characters, of each document's first full stop."""
    docs = read(spark, sf_dir, "documents").withColumn("at", F.instr("text", ".")).where("at > 0")
    before = F.expr("substring(text, 1, at - 1)")
    return docs.select("doc_id", F.regexp_count(before, F.lit("\n")).cast("bigint").alias("line"), F.length(F.substring_index(before, "\n", -1)).cast("bigint").alias("col"))


@query("display_context", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:4], chr(10)) AS context FROM documents WHERE text IS NOT NULL")
def display_context(spark, sf_dir):
    """What stands around each document's third line: two lines before, one after."""
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", scan.context_lines(F.col("text"), F.lit(2), 2, 1).alias("context"))


@query(
    "line_table",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL)"
    " SELECT doc_id, line, CAST(sum(length(t) + 1) OVER w - 1 - length(t) AS BIGINT) AS start_char, CAST(sum(length(t) + 1) OVER w - 1 AS BIGINT) AS end_char FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line)",
)
def line_table(spark, sf_dir):
    return trees.lines(spark, sf_dir).select("doc_id", F.col("line").cast("bigint").alias("line"), "start_char", "end_char")


_KINDS = "function_declaration function_definition class_declaration class_definition interface_declaration variable_declaration let_declaration const_declaration constant type_declaration type_definition module_declaration namespace_declaration enum_declaration field_declaration property_declaration method_declaration method_definition constructor_declaration comment class_body Class_Declaration".split()
_SYMBOLS = "function function class class interface variable variable constant constant type type module namespace enum field property method method constructor other:comment other:class_body other:Class_Declaration".split()
_MODIFIERS = "pub public priv private protected internal package static Pub".split()
_SEEN = "public public private private protected internal package other:static other:Pub".split()


@query("symbol_kinds", f"SELECT o_orderkey, ({_SEEN})[o_orderkey % {len(_SEEN)} + 1] AS visibility, ({_SYMBOLS})[o_orderkey % {len(_SYMBOLS)} + 1] AS symbol FROM orders")
def symbol_kinds(spark, sf_dir):
    """Every kind and modifier that has a name of its own, and some that have none."""
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("o_orderkey") % len(words) + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", symbols.visibility(pick(_MODIFIERS)).alias("visibility"), symbols.symbol_kind(pick(_KINDS)).alias("symbol"))


# --- patterns, scans and rewriting ------------------------------------------

_VALUE = """
id: value
language: json
severity: warning
message: the value is $V, $SHOWN
rule: {pattern: '{"k": $V}'}
transform:
  SHOWN: {replace: {source: $V, replace: '^(\\d)', by: '<$1>'}}
fix: '{"key": $V}'
"""


def _events(found):
    return found.withColumn("event_id", F.col("file_id").cast("bigint"))


@query(
    "pattern_capture",
    """WITH v AS (SELECT event_id, props, regexp_extract(props, '^\\{"k": (.*)\\}$', 1) AS v FROM events WHERE regexp_matches(props, '^\\{"k": [^,{}]+\\}$')) SELECT event_id, 'value' AS rule_id, 'warning' AS severity, """
    """'the value is ' || v || ', ' || regexp_replace(v, '^([0-9])', '<\\1>') AS message, '{"key": ' || v || '}' AS edit_text, v FROM v""",
)
def pattern_capture(spark, sf_dir):
    """A rule document from its YAML to findings with message, transform and fix."""
    found = scan.scan_sources(trees.prop_sources(spark, sf_dir), rules.load(_VALUE))
    return _events(found).select("event_id", "rule_id", "severity", "message", "edit_text", F.get_json_object("captures", "$.V").alias("v"))


@query("constraint_filter", """SELECT event_id FROM events WHERE regexp_matches(props, '^\\{"k": [0-9]\\}$')""")
def constraint_filter(spark, sf_dir):
    rule = rules.load("id: small\nlanguage: json\nrule: {pattern: '{\"k\": $V}'}\nconstraints: {V: {regex: '^[0-9]$'}}\n")
    return _events(scan.scan_sources(trees.prop_sources(spark, sf_dir), rule, report_unused=False)).select("event_id")


@query("pattern_repeat_var", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS both FROM part WHERE CAST(p_size AS VARCHAR) = regexp_extract(p_brand, '([0-9]+)', 1)")
def pattern_repeat_var(spark, sf_dir):
    """Lists whose two numbers are the same: one variable that occurs twice."""
    found = scan.scan_sources(trees.pair_sources(spark, sf_dir), rules.load("id: same\nlanguage: json\nrule: {pattern: '[$A, $A]'}\n"), report_unused=False)
    return found.select(F.col("file_id").cast("bigint").alias("p_partkey"), F.get_json_object("captures", "$.A").alias("both"))


@query("strictness_levels", "SELECT s AS strictness, count(*) AS n FROM part, (VALUES ('cst'), ('smart'), ('ast'), ('relaxed'), ('signature')) v(s) WHERE p_size = 7 OR s = 'signature' GROUP BY s")
def strictness_levels(spark, sf_dir):
    """`[7, $B]` under each level; a signature asks for kinds alone."""
    text = "\n---\n".join(f"id: {s}\nlanguage: json\nrule: {{pattern: {{context: '[7, $B]', selector: array, strictness: {s}}}}}" for s in ("cst", "smart", "ast", "relaxed", "signature"))
    found = scan.scan_sources(trees.pair_sources(spark, sf_dir), rules.load(text), report_unused=False)
    return found.groupBy(F.col("rule_id").alias("strictness")).agg(F.count("*").alias("n"))


@query("pattern_ellipsis", "SELECT p_partkey, CAST(p_size AS VARCHAR) || ', ' || regexp_extract(p_brand, '([0-9]+)', 1) AS inside FROM part")
def pattern_ellipsis(spark, sf_dir):
    found = scan.scan_sources(trees.pair_sources(spark, sf_dir), rules.load("id: list\nlanguage: json\nmessage: $$$ALL\nrule: {pattern: '[$$$ALL]'}\n"), report_unused=False)
    return found.select(F.col("file_id").cast("bigint").alias("p_partkey"), F.col("message").alias("inside"))


@query("replace_all_text", """SELECT event_id, regexp_replace(props, '^\\{"k": ([^,{}]+)\\}$', '{"key": [\\1]}') AS content, CAST(CASE WHEN regexp_matches(props, '^\\{"k": [^,{}]+\\}$') THEN 1 ELSE 0 END AS BIGINT) AS n_edits FROM events""")
def replace_all_text(spark, sf_dir):
    return _events(rewrite.replace_all(trees.prop_sources(spark, sf_dir), '{"k": $V}', '{"key": [$V]}')).select("event_id", "content", "n_edits")


@query("remove_nodes", "SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS content FROM pages")
def remove_nodes(spark, sf_dir):
    out = rewrite.rewrite_sources(trees.page_sources(spark, sf_dir), lambda tree: [rewrite.node_edit("remove", n) for n in tree.nodes if n.kind == "comment"])
    return _page_id(out).select("page_id", "content")


@query("edits_apply", "SELECT page_id, regexp_replace(regexp_replace(html, '(?s)(<script[^>]*>).*?(</script>)', '\\1/**/\\2', 'g'), '(?s)(<!--.*?-->)', '[\\1]', 'g') AS content FROM pages")
def edits_apply(spark, sf_dir):
    """Edits of several sorts in one pass: script bodies are replaced, comments get brackets around them."""

    def edits(tree):
        out = []
        for n in tree.nodes:
            if n.kind == "raw_text" and n.parent.kind == "script_element":
                out.append(rewrite.node_edit("replace", n, "/**/"))
            elif n.kind == "comment":
                out += [rewrite.node_edit("before", n, "["), rewrite.node_edit("after", n, "]")]
        return out

    return _page_id(rewrite.rewrite_sources(trees.page_sources(spark, sf_dir), edits)).select("page_id", "content")


# --- symbols ----------------------------------------------------------------


@query("symbols_defs", "SELECT p_partkey, 'part_' || p_partkey AS name, 'def part_' || p_partkey || '(a, b=1)' AS signature, CAST(2 AS BIGINT) AS n_args FROM part")
def symbols_defs(spark, sf_dir):
    found = symbols.functions(trees.part_code(spark, sf_dir))
    return found.select(F.col("file_id").cast("bigint").alias("p_partkey"), "name", "signature", F.col("n_args").cast("bigint").alias("n_args"))


@query("symbol_calls", "SELECT p_partkey, 'part_' || p_size AS name FROM part")
def symbol_calls(spark, sf_dir):
    return symbols.calls(trees.part_code(spark, sf_dir)).select(F.col("file_id").cast("bigint").alias("p_partkey"), "name")


@query("import_edges", "SELECT p_partkey, 'json' AS target FROM part UNION ALL SELECT p_partkey, 'parts.part_' || p_size FROM part")
def import_edges(spark, sf_dir):
    return symbols.imports(trees.part_code(spark, sf_dir)).select(F.col("file_id").cast("bigint").alias("p_partkey"), "target")


@query("python_functions", "SELECT p_partkey, 'part_' || p_partkey AS name FROM part")
def python_functions(spark, sf_dir):
    """A node rule over parsed code: the names that stand in the field `name` of a definition."""
    found = scan.matches(trees.part_code(spark, sf_dir), {"name": {"kind": "identifier", "inside": {"kind": "function_definition", "field": "name"}}})
    return found.select(F.col("file_id").cast("bigint").alias("p_partkey"), F.col("text").alias("name"))


#: A function, a call and an import in other languages; the number of the part stands for #, that of its size for %.
CODES = {
    "javascript": "import { a } from 'lib%';\n\nexport function part_#(a, b = [1, 2]) {\n  return part_%(a, [b, 2]);\n}\n",
    "typescript": "import * as a from 'lib%';\n\nexport async function part_#(a: number, b: number[]): number\n{\n  return part_%(a, [b, 2]);\n}\n",
    "rust": "use lib%;\n\npub fn part_#(a: i32, b: Vec<i32>) -> i32 {\n    part_%(a, [b, 2])\n}\n",
    "go": "import \"lib%\"\n\nfunc part_#(a int, b []int) int {\n\treturn part_%(a, f{b, 2})\n}\n",
    "java": "import lib%;\n\npublic class A {\n    private int part_#(int a, int... b) {\n        return part_%(a, g[b]);\n    }\n}\n",
}


def _codes(spark, sf_dir):
    """A source for each part, in one of the languages by its number."""
    names, key = sorted(CODES), F.col("p_partkey")
    text = F.lit(None).cast("string")
    language = F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    for n in names:
        text = F.when(language == n, F.replace(F.replace(F.lit(CODES[n]), F.lit("#"), key.cast("string")), F.lit("%"), F.col("p_size").cast("string"))).otherwise(text)
    return read(spark, sf_dir, "part").select(key.cast("string").alias("file_id"), language.alias("language"), text.alias("content"))


@query("symbols_languages", f"SELECT p_partkey, ({sorted(CODES)})[p_partkey % {len(CODES)} + 1] AS language, w AS what, CASE w WHEN 'def' THEN 'part_' || p_partkey WHEN 'call' THEN 'part_' || p_size ELSE 'lib' || p_size END AS name, CASE WHEN w <> 'import' THEN 2 END AS n_args FROM part, (VALUES ('def'), ('call'), ('import')) v(w)")
def symbols_languages(spark, sf_dir):
    """Definitions, calls and imports of JavaScript, TypeScript, Rust, Go and Java."""
    found = symbols.extract(_codes(spark, sf_dir))
    return found.select(F.col("file_id").cast("bigint").alias("p_partkey"), "language", "what", "name", "n_args")


_NAMED = {"javascript": "function_declaration", "typescript": "function_declaration", "rust": "function_item", "go": "function_declaration", "java": "method_declaration"}


@query("named_kinds", f"SELECT p_partkey, CASE ({sorted(CODES)})[p_partkey % {len(CODES)} + 1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMED.items()) + " END AS kind, 'part_' || p_partkey AS name FROM part")
def named_kinds(spark, sf_dir):
    """The names of definitions by a rule over node kinds, in each of these languages."""
    kinds = {"any": [{"kind": k} for k in sorted(set(_NAMED.values()))]}
    found = scan.matches(_codes(spark, sf_dir), {"definition": kinds, "name": {"kind": "identifier", "inside": {**kinds, "field": "name"}}})
    pick = lambda rule, column: F.max(F.when(F.col("rule_id") == rule, F.col(column))).alias(column)
    node = F.when(F.col("rule_id") == "name", F.col("parent")).otherwise(F.col("pre")).alias("node")
    found = found.withColumnRenamed("text", "name").groupBy("file_id", node).agg(pick("definition", "kind"), pick("name", "name")).where("name IS NOT NULL")
    return found.select(F.col("file_id").cast("bigint").alias("p_partkey"), "kind", "name")


@query("css_declarations", """SELECT p_partkey, 'margin' AS property, p_size || 'px' AS value FROM part UNION ALL SELECT p_partkey, 'color', '#' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') FROM part""")
def css_declarations(spark, sf_dir):
    """Properties and values of style sheets."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit(".a, #b > p { margin: "), size, F.lit("px; /* x: y; */ }\n@media print { p { color: #"), F.lpad(key, 6, "0"), F.lit(" } }\n"))
    sources = read(spark, sf_dir, "part").select(key.alias("file_id"), F.lit("css").alias("language"), text.alias("content"))
    found = scan.declarations(sources, {"integer_value", "color_value"})
    return found.select(F.col("file_id").cast("bigint").alias("p_partkey"), "property", "value")
