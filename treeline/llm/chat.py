"""Operator 6: chat formatting over typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor
with one method for each type flattens them in order: text is kept, an
attachment becomes a numbered placeholder, its reference and the tokens that it
expands to are recorded. Numbers run through the whole conversation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm import bpe
from treeline.llm.shared import read

PART = "struct<type:string,text:string,uri:string,units:bigint>"
#: Tokens for each unit of an attachment: a tile of an image, a second of audio, a page of a document.
TOKENS = {"image": 576, "audio": 25, "document": 800}
TURN_TOKENS = 2
_PIECE = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"


def pieces(text: Column) -> Column:
    """Words and single marks of a text: a count that needs no vocabulary."""
    return F.regexp_count(text, F.lit(_PIECE)).cast("bigint")


def tokens(spark: SparkSession, vocabulary: str = bpe.VOCABULARY) -> Callable[[Column], Column]:
    """A count by the automaton of operator 1."""
    shared = spark.sparkContext.broadcast(bpe.compiled(vocabulary))

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        found = [np.zeros(0, np.int64), *(np.diff(off) for _, _, _, off, _ in bpe.encode_column(shared.value, texts))]
        return pa.array(np.concatenate(found).astype(np.int64))

    return count


def parts_of(text: Column) -> Column:
    """A content as a list of parts: a JSON list of parts is taken apart, anything else is one text part, null none."""
    listed = F.when(F.substring(F.trim(text), 1, 1) == "[", F.from_json(text, f"array<{PART}>", {"mode": "PERMISSIVE"}))
    typed = F.size(listed) == F.size(F.filter(listed, lambda p: p["type"].isNotNull()))
    plain = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("bigint").alias("units")))
    return F.when(text.isNull(), F.array().cast(f"array<{PART}>")).when(listed.isNotNull() & (F.size(listed) > 0) & typed, listed).otherwise(plain)


class Visitor:
    """What becomes of a part of each type, as columns over type, text, uri, units and number. count: tokens of a text."""

    def __init__(self, count: Callable[[Column], Column] = pieces):
        self.count = count

    def text(self) -> tuple[Column, Column]:
        # a marker inside a text must not look like ours
        body = F.coalesce(F.replace(F.col("text"), F.lit("<|"), F.lit("< |")), F.lit(""))
        return body, self.count(F.coalesce(F.col("text"), F.lit("")))

    def image(self) -> tuple[Column, Column]:
        return self._attachment("image")

    def audio(self) -> tuple[Column, Column]:
        return self._attachment("audio")

    def document(self) -> tuple[Column, Column]:
        return self._attachment("document")

    def other(self) -> tuple[Column, Column]:
        return F.lit(""), F.lit(0).cast("bigint")

    def _attachment(self, kind: str) -> tuple[Column, Column]:
        units = F.greatest(F.coalesce(F.col("units"), F.lit(1)), F.lit(0))
        return F.concat(F.lit(f"<|{kind}_"), F.col("number").cast("string"), F.lit("|>")), units * F.lit(TOKENS[kind])

    def visit(self) -> tuple[Column, Column]:
        body, tokens = self.other()
        for kind in ("text", *TOKENS):
            b, t = getattr(self, kind)()
            body, tokens = F.when(F.col("type") == kind, b).otherwise(body), F.when(F.col("type") == kind, t).otherwise(tokens)
        return body, tokens


def format_chats(turns: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """A row for each conversation: conv_id, n_turns, prompt, n_tokens, n_attachments, attachments (JSON).

    turns: conv_id, turn, role, text. Turns go by turn, nulls last, then role
    and text; repeated turns stay. A null text is a turn without content, a
    null role is written as unknown; turns with a null conv_id are one
    conversation. Parts of an unknown type leave nothing. An empty table gives
    no rows; further columns are left out.
    """
    visitor = visitor or Visitor()
    keyed = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.col("text").alias("content"), parts_of(F.col("text")).alias("parts"))
    order = [F.col("turn").asc_nulls_last(), "role", F.col("content").asc_nulls_last()]
    keyed = keyed.withColumn("turn_no", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    rows = keyed.select("conv_id", "turn_no", "role", F.size("parts").alias("n_parts"), F.posexplode_outer("parts").alias("part_no", "part"))
    rows = rows.select("conv_id", "turn_no", "role", "n_parts", F.coalesce("part_no", F.lit(0)).alias("part_no"), "part.*")
    attached = F.coalesce(F.col("type").isin(*TOKENS), F.lit(False))
    run = Window.partitionBy("conv_id").orderBy("turn_no", "part_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("attached", attached).withColumn("number", F.sum(attached.cast("bigint")).over(run))
    body, tokens = visitor.visit()
    first, last = F.col("part_no") == 0, F.col("part_no") >= F.col("n_parts") - 1
    piece = F.concat(F.when(first, F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))).otherwise(""), F.coalesce(body, F.lit("")), F.when(last, F.lit("<|end|>\n")).otherwise(""))
    rows = rows.select("conv_id", "turn_no", "part_no", "attached", "number", piece.alias("piece"), tokens.alias("tokens"), "type", "uri", first.cast("bigint").alias("opens"))
    ordered = lambda c: F.array_sort(F.collect_list(c))
    return rows.groupBy("conv_id").agg(
        F.sum("opens").alias("n_turns"),
        F.array_join(F.transform(ordered(F.struct("turn_no", "part_no", "piece")), lambda x: x["piece"]), "").alias("prompt"),
        (F.sum(F.coalesce("tokens", F.lit(0))) + F.sum("opens") * TURN_TOKENS).alias("n_tokens"),
        F.sum(F.col("attached").cast("bigint")).alias("n_attachments"),
        F.to_json(ordered(F.when(F.col("attached"), F.struct("number", "type", "uri", "tokens")))).alias("attachments"),
    )


def with_parts(turns: DataFrame) -> DataFrame:
    """turns with typed contents: by turn number an image after the text, audio before it, or a document and an image; every fourth stays plain."""
    uri = lambda kind: F.concat(F.lit(kind + "/"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    units = F.lit(1).cast("bigint") + F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(5))
    none = F.lit(None).cast("string")
    said = F.struct(F.lit("text").alias("type"), F.col("text"), none.alias("uri"), F.lit(None).cast("bigint").alias("units"))
    image, audio, document = (F.struct(F.lit(k).alias("type"), none.alias("text"), uri(k).alias("uri"), units.alias("units")) for k in TOKENS)
    kind = F.when(F.col("text").isNotNull(), F.pmod("turn", F.lit(4)))
    typed = F.when(kind == 1, F.array(said, image)).when(kind == 2, F.array(audio, said)).when(kind == 3, F.array(said, document, image))
    return turns.select("conv_id", "turn", "role", F.coalesce(F.to_json(typed), "text").alias("text"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, with attachments of all types among their turns, as prompts: `format_chats` of the whole table."""
    return format_chats(with_parts(read(spark, sf_dir, "conversations")))


OP6_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, CASE WHEN text IS NULL OR turn IS NULL THEN 0 ELSE ((turn % 4) + 4) % 4 END AS k,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), text NULLS LAST) AS n,
    1 + ((coalesce(conv_id, 0) % 5) + 5) % 5 AS units, concat_ws('-', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS place
  FROM conversations),
b AS (SELECT *, coalesce(sum(CASE k WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
a AS (
  SELECT conv_id, before + 1 AS number, CASE k WHEN 1 THEN 'image' WHEN 2 THEN 'audio' ELSE 'document' END AS type, place, units FROM b WHERE k > 0
  UNION ALL SELECT conv_id, before + 2, 'image', place, units FROM b WHERE k = 3),
j AS (SELECT *, units * CASE type WHEN 'image' THEN {TOKENS["image"]} WHEN 'audio' THEN {TOKENS["audio"]} ELSE {TOKENS["document"]} END AS tokens FROM a),
g AS (
  SELECT conv_id, count(*) AS n_attachments, sum(tokens) AS tokens,
    string_agg('{{"number":' || number || ',"type":"' || type || '","uri":"' || type || '/' || place || '","tokens":' || tokens || '}}', ',' ORDER BY number) AS listed
  FROM j GROUP BY conv_id),
p AS (
  SELECT *, replace(text, '<|', '< |') AS body, len(regexp_extract_all(text, '{_PIECE}')) AS tokens FROM b),
c AS (
  SELECT conv_id, count(*) AS n_turns, sum(tokens) AS tokens,
    string_agg('<|' || role || '|>' || chr(10) || CASE k WHEN 2 THEN '<|audio_' || (before + 1) || '|>' ELSE '' END || body
      || CASE k WHEN 1 THEN '<|image_' || (before + 1) || '|>' WHEN 3 THEN '<|document_' || (before + 1) || '|><|image_' || (before + 2) || '|>' ELSE '' END || '<|end|>' || chr(10), '' ORDER BY n) AS prompt
  FROM p GROUP BY conv_id)
SELECT c.conv_id, n_turns, prompt, CAST(c.tokens + coalesce(g.tokens, 0) + {TURN_TOKENS} * n_turns AS BIGINT) AS n_tokens,
  CAST(coalesce(n_attachments, 0) AS BIGINT) AS n_attachments, '[' || coalesce(listed, '') || ']' AS attachments
FROM c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id
"""
