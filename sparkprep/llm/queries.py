"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import (chat, hard_negatives, html_extract, langid, minhash, mixing, packing, prefix_trie, projections,
                           simhash, suffix_dedup, topk, url_filter)
from sparkprep.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):  # noqa: ANN201
    def deco(fn):  # noqa: ANN001, ANN202
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op1_document_fingerprints")
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edit_similarity(table(spark, sf_dir, "documents"))


@register("op2_exact_top_k", """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id,
             CAST(coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]), 0) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: Fixed values: (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@register("op3_url_filters")
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@register("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


#: A turn that says something is a call to one of two tools.
CHAT_SCHEMAS = {
    "reply": {"text": {"type": "string", "required": True, "min": 1, "max": 500},
              "turn": {"type": "integer", "required": True, "min": 0}},
    "set_context": {"text": {"type": "string", "required": True, "min": 1, "max": 200},
                    "turn": {"type": "integer", "required": True, "min": 0, "max": 0}},
}


def chat_tables(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``conversations``: user and system turns call a tool
    under the identifier conv:turn, after the call one or two turns before; an
    assistant turn is the result of the turn before it."""
    def key(back: int) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    asks = conversations.where(F.col("role").isin("user", "system"))
    arguments = F.to_json(F.struct("turn", "text"))
    calls = asks.select("conv_id", key(0).alias("call_id"), "turn",
                        F.when(F.col("role") == "user", "reply").otherwise("set_context").alias("name"),
                        arguments.alias("arguments"), F.array(key(1), key(2)).alias("after"))
    answers = conversations.where(F.col("role") == "assistant")
    return calls, answers.select("conv_id", key(1).alias("call_id"), "turn", F.col("text").alias("content"))


def _chat_error_sql(schemas: dict) -> str:
    out = "CASE"
    for tool, schema in schemas.items():
        t, n = schema["text"], schema["turn"]
        parts = [f"CASE WHEN text IS NULL THEN 'text: missing' WHEN length(text) < {t['min']} THEN 'text: shorter than {t['min']}' "
                 f"WHEN length(text) > {t['max']} THEN 'text: longer than {t['max']}' END",
                 f"CASE WHEN turn < {n['min']} THEN 'turn: less than {n['min']}'"
                 + (f" WHEN turn > {n['max']} THEN 'turn: more than {n['max']}'" if "max" in n else "") + " END"]
        out += f" WHEN name = '{tool}' THEN concat_ws('; ', {', '.join(parts)})"
    return out + " END"


@register("op6_tool_call_linking", f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id,
         CASE WHEN role = 'user' THEN 'reply' ELSE 'set_context' END AS name
  FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
p AS (SELECT c.*, coalesce(c1.call_id, c2.call_id) AS after_id FROM c
      LEFT JOIN c c1 ON c1.call_id = c.conv_id || ':' || (c.turn - 1)
      LEFT JOIN c c2 ON c2.call_id = c.conv_id || ':' || (c.turn - 2)),
d AS (SELECT call_id, 0 AS depth FROM p WHERE after_id IS NULL
      UNION ALL SELECT p.call_id, d.depth + 1 FROM p JOIN d ON p.after_id = d.call_id),
l AS (SELECT coalesce(p.conv_id, r.conv_id) AS conv_id, coalesce(p.call_id, r.call_id) AS call_id, p.turn, p.name, p.text,
             p.after_id, d.depth, r.turn AS result_turn, r.text AS content
      FROM p JOIN d USING (call_id) FULL JOIN r ON r.call_id = p.call_id)
SELECT conv_id, call_id, CAST(turn AS DOUBLE) AS turn, name, after_id, CAST(depth AS DOUBLE) AS depth,
  CAST(result_turn AS DOUBLE) AS result_turn,
  CASE WHEN name IS NULL THEN 'no_call' WHEN result_turn IS NULL THEN 'no_result' ELSE 'linked' END AS status,
  {_chat_error_sql(CHAT_SCHEMAS)} AS errors,
  '{{' || concat_ws(',', CASE WHEN name IS NOT NULL THEN '"arguments":{{"text":' || to_json(text) || ',"turn":' || turn || '}}' END,
    '"call_id":' || to_json(call_id), '"name":' || to_json(name), '"result":' || to_json(content)) || '}}' AS message
FROM l""")
def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_turns(table(spark, sf_dir, "conversations"))


def linked_turns(conversations: DataFrame) -> DataFrame:
    """Every row of ``conversations``, linked; further rows of a turn have status
    duplicate, rows of other roles other_role and the role as ``name``."""
    linked = chat.link_calls(*chat_tables(conversations), CHAT_SCHEMAS)
    other = conversations.where(~F.coalesce(F.col("role").isin("user", "system", "assistant"), F.lit(False))).select(
        "conv_id", "turn", F.col("role").alias("name"), F.lit("other_role").alias("status"),
        F.to_json(F.struct(F.col("role").alias("name"), F.col("text").alias("result"))).alias("message"))
    linked = linked.unionByName(other, allowMissingColumns=True)
    number = [F.col(c).cast("double").alias(c) for c in ("turn", "depth", "result_turn")]  # nulls compare alike as doubles
    return linked.select("conv_id", "call_id", "name", "after_id", *number, "status", "errors", "message")


@register("op7_suffix_array_dedup")
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("_row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
                      F.sha2(suffix_dedup.joined_bytes(F.col("parts")), 256).alias("kept_sha256"), "spans",
                      suffix_dedup.joined_text(F.col("parts")).alias("text"))


@register("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit_text_model(table(spark, sf_dir, "documents"))
    evidence = langid.page_evidence(table(spark, sf_dir, "pages"))
    return langid.identify(evidence, model, id_cols=["page_id"])


@register("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit_labeller(pages))


@register("op10_source_mixing")
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double"), "taken", "source",
                        "copies")


@register("op11_prefix_trie", r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, s, 0 AS k, CAST(4294967295 AS BIGINT) AS r FROM ids
  UNION ALL
  SELECT c, s, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
  FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(r, CAST(ascii(substr(s, CAST(k // 8 + 1 AS INTEGER), 1)) AS BIGINT)) ELSE r END AS v
        FROM crc WHERE k < 8 * length(s))),
heads AS (SELECT c, xor(r, 4294967295) % 4 AS h FROM crc WHERE k = 8 * length(s)),
own AS (SELECT conv_id AS c, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST, role, text) AS l
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
seq AS (SELECT own.c, list_concat(coalesce(b.l, [])[1:h], own.l[h + 1:]) AS q
        FROM own JOIN heads USING (c) LEFT JOIN own b ON b.c = own.c - own.c % 20),
r AS (SELECT c, d, q[1:d] AS k, len(q) AS n, q FROM (SELECT c, q, unnest(range(0, len(q) + 1)) AS d FROM seq)),
nodes AS (SELECT k, CAST(d AS BIGINT) AS depth, min(c) AS conv_id, count(*) AS n_convs,
            (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d][2], '[^\x20\x09-\x0D]+')) END AS value,
            sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
          FROM r GROUP BY k, d),
kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
under AS (SELECT DISTINCT a.k AS top, b.k AS k FROM r a JOIN r b ON a.c = b.c AND b.d >= a.d),
below AS (SELECT u.top AS k, sum(x.value) AS saved_tokens, count(*) FILTER (kids.n_children IS NULL) AS n_leaves
          FROM under u JOIN nodes x ON x.k = u.k LEFT JOIN kids ON kids.k = u.k GROUP BY 1)
SELECT n.conv_id, n.depth, CAST(p.conv_id AS HUGEINT) AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children,
       below.n_leaves, CAST(below.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below ON below.k = n.k LEFT JOIN kids ON kids.k = n.k
LEFT JOIN nodes p ON n.depth > 0 AND p.k = n.k[1:n.depth - 1]""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, parts = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    taken = F.crc32(conv.cast("string").cast("binary")) % 4
    nodes = prefix_trie.prefix_nodes(*prefix_trie.grafted_sequences(turns, parts, taken, conv - conv % 20))
    return nodes.drop("single")


@register("op12_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]), 0) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@register("op13_embedding_near_dedup")
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(table(spark, sf_dir, "embeddings"))
