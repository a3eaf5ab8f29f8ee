"""The registered queries of this subpackage and their checks in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import audit as op11
from corpusloom.llm import chat as op4
from corpusloom.llm import classifier as op10
from corpusloom.llm import decontaminate as op1
from corpusloom.llm import hardneg as op12
from corpusloom.llm import jaccard as op13
from corpusloom.llm import langid as op6
from corpusloom.llm import lines as op8
from corpusloom.llm import packing as op3
from corpusloom.llm import pii as op5
from corpusloom.llm import rules as op7
from corpusloom.llm import simhash as op2
from corpusloom.llm import tokens as op9
from corpusloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = rf"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
  SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM iw WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item FROM pos JOIN win ON win.n = pos.n AND win.g = array_to_string(pos.w[pos.i:pos.i + pos.n - 1], ' ')),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op1_decontaminate", OP1_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op1.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        op1.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def _divergence(p: str, q: str) -> str:
    """A cell's p ln(2p/(p+q)) + q ln(2q/(p+q)) in SQL."""
    return f"(CASE WHEN {p} > 0 THEN {p} * ln(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * ln(2 * {q} / ({p} + {q})) ELSE 0 END)"


_CELLS = [f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))" for _, pattern in op7.CLASSES]
_CELL_NAMES = [f"c{i}" for i in range(op7.CELLS)]
# the given documents have a few languages and no null ones, so every language has its reference
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, {", ".join(f"{e} AS c{i}" for i, e in enumerate(_CELLS))},
  length(t) - {" - ".join(f"({e})" for e in _CELLS)} AS c{op7.CELLS - 1} FROM d),
cr AS (SELECT lang, {", ".join(f"sum({c}) / sum(length(t)) AS q{c}" for c in _CELL_NAMES)} FROM b GROUP BY lang),
u AS (SELECT doc_id, lang, unnest(ws) AS word FROM b),
wc AS (SELECT lang, word, count(*) AS n FROM u GROUP BY ALL),
wr AS (SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS q, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM wc),
top AS (SELECT lang, word, q FROM wr WHERE r <= {op7.COMMON_WORDS}),
tq AS (SELECT lang, sum(q) AS q FROM top GROUP BY lang),
dw AS (SELECT u.doc_id, word, q, count(*) AS k FROM u JOIN top USING (lang, word) GROUP BY ALL),
ds AS (SELECT doc_id, sum(k) AS k, sum(dw.q) AS seen, sum({_divergence("(k / len(ws))", "dw.q")}) AS part FROM dw JOIN b USING (doc_id) GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b)),
rp AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g) WHERE times > 1) GROUP BY doc_id),
m AS (SELECT b.doc_id, len(ws) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
  coalesce(rp.n, 0) AS n_repeat_words,
  CASE WHEN length(t) >= {op7.MIN_CHARS} THEN sqrt(greatest(0, ({" + ".join(_divergence(f"(b.{c} / length(t))", f"cr.q{c}") for c in _CELL_NAMES)}) / (2 * ln(2)))) END AS cd,
  CASE WHEN len(ws) >= {op7.MIN_WORDS} THEN sqrt(greatest(0, (coalesce(part, 0) + greatest(0, tq.q - coalesce(seen, 0)) * ln(2) + {_divergence("((len(ws) - coalesce(k, 0)) / len(ws))", "greatest(0, 1 - tq.q)")}) / (2 * ln(2)))) END AS wd
  FROM b JOIN cr USING (lang) LEFT JOIN tq USING (lang) LEFT JOIN ds USING (doc_id) LEFT JOIN rp USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance, base_failed,
  NOT base_failed AND coalesce(cd, 0) <= {op7.MAX_CLASS_DISTANCE} AND coalesce(wd, 0) <= {op7.MAX_WORD_DISTANCE} AS kept FROM f"""


@query("op7_quality_rules", OP7_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op7.quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


_KEY = rf"regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
OP8_SQL = rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
keyed AS (SELECT doc_id, line, pos, {_KEY} AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, line, pos, keeper IS NOT NULL AND doc_id < keeper AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op8_line_dedup", OP8_SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op8.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op2.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; the folder is a parameter of the environment."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = op10.train(docs, table(spark, sf_dir, "labels"))
    out = op10.scores(docs, model)
    return out.select(
        "doc_id", op10.held_out(F.col("doc_id")).alias("held_out"), "score", op10.accepted(F.col("score")).cast("int").alias("predicted")
    )


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = op6.predict(docs, op6.train(docs))
    return out.select("doc_id", op10.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op5.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id", *[n(kind) for kind in op5.KINDS],
        F.sha2(op5.spans_text("base"), 256).alias("base_sha256"), op5.spans_text("spans").alias("spans"),
    )


OP4_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, -1), role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
p AS (SELECT *, list(role || chr(0) || text) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM n),
ends AS (SELECT min(conv_id) AS conv_id, upto FROM p WHERE pos = n_turns GROUP BY upto),
kept AS (SELECT conv_id FROM ends WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.upto = ends.upto))
SELECT conv_id, CAST(pos AS BIGINT) AS pos, CAST(n_turns AS BIGINT) AS n_turns, role,
  '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered, role = 'assistant' AS is_target
FROM n JOIN kept USING (conv_id)"""


@query("op4_chat_format", OP4_SQL)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.format_chats(table(spark, sf_dir, "conversations"))


_FAILS = rf"""
  CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first_id, false) AS INT)"""
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
m AS (SELECT part, {_FAILS} AS mask,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
  doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM w),
cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, CAST(pow(2, ascii(filter_order[step]) - 65) AS INT) AS bit,
  list_sum([CAST(pow(2, ascii(x) - 65) AS INT) for x in string_split(filter_order[1:step], '')]) AS applied
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, letter,
  sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & applied = bit THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & applied <> bit THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & applied = bit THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & applied = bit THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, (SELECT *  REPLACE (CAST(applied AS INT) AS applied) FROM s) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""


@query("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 100 == 0).alias("is_anchor")
    )
    return op12.hard_negatives(rows)


@query("op13_jaccard_join")
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.near_duplicates(table(spark, sf_dir, "documents"))
