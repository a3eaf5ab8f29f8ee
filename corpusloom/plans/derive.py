"""Document tables derived from the given tables.

The given `documents` have no folders, headings, tags, links or Han text, so the
note, manifest, listing, log and reply tables used by the queries are computed
from them by plain expressions. Each expression text is valid both in Spark SQL
and in DuckDB, so that a query and its check start from the same rows; the
operators themselves are written twice, independently.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"
WORDS = ["therea", "erblees", "ingand", "euxle", "schen", "cionla", "thand"]
TOPICS = ["图谱", "检索", "笔记", "摘要", "标签", "向量"]


def derived(spark: SparkSession, sf_dir: str, name: str, *exprs: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Expressions over a given table. A table read in fewer splits than there are cores
    (one row group at the small scales) is spread over them after the expressions; at
    scale the scan has enough splits and nothing is moved."""
    raw = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    cores = spark.sparkContext.defaultParallelism
    few = raw.rdd.getNumPartitions() < cores
    out = raw.selectExpr(*exprs) if exprs else raw
    if more:
        out = out.selectExpr("*", *more)
    return out.repartition(cores, out.columns[0]) if few else out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the text tables are spread where they are too small to be split."""
    if name in ("documents", "pages", "conversations"):
        return derived(spark, sf_dir, name)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(values: list[str], d: str) -> str:
    return f"split_part('{','.join(values)}', ',', CAST(({d}) % {len(values)} AS INT) + 1)"


def _s(d: str) -> str:
    return f"CAST({d} AS STRING)"


def topic_sql(d: str) -> str:
    return _pick(TOPICS, d)


def title_sql(d: str) -> str:
    w = _pick(WORDS, d)
    return (
        f"(CASE ({d}) % 4 WHEN 0 THEN {w} || '-' || {_s(d)}"
        f" WHEN 1 THEN '2024-03-1' || {_s(f'({d}) % 10')} || ' ' || {w} || ' ' || {_s(d)}"
        f" WHEN 2 THEN '知识' || {topic_sql(d)} || {_s(d)}"
        f" ELSE upper({w}) || '_' || {_s(d)} END)"
    )


def stem_sql(d: str) -> str:
    """Path without extension: a third of all notes share one folder, some have none."""
    area = f"'area' || {_s(f'({d}) % 20')}"
    return (
        f"((CASE WHEN ({d}) % 17 = 0 THEN '' WHEN ({d}) % 3 = 0 THEN 'inbox/'"
        f" WHEN ({d}) % 3 = 1 THEN {area} || '/笔记/' ELSE {area} || '/' END) || {title_sql(d)})"
    )


def path_sql(d: str) -> str:
    return f"({stem_sql(d)} || (CASE WHEN ({d}) % 29 = 5 THEN '.MD' ELSE '.md' END))"


HALF = "CAST(floor(doc_id / 2) AS BIGINT)"
FRONT = (
    "(CASE WHEN doc_id % 3 = 1 THEN '' ELSE '---' || chr(10)"
    " || 'tags: [' || lang || ', \"' || source || '\", \"#' || " + topic_sql("doc_id") + " || '\"]' || chr(10)"
    " || (CASE WHEN doc_id % 4 = 0 THEN 'tag: ''#hot''' || chr(10) ELSE '' END)"
    " || (CASE WHEN doc_id % 10 = 9 THEN 'note: [open' || chr(10) ELSE '' END)"
    " || 'order: ' || CAST(doc_id AS STRING) || chr(10) || '---' || chr(10) END)"
)
_PARA = "(CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END)"
BODY = (
    f"(CASE WHEN doc_id % 5 = 0 THEN {_PARA} ELSE replace(replace({_PARA},"
    " chr(10) || 'A', chr(10) || '## A'), chr(10) || 'E', chr(10) || '## E') END)"
)
TAIL = (
    "chr(10) || chr(10) || '知识图谱与检索的方法，' || " + topic_sql("doc_id") + " || '和我的' || " + topic_sql("doc_id + 1")
    + " || '。 #' || " + topic_sql("doc_id") + " || '/sub (#inline' || CAST(doc_id % 10 AS STRING) || ')' || chr(10)"
    + " || 'See [[' || " + stem_sql(HALF) + " || ']] and [[' || " + title_sql("doc_id + 1") + " || '|next]].' || chr(10)"
    + " || (CASE WHEN doc_id % 3 = 0 THEN 'Hub [[' || " + title_sql("0") + " || ']] [[ ' || " + title_sql("0")
    + " || ' ]]' || chr(10) ELSE '' END)"
    + " || (CASE WHEN doc_id % 4 = 1 THEN 'Also [[' || upper(" + title_sql("doc_id + 2") + ") || '.md]]' || chr(10) ELSE '' END)"
    + " || (CASE WHEN doc_id % 5 = 0 THEN 'Lost [[missing note]] [[!embed]] [[a#h|]]' || chr(10) ELSE '' END)"
    + " || (CASE WHEN doc_id % 6 = 0 AND doc_id > 0 THEN 'Back [[' || " + stem_sql("doc_id - 1") + " || ']]' || chr(10) ELSE '' END)"
)
# one note in 23 has neither links nor tags
CONTENT = f"(CASE WHEN doc_id % 23 = 4 THEN text ELSE {FRONT} || {BODY} || {TAIL} END)"
MTIME = f"(1700000000000 + {HALF} * 60000)"

NOTES_COLS = [
    "doc_id", f"{path_sql('doc_id')} AS path", f"{CONTENT} AS content", f"{MTIME} AS mtime",
    f"{MTIME} + 1 AS cached_at",
]
NOTES_SQL = f"SELECT *, md5(content) AS hash FROM (SELECT {', '.join(NOTES_COLS)} FROM documents)"

MANIFEST_COLS = [
    "path", "CAST(octet_length(encode(content, 'UTF-8')) AS BIGINT) AS size",
    "mtime + (CASE WHEN doc_id % 13 = 0 THEN 5000 WHEN doc_id % 13 = 1 THEN -5000 ELSE 0 END) AS mtime",
    "(CASE WHEN doc_id % 7 = 0 THEN md5('v2' || content) ELSE hash END) AS hash",
]
MANIFEST_SQL = (
    "SELECT " + ", ".join(MANIFEST_COLS).replace("octet_length(encode(content, 'UTF-8'))", "octet_length(encode(content))")
    + " FROM notes WHERE doc_id % 11 <> 0"
    " UNION ALL SELECT 'files/' || CAST(doc_id AS STRING) || '.png', doc_id, mtime, hash FROM notes WHERE doc_id % 9 = 0"
)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 with a `doc_id` column kept for joins to other given tables."""
    return derived(spark, sf_dir, "documents", *NOTES_COLS, more=("md5(content) AS hash",))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    return n.where("doc_id % 11 <> 0").selectExpr(*MANIFEST_COLS).unionByName(
        n.where("doc_id % 9 = 0").selectExpr("'files/' || CAST(doc_id AS STRING) || '.png' AS path", "doc_id AS size", "mtime", "hash")
    )


def with_tables(*names: str) -> str:
    """`WITH` prefix giving DuckDB the same derived tables."""
    known = {"notes": NOTES_SQL, "manifest": MANIFEST_SQL}
    order = ["notes", "manifest"]
    need = set(names)
    if "manifest" in need:
        need.add("notes")
    return "WITH " + ", ".join(f"{n} AS ({known[n]})" for n in order if n in need) + " "
