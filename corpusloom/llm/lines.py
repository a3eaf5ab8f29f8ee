"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line stripped and in lower case. The state is a set of runs: tables of
(key hash, documents that hold it, largest such document), each sorted by hash and written
to the shared folder. Documents come in batches of descending ids, so the first batch that
holds a key also holds the document that keeps it. A new batch merge-anti-joins the runs:
keys already settled there (in enough documents, their keeper known) need nothing more and
are left out; the rest is the batch's own run on level 0. When a level has FAN_IN runs they
are compacted: merged, summed per key and written as one run of the next level. A row is
rewritten once per level, not once per batch, and a very common line is written only until
it is settled.

`dedup_lines` compacts to one run in the end and drops, from every document but the largest
holding it, each line whose key is long enough and in enough documents. Hashes have 128
bits (two independent 64-bit ones), so that no collision is expected even among 10^15
lines. Line keys move as hashes; texts are shuffled once, where they meet the positions to
drop. A common line is summed in its task before it moves, and the join of lines with
common keys is one that Spark splits by skew.

Defined cases: a null or empty text is one empty line and comes out as ""; short keys are
never dropped; a line repeated inside one document counts one document and all its
occurrences are dropped or kept together; rows sharing a doc_id count as one document; rows
with a null id hold no keys and keep all lines; extra columns are kept; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import WS, ascii_lower, fresh, stored

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FAN_IN = 4, 2


def line_keys(text: Column) -> Column:
    """Keys of the lines of a text, in order."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.trim(x, F.lit(WS)))


def hashed(key: Column) -> Column:
    """The key's hash, null for keys too short to be dropped."""
    both = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))
    return F.when(F.length(key) >= MIN_CHARS, both)


class LineRuns:
    """Levelled runs of (a, b, n_docs, max_doc)."""

    def __init__(self, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN):
        self.min_docs, self.fan_in = min_docs, fan_in
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _write(rows: DataFrame) -> DataFrame:
        return stored(rows.sortWithinPartitions("a", "b"))

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._put(self._write(self._merge(full)), level + 1)

    def add(self, keys: DataFrame) -> None:
        """A batch of distinct (a, b, doc) rows, all of whose documents have smaller ids
        than those of the batches before."""
        own = keys.groupBy("a", "b").agg(F.count("doc").alias("n_docs"), F.max("doc").alias("max_doc"))
        for run in self.runs():
            settled = run.where(F.col("n_docs") >= self.min_docs).select("a", "b")
            own = own.join(settled.hint("merge"), ["a", "b"], "left_anti")
        self._put(self._write(own), 0)

    def compacted(self) -> DataFrame:
        """All levels as one run."""
        runs = self.runs()
        if len(runs) > 1:
            self.levels = [[] for _ in self.levels] + [[self._write(self._merge(runs))]]
        return self.runs()[0]


def _batches(keys: DataFrame, n: int) -> list[DataFrame]:
    """The rows cut at quantiles of the document id, largest ids first."""
    cuts = keys.agg(F.percentile_approx("doc", [i / n for i in range(1, n)], 1000)).first()[0] or []
    edges = [None, *sorted(set(cuts), reverse=True), None]
    parts = []
    for above, below in zip(edges[:-1], edges[1:]):
        part = keys if above is None else keys.where(F.col("doc") < above)
        parts.append(part if below is None else part.where(F.col("doc") >= below))
    return parts


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """All columns of the documents, the text without the dropped lines, and n_lines and
    n_dropped (with underscores appended where the documents have such columns)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    doc, key, lost, left, all_lines = (fresh(docs, x) for x in ("_doc", "_t", "_gone", "_left", "_lines"))
    lines = stored(
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("t"), F.posexplode(F.transform(line_keys(text), hashed)).alias("pos", "h"))
        .where("h is not null")
        .select("doc", "t", "pos", "h.a", "h.b")
    )
    runs = LineRuns(min_docs, fan_in)
    for batch in _batches(lines.select("a", "b", "doc"), batches):
        runs.add(batch.distinct())
    common = stored(runs.compacted().where(F.col("n_docs") >= min_docs).select("a", "b", "max_doc"))
    drops = (
        lines.join(common, ["a", "b"]).where(F.col("doc") < F.col("max_doc"))
        .groupBy(F.col("doc").alias(doc), F.col("t").alias(key)).agg(F.collect_set("pos").alias(lost))  # bounded by the document's lines
    )
    drops = stored(drops)
    parts = F.split(text, "\n")
    gone = F.coalesce(F.col(lost), F.array().cast("array<int>"))
    out = (
        docs.join(drops, (F.col(id_col) == F.col(doc)) & (F.xxhash64(text) == F.col(key)), "left")
        .withColumn(n_lines, F.size(parts).cast("long"))
        .withColumn(n_dropped, F.size(gone).cast("long"))
        .withColumn(left, F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone))
        .withColumn(all_lines, parts)
        .withColumn(text_col, F.array_join(F.transform(left, lambda i: F.get(F.col(all_lines), i)), "\n"))
    )
    return out.select(*docs.columns, n_lines, n_dropped)
