"""Personal data: base patterns, and terms that disclose what the patterns protect.

Base spans (mail addresses, IP addresses, card and telephone numbers) come from fixed
patterns. The information-theoretic part estimates from the corpus how strongly a term that
stands near a protected entity reveals it:

    disclosure(t, e) = PMI(t; e) / IC(e) = log2(p(e | t) / p(e)) / log2(1 / p(e))
    p(e) = n(e) / N,  p(e | t) = (n(t,e) + SMOOTHING p(e)) / (n(t) + SMOOTHING)

where N, n(t) and n(e) count distinct texts: all, with the term, with the entity. n(t,e)
counts a text with the term within NEAR words of the entity as 1; texts that have both but
never that near count FAR each, all but the first of them, as a single text says nothing
about words far apart. Disclosure is near 1 for a term that occurs with
the entity alone and 0 for an independent one; SMOOTHING texts in which the term is
independent stand against what few texts say, so there is no least number of them. e is the
entity itself, the domain of a mail address, and the kind, so that counts accumulate over
addresses that occur once; the largest of the three counts. In a text with an entity, every
occurrence of a term whose disclosure reaches THRESHOLD is a span of its own (kind "term"),
near or far; sanitising removes the base spans behind a placeholder of their kind and
generalises terms to a placeholder that keeps their shape class.

One pass in Arrow batches finds the base spans and, of texts with an entity, the places of
all terms; the texts themselves are not shuffled. Pairs that stand far apart are formed only
where their counts could reach the threshold if all of them held, so terms of one text with
an entity and common words form none. Counts of the candidate terms over all texts are a
second pass, summed in each task. All counts are over all documents. A mail address that
very many documents share is a hot key of the pair counts, which are summed before they
move, and of joins that Spark splits by skew. A text with very many entities that recur
elsewhere, and very many rare terms that do, forms pairs by the product of both.

Defined cases: a null or empty text has no spans; repeated rows have the same spans each
and count once; the entity's own words are no terms; overlapping spans of several kinds are
all reported, sanitising replaces their union; very long texts, runs of digits among them,
are searched in time that grows with their length; null ids are kept; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.scale import small_side
from corpusloom.llm.common import ascii_lower, fresh, stored

KINDS = ("email", "ip", "card", "phone")
# patterns fixed by the contract
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a leftmost match starts where its digits start, so the inside of a long run is not tried again
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NEAR, FAR, SMOOTHING, THRESHOLD, MIN_TERM = 5, 0.75, 2.0, 0.8, 3
_TERM_SEPARATORS = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_UPPER = {i: i + 32 for i in range(65, 91)}
_DIGIT = re.compile("[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without overlap, looking only around each @: what the pattern takes
    before an @ is the run of name characters that ends there."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _NAME:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            end = m.end()
        at = text.find("@", max(end, at + 1))


_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    out = [(a, 0, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end(), "phone"))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def _entity(text: str, a: int, b: int, kind: str) -> str:
    return f"{kind}:{text[a:b].translate(_UPPER)}"


def _free_terms(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Terms outside the spans, in order, once for the text."""
    words, at = [], 0
    for a, b, _ in [*sorted(spans), (len(text), len(text), "")]:
        if a > at:
            words += [(m.start(), m.end()) for m in _TERM.finditer(text, at, a)]
        at = max(at, b)
    return words


def near_terms(text: str, spans: list[tuple[int, int, str]], near: int = NEAR, words: list[tuple[int, int]] | None = None) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) for the terms within `near` terms of an entity, outside any span."""
    if not spans:
        return []
    words = _free_terms(text, spans) if words is None else words
    starts = [w[0] for w in words]
    out = []
    for a, b, kind in spans:
        entity = _entity(text, a, b, kind)
        k = bisect_left(starts, a)
        for s, e in words[max(0, k - near):k + near]:
            if e - s >= MIN_TERM:
                out.append((entity, text[s:e].translate(_UPPER), s, e))
    return out


def _contexts(text: str, spans: list[tuple[int, int, str]], near: int) -> tuple[list[str], list[dict], list[dict]]:
    """The entities, the pairs that stand near, and the places of every term of the text."""
    if not spans:
        return [], [], []
    words = _free_terms(text, spans)
    places: dict[str, list[dict]] = {}
    for s, e in words:
        if e - s >= MIN_TERM:
            places.setdefault(text[s:e].translate(_UPPER), []).append({"start": s, "end": e})
    pairs = dict.fromkeys((x, t) for x, t, _, _ in near_terms(text, spans, near, words))
    entities = dict.fromkeys(_entity(text, *s) for s in spans)
    return list(entities), [{"entity": x, "term": t} for x, t in pairs], [{"term": t, "at": at} for t, at in places.items()]


def found(docs: DataFrame, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and spans of every row; entities, near pairs and terms where there are spans."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [base_spans(t) for t in b["t"]]
            parts = [_contexts(t, s, near) for t, s in zip(b.pop("t"), spans)]
            yield b.assign(
                spans=[[{"start": a, "end": e, "kind": k} for a, e, k in s] for s in spans],
                entities=[p[0] for p in parts], near=[p[1] for p in parts], terms=[p[2] for p in parts],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("t")).mapInPandas(
        run,
        f"doc_id {kind}, text_hash long, spans array<struct<start int, end int, kind string>>, entities array<string>,"
        " near array<struct<entity string, term string>>, terms array<struct<term string, at array<struct<start int, end int>>>>",
    )


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(text), _TERM_SEPARATORS), lambda w: F.length(w) >= MIN_TERM))


def _keys(entity: str) -> Column:
    """What an entity (kind:text) is counted as: itself, its mail domain and its kind."""
    kind = F.substring_index(entity, ":", 1)
    domain = F.when(kind == "email", F.concat(F.lit("email@"), F.substring_index(entity, "@", -1)))
    return F.array_compact(F.array(F.col(entity), domain, kind))


def _disclosure(n_all: int, n_both: Column | None = None) -> Column:
    p = F.col("n_key") / F.lit(float(n_all))
    given = ((F.col("n_both") if n_both is None else n_both) + SMOOTHING * p) / (F.col("n_term") + SMOOTHING)
    return F.when(p < 1, F.log2(given / p) / -F.log2(p)).otherwise(0.0)


def _with_entities(rows: DataFrame) -> DataFrame:
    """One row per distinct text that has an entity."""
    return rows.where(F.size("entities") > 0).groupBy("text_hash").agg(*[F.first(c).alias(c) for c in ("entities", "near", "terms")])


def _revealing(docs: DataFrame, n_all: int, texts: DataFrame, threshold: float, text_col: str) -> DataFrame:
    """key, term, disclosure: the pairs that reach the threshold."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    holders = stored(texts.select("text_hash", F.explode("entities").alias("entity")).select("text_hash", F.explode(_keys("entity")).alias("key")).distinct())
    keys = stored(holders.groupBy("key").agg(F.count("*").alias("n_key")))
    # the texts with both an entity and the term are some of all texts with it: a pair that fails
    # with this smaller count fails with the whole one, so common words are out before the count
    own = texts.select("text_hash", F.explode("terms.term").alias("term"))
    around = stored(own.groupBy("term").agg(F.count("*").alias("n_term")))
    near = (
        texts.select("text_hash", F.explode("near").alias("c")).select("text_hash", F.explode(_keys("c.entity")).alias("key"), "c.term")
        .distinct().groupBy("key", "term").agg(F.count("*").alias("n_near"))
    )
    # far pairs need a second text, and at most all texts of the key and all of the term are common
    bound = _disclosure(n_all, F.least("n_key", "n_term")) >= threshold - 1e-9
    shared = (
        own.join(around.where("n_term > 1"), "term").join(holders.join(keys.where("n_key > 1"), "key"), "text_hash")
        .where(bound).groupBy("key", "term").agg(F.count("*").alias("n_any"))
    )
    both = F.coalesce("n_near", F.lit(0)) + FAR * F.greatest(F.lit(0), F.coalesce("n_any", "n_near") - F.coalesce("n_near", F.lit(0)) - 1)
    pairs = stored(
        near.join(shared, ["key", "term"], "full").withColumn("n_both", both).join(keys, "key").join(around, "term")
        .where(_disclosure(n_all) >= threshold - 1e-9).select("key", "term", "n_both", "n_key")
    )
    # texts with the term: over all documents, equal texts counted once; the candidates alone leave a task
    wanted = small_side(pairs.select("term").distinct())
    terms = (
        docs.select(F.xxhash64(text).alias("text_hash"), F.explode(_terms(text)).alias("term"))
        .join(wanted, "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    )
    return (
        pairs.join(terms, "term").withColumn("disclosure", _disclosure(n_all))
        .where(F.col("disclosure") >= threshold).select("key", "term", "disclosure")
    )


def _revealed(texts: DataFrame, reveal: DataFrame) -> DataFrame:
    """text_hash, entity, term, at, disclosure: the revealing terms of each text and the entity they reveal."""
    own = texts.select("text_hash", F.explode("terms").alias("c")).select("text_hash", "c.term", "c.at")
    held = texts.select("text_hash", F.explode("entities").alias("entity")).withColumn("key", F.explode(_keys("entity")))
    return own.join(reveal, "term").join(held, ["text_hash", "key"]).select("text_hash", "entity", "term", "at", "disclosure")


def disclosing(docs: DataFrame, rows: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """entity, term, disclosure: the pairs of a text that reach the threshold."""
    n_all = rows.select("text_hash").distinct().count()
    texts = stored(_with_entities(rows))
    return (
        _revealed(texts, _revealing(docs, n_all, texts, threshold, text_col))
        .groupBy("entity", "term").agg(F.max("disclosure").alias("disclosure"))
    )


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, base and spans (base and terms), both array<struct<start, end, kind>>
    by start, then kind as listed; one row per document."""
    rows = stored(found(docs, near, id_col, text_col))
    # equal texts have equal spans: one row per text meets the pairs
    texts = stored(_with_entities(rows))
    n_all = rows.select("text_hash").distinct().count()
    reveal = _revealing(docs, n_all, texts, threshold, text_col)
    # every place of a term, however many entities it reveals
    places = _revealed(texts, reveal).groupBy("text_hash", "term").agg(F.first("at").alias("at"))
    extra = stored(
        places.select("text_hash", F.explode("at").alias("s")).groupBy("text_hash")
        .agg(F.collect_list(F.struct("s.start", "s.end", F.lit("term").alias("kind"))).alias("extra"))  # bounded by the text's own terms
    )
    order = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    full = F.concat("spans", F.coalesce("extra", F.array().cast("array<struct<start:int,end:int,kind:string>>")))
    ranked = F.array_sort(F.transform(full, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("k"), s["end"], s["kind"])))
    return (
        rows.select("doc_id", "text_hash", "spans").join(extra, "text_hash", "left")
        .select("doc_id", "text_hash", F.col("spans").alias("base"), F.transform(ranked, lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("spans"))
    )


def spans_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def one(text: str, found_spans) -> str:
        out, at = [], 0
        for s in found_spans:
            if s["start"] >= at:
                word = text[s["start"]:s["end"]]
                shape = "NAME" if word[:1].isupper() else "WORD"
                out += [text[at:s["start"]], f"[{shape if s['kind'] == 'term' else s['kind'].upper()}]"]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    return pd.Series([one(t, s) for t, s in zip(texts, spans)])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents with all their columns, spans replaced. A null text stays null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    replaced = F.pandas_udf(_replaced, "string")
    key, found_spans = fresh(docs, "_hash"), fresh(docs, "_spans")
    spans = (
        detect(docs, id_col, text_col, **settings).where(F.size("spans") > 0)
        .groupBy(F.col("text_hash").alias(key)).agg(F.first("spans").alias(found_spans))
    )
    return (
        docs.join(stored(spans), F.xxhash64(text) == F.col(key), "left")
        .withColumn(text_col, F.when(F.col(found_spans).isNotNull(), replaced(text, F.coalesce(found_spans, F.array().cast("array<struct<start:int,end:int,kind:string>>")))).otherwise(F.col(text_col)))
        .select(*docs.columns)
    )
