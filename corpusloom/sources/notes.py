"""Reading note files, and their front matter."""

from __future__ import annotations

import json
import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FRONT = re.compile(r"^﻿?---\r?\n(.*?)\r?\n---\r?\n?", re.S)
_KEY = re.compile(r"^([^:\n\s][^:\n]{0,39}):\s*(.*)$")


def read_notes(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, content, mtime, size) of files below a folder, paths relative to it."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    )
    base = root.rstrip("/") + "/"
    rel = F.substring_index(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), base, -1)
    return files.select(
        rel.alias("path"), F.decode("content", "UTF-8").alias("content"),
        F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"),
    )


def _salvage(block: str) -> dict:
    """`key: value` lines of a block that is not valid YAML."""
    found = (_KEY.match(line) for line in re.split(r"\r?\n", block))
    return {m.group(1).strip(): m.group(2).strip() for m in found if m}


def front_matter(content: str) -> tuple[dict, str]:
    m = FRONT.match(content)
    if not m:
        return {}, content
    block, body = m.group(1), content[m.end():]
    try:
        data = yaml.safe_load(block)
    except Exception:  # noqa: BLE001 - any malformed block is salvaged line by line
        return _salvage(block), body
    return (data if isinstance(data, dict) else {}), body


def parse_front_matter(notes: DataFrame) -> DataFrame:
    """(path, fm map<string,string>, fm_tags, fm_tag, fm_tags_text, body). List and map
    values are kept as JSON text in the map; `tags` is also given as a list."""

    def job(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                data, body = front_matter(content or "")
                plain = {
                    str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)
                    for k, v in data.items() if v is not None
                }
                tags, tag = data.get("tags"), data.get("tag")
                rows.append((
                    path, plain, [str(t) for t in tags if t is not None] if isinstance(tags, list) else None,
                    tag if isinstance(tag, str) else None, tags if isinstance(tags, str) else None, body,
                ))
            yield pd.DataFrame(rows, columns=["path", "fm", "fm_tags", "fm_tag", "fm_tags_text", "body"])

    return notes.select("path", "content").mapInPandas(
        job, "path string, fm map<string,string>, fm_tags array<string>, fm_tag string, fm_tags_text string, body string"
    )


def _as_text(value) -> str:
    """A tag as the text it is shown by."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def list_tags(content: Column) -> Column:
    """The front matter's `tags` where YAML gives a list, without one leading `#`, repeats
    kept; an empty list for anything else, a broken header included."""

    def job(texts: pd.Series) -> pd.Series:
        def one(text):
            tags = front_matter(text)[0].get("tags") if text and FRONT.match(text) else None
            return [_as_text(t).removeprefix("#") for t in tags] if isinstance(tags, list) else []

        return texts.map(one)

    return F.pandas_udf(job, "array<string>")(content)
