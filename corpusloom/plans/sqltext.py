"""Pieces of DuckDB SQL used by the checks."""

from __future__ import annotations

from corpusloom import constants as K


def quoted(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def tokens(e: str, han=None, latin=None) -> str:
    """Token list of an expression."""
    han, latin = quoted(han or K.HAN_STOP), quoted(latin or K.LATIN_STOP)
    singles = f"list_filter(string_split(r, ''), lambda c: c NOT IN {han})"
    pairs = (
        f"list_transform(list_filter(range(1, length(r)), lambda i: substr(r, i, 1) NOT IN {han}"
        f" AND substr(r, i + 1, 1) NOT IN {han}), lambda i: substr(r, i, 2))"
    )
    return (
        f"list_concat(list_filter(regexp_extract_all(lower({e}), '[a-z0-9_]+'), lambda t: length(t) > 1 AND t NOT IN {latin}),"
        f" flatten(list_transform(regexp_extract_all({e}, '[一-鿿]+'), lambda r: list_concat({singles}, {pairs}))))"
    )


def rerank_tokens(e: str) -> str:
    return tokens(e, K.RERANK_HAN_STOP, K.RERANK_LATIN_STOP)


def base(e: str) -> str:
    return f"regexp_extract({e}, '([^/]*)$', 1)"


def title(e: str) -> str:
    return f"regexp_replace({base(e)}, '\\.md$', '')"


def title_ci(e: str) -> str:
    return f"regexp_replace({base(e)}, '(?i)\\.md$', '')"


def trim(e: str) -> str:
    return f"regexp_replace({e}, '^[\\s　]+|[\\s　]+$', '', 'g')"


def cut(e: str, n: int) -> str:
    return f"CASE WHEN length({e}) > {n} THEN substr({e}, 1, {n}) || '...' ELSE {e} END"


def snippet(content: str, toks: str) -> str:
    """Snippet of `content` for a token list; both must be plain column names."""
    hit = f"list_filter({toks}, lambda t: position(t in lower({content})) > 0)[1]"
    at = f"position({hit} in lower({content}))"
    lo = f"greatest(0, {at} - 101)"
    hi = f"least(length({content}), {at} - 1 + length({hit}) + 100)"
    return (
        f"CASE WHEN {hit} IS NULL THEN regexp_replace(substr({content}, 1, 200), '\\s+', ' ', 'g')"
        f" || CASE WHEN length({content}) > 200 THEN '...' ELSE '' END"
        f" ELSE CASE WHEN {lo} > 0 THEN '...' ELSE '' END"
        f" || regexp_replace(substr({content}, {lo} + 1, {hi} - {lo}), '\\s+', ' ', 'g')"
        f" || CASE WHEN {hi} < length({content}) THEN '...' ELSE '' END END"
    )


LINKS_WIKI = r"list_distinct(list_transform(regexp_extract_all(content, '\[\[([^\]|]+?)(?:\|[^\]]+)?\]\]', 1), lambda x: trim(x)))"
LINKS_GRAPH = (
    r"list_transform(list_filter(list_transform(regexp_extract_all(content, '\[\[([^\]|]+?)(?:\|[^\]]*)?\]\]', 1),"
    r" lambda x: trim(x)), lambda t: t <> '' AND t[1] <> '!'),"
    r" lambda t: CASE WHEN lower(t) LIKE '%.md' THEN t ELSE t || '.md' END)"
)
LINKS_RENDER = (
    r"list_distinct(list_filter(list_transform(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1),"
    r" lambda x: trim(split_part(x, '|', 1))), lambda x: x <> ''))"
)
_FM = r"regexp_extract(content, '(?s)^---\r?\n(.*?)\r?\n---', 1)"
_STRIP = r"regexp_replace(regexp_replace(trim(x), '^[''\"]|[''\"]$', '', 'g'), '^#', '')"
QUICK_TAGS = (
    rf"list_filter(list_transform(list_concat(string_split(regexp_extract({_FM}, '(?m)^tags:\s*\[([^\]]*)\]', 1), ','),"
    rf" [regexp_extract({_FM}, '(?m)^tag:\s*(.+)$', 1)]), lambda x: {_STRIP}), lambda x: x <> '')"
)
# spans of every folder prefix of `path`
FOLDERS = "list_transform(range(1, length(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))"
TOP = "CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END"
