"""Text functions as Column expressions. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom import constants as K



def no_strings() -> Column:
    return F.expr("CAST(array() AS array<string>)")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uni_trim(c: Column) -> Column:
    """Trim Unicode white space; the builtin trims ASCII blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def nonempty(c: Column) -> Column:
    return F.filter(c, lambda x: F.length(x) > 0)


def ngrams(c: Column, n: int) -> Column:
    """Every run of n characters, overlapping. One regex pass with a look-ahead: taking
    substrings by position would cost the square of the length on long texts."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(" + "." * n + "))"), F.lit(1))


def quote_regex(c: Column) -> Column:
    """Escape a string for use as a literal inside a pattern."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def starts_with_any(c: Column, prefixes) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | c.startswith(p)
    return cond


def i32(c: Column) -> Column:
    """Fold a bigint to the signed 32-bit range (wrap-around arithmetic)."""
    return F.pmod(c + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)


# --- tokens ----------------------------------------------------------------
def _han_tokens(c: Column, stop: list[str]) -> Column:
    """Single characters, then pairs, of every run of Han characters."""
    runs = F.regexp_extract_all(c, F.lit(f"[{K.HAN}]+"), F.lit(0))
    is_stop = lambda ch: ch.isin(*stop)

    def of_run(run):
        singles = F.filter(F.split(run, ""), lambda ch: (F.length(ch) > 0) & ~is_stop(ch))
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        kept = F.filter(pairs, lambda p: ~is_stop(F.substring(p, 1, 1)) & ~is_stop(F.substring(p, 2, 1)))
        return F.concat(singles, F.when(F.length(run) > 1, kept).otherwise(no_strings()))

    return F.when(c.rlike(f"[{K.HAN}]"), F.flatten(F.transform(runs, of_run))).otherwise(no_strings())


def tokenize(c: Column, han_stop=None, latin_stop=None) -> Column:
    """Search tokens: latin words longer than one letter, then Han characters and pairs.

    Stop words are excluded inside the pattern, so the latin part is one regex pass.
    """
    han_stop = K.HAN_STOP if han_stop is None else han_stop
    latin_stop = K.LATIN_STOP if latin_stop is None else latin_stop
    text = F.coalesce(c, F.lit(""))
    word = rf"(?<![a-z0-9_])(?!(?:{'|'.join(latin_stop)})(?![a-z0-9_]))[a-z0-9_]{{2,}}"
    latin = F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0))
    return F.concat(latin, _han_tokens(text, han_stop))


def tokenize_rerank(c: Column) -> Column:
    return tokenize(c, K.RERANK_HAN_STOP, K.RERANK_LATIN_STOP)


def title_tokens(title: Column) -> Column:
    """Terms of a title: latin words of two letters or more, single Han characters."""
    latin = F.filter(
        F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9_]+"), F.lit(0)),
        lambda t: (F.length(t) >= 2) & ~t.isin(*K.CONCEPT_LATIN_STOP),
    )
    han = F.filter(
        F.regexp_extract_all(title, F.lit(f"[{K.HAN}]"), F.lit(0)), lambda t: ~t.isin(*K.CONCEPT_HAN_STOP)
    )
    return F.concat(latin, han)


def title_keywords(title: Column) -> Column:
    """Keywords of a title in order of preference, distinct."""
    t = F.regexp_replace(title, r"(?i)\.md$", "")
    t = F.element_at(F.split(t, "/"), -1)
    t = F.regexp_replace(t, r"^\d{4}[-_]\d{1,2}[-_]\d{1,2}[-_ ]?", "")
    t = F.regexp_replace(t, r"(?U)^\d+[.\-_\s]+", "")
    t = F.regexp_replace(t, f"^({'|'.join(K.TITLE_CATEGORY_PREFIXES)})", "")
    latin = F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    runs = F.regexp_extract_all(t, F.lit(f"[{K.HAN}]+"), F.lit(0))

    def of_run(run):
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        whole = F.when(F.length(run).between(2, 6), F.array(run)).otherwise(no_strings())
        kept = F.filter(pairs, lambda p: ~p.isin(*K.TITLE_STOP_BIGRAMS))
        return F.when(F.length(run) > 1, F.concat(kept, whole)).otherwise(no_strings())

    digits = F.filter(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.concat(latin, F.flatten(F.transform(runs, of_run)), digits))


# --- names -----------------------------------------------------------------
def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def title_of(path: Column, any_case: bool = False) -> Column:
    """Last path segment without `.md`; search drops the ending in any case."""
    pattern = r"(?i)\.md$" if any_case else r"\.md$"
    return F.regexp_replace(base_name(path), pattern, "")


def drop_md(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def encode_path(path: Column) -> Column:
    """Percent-encode each segment and keep the slashes."""

    def enc(seg):
        out = F.replace(F.url_encode(seg), F.lit("+"), F.lit("%20"))
        for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            out = F.replace(out, F.lit(code), F.lit(char))
        return out

    return F.array_join(F.transform(F.split(path, "/"), enc), "/")


def safe_file_name(path: Column) -> Column:
    base = title_of(path)
    named = F.when(F.length(base) > 0, base).otherwise(F.lit("笔记"))
    return F.substring(F.regexp_replace(named, r'[<>:"/\\|?*]', "_"), 1, 100)


# --- snippets --------------------------------------------------------------
def snippet(content: Column, tokens: Column, radius: int = K.SNIPPET_RADIUS) -> Column:
    """Text around the first query token, in query order, that occurs in the content."""

    def around(s):
        hit, at = s["hit"], s["at"]
        start = F.greatest(F.lit(0), at - 1 - radius)
        end = F.least(F.length(content), at - 1 + F.length(hit) + radius)
        mid = collapse(F.substring(content, start + 1, end - start))
        return F.concat(
            F.when(start > 0, "...").otherwise(""), mid, F.when(end < F.length(content), "...").otherwise("")
        )

    def head():
        cut = F.when(F.length(content) > 2 * radius, "...").otherwise("")
        return F.concat(collapse(F.substring(content, 1, 2 * radius)), cut)

    found = let(
        F.lower(content),
        lambda low: let(
            F.try_element_at(F.filter(tokens, lambda t: F.instr(low, t) > 0), F.lit(1)),
            lambda hit: F.struct(hit.alias("hit"), F.instr(low, hit).alias("at")),
        ),
    )
    return let(found, lambda s: F.when(s["hit"].isNull(), head()).otherwise(around(s)))


def cut(c: Column, n: int) -> Column:
    """First n characters, with dots where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def highlight_pattern(query: Column) -> Column:
    words = F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda t: F.length(t) >= 2)
    return F.when(F.size(words) > 0, F.concat(F.lit("(?iu)("), F.array_join(F.transform(words, quote_regex), "|"), F.lit(")")))


def highlight(text: Column, query: Column) -> Column:
    """Wrap every query word found in the text in `<mark>`, in any case."""
    return let(
        highlight_pattern(query),
        lambda p: F.when(p.isNull(), text).otherwise(F.regexp_replace(text, p, F.lit("<mark>$1</mark>"))),
    )


# --- front matter, tags ------------------------------------------------------
FRONT_BLOCK = r"(?s)^---\r?\n(.*?)\r?\n---"


def _clean_tag(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(uni_trim(c), r"""^['"]|['"]$""", ""), "^#", "")


def quick_tags(content: Column) -> Column:
    """Tags of the front matter block without parsing YAML: the list, then `tag:`."""
    block = F.regexp_extract(content, FRONT_BLOCK, 1)
    listed = F.split(F.regexp_extract(block, r"(?m)^tags:\s*\[([^\]]*)\]", 1), ",")
    single = F.array(F.regexp_extract(block, r"(?m)^tag:\s*(.+)$", 1))
    return nonempty(F.transform(F.concat(listed, single), _clean_tag))


def inline_tags(body: Column) -> Column:
    tag = rf"(?U)(?:^|\s|[(\[])#([a-zA-Z{K.HAN_TAG}][a-zA-Z0-9_\-/{K.HAN_TAG}]*)"
    return F.regexp_extract_all(body, F.lit(tag), F.lit(1))


def all_tags(body: Column, fm_tags: Column, fm_tag: Column) -> Column:
    """Distinct tags: the front matter list, the front matter `tag`, then inline `#tag`."""
    strip = lambda c: F.regexp_replace(c, "^#", "")
    listed = F.transform(F.coalesce(fm_tags, no_strings()), strip)
    single = F.when(fm_tag.isNotNull(), F.array(strip(fm_tag))).otherwise(no_strings())
    return F.array_distinct(F.concat(listed, single, inline_tags(body)))


def note_tags(fm_list: Column, fm_text: Column) -> Column:
    """Tag list as it is, or a string split on commas and blanks."""
    split = nonempty(F.split(fm_text, r"(?U)[,\s]+"))
    return F.coalesce(fm_list, F.when(fm_text.isNotNull(), split), no_strings())


# --- links -----------------------------------------------------------------
def links_render(content: Column) -> Column:
    """Distinct targets, text before the first bar, empty ones dropped."""
    raw = F.regexp_extract_all(content, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.array_distinct(nonempty(F.transform(raw, lambda t: uni_trim(F.substring_index(t, "|", 1)))))


def links_wiki(content: Column) -> Column:
    """Distinct targets; an alias, where present, must not be empty."""
    raw = F.regexp_extract_all(content, F.lit(r"\[\[([^\]|]+?)(?:\|[^\]]+)?\]\]"), F.lit(1))
    return F.array_distinct(F.transform(raw, uni_trim))


def links_graph(content: Column) -> Column:
    """Every occurrence, as a file name; targets starting with `!` are skipped."""
    raw = F.regexp_extract_all(content, F.lit(r"\[\[([^\]|]+?)(?:\|[^\]]*)?\]\]"), F.lit(1))
    kept = F.filter(F.transform(raw, uni_trim), lambda t: (F.length(t) > 0) & ~t.startswith("!"))
    return F.transform(kept, lambda t: F.when(F.lower(t).endswith(".md"), t).otherwise(F.concat(t, F.lit(".md"))))


# --- replies ---------------------------------------------------------------
def session_title(message: Column) -> Column:
    """First sentence of a message, twelve characters; null where nothing is left."""
    first = F.element_at(F.split(message, "[。\n!?？]"), 1)
    t = F.substring(uni_trim(first), 1, K.TITLE_CHARS)
    return F.when(F.length(t) > 0, t)


def json_payload(reply: Column) -> Column:
    """JSON inside a ```json fence, else the widest braces, else the whole text."""
    both = r"(?s)```json\s*(.*?)\s*```|(\{.*\})"
    fenced, braced = F.regexp_extract(reply, both, 1), F.regexp_extract(reply, both, 2)
    return F.when(F.length(fenced) > 0, fenced).when(F.length(braced) > 0, braced).otherwise(reply)


# --- hashes ----------------------------------------------------------------
def gram_hash(gram: Column) -> Column:
    """Signed 32-bit hash of an n-gram of at most four characters, in closed form:
    seed * 33^n + sum(c_i * 33^(n-i)), which fits a bigint before folding."""
    n = F.length(gram)
    total = F.aggregate(
        F.transform(F.split(gram, ""), lambda ch: F.ascii(ch).cast("bigint")),
        F.lit(K.HASH_SEED).cast("bigint"),
        lambda acc, code: acc * K.HASH_MULT + code,
    )
    return F.when(n <= 4, i32(total))
