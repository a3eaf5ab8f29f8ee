"""Fixed values.

Everything here must keep the stated value for results to be right: word lists,
weights, sizes, thresholds and text formats.
"""

# --- word lists -----------------------------------------------------------
HAN_STOP = "的 了 是 在 和 与 或 及 等 为 我 你 他 她 它".split()
LATIN_STOP = (
    "a an the is are was were be been and or but in on "
    "at to for of with by as this that these those it its"
).split()
RERANK_HAN_STOP = HAN_STOP + "这 那 有 没 不 也 都 就 要 会 能 把 被 对 从".split()
RERANK_LATIN_STOP = LATIN_STOP + "i you he she we they".split()
CONCEPT_HAN_STOP = HAN_STOP + "这 那 有 没 不 也 都 就 要 会 能".split()
CONCEPT_LATIN_STOP = (
    "a an the is are was were be been and or but "
    "in on at to for of with by as this that "
    "i you he she we they it its"
).split()
TITLE_STOP_BIGRAMS = "这是 我们 他们 自己 因为 所以 如果 或者 那么 什么 怎么 现在 可以 应该 需要".split()
TITLE_CATEGORY_PREFIXES = "公众号 读书 笔记 草稿 模板 归档".split()
IMAGE_EXTENSIONS = "jpg jpeg png webp".split()

# --- character classes ----------------------------------------------------
HAN = r"\x{4e00}-\x{9fff}"  # text search, titles
HAN_TAG = r"\x{4e00}-\x{9fa5}"  # inline tags
PDF_MARK, EPUB_MARK = "📕", "📘"  # path prefixes of local books
LOCAL_MARKS = (PDF_MARK, EPUB_MARK)

# --- retrieval ------------------------------------------------------------
BM25_K1, BM25_B, BM25_AVG_LEN = 1.5, 0.75, 300
SNIPPET_RADIUS = 100
DEFAULT_K, DEFAULT_MAX_CHARS = 9999, 30000
RESULT_OVERHEAD = 50  # per-result cost added to the character budget
VECTOR_SNIPPET = 300
FUSE_TOP, RRF_C = 50, 60
CONTEXT_SNIPPET = 600
PIN_CHUNKS, PIN_TOTAL = 5, 30

# --- reranking ------------------------------------------------------------
TITLE_HIT, HEADING_HIT, CONTENT_TF, PHRASE_BONUS = 3.0, 2.0, 1.0, 1.5
SHORT_CHUNK_PENALTY, SHORT_CHUNK_CHARS, PHRASE_MIN = 0.8, 50, 4

# --- chunking and embedding ----------------------------------------------
CHUNK_MAX, CHUNK_MIN_BREAK, CHUNK_OVERLAP = 800, 100, 100
PARAGRAPH_CHUNK, BOOK_CHUNK, LONG_PARAGRAPH = 400, 500, 1.5
VEC_DIM, NGRAM_MIN, NGRAM_MAX = 256, 2, 4
HASH_SEED, HASH_MULT = 5381, 33

# --- graph, statistics, automatic links ------------------------------------
EDGE_WEIGHT_CAP, MAX_EDGES, MAX_NODES, FILL_NODES, HUB_IN = 5, 800, 220, 200, 3
MOC_LIMIT = 20
MAX_CONCEPTS, MAX_TAG_GROUPS, MAX_TIMELINE, CONCEPT_PATHS = 10, 8, 15, 3
BACKLINK_CONTEXT = 200
AUTOLINK_PER_NOTE, AUTOLINK_MIN_TITLE, FRONT_ZONE, PREVIEW_RADIUS = 50, 3, 200, 30

# --- chat, memory, history, agent ------------------------------------------
CHAT_KEEP, HISTORY_KEEP, SNAPSHOT_MAX_BYTES = 200, 30, 512 * 1024
PROMPT_TURNS, MEMORY_TURNS, MEMORY_TURN_CHARS, MEMORY_MIN_TURNS = 16, 6, 500, 2
TITLE_CHARS = 12
MEMORY_TOPICS, MEMORY_ITEMS = 3, 6
TOPIC_TITLE, TOPIC_SUMMARY, ITEM_CONTENT = 80, 500, 200
CONTEXT_TOPICS, CONTEXT_ITEMS = 10, 4
AGENT_MAX_STEPS = 18
AGENT_TOOLS = (
    "kb_search web_search note_open list_files note_edit "
    "get_chunk list_tags get_history find_by_tag"
).split()

# --- web results, books, monitoring ----------------------------------------
WEB_CONTENT = 800
BOOK_MIN_CHARS, FALLBACK_MIN_CHARS = 50, 50
SCANNED_SHARE, SPINE_SHARE = 0.5, 0.5
RUNS_CHECKED, REPORTS_CHECKED = 12, 4
STALE_MINUTES, MANIFEST_WARN_DIFF = 30, 3
IDLE_WARN_MIN, IDLE_ERROR_MIN = 20, 45
ALERT_THRESHOLD, ALERT_REPEAT_HOURS = 3, 6

# --- text formats ----------------------------------------------------------
KB_SECTION = "## 知识库检索结果（本地笔记 chunks）"
WEB_SECTION = "## 联网搜索结果"
NOTHING_FOUND = "(无 — 知识库内未找到相关内容)"
BLOCK_SEPARATOR = "\n\n---\n\n"
ROOT_FOLDER = "(root)"
