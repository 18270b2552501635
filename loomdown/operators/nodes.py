"""A page becomes rows of a node table.

``nodes(page_id, pos, ord, sub, elem, end, depth, parent, box, kind, tag, amap, cls, role, text, any_text, piece)``

* one row per token (N1), ``pos`` is the token index inside the page;
* nested-set interval ``[pos, end)`` per element, exclusive ``end`` (N3): a close tag
  pops through the nearest open element with that tag (matched: ``end = close + 1``; popped with it: ``end = close``),
  a close tag with no such open element is ignored, elements left open end at the page's token count;
* ``depth`` = number of enclosing elements, ``parent`` = position of the innermost one (N4);
* ``box`` = position of the innermost div, li, article or section around it (J2), from the same pass;
* ``amap`` attribute map (N2), entity-decoded text (N7).

Physical plan: pages are hash-partitioned by ``page_id`` once, *before* the explode, so every later window, aggregate
and self-join keyed by ``page_id`` reuses that partitioning and the only Exchange moves the raw page rows.
The nesting of a page is one linear walk over its events (``operators.nesting``); very long pages are nested in pieces by several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdown.functions import constants as K
from loomdown.functions.text import WS, decode_entities, strip_ws
from loomdown.operators.nesting import SPLIT, events_of, nest_long, nest_whole

# N1 token pattern (Java regex). Possessive quantifiers keep long attribute values / text runs from backtracking.
# One alternative per raw-text element so that '<script>...</style>' is never taken as one token.
TOKEN_RE = (
    r"(?is)(<!--.*?-->"
    r"|<script\b[^>]*+>.*?</script\s*>|<style\b[^>]*+>.*?</style\s*>"
    r"|<textarea\b[^>]*+>.*?</textarea\s*>|<title\b[^>]*+>.*?</title\s*>"
    r"|<![^>]*+>|<\?[^>]*+>"
    r"|</?[a-z](?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>"
    r"|[^<]++|<)"
)
ATTR_RE = r"[^\s\"'>/=]++(?:\s*=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+))?"
BARE_RE = r"^<[A-Za-z][^\s/>\"']*+/?+>"  # an open tag of nothing but its name

_VOID = ", ".join(f"'{t}'" for t in K.VOID_TAGS)

_RAW = ", ".join(f"'{t}'" for t in K.RAW_TAGS)
TAG_SQL = "lower(regexp_extract(tok, '^</?([A-Za-z][^\\\\s/>]*)', 1))"

# Token kind. A raw-text element is one token that ends with its own closing tag (only the raw alternatives of the
# token pattern produce that), however much white space the closing tag holds. Quotes open a value only after '='.
KIND_SQL = f"""case
  when tok like '<!--%' then 'comment'
  when tok like '<!%' or tok like '<?%' then 'decl'
  when tok like '</%' then case when tok rlike '^</[A-Za-z]' then 'close' else 'text' end
  when tok rlike '^<[A-Za-z]' then
    case when {TAG_SQL} in ({_RAW}) and tok rlike '(?i)</(script|style|textarea|title)\\\\s*>\\\\z' then 'raw'
         when {TAG_SQL} in ({_VOID}) or tok like '%/>' then 'void'
         else 'open' end
  else 'text' end"""

def page_partitions(spark) -> int:
    """Partitions for the page shuffle: the session's shuffle partitions, at least the default parallelism."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(n, spark.sparkContext.defaultParallelism)


def page_key(key: str) -> Column:
    """The key as ``page_id``. No alias if it has that name: the optimiser drops such an alias, and a table checkpointed behind it
    keeps a partitioning by a column that it no longer has, so that every reader moves its rows again."""
    return F.col(key) if key == "page_id" else F.col(key).alias("page_id")


def tokenize(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Page rows -> (key, toks array<string>); lossless: concatenating toks gives the page back."""
    return pages.select(page_key(key), F.regexp_extract_all(F.col(html), F.lit(TOKEN_RE), 1).alias("toks"))


def html_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """N1 as rows: (page_id, pos, tok, kind, tag)."""
    t = tokenize(pages, key, html).select("page_id", F.posexplode("toks").alias("pos", "tok"))
    return t.withColumn("kind", F.expr(KIND_SQL)).withColumn(
        "tag", F.when(F.col("kind").isin("open", "void", "raw", "close"), F.lower(F.regexp_extract("tok", r"^</?([A-Za-z][^\s/>]*)", 1))))


def _attrs(tok: Column) -> Column:
    """Attribute list of an open tag, names lower-cased, values entity-decoded; duplicates resolved by attr()."""
    head = F.regexp_extract(tok, r"(?s)^<[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", 0)
    body = F.regexp_replace(F.regexp_replace(head, r"^<[A-Za-z][^\s/>]*", ""), r"/?>$", "")
    items = F.regexp_extract_all(body, F.lit(ATTR_RE), 0)

    def one(a):
        name = F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1))
        raw = F.regexp_replace(a, r"^[^\s=]+\s*(=\s*)?", "")
        val = (F.when(raw.startswith('"'), F.regexp_extract(raw, r'(?s)^"(.*)"$', 1))
               .when(raw.startswith("'"), F.regexp_extract(raw, r"(?s)^'(.*)'$", 1))
               .otherwise(raw))
        return F.struct(name.alias("k"), decode_entities(val).alias("v"))

    return F.transform(items, one)


def attr_map(attrs: Column) -> Column:
    """N2 map: duplicate attribute names resolved up front, the last value wins (no session dedup policy needed)."""
    rev = F.reverse(attrs)
    uniq = F.filter(rev, lambda a, i: ~F.exists(F.slice(rev, F.lit(1), i), lambda b: b["k"] == a["k"]))
    return F.when(F.size(attrs) > 0, F.map_from_entries(uniq))


def attr(name: str, amap: str = "amap") -> Column:
    """Value of one attribute, NULL when absent."""
    return F.col(amap)[F.lit(name)]


def _tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(page_id, toks, kinds, tags): kind and tag are computed once per token and carried to the rows."""
    toks = tokenize(pages, key, html)
    kinds = toks.select("page_id", "toks", F.expr(f"transform(toks, tok -> {KIND_SQL})").alias("kinds"))
    return kinds.select("page_id", "toks", "kinds", F.expr(
        f"transform(toks, (tok, i) -> case when kinds[i] in ('open', 'close', 'void', 'raw') then {TAG_SQL} end)").alias("tags"))


def _spread(pages: DataFrame) -> DataFrame:
    """Pages read from fewer files than there are cores are dealt evenly first: a file of few row groups would keep the work
    of all its pages in few tasks, and the work per byte is high."""
    n = page_partitions(pages.sparkSession)
    return pages.repartition(n, "page_id") if len(pages._jdf.inputFiles()) < n else pages


def _nested(pages: DataFrame, key: str, html: str, split: int) -> DataFrame:
    """(page_id, toks, kinds, tags, first, nest): a page in one row, or in several if it has more than ``split`` bytes."""
    pages = pages.select(page_key(key), F.col(html).alias("html"))
    size = F.octet_length("html")
    short = _tokens(_spread(pages.where(F.coalesce(size, F.lit(0)) <= split)), "page_id", "html")
    whole = short.select("page_id", "toks", "kinds", "tags", F.lit(0).alias("first"), nest_whole(events_of()).alias("nest"))
    long = pages.where(size > split)
    if long.isEmpty():  # one look at the lengths saves the rounds of the pieces' plan
        return whole
    return whole.unionByName(nest_long(_tokens(_spread(long), "page_id", "html")))


def _rows(nested: DataFrame) -> DataFrame:
    return nested.select("page_id", F.inline(F.transform("nest", lambda o, i: F.struct(
        (F.col("first") + i).alias("pos"), o["e"].alias("end"), o["d"].alias("depth"), o["par"].alias("parent"), o["box"].alias("box"),
        F.get("toks", i).alias("tok"), F.get("kinds", i).alias("kind"), F.get("tags", i).alias("tag")))))


def token_rows(pages: DataFrame, key: str = "page_id", html: str = "html", split: int = SPLIT) -> DataFrame:
    """(page_id, pos, end, depth, parent, box, tok, kind, tag), one row a token, where its page was read. Pages over
    ``split`` bytes are nested in pieces."""
    return _rows(_nested(pages, key, html, split))


def build_nodes(pages: DataFrame, opts, key: str = "page_id", html: str = "html", split: int = SPLIT) -> DataFrame:
    """Node table, hash-partitioned by page_id (see module doc)."""
    # Tokens and nesting are computed before the Exchange that moves the page rows by page_id. An explicit count: the explode
    # multiplies the per-page work several times over, so AQE must not merge these small-looking partitions by input size.
    rows = _rows(_nested(pages, key, html, split).repartition(page_partitions(pages.sparkSession), "page_id"))
    # most tags are bare: one look saves them the attribute patterns
    has_attrs = F.col("kind").isin("open", "void", "raw") & ~F.col("tok").rlike(BARE_RE)
    rows = rows.withColumn("amap", F.when(has_attrs, attr_map(_attrs(F.col("tok")))))
    raw_body = F.regexp_extract("tok", r"(?is)^<[a-z][^>]*+>(.*)</[a-z]+\s*>$", 1)
    text = (
        F.when(F.col("kind") == "text", decode_entities(F.col("tok")))
        .when((F.col("kind") == "raw") & F.col("tag").isin("title", "textarea"), decode_entities(raw_body))
    )
    # anything a string search sees (text, raw bodies incl. script/style, comments, declarations)
    any_text = (
        F.when(F.col("kind") == "comment", F.regexp_extract("tok", r"(?s)^<!--(.*)-->$", 1))
        .when(F.col("kind") == "decl", F.regexp_replace(F.regexp_extract("tok", r"(?s)^<[!?](.*)>$", 1), r"^(?i)DOCTYPE\s+", ""))
        .when(F.col("kind") == "raw", raw_body)
    )
    cls = F.regexp_replace(strip_ws(attr("class")), WS + "+", " ")
    rows = (
        rows.withColumn("text", text)
        .withColumn("any_text", F.coalesce(F.col("text"), any_text))
        .withColumn("cls", cls)
        .withColumn("role", attr("role"))
        .withColumn("piece", F.when(F.col("text").isNotNull(), strip_ws(F.col("text"))))
        .drop("tok")
    )
    return with_end_markers(rows)


NODE_COLS = ["page_id", "pos", "ord", "sub", "elem", "end", "depth", "parent", "box", "kind", "tag", "amap", "text", "any_text",
             "cls", "role", "piece"]


def with_end_markers(rows: DataFrame) -> DataFrame:
    """Every element gets a second row, its *end marker*, at ``pos = end - 1`` with ``ord = 1`` and ``sub = -pos``
    (inner elements first), so that in ``(pos, ord, sub)`` order it sits after the element's last row and before the
    next token. Windows can then read "the value at the element's end" without a self-join. Generated from the same
    row (explode), so the lineage is not duplicated."""
    is_el = F.col("kind").isin("open", "void", "raw")
    fields = ["pos", "end", "depth", "parent", "box", "kind", "tag", "amap", "text", "any_text", "cls", "role", "piece"]
    real = F.struct(
        F.col("pos"), F.lit(0).alias("ord"), F.lit(0).alias("sub"), F.when(is_el, F.col("pos")).alias("elem"),
        *[F.col(c) for c in fields if c != "pos"])
    mark = F.struct(
        (F.col("end") - 1).alias("pos"), F.lit(1).alias("ord"), (-F.col("pos")).alias("sub"), F.col("pos").alias("elem"),
        F.col("end"), F.col("depth"), F.col("parent"), F.col("box"), F.lit("end").alias("kind"), F.col("tag"), F.col("amap"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("any_text"), F.col("cls"), F.col("role"),
        F.lit(None).cast("string").alias("piece"))
    both = F.when(is_el, F.array(real, mark)).otherwise(F.array(real))
    return rows.select("page_id", F.inline(both))


def without_closes(nodes: DataFrame) -> DataFrame:
    """The node table without the rows of close tags, about a quarter of it: the nesting is settled, an element's end is its marker, and a
    close tag holds no text. The page plans sort and sweep the rest."""
    return nodes.where(F.col("kind") != "close")


def html_nodes(tokens: DataFrame) -> DataFrame:
    """N3/N4 as a result table from ``token_rows``: one row per element (open, void or raw)."""
    return tokens.where(F.col("kind").isin("open", "void", "raw")).select("page_id", "pos", "end", "depth", "parent", "tag")
