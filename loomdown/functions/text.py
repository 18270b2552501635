"""Column -> Column helpers: whitespace, entities, titles, file names, tags, word counts, front matter.

Everything here is a built-in Spark SQL expression (no Python UDF), so it stays inside whole-stage code generation
where Spark supports it and never leaves the JVM.
"""

from __future__ import annotations

import html.entities
import json
import zlib
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdown.functions import constants as K

# Whitespace as Python's str.strip()/split() understand it, written so both Java regex and RE2 accept it.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _ws(pattern: str) -> str:
    """A pattern with ``\\s`` and ``\\S`` meaning Unicode white space."""
    return pattern.replace(r"\s", WS).replace(r"\S", "[^" + WS[1:])


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it (the plan holds one copy of it)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def java_quote(s: str) -> str:
    """Quote a literal for a Java regex (the names contain only letters, digits, space and '-')."""
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r".^$*+?()[]{}|\-" else ch)
    return "".join(out)


# the characters of WS
WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\n\r\f]+", " ")


_REFERENCE = r"(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&)"


@lru_cache(maxsize=None)
def _bucket_json(table: tuple[tuple[str, str], ...]) -> str:
    buckets: list[dict[str, str]] = [{} for _ in range(2 * len(table))]
    for k, v in table:
        buckets[zlib.crc32(k.encode()) % len(buckets)][k] = v
    return json.dumps(buckets)


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The key's value in a constant table, NULL when absent. A map literal is searched from its start, so the table lies in
    buckets by the key's hash: a look-up reads one bucket of few entries, however long the table. Folded once when the plan is optimised."""
    buckets = F.from_json(F.lit(_bucket_json(tuple(table.items()))), "array<map<string,string>>")
    return F.get(buckets, (F.crc32(F.encode(key, "UTF-8")) % (2 * len(table))).cast("int"))[key]


def decode_entities(c: Column) -> Column:
    """Every character reference once, in one pass over the pieces: numeric (any number of digits; 128-159 as
    Windows-1252, invalid code points as U+FFFD) and named by the HTML table (without ';' where HTML allows that)."""
    named = {"&" + k: v for k, v in html.entities.html5.items()}
    remap = {str(k): bytes([k]).decode("cp1252") for k in range(128, 160) if k not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

    def piece(p):
        is_hex = p.rlike("^&#[xX]")
        digits = F.regexp_extract(p, r"^&#[xX]?0*([0-9a-fA-F]*);?$", 1)
        short = F.when(F.length(digits).between(1, 8), digits)
        cp = F.when(is_hex, F.conv(short, 16, 10)).otherwise(short).try_cast("long")
        valid = cp.between(1, 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
        char = F.when(valid, F.coalesce(_lookup(remap, cp.cast("string")), F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))).otherwise("\ufffd")
        return F.when(p.startswith("&#") & (F.length(p) > 2), char).when(p.startswith("&") & (F.length(p) > 1), F.coalesce(_lookup(named, p), p)).otherwise(p)

    return F.when(c.contains("&"), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), 1), piece), "")).otherwise(c)


# ---------------------------------------------------------------- titles
def clean_title(c: Column) -> Column:
    """Strip, drop 'Conversation with', platform suffix/prefix, one sidebar suffix, separators; NULL if a
    platform name, a UI label or empty."""
    x = strip_ws(c)
    x = F.regexp_replace(x, _ws(r"(?i)^conversation\s+with\s+"), "")
    for name in K.PLATFORM_NAMES:
        q = java_quote(name)
        x = F.regexp_replace(x, _ws(rf"(?i)\s*[-–—|:]\s*{q}\s*$"), "")
        x = F.regexp_replace(x, _ws(rf"(?i)^{q}\s*[-–—|:]\s*"), "")
    x = F.regexp_replace(x, _ws("(?i)" + K.SIDEBAR_SUFFIX_RE), "")
    x = F.btrim(x, F.lit(K.TITLE_SEPARATORS))
    def accepted(v: Column) -> Column:
        low = F.lower(v)
        bad = low.isin([n.lower() for n in K.PLATFORM_NAMES]) | low.isin(K.UI_LABELS) | (v == "")
        return F.when(bad, F.lit(None).cast("string")).otherwise(v)

    return let(x, accepted)


def user_turn_title(c: Column) -> Column:
    """T5 text rule: first piece before . ? ! or newline, stripped; > 120 chars -> 117 cut back to a space + '…';
    NULL when empty or a platform name."""
    t = strip_ws(F.element_at(F.split(c, r"[.?!\n]"), 1))
    cut = F.concat(F.regexp_replace(F.substr(t, F.lit(1), F.lit(117)), r" [^ ]*\z", ""), F.lit("…"))
    t = F.when(F.length(t) > K.USER_TITLE_MAX, cut).otherwise(t)
    bad = (t == "") | F.lower(t).isin([n.lower() for n in K.PLATFORM_NAMES])
    return F.when(bad, F.lit(None).cast("string")).otherwise(t)


def title_case(c: Column) -> Column:
    """First word and non-small words capitalised (rest lower), small words lower. A leading 'ß' becomes 'Ss'."""
    words = F.split(strip_ws(c), WS + "+")
    small = lit_array(K.SMALL_WORDS)

    def cap(w):
        first = F.substr(w, F.lit(1), F.lit(1))
        head = F.when(first == "ß", F.lit("Ss")).otherwise(F.upper(first))
        return F.concat(head, F.lower(F.substr(w, F.lit(2))))

    out = F.transform(words, lambda w, i: F.when((i == 0) | ~F.array_contains(small, F.lower(w)), cap(w)).otherwise(F.lower(w)))
    return F.array_join(out, " ")


def heuristic_title(c: Column, max_length: int = 50) -> Column:
    """Fillers (longest first, each tested once), trailing punctuation, cut at a word, title case."""
    text = strip_ws(c)
    starts = sorted(K.FILLER_STARTS, key=len, reverse=True)
    ends = sorted(K.FILLER_ENDS, key=len, reverse=True)
    text = F.aggregate(
        lit_array(starts), text,
        lambda acc, f: F.when(F.lower(acc).startswith(f), F.substr(acc, F.length(f) + 1)).otherwise(acc),
    )
    text = F.aggregate(
        lit_array(ends), text,
        lambda acc, f: F.when(F.lower(acc).endswith(f), F.substr(acc, F.lit(1), F.length(acc) - F.length(f))).otherwise(acc),
    )
    text = F.btrim(text, F.lit(" ?.!,;:"))
    cut = F.regexp_replace(F.regexp_replace(F.substr(text, F.lit(1), F.lit(max_length)), r" [^ ]*\z", ""), r"[ ,.;:\-]+\z", "")
    text = F.when(F.length(text) > max_length, cut).otherwise(text)
    text = title_case(text)
    return F.when(text == "", F.substr(c, F.lit(1), F.lit(max_length))).otherwise(text)


def smart_title(c: Column, opts) -> Column:
    """Heuristic title when smart titles are on, else the text unchanged."""
    return heuristic_title(c, opts.max_filename_length) if opts.smart_titles else c


def file_name(c: Column, max_len: int = 50) -> Column:
    """Delete < > : " / \\ | ? *, spaces to '_', strip '_', cut, add '.md'."""
    x = F.regexp_replace(c, r"[<>:\"/\\|?*]", "")
    x = F.btrim(F.replace(x, F.lit(" "), F.lit("_")), F.lit("_"))
    return F.concat(F.substr(x, F.lit(1), F.lit(max_len)), F.lit(".md"))


def merge_target_name(c: Column) -> Column:
    """Add '.md' unless present."""
    return F.when(c.endswith(".md"), c).otherwise(F.concat(c, F.lit(".md")))


# ---------------------------------------------------------------- languages and tags
def syntax_language(code: Column) -> Column:
    """L3: ordered syntax rules on a code block's text; '' when nothing fits."""
    has = code.contains
    return (
        F.when(has("#include") | has("std::"), "cpp")
        .when(has("cout") & has("<<"), "cpp")
        .when(code.rlike(r"(?s)\b(int|void|double|float|bool|char)\s+\w+\s*\(.*?\)\s*\{"), "cpp")
        .when(has("def ") & has(":"), "python")
        .when(has("import ") & has("from "), "python")
        .when(has("fn ") & has("let ") & has("->"), "rust")
        .when(has("func ") & has("fmt."), "go")
        .when(has("interface ") & has(":") & has("export "), "typescript")
        .when(has("console.log") | has("document."), "javascript")
        .when(code.rlike(r"(?is)\bSELECT\b.*\bFROM\b"), "sql")
        .when(code.rlike(r"(?i)</?[a-z]+[^>]*>"), "html")
        .otherwise("")
    )


def label_language(text: Column) -> Column:
    """L2 for one block: lower-cased text (last 60 chars when > 120); first label that is a substring wins;
    'java' is skipped when the text also contains 'script'."""
    labels = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("lang")) for a, b in K.LABEL_LANGS])

    def first(t):
        hits = F.filter(labels, lambda l: t.contains(l["label"]) & ~((l["label"] == "java") & t.contains("script")))
        return F.try_element_at(hits, F.lit(1))["lang"]

    # the cut text is made once, not once a label
    return let(F.lower(text), lambda t: let(F.when(F.length(t) > 120, F.substr(t, F.length(t) - 59)).otherwise(t), first))


def auto_tags(md: Column) -> Column:
    """{'ai-chat'} + fence markers (substrings) + syntax hints, sorted and unique."""
    low = F.lower(md)
    fences = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(l).alias("l")) for m, l in K.FENCE_LANGS])
    fence_tags = F.transform(F.filter(fences, lambda f: low.contains(f["m"])), lambda f: f["l"])
    hints = F.array_compact(F.array(
        F.when(low.contains("def ") & low.contains(":"), F.lit("python")),
        F.when(low.contains("#include") | low.contains("std::"), F.lit("cpp")),
        F.when(low.contains("console.log"), F.lit("javascript")),
        F.when(low.contains("fmt.println") | low.contains("func "), F.lit("go")),
        F.when(low.contains("fn ") & low.contains("let mut"), F.lit("rust")),
        F.when(low.contains("public static void main"), F.lit("java")),
    ))
    return F.sort_array(F.array_distinct(F.concat(F.array(F.lit("ai-chat")), fence_tags, hints)))


def word_count(md: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(md, WS + "+"), lambda w: w != "")).cast("long")


# ---------------------------------------------------------------- Markdown post-processing and notes
def strip_brand_headings(md: Column) -> Column:
    """Remove heading lines that are only a platform name (case-sensitive)."""
    for name in K.PLATFORM_NAMES:
        md = F.regexp_replace(md, _ws(rf"(?md)^#+\s*{java_quote(name)}\s*$"), "")
    return md


def strip_conversation_with(md: Column) -> Column:
    """Remove 'Conversation with X' heading lines and plain lines (ignoring case)."""
    md = F.regexp_replace(md, _ws(r"(?imd)^#+\s*Conversation\s+with\s+\S+.*$"), "")
    return F.regexp_replace(md, _ws(r"(?imd)^Conversation\s+with\s+\S+.*$"), "")


def squeeze_blank(md: Column) -> Column:
    """Four or more newlines become three."""
    return F.regexp_replace(md, r"\n{4,}", "\n\n\n")


def lstrip_newlines(md: Column) -> Column:
    """R6."""
    return F.regexp_replace(md, r"^\n+", "")


_DATE_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%B": "MMMM",
               "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%j": "DDD", "%%": "%"}


def spark_date_pattern(fmt: str) -> str:
    """Map a strftime format to a Spark datetime pattern; unmapped codes are rejected."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            code = fmt[i:i + 2]
            if code not in _DATE_CODES:
                raise ValueError(f"unsupported date code {code!r}")
            out.append(_DATE_CODES[code])
            i += 2
        else:
            ch = fmt[i]
            out.append(f"'{ch}'" if ch.isalpha() else ("''" if ch == "'" else ch))
            i += 1
    return "".join(out)


def front_matter(title: Column, tags: Column, opts) -> Column:
    """YAML front matter; the run date is a literal option, source is always 'Local File'."""
    date = F.date_format(F.to_date(F.lit(opts.run_date)), spark_date_pattern(opts.date_format))
    return F.concat(
        F.lit('---\ntitle: "'), title, F.lit('"\ndate: '), date, F.lit("\ntags: ["), F.array_join(tags, ", "),
        F.lit(']\nsource: "Local File"\n---\n\n'),
    )


def note_text(title: Column, body: Column, tags: Column, opts) -> Column:
    """S4 file content: front matter (optional) + '# title' + body."""
    head = F.concat(F.lit("# "), title, F.lit("\n\n"), body)
    return F.concat(front_matter(title, tags, opts), head) if opts.include_metadata else head
