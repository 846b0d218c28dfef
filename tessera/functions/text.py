"""Column expressions over names, texts, citations, times and links. All are built-in functions, none a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and labels that results depend on.
GLOBAL_KEYWORDS = ["overview", "trend", "history", "compare", "evolution", "what are all", "which groups", "overall", "summary", "概述", "趨勢", "整體", "比較", "歷史", "哪些"]
STOPWORDS = "the a an is are was were what who how when where which that this of in to for with on at by from and or".split()
PLACEHOLDERS = ["string or null", "null", "none"]
PROTOCOLS = ["QUIC", "TCP", "UDP", "HTTP", "TLS"]
ENTITY_TYPES = ["PROTOCOL", "ORGANIZATION", "PERSON", "CONCEPT", "DOCUMENT", "WORKING_GROUP", "RFC", "OTHER"]
RELATION_TYPES = ["USES", "DEFINES", "EXTENDS", "REPLACES", "PART_OF", "DISCUSSES", "PROPOSED_BY", "IMPLEMENTED_BY", "RELATED_TO"]
UNDIRECTED_TYPES = ["RELATED_TO", "PART_OF"]
SOURCE_HEADER = r"\[SOURCE:\s*([^,]+),\s*START:\s*([\d.]+),\s*END:\s*([\d.]+)(?:,\s*ID:\s*([^\]]+))?\]"
ERROR_MESSAGES = [
    (r"(?i)rate.limit|429|tokens per day", "API usage limit reached. Please try again later."),
    (r"(?i)failed to fetch|networkerror|econnrefused", "Cannot connect to server. Please check if the backend is running."),
    (r"(?i)timeout|timed out", "Request timed out. Please try again."),
    (r"(?i)502|503|500", "Server error. Please try again later."),
]
NO_ERROR_TEXT, OTHER_ERROR = "An unknown error occurred. Please try again.", "Failed to generate a response. Please try again."


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c) -> Column:
    out = strip_ws(c)
    return F.when(out != "", out)


def md5_id(c, n: int) -> Column:
    return F.substring(F.md5(col(c)), 1, n)


# --- names ---------------------------------------------------------------------------------------------------------


def canonical_name(c) -> Column:
    """Lower case, hyphens and underscores as spaces, other punctuation but ``/`` and ``.`` gone, single spaces."""
    out = F.regexp_replace(strip_ws(F.lower(col(c))), "[-_]", " ")
    out = strip_ws(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s/.]", ""), r"(?U)\s+", " "))
    # most names are one plain word, in which there is nothing to replace
    return F.when(F.rlike(col(c), F.lit("^[A-Za-z0-9]+\\z")), F.lower(col(c))).otherwise(out)


def entity_type(c) -> Column:
    return F.coalesce(F.upper(blank_to_null(c)), F.lit("OTHER"))


def relation_type(c) -> Column:
    return F.coalesce(F.upper(blank_to_null(c)), F.lit("RELATED_TO"))


def is_directional(c) -> Column:
    return ~col(c).isin(UNDIRECTED_TYPES)


def entity_id(name, kind) -> Column:
    return md5_id(F.concat_ws("|", canonical_name(name), entity_type(kind)), 12)


def relation_id(source, kind, target) -> Column:
    return md5_id(F.concat_ws("|", canonical_name(source), relation_type(kind), canonical_name(target)), 12)


def fuzzy_contains(a, b) -> Column:
    return F.contains(col(a), col(b)) | F.contains(col(b), col(a))


# --- file and meeting names ----------------------------------------------------------------------------------------


def basename(c) -> Column:
    return F.regexp_replace(col(c), r"^.*[/\\]", "")


def stem(c) -> Column:
    """The file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]+$", "")


def _word_or(c, pattern: str) -> Column:
    return F.regexp_replace(col(c), pattern, "_")


def safe_filename(video, record) -> Column:
    return F.concat(_word_or(stem(video), r"(?U)[^\w\-]"), F.lit("_"), _word_or(col(record).cast("string"), r"(?U)[^\w\-]"), F.lit(".txt"))


def safe_stem(c) -> Column:
    out = F.regexp_replace(_word_or(c, r"(?U)[^\w\-]+"), "^_+|_+$", "")
    return F.when(out == "", "meeting").otherwise(out)


def safe_meeting_name(c) -> Column:
    out = F.substring(_word_or(strip_ws(F.regexp_replace(col(c), r"(?U)\s+", " ")), r'[<>:"/\\|?*\x00-\x1f]'), 1, 120)
    return F.when(out == "", "YouTube Meeting").otherwise(out)


def zero_filled(c, n: int = 3) -> Column:
    """Zeros in front up to n characters; longer values stay whole."""
    return F.when(F.length(col(c)) < n, F.lpad(col(c), n, "0")).otherwise(col(c))


# --- times and links -----------------------------------------------------------------------------------------------


def hhmmss(seconds) -> Column:
    s = F.floor(col(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def minutes_seconds(seconds) -> Column:
    s = F.floor(col(seconds)).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)


def youtube_id(url) -> Column:
    """The video id of an https YouTube link in one of its three forms, else null."""
    scheme, host, path = (F.try_parse_url(col(url), F.lit(x)) for x in ("PROTOCOL", "HOST", "PATH"))
    long = (host == "youtube.com") | host.endswith(".youtube.com")
    live = F.regexp_extract(path, "^/live/+([^/]+)", 1)
    short = F.regexp_replace(path, "^/+|/+$", "")
    found = F.when(host == "youtu.be", short).when(long & path.startswith("/live/"), live).when(long, F.try_parse_url(col(url), F.lit("QUERY"), F.lit("v")))
    return F.when((scheme == "https") & (found != ""), found)


def same_video(a, b) -> Column:
    return F.coalesce(youtube_id(a) == youtube_id(b), F.lit(False))


def url_at(url, seconds) -> Column:
    """The link with its time parameter set to whole seconds."""
    plain = F.regexp_replace(F.regexp_replace(col(url), r"([?&])t=[^&#]*&?", "$1"), r"[?&]$", "")
    mark = F.when(F.contains(plain, F.lit("?")), "&").otherwise("?")
    return F.concat(plain, mark, F.lit("t="), F.floor(col(seconds)).cast("long").cast("string"), F.lit("s"))


# --- words and sets ------------------------------------------------------------------------------------------------


def word_set(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(r"(?U)\b\w+\b"), 0))


def space_set(c) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(col(c)), r"(?U)\s+")), lambda x: x != "")


def content_words(c) -> Column:
    return F.array_except(word_set(c), F.array(*map(F.lit, STOPWORDS)))


def jaccard(a, b) -> Column:
    """Of two sets; 0 if either is empty."""
    a, b = col(a), col(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def mentions(c, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(c), F.lit(pattern), 0)))


def rfc_mentions(c) -> Column:
    return mentions(c, r"(?i)RFC\s?\d+")


def protocol_mentions(c) -> Column:
    return mentions(c, r"(?i)\b(?:" + "|".join(PROTOCOLS) + r")\b")


def approx_tokens(c) -> Column:
    return F.floor(F.length(col(c)) / 4).cast("long")


def tail_tokens(c, n: int) -> Column:
    return F.substring(col(c), -4 * n, 4 * n) if n > 0 else F.lit("")


def cut(c, n: int, mark: str = "") -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit(mark))).otherwise(col(c)) if mark else F.substring(col(c), 1, n)


def sentences(c) -> Column:
    return F.split(col(c), r"(?U)(?<=[.!?])\s+")


# --- headers, placeholders, queries --------------------------------------------------------------------------------


def source_header(c) -> Column:
    """Video, start, end and id told by a text's first line; null without a header there."""
    line = F.split(col(c), "\n")[0]
    part = lambda i: F.regexp_extract(line, SOURCE_HEADER, i)
    whole = F.struct(strip_ws(part(1)).alias("video"), part(2).try_cast("double").alias("start"), part(3).try_cast("double").alias("end"), strip_ws(part(4)).alias("id"))
    return F.when(line.rlike(SOURCE_HEADER), whole)


def without_headers(c) -> Column:
    kept = F.filter(F.split(col(c), "\n"), lambda x: ~strip_ws(x).rlike("^" + SOURCE_HEADER))
    return strip_ws(F.array_join(kept, "\n"))


def without_meeting_prefix(c) -> Column:
    return F.regexp_replace(col(c), r"^\[Meeting:[^\]]*\]\s*", "")


def clean_placeholder(c) -> Column:
    out = strip_ws(F.coalesce(col(c), F.lit("")))
    return F.when(F.lower(out).isin(PLACEHOLDERS), "").otherwise(out)


def effective_query(query, meetings) -> Column:
    """The query led by the meetings it is limited to, where it is."""
    return F.when(F.size(col(meetings)) > 0, F.concat(F.lit("[Meeting context: "), F.array_join(col(meetings), ", "), F.lit("] "), col(query))).otherwise(col(query))


def classify_query(c) -> Column:
    """``global`` if any keyword of breadth occurs, else ``local``."""
    text = F.lower(col(c))
    found = F.exists(F.array(*map(F.lit, GLOBAL_KEYWORDS)), lambda k: F.contains(text, k))
    return F.when(found, "global").otherwise("local")


def query_type(c) -> Column:
    return F.when(col(c).isin("local", "global"), col(c)).otherwise("local")


def string_list(c) -> Column:
    """A JSON list of strings, empty if it isn't one."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def repaired_json(c, schema: str) -> Column:
    """A model's JSON reply: as it is, without its fence, or the outermost braces in it."""
    text = F.translate(F.regexp_replace(strip_ws(c), "^﻿", ""), "“”‘’", "\"\"''")
    bare = strip_ws(F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    tried = [F.from_json(F.when(F.try_parse_json(x).isNotNull(), x), schema) for x in (text, bare, inner)]
    return F.coalesce(*tried)


# --- citations -----------------------------------------------------------------------------------------------------


def normal_citations(c) -> Column:
    out = F.regexp_replace(col(c), "：", ":")
    for open_, close in (("【", "】"), (r"\(", r"\)"), ("<", ">")):
        out = F.regexp_replace(out, rf"{open_}REF:([^{close}]+){close}", "[REF:$1]")
    return out


def citation_marks(c) -> Column:
    """All cited ids in order, repeats included."""
    return F.transform(F.regexp_extract_all(normal_citations(c), F.lit(r"\[REF:([^\]]+)\]"), 1), strip_ws)


def citations(c) -> Column:
    return F.array_distinct(citation_marks(c))


def plain_answer(c) -> Column:
    return strip_ws(F.regexp_replace(col(c), r"\[REF:[^\]]+\]", ""))


def cited_sentences(c) -> Column:
    """(sentence, ids) for each sentence and the citations right after it."""
    found = F.regexp_extract_all(col(c), F.lit(r"[^.!?\[\]]*[.!?]?\s*(?:\[REF:[^\]]+\]\s*)*"), 0)
    pairs = F.transform(found, lambda x: F.struct(plain_answer(x).alias("sentence"), F.regexp_extract_all(x, F.lit(r"\[REF:([^\]]+)\]"), 1).alias("ids")))
    return F.filter(pairs, lambda p: (p.sentence != "") | (F.size(p.ids) > 0))


# --- judged replies, messages, display -----------------------------------------------------------------------------


def judged_yes_no(c, partial: float = 0.5) -> Column:
    up = F.upper(strip_ws(c))
    return F.when(up.startswith("YES"), 1.0).when(up.startswith("PARTIAL"), partial).when(up.startswith("NO"), 0.0).when(F.contains(up, F.lit("YES")), 1.0).when(F.contains(up, F.lit("NO")), 0.0).otherwise(partial)


def judged_score(c) -> Column:
    raw = F.regexp_extract(col(c), r"\b(\d+(?:\.\d+)?)\b", 1).try_cast("double")
    return F.when(raw.isNull(), 0.5).when(raw > 1, F.least(raw / 10, F.lit(1.0))).otherwise(raw)


def clamped(c, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def claims(c) -> Column:
    """Claims listed with dashes; without any, the sentences."""
    lines = F.transform(F.split(col(c), "\n"), strip_ws)
    listed = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("-")), lambda x: strip_ws(F.regexp_replace(x, "^-+", ""))), lambda x: x != "")
    plain = F.filter(F.transform(F.split(col(c), "[.!?]"), strip_ws), lambda x: x != "")
    return F.when(F.size(listed) > 0, listed).otherwise(plain)


def friendly_error(c) -> Column:
    out = F.when(F.coalesce(col(c), F.lit("")) == "", NO_ERROR_TEXT)
    for pattern, message in ERROR_MESSAGES:
        out = out.when(col(c).rlike(pattern), message)
    return out.otherwise(OTHER_ERROR)


def html_escaped(c) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def node_radius(degree) -> Column:
    return 6 + F.sqrt(col(degree)) * 2.5


def edge_width(weight) -> Column:
    return F.sqrt(col(weight)) * 1.2
