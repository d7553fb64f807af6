"""Text expressions: normalising, hashing, cutting, keywords, slugs, links."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Search operators of note apps whose ``name:value`` words are stripped. Fixed values.
QUERY_OPERATORS = ("any", "title", "body", "tag", "notebook", "created", "updated", "due", "type", "iscompleted", "latitude", "longitude", "altitude", "resource", "sourceurl", "id")
#: Characters of scripts without blanks, and marks that are dense in code. Fixed values.
CJK = r"[\u4E00-\u9FFF\u3040-\u309F\u30A0-\u30FF]"
MARKS = r"""[.,:;!?(){}\[\]"'`]"""
SENTENCE = r"[^.!?\n]+[.!?\n]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_newlines(t: Column | str) -> Column:
    return F.regexp_replace(_col(t), r"\r\n?", "\n")


def content_hash(t: Column | str) -> Column:
    """MD5 of the text as it is, before its newlines are normalised."""
    return F.md5(_col(t).cast("binary"))


def strip_generated(t: Column | str, markers: list[tuple[str, str]]) -> Column:
    """Drops generated blocks: from each opening marker to the nearest closing one."""
    t = _col(t)
    for start, end in markers:
        t = F.regexp_replace(t, f"(?s){re.escape(start)}.*?{re.escape(end)}", "")
    return t


def strip_html(t: Column | str) -> Column:
    """Scripts and styles go, other tags become blanks, white space is collapsed."""
    t = F.regexp_replace(_col(t), r"(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"[ \t\n\r\f]+", " "))


def token_estimate(t: Column | str) -> Column:
    """ceil(characters / characters per token), by the kind of text."""
    t = _col(t)
    n = F.length(t)
    marks = n - F.length(F.regexp_replace(t, MARKS, ""))
    per = F.when(t.rlike(CJK), 2.5).when(t.rlike(r"[^\x00-\x7f]"), 3.2).when(marks / n > 0.1, 3.5).otherwise(4.0)
    return F.when(n == 0, F.lit(0)).otherwise(F.ceil(n / per)).cast("int")


def sentences(t: Column | str) -> Column:
    """Runs up to a full stop, exclamation or question mark or line end."""
    return F.regexp_extract_all(F.concat(_col(t), F.lit("\n")), F.lit(SENTENCE), F.lit(0))


def truncate_tokens(t: Column | str, most: int, suffix: str = " [truncated]", suffix_tokens: int = 4) -> Column:
    """Cuts a text whose estimate is over ``most`` and marks the cut."""
    t = _col(t)
    tokens = token_estimate(t)
    keep = F.floor(F.lit(float(most - suffix_tokens)) * F.length(t) / tokens * 0.95).cast("int")
    return F.when(tokens <= most, t).otherwise(F.concat(F.substring(t, F.lit(1), F.greatest(keep, F.lit(0))), F.lit(suffix)))


def line_number(body: Column | str, part: Column | str) -> Column:
    """1-based line of the first place of ``part``; 0 where it doesn't occur."""
    body, part = _col(body), _col(part)
    at = F.locate_in(body, part) if hasattr(F, "locate_in") else F.instr(body, part)
    before = F.substring(body, F.lit(1), at - 1)
    return F.when(at == 0, F.lit(0)).otherwise(F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def slug(t: Column | str) -> Column:
    t = F.regexp_replace(F.lower(_col(t)), r"[ \t\n\r\f]+", "-")
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9-]", ""), r"-+", "-")
    return F.regexp_replace(F.regexp_replace(t, r"^-", ""), r"-$", "")


def strip_query_operators(q: Column | str, operators: tuple[str, ...] = QUERY_OPERATORS) -> Column:
    return F.trim(F.regexp_replace(_col(q), rf"(?<![A-Za-z0-9_])(?:{'|'.join(operators)}):\S+", ""))


def _term_pattern(term: str) -> str:
    """A word, a prefix (``word*``) or a quoted phrase as a pattern; word edges are ASCII."""
    edge_l, edge_r = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    if term.startswith('"'):
        return edge_l + re.escape(term.strip('"')) + edge_r
    if term.endswith("*"):
        return edge_l + re.escape(term[:-1])
    return edge_l + re.escape(term) + edge_r


def matches_keywords(t: Column | str, query: str) -> Column:
    """All words, prefixes and quoted phrases of a query occur, in either case."""
    found, query = F.lit(True), re.sub(rf"\b(?:{'|'.join(QUERY_OPERATORS)}):\S+", "", query, flags=re.A)
    for term in re.findall(r'"[^"]+"|\S+', query):
        found &= _col(t).rlike("(?is)" + _term_pattern(term))
    return found


def decoration(title: Column, path: Column, heading: Column, tags: Column, *, embed_title: bool = True, embed_path: bool = True, embed_heading: bool = True, embed_tags: bool = True) -> Column:
    """``title/path/heading:`` and a line of tags, as far as each is wanted and not empty."""
    parts = [F.array(title)] if embed_title else []
    parts += [path] if embed_path else []
    parts += [F.array(heading)] if embed_heading else []
    if parts:
        head = F.array_join(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "")), "/")
        head = F.when(head != "", F.concat(head, F.lit(":\n"))).otherwise(F.lit(""))
    else:
        head = F.lit("")
    line = F.when(F.size(tags) > 0, F.concat(F.lit("tags: "), F.array_join(tags, ", "), F.lit("\n"))).otherwise(F.lit("")) if embed_tags else F.lit("")
    return F.concat(head, line)


def internal_links(t: Column | str, skip: tuple[str, ...] = ()) -> Column:
    """Different ids of notes linked as ``[text](:/<32 letters and digits>...)``, in order.

    Lines that begin with one of ``skip`` or with a numbered reference (``[1]:``) don't count."""
    led = "|".join([*map(re.escape, skip), r"\[\d+\]:"])
    kept = F.regexp_replace(_col(t), rf"(?m)^(?:{led})[^\n]*$", "")
    return F.array_distinct(F.regexp_extract_all(kept, F.lit(r"\[[^\]]+\]\(:/([A-Za-z0-9]{32})[^)]*\)"), F.lit(1)))


def reference_link(number: Column, note_id: Column, level: Column, title: Column) -> Column:
    """``[i]: :/id#slug``; the slug only below a heading."""
    anchor = F.when(level > 0, F.concat(F.lit("#"), slug(title))).otherwise(F.lit(""))
    return F.concat(F.lit("["), number.cast("string"), F.lit("]: :/"), note_id.cast("string"), anchor)


def middle_truncate(t: Column | str, most: int = 200) -> Column:
    """Start and end of a text that is too long, four dots between them."""
    t, half = _col(t), (most - 4) // 2
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(half)), F.lit("...."), F.right(t, F.lit(half))))


def search_term(t: Column | str, most: int = 300) -> Column:
    """Collapsed white space, cut to whole words of at most ``most`` characters in all."""
    words = F.split(F.trim(F.regexp_replace(_col(t), r"\s+", " ")), " ")
    joined = F.aggregate(words, F.lit(""), lambda s, w: F.when(s.endswith("\0"), s).when(F.length(s) + F.length(w) + F.when(s == "", 0).otherwise(1) > most, F.concat(s, F.lit("\0"))).when(s == "", w).otherwise(F.concat(s, F.lit(" "), w)))
    return F.regexp_replace(joined, "\0$", "")


def plain_citations(t: Column | str, word: str = "note") -> Column:
    """``[note 1]`` becomes ``[1]``."""
    return F.regexp_replace(_col(t), rf"(?i)\[{re.escape(word)}\s*(\d+)\]", "[$1]")


def title_prefix(t: Column | str) -> Column:
    """Digits, hyphens, dots and slashes that lead a title."""
    return F.regexp_extract(_col(t), r"^[\d\-/.]+", 0)


def upsert_block(body: Column | str, block: Column | str, start: str, end: str, append: bool = True) -> Column:
    """Replaces what stands between two markers, or adds the marked block."""
    body, marked = _col(body), F.concat(F.lit(start + "\n"), _col(block), F.lit("\n" + end))
    pattern = f"(?s){re.escape(start)}.*?{re.escape(end)}"
    added = F.concat(body, F.lit("\n"), marked) if append else F.concat(marked, F.lit("\n"), body)
    return F.when(body.rlike(pattern), F.concat(F.regexp_extract(body, f"(?s)^(.*?){pattern}", 1), marked, F.regexp_extract(body, f"{pattern}(.*)$", 1))).otherwise(added)


def escape_html(t: Column | str) -> Column:
    t = _col(t)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(raw), F.lit(safe))
    return t


def clean_inline(t: Column | str) -> Column:
    """Named and numeric ASCII entities decoded, tags dropped, white space collapsed."""
    t = F.regexp_replace(_col(t), r"<[^>]+>", "")
    codes = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(\d{1,3}|[xX][0-9a-fA-F]{1,2});"), F.lit(1)))
    code = lambda x: F.when(F.lower(F.left(x, F.lit(1))) == "x", F.conv(F.substr(x, F.lit(2)), 16, 10)).otherwise(x).cast("int")
    ascii_ = F.filter(codes, lambda x: (code(x) >= 32) & (code(x) < 127) & (code(x) != 38))  # an ampersand comes last, as below
    t = F.aggregate(ascii_, t, lambda s, x: F.replace(s, F.concat(F.lit("&#"), x, F.lit(";")), F.char(code(x))))
    t = F.regexp_replace(t, r"&#(?:38|[xX]26);", "&amp;")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def replace_last(t: Column | str, old: str, new: str) -> Column:
    """The text with the last occurrence of a string replaced."""
    t = _col(t)
    tail = F.substring_index(t, old, -1)
    return F.when(t.contains(old), F.concat(F.left(t, F.length(t) - F.length(tail) - len(old)), F.lit(new), tail)).otherwise(t)


def format_bytes(n: Column | str) -> Column:
    """About how many KB or MB; one decimal under 10."""
    n = _col(n).cast("double")
    kb, mb = n / 1024, n / (1 << 20)
    shown = lambda x, unit: F.when(x >= 10, F.format_string(f"≈%.0f {unit}", x)).otherwise(F.format_string(f"≈%.1f {unit}", x))
    return F.when(n.isNull() | F.isnan(n) | (n <= 0) | (n == float("inf")), "≈0 KB").when(mb >= 1, shown(mb, "MB")).otherwise(shown(kb, "KB"))


def model_name(t: Column | str) -> Column:
    """A model id without a date and a release word at its end."""
    t = F.regexp_replace(F.regexp_replace(_col(t), r"-\d{4}.*$", ""), r"-\d{2}-\d{2}.*$", "")
    for word in ("latest", "preview", "exp"):
        t = F.regexp_replace(t, f"-{word}$", "")
    return t


def prompt(*parts: Column) -> Column:
    """The parts that aren't blank, on lines of their own."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n\n")
