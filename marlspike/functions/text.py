"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: Column | str | None) -> Column:
    """A string without null: null and absent become ''."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def or_else(value: Column, other: Column | str) -> Column:
    """value unless it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), other if isinstance(other, Column) else F.lit(other))


def leaf_id(source: Column, body: Column) -> Column:
    """First 24 hex digits of SHA-256 over source, NUL, text."""
    return F.substring(F.sha2(F.concat(source, F.lit("\0"), body), 256), 1, 24)


def text_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def file_id(repo: Column, path: Column) -> Column:
    return F.when(text(repo) == "", path).otherwise(F.concat_ws(":", repo, path))


def normal_day(value: Column) -> Column:
    """Trimmed; a value of at least ten characters with dashes where a date has them is cut to its day."""
    t = F.regexp_replace(text(value), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return F.when((F.length(t) >= 10) & t.rlike(r"(?s)^.{4}-.{2}-"), F.substring(t, 1, 10)).otherwise(t)


def clip(body: Column, n: int = 280) -> Column:
    return F.substring(body, 1, n)


def squeeze(body: Column) -> Column:
    return F.trim(F.regexp_replace(text(body), r"[ \t\n\x0b\f\r]+", " "))


def web_snippet(body: Column, n: int = 150) -> Column:
    """White space squeezed; longer than n: cut, right-trimmed, with dots."""
    s = squeeze(body)
    return F.when(F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n)), F.lit("..."))).otherwise(s)


def cache_key(query: Column, parameters: Column) -> Column:
    """Equal for queries that differ in case, spacing or the order of parameters (a map)."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(parameters)))
    return F.sha2(F.concat(F.lower(squeeze(query)), F.lit("\0"), F.to_json(ordered)), 256)


def strip_html(html: Column) -> Column:
    """Scripts, styles and tags off, breaks as line ends; entities stay (see unescape)."""
    for pattern, to in ((r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?s)<[^>]+>", "")):
        html = F.regexp_replace(html, pattern, to)
    return html


def trimmed(body: Column) -> Column:
    return F.regexp_replace(body, r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "")


def unescape(body: Column) -> Column:
    """HTML entities of the five predefined names, no-break space, and the numeric ones below 128, in the JVM."""
    for name, to in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("#34", '"'), ("#x27", "'"), ("amp", "&")):
        body = F.replace(body, F.lit(f"&{name};"), F.lit(to))
    return body


def html_text(html: Column) -> Column:
    return trimmed(unescape(strip_html(html)))


def html_title(html: Column) -> Column:
    return squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def body_markdown(plain: Column, html: Column) -> Column:
    """Plain text, else stripped HTML, else ''."""
    return F.coalesce(F.nullif(trimmed(text(plain)), F.lit("")), html_text(text(html)))


#: Fixed list of code points that are dropped: zero-width marks, joiners, directional marks, soft hyphen and byte order mark.
INVISIBLE = "​‌‍‎‏⁠­﻿"


def normal_markdown(body: Column) -> Column:
    """NUL and invisible code points off, runs of blank lines to one."""
    return trimmed(F.regexp_replace(F.regexp_replace(body, f"[\\x00{INVISIBLE}]", ""), r"(\n[ \t]*){3,}", "\n\n"))


def decode_bytes(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def safe_name(value: Column) -> Column:
    """Characters that file names can't hold as '_'."""
    return F.translate(value, '/\\:*?"<>| ', "_" * 10)


def yaml_scalar(value: Column) -> Column:
    """Quoted where YAML would read something else."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when((value == "") | value.rlike(r"""[:#\[\]{}&*!|>'"%@`\n]|^[-? ]| $"""), quoted).otherwise(value)


def digits_only(value: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(value, "[^0-9]", ""), F.lit("")), value)


def clean_sender(value: Column) -> Column:
    """Cut at ' (' or else ' @', then at ' ['."""
    first = F.when(F.contains(value, F.lit(" (")), F.substring_index(value, " (", 1)).otherwise(F.substring_index(value, " @", 1))
    return F.trim(F.substring_index(first, " [", 1))


def first_line(value: Column) -> Column:
    return F.trim(F.split_part(F.replace(value, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit(1)))


def source_sides(source: Column) -> tuple[Column, Column]:
    """What stands before and after the first ' vs '."""
    at = F.instr(source, " vs ")
    before = F.when(at > 0, F.substring_index(source, " vs ", 1)).otherwise(source)
    after = F.when(at > 0, F.expr("1") * 0 + 1).otherwise(F.lit(0))
    rest = F.when(after == 1, source.substr(at + 4, F.length(source))).otherwise(F.lit(""))
    return F.trim(before), F.trim(rest)


def quoted(value: Column) -> Column:
    """In double quotes, with escapes of quotes, backslashes and control characters."""
    out = F.replace(F.replace(text(value), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return F.concat(F.lit('"'), out, F.lit('"'))


def shell_quote(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def recipient(name: Column, address: Column) -> Column:
    """'Name <address>', or the one that is there."""
    n, a = text(name), text(address)
    return F.when((n == "") | (n == a), a).when(a == "", n).otherwise(F.concat(n, F.lit(" <"), a, F.lit(">")))


def shorten(value: Column, n: int) -> Column:
    return F.when(F.length(value) > n, F.concat(F.substring(value, 1, n), F.lit("…"))).otherwise(value)


def display_name(full: Column, given: Column, family: Column, emails: Column, phones: Column) -> Column:
    """The full name, else given and family name, else the first mail address or phone number."""
    both = F.concat_ws(" ", F.nullif(F.trim(text(given)), F.lit("")), F.nullif(F.trim(text(family)), F.lit("")))
    options = [F.trim(text(full)), both, text(F.get(emails, F.lit(0))), text(F.get(phones, F.lit(0)))]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in options], F.lit("(unnamed)"))


def padded(vector: Column, n: int) -> Column:
    """Cut or filled with zeros to n."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def retry_delay(attempt: Column, base: float, most: float) -> Column:
    """Nothing before the second attempt, then base doubled each time up to most, without jitter."""
    return F.when(attempt < 2, F.lit(0.0)).otherwise(F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt - 2, F.lit(10)))))


def since(value: Column) -> Column:
    """A timestamp from RFC 3339 or a day."""
    return F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))


def from_millis(value: Column) -> Column:
    return F.timestamp_millis(value.try_cast("bigint"))


def xml_leak(value: Column) -> Column:
    """A tool call that was written out as XML."""
    return F.lower(value).rlike(r"<(tool_call|function|invoke|parameter)[ =>]")


def joined_words(words: Column) -> Column:
    """The query of positional words (an array)."""
    return F.trim(F.array_join(words, " "))


def message_cap(n: Column, default: int = 100) -> Column:
    """How many messages of a conversation are taken; none or 0 means the default."""
    return F.coalesce(F.nullif(n, F.lit(0)), F.lit(default))
