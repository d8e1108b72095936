"""Predicates and classifiers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlspike.functions.text import text

#: Fixed lists: directories without content of interest, directories and base names that may hold secrets.
NOISE = ("node_modules", ".venv", "venv", ".git", "_archive", "var", "dist", "build", ".next", ".cache", "target")
SECRET_DIRECTORIES = (".ssh", "secrets", "credentials", "certs", "keys", "tokens", "wallets", "private")
SECRET_NAMES = (".env", "secret", "credential", "allowlist", "token", "id_rsa", ".pem", ".p12", "password", "passwords")
#: Fixed patterns of personal data in outgoing queries, with reasons, in order. Java's \b knows letters that RE2's doesn't, so ASCII bounds are spelled out.
B, E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
PRIVATE = (
    (r"\d{6,}", "a run of six or more digits looks like an ID"),
    (rf"(?iu){B}personalnummer{E}", "Personalnummer is staff data"),
    (rf"(?iu){B}kv[-\s]?nr{E}", "KV-Nr is an insurance number"),
    (rf"(?iu){B}versichertennummer{E}", "insurance number"),
    (rf"(?iu){B}[A-Za-zÄÖÜäöüß]+(?:stra(?:ss|ß)e|str\.)\s*\d+", "a street with a house number looks like an address"),
    (rf"(?iu){B}geb(?:urtsdatum)?\.?\s*\d{{1,2}}[./]\d{{1,2}}[./]\d{{2,4}}", "a date of birth"),
)
#: Fixed routes of attachments: media type (a star ends a prefix), extension or '', handler; the first that fits is taken.
ROUTES = (
    ("application/pdf", "", "pdf"),
    ("image/*", "", "image"),
    ("text/calendar", "", "ical"),
    ("text/html", "", "html"),
    ("text/*", "", "text"),
    ("application/json", "", "structured"),
    ("application/xml", "", "structured"),
    ("application/xhtml*", "", "html"),
    ("application/vnd.openxmlformats-*", "", "office"),
    ("application/msword", "", "legacy"),
    ("application/vnd.ms-*", "", "legacy"),
    ("application/octet-stream", ".eml", "eml"),
)


def indexable(path: Column) -> Column:
    """Neither below a noise or secret directory, nor with a secret-like base name; case doesn't count."""
    parts = F.split(F.lower(path), "/")
    base = F.element_at(parts, -1)
    return ~F.exists(parts, lambda p: p.isin(*NOISE, *SECRET_DIRECTORIES)) & reduce(lambda a, n: a & ~F.contains(base, F.lit(n)), SECRET_NAMES, F.lit(True))


def active_at(valid_from: Column, valid_to: Column, day: Column | str) -> Column:
    """Whether day lies within the closed interval; '' is open on that side, and an empty day is within any."""
    d, lo, hi = (F.lit(day) if isinstance(day, str) else day), text(valid_from), text(valid_to)
    return (d == "") | (((lo == "") | (lo <= d)) & ((hi == "") | (d <= hi)))


def valid_phone(value: Column) -> Column:
    """Ordered rejections: length, dates, ranges, letters, zero groups, digit count, days, a leading 2."""
    s = F.regexp_replace(F.trim(value), r"^[+()\-\t ]+|[+()\-\t ]+$", "")
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    bad = (
        ~F.length(s).between(6, 25)
        | s.rlike(r"^\d{2,4}[-/]\d{1,2}[-/]\d{2,4}$")
        | s.rlike(r"^\d+\s*[-–]\s*\d+$")
        | s.rlike("[/a-zA-Z]")
        | F.contains(s, F.lit("000"))
        | F.contains(s, F.lit("500 "))
        | ~digits.between(7, 15)
        | ((F.length(s) <= 8) & (digits == 8) & s.rlike("^(20|19)"))
        | ((digits >= 11) & s.startswith("2"))
    )
    return ~bad


def private_reason(query: Column) -> Column:
    """Why a query mustn't leave, or ''."""
    return F.coalesce(*[F.when(query.rlike(p), F.lit(why)) for p, why in PRIVATE], F.lit(""))


def read_only(sql: Column) -> Column:
    """A single statement that only reads."""
    s = F.lower(F.trim(sql))
    return s.rlike(r"^(select|with|show|explain|values|table)([^a-z_]|$)") & ~s.rlike(r"(^|[^a-z_])(insert|update|delete|drop|alter|create|truncate|grant|revoke|copy|merge|call|do|vacuum)([^a-z_]|$)") & ~s.rlike(r";\s*\S")


def confirmed_fact(root: Column, confidence: Column) -> Column:
    return (root == "facts") & ~text(confidence).isin("hypothesis", "partial")


def has_identity(*values: Column, lists: tuple[Column, ...] = ()) -> Column:
    return reduce(lambda a, b: a | b, [F.trim(text(v)) != "" for v in values] + [F.coalesce(F.size(x), F.lit(0)) > 0 for x in lists])


def transient(message: Column) -> Column:
    return F.lower(message).rlike("timeout|timed out|temporar|rate limit|too many requests|connection (reset|refused)|503|429")


def mentions(body: Column, word: str) -> Column:
    """A whole-word mention, case ignored, with ASCII bounds."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in word)
    return body.rlike(rf"(?iu){B}{quoted}{E}")


def route(media: Column, extension: Column) -> Column:
    """The handler of an attachment; unknown ones are described by their metadata."""
    m, e = F.lower(F.trim(text(media))), F.lower(F.trim(text(extension)))
    when = [F.when((m.startswith(t[:-1]) if t.endswith("*") else m == t) & ((e == x) if x else F.lit(True)), F.lit(h)) for t, x, h in ROUTES]
    return F.coalesce(*when, F.lit("metadata"))


def web_status(results: Column) -> Column:
    """No result means throttled, never absent."""
    return F.when(F.coalesce(F.size(results), F.lit(0)) > 0, "ok").otherwise("throttled")


def day_header(line: Column) -> Column:
    return F.upper(line).isin("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY", "TODAY", "YESTERDAY", "THIS WEEK", "LAST WEEK") | line.rlike(r"^[A-Z]{3}\s+\d{1,2}$")


def calendar_file(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(ics|ical)$")
