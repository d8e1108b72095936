"""Tables of the engine and their defaults."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of enumerated columns.
ROOTS, CONFIDENCES, KINDS = ("facts", "info"), ("confirmed", "partial", "hypothesis"), ("runtime", "config", "narrative")
DIMENSIONS = 256


def strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


LEAFS = T.StructType(
    strings("id", "text", "root", "confidence", "sha256", "source", "source_rev", "observed_at", "how", "loc", "type", "valid_from", "valid_to")
    + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
FILES = T.StructType(strings("id", "path", "repo", "mtime"))
COMMITS = T.StructType(strings("id", "repo", "subject", "author", "email", "date"))
PERSONS = T.StructType(strings("id", "name", "email"))
EDGES = T.StructType(strings("src", "dst"))
EVIDENCE = T.StructType([*strings("id", "kind", "when"), T.StructField("stale", T.BooleanType())])
CLAIMS = T.StructType([T.StructField("text", T.StringType()), T.StructField("yes", T.ArrayType(EVIDENCE)), T.StructField("no", T.ArrayType(EVIDENCE))])
MESSAGES = T.StructType(strings("id", "ts", "from", "text", "media", "platform"))
CONTACTS = T.StructType([*strings("full_name", "given", "family", "org", "title", "photo", "source"), T.StructField("emails", T.ArrayType(T.StringType())), T.StructField("phones", T.ArrayType(T.StringType()))])
