"""Personal data: keyed surrogates of the same length and character classes, and a scanner."""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FIELD_PATHS, RAW_SCHEMA

#: Fields that identify a person, and shapes of personal data in text.
PII_FIELDS = ("patient.name", "patient.uhid", "patient.ip_number", "insurance.policy_number", "insurance.claim_number", "insurance.employee_id")
TEXT_PATTERNS = {
    "aadhaar": r"(?<!\d)[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}(?!\d)",
    "pan": r"(?<![A-Z0-9])[A-Z]{5}\d{4}[A-Z](?![A-Z0-9])",
    "phone": r"(?<!\d)(?:\+?91[ -]?)?[6-9]\d{9}(?!\d)",
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
}
SCAN_PATTERNS = TEXT_PATTERNS | {"gstin": r"(?<![A-Z0-9])\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9](?![A-Z0-9])"}
ALLOW = "pii-allow"


@dataclass(frozen=True)
class RedactionKey:
    """A secret of at least 32 bytes."""

    material: bytes

    def __post_init__(self):
        if len(self.material) < 32:
            raise ValueError("a redaction key has 32 bytes or more")

    @property
    def fingerprint(self) -> str:
        """What records name the key by; the key can't be told from it."""
        return hashlib.sha256(hmac.digest(self.material, b"fingerprint:", "sha256")).hexdigest()[:16]

    @classmethod
    def load_or_create(cls, path: Path | str, repository: Path | str | None = None) -> RedactionKey:
        """The key at a path outside the repository, made there if it isn't yet, readable by its owner."""
        path = Path(path).expanduser().resolve()
        if repository and path.is_relative_to(Path(repository).resolve()):
            raise ValueError("a redaction key must not lie in the repository")
        if not path.exists():
            path.parent.mkdir(parents=True, exist_ok=True)
            with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
                f.write(secrets.token_bytes(64))
        return cls(path.read_bytes())


def surrogate_text(value: str | None, material: bytes, kind: str) -> str | None:
    """The same for values of any length and script."""
    if not value:
        return value
    stream = hmac.digest(material, f"{kind}:{value}".encode(), "sha256")
    while len(stream) < len(value):
        stream += hmac.digest(stream, b"extend", "sha256")
    swap = lambda c, b: chr(48 + b % 10) if c.isdigit() else chr(65 + b % 26) if c.isupper() else chr(97 + b % 26) if c.islower() else c
    return "".join(map(swap, value, stream))


def surrogate(value: Column, key: RedactionKey, kind: str = "generic") -> Column:
    material = key.material

    @F.pandas_udf("string")
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda v: surrogate_text(v, material, kind))

    return replaced(value)


def redact_text(text: Column, key: RedactionKey) -> Column:
    """struct(text, aadhaar, pan, phone, email): each shape replaced in turn, and how many of each there were."""
    material, names = key.material, list(TEXT_PATTERNS)

    @F.pandas_udf(f"text string, {', '.join(f'{n} int' for n in names)}")
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shapes = {n: re.compile(p) for n, p in TEXT_PATTERNS.items()}
        for texts in batches:
            rows = []
            for text in texts:
                counts = []
                for name, shape in shapes.items():
                    text, n = (None, 0) if text is None else shape.subn(lambda m, k=name: surrogate_text(m[0], material, k), text)
                    counts.append(n)
                rows.append((text, *counts))
            yield pd.DataFrame(rows, columns=["text", *names])

    return redacted(text)


def redact_documents(rows: DataFrame, key: RedactionKey, document_col: str = "document", id_col: str = "doc_id", extra_fields: tuple[str, ...] = (), consent: str | None = None) -> DataFrame:
    """All columns of ``rows``, the raw document with its identifying fields (and ``extra_fields``, as block.field) replaced and its
    descriptions redacted, and ``record``: which fields were, how often each shape was, when, under which key and consent; never a value.

    Blank fields stay and aren't recorded; the hospital stays; a null document stays null, with an empty record. ``record`` has the columns of
    ``sources.manifest.REDACTION``, so ``rows.select("record.*")`` can be appended to the log.
    """
    fields = tuple(dict.fromkeys((*PII_FIELDS, *extra_fields)))
    if unknown := [f for f in fields if f not in FIELD_PATHS]:
        raise ValueError(f"no such fields: {', '.join(unknown)}")
    material, names, document = key.material, list(TEXT_PATTERNS), F.col(document_col)

    @F.pandas_udf(f"said array<string>, {', '.join(f'{n} int' for n in names)}")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shapes = {n: re.compile(p) for n, p in TEXT_PATTERNS.items()}
        for lists in batches:
            out = []
            for texts in lists:
                counts, said = dict.fromkeys(names, 0), []
                for text in () if texts is None else texts:
                    for name, shape in shapes.items():
                        text, n = shape.subn(lambda m, k=name: surrogate_text(m[0], material, k), text) if text else (text, 0)
                        counts[name] += n
                    said.append(text)
                out.append((None if texts is None else said, *counts.values()))
            yield pd.DataFrame(out, columns=["said", *names])

    given = lambda p: F.coalesce(document[p.split(".")[0]][p.split(".")[1]], F.lit(""))
    blocks = []
    for f in RAW_SCHEMA:
        if f.name == "line_items":
            blocks.append(F.zip_with(document["line_items"], F.col("_cleaned.said"), lambda i, d: i.withField("description", d)).alias(f.name))
        else:
            leaf = lambda n, b=f.name: surrogate(document[b][n], key, f"{b}.{n}") if f"{b}.{n}" in fields else document[b][n]
            blocks.append(F.struct(*(leaf(n).alias(n) for n in f.dataType.fieldNames())).alias(f.name))
    counts = F.filter(F.array(*(F.struct(F.lit(n).alias("k"), F.col(f"_cleaned.{n}").alias("v")) for n in names)), lambda c: c["v"] > 0)
    record = F.struct(
        F.col(id_col).cast("string").alias("document_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("redacted_at"),
        F.filter(F.array(*(F.when(given(p) != "", F.lit(p)) for p in fields)), lambda p: p.isNotNull()).alias("fields_redacted"),
        F.map_from_entries(counts).alias("text_patterns"), F.lit(key.fingerprint).alias("key_fingerprint"), F.lit(consent).cast("string").alias("consent_reference"),
    )
    made = rows.withColumn("_cleaned", cleaned(F.transform(document["line_items"], lambda i: i["description"])))
    return made.withColumn("record", record).withColumn(document_col, F.when(document.isNotNull(), F.struct(*blocks))).drop("_cleaned")


def scan_text(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, kind, found) for every match on lines that aren't allowed by a mark."""
    lines = rows.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line")).where(~F.contains("line", F.lit(ALLOW)))
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("line", F.lit(p), 0).alias("hits")) for k, p in SCAN_PATTERNS.items()))
    return lines.select(id_col, (F.col("at") + 1).alias("line_no"), F.inline(found)).select(id_col, "line_no", "kind", F.explode("hits").alias("found"))


def is_forbidden(path: Column) -> Column:
    """Whether data/real are neighbouring segments of a path."""
    return F.regexp_like(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(r"(^|/)data/real(/|$)"))


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """The prefixes of an allow-list file: a line each, without comments, blanks and slashes at the end; none where there is no file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "prefix string")
    bare = F.regexp_replace(F.trim(F.regexp_replace("value", "#.*$", "")), "/+$", "")
    return spark.read.text(path).select(bare.alias("prefix")).where("prefix <> ''")


def allowed(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Files (path) at or under one of the prefixes (prefix)."""
    under = (F.col("path") == F.col("prefix")) | F.startswith(F.col("path"), F.concat(F.col("prefix"), F.lit("/")))
    return files.join(prefixes, under, "left_semi")
