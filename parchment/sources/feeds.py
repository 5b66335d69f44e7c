"""Records of catalogue feeds as manifest rows. Fetching is the caller's; retry rules are plain functions."""

from __future__ import annotations

import email.utils
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.functions import text as t

# Statuses worth another try, longest wait in seconds, document types of a registry.
RETRY = (408, 425, 429, 500, 502, 503, 504)
MAX_WAIT = 60.0
TYPES = ("Prot", "Prot_SAP")


def retry_after(value: str | None, now: float | None = None) -> float | None:
    """Seconds of a Retry-After header, given in seconds or as a date, at most MAX_WAIT."""
    if not value:
        return None
    try:
        seconds = float(value)
    except ValueError:
        try:
            seconds = email.utils.parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now)
        except (TypeError, ValueError):
            return None
    return min(max(seconds, 0.0), MAX_WAIT) if seconds == seconds else None


def backoff(attempt: int, header: str | None = None, base: float = 1.0) -> float:
    wait = retry_after(header)
    return min(base * 2**attempt, MAX_WAIT) if wait is None else wait


def guidance(raw: DataFrame, base: str) -> DataFrame:
    """Manifest rows of HTML-fragment records (title, media, issued, status, center, offices, docket); rows without media link go."""
    media, _ = t.first_link("media")
    landing, title = t.first_link("title")
    docket = t.first_link("docket")[1]
    r = raw.withColumns({"__href": media, "__landing": landing, "__title": title}).where("__href IS NOT NULL")
    r = r.withColumn("__id", F.regexp_extract("__href", "/media/([0-9]+)", 1)).where("__id <> ''")
    return r.select(
        F.concat(F.lit("guidance-"), "__id").alias("doc_id"), F.lit("guidance").alias("source"), F.when(F.col("__title") != "", F.col("__title")).alias("title"),
        t.absolute("__href", base).alias("url"), t.absolute("__landing", base).alias("landing_url"), F.nullif(t.strip_tags("status"), F.lit("")).alias("status"),
        F.nullif(t.strip_tags("center"), F.lit("")).alias("center"), t.offices("offices").alias("offices"), F.when((docket != "") & (F.lower(docket) != "none found"), docket).alias("docket"), t.us_date("issued").alias("issue_date"),
    )


def registry(raw: DataFrame, base: str) -> DataFrame:
    """Manifest rows of nested study JSON (response): one for each large document of a wanted type."""
    shape = "struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,sponsorCollaboratorsModule:struct<leadSponsor:struct<class:string>>>,documentSection:struct<largeDocumentModule:struct<largeDocs:array<struct<typeAbbrev:string,filename:string,size:bigint>>>>>"
    r = raw.select(F.from_json("response", shape).alias("s"))
    r = r.select("s.protocolSection.identificationModule.*", F.col("s.protocolSection.sponsorCollaboratorsModule.leadSponsor.class").alias("sponsor_class"), F.explode_outer("s.documentSection.largeDocumentModule.largeDocs").alias("d"))
    r = r.where(F.col("d.typeAbbrev").isin(*TYPES) & F.col("nctId").isNotNull())
    url = F.concat(F.lit(base), F.lit("/"), F.right("nctId", F.lit(2)), F.lit("/"), F.col("nctId"), F.lit("/"), F.col("d.filename"))
    return r.select(F.concat_ws("-", F.lit("registry"), "nctId", F.regexp_replace("d.filename", r"\.pdf$", "")).alias("doc_id"), F.lit("registry").alias("source"), F.col("briefTitle").alias("title"), url.alias("url"), F.coalesce("sponsor_class", F.lit("UNKNOWN")).alias("sponsor_class"), F.col("d.size").alias("declared_bytes"))
