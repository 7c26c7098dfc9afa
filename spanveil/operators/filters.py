"""Filters and relabels of spans (doc_id, label, start, end, value, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validators import lat_lon
from .detect import matches

# Labels that are off by default, and cuts by label.
DISABLED = ["private_organization", "private_occupation", "private_demographic", "private_sensitive", "private_title", "private_date"]
CUTS = {"private_ip": 0.5, "private_mac": 0.5, "private_date": 0.125, "private_email": 0.075}
DECODE_CUT, POST_CUT = 0.05, 0.0
AGENT_READABLE = DISABLED

# Shapes by which model spans and dates are relabelled or dropped. Stray punctuation may stand around a value.
DMS = r"\d{1,3}\s*°\s*\d{1,2}\s*['′]"
PAIR = r"(-?\d{1,3}\.\d+)\s*[,;]\s*(-?\d{1,3}(?:\.\d+)?)|(-?\d{1,3}(?:\.\d+)?)\s*[,;]\s*(-?\d{1,3}\.\d+)"
QUAD = r"^\W*\d{1,3}(?:\.\d{1,3}){3}\W*\z"
UUID = r"(?i)^\W*[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\W*\z"
CREDENTIAL_KEY = r"(?i)(?:api[_-]?key|apikey|access[_-]?key|secret|token|password|passwd|client[_-]?secret|auth)[\"']?\s*[:=]\s*[\"']?$"
PRODUCT_NAMES = r"(?i)^\W*claude(?:[ -](?:code|desktop|api|agent(?: sdk)?|opus|sonnet|haiku|fable)(?:[ -]\d+(?:\.\d+)*)?)?\W*\z"
DIGEST = r"\b(?:sha1|sha256|sha384|sha512)-[A-Za-z0-9+/]{20,}={0,2}"
LEVELS = "TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|FATAL|CRITICAL"
CLOCK, ZONE = r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?", r"(?:Z|[+-]\d{2}:?\d{2})?"
STAMP = rf"(?m)(?=\d{{4}}-\d{{2}}-\d{{2}}[ T])(?<=^[ \t]{{0,64}}\[?)\d{{4}}-\d{{2}}-\d{{2}}(?: {CLOCK}|T{CLOCK}|T\d{{2}}:\d{{2}}){ZONE}(?=\]?[^\n]{{0,24}}?\b(?:{LEVELS})\b)"


def enabled(spans: DataFrame, disabled: list[str] = DISABLED) -> DataFrame:
    return spans.where(~F.col("label").isin(disabled)) if disabled else spans


def cut_of(label: Column, cuts: dict[str, float], otherwise: float) -> Column:
    """A label's cut, else the general one."""
    if not cuts:
        return F.lit(otherwise)
    table = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), F.lit(otherwise))


def above_cut(spans: DataFrame, cuts: dict[str, float] = CUTS, otherwise: float = POST_CUT) -> DataFrame:
    """Spans that score at least their cut. Belongs before any deduplication, which would let a weak span swallow a strong one."""
    return spans.where(F.col("score") >= cut_of(F.col("label"), cuts, otherwise))


def decode_cut(label: Column, cuts: dict[str, float] = CUTS, disabled: list[str] = DISABLED) -> Column:
    """The cut at decoding: never under the decoder's own, and out of reach for labels that are off."""
    return F.when(label.isin(disabled), F.lit(float("inf"))).otherwise(F.greatest(F.lit(DECODE_CUT), cut_of(label, cuts, POST_CUT)))


def geo(spans: DataFrame) -> DataFrame:
    """Places in degrees, or with a pair in range of which one number at least has decimals, stay; dotted quads go; any other is an address."""
    place = F.col("label") == "private_geolocation"
    part = lambda one, other: F.concat(F.regexp_extract("value", PAIR, one), F.regexp_extract("value", PAIR, other))
    kept = F.col("value").rlike(DMS) | lat_lon(F.concat(part(1, 3), F.lit(","), part(2, 4)))
    return spans.where(~(place & F.col("value").rlike(QUAD))).withColumn("label", F.when(place & ~kept, "private_address").otherwise(F.col("label")))


def drop_quads(spans: DataFrame) -> DataFrame:
    """Without model spans that are only a dotted quad: those are the pattern's to find."""
    return spans.where(~F.col("value").rlike(QUAD))


def resolve_uuids(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """A UUID taken for an account number is a secret after a credential key on its line (within 48 characters), else nothing."""
    joined = spans.join(texts.select("doc_id", "text"), "doc_id")
    before = F.expr("substring(text, greatest(start - 48, 0) + 1, least(start, 48))")
    line = F.element_at(F.split(before, "\n", -1), -1)
    uuid = (F.col("label") == "account_number") & F.col("value").rlike(UUID)
    keyed = line.rlike(CREDENTIAL_KEY)
    return joined.where(~uuid | keyed).withColumn("label", F.when(uuid, "secret").otherwise(F.col("label"))).select(*spans.columns)


def drop_product_names(spans: DataFrame) -> DataFrame:
    """Without persons that are only the name of an assistant or of one of its products."""
    return spans.where(~((F.col("label") == "private_person") & F.col("value").rlike(PRODUCT_NAMES)))


def _outside(spans: DataFrame, texts: DataFrame, pattern: str, only: str | None) -> DataFrame:
    """Without spans that lie inside a match of a pattern: a containment anti-join by document."""
    found = texts.select("doc_id", F.explode(matches(F.col("text"), pattern)).alias("m")).select(F.col("doc_id").alias("_id"), F.col("m.start").alias("_s"), F.col("m.end").alias("_e"))
    inside = (F.col("doc_id") == F.col("_id")) & (F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e"))
    return spans.join(found, inside & (F.col("label") == only) if only else inside, "left_anti")


def drop_in_digests(spans: DataFrame, texts: DataFrame) -> DataFrame:
    return _outside(spans, texts, DIGEST, None)


def drop_log_stamps(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Without dates that only stamp a log line whose level follows."""
    return _outside(spans, texts, STAMP, "private_date")


def relabel(spans: DataFrame, names: dict[str, str | None], keep_unmapped: bool = False) -> DataFrame:
    """Another tool's labels as ours; a label mapped to nothing goes, an unknown one goes or is marked."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map()
    known = F.col("label").isin(list(names))
    mapped = F.when(known, F.try_element_at(table, F.col("label"))).otherwise(F.concat(F.lit("unmapped:"), F.col("label")) if keep_unmapped else F.lit(None))
    return spans.withColumn("label", mapped).where(F.col("label").isNotNull())


def strip_space(spans: DataFrame, texts: DataFrame) -> DataFrame:
    joined = spans.join(texts.select("doc_id", "text"), "doc_id").withColumn("_v", F.expr("substring(text, start + 1, end - start)"))
    left, right = F.length("_v") - F.length(F.ltrim("_v")), F.length("_v") - F.length(F.rtrim("_v"))
    return joined.withColumn("start", F.col("start") + left).withColumn("end", F.col("end") - right).where("end > start").select(*spans.columns)


def secret_pass(secrets: DataFrame, seen: DataFrame) -> DataFrame:
    """Secrets of a second pass that share characters with what the first one saw. The exact rule is an approximation."""
    s = seen.select(F.col("doc_id").alias("_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return secrets.join(s, (F.col("doc_id") == F.col("_id")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_semi")
