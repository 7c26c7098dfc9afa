"""Release of clean public URLs: how much of a URL may stay readable, by host."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidConfig

HOST_KEY = re.compile(r"^(?:\*\.)?(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9-]{2,63}$")

# Hosts whose URLs stay readable in full; `*.` covers a domain and all below it.
FULL = """
localhost 127.0.0.1 [::1] 0.0.0.0 *.github.com *.githubusercontent.com *.gitlab.com *.bitbucket.org *.codeberg.org
*.sourceforge.net *.huggingface.co *.npmjs.com *.npmjs.org *.yarnpkg.com *.pypi.org *.pythonhosted.org *.crates.io
*.rubygems.org *.packagist.org *.nuget.org *.maven.org *.wikipedia.org *.wikimedia.org *.mozilla.org *.w3.org *.whatwg.org
*.rfc-editor.org *.ietf.org *.iso.org *.unicode.org *.iana.org *.apache.org *.python.org *.nodejs.org *.rust-lang.org
*.golang.org *.go.dev *.kotlinlang.org *.scala-lang.org *.typescriptlang.org anthropic.com docs.anthropic.com openai.com
deepmind.com mistral.ai docs.mistral.ai oracle.com docs.oracle.com aws.amazon.com docs.aws.amazon.com cloud.google.com
azure.microsoft.com docs.microsoft.com learn.microsoft.com *.stackoverflow.com *.stackexchange.com *.serverfault.com
*.superuser.com *.shields.io *.badgen.net *.fury.io *.nodei.co *.npm.im *.packagequality.com *.travis-ci.org *.travis-ci.com
*.circleci.com *.appveyor.com *.coveralls.io *.codecov.io *.david-dm.org *.snyk.io *.tidelift.com *.opencollective.com
*.jsdelivr.com *.jsdelivr.net *.unpkg.com
""".split()
TOKEN = r"^(?i)(?:https?://|www\.)[^\s<>\"'`()\[\]{}|\\^,;]+"
NESTED = r"(?i)[a-z][a-z0-9+.-]*://|.www\."
SEPARATORS = r"^[\s)\]\[(,;:.!?'\"`<>]*$"
CREDENTIAL = r"(?i)[?&#;](?:(?:[a-z0-9]+[_-])+(?:token|secret|password|api[_-]?key)|access[_-]?token|auth[_-]?token|id[_-]?token|token|api[_-]?key|apikey|key|secret|client[_-]?secret|password|passwd|pwd|sig|signature|x-amz-signature|x-amz-credential|x-goog-signature|x-goog-credential|x-oss-signature|x-oss-credential|code|auth)="


def policy(hosts: dict[str, str] | None = None, replace_defaults: bool = False) -> dict[str, str]:
    """Host keys to `full`, `host` or `mask`; raises for a key that isn't a lower-case host or domain."""
    for key, release in (hosts or {}).items():
        if not HOST_KEY.match(key):
            raise InvalidConfig(f"not a lower-case host or *.domain: {key!r}")
        if release not in ("full", "host", "mask"):
            raise InvalidConfig(f"release of {key!r} must be 'full', 'host' or 'mask', not {release!r}")
    return {**({} if replace_defaults else dict.fromkeys(FULL, "full")), **(hosts or {})}


def policy_table(spark: SparkSession, table: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(table.items()), "host_key string, release string")


def host_of(url: Column) -> Column:
    """The host without port or user information, lower case; null if there is none."""
    bare = F.regexp_replace(url, r"^(?i)(?:https?://)?", "")
    authority = F.regexp_extract(bare, r"^[^/?#\\]*", 0)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    return F.when(host != "", host)


def release_of(host: Column, table: dict[str, str]) -> Column:
    """The nearest entry for a host: the host itself, then each parent domain's `*.` key; `www.` doesn't count; else mask."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    bare = F.regexp_replace(host, r"^www\.", "")
    labels = F.split(bare, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.concat(F.lit("*."), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    nearest = F.get(F.filter(F.transform(parents, lambda p: F.try_element_at(entries, p)), lambda r: r.isNotNull()), F.lit(0))
    return F.coalesce(F.try_element_at(entries, bare), nearest, F.lit("mask"))


def readable(url: Column, table: dict[str, str]) -> Column:
    """How many leading characters of a URL span may stay readable, by itself."""
    token = F.regexp_extract(url, TOKEN, 0)
    body = F.regexp_replace(token, r"^(?i)(?:https?://|www\.)", "")
    origin = F.length(F.regexp_extract(token, r"^(?i)(?:https?://|www\.)[^/?#]*", 0))
    host = host_of(token)
    release = F.coalesce(release_of(host, table), F.lit("mask"))
    clean = (token != "") & ~body.rlike(NESTED) & ~F.regexp_extract(body, "^[^/?#]*", 0).contains("@") & ~token.rlike(CREDENTIAL) & (release != "mask")
    rest = F.substr(url, F.length(token) + 1)
    full = F.when(rest.rlike(SEPARATORS), F.length(url)).otherwise(F.length(token))
    return F.when(clean, F.when((release == "host") & (F.length(token) - origin > 1), origin).otherwise(full)).otherwise(0)


def release_clean(spans: DataFrame, table: dict[str, str]) -> DataFrame:
    """Spans (doc_id, label, start, end, value) without the public part of clean URLs.

    A URL span is split at its schemes; a part that any other span touches stays masked whole. What remains of a
    part is a span of its own, and URL fragments inside a released range go.
    """
    others = spans.where("label <> 'private_url'").select(F.col("doc_id").alias("_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    urls = spans.where("label = 'private_url'")
    pieces = F.filter(F.split("value", r"(?i)(?=https?://)", -1), lambda p: p != "")
    rows = urls.select("*", F.posexplode(pieces).alias("_i", "_p"))
    w = W.partitionBy("doc_id", "start", "end").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_from", F.col("start") + F.coalesce(F.sum(F.length("_p")).over(w), F.lit(0))).withColumn("_to", F.col("_from") + F.length("_p"))
    touched = (F.col("doc_id") == F.col("_id")) & (F.col("_s") < F.col("_to")) & (F.col("_from") < F.col("_e"))
    flagged = rows.join(others, touched, "left").groupBy(*urls.columns, "_i", "_p", "_from", "_to").agg(F.max("_s").isNotNull().alias("_touched"))
    cut = flagged.withColumn("_n", F.when(F.col("_touched"), 0).otherwise(readable(F.col("_p"), table)).cast("int"))
    left = cut.where(F.col("_n") < F.length("_p")).withColumn("start", F.col("_from") + F.col("_n")).withColumn("end", F.col("_to"))
    left = left.withColumn("value", F.expr("substr(_p, _n + 1)")).select(*spans.columns)
    open_ = cut.where("_n > 0").select(F.col("doc_id").alias("_id"), F.col("_from").alias("_s"), (F.col("_from") + F.col("_n")).alias("_e"))
    inside = (F.col("doc_id") == F.col("_id")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e"))
    return spans.where("label <> 'private_url'").unionByName(left.join(open_, inside, "left_anti"))
