"""Verdicts on findings: who can be asked, what an answer means, what would be revoked.

Nothing here opens a connection: requests are described, sending one is a
function the caller passes in, answers are read as a relation, and revoking
ends with a plan."""

from __future__ import annotations

import base64
import datetime
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.functions.signing import authorization
from driftnet.functions.text import identity
from driftnet.operators.state import secret_key

# Providers by the beginning of the rule id, and whether they can be asked and revoked by themselves.
PROVIDERS = (("github.", "github", True, False), ("slack.", "slack", True, True), ("stripe.", "stripe", True, False), ("openai.", "openai", True, False), ("gcp.", "gcp", False, False), ("aws.", "aws", True, True))
# Where a person revokes what cannot be revoked automatically.
PAGES = {"github": "https://github.com/settings/tokens", "stripe": "https://dashboard.stripe.com/apikeys", "openai": "https://platform.openai.com/api-keys", "gcp": "https://console.cloud.google.com/apis/credentials"}


def provider(rule_id: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for start, name, _, _ in PROVIDERS:
        out = out.when(F.startswith(rule_id, F.lit(start)), F.lit(name))
    return out


def verdict(status: Column) -> Column:
    """active, inactive or error by the status of an answer; null is an error."""
    return F.when(status == 200, "active").when(status.isin(401, 403), "inactive").otherwise("error")


def eligible(findings: DataFrame, only: Sequence[str] = (), least: float = 0.5) -> DataFrame:
    """Findings sure enough and of a known provider, with ``provider``."""
    out = findings.withColumn("provider", provider(F.col("rule_id"))).where(F.col("provider").isNotNull() & (F.col("confidence") >= least))
    return out.where(F.col("provider").isin(*only)) if only else out


def providers_for(findings: DataFrame, least: float = 0.5) -> DataFrame:
    return eligible(findings, (), least).select("provider").distinct()


def verified(findings: DataFrame, ask: Callable[[str, str], tuple[int | None, str]], least: float = 0.5) -> DataFrame:
    """provider, secret_hash, verdict, note: each distinct secret is asked about once.

    ``ask(provider, secret) -> (status, note)`` runs in the executors; a provider
    that cannot be asked is ``unsupported``."""
    asked = frozenset(name for _, name, can, _ in PROVIDERS if can)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, secret, key in zip(batch["provider"], batch["secret"], batch["secret_hash"], strict=True):
                if name not in asked:
                    rows.append((name, key, None, "no verifier", False))
                    continue
                try:
                    status, note = ask(name, secret)
                except Exception as error:  # noqa: BLE001 - an answer that fails is an answer
                    status, note = None, type(error).__name__
                rows.append((name, key, status, note, True))
            yield pd.DataFrame(rows, columns=["provider", "secret_hash", "status", "note", "asked"])

    distinct = eligible(findings, (), least).withColumn("secret_hash", secret_key()).groupBy("provider", "secret_hash").agg(F.min("secret").alias("secret"))
    answers = distinct.mapInPandas(run, "provider string, secret_hash string, status int, note string, asked boolean")
    return answers.select("provider", "secret_hash", F.when(~F.col("asked"), "unsupported").otherwise(verdict(F.col("status"))).alias("verdict"), "note")


@dataclass(frozen=True)
class Request:
    """A read-only request that tells whether a secret works."""

    method: str
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    body: str = ""


# The providers' own addresses for "who am I".
WHO_AM_I = {"github": ("GET", "https://api.github.com/user"), "slack": ("POST", "https://slack.com/api/auth.test"), "stripe": ("GET", "https://api.stripe.com/v1/account"),
            "openai": ("GET", "https://api.openai.com/v1/models"), "aws": ("POST", "https://sts.amazonaws.com/")}
_ANSWER = "provider string, secret_hash string, status int, headers map<string,string>, body string, note string"


def request_for(name: str, secret: str, at: str | None = None) -> Request | None:
    """The request that asks a provider about a secret; None where there is none or a pair ``id:secret`` is needed."""
    if name not in WHO_AM_I:
        return None
    method, url = WHO_AM_I[name]
    if name == "stripe":
        return Request(method, url, {"Authorization": "Basic " + base64.b64encode(f"{secret}:".encode()).decode()})
    if name != "aws":
        return Request(method, url, {"Authorization": f"Bearer {secret}"})
    key_id, _, key = secret.partition(":")
    if not key:
        return None
    at = at or datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%SZ")
    body, kind = "Action=GetCallerIdentity&Version=2011-06-15", {"Content-Type": "application/x-www-form-urlencoded"}
    signed = authorization(key_id, key, method, "sts.amazonaws.com", "/", body, at, "us-east-1", "sts", kind)
    return Request(method, url, {**kind, "Host": "sts.amazonaws.com", "X-Amz-Date": at, "Authorization": signed}, body)


def answers_read(answers: DataFrame) -> DataFrame:
    """provider, secret_hash, verdict, note, identity, team, scopes of ``answers`` (provider, secret_hash, status, headers, body, note).

    A null status is a failed request and an error, never inactive; a status of
    200 is active, but for a provider that says in its body whether it accepts;
    401 and 403 are inactive.  Header names are compared without letter case.
    """
    name, status, body = F.col("provider"), F.col("status"), F.col("body")
    header = F.element_at(F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k)), "x-oauth-scopes")
    scopes = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    accepted = F.get_json_object(body, "$.ok")
    by_body = F.when(status.isNull() | accepted.isNull(), "error").when(accepted == "true", "active").otherwise("inactive")
    found = F.when(status.isNull() & F.col("note").isin("no verifier", "no pair of id and secret"), "unsupported").when(name == "slack", by_body).otherwise(verdict(status))
    who = F.when(name == "github", F.get_json_object(body, "$.login")).when(name == "slack", F.get_json_object(body, "$.user")).when(name == "aws", F.nullif(F.regexp_extract(body, "<Arn>([^<]*)</Arn>", 1), F.lit("")))
    team = F.when(name == "slack", F.get_json_object(body, "$.team")).when(name == "aws", F.nullif(F.regexp_extract(body, "<Account>([^<]*)</Account>", 1), F.lit("")))
    rows = answers.select("provider", "secret_hash", found.alias("verdict"), "status", "note", who.alias("who"), team.alias("team"), scopes.alias("scopes"))
    live = F.col("verdict") == "active"
    note = F.when(live, F.concat_ws(" ", "provider", "who", F.when(F.size("scopes") > 0, F.concat(F.lit("scopes: "), F.array_join("scopes", ", "))))) \
        .when(F.col("verdict") == "inactive", F.concat(name, F.lit(" rejected"))).otherwise(F.coalesce("note", F.concat(name, F.lit(" http "), status.cast("string"))))
    return rows.select("provider", "secret_hash", "verdict", note.alias("note"), F.when(live, F.col("who")).alias("identity"), F.when(live, F.col("team")).alias("team"), F.when(live, F.col("scopes")).alias("scopes"))


def asked_about(findings: DataFrame, send: Callable[[Request], tuple[int, dict, str]], cache: DataFrame | None = None, budget: int = 2000, least: float = 0.5, only: Sequence[str] = ()) -> DataFrame:
    """Verdicts on the distinct secrets of ``findings``, the surest asked about first.

    ``send(request) -> (status, headers, body)`` runs in the executors, once a
    secret (a pair counts as one).  Secrets of ``cache`` (secret_hash, ...) are
    not asked about again; at most ``budget`` requests are sent and the secrets
    beyond are left for the next run.  An exception of ``send`` is an error.
    """
    value = identity(F.col("secret"), F.col("secret_v2")) if "secret_v2" in findings.columns else F.col("secret")
    keyed = eligible(findings, only, least).where("secret is not null").withColumn("_value", value).withColumn("secret_hash", F.sha2(F.col("_value").cast("binary"), 256))
    distinct = keyed.groupBy("provider", "secret_hash").agg(F.min("_value").alias("value"), F.max("confidence").alias("confidence"))
    if cache is not None:
        distinct = distinct.join(cache.select("secret_hash").distinct(), "secret_hash", "left_anti")
    chosen = distinct.orderBy(F.desc("confidence"), "provider", "secret_hash").limit(budget)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, key, secret in zip(batch["provider"], batch["secret_hash"], batch["value"], strict=True):
                request = request_for(name, secret)
                if request is None:
                    rows.append((name, key, None, {}, None, "no pair of id and secret" if name in WHO_AM_I else "no verifier"))
                    continue
                try:
                    status, headers, body = send(request)
                    rows.append((name, key, status, dict(headers), body, None))
                except Exception as error:  # noqa: BLE001 - an answer that fails is an answer
                    rows.append((name, key, None, {}, None, f"{name}: {type(error).__name__}"))
            out = pd.DataFrame(rows, columns=["provider", "secret_hash", "status", "headers", "body", "note"])
            yield out.assign(status=out["status"].astype("Int32"))

    return answers_read(chosen.mapInPandas(run, _ANSWER))


def revocation_plan(findings: DataFrame) -> DataFrame:
    """What revoking would do, one row per active secret: provider, secret_hash, automated, detail."""
    spark: SparkSession = findings.sparkSession
    table = spark.createDataFrame([(n, auto, PAGES.get(n, "")) for _, n, _, auto in PROVIDERS], "provider string, automated boolean, page string")
    live = findings.where("verified = 'active'").withColumn("provider", provider(F.col("rule_id"))).where("provider is not null")
    plan = live.select("provider", secret_key().alias("secret_hash")).distinct().join(F.broadcast(table), "provider")  # six providers
    return plan.select("provider", "secret_hash", "automated", F.when(F.col("automated"), F.concat_ws(" ", F.lit("revoke through the API of"), "provider")).otherwise(F.concat_ws(" ", F.lit("by hand:"), "page")).alias("detail"))


def rescored(findings: DataFrame, tokens: Callable[[Column], Column] | None) -> DataFrame:
    """Confidence moved by how well a tokenizer packs the secret; unchanged without one.

    0.35 tokens a character and more: +0.1 up to 0.9; under 0.175: -0.1.  Sure
    findings (0.85) and sensitive keys keep theirs."""
    if tokens is None:
        return findings
    share = tokens(F.col("secret")) / F.greatest(F.length("secret"), F.lit(1))
    moved = F.when(share >= 0.35, F.greatest(F.col("confidence"), F.least(F.lit(0.9), F.col("confidence") + 0.1))).when(share < 0.175, F.greatest(F.lit(0.05), F.col("confidence") - 0.1)).otherwise(F.col("confidence"))
    return findings.withColumn("confidence", F.when((F.col("confidence") >= 0.85) | (F.col("detector") == "keyname"), F.col("confidence")).otherwise(F.bround(moved, 3)))
