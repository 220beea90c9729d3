"""Request signatures of version 4, as the provider's public documentation defines them.

For callers who ask a provider about a key pair: nothing here opens a connection."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mac(key: bytes, text: str) -> bytes:
    return hmac.new(key, text.encode(), hashlib.sha256).digest()


def signing_key(secret: str, date: str, region: str, service: str) -> bytes:
    """The key derived for a day (YYYYMMDD), a region and a service."""
    key = ("AWS4" + secret).encode()
    for part in (date, region, service, "aws4_request"):
        key = _mac(key, part)
    return key


def authorization(key_id: str, secret: str, method: str, host: str, path: str, body: str, at: str, region: str, service: str, headers: Mapping[str, str] | None = None) -> str:
    """The Authorization header of a request at ``at`` (YYYYMMDDTHHMMSSZ) without query."""
    every = {k.lower(): " ".join(v.split()) for k, v in {"host": host, "x-amz-date": at, **(headers or {})}.items()}
    names = ";".join(sorted(every))
    canonical = "\n".join([method, path, "", *(f"{k}:{every[k]}" for k in sorted(every)), "", names, hashlib.sha256(body.encode()).hexdigest()])
    scope = f"{at[:8]}/{region}/{service}/aws4_request"
    text = "\n".join(["AWS4-HMAC-SHA256", at, scope, hashlib.sha256(canonical.encode()).hexdigest()])
    made = hmac.new(signing_key(secret, at[:8], region, service), text.encode(), hashlib.sha256).hexdigest()
    return f"AWS4-HMAC-SHA256 Credential={key_id}/{scope}, SignedHeaders={names}, Signature={made}"


def split_pair(pair: Column) -> tuple[Column, Column]:
    """Id and secret of a linked pair ``id:secret``; nulls where there is no colon."""
    has = F.contains(pair, F.lit(":"))
    return F.when(has, F.substring_index(pair, ":", 1)), F.when(has, F.substring(pair, F.instr(pair, F.lit(":")) + 1, F.length(pair)))
