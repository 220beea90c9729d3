"""Entropy of tokens and the shapes that explain it, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of generated files in which random-looking text is normal.
NOISY = (".min.js", ".bundle.js", ".map", ".lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "composer.lock", "cargo.lock", "go.sum")
# Words that explain a random token, and words that make it a likely secret.
SAFE_LINE = (r"(?i)integrity\s*[=:]|sha(?:1|256|384|512)[-:]|md5|checksum|etag|\bdigest\b|content-hash|resolved\s*[\"']?https|\"version\"|sourcemappingurl"
             r"|\bcommit\b|\brevision\b|\bhash\b|\bfingerprint\b|base64,|font-face|cache[-_]?key|bundle[-_]?id|build[-_]?id")
SECRET_LINE = r"(?i)secret|token|key|passwd|password|passphrase|credential|auth|signature|sig|private|session|cookie|salt|seed|dsn"
# Shapes of tokens that are no secrets (UUIDs, digests, numbers, dates, names of several words, paths, data and colours of style sheets).
NOISE_SHAPES = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^[0-9a-f]{40}$|^[0-9a-f]{64}$", r"^[0-9._\-]+$", r"^\d{4}[-_]?\d{2}[-_]?\d{2}",
                r"^[a-z0-9]{1,32}(?:[_\-][a-z0-9]{1,32}){2,8}$", r"[/\\]{1}[A-Za-z0-9_.\-]+[/\\]", r"(?i:^(?:data:|#[0-9a-f]{3,8}$|rgba?\())")
# Bits per character from which a token counts, plain and in noisy files.
THRESHOLD = {"hex": (3.2, 3.6), "base64": (4.3, 4.8)}


def shannon(token: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    n = F.length(token)
    # What is left without a character tells its count: one native replace each, no inner loop.
    shares = F.transform(F.array_distinct(F.split(token, "")), lambda c: (n - F.length(F.replace(token, c, F.lit("")))) / n.cast("double"))
    bits = F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    return F.when(F.length(token) == 0, F.lit(0.0)).otherwise(bits)


def charset(token: Column) -> Column:
    return F.when(token.rlike(r"^[A-Fa-f0-9]+$"), "hex").when(token.rlike(r"^[A-Za-z0-9+/=_\-]+$"), "base64")


def looks_like_words(token: Column) -> Column:
    """Letters only, and camel-case parts of three or more, or one lower-case run."""
    parts = F.filter(F.split(token, r"(?=\p{Lu})"), lambda p: p != "")
    camel = (F.size(parts) >= 2) & F.forall(parts, lambda p: F.length(p) >= 3)
    return token.rlike(r"^\p{L}+$") & (camel | token.rlike(r"^\p{Ll}+$"))


def structural_noise(token: Column) -> Column:
    """Whether the shape of a token explains its entropy (ids, dates, words, paths, few characters)."""
    distinct = F.size(F.array_distinct(F.split(token, "")))
    shape = token.rlike("|".join(NOISE_SHAPES))
    return shape | looks_like_words(token) | (distinct <= F.greatest(F.lit(4), F.floor(F.length(token) / 8)))


def noisy_path(path: Column) -> Column:
    p = F.lower(path)
    out = F.contains(p, F.lit("/node_modules/"))
    for suffix in NOISY:
        out = out | F.endswith(p, F.lit(suffix))
    return out


def threshold(kind: Column, noisy: Column) -> Column:
    return F.when(kind == "hex", F.when(noisy, THRESHOLD["hex"][1]).otherwise(THRESHOLD["hex"][0])) \
        .otherwise(F.when(noisy, THRESHOLD["base64"][1]).otherwise(THRESHOLD["base64"][0]))


def token_confidence(bits: Column, kind: Column, token: Column, line: Column, noisy: Column) -> Column:
    margin = F.least(F.lit(0.25), F.greatest(F.lit(0.0), (bits - threshold(kind, noisy)) * 0.25))
    total = F.when(kind == "base64", 0.45).otherwise(0.35) + margin \
        + F.when(line.rlike(SECRET_LINE), 0.25).otherwise(0.0) + F.when(F.length(token) >= 40, 0.05).otherwise(0.0) - F.when(noisy, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), total))
