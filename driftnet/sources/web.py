"""Web pages as a relation: paths, links and assets, the frontier of a crawl, and site policies.

Pages come from a table (url, html); fetching them is the business of whoever
fills it.  A crawl is a loop of joins over that table, one level per round.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of URLs whose content is worth scanning.
INTERESTING = ("js mjs cjs map json json5 xml yml yaml env config conf ini properties txt sql bak old zip tar gz tgz toml lock log pem key crt wasm graphql har plist csv tsv webmanifest swp").split()


def logical_path(url: Column) -> Column:
    """Host with port and path; ``index.html`` after a closing slash."""
    host = F.regexp_extract(url, r"^[a-zA-Z][\w+.\-]*://(?:[^@/?#]*@)?([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][\w+.\-]*://[^/?#]*([^?#]*)", 1)
    full = F.when(path == "", "/").otherwise(path)
    return F.concat(host, full, F.when(F.endswith(full, F.lit("/")), "index.html").otherwise(""))


def absolute(href: Column, base: Column) -> Column:
    """An href made absolute against its page; fragments are dropped, dots are not resolved."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z][\w+.\-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][\w+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-zA-Z][\w+.\-]*://[^/]*)?(.*/)?[^/]*$", "$1$2")
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(h.rlike(r"^[a-zA-Z][\w+.\-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(scheme, h)).when(F.startswith(h, F.lit("/")), F.concat(root, h)).when(h == "", base).otherwise(F.concat(folder, h))


def interesting(url: Column) -> Column:
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return path.rlike(r"\.(?:" + "|".join(INTERESTING) + r")$") | path.rlike(r"/\.env|/\.git/")


def references(pages: DataFrame) -> DataFrame:
    """url, kind (script, link, iframe, anchor), target of every reference of ``pages(url, html)``."""
    def found(tag: str, attribute: str, kind: str) -> Column:
        hits = F.regexp_extract_all("html", F.lit(rf"""(?is)<{tag}\b[^>]*?\b{attribute}\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
        return F.transform(hits, lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("href")))

    every = F.concat(found("script", "src", "script"), found("link", "href", "link"), found("iframe", "src", "iframe"), found("a", "href", "anchor"))
    rows = pages.where("url is not null and html is not null").select("url", F.explode(every).alias("r"))
    return rows.select("url", "r.kind", absolute(F.col("r.href"), F.col("url")).alias("target")).where(F.col("target").rlike("^https?://")).distinct()


def assets(pages: DataFrame) -> DataFrame:
    """What a scan fetches besides pages: scripts with their maps, frames, interesting links and anchors."""
    refs = references(pages)
    direct = refs.where((F.col("kind").isin("script", "iframe")) | interesting(F.col("target")) | (F.col("kind") == "link") & F.lower("target").rlike(r"\.css"))
    maps = direct.where(F.lower("target").rlike(r"\.(?:js|css)$")).withColumn("target", F.concat("target", F.lit(".map")))
    return direct.unionByName(maps).select("url", "target").distinct()


def links(pages: DataFrame) -> DataFrame:
    """Anchors to further pages of the same host."""
    host = lambda c: F.regexp_extract(c, r"^https?://([^/?#]*)", 1)
    return references(pages).where((F.col("kind") == "anchor") & ~interesting(F.col("target")) & (host("target") == host("url"))).select("url", "target").distinct()


def crawl(pages: DataFrame, start: Sequence[str], depth: int = 3) -> DataFrame:
    """url, level of pages reached from ``start`` over links within ``depth`` rounds.

    Each round is an anti-join of the frontier against what was seen, stored so
    that lineage does not grow."""
    from driftnet.storage import stored

    spark, edges = pages.sparkSession, stored(links(pages), "links")
    seen = spark.createDataFrame([(u,) for u in start], "url string").distinct().withColumn("level", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        found = edges.join(frontier.select("url"), "url", "left_semi").select(F.col("target").alias("url")).distinct()
        frontier = stored(found.join(seen, "url", "left_anti").withColumn("level", F.lit(level)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


# --- policies ----------------------------------------------------------------------------

# Seconds of the windows a rate limit can name.
WINDOWS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400}


def seconds_per_request(limit: Column) -> Column:
    """``N/window`` as seconds between requests; null where it cannot be read."""
    n = F.regexp_extract(limit, r"^\s*(\d+(?:\.\d+)?)\s*(?:requests?|reqs?)?\s*(?:/|per)\s*(\d+)?\s*([a-zA-Z]+?)s?\s*$", 1).try_cast("double")
    many = F.regexp_extract(limit, r"(?:/|per)\s*(\d+)\s*[a-zA-Z]+\s*$", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(limit, r"([a-zA-Z]+?)s?\s*$", 1))
    unit = F.when(F.trim(F.lower(limit)).rlike(r"(?:/|per)\s*\d*\s*s$"), "s").otherwise(unit)
    table = F.create_map(*(F.lit(x) for kv in WINDOWS.items() for x in kv))
    return F.when(n > 0, F.try_element_at(table, unit) * F.coalesce(many, F.lit(1.0)) / n)


def glob_pattern(glob: str) -> str:
    """A path pattern of robots files (``*`` and a closing ``$``) as a regular expression."""
    end = glob.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in glob.removesuffix("$").split("*")) + ("$" if end else "")


def path_allowed(path: Column, allow: Sequence[str], deny: Sequence[str]) -> Column:
    """The longest matching pattern decides, allow on a tie; no match allows."""
    verdicts = [F.when(path.rlike(glob_pattern(g)), F.struct(F.lit(len(g)).alias("n"), F.lit(ok).alias("ok"))) for ok, globs in ((True, allow), (False, deny)) for g in globs if g]
    if not verdicts:
        return F.lit(True)
    return F.coalesce(F.array_max(F.array_compact(F.array(*verdicts)))["ok"], F.lit(True))


def parse_policy(text: str, agent: str = "*") -> dict:
    """A site policy in robots form or in ``key: value`` blocks: allow, disallow, delay, fields.

    General fields hold first, then those of ``*``, then those of the agent."""
    blocks: dict[str, dict[str, list[str]]] = {"": {}}
    current = [""]
    fresh = True
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if ":" not in line:
            continue
        key, value = (x.strip() for x in line.split(":", 1))
        key = key.lower()
        if key in ("user-agent", "agent"):
            current = [*current, value.lower()] if not fresh and current != [""] else [value.lower()]
            fresh = False
            blocks.setdefault(value.lower(), {})
            continue
        fresh = True
        if not raw[:1].isspace() and key not in ("allow", "disallow", "crawl-delay") and "user-agent" not in text.lower():
            current = [""]
        for name in current:
            blocks[name].setdefault(key, []).append(value)
    fields: dict[str, list[str]] = {}
    wanted = [n for n in ("", "*", agent.lower()) if n in blocks] + [n for n in blocks if n not in ("", "*", agent.lower()) and n and agent.lower().startswith(n)]
    for name in dict.fromkeys(wanted):
        fields |= blocks[name]
    delay = next((float(v) for v in fields.get("crawl-delay", []) if re.fullmatch(r"\d+(?:\.\d+)?", v)), 0.0)
    disallow = [p for v in fields.get("disallow", []) for p in v.split()] or (["/"] if any(v.lower() in ("no", "deny", "disallow", "n") for v in fields.get("scraping", [])) else [])
    return {"allow": [p for v in fields.get("allow", []) for p in v.split()], "disallow": disallow, "delay": delay, "denied": "/" in disallow, "fields": {k: v[-1] for k, v in fields.items()}}


def policies(files: DataFrame, agent: str = "*") -> DataFrame:
    """host, allow, disallow, delay, denied of ``files(host, text)``, the sites' policy files.

    Of several files of a host the greatest text counts; a null text allows all."""
    @F.pandas_udf("allow array<string>, disallow array<string>, delay double, denied boolean")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        rows = [parse_policy(t or "", agent) for t in texts]
        return pd.DataFrame({k: [r[k] for r in rows] for k in ("allow", "disallow", "delay", "denied")})

    one = files.where("host is not null").groupBy(F.lower("host").alias("host")).agg(F.max("text").alias("text"))
    return one.select("host", parsed("text").alias("p")).select("host", "p.*")


def policy_allows(path: Column, allow: Column, disallow: Column) -> Column:
    """As ``path_allowed`` with patterns in array columns: the longest that matches decides, allow on a tie, none allows."""
    def longest(globs: Column) -> Column:
        def matched(g: Column) -> Column:
            body = F.regexp_replace(F.regexp_replace(g, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
            pattern = F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(F.endswith(g, F.lit("$")), "$").otherwise(""))
            return F.when((g != "") & F.regexp_like(path, pattern), F.length(g))

        return F.coalesce(F.array_max(F.transform(globs, matched)), F.lit(-1))

    return longest(allow) >= longest(disallow)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://(?:[^@/?#]*@)?([^/?#]*)", 1))


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, bytes]], sites: DataFrame | None = None, delay: float = 0.0, most_bytes: int = 16 << 20) -> DataFrame:
    """url, status, content, message of each distinct address of ``urls(url)``.

    ``fetch(url) -> (status, bytes)`` runs in the executors.  Addresses a policy
    of ``sites`` (as of ``policies``) forbids are not asked for and come with a
    message, as do failed and oversized answers.  A host is asked by one task at
    a time with the longer of ``delay`` and its policy's between two requests:
    that a large site takes long is what its policy wants.
    """
    rows = urls.where(F.col("url").rlike("^https?://")).select("url", host_of(F.col("url")).alias("host")).distinct()
    if sites is None:
        rows = rows.withColumns({"delay": F.lit(float(delay)), "open": F.lit(True)})
    else:
        path = F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
        rows = rows.join(sites, "host", "left").withColumns({"open": F.coalesce(~F.col("denied") & policy_allows(path, F.col("allow"), F.col("disallow")), F.lit(True)), "delay": F.greatest(F.lit(float(delay)), "delay")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for batch in batches:
            out = []
            for url, host, wait, allowed in zip(batch["url"], batch["host"], batch["delay"], batch["open"], strict=True):
                if not allowed:
                    out.append((url, None, None, "forbidden by the site's policy"))
                    continue
                left = last.get(host, 0.0) + wait - time.monotonic()
                if host in last and left > 0:
                    time.sleep(left)
                try:
                    status, body = fetch(url)
                    message = f"http {status}" if status != 200 else "too large" if len(body) > most_bytes else ""
                    out.append((url, status, None if message else body, message))
                except Exception as error:  # noqa: BLE001 - a failed request is a row
                    out.append((url, None, None, type(error).__name__))
                last[host] = time.monotonic()
            frame = pd.DataFrame(out, columns=["url", "status", "content", "message"])
            yield frame.assign(status=frame["status"].astype("Int32"))

    return rows.repartition("host").select("url", "host", "delay", "open").mapInPandas(run, "url string, status int, content binary, message string")


def llms_links(text: Column, base: Column) -> Column:
    """Targets of the Markdown links of an llms.txt on the same host, each once, in order."""
    hrefs = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(\s*<?([^)\s>]+)"), F.lit(1))
    root = F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    return F.array_distinct(F.filter(F.transform(hrefs, lambda h: absolute(h, base)), lambda u: F.startswith(u, root)))
