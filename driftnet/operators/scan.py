"""The scan: blobs to findings.

Three passes (rules, entropy, sensitive keys) run over each text and over its
decoded views in one narrow stage: every text is read, decoded and lowered once,
all candidates leave one generator, and one projection judges them.  Each text meets each rule's pattern only if
one of the rule's literals stands in it.  What is found is small against the
texts; only that is shuffled, once for pairs within a blob and once, after a
map-side combine, to keep each finding once.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftnet.functions import decode, entropy, keywords, parse, scope, text as tx, validate
from driftnet.plans.rules import BUILT_IN, PAIRS, Rule, rules_frame

FINDING = ("fingerprint", "rule_id", "title", "detector", "severity", "logical_path", "source_path", "line", "column_no", "secret", "match_context",
           "confidence", "entropy", "key_name", "notes", "media_type", "secret_v2", "checksum", "actionability")
# Classes are spelled out: the JVM looks single characters up in a bit set, ranges one by one.
_HEX = "ABCDEFabcdef0123456789"
_ENTROPY = (("base64", "[" + string.ascii_letters + string.digits + r"+/=_\-]{20,120}"), ("hex", rf"\b[{_HEX}]{{32,128}}\b"))


@dataclass(frozen=True)
class ScanOptions:
    """What a scan looks for and what it reports; applied when the plan is made."""

    rules: Sequence[Rule] = BUILT_IN
    min_confidence: float = 0.4
    min_severity: str = "low"
    regex: bool = True
    entropy: bool = True
    keynames: bool = True
    decoders: bool = True
    respect_ignore: bool = True
    #: Words whose presence makes a value a name; pass the contents of a word list.
    words: Sequence[str] = field(default=())
    #: Most findings of one blob, in the order they are met; None keeps all.
    max_per_blob: int | None = None
    redact: bool = False
    #: Columns of the blobs that their findings keep, such as the commit they come from.
    keep: Sequence[str] = ()


def _quoted(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _positions(pattern: str, group: int, number: int) -> str:
    """SQL for array<struct<rule_ord, start, secret>> of a pattern's matches in ``text``.

    Starts come from the lengths of what lies between the matches, so the JVM's
    UTF-16 offsets never show.  The fold runs over the gaps: the one after the
    last match has no match and adds nothing.  (One string for all rules: built
    call by call, the plan would take longer to make than small inputs to scan.)
    """
    re_ = _quoted(pattern)
    wholes = f"regexp_extract_all(text, {re_}, 0)"
    secrets = wholes if group == 0 else f"regexp_extract_all(text, {re_}, {group})"
    inside = "0" if group == 0 else "greatest(instr(r.w, r.s) - 1, 0)"
    rows = f"zip_with(zip_with({wholes}, {secrets}, (w, s) -> struct(w as w, s as s)), transform(split(text, {re_}, -1), g -> length(g)), (m, g) -> struct(m.w as w, m.s as s, g as g))"
    if group == 0:
        rows = f"zip_with({wholes}, transform(split(text, {re_}, -1), g -> length(g)), (m, g) -> struct(m as w, m as s, g as g))"
    empty = "cast(array() as array<struct<rule_ord:int,start:int,secret:string>>)"
    hit = f"struct({number} as rule_ord, cast(acc.at + r.g + {inside} as int) as start, r.s as secret)"
    return (f"aggregate({rows}, struct(0 as at, {empty} as out), (acc, r) -> struct(cast(acc.at + r.g + coalesce(length(r.w), 0) as int) as at, "
            f"if(r.w is null, acc.out, array_append(acc.out, {hit})) as out), acc -> acc.out)")


# From this many rules on one automaton looks for all their literals; below it, a search each is cheaper.
AUTOMATON_RULES = 80


def rule_matches(rules: Sequence[Rule], hits: str | None = None) -> Column:
    """array<struct<rule_ord, start, secret>> of all rules' matches in ``text``, in rule order.

    Reads the columns text, lowered and logical_path.  A rule is tried only if one of its guards stands
    in the text (or its number in the array ``hits``, of keywords.keyword_hits) and its path conditions hold."""
    parts = []
    for i, rule in enumerate(rules):
        guard = f"array_contains({hits}, {i})" if hits else " or ".join(f"contains(lowered, {_quoted(g)})" for g in rule.guards)
        when = [guard] if rule.guards else []
        when += [f"logical_path rlike {_quoted(rule.path)}"] if rule.path else []
        when += [f"not logical_path rlike {_quoted(no)}" for no in rule.not_paths]
        # One search decides; only texts with a match are split at all their matches.
        when.append(f"text rlike {_quoted(rule.pattern)}")
        parts.append(f"case when {' and '.join(f'({w})' for w in when)} then {_positions(rule.pattern, rule.group, i)} else array() end")
    return F.expr(f"flatten(array({', '.join(parts)}))") if parts else F.array().cast("array<struct<rule_ord:int,start:int,secret:string>>")


def _views(blobs: DataFrame, options: ScanOptions) -> DataFrame:
    """One row per blob and view: path, text, lowered text, boost."""
    plain = F.array(F.struct(F.lit(0).alias("view_ord"), F.lit("").alias("label"), F.col("text").alias("text")))
    every = F.concat(plain, decode.views(F.col("text"))) if options.decoders else plain
    rows = blobs.withColumn("v", F.explode(every)).select(
        F.when(F.col("v.label") == "", F.col("logical_path")).otherwise(F.concat_ws("#", "logical_path", "v.label")).alias("logical_path"), F.col("logical_path").alias("root_path"),
        "source_path", "media_type", "is_binary", "line_offset", "commit_line", *(("extra",) if options.keep else ()), "v.view_ord", "v.text")
    return rows.withColumn("x", F.explode(F.array(F.struct(F.lower("text").alias("lowered"), scope.boost(scope.categories(F.col("logical_path"))).alias("boost"))))).select("*", "x.*").drop("x")


def _blobs(frame: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Blobs with every column the scan reads; missing ones get their defaults."""
    defaults = {"source_path": F.col("logical_path"), "media_type": F.lit("text/plain"), "is_binary": F.lit(False), "line_offset": F.lit(0), "commit_line": F.lit(0)}
    out = frame.select(F.col("logical_path").cast("string"), F.col("text").cast("string"),
                       *(F.coalesce(F.col(c), d).alias(c) if c in frame.columns else d.alias(c) for c, d in defaults.items()),
                       *([F.struct(*(F.col(f"`{c}`") for c in keep)).alias("extra")] if keep else []))
    return out.where("logical_path is not null and text is not null and text <> ''")


_KEEP = ("root_path", "logical_path", "source_path", "media_type", "is_binary", "line_offset", "commit_line", "view_ord", "boost")


def _kept(options: ScanOptions) -> tuple[str, ...]:
    return (*_KEEP, "extra") if options.keep else _KEEP


#: One candidate of any pass: which pass, the rule's or tokeniser's number, where, what, and its key and line if known.
_CANDIDATE = "array<struct<pass_ord:int,rule_ord:int,start:int,secret:string,key:string,key_line:int,bits:double>>"
_REGEX, _TOKEN, _KEY = 0, 1, 2


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns computed exactly once: they pass through a generator, so no
    later projection or filter repeats them."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return rows.withColumn("_x", F.explode(F.array(made))).select("*", "_x.*").drop("_x")


def _as_candidate(kind: int):  # noqa: ANN202
    return lambda h: F.struct(F.lit(kind).alias("pass_ord"), h["rule_ord"].alias("rule_ord"), h["start"].alias("start"), h["secret"].alias("secret"),
                              F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("key_line"), (h["bits"] if kind == _TOKEN else F.lit(None).cast("double")).alias("bits"))


def _pair_candidate(p: Column) -> Column:
    return F.struct(F.lit(_KEY).alias("pass_ord"), F.lit(0).alias("rule_ord"), p["start"].alias("start"), F.regexp_replace(p["value"], r"^\s+|\s+$", "").alias("secret"),
                    p["key_path"].alias("key"), p["line"].alias("key_line"), F.lit(None).cast("double").alias("bits"))


def _trimmed_token(h: Column) -> Column:
    """A token without outer =, - and _; its start moves along."""
    head = F.length(F.regexp_extract(h["secret"], "^[=_-]*", 0))
    return F.struct(h["rule_ord"].alias("rule_ord"), (h["start"] + head).cast("int").alias("start"), F.regexp_replace(h["secret"], "^[=_-]+|[=_-]+$", "").alias("secret"))


def token_matches() -> Column:
    """array<struct<rule_ord, start, secret>> of the long tokens of ``text``, 20 characters or more."""
    parts = ", ".join(f"case when text rlike {_quoted(pattern)} then {_positions(pattern, 0, i)} else array() end" for i, (_, pattern) in enumerate(_ENTROPY))
    return F.filter(F.transform(F.expr(f"flatten(array({parts}))"), _trimmed_token), lambda t: F.length(t["secret"]) >= 20)


def _with_bits(h: Column) -> Column:
    """A token with its entropy, null where its shape explains it."""
    bits = F.when(~entropy.structural_noise(h["secret"]), entropy.shannon(h["secret"]))
    return F.struct(h["rule_ord"].alias("rule_ord"), h["start"].alias("start"), h["secret"].alias("secret"), bits.alias("bits"))


def _regex_secret(h: Column) -> Column:
    """A match without outer blanks and quotes; its start moves along."""
    head = F.length(F.regexp_extract(h["secret"], "^\\s*[\"']*", 0))
    secret = F.regexp_replace(F.regexp_replace(h["secret"], r"^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")
    return F.struct(h["rule_ord"].alias("rule_ord"), (h["start"] + head).cast("int").alias("start"), secret.alias("secret"))


def _with_spans(every: Column) -> Column:
    """Candidates with the places of all candidates that its context shows: what a redacted report must hide there."""
    def one(c: Column) -> Column:
        def shown(o: Column) -> Column:
            return (o["start"] >= 0) & (o["start"] < c["start"] + F.length(c["secret"]) + tx.CONTEXT) & (o["start"] + F.length(o["secret"]) > c["start"] - tx.CONTEXT)

        spans = F.transform(F.filter(every, shown), lambda o: F.struct(o["start"].alias("at"), (o["start"] + F.length(o["secret"])).alias("end")))
        return F.struct(*(c[n].alias(n) for n in ("pass_ord", "rule_ord", "start", "secret", "key", "key_line", "bits")), F.array_distinct(spans).alias("spans"))

    return F.transform(every, one)


def _candidates(views: DataFrame, options: ScanOptions) -> DataFrame:
    """All candidates of all passes in one generator: each text is read and decoded once."""
    text, path = F.col("text"), F.col("logical_path")
    parts = []
    if options.regex:
        hits = "hits" if len(options.rules) >= AUTOMATON_RULES else None
        if hits:
            views = views.withColumn(hits, keywords.keyword_hits(F.col("lowered"), [r.guards for r in options.rules]))
        parts.append(F.transform(F.transform(rule_matches(options.rules, hits), _regex_secret), _as_candidate(_REGEX)))
    if options.entropy:
        # Only random tokens leave the generator: every candidate carries its text to the next steps.
        random = F.filter(F.transform(token_matches(), _with_bits), lambda t: t["bits"] >= entropy.threshold(entropy.charset(t["secret"]), F.lit(False)))
        parts.append(F.transform(random, _as_candidate(_TOKEN)))
    if options.keynames:
        pairs = F.filter(parse.pairs_of(text, path), lambda p: validate.sensitive_key(p["key_path"]))
        parts.append(F.when(~F.col("is_binary"), F.transform(parse.with_lines(pairs, text), _pair_candidate)).otherwise(F.array().cast(_CANDIDATE)))
    if not parts:
        raise ValueError("no pass is switched on")
    every = F.filter(F.concat(*parts), lambda c: (c["secret"] != "") & ~c["secret"].isin(*validate.PUBLISHED))
    if options.redact:
        # The list passes through a generator, so that the places of all candidates are found once.
        views = _once(views, every=every)
        every = _with_spans(F.col("every"))
    return views.withColumn("h", F.explode(every)).select(*_kept(options), "text", "h.*")


def _judged(rows: DataFrame, options: ScanOptions) -> DataFrame:
    """Candidates that stand, with rule, severity and confidence; one expression per pass under CASE."""
    spark, s = rows.sparkSession, F.col("secret")
    is_regex, is_token = F.col("pass_ord") == _REGEX, F.col("pass_ord") == _TOKEN
    table = rules_frame(spark, options.rules).drop("guards").withColumnRenamed("rule_ord", "_rule")
    rows = rows.withColumn("_rule", F.when(is_regex, F.col("rule_ord"))).join(F.broadcast(table), "_rule", "left")  # as many rows as there are rules
    check = F.col("check")
    rows = rows.withColumnRenamed("bits", "_bits")
    rows = _once(rows, noise=F.when(~is_regex & ~is_token, entropy.structural_noise(s)),
                 bits=F.when(is_token, F.col("_bits")).otherwise(F.when(~is_regex | (F.col("min_entropy") > 0), entropy.shannon(s))), named=validate.contains_word(s, options.words), charset=F.when(is_token, entropy.charset(s)), noisy=F.when(is_token, entropy.noisy_path(F.col("logical_path"))),
                 checksum=F.when(check == "github", validate.github_checksum(s)))
    valid = F.when(check == "real", validate.not_placeholder(s)).when(check == "jwt", validate.valid_jwt(s)).when(check == "login", validate.uri_login(s)) \
        .when(check == "private-ip", validate.private_ipv4(s)).when(check == "public-ip", validate.public_ipv4(s)).otherwise(True)
    harmless = F.lit(False)
    for i, rule in enumerate(options.rules):
        for pattern in rule.harmless:
            harmless = harmless | ((F.col("_rule") == i) & s.rlike(validate.HARMLESS_NAME if pattern == "name" else pattern))
    regex_stands = valid & ~harmless & ((F.col("min_entropy") == 0) | (F.col("bits") >= F.col("min_entropy"))) & F.coalesce(F.col("checksum"), F.lit(True)) \
        & ~(F.array_contains("tags", "generic") & validate.benign_value(s)) & ~(F.col("words") & F.col("named"))
    token_stands = F.col("charset").isNotNull() & (F.col("bits") >= entropy.threshold(F.col("charset"), F.col("noisy")))
    key_stands = ~validate.benign_value(s) & (F.length(s) <= 512) & ~validate.prose(s) & ~validate.plain_identifier(s)
    rows = rows.where(F.when(is_regex, regex_stands).when(is_token, token_stands).otherwise(key_stands))
    # Only what stands is placed: line, context and key need the text.
    text, start, path = F.col("text"), F.col("start"), F.col("logical_path")
    in_text = F.col("pass_ord") != _KEY
    minified = F.lower("logical_path").rlike(r"\.(?:min|bundle)\.js$") | F.substring("text", 1, 4096).rlike(r"(?m)^\s*[\w$]{1,3}\s*=\s*function|;\s*function\s*\(")
    before, after = tx.around(text, start)
    rows = _once(rows, before=F.when(in_text, before), after=F.when(in_text, after), minified=F.when(is_token, minified)).drop("text")
    at = tx.placed(F.col("before"), F.col("after"), F.length(s), F.col("spans") if options.redact else None)
    rows = _once(rows, at_line=F.when(in_text, at["line"]).otherwise(F.col("key_line")), column_no=F.when(in_text, at["column_no"]).otherwise(1), line_text=F.when(in_text, at["line_text"]),
                 near=F.when(is_token, at["near"]), match_context=F.when(in_text, at["match_context"]).otherwise(F.concat_ws(" = ", "key", "secret"))).drop("before", "after")
    rows = rows.where(~F.coalesce(F.col("near").rlike(entropy.SAFE_LINE), F.lit(False)))
    if options.respect_ignore:
        rows = rows.where(~F.coalesce(F.col("line_text").rlike(validate.IGNORE_LINE), F.lit(False)))
    rows = _once(rows, own=F.when(is_token, F.bround(entropy.token_confidence(F.col("bits"), F.col("charset"), s, F.col("near"), F.col("noisy")), 3)),
                 penalty=scope.context_penalty(path, F.col("line_text")),
                 keyed=F.lit(0.6) + F.col("boost") + F.when(F.col("bits") > 3.5, 0.1).otherwise(0.0) - F.when(F.col("noise"), 0.2).otherwise(0.0) - F.when(F.col("named"), 0.2).otherwise(0.0))
    off = F.when(F.col("is_binary"), 0.05).otherwise(0.0)
    ruled = F.least(F.lit(0.99), F.when(F.col("checksum"), F.lit(0.99)).otherwise(F.col("base") + F.col("boost") - F.col("penalty")) - off)
    tokened = F.col("own") + F.col("boost") - F.col("penalty") - F.when(F.col("named"), 0.2).otherwise(0.0) - F.when(F.col("minified"), 0.1).otherwise(0.0) - 2 * off
    sure = F.when(is_regex, ruled).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.when(is_token, tokened).otherwise(F.col("keyed")))))
    leaf = F.regexp_extract(F.substring_index("key", ".", -1), r"^[^\[]*", 0)
    noted = F.array_compact(F.array(F.when(F.col("checksum"), "checksum verified"), F.when(F.col("is_binary"), "recovered from binary strings")))
    graded = F.when(is_regex, F.col("severity")).when(is_token, F.when(F.col("own") > 0.6, "medium").otherwise("low")).otherwise(F.when(F.col("keyed") >= 0.7, "high").otherwise("medium"))
    titled = F.when(is_regex, F.col("title")).when(is_token, F.concat(F.lit("High-entropy "), "charset", F.lit(" string"))).otherwise(F.concat(F.lit("Sensitive key '"), leaf, F.lit("' with a literal value")))
    return rows.select(
        *_kept(options), "pass_ord", "rule_ord", "start", F.when(is_regex, F.col("rule_id")).when(is_token, F.concat(F.lit("entropy."), "charset")).otherwise("keyname.sensitive-assignment").alias("rule_id"),
        titled.alias("title"), F.when(is_regex, "regex").when(is_token, "entropy").otherwise("keyname").alias("detector"), graded.alias("severity"),
        "secret", "match_context", "at_line", "column_no", F.bround(sure, 3).alias("confidence"), F.when(~is_regex, F.bround("bits", 3)).alias("entropy"),
        F.when(in_text, tx.key_near(F.col("line_text"))).otherwise(F.col("key")).alias("key_name"),
        F.when(is_regex, noted).otherwise(F.array().cast("array<string>")).alias("notes"), F.coalesce("checksum", F.lit(False)).alias("checksum"))


def scan(blobs: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of ``blobs(logical_path, text, ...)``, each once.

    Optional columns: source_path, media_type, is_binary, line_offset (added to
    lines), commit_line (first line, from 1, the blob owns).  Blobs with a null
    path, a null text or an empty text give nothing; repeated blobs give their
    findings once; other columns are ignored.  A value met in the plain text is
    not reported again from a decoded view.  Columns named in ``keep`` come with
    the findings of their blob.  With ``redact`` no context shows a
    value any pass takes for a candidate, also one that is cut off by the
    context's edge: they are hidden by their places in the text, before anything
    is shuffled.
    """
    views = _views(_blobs(blobs, options.keep), options)
    found = _judged(_candidates(views, options), options)
    decoded = F.col("view_ord") > 0
    found = found.where("at_line >= commit_line").withColumns({
        "line": F.col("at_line") + F.col("line_offset"),
        "confidence": F.when(decoded, F.greatest(F.lit(0.05), F.bround(F.col("confidence") - 0.05, 3))).otherwise(F.col("confidence")),
        "notes": F.when(decoded, F.array_append("notes", F.concat(F.lit("recovered after "), F.substring_index("logical_path", "#", -1), F.lit(" decoding")))).otherwise(F.col("notes"))})
    linked = link_pairs(found)
    kept = linked.where((F.col("confidence") >= options.min_confidence) & (tx.severity_rank(F.col("severity")) >= tx.SEVERITY_RANK[options.min_severity]))
    named = kept.withColumn("value", tx.identity(F.col("secret"), F.col("secret_v2")))
    order = F.struct("view_ord", "pass_ord", "rule_ord", "line", "start")
    rest = [c for c in named.columns if c not in ("root_path", "rule_id", "value")]
    # Earliest meeting per root path, rule and value: plain text before views, combined before the shuffle.
    once = named.groupBy("root_path", "rule_id", "value").agg(F.min_by(F.struct(*rest), order).alias("f")).select("root_path", "rule_id", "value", "f.*")
    out = once.withColumn("fingerprint", tx.fingerprint(F.col("rule_id"), F.col("logical_path"), F.col("secret"), F.col("secret_v2")))
    if options.max_per_blob is not None:
        w = Window.partitionBy("root_path").orderBy("view_ord", "pass_ord", "rule_ord", "line", "start")
        out = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= options.max_per_blob)
    out = out.withColumn("actionability", tx.actionability(F.lit("unknown"), F.col("checksum"), F.col("confidence")))
    if options.redact:
        # Contexts of the text are hidden by place already; a key's context is made of its key and value.
        out = out.withColumns({"match_context": F.replace("match_context", F.col("secret"), tx.redact(F.col("secret"))), "secret": tx.redact(F.col("secret")),
                               "secret_v2": tx.redact(F.col("secret_v2"))})
    return out.select(*FINDING, *(F.col(f"extra.`{c}`") for c in options.keep))


def _has_rule(rule_id: str):  # noqa: ANN202
    return lambda m: m["r"] == rule_id


def _nearest(secrets: Column, line: Column) -> Column:
    """struct<d, o, s> of the secret nearest to a line."""
    return F.array_min(F.transform(secrets, lambda m: F.struct(F.abs(m["l"] - line).alias("d"), m["o"].alias("o"), m["s"].alias("s"))))


def _chooses(secrets: Column, order: Column, line: Column, window: int):  # noqa: ANN202
    """Whether an id's nearest secret is the one at ``order``, within the window."""
    return lambda m: (_nearest(secrets, m["l"])["o"] == order) & (F.abs(m["l"] - line) <= window)


def link_pairs(found: DataFrame, pairs: Sequence[tuple[str, str, int]] = PAIRS) -> DataFrame:
    """``secret_v2`` of findings that make one credential, in one pass over all findings.

    Each id goes with the nearest secret by lines in the same blob (ties: first
    met), if near enough; a secret takes the pair of the last id that chose it.

    Only rows of the pairs' rules carry a blob key into the window; the others
    get one of their own, so that no blob's other findings gather anywhere.  A
    row sees the lines that can matter, twice the pairs' reach on both sides:
    those of an id it may belong to, and of that id's other choices.
    """
    involved = [r for p in pairs for r in p[:2]]
    one = F.when(F.col("rule_id").isin(*involved), F.concat_ws("\0", "logical_path", F.col("line_offset").cast("string"))).otherwise(
        F.concat_ws("\0", "logical_path", *(F.col(c).cast("string") for c in ("view_ord", "pass_ord", "rule_ord", "start", "line_offset"))))
    keyed = found.withColumn("_blob", one)
    order = F.struct("view_ord", "pass_ord", "rule_ord", "start")
    member = F.when(F.col("rule_id").isin(*involved), F.struct(order.alias("o"), F.col("rule_id").alias("r"), F.col("line").alias("l"), F.col("secret").alias("s")))
    reach = 2 * max((w for _, _, w in pairs), default=0)
    rows = keyed.withColumn("_all", F.array_sort(F.collect_list(member).over(Window.partitionBy("_blob").orderBy("line").rangeBetween(-reach, reach))))
    combined, note = F.lit(None).cast("string"), F.lit(None).cast("string")
    for id_rule, secret_rule, window in pairs:
        secrets = F.filter("_all", _has_rule(secret_rule))
        mine = _nearest(secrets, F.col("line"))
        here = F.when((F.col("rule_id") == id_rule) & (mine["d"] <= window), F.concat_ws(":", F.col("secret"), mine["s"]))
        chosen = F.filter(F.filter("_all", _has_rule(id_rule)), _chooses(secrets, order, F.col("line"), window))
        there = F.when((F.col("rule_id") == secret_rule) & (F.size(chosen) > 0), F.concat_ws(":", F.get(chosen, F.size(chosen) - 1)["s"], F.col("secret")))
        combined, note = F.coalesce(combined, here, there), F.coalesce(note, F.when(here.isNotNull(), F.lit(f"paired with {secret_rule}")))
    return rows.withColumns({"secret_v2": combined, "notes": F.when(note.isNotNull(), F.array_append("notes", note)).otherwise(F.col("notes"))}).drop("_all", "_blob")
