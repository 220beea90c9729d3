"""The SQL of the core queries, for DuckDB over the same tables."""

from __future__ import annotations

_SHANNON = """round(abs(coalesce((select -sum(p * log2(p)) from (select count(*)::double / length(@@) as p from (select unnest(string_split(@@, '')) as c) group by c)), 0.0)), 3)"""
_CHARSET = "case when regexp_full_match(@@, '[A-Fa-f0-9]+') then 'hex' when regexp_full_match(@@, '[A-Za-z0-9+/=_\\-]+') then 'base64' end"
_PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|change_me|your[-_ ]?(?:key|token|secret)|xxx+|fake|redact|test[-_]?key|insert[-_]?here|<[^>]+>|\$\{[^}]+\}|%\([^)]+\)s"
_BENIGN = (r"(?i)(?:|true|false|null|none|nil|undefined|0|1|-|n/?a|\*+|x+|\$\{[^}]*\}|\{\{[^}]*\}\}|%[A-Z_]+%|<[^>]*>|/[a-z0-9/._\-]*|\d+(?:\.\d+)*|[a-f0-9]{0,7}"
           r"|(?:changeme|example|placeholder|dummy|secret|password|your[-_ ]?\w+|todo|fixme|redacted|hidden|masked|env|default|local(?:host)?)\.?)")
_BENIGN_SQL = f"(length(trim(@@)) < 6 or regexp_full_match(trim(@@), '{_BENIGN}'))"
_REDACT = "case when length(trim(@@)) <= 11 then repeat('*', length(trim(@@))) else concat(left(trim(@@), 4), '...', right(trim(@@), 4)) end"
_RANK = "case @@ when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 when 'info' then 0 end"
_TIER = "case when verified = 'active' then 'verified-active' when verified = 'inactive' then 'verified-inactive' when confidence >= 0.85 then 'high-confidence' else 'candidate' end"
_TIER_RANK = f"case {_TIER} when 'verified-active' then 4 when 'high-confidence' then 2 when 'candidate' then 1 else 0 end"
_MINE = r"""(?:https?|ssh|ftp|smb|ldaps?|rdp)://(?:[A-Za-z0-9._\-]+\.(?:local|lan|internal|intranet|corp|home\.arpa)|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|localhost)(?::\d+)?[^\s"''<>\\]*"""
_FORMATS = {
    "aws.access-key-id": r"\b((?:A3T[A-Z0-9]|AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16})\b", "gcp.api-key": r"\b(AIza[0-9A-Za-z_\-]{35})\b", "gitlab.token": r"\b(gl(?:pat|rt|ft|soat|cbt)-[A-Za-z0-9_\-]{20,})\b",
    "slack.token": r"\b(xox[abposr]-[A-Za-z0-9\-]{10,})\b", "stripe.secret-key": r"\b([sr]k_(?:live|test)_[A-Za-z0-9]{20,})\b", "npm.token": r"\b(npm_[A-Za-z0-9]{36})\b",
    "sendgrid.api-key": r"\b(SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43})\b", "crypto.private-key": r"(-----BEGIN (?:(?:RSA|DSA|EC|OPENSSH|PGP|ENCRYPTED) )?PRIVATE KEY(?: BLOCK)?-----)",
    "generic.internal-url": r"\b(" + _MINE + ")",
    "generic.database-uri": r"""\b((?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|rediss?|amqps?|mssql|jdbc:[a-z]+|clickhouse|cassandra)://[^:/\s"'']+:[^@\s"'']+@[^\s"''<>\\]+)""",
    "generic.basic-auth-url": r"""\b(https?://[^:/\s"'']+:[^@\s"'']{3,}@[^\s"''<>\\]+)"""}
_SENSITIVE = (r"(?i)(?:^|[._\-\[])(?:pass(?:wd|word)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|secret[_\-]?key|private[_\-]?key|client[_\-]?secret|auth|authorization"
              r"|credential|cred|bearer|session[_\-]?key|encryption[_\-]?key|signing[_\-]?key|master[_\-]?key|salt|dsn|conn(?:ection)?[_\-]?string|sas|sa[_\-]?key"
              r"|refresh[_\-]?token|id[_\-]?token|otp|pin|passphrase|keystore[_\-]?pass|_key|_token|_secret)(?:$|[._\-\]])")
_ASSIGN = r"""(?i)(?:access|auth|(?-i:[Aa]pi|API)|credential|creds|key|passw(?:or)?d|secret|token)[ \t\w.-]{0,20}[\s''"]{0,3}(?:=|>|:{1,3}=|\|\||:|=>|\?=|,)[`''"\s=]{0,5}([\w.=-]{10,150}|[a-z0-9][a-z0-9+/]{11,}={0,3})(?:[`''"\s;]|\\[nr]|$)"""
_SHELL = r"""(?m)^\s*(?:export\s+|declare\s+-\w+\s+|readonly\s+)?([A-Za-z_][A-Za-z0-9_]*)=(?:"([^"]*)"|''([^'']*)''|([^\s;#|&]+))"""
_HCL = r"""(?m)^\s*([A-Za-z_][A-Za-z0-9_.\-]*)\s*=\s*(?:"([^"\n]{0,999})"|([^\s#]+))"""
_LATEST = "l as (select path, arg_max({'h': blob_hash}, listed_at).h as blob_hash from file_listing where path is not null group by 1), u as (select l.path, coalesce(k.path is not null, false) as unchanged from l left join (select distinct path, blob_hash from files where path is not null and blob_hash is not null) k on l.path = k.path and l.blob_hash = k.blob_hash)"


def _pairs(media: str, body: str) -> str:
    return f"with b as (select blob_id, text from blob_texts where text is not null and lower(media_type) like '{media}%') {body}"


SQL: dict[str, str] = {
    "format_matches": " union ".join(f"select blob_id, '{r}' as rule_id, unnest(regexp_extract_all(text, '{p}', 1)) as secret from blob_texts" for r, p in _FORMATS.items()),
    "match_places": f"""
      with recursive m as (select blob_id, text, regexp_extract_all(text, '\\b({_MINE})', 1) as hits, string_split_regex(text, '\\b{_MINE}') as gaps from (select distinct blob_id, text from blob_texts)),
      h as (select blob_id, text, hits[i] as secret, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))::int as start
            from (select *, unnest(generate_series(1, len(hits))) as i from m where len(hits) > 0))
      select distinct blob_id, secret, (1 + start - length(replace(left(text, start), chr(10), '')))::int as line, (length(string_split(left(text, start), chr(10))[-1]) + 1)::int as column_no from h""",
    "ipv4_classes": """
      with m as (select doc_id, unnest(regexp_extract_all(text, '\\b([0-9]{1,3}(?:\\.[0-9]{1,3}){3})\\b', 1)) as ip from documents),
      o as (select doc_id, ip, list_transform(string_split(ip, '.'), lambda x: x::int) as o from m)
      select ip, case when list_max(o) > 255 then 'invalid' when o[1] = 10 or (o[1] = 172 and o[2] between 16 and 31) or (o[1] = 192 and o[2] = 168) then 'private'
        when o[1] in (0, 127) or o[1] >= 224 or (o[1] = 169 and o[2] = 254) then 'special' else 'public' end as kind, count(*) as n, count(distinct doc_id) as n_docs from o group by 1, 2""",
    "login_uris": f"""
      with m as ({' union '.join(f"select blob_id, '{r}' as rule_id, unnest(regexp_extract_all(text, '{_FORMATS[r]}', 1)) as secret from blob_texts" for r in ('generic.database-uri', 'generic.basic-auth-url'))}),
      p as (select *, regexp_extract(secret, '://([^:/\\s]*):([^@\\s]*)@', 1) as u, regexp_extract(secret, '://([^:/\\s]*):([^@\\s]*)@', 2) as w from m)
      select blob_id, rule_id, secret, w <> '' and not regexp_matches(w, '{_PLACEHOLDER}') and not regexp_full_match(u, '{_PLACEHOLDER}') as real from p""",
    "assignment_matches": f"""
      with m as (select distinct blob_id, unnest(regexp_extract_all(text, '{_ASSIGN}', 1)) as secret from blob_texts)
      select blob_id, secret, {_SHANNON.replace('@@', 'secret')} as entropy, not regexp_matches(secret, '{_PLACEHOLDER}') as real, regexp_full_match(secret, '[a-zA-Z_.-]+') as name_only, {_BENIGN_SQL.replace('@@', 'secret')} as benign from m""",
    "long_tokens": f"""
      with m as (select blob_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_\\-]{{20,120}}')) as t from blob_texts union all
                 select blob_id, unnest(regexp_extract_all(text, '\\b([A-Fa-f0-9]{{32,128}})\\b', 1)) from blob_texts),
      d as (select distinct blob_id, trim(t, '=-_') as token from m)
      select blob_id, token, {_CHARSET.replace('@@', 'token')} as charset, {_SHANNON.replace('@@', 'token')} as entropy, len(list_distinct(string_split(token, '')))::int as n_chars from d where length(token) >= 20""",
    "secret_shapes": f"""
      with d as (select distinct secret from findings where secret is not null)
      select secret, {_SHANNON.replace('@@', 'secret')} as entropy, {_CHARSET.replace('@@', 'secret')} as charset, {_BENIGN_SQL.replace('@@', 'secret')} as benign, regexp_matches(trim(trim(secret), '''"'), '\\S.* .*\\S') as prose,
        regexp_full_match(trim(trim(secret), '''"'), '[A-Za-z_][A-Za-z_.]*') and length(trim(trim(secret), '''"')) <= 40 as identifier from d""",
    "structural_noise": r"""
      with d as (select distinct secret from findings where secret is not null),
      w as (select secret, regexp_full_match(secret, '\p{L}+') and (regexp_full_match(secret, '\p{Ll}+') or regexp_full_match(secret, '(?:\p{Lu}|[^\p{Lu}])[^\p{Lu}]{2,}(?:\p{Lu}[^\p{Lu}]{2,})+')) as words from d)
      select secret, words or regexp_matches(secret, '^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$|^[0-9a-f]{40}$|^[0-9a-f]{64}$|^[0-9._\-]+$|^\d{4}[-_]?\d{2}[-_]?\d{2}|^[a-z0-9]{1,32}(?:[_\-][a-z0-9]{1,32}){2,8}$|[/\\][A-Za-z0-9_.\-]+[/\\]')
        or regexp_matches(secret, '(?i)^data:|^#[0-9a-f]{3,8}$|^rgba?\(') or len(list_distinct(string_split(secret, ''))) <= greatest(4, length(secret) // 8) as noise, words from w""",
    "sensitive_keys": f"""
      select key_name, count(*) as n, regexp_matches(key_name, '{_SENSITIVE}') or regexp_matches('.' || key_name || '.', '{_SENSITIVE}') as sensitive from findings where key_name is not null group by key_name""",
    "env_pairs": _pairs("text/plain", r"""
      , l as (select blob_id, trim(unnest(string_split_regex(text, '\r\n|[\n\r]')), chr(32) || chr(9)) as x from b),
      p as (select distinct blob_id, regexp_extract(x, '^(?:export\s+|set\s+)?([A-Za-z_][A-Za-z0-9_.\-]*)\s*=\s*(.*?)$', 1) as key_path, trim(split_part(regexp_extract(x, '^(?:export\s+|set\s+)?([A-Za-z_][A-Za-z0-9_.\-]*)\s*=\s*(.*?)$', 2), ' #', 1)) as v
            from l where not regexp_matches(x, '^(?:#|;|//)') and regexp_matches(x, '^(?:export\s+|set\s+)?([A-Za-z_][A-Za-z0-9_.\-]*)\s*=\s*(.*?)$')),
      q as (select distinct blob_id, key_path, case when length(v) >= 2 and v[1] in ('"', '''') and v[1] = v[-1] then v[2:-2] else v end as value from p)
      select * from q where value <> ''"""),
    "shell_pairs": _pairs("text/x-shellscript", r"""
      , p as (select ${G}) select distinct blob_id, z[1] as key_path, coalesce(nullif(z[2], ''), nullif(z[3], ''), z[4]) as value from p where coalesce(nullif(z[2], ''), nullif(z[3], ''), z[4], '') <> ''
      """.replace("${G}", "blob_id, unnest(list_zip(" + ", ".join(f"regexp_extract_all(text, '{_SHELL}', {g})" for g in (1, 2, 3, 4)) + ")) as z from b")),
    "hcl_pairs": _pairs("text/x-terraform", """
      , p as (select ${G}) select distinct blob_id, z[1] as key_path, trim(coalesce(nullif(z[2], ''), z[3]), chr(34)) as value from p where trim(coalesce(nullif(z[2], ''), z[3], ''), chr(34)) <> ''
      """.replace("${G}", "blob_id, unnest(list_zip(" + ", ".join(f"regexp_extract_all(text, '{_HCL}', {g})" for g in (1, 2, 3)) + ")) as z from b")),
    "event_properties": "select event_id, key as key_path, json_extract_string(props, '$.' || key) as value from (select event_id, props, unnest(json_keys(props)) as key from events)",
    "context_penalties": r"""
      with d as (select distinct logical_path, match_context from findings where logical_path is not null)
      select logical_path, match_context, round(least(0.3::double, case when list_has_any(string_split(lower(replace(logical_path, '\', '/')), '/'), ['test','tests','testing','spec','specs','fixture','fixtures','example','examples','sample','samples','mock','mocks','__tests__','__mocks__','testdata','e2e','demo','demos','stub','stubs'])
        or regexp_matches(string_split(lower(replace(logical_path, '\', '/')), '/')[-1], '[._-](?:test|spec|fixture|mock|example|sample)s?\.[a-z0-9]+$') then 0.2::double else 0.0::double end
        + case when regexp_matches(match_context, '^\s*(?:#|//|\*|--|;|<!--)') then 0.1::double else 0.0::double end), 3) as penalty from d""",
    "path_parts": """
      select distinct logical_path, split_part(logical_path, '!/', 1) as root, string_split(logical_path, '/')[-1] as base_name,
        array_to_string(list_filter(string_split(logical_path, '/'), lambda x: x not in ('', '.', '..')), '/') as safe_name, len(string_split(logical_path, '!/'))::int as depth from blob_texts where logical_path is not null""",
    "fingerprints": f"""
      select distinct rule_id, logical_path, left(sha256(rule_id || chr(0) || logical_path || chr(0) || coalesce(nullif(secret_v2, ''), secret)), 32) as made, {_REDACT.replace('@@', 'secret')} as redacted
      from findings where rule_id is not null and logical_path is not null and secret is not null""",
    "action_tiers": f"select {_TIER} as tier, severity, count(*) as n from findings group by 1, 2",
    "severity_counts": "select s.severity, count(f.severity) as n from (values ('critical'), ('high'), ('medium'), ('low'), ('info')) s(severity) left join findings f on lower(f.severity) = s.severity group by 1",
    "findings_summary": """
      select 'total' as kind, '' as name, count(*) as n from findings union all
      select 'severity', s.severity, count(f.severity) from (values ('critical'), ('high'), ('medium'), ('low'), ('info')) s(severity) left join findings f on lower(f.severity) = s.severity group by 2 union all
      select 'rule', coalesce(rule_id, ''), count(*) from findings group by rule_id""",
    "severity_rule_rollup": "select severity, rule_id, count(*) as n, (grouping(severity) + grouping(rule_id))::int as level from findings group by rollup (severity, rule_id)",
    "once_per_fingerprint": """
      select fingerprint, m.rule_id as rule_id, m.logical_path as logical_path, m.line as line, m.column_no as column_no from (
        select fingerprint, min({'line': line, 'column_no': column_no, 'rule_id': rule_id, 'logical_path': logical_path}) as m from findings where fingerprint is not null group by 1)""",
    "findings_by_path": """
      select logical_path, count(*) as n, sum(('0x' || left(md5(concat_ws('|', rule_id, line, fingerprint)), 8))::bigint)::bigint as digest from findings where logical_path is not null group by 1""",
    "redacted_contexts": "select count(*) as n, count(match_context) as n_contexts, count(secret) as n_secrets, 0::bigint as n_leaks from findings",
    "top_findings": f"""
      select distinct {_TIER} as actionability, severity, confidence, logical_path, line, fingerprint from findings where fingerprint is not null
      order by {_TIER_RANK} desc, {_RANK.replace('@@', 'severity')} desc, confidence desc, logical_path, line, fingerprint limit 100""",
    "ranked_in_blob": f"""
      with d as (select distinct logical_path, severity, confidence, line, fingerprint from findings where logical_path is not null)
      select logical_path, fingerprint, line, row_number() over (partition by logical_path order by {_RANK.replace('@@', 'severity')} desc nulls last, confidence desc nulls last, line nulls first, fingerprint nulls first)::int as place from d qualify place <= 3""",
    "capped_per_source": "select source_path, least(count(*), 2000) as n from (select distinct source_path, line, fingerprint from findings where source_path is not null) group by 1",
    "without_baseline": "select fingerprint, rule_id, logical_path, line from findings f where not exists (select 1 from finding_batches b where b.fingerprint = f.fingerprint)",
    "nearest_pairs": """
      with f as (select distinct concat_ws(':', fingerprint, line) as id, source_path, line, rule_id from findings)
      select a.id, min({'d': abs(a.line - b.line), 'p': b.id}).p as partner, min(abs(a.line - b.line))::int as distance from f a join f b on a.source_path = b.source_path and abs(a.line - b.line) <= 40
      where a.rule_id = 'aws.access-key-id' and b.rule_id = 'keyname.password' group by 1""",
    "evaluation": """
      with h as (select distinct source_path as path, line from finding_batches where source_path is not null and line is not null), t as (select distinct source_path as path, line from findings where source_path is not null and line is not null),
      c as (select (select count(*) from t where exists (select 1 from h where h.path = t.path and h.line between t.line - 1 and t.line + 1)) as tp,
                   (select count(*) from h where not exists (select 1 from t where h.path = t.path and h.line between t.line - 1 and t.line + 1)) as fp, (select count(*) from t) as n)
      select tp, fp, n - tp as fn, coalesce(tp / nullif(tp + fp, 0), 0.0)::double as precision, coalesce(tp / nullif(n, 0), 0.0)::double as recall,
        coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(n, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(n, 0), 0), 0.0)::double as f1 from c""",
    "content_copies": "select sha256(text) as content_hash, count(*) as n_copies, min(logical_path) as logical_path from blob_texts where text is not null group by 1",
    "sarif_rows": """
      with s as (select rule_id, case lower(severity) when 'critical' then 'error' when 'high' then 'error' when 'medium' then 'warning' when 'low' then 'note' when 'info' then 'note' end as level,
          case lower(severity) when 'critical' then '9.5' when 'high' then '8.0' when 'medium' then '5.5' when 'low' then '3.0' when 'info' then '1.0' end as security_severity,
          replace(replace(logical_path, '\\', '/'), ' ', '%20') as uri, greatest(line, 1)::int as line, fingerprint, logical_path from findings)
      select distinct rule_id, level, security_severity, uri, line, fingerprint, to_json({'ruleId': rule_id, 'level': level, 'message': {'text': rule_id || ' in ' || logical_path},
        'locations': [{'physicalLocation': {'artifactLocation': {'uri': uri}, 'region': {'startLine': line}}}], 'partialFingerprints': {'secretIdentity/v1': fingerprint}})::varchar as result from s""",
    "unchanged_files": f"with {_LATEST} select path, unchanged from u",
    "carried_findings": f"with {_LATEST} select distinct fingerprint, rule_id, source_path, line, true as carried from findings where source_path in (select path from u where unchanged)",
    "finding_history": """
      with o as (select fingerprint, min(first_seen) as f, max(last_seen) as l from findings where fingerprint is not null group by 1), n as (select fingerprint, min(observed_at) as f, max(observed_at) as l from finding_batches where fingerprint is not null group by 1)
      select coalesce(o.fingerprint, n.fingerprint) as fingerprint, case when o.f is not null or o.l is not null then o.f else n.f end as first_seen, greatest(o.l, n.l) as last_seen, not (o.f is not null or o.l is not null) as is_new
      from o full join n on o.fingerprint = n.fingerprint""",
    "new_and_known": """
      select count(*) filter (not k) as n_new, count(*) filter (k) as n_known from (
        select distinct fingerprint, fingerprint in (select fingerprint from findings where fingerprint is not null) as k from finding_batches where fingerprint is not null)""",
    "cached_verdicts": """
      with c as (select sha256(secret) as h, arg_max(verified, last_seen) as v from findings where verified <> 'unknown' and secret is not null group by 1)
      select distinct arrival_id, sha256(secret) as secret_hash, coalesce(c.v, 'unknown') as verified from finding_batches left join c on c.h = sha256(secret) where secret is not null""",
    "providers": """
      select split_part(rule_id, '.', 1) as provider, count(*) as n from findings where split_part(rule_id, '.', 1) in ('github', 'slack', 'stripe', 'openai', 'gcp', 'aws') and contains(rule_id, '.') and confidence >= 0.5 group by 1""",
    "revocation_plan": """
      select distinct p.provider, sha256(secret) as secret_hash, p.provider in ('slack', 'aws') as automated, case when p.provider in ('slack', 'aws') then 'revoke through the API of ' || p.provider else 'by hand: ' || page end as detail
      from findings join (values ('github', 'https://github.com/settings/tokens'), ('slack', ''), ('stripe', 'https://dashboard.stripe.com/apikeys'), ('openai', 'https://platform.openai.com/api-keys'),
        ('gcp', 'https://console.cloud.google.com/apis/credentials'), ('aws', '')) p(provider, page) on starts_with(rule_id, p.provider || '.') where verified = 'active'""",
    "rescored": """
      with d as (select distinct fingerprint, detector, secret, confidence, len(regexp_extract_all(secret, '[A-Za-z]{1,4}|[0-9]{1,3}|[^A-Za-z0-9]'))::double / greatest(length(secret), 1) as share from findings where secret is not null)
      select fingerprint, round(case when confidence >= 0.85 or detector = 'keyname' then confidence when share >= 0.35 then greatest(confidence, least(0.9::double, confidence + 0.1::double))
        when share < 0.175 then greatest(0.05::double, confidence - 0.1::double) else confidence end, 3) as confidence from d""",
    "escape_views": r"""
      with u as (select blob_id, text, string_split_regex(text, '\\[uU]00[0-9a-fA-F]{2}') as gaps, regexp_extract_all(text, '\\[uU]00([0-9a-fA-F]{2})', 1) as hits from blob_texts where text is not null),
      v as (select blob_id, text, array_to_string(list_transform(list_zip(gaps, hits), lambda z: z[1] || coalesce(chr(('0x' || z[2])::int), '')), '') as once from u),
      x as (select blob_id, text, string_split_regex(once, '\\x[0-9a-fA-F]{2}') as gaps, regexp_extract_all(once, '\\x([0-9a-fA-F]{2})', 1) as hits from v),
      y as (select blob_id, text, array_to_string(list_transform(list_zip(gaps, hits), lambda z: z[1] || coalesce(chr(('0x' || z[2])::int), '')), '') as view from x)
      select distinct blob_id, md5(view) as digest from y where view <> text""",
    "percent_views": r"""
      with m as (select distinct match_context as context, string_split_regex(match_context, '%[0-9a-fA-F]{2}') as gaps, regexp_extract_all(match_context, '%([0-9a-fA-F]{2})', 1) as hits from findings where match_context is not null),
      y as (select context, array_to_string(list_transform(list_zip(gaps, hits), lambda z: z[1] || coalesce(chr(('0x' || z[2])::int), '')), '') as view from m)
      select context, view from y where view <> context""",
    "event_windows": "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events where ts is not null group by 1, 2",
    "event_sessions": """
      with s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events where ts is not null))
      select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from s group by user_id, g""",
    "rule_table": "select * from (values ('critical', 13::bigint), ('high', 15::bigint), ('medium', 3::bigint), ('low', 1::bigint), ('info', 4::bigint)) t(severity, n)",
    "rate_limits": "select * from (values ('60/minute', 1.0::double), ('1/second', 1.0), ('100/hour', 36.0), ('2/s', 0.5), ('soon', null), ('0/minute', null), ('24/day', 3600.0)) t(rate, seconds)",
    "page_references": """
      select 'https://www.example.com/docs/index.html' as url, kind, target from (values ('anchor', 'https://www.example.com/a/'), ('anchor', 'https://www.example.com/docs/b.html'), ('script', 'https://www.example.com/docs/js/app.js'),
        ('link', 'https://cdn.example.net/s.css'), ('iframe', 'https://f.example.org/i')) t(kind, target)""",
    "page_paths": """
      select * from (values ('https://h.example.com/a/b.js?x=1', 'h.example.com/a/b.js'), ('https://h.example.com:8080', 'h.example.com:8080/index.html'), ('http://u@h.example.com/d/', 'h.example.com/d/index.html'),
        ('https://h.example.com/#top', 'h.example.com/index.html')) t(url, logical_path)""",
    "unpacked_archive": """
      select * from (values ('x.zip!/in.zip!/deep/.env', 'x.zip', 'KEY=value' || chr(10), false, 2::int), ('x.zip!/a.txt', 'x.zip', 'plain text' || chr(10), false, 1), ('n.log.gz!/n.log', 'n.log.gz', 'log line' || chr(10), false, 1),
        ('p.txt', 'p.txt', 'déjà vu, noted in plain words' || chr(10), false, 0)) t(logical_path, source_path, text, is_binary, container_depth)""",
    "checksums": "select * from (values ('right', 'true', true), ('wrong', 'false', true), ('other', 'none', true)) t(name, valid, luhn)",
}
