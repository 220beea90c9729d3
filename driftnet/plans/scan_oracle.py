"""SQL that finds, checks and places what the rule pass of a scan reports, for DuckDB.

Patterns, guards and fixed values come from the rule table and the validators;
everything else (positions, checks, checksums, links of pairs, one row per
value) is said again in SQL.  DuckDB's expressions have no look-around, so the
few rules that use it are stated without and filtered after.
"""

from __future__ import annotations

import re

from driftnet.functions import entropy, scope, validate
from driftnet.plans.rules import BUILT_IN, PAIRS, Rule

_SHANNON = "coalesce((select -sum(p * log2(p)) from (select count(*)::double / length(@@) as p from (select unnest(string_split(@@, '')) as c) group by c)), 0.0)"
_RUN = r"[:.\w]+"
# crc32 over single-byte characters: a fold over bytes, and inside it one over eight shifts.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(@@, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain(rule: Rule) -> tuple[str, str]:
    """(pattern without look-around, condition on what it finds)."""
    if rule.rule_id == "generic.ipv6":
        # What no word character, dot or colon touches is a whole run of these.
        inner = re.fullmatch(r"\(\?=\[[^\]]*\]\)\(\?<![^)]*\)(.*)\(\?![^)]*\)", rule.pattern).group(1)
        return _RUN, f"regexp_full_match(s, {_q(inner)})"
    pattern = re.sub(r"\(\?=[^()]*\)", "", rule.pattern)
    no = re.search(r"\(\?!([^)]*)\)", pattern)
    pattern = re.sub(r"\(\?![^)]*\)", "", pattern)
    return pattern, f"not contains(s, {_q({'ant-': 'sk-ant-', 'localhost': '://localhost'}[no.group(1)])})" if no else "true"


BLOBS = "select distinct logical_path, text, coalesce(line_offset, 0) as line_offset, coalesce(commit_line, 0) as commit_line from blob_texts where logical_path is not null and text <> ''"
DOCUMENTS = "select distinct concat_ws('/', coalesce(repo, 'documents'), doc_id || '.txt') as logical_path, text, 0 as line_offset, 0 as commit_line from documents where text <> ''"


def token_scan_sql(blobs: str = BLOBS) -> str:
    """logical_path, rule_id, line, column_no, secret of the entropy pass: long random tokens."""
    raw = " union all ".join(
        f"select b.*, {i} as rule_ord, regexp_extract_all(text, {_q(p)}, 0) as w, string_split_regex(text, {_q(p)}) as gaps from b where regexp_matches(text, {_q(p)})"
        for i, p in enumerate((r"[A-Za-z0-9+/=_\-]{20,120}", r"\b[A-Fa-f0-9]{32,128}\b")))
    noisy = " or ".join(["contains(lower(logical_path), '/node_modules/')", *(f"ends_with(lower(logical_path), {_q(x)})" for x in entropy.NOISY)])
    published = ", ".join(_q(p) for p in validate.PUBLISHED)
    limit = "case charset " + " ".join(f"when '{k}' then case when NOISY then {hi} else {lo} end" for k, (lo, hi) in entropy.THRESHOLD.items()) + " end"
    return rf"""
      with b as ({blobs}), raw as ({raw}), m as (select *, unnest(generate_series(1, len(w))) as i from raw),
      h as (select logical_path, text, line_offset, commit_line, rule_ord, w[i] as found,
              (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda g: length(g))), 0))::int as pos from m),
      c as (select *, trim(found, '=-_') as secret, pos + length(found) - length(ltrim(found, '=-_')) as start from h),
      k as (select *, case when regexp_full_match(secret, '[A-Fa-f0-9]+') then 'hex' else 'base64' end as charset, {_SHANNON.replace('@@', 'secret')} as bits from c
            where length(secret) >= 20 and secret not in ({published}) and not regexp_matches(secret, '^[0-9a-fA-F]{{8}}-(?:[0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}$|^[0-9a-f]{{40}}$|^[0-9a-f]{{64}}$|^[0-9._\-]+$|^\d{{4}}[-_]?\d{{2}}[-_]?\d{{2}}')
              and not regexp_matches(secret, '^[a-z0-9]{{1,32}}(?:[_\-][a-z0-9]{{1,32}}){{2,8}}$|[/\\][A-Za-z0-9_.\-]+[/\\]|(?i:^data:|^#[0-9a-f]{{3,8}}$|^rgba?\()') and len(list_distinct(string_split(secret, ''))) > greatest(4, length(secret) // 8)
              and not (regexp_full_match(secret, '\p{{L}}+') and (regexp_full_match(secret, '\p{{Ll}}+') or regexp_full_match(secret, '(?:\p{{Lu}}|[^\p{{Lu}}])[^\p{{Lu}}]{{2,}}(?:\p{{Lu}}[^\p{{Lu}}]{{2,}})+')))),
      t as (select * from k where bits >= {limit.replace('NOISY', 'false')} and bits >= {limit.replace('NOISY', noisy)}),
      p as (select *, 1 + length(left(text, start)) - length(replace(left(text, start), chr(10), '')) as at_line, string_split(left(text, start), chr(10))[-1] as before, string_split(substr(text, start + 1), chr(10))[1] as after from t),
      l as (select * from p where at_line >= commit_line and not regexp_matches(case when length(before || after) > 4096 then right(before, 512) || left(after, 512) else before || after end, {_q(validate.IGNORE_LINE)})
              and not regexp_matches(case when length(before || after) > 320 then right(before, 160) || left(after, 160) else before || after end, {_q(entropy.SAFE_LINE)}))
      select logical_path, rule_id, x.line::int as line, x.column_no::int as column_no, secret from (
        select logical_path, 'entropy.' || charset as rule_id, secret, min({{'rule_ord': rule_ord, 'line': at_line + line_offset, 'start': start, 'column_no': length(before) + 1}}) as x from l group by 1, 2, 3)"""


def path_scope_sql() -> str:
    """path, extension, categories, boost, allowed, denied of the paths of ``files``."""
    def among(column: str, values) -> str:  # noqa: ANN001
        return f"{column} in ({', '.join(_q(v) for v in values)})"

    def globbed(patterns) -> str:  # noqa: ANN001
        joined = _q("|".join(scope.glob_regex(p).replace("(?>", "(?:") for p in patterns))
        return f"regexp_matches(p, {joined}) or regexp_matches(base, {joined})"

    more = {"config": "starts_with(lower(base), '.env')", "vcs": "regexp_matches(p, '(?:^|/)\\.git/')", "sourcemap": "regexp_matches(lower(base), '\\.(?:js|css)\\.map$')",
            "archive": "regexp_matches(lower(base), '\\.(?:tar\\.(?:gz|bz2|xz)|sql\\.gz)$')"}
    kinds = []
    for name in sorted(scope.CATEGORIES):
        spec = scope.CATEGORIES[name]
        tests = [among("ext", spec["ext"])] if spec.get("ext") else []
        tests += [among("lower(base)", [n.lower() for n in spec["name"]])] if spec.get("name") else []
        tests += [globbed(spec["glob"])] if spec.get("glob") else []
        tests += [more[name]] if name in more else []
        kinds.append(f"case when {' or '.join(tests)} then '{name}' end")
    weights = ", ".join(f"({_q(k)}, {v}::double)" for k, v in scope.WEIGHTS.items())
    denied = " or ".join([f"list_has_any(string_split(p, '/')[1:-2], [{', '.join(_q(d) for d in scope.DENIED_FOLDERS)}])", *(f"contains(p, {_q(x)})" for x in scope.DENIED_PARTS)])
    return rf"""
      with d as (select distinct path, replace(path, '\', '/') as p from files where path is not null),
      e as (select *, string_split(p, '/')[-1] as base, lower(regexp_extract(string_split(p, '/')[-1], '^.+\.([^.]*)$', 1)) as ext from d),
      k as (select *, list_filter([{', '.join(kinds)}], lambda x: x is not null) as kinds from e)
      select path, ext as extension, array_to_string(kinds, ',') as categories, coalesce((select max(w) from (values {weights}) t(c, w) where list_contains(kinds, c)), 0.0::double) as boost,
        not {among('ext', scope.DENIED_EXTENSIONS)} as allowed, {denied} as denied from k"""


def rule_scan_sql(blobs: str = BLOBS) -> str:
    """logical_path, rule_id, line, column_no, secret, secret_v2 of the rule pass, endpoints included."""
    raw, meta = [], []
    for i, rule in enumerate(BUILT_IN):
        pattern, fits = _plain(rule)
        guards = " or ".join(f"contains(lower(text), {_q(g)})" for g in rule.guards) or "true"
        raw.append(f"select b.*, {i} as rule_ord, {rule.group} as grp, regexp_extract_all(text, {_q(pattern)}, 0) as w, regexp_extract_all(text, {_q(pattern)}, {rule.group}) as s, "
                   f"string_split_regex(text, {_q(pattern)}) as gaps, list_transform(regexp_extract_all(text, {_q(pattern)}, {rule.group}), lambda s: {fits}) as fits from b where ({guards}) and regexp_matches(text, {_q(pattern)})")
        harmless = "|".join(f"(?:{validate.HARMLESS_NAME if h == 'name' else h})" for h in rule.harmless)
        meta.append(f"({i}, {_q(rule.rule_id)}, {_q(rule.check)}, {rule.min_entropy}::double, {'generic' in rule.tags}, {_q(harmless)})")
    published = ", ".join(_q(p) for p in validate.PUBLISHED)
    pairs = ", ".join(f"({_q(a)}, {_q(b)}, {n}, {k})" for k, (a, b, n) in enumerate(PAIRS))
    benign = f"(length(trim(secret)) < 6 or regexp_matches(trim(secret), {_q(validate.BENIGN)}))"
    return rf"""
      with b as ({blobs}),
      raw as ({" union all ".join(raw)}),
      m as (select *, unnest(generate_series(1, len(w))) as i from raw),
      h as (select logical_path, text, line_offset, commit_line, rule_ord, s[i] as found,
              (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda g: length(g))), 0) + case when grp = 0 then 0 else greatest(instr(w[i], s[i]) - 1, 0) end)::int as pos
            from m where fits[i]),
      r(rule_ord, rule_id, chk, min_entropy, is_generic, harmless) as (values {", ".join(meta)}),
      c as (select h.*, r.* exclude (rule_ord), regexp_replace(regexp_replace(found, '^\s+|\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g') as secret,
              pos + length(regexp_extract(found, '^\s*["'']*')) as start from h join r using (rule_ord)),
      v as (select *, regexp_extract(secret, '://([^:/\s]*):([^@\s]*)@', 1) as login, regexp_extract(secret, '://([^:/\s]*):([^@\s]*)@', 2) as word,
              case when chk in ('private-ip', 'public-ip') then list_transform(string_split(secret, '.'), lambda x: x::int) end as o,
              regexp_extract(secret, '^(?:gh[pousr]|github_pat)_(.+)$', 1) as body, string_split(secret, '.') as parts from c where secret <> '' and secret not in ({published})),
      k as (select *, case when list_max(o) > 255 then '' when o[1] = 10 or (o[1] = 172 and o[2] between 16 and 31) or (o[1] = 192 and o[2] = 168) then 'private-ip'
              when o[1] in (0, 127) or o[1] >= 224 or (o[1] = 169 and o[2] = 254) then '' else 'public-ip' end as ip,
              translate(parts[1], '-_', '+/') as head from v),
      f as (select * from k where
          case chk when 'real' then not regexp_matches(secret, {_q(validate.PLACEHOLDER)})
            when 'login' then word <> '' and not regexp_matches(word, {_q(validate.PLACEHOLDER)}) and not regexp_full_match(login, {_q(validate.PLACEHOLDER)})
            when 'private-ip' then ip = chk when 'public-ip' then ip = chk
            when 'jwt' then len(parts) = 3 and coalesce(try(json_exists(decode(from_base64(rpad(head, ((length(head) + 3) // 4 * 4)::int, '='))), '$.alg')), false)
            when 'github' then length(body) < 7 or {_CRC.replace('@@', 'left(body, length(body) - 6)')}
              = list_reduce(list_prepend(0::bigint, list_transform(string_split(right(body, 6), ''), lambda d: (instr({_q(validate.BASE62)}, d) - 1)::bigint)), lambda n, d: n * 62 + d)
            else true end
          and (min_entropy = 0 or {_SHANNON.replace('@@', 'secret')} >= min_entropy) and not (harmless <> '' and regexp_matches(secret, harmless)) and not (is_generic and {benign})),
      p as (select *, 1 + length(left(text, start)) - length(replace(left(text, start), chr(10), '')) as at_line, string_split(left(text, start), chr(10))[-1] as before, string_split(substr(text, start + 1), chr(10))[1] as after from f),
      l as (select logical_path, line_offset, rule_ord, rule_id, start, secret, at_line + line_offset as line, length(before) + 1 as column_no from p
            where at_line >= commit_line and not regexp_matches(case when length(before || after) > 4096 then right(before, 512) || left(after, 512) else before || after end, {_q(validate.IGNORE_LINE)})),
      ps(id_rule, secret_rule, reach, pair) as (values {pairs}),
      -- the secret nearest to each id, the first met of several
      n as (select a.logical_path, a.line_offset, a.rule_ord, a.start, a.secret, a.line, ps.pair, min((abs(z.line - a.line), z.rule_ord, z.start, z.secret)) as best, any_value(reach) as reach
            from (select distinct * from l) a join ps on a.rule_id = ps.id_rule join (select distinct * from l) z on z.rule_id = ps.secret_rule and z.logical_path = a.logical_path and z.line_offset = a.line_offset group by 1, 2, 3, 4, 5, 6, 7),
      near as (select * from n where best[1] <= reach),
      chosen as (select logical_path, line_offset, best[2] as rule_ord, best[3] as start, arg_max(secret, (rule_ord, start, line, secret)) as id from near group by 1, 2, 3, 4),
      linked as (select l.*, coalesce(near.secret || ':' || near.best[4], chosen.id || ':' || l.secret) as secret_v2 from l
            left join near on (near.logical_path, near.line_offset, near.rule_ord, near.start, near.secret, near.line) = (l.logical_path, l.line_offset, l.rule_ord, l.start, l.secret, l.line)
            left join chosen on (chosen.logical_path, chosen.line_offset, chosen.rule_ord, chosen.start) = (l.logical_path, l.line_offset, l.rule_ord, l.start))
      select logical_path, rule_id, x.line::int as line, x.column_no::int as column_no, secret, secret_v2 from (
        select logical_path, rule_id, secret, secret_v2, min({{'line': line, 'start': start, 'column_no': column_no}}) as x from linked group by 1, 2, 3, 4)"""
