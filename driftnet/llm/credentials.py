"""Problem 5: credentials embedded in source code and configuration.

Method: each line is tokenised lexically (string literals with their escapes,
identifiers, operators, bare words); literals that are assigned or passed to a
credential-named identifier are flagged unless they are placeholders,
references, masked, hashed or encrypted.  Literals whose own format is a
credential (provider tokens, signed tokens, private keys, logins in URLs,
authorization headers, command-line passwords) are flagged whatever they are
assigned to, also after undoing concatenation, base64 (however often, and over
lines), hex, percent and character escapes.  Redaction replaces the contents of the literal only: quotes, escapes,
prefixes of the syntax and everything around stay byte for byte.

One narrow stage: no shuffle before the de-duplication of repeated rows.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.common import LINE_BREAK, one_text
from driftnet.storage import spread


class Hit(NamedTuple):
    """Where a credential value stands in a text (code points), and its kind; of the
    kind "continued" is what stands of a value on lines after its first."""

    start: int
    end: int
    kind: str


# --- identifiers --------------------------------------------------------------------
# Last words of identifiers that hold credentials, by language.
_SECRET_WORDS = frozenset(
    "password passwd pwd pass passphrase passcode pw secret token apikey credential credentials creds kennwort passwort "
    "contrasena contraseña senha parola clave motdepasse wachtwoord haslo hasło lozinka пароль 密码 密碼 パスワード pin accesstoken "
    "authtoken secretkey privatekey accesskey userpass dbpass dbpassword clientsecret bearer authkey psk".split())
# Words that make "key" a credential.
_KEY_OWNERS = frozenset("api secret access private encryption signing auth master tls host ssh service account storage shared crypt deploy hmac webhook app jwt session license".split())
_PIECE = re.compile(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|[^\W\d_A-Za-zÀ-ÿ]+|\d+")


@lru_cache(maxsize=1 << 14)
def names_credential(identifier: str) -> bool:
    """Whether an identifier (snake, kebab, camel, dotted) names a credential value."""
    words = [w.lower() for w in _PIECE.findall(identifier)]
    while words and words[-1].isdigit():
        words.pop()
    if words and words[-1] in ("value", "plain", "plaintext", "old", "new", "prod", "dev", "test", "base64", "b64"):
        words.pop()
    if not words:
        return False
    last = words[-1]
    if last in ("public", "pub"):
        return False
    if last in _SECRET_WORDS:
        return not (last in ("token", "pin", "bearer") and len(words) > 1 and words[-2] in ("csrf", "xsrf", "page", "next", "cancel"))
    if last in ("key", "keys"):
        return len(words) > 1 and words[-2] in _KEY_OWNERS and "public" not in words
    if last in ("passe",) and words[-3:] == ["mot", "de", "passe"]:
        return True
    if last in ("auth", "authorization") and len(words) > 1 and words[-2] in ("basic", "http", "proxy", "smtp", "redis", "registry"):
        return True
    if last in ("sas", "dsn"):
        return False
    return len(words) == 1 and any(last.endswith(w) and len(last) <= len(w) + 6 and len(w) >= 6 for w in ("password", "passwd", "secret", "apikey", "passphrase"))


# --- values -------------------------------------------------------------------------
_REFERENCE = re.compile(
    r"""^(?:\$\{?\w[\w.\-]*\}?|\$\(.*\)|\$\{\{.*\}\}|\{\{.*\}\}|\{%.*%\}|<%.*%>|%\(\w+\)s|%\w+%|\#\{.*\}|@\w+@|@\{.*\}|![A-Z]?[a-z]+(?:[A-Z][a-z]+)*(?:[\s.].*)?|\{\w*\}|<[^>]*>|\[[^\]]*\]|\{[^}]*\}
    |(?:vault|file|env|secret|secrets|ssm|aws|gcp|azure|arn|kms|op|keyring|akv|sm|https?|s3|gs|ref|k8s|doppler|sops|config|credstash|keychain|parameter)[:+][^@]*
    |(?:data|urn):.*
    |/[\w./\-]+|\.{1,2}/[\w./\-]+|~/[\w./\-]+|[A-Za-z]:\\.*
    |(?:\w+\.)*\w+\(.*\)?|\w+(?:\.\w+)*\[.*\]?
    )$""", re.X | re.S)
_DOTTED = re.compile(r"^(?:[A-Za-z_]\w*(?:\.|->|::))+[A-Za-z_]\w*$")
_PLACEHOLDER = re.compile(
    r"""(?i)^(?:
    (?:[x*.\-_\#•0?yz]|(?!0)\d{1,3}x){3,}|\W*|
    .*(?:x{6,}|\*{3,}|•{3,}|\.{3,}|…|0{8,}).*|
    (?:change|replace|insert|enter|fill|put|set|add|your|my|some|the)[\s_\-]?.*(?:me|here|please|this|key|token|password|secret|value|pass).*|
    .*\b(?:placeholder|redacted|masked|removed|hidden|example|sample|dummy|changeme|change[_\-]me|replaceme|replace[_\-]me|fake|todo|fixme|tbd|not[_\-]?set|unset|your[_\-])(?:\b|_).*|
    (?:todo|tbd|fixme|none|null|nil|undefined|empty|n/?a|true|false|yes|no|on|off|default|disabled|enabled|required|optional|basic|bearer|digest|oauth2?|jwt|saml|ldap|plain|plaintext|string|str|text|password|passwd|secret|token|api[_\-]?key|key|pass|pwd|test|tests|testing|foo|bar|baz|admin|root|user|username|guest|anonymous|prompt|auto|manual|inherit|unknown|missing|invalid|expired|rotated|strict|strong|weak|hidden|secret_?name|name|value|sops|vault|env|keychain|keyring|interactive|nan|void)
    )$""", re.X)
_HASHED = re.compile(
    r"""(?i)^(?:
    \$(?:2[abxy]?|1|5|6|y|argon2\w*|pbkdf2[\w\-]*|scrypt|apr1|bcrypt)\$.*|\{(?:ssha|sha|md5|crypt|smd5|ssha\d+|pbkdf2\S*)\}.*|
    (?:pbkdf2|scrypt|bcrypt|argon2\w*|sha\d+|md5|sha)[:$\-_].*|
    [0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|
    [0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}
    )$""", re.X)
_ENCRYPTED = re.compile(r"(?i)^(?:ENC\[|ENC\(|\$ANSIBLE_VAULT|age1|AGE-ENC|vault:v\d|AQICAH|\{cipher\}|enc:|encrypted:|gAAAAA|-----BEGIN (?:PGP MESSAGE|AGE ENCRYPTED|ENCRYPTED|PUBLIC|CERTIFICATE|SSH2 PUBLIC|RSA PUBLIC|EC PUBLIC)|ssh-(?:rsa|ed25519|dss)|ecdsa-)")
_PROSE = re.compile(r"^[^\W\d]+(?:[ ,;][^\W\d]+)+[.!?]?$")


def _masked(value: str) -> bool:
    """Repeats of one character where a token should be random."""
    run = re.search(r"([^\W_])\1{5,}", value)
    return bool(run) or value.count("*") >= 3


@lru_cache(maxsize=1 << 14)
def is_value(value: str, quoted: bool, key: str = "") -> bool:
    """Whether a literal given to a credential-named identifier is a credential."""
    v = value.strip()
    if len(v) < 4 or _PLACEHOLDER.match(v) or _ENCRYPTED.match(v) or _HASHED.match(v) or _masked(v):
        return False
    if re.fullmatch(r"[A-Za-z0-9/+]{40}", v) and re.search(r"(?i)secret", key) and re.search(r"\d", v) and re.search("[A-Z]", v) and re.search("[a-z]", v):
        return True  # 40 base64 characters may begin like a path
    if _REFERENCE.match(v):
        return False
    if _DOTTED.match(v) and (not quoted and not re.search(r"\d", v) or v.isupper() or not re.search(r"\d|[a-z][A-Z]{2}", v)):
        return False
    if v.isdigit():
        return len(v) >= 6 and quoted
    if re.fullmatch(r"-?[\d.,:%/ ]+[a-z]{0,3}", v):
        return False
    if " " in v and (not quoted or _PROSE.match(v)):
        # A passphrase of several words is only one when quoted and assigned to such a name.
        return quoted and bool(re.search(r"(?i)phrase", key)) and len(v.split()) >= 3
    if not quoted and re.fullmatch(r"[A-Z][A-Z0-9_]*", v) and "_" in v:
        return False
    if re.fullmatch(r"[A-Z]+(?:_[A-Z]+)+", v):
        return False
    if re.fullmatch(r"[a-z]+(?:[_\-][a-z]+)*", v) and not strong(v):
        # A lone lower-case word is a value only where nothing else can be meant.
        return quoted and len(v) >= 8 and "_" not in v and "-" not in v and key.lower() not in v
    return True


def strong(value: str) -> bool:
    """Whether a bare word looks chosen as a secret: long and of mixed classes."""
    if len(value) < 8:
        return False
    classes = bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search(r"\d", value)) + bool(re.search(r"[^\w]|_", value))
    return classes >= 3 or classes == 2 and bool(re.search(r"\d", value)) and bool(re.search("[A-Za-z]", value))


# --- formats that are credentials by themselves ---------------------------------------
# Published token formats.
_TOKEN = re.compile(
    r"""(?<![A-Za-z0-9])(?=[AGPSdeghlnprswxy\d])(?:
    (?P<aws>(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16})(?![A-Za-z0-9*])
    |(?P<github>gh[pousr]_[A-Za-z0-9]{30,255}|github_pat_[A-Za-z0-9_]{22,255})
    |(?P<gitlab>gl(?:pat|rt|ft|soat|cbt|ptt|dt)-[A-Za-z0-9_\-]{16,})
    |(?P<slack>xox[abeposr]-[A-Za-z0-9\-]{10,}|xapp-\d-[A-Za-z0-9\-]{20,})
    |(?P<slackhook>https://hooks\.slack\.com/(?:services|workflows)/[A-Za-z0-9/_+]{20,})
    |(?P<stripe>[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9+/=]{24,})
    |(?P<google>AIza[A-Za-z0-9_\-]{35}|GOCSPX-[A-Za-z0-9_\-]{28}|ya29\.[A-Za-z0-9_\-]{30,}|1//0[A-Za-z0-9_\-]{30,})
    |(?P<sendgrid>SG\.[A-Za-z0-9_\-]{16,32}\.[A-Za-z0-9_\-]{32,64})
    |(?P<npm>npm_[A-Za-z0-9]{36})
    |(?P<pypi>pypi-[A-Za-z0-9_\-]{40,})
    |(?P<openai>sk-(?:proj-|svcacct-|ant-(?:api|admin)\d\d-)?[A-Za-z0-9_\-]{32,})
    |(?P<telegram>\d{8,10}:AA[A-Za-z0-9_\-]{32,33})
    |(?P<twilio>SK[0-9a-f]{32})
    |(?P<vault>hv[sbr]\.[A-Za-z0-9_\-]{24,})
    |(?P<misc>dop_v1_[0-9a-f]{64}|dckr_pat_[A-Za-z0-9_\-]{20,}|hf_[A-Za-z]{34}|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}|AGE-SECRET-KEY-1[0-9A-Z]{58}|lin_api_[A-Za-z0-9]{40}|PMAK-[0-9a-f]{24}-[0-9a-f]{34}|dapi[0-9a-f]{32}|rubygems_[0-9a-f]{48}|sq0(?:csp|atp)-[A-Za-z0-9_\-]{22,43})
    |(?P<jwt>eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})
    )(?![A-Za-z0-9*])""", re.X)
_URL_LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?P<user>[^\s:/@'\"<>]*):(?P<pw>[^\s/@'\"<>`]*(?:/[^\s@'\"<>`]*)?)@(?=[\w\[.\-$\{])")
_PEM = re.compile(r"-----BEGIN (?!ENCRYPTED )(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_HEADER = re.compile(r"(?i)\b(?:proxy-)?authorization[\"']?\s*(?::|=>?|,)\s*[\"']?(?:(?:bearer|basic|token|apikey|digest|negotiate|aws4-hmac-sha256)\s+)?(?P<v>[A-Za-z0-9._~+/=\-]{12,})")
_HEADER_KEY = re.compile(r"(?i)\bx-(?:[a-z]+-)*(?:api-key|auth-token|token|secret|access-key|auth-key)[\"']?\s*[:=]\s*[\"']?(?P<v>[A-Za-z0-9._~+/=\-]{8,})")
_BEARER = re.compile(r"\b(?:Bearer|Basic)\s+(?P<v>[A-Za-z0-9._~+/=\-]{16,})")
# Command-line options that carry passwords.
_COMMAND = re.compile(
    r"""(?:
    \bcurl\b[^|;\n]*?\s(?:-u|--user|-U|--proxy-user)[\s=]*(?P<cq>["']?)[^\s:"']+:(?P<curl>[^\s"']+|(?<=['"])[^'"]+)
    |\b(?:mysql\w*|mariadb\w*|mongo\w*|xtrabackup)\b[^|;\n]*?\s-p(?P<mq>["']?)(?P<mysql>[^\s"']+)
    |\bsshpass\s+-p\s*(?P<sq>["']?)(?P<ssh>[^\s"']+)
    |\bredis-cli\b[^|;\n]*?\s-a\s+(?P<rq>["']?)(?P<redis>[^\s"']+)
    |\s--?(?:[a-z]+-)*(?:password|passwd|passphrase|pass|secret|token|api-key|apikey|access-key|secret-key|auth-token)[\s=]+(?P<oq>["']?)(?P<option>[^\s"']+)
    |\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<netrc>\S+)
    |\b(?:docker|podman|oc|az|helm)\b[^|;\n]*?\blogin\b[^|;\n]*?\s-p[\s=]+(?P<lq>["']?)(?P<login>[^\s"']+)
    |\b(?:sqlcmd|bcp|unzip|zip)\b[^|;\n]*?\s-P\s*(?P<bq>["']?)(?P<tool2>[^\s"']+)
    |\bldap(?:search|add|modify|delete|passwd|whoami|compare|modrdn)\b[^|;\n]*?\s-w\s*(?P<lw>["']?)(?P<ldap>[^\s"']+)
    |\b7z[ar]?\b[^|;\n]*?\s-p(?P<zq>["']?)(?P<zip>[^\s"']+)
    |\b(?:htpasswd|openssl)\b[^|;\n]*?\s(?:-\w*b\w*\s+\S+\s+\S+\s+|-pass(?:in|out)?\s+pass:)(?P<tool>[^\s"']+)
    |\bpass:(?P<passarg>[^\s"']{6,})
    |(?i:\bidentified\s+(?:with\s+\S+\s+)?(?:by|as)\s+(?:password\s+)?)(?P<iq>["'])(?P<sql>[^"']+)
    |(?i:\b(?:with\s+)?(?:encrypted\s+)?password\s+)(?P<pq>["'])(?P<sqlpw>[^"']+)
    )""", re.X)
# Every form of _COMMAND has an option, or one of the words "pass" and "identified".
_OPTION_HINT = re.compile(r"\s--?\w")
_SQL_PAIR = (
    re.compile(r"(?i)\b(?:val|value|setting|data|content)\w*\s*=\s*(['\"])(?P<v>(?:(?!\1).)+)\1[^;]*?\b(?:name|key|k|setting|option|param)\w*\s*=\s*(['\"])(?P<n>[\w.\-]+)\3"),
    re.compile(r"(?i)\b(?:name|key|param|option)[\"']?\s*[:=]\s*(['\"]?)(?P<n>[\w.\-]+)\1\s*[,;]?\s*[\"']?(?:value|val|default)[\"']?\s*[:=]\s*(['\"]?)(?P<v>[^\s'\",}]+)"),
    re.compile(r"(?i)<\w+\s+(?:name|key)=(['\"])(?P<n>[\w.\-]+)\1\s*(?:value=(['\"])|>)(?P<v>[^'\"<]+)"),
    re.compile(r"(?i)\(\s*(['\"])(?P<n>[\w.\-]+)\1\s*,\s*(['\"])(?P<v>[^'\"]+)\3\s*[,)]"),
)

# --- lexical tokens -------------------------------------------------------------------
_LEX = re.compile(
    r"""(?P<str>"(?:[^"\\]|\\.)*"|'(?:(?<![^\W\d_]')|(?<=\b[bruflBRUFLNEXx]')|(?<=\b[bBrRfFu][bBrRfF8]'))(?:[^'\\]|\\.)*'|`[^`]*`)
    |(?P<id>[^\W\d](?:[\w]|[.\-](?=\w))*)
    |(?P<op>:=|=>|->|==|!=|\?=|\+=|<-|[=:])
    |(?P<sp>\s+)|(?P<other>.)""", re.X | re.S)
_DEFAULT_IN = re.compile(r"\$\{(?P<n>\w+):?-(?P<v>[^}]*)\}")
_CALL_DEFAULT = re.compile(r"""\(\s*(["'])[\w.\-]+\1\s*,\s*(["'])(?P<v>(?:(?!\2)[^\\]|\\.)*)\2\s*\)""")
_TAG = re.compile(r"<(?P<n>[\w.:\-]+)(?:\s[^<>]*)?>(?P<v>[^<>\s][^<>]*)</(?P=n)>")
_TAG_ANGLE = re.compile(r"<(?P<n>[\w.:\-]+)>(?P<v>.+)</(?P=n)>")
_TALK = re.compile(
    r"""(?i)(?:^|[\s"'(\[=#/])(?P<n>[^\W\d][\w\-]*)\s+(?:was|is|war|ist|era|est|=|->|→|was\s+set\s+to|set\s+to|changed\s+to|is\s+now)\s+["'`]?(?P<v>[^\s"'`,;]+)""")
_LOGIN_TALK = re.compile(r"(?i)\b(?:login|creds?|credentials?|account|logon|zugang|acceso)\s*[:=]\s*\S+\s*(?:/|,|\|)\s*(?P<v>\S+)")
_WORDS_TALK = re.compile(
    r"(?i)\b(?:password|passwd|passphrase|pwd|kennwort|passwort|contrase[nñ]a|senha|mot[ _]de[ _]passe|api[ _-]?key|access[ _-]?key|secret[ _-]?key|secret|token)\b[^\S\n]*(?:is|was|war|ist|es|era|est|é|lautet|:|=|->|→)[^\S\n]*[\"'`]?(?P<v>[^\s\"'`,;]+)")
_ENCODED = re.compile(r"(?P<u>(?:\\u00[0-9a-fA-F]{2}){6,})|(?P<x>(?:\\x[0-9a-fA-F]{2}){6,})|(?P<p>(?:%[0-9A-Fa-f]{2}){6,})|(?P<e>(?:&\#x?[0-9A-Fa-f]{2,4};){6,})|(?P<h>(?<![0-9A-Za-z])(?:[0-9a-f]{24,}|[0-9A-F]{24,})(?![0-9A-Za-z]))|(?P<b>(?<![A-Za-z0-9+/_\-.])[A-Za-z0-9+/_\-]{16,}={0,2}(?![A-Za-z0-9+/=_\-]))")
_JOIN = re.compile(r"""(["'])((?:(?!\1)[^\\\n]|\\.)*)\1(?:\s*+(?:\+|\.\.?|\|\||&)?+\s*+\\?+\s*+(["'])((?:(?!\3)[^\\\n]|\\.)*)\3)+""")
_PART = re.compile(r"""(["'])((?:(?!\1)[^\\\n]|\\.)*)\1""")
# A literal that goes on in one on the next line.
_LINE_JOIN = re.compile(r"""["'][^\S\n]*+(?:\+|\.\.?|\|\||&)?+[^\S\n]*+\\?+[^\S\n]*+\n\s*+(?:\+|\.\.?|\|\||&)?+\s*+["']""")
_JOIN_NAME = re.compile(r"""([\w.\-]+)["']?\s*(?::=|=>|[=:])\s*(?:\(\s*)?(?:\\\s*)?$""")
# Single escaped characters, wherever they stand in a line; one escaped several times over is one.
_ESCAPED = re.compile(r"\\(?:x5[cC]|u005[cC])*(?:u\{0*([0-9A-Fa-f]{2})\}|u00([0-9A-Fa-f]{2})|U000000([0-9A-Fa-f]{2})|x([0-9A-Fa-f]{2}))|%(?:25)*([0-9A-Fa-f]{2})"
                      r"|&(?:amp;|\#38;|\#[xX]26;)*(?:\#[xX]0*([0-9A-Fa-f]{2});|\#0*(\d{2,3});|(quot|apos|amp|lt|gt);)|\\([01][0-7]{2})")
_ENTITIES = {"quot": '"', "apos": "'", "amp": "&", "lt": "<", "gt": ">"}

# A line can hold a credential only with one of these words (lower case), or with a long run, escapes
# or a concatenation of literals; one pass over the line tells.
_WORDS = ("pass pwd _pw pw= pw: pw\" secret token key cred kennwort contrase senha parola пароль 密码 密碼 パスワード auth bearer login private akia asia abia acca "
          "ghp_ gho_ ghu_ ghs_ ghr_ github_pat glpat- glrt- glft- glsoat- glcbt- glptt- gldt- xox xapp- sk_live sk_test rk_live rk_test aiza gocspx sg. npm_ pypi- sk- eyj hvs. hvb. hvr. "
          "hooks.slack curl mysql mariadb mongo xtrabackup redis-cli sqlcmd bcp zip ldap 7z openssl basic identified :- dop_v1 dckr hf_ whsec ya29 1//0 shpat shpca shppa shpss :aa psk haslo hasło wachtwoord lozinka clave motdepasse mot_de_passe pin= pin: lin_api pmak- dapi rubygems_ sq0 @").split()
try:
    import ahocorasick

    _AUTOMATON = ahocorasick.Automaton()
    for _word in _WORDS:
        _AUTOMATON.add_word(_word, 1)
    _AUTOMATON.make_automaton()

    def _has_word(low: str) -> bool:
        return next(_AUTOMATON.iter(low), None) is not None
except ImportError:
    def _has_word(low: str) -> bool:
        return any(w in low for w in _WORDS)

_ENCODED_HINT = re.compile(r"\\u00|\\x[0-9a-fA-F]|(?:%[0-9a-fA-F]{2}){4}|&#")
_JOIN_HINT = re.compile(r"[\"']\s*(?:[+.&\\]|\|\||\.\.)?\s*[\"']")
_RUN_HINT = re.compile(r"[A-Za-z0-9+/_\-]{16,}|SK[0-9a-f]{32}")


def _long_run(line: str) -> bool:
    return any(len(w) >= 16 for w in line.split()) and _RUN_HINT.search(line) is not None


# Names too short to look for as parts of words: where _PIECE makes a word of them.
_SHORT_NAMES = re.compile("(?<![A-Za-zÀ-ÿ])p(?:w|in)(?![a-zß-ÿ])|P(?:w|in)(?![a-zß-ÿ])|(?<![A-ZÀ-Þ])P(?:W|IN)(?![A-ZÀ-Þa-zß-ÿ])")


def _rare_hint(line: str, low: str) -> bool:
    return ("pw" in low or "pin" in low) and _SHORT_NAMES.search(line) is not None \
        or ("account" in low or "logon" in low or "zugang" in low or "acceso" in low) and _LOGIN_TALK.search(line) is not None \
        or "${" in low and _DEFAULT_IN.search(line) is not None


def _unescaped(line: str) -> tuple[str, list[int]] | None:
    """The line with its escaped ASCII characters written out and the place of each
    character in the line, the end included; None where nothing is escaped."""
    out: list[str] = []
    places: list[int] = []
    at = 0
    for m in _ESCAPED.finditer(line):
        value = m[m.lastindex]
        char = _ENTITIES[value] if m.lastindex == 8 else chr(int(value, {7: 10, 9: 8}.get(m.lastindex, 16)))
        if not " " <= char <= "~":
            continue
        out += (line[at:m.start()], char)
        places += (*range(at, m.start()), m.start())
        at = m.end()
    if not at:
        return None
    return "".join((*out, line[at:])), [*places, *range(at, len(line) + 1)]


def _layers(line: str) -> Iterator[tuple[str, list[int]]]:
    """The line without its escapes, as often as some are left, with the places in the line."""
    text, places = line, None
    while "\\" in text or "%" in text or "&" in text:
        plain = _unescaped(text)
        if plain is None:
            return
        text = plain[0]
        places = plain[1] if places is None else [places[i] for i in plain[1]]
        yield text, places


def may_hold(line: str) -> bool:
    """Whether a line needs a closer look."""
    return _may_hold(line) or any(_may_hold(text) for text, _ in _layers(line))


def _may_hold(line: str) -> bool:
    low = line.lower()
    return _has_word(low) or _long_run(line) or ("\\" in line or "%" in line or "&#" in line) and _ENCODED_HINT.search(line) is not None \
        or (line.count('"') + line.count("'") >= 4 and _JOIN_HINT.search(line) is not None) or _rare_hint(line, low)


# What base64 of printable text, ASCII or not, begins with.
_TEXT_START = frozenset("CDIJKLMNOPQRSTUVWXYZabcdefwxyz0123456789")
_BLANKS = str.maketrans("\t\r\n", "   ")


def _decoded(m: re.Match) -> str | None:
    """The text behind an encoded run, if it is printable."""
    raw = m.group()
    try:
        if m["u"]:
            text = re.sub(r"\\u00([0-9a-fA-F]{2})", lambda x: chr(int(x[1], 16)), raw)
        elif m["x"]:
            text = re.sub(r"\\x([0-9a-fA-F]{2})", lambda x: chr(int(x[1], 16)), raw)
        elif m["p"]:
            text = unquote(raw)
        elif m["e"]:
            text = re.sub(r"&#(x?)([0-9A-Fa-f]+);", lambda x: chr(int(x[2], 16 if x[1] else 10)), raw)
        elif m["h"]:
            text = bytes.fromhex(raw).decode("ascii")
        else:
            body = raw.rstrip("=").translate(str.maketrans("-_", "+/"))
            if len(body) % 4 == 1:
                return None
            text = base64.b64decode(body + "=" * (-len(body) % 4), validate=True).decode("utf-8")
    except (ValueError, binascii.Error, UnicodeDecodeError, OverflowError):
        return None
    text = text.rstrip("\r\n")
    return text if len(text) >= 6 and text.translate(_BLANKS).isprintable() else None


def _tokens(line: str) -> list[tuple[str, int, int]]:
    return [(m.lastgroup, m.start(), m.end()) for m in _LEX.finditer(line) if m.lastgroup != "sp"]


# Declared types between a name and its literal, and the literal handed to a setter.
_TYPED = re.compile(r"""(?:\s*\[\s*\w*\s*\]|\s+(?:string|String|str)|\s*:\s*(?:&\s*(?:'\w+\s+)?|\*)?[A-Za-z_][\w.:]*(?:[<\[][^=;"']*[>\]])?[?!]?(?:\s*\|\s*[\w.]+)*)\s*=\s*(?:[A-Za-z]{1,2}|@|Some\()?(?=["'`])""")
_GIVEN = re.compile(r"""\(\s*(?=["'`])""")


def _assigned(line: str, hits: list[Hit]) -> None:
    """Literals assigned or handed to credential-named identifiers."""
    if not ("=" in line or ":" in line or "->" in line or "<-" in line or "(" in line):
        return
    tokens = _tokens(line)
    n = len(tokens)
    for i, (kind, a, b) in enumerate(tokens):
        if kind == "id":
            name = line[a:b]
        elif kind == "str":
            name = line[a + 1:b - 1]
        else:
            continue
        if i + 1 >= n or not name or tokens[i + 1][0] == "str" or not names_credential(name):
            continue
        j = i + 1
        if kind == "id" and ((typed := _TYPED.match(line, b)) or (typed := _GIVEN.match(line, b)) and _PIECE.match(name) and _PIECE.findall(name)[0].lower() in ("set", "with")):
            while j < n and tokens[j][1] < typed.end():
                j += 1
            if j < n and tokens[j][0] == "str" and tokens[j][1] == typed.end():
                if is_value(line[tokens[j][1] + 1:tokens[j][2] - 1], True, name):
                    hits.append(Hit(tokens[j][1] + 1, tokens[j][2] - 1, "assigned"))
                continue
            j = i + 1
        # name["x"], name] and declared types: name: str = "x"
        while j < n and line[tokens[j][1]:tokens[j][2]] in ("]", ")", "?", "!"):
            j += 1
        if j < n and tokens[j][0] == "op" and line[tokens[j][1]:tokens[j][2]] == ":" and j + 2 < n and tokens[j + 1][0] == "id" and line[tokens[j + 2][1]:tokens[j + 2][2]] == "=" and tokens[j + 2][1] > tokens[j + 1][2]:
            j += 2
        if j >= n or tokens[j][0] != "op":
            continue
        op = line[tokens[j][1]:tokens[j][2]]
        if op in ("==", "!=", "->") and not (op == "->" and kind == "id"):
            continue
        j += 1
        if j >= n:
            continue
        kind2, c, d = tokens[j]
        # prefixed literals such as b"x", r"x", f"x", @"x"
        if kind2 in ("id", "other") and d - c <= 2 and j + 1 < n and tokens[j + 1][0] == "str" and tokens[j + 1][1] == d:
            if line[c:d].lower().startswith("f") and "{" in line[tokens[j + 1][1]:tokens[j + 1][2]]:
                continue
            j += 1
            kind2, c, d = tokens[j]
        if kind2 == "str":
            value = line[c + 1:d - 1]
            if " " in name and not strong(value):
                continue  # under a name of several words, a word may as well be a caption's translation
            m = _DEFAULT_IN.fullmatch(value)
            if m:
                if is_value(m["v"], True, name):
                    hits.append(Hit(c + 1 + m.start("v"), c + 1 + m.end("v"), "default"))
            elif is_value(value, True, name):
                hits.append(Hit(c + 1, d - 1, "assigned"))
            continue
        if " " not in name:
            _bare(line, c, name, hits)


_BARE_END = re.compile(r"\s+(?:#|//|--|;|done\b|\*/|-->|/\*)|[,;]\s*$|\s*\\?$|</|\s+done$")


def _bare(line: str, start: int, name: str, hits: list[Hit]) -> None:
    """An unquoted value up to the end of the line or the next comment."""
    m = _BARE_END.search(line, start)
    end = m.start() if m else len(line)
    value = line[start:end]
    call = _CALL_DEFAULT.search(value)
    if call and re.match(r"[\w.:>$-]+(?:\(\))?[\w.]*\s*\(", value):
        if is_value(call["v"], True, name):
            hits.append(Hit(start + call.start("v"), start + call.end("v"), "default"))
        return
    default = re.search(r"""(?:\|\||\?\?|\bor\b|\?:)\s*(["'])(?P<v>(?:(?!\1).)+)\1""", value)
    if default:
        if is_value(default["v"], True, name):
            hits.append(Hit(start + default.start("v"), start + default.end("v"), "default"))
        return
    m = _DEFAULT_IN.match(value)
    if m:
        if is_value(m["v"], True, name):
            hits.append(Hit(start + m.start("v"), start + m.end("v"), "default"))
        return
    first = re.match(r"[^\s,;]+", value)
    if first is None:
        return
    if " " in value.strip():
        rest = value[first.end():].strip()
        if re.match(r"[\w.\-]+\s*[=:]", rest) or rest.startswith(("(", "|", "&")) or re.match(r"\w+=", rest):
            value, end = first.group(), start + first.end()
    text = value.strip().rstrip("},])") if value.strip()[:1] not in "{[(<" else value.strip()
    if text and is_value(text, False, name):
        hits.append(Hit(start + value.index(text), start + value.index(text) + len(text), "assigned"))


def _formats(text: str, hits: list[Hit]) -> None:
    """Values whose own format is a credential."""
    for m in _TOKEN.finditer(text):
        body = m.group()
        if not _masked(body) and len(set(body)) >= 10 and not re.search(r"(?i)example|x{6}", body):
            hits.append(Hit(m.start(), m.end(), m.lastgroup or "token"))
    for m in _URL_LOGIN.finditer(text) if "://" in text else ():
        value = m["pw"]
        if value and not _PLACEHOLDER.match(value) and not _masked(value) and not re.match(r"[$<{%\[]|!?Ref\b", value) and not _ENCRYPTED.match(value):
            hits.append(Hit(m.start("pw"), m.end("pw"), "url"))
    low = text.lower()
    for pattern, kind in ((_HEADER, "header"), (_HEADER_KEY, "header"), (_BEARER, "header")) if "authorization" in low or "x-" in low or "bearer" in low or "basic" in low else ():
        for m in pattern.finditer(text):
            value = m["v"]
            if not _PLACEHOLDER.match(value) and not _masked(value) and not _DOTTED.match(value) and re.search(r"[\d_\-]|[a-z][A-Z]", value) and not _ENCRYPTED.match(value):
                hits.append(Hit(m.start("v"), m.end("v"), kind))
    for m in _COMMAND.finditer(text) if "pass" in low or "identified" in low or "-" in text and _OPTION_HINT.search(text) else ():
        group = next(g for g in ("curl", "mysql", "ssh", "redis", "option", "netrc", "login", "tool2", "ldap", "zip", "tool", "passarg", "sql", "sqlpw") if m[g] is not None)
        value = m[group]
        if is_value(value, True, "password") and not (group in ("mysql",) and value.startswith(("rotocol", "ort", "rint"))):
            hits.append(Hit(m.start(group), m.end(group), "command"))


def _name_before(text: str, at: int) -> re.Match | None:
    """The name that what stands at ``at`` is given to; read backwards, as lines may be long."""
    i = at
    for chars in (" \t\r\n(\\", ":=>", " \t\r\n", "\"'"):
        while i > 0 and text[i - 1] in chars:
            i -= 1
    while i > 0 and (text[i - 1].isalnum() or text[i - 1] in "_.-"):
        i -= 1
    return _JOIN_NAME.search(text, i, at)


def _joined(text: str, start: int, end: int, hits: list[Hit], over_lines: bool = False) -> None:
    """Concatenated literals that together are a credential; what of one stands on
    later lines is "continued": it belongs to the value that began before."""
    for m in _JOIN.finditer(text, start, end):
        if over_lines and "\n" not in m.group():
            continue
        parts = [(p.start(2), p.end(2)) for p in _PART.finditer(text, m.start(), m.end())]
        joined = "".join(text[a:b] for a, b in parts)
        before = _name_before(text, m.start())
        if before and names_credential(before[1]) and is_value(joined, True, before[1]):
            chosen = [(a, b) for a, b in parts if b > a]
        else:
            got: list[Hit] = []
            _formats(joined, got)
            chosen, at = [], 0
            for a, b in parts if got else ():
                if b > a and any(h.start < at + b - a and at < h.end for h in got):
                    chosen.append((a, b))
                at += b - a
        first = text.find("\n", chosen[0][0]) if chosen else -1
        hits += [Hit(a, b, "joined" if first < 0 or a < first else "continued") for a, b in chosen]


def _find(line: str) -> list[Hit]:
    """The credential values of a line, as it stands and without its escapes."""
    hits = _find_plain(line)
    for text, places in _layers(line):
        if _may_hold(text):
            hits += [Hit(places[h.start], places[h.end], "encoded") for h in _find_plain(text)]
    return hits


def _find_plain(line: str) -> list[Hit]:
    hits: list[Hit] = []
    _formats(line, hits)
    _assigned(line, hits)
    for m in (*_TAG.finditer(line), *_TAG_ANGLE.finditer(line)) if "</" in line else ():
        if names_credential(m["n"]) and is_value(m["v"], True, m["n"]):
            hits.append(Hit(m.start("v"), m.end("v"), "element"))
    for pattern in _SQL_PAIR if "'" in line or '"' in line or "=" in line or ":" in line else ():
        for m in pattern.finditer(line):
            if names_credential(m["n"]) and is_value(m["v"], True, m["n"]):
                hits.append(Hit(m.start("v"), m.end("v"), "pair"))
    for m in _DEFAULT_IN.finditer(line) if "${" in line else ():
        if (names_credential(m["n"]) and is_value(m["v"], True, m["n"])) or (strong(m["v"]) and is_value(m["v"], True) and not re.search(r"^\w+(?:[./\-]\w+)*$", m["v"])):
            hits.append(Hit(m.start("v"), m.end("v"), "default"))
    for m in (*_TALK.finditer(line), *_WORDS_TALK.finditer(line), *_LOGIN_TALK.finditer(line)):
        value = m["v"].rstrip(".")
        if strong(value) and is_value(value, False, "") and not re.search(r"^(?:https?:|[\w\-]+(?:\.[\w\-]+)+$|.*/.*\.\w{1,5}$)", value) or "n" not in m.groupdict() and re.fullmatch(r"[a-z]+[._\-][a-z]+\d+", value):
            if "n" in m.groupdict() and not names_credential(m["n"]):
                continue
            hits.append(Hit(m.start("v"), m.start("v") + len(value), "mention"))
        elif "n" in m.groupdict() and names_credential(m["n"]) and re.fullmatch(r"[a-z]+[._\-][a-z]+\d+", value):
            hits.append(Hit(m.start("v"), m.start("v") + len(value), "mention"))
    if line.count('"') + line.count("'") >= 4:
        _joined(line, 0, len(line), hits)
    if _long_run(line) or _ENCODED_HINT.search(line):
        for m in _ENCODED.finditer(line):
            text = _decoded(m) if m["b"] is None or m["b"][0] in _TEXT_START else None
            if text is not None and (find_in_text(text) if "\n" in text else may_hold(text) and _find(text)):
                hits.append(Hit(m.start(), m.end(), "encoded"))
    return hits


def _merge(hits: list[Hit]) -> list[Hit]:
    out: list[Hit] = []
    for hit in sorted(hits, key=lambda h: (h.start, -h.end)):
        if out and hit.start < out[-1].end:
            if hit.end > out[-1].end:
                out[-1] = Hit(out[-1].start, hit.end, out[-1].kind)
        else:
            out.append(hit)
    return out


_KEY_BREAK = re.compile(r"\r?\n|(?:\\r)?\\n|$")
_KEY_SYNTAX = re.compile(r"""[\s"'`,;\\)\]}]|(?:^|(?<=["'`\s]))[+.&](?=["'`\s\\]|$)|^\s*(?:#|//|\*|>|\|)+""")
_KEY_RUN = re.compile(r"(?:[A-Za-z0-9+/]+={0,3}|=[A-Za-z0-9+/]{4})")
_KEY_START = re.compile(r"""[\s"'`]*[A-Za-z0-9+/]{16,}={0,2}""")
_KEY_HEADER = re.compile(r"\s*[A-Z][A-Za-z\-]+: .*")
_PUTTY = re.compile(r"PuTTY-User-Key-File-\d: .*\r?\nEncryption: none\r?\n(?:(?!PuTTY-User).*\r?\n)*?Private-Lines: \d+\r?\n(?P<v>(?:[A-Za-z0-9+/=]+(?:\r?\n|$))+)")


def _key_body(text: str, at: int, limit: int, closed: bool, lead: str) -> tuple[list[tuple[int, int]], str, bool]:
    """Where the body of a private key stands that begins at ``at``, its characters,
    and whether a header says it is encrypted.

    Each line (or its escaped form) is a header or characters of the body amid
    syntax, behind the same lead as the BEGIN mark or none.  Behind other lines the
    body goes on as far as the END mark (at ``limit``, if ``closed``), without
    one only in lines of its width."""
    spans, real, encrypted, start, stop = [], [], False, at, at
    while at < limit:
        m = _KEY_BREAK.search(text, at, limit)
        begin, end, at = at, m.start(), max(m.end(), at + 1) if m.end() < limit else limit
        if lead and text.startswith(lead, begin, end):
            begin += len(lead)
        line = text[begin:end]
        run = _KEY_SYNTAX.sub("", line)
        if not run or run in lead or _KEY_HEADER.fullmatch(line) and not real:
            encrypted = encrypted or run != "" and "ENCRYPTED" in line
            continue
        if not _KEY_RUN.fullmatch(run):
            fits = False
        elif start < 0 and not closed:
            fits = len(run) == len(real[0])
        else:
            fits = len(run) >= 16 or closed and at >= limit or start >= 0 and real and ("=" in run or len(run) % 4 == 0 and not run.islower())
        if fits:
            real.append(run)
            if start < 0:
                start = begin
            stop = end
            continue
        m = _KEY_START.match(line)
        if m and start >= 0:  # cut off: the literal ends, its line does not
            real.append(_KEY_SYNTAX.sub("", m.group()))
            stop = begin + m.end()
        if not closed and not real:
            break
        if real and start >= 0:
            spans.append((start, stop))
            start = -1
    if real and start >= 0:
        spans.append((start, stop))
    return spans, "".join(real), encrypted


_NAME_LINE = re.compile(r"""(?i)^\s*(?:-\s*)?["']?(?:name|key)["']?\s*[:=]\s*["']?(?P<n>[\w.\-]+)["']?\s*,?\s*$""")
_VALUE_LINE = re.compile(r"""(?i)^\s*["']?(?:value|val)["']?\s*[:=]\s*(?P<q>["']?)(?P<v>[^\s"']+)(?P=q)\s*,?\s*$""")
_VALUE_FIRST = re.compile(r"""(?i)^\s*-\s*["']?(?:value|val)["']?\s*[:=]\s*(?P<q>["']?)(?P<v>[^\s"']+)(?P=q)\s*,?\s*$""")
_OPEN_LINE = re.compile(r"""(?P<n>[\w.\-]+)["']?\s*(?:[:=]|:=|=>)\s*(?P<o>[|>][+\-]?|\\|\(|"{3}|'{3}|<<-?['"]?\w+['"]?)?\s*$""")
_OPEN_TAG = re.compile(r"<(?P<n>[\w.:\-]+)(?:\s[^<>]*)?>\s*$")
_ALONE = re.compile(r"""^(?P<in>\s*)(?P<q>["'`]?)(?![\w.\-]+[=:](?!=*$))(?P<v>[^\s"'`]+)(?P=q)\s*[,;)]?\s*$""")


# Base64 over several lines.
_WRAPPED = re.compile(r"^(?:[ \t]*+[A-Za-z0-9+/]{16,}+\r?\n)+[ \t]*+[A-Za-z0-9+/]++={0,2}+(?=[ \t]*\r?$)", re.M)


def _text_of(encoded: str) -> str | None:
    """The printable text behind base64, if it is that."""
    body = encoded.rstrip("=")
    if body[:1] not in _TEXT_START or len(body) % 4 == 1:
        return None
    try:
        text = base64.b64decode(body + "=" * (-len(body) % 4), validate=True).decode("utf-8")
    except (ValueError, binascii.Error):
        return None
    return text if text.translate(_BLANKS).isprintable() else None


def _wrapped(text: str, m: re.Match, hits: list[Hit]) -> None:
    """Credentials in base64 that goes on over lines: a value counts at the line where it begins."""
    lines = [(p.start(), p.end()) for p in re.compile(r"\S+").finditer(text, m.start(), m.end())]
    inner = _text_of("".join(text[a:b] for a, b in lines))
    if inner is None:
        # The last line may be a word of its own.
        inner = _text_of("".join(text[a:b] for a, b in lines[:-1])) or ""
    for hit in find_in_text(inner):
        first, last = (len(inner[:x].encode()) * 4 // 3 for x in (hit.start, hit.end - 1))
        at, kind = 0, "continued" if hit.kind == "continued" else "encoded"
        for a, b in lines:
            if at <= last and first < at + b - a:
                hits.append(Hit(a, b, kind))
                kind = "continued"
            at += b - a


_REPEATS = re.compile(r"([B-Za-z0-9])\1{5,}")
_COMMENT_LINE = re.compile(r"\s*(?:#|//|--|<!--)")


def find_in_text(text: str) -> list[Hit]:
    """All credential values of a text, in order, not overlapping.

    A private key is one hit from its BEGIN mark through its body; a value on the
    line after its name starts there.  What follows of a value on later lines,
    behind other text, is a hit of the kind "continued".
    """
    hits: list[Hit] = []
    keys: list[tuple[int, int]] = []
    if "PRIVATE KEY" in text:
        marks = sorted([(m.start(), m.end(), True) for m in _PEM.finditer(text)] + [(m.start(), m.end(), False) for m in _PEM_END.finditer(text)])
        if marks and not marks[0][2]:
            # A piece that begins within a key: the key counts where it begins, its characters are hidden here too.
            spans, real, _ = _key_body(text, 0, marks[0][0], True, "")
            if len(real) >= 24 and not _REPEATS.search(real) and text[spans[-1][1]:marks[0][0]].strip() == "":
                hits.append(Hit(*spans[-1], "continued"))
        for (mark, at, begins), (limit, _, other) in zip(marks, [*marks[1:], (len(text), 0, True)], strict=False):
            if not begins:
                continue
            spans, real, encrypted = _key_body(text, at, limit, not other, text[text.rfind("\n", 0, mark) + 1:mark])
            # A mention, a placeholder or an encrypted body is no key.  Keys have runs of A where lengths stand.
            if len(real) >= 24 and not encrypted and len(set(real)) >= 10 and not _REPEATS.search(real) and not _PLACEHOLDER.match(real[:64]):
                stop = spans[0][1]
                body = text[at:stop]
                keys += [(mark, stop), *spans[1:]]
                hits.append(Hit(at + (len(body) - len(body.lstrip("\r\n"))) if not body.startswith("\\") else at, stop, "private-key"))
                hits += [Hit(a, b, "continued") for a, b in spans[1:]]
    for m in _PUTTY.finditer(text) if "Private-Lines" in text else ():
        keys.append((m.start(), m.end()))
        hits.append(Hit(m.start("v"), m.end("v"), "private-key"))
    spans: list[list[int]] = []
    for m in _LINE_JOIN.finditer(text):
        first, last = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        last = len(text) if last < 0 else last
        if spans and first <= spans[-1][1]:
            spans[-1][1] = last
        else:
            spans.append([first, last])
    for m in _WRAPPED.finditer(text):
        _wrapped(text, m, hits)
    for first, last in spans:
        _joined(text, first, last, hits, over_lines=True)
    position = 0
    lines = LINE_BREAK.split(text)
    before = last = None
    spot = 0
    breaks = LINE_BREAK.finditer(text)
    for line in lines:
        position = spot
        inside = any(a < position < b for a, b in keys)
        if line and not inside:
            if may_hold(line):
                for hit in _find(line):
                    hits.append(Hit(hit.start + position, hit.end + position, hit.kind))
            if before is not None:
                m = _VALUE_LINE.match(line) if before[1] else _ALONE.match(line)
                if m and not before[1] and len(m["in"]) <= before[2]:
                    m = None
                if m and is_value(m["v"], bool(m["q"]) or bool(before[1]), before[0]) and (before[1] or strong(m["v"])):
                    hits.append(Hit(position + m.start("v"), position + m.end("v"), "next-line"))
            m = _NAME_LINE.match(line)
            if m is None and before is not None and _COMMENT_LINE.match(line):
                pass  # a comment between a name and its value
            else:
                before = None
            if m and names_credential(m["n"]):
                before = (m["n"], True, 0)
                m = _VALUE_FIRST.match(last[1]) if last is not None and line.lstrip()[0] != "-" else None
                if m and is_value(m["v"], True, before[0]):
                    hits.append(Hit(last[0] + m.start("v"), last[0] + m.end("v"), "next-line"))
            elif line.rstrip()[-1:] in ":=|>\\(+\"'-" and (m := _OPEN_LINE.search(line) or _OPEN_TAG.search(line)) and names_credential(m["n"]):
                # Without a continuation mark, only a deeper line can be the value.
                before = (m["n"], False, -1 if m.groupdict().get("o") else len(line) - len(line.lstrip()))
            last = (position, line) if line.strip() else last
        end = next(breaks, None)
        spot = end.end() if end else len(text)
    kept = _merge([h for h in hits if h.kind in ("private-key", "continued") or not any(a <= h.start < b for a, b in keys)])
    later = {h.start: h.end for h in hits if h.kind == "continued"}
    return [h._replace(kind="continued") if later.get(h.start, 0) >= h.end else h for h in kept] if later else kept


def _mark_start(text: str, hit: Hit) -> int:
    """The offset whose line the hit counts at: a private key counts at its BEGIN mark."""
    if hit.kind == "private-key":
        at = max(text.rfind("-----BEGIN", 0, hit.start + 1), text.rfind("PuTTY-User-Key-File", 0, hit.start + 1))
        return at if at >= 0 else hit.start
    return hit.start


_ESCAPE = re.compile(r"\\(?=[\r\n])|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\.|%[0-9A-Fa-f]{2}|&#?\w+;|\s", re.S)


def redact(text: str) -> str:
    """The text with every credential value made unreadable and nothing else changed.

    Each character of a value becomes ``*``; escape sequences, line breaks and
    blanks inside a value keep their form, so the literal still parses.
    """
    out, at = [], 0
    for hit in find_in_text(text):
        out.append(text[at:hit.start])
        piece = text[hit.start:hit.end]
        if hit.kind == "encoded":
            out.append("*" * len(piece))
        else:
            last = 0
            for m in _ESCAPE.finditer(piece):
                out.append("*" * (m.start() - last))
                kept = m.group()
                # Structure (line ends, blanks) stays; an escaped character is content.
                out.append(kept if kept.isspace() or kept in ("\\", "\\n", "\\r", "\\t") else "*" * len(kept))
                last = m.end()
            out.append("*" * (len(piece) - last))
        at = hit.end
    out.append(text[at:])
    return "".join(out)


_OUT = pa.schema([("blob_id", pa.int64()), ("line_no", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in _OUT]
        for blob_id, text, owned in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            line_no, at = 1, 0
            for hit in find_in_text(text):
                if hit.kind == "continued":
                    continue
                start = _mark_start(text, hit)
                line_no += text.count("\n", at, start)
                at = start
                if line_no >= owned:
                    for column, value in zip(rows, (blob_id, line_no, hit.kind, hit.start, hit.end), strict=True):
                        column.append(value)
        yield pa.record_batch(rows, schema=_OUT)


def credential_places(blobs: DataFrame) -> DataFrame:
    """One row per credential value in ``blobs(blob_id, text, commit_line)``.

    Columns: blob_id, line_no (from 1; a value over several lines counts at its
    first), kind, start and end (code points from 0, the literal's contents).
    Lines before ``commit_line`` belong to another piece and give nothing; a
    null commit_line counts as 0.  Null ids or texts and empty texts give
    nothing, a blob_id delivered twice counts once (its smallest text), other
    columns are ignored.
    """
    source = blobs.select(
        F.col("blob_id").cast("bigint").alias("blob_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("commit_line").cast("int"), F.lit(0)).alias("owned"))
    kept = source.where("blob_id is not null and text is not null and text <> ''")
    return one_text(kept, "blob_id").mapInArrow(_scan, "blob_id bigint, line_no int, kind string, start int, end int")


def redacted(frame: DataFrame, *columns: str) -> DataFrame:
    """``frame`` with every credential in the named string columns redacted.

    Nulls stay null; other columns, their names and the row count do not change.
    """
    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: None if t is None else redact(t))

    return frame.withColumns({c: F.when(F.col(f"`{c}`").isNotNull(), clean(F.col(f"`{c}`").cast("string"))) for c in columns})


# What stands for the hidden part of a masked secret.  One or two stars may belong to a real value.
_HIDDEN = re.compile(r"\.{3,}|…+|\*{3,}")
_QUOTED_RUN = r"""(?<![^\s=:>(\[{{,])(["'`])(?P<v>\S{{{n}}})\1(?![^\s,;)\]}}])"""
_BARE_RUN = r"""[=:]\s?(?P<v>[^\s"'`]{{{n}}})(?![^\s,;)\]}}])"""

# A private key in a context, where line breaks show as a mark and the end may be cut off.
_SHOWN_KEY = re.compile(r"(-----BEGIN (?!ENCRYPTED )(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)((?:[\s⏎]|\\[nr])+[A-Za-z0-9+/=]{16,}(?:(?:[\s⏎]|\\[nr])+[A-Za-z0-9+/=]+)*)")


def _stars(text: str) -> str:
    return re.sub(r"\S", "*", text)


def _mask_hidden(context: str, secret: str) -> str:
    """``context`` without the value that a masked secret stands for.

    The value is a non-blank run from the secret's head to its tail; of a secret
    of stars alone only the length is known, so a literal of that length counts.
    """
    mark = _HIDDEN.search(secret)
    head, tail = secret[:mark.start()], secret[mark.end():].lstrip("*.…")
    tail = _HIDDEN.split(tail)[-1]
    if not head and not tail:
        n = len(secret)
        if n < 4 or set(secret) != {"*"}:
            return context
        found = list(re.finditer(_QUOTED_RUN.format(n=n), context)) or [m for m in re.finditer(_BARE_RUN.format(n=n), context) if strong(m["v"])]
        for m in found:
            context = context[:m.start("v")] + "*" * n + context[m.end("v"):]
        return context
    if context.count(head) == context.count(secret) and not head.startswith("---"):
        return context  # only the masked form stands here
    before, after = r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt]))", "(?![A-Za-z0-9])"
    if head.startswith("---"):
        context = _SHOWN_KEY.sub(lambda m: m[1] + re.sub(r"[^\s⏎]", "*", m[2]), context)
    # The last form is a quoted passphrase.
    for first, inner, last in ((before, r"[^\s\"'`]*", after), (before, r"\S*", after), (r"(?<=[\"'`])", r"[^\"'`⏎]*", r"(?=[\"'`])")):
        got, n = re.subn(first + re.escape(head) + inner + re.escape(tail) + last, lambda m: m.group() if m.group() == secret else _stars(m.group()), context)
        if n:
            return got
    return context


def redacted_findings(findings: DataFrame) -> DataFrame:
    """``findings`` in reported form: ``secret`` masked whole, its occurrences in
    ``match_context`` and every other credential there masked too.

    A secret masked with three stars or more keeps its text; the value it stands
    for is masked in the context.  Null contexts stay null.  Rows are dealt out
    evenly first: a context costs Python time whatever file it lies in.
    """
    @F.pandas_udf("string")
    def context(contexts, secrets):  # noqa: ANN001, ANN202
        def one(c, s):  # noqa: ANN001, ANN202
            if c is None:
                return None
            if s and _HIDDEN.search(s):
                c = _mask_hidden(c, s)
            elif s and len(s) >= 4:
                c = c.replace(s, "*" * len(s))
            return redact(c)
        return contexts.combine(secrets, one)

    findings = spread(findings)
    masked = F.when(F.col("secret").rlike(r"\*{3}"), F.col("secret")).otherwise(F.regexp_replace("secret", r"\S", "*"))
    return findings.withColumns({"match_context": context(F.col("match_context"), F.col("secret")), "secret": masked})
