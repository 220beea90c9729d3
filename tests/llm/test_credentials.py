"""Credentials: forms that count, forms that do not, and exact redaction."""

import base64
import random
import re
import string

import pytest

from driftnet.llm import credentials

R = random.Random(11)


def made(prefix, n, alphabet=string.ascii_letters + string.digits):
    return prefix + "".join(R.choice(alphabet) for _ in range(n))


PW = "q8Zk1Lm" + "X0pVw7"
TOKEN = made("glpat" + "-", 20)
KEY_BODY = "\n".join(made("", 64) for _ in range(4))
PEM = "-----BEGIN RSA " + f"PRIVATE KEY-----\n{KEY_BODY}\n-----END RSA " + "PRIVATE KEY-----"

CASES = [f'password = "{PW}"', f"DB_PASS={PW}", f"  'api_key' => '{PW}',", f"const apiKey = '{PW}';", f"\tclient_secret := \"{PW}\"", f"  <kennwort>{PW}</kennwort>", f'"redis_password": "{PW}",', f"level=info passwd={PW} done",
         f"- passphrase: `{PW}`", f'pwd = os.getenv("X", "{PW}")', f"secret: ${{X:-{PW}}}", f"UPDATE settings SET val = '{PW}' WHERE name = 'api_key';", f"curl -u user:{PW} https://h.example/", f"mysqldump -u x -p'{PW}' db",
         f"sshpass -p '{PW}' ssh h", f"machine h login u password {PW}", f"url: postgres://u:{PW}@h.example/d", f'curl -H "Authorization: Bearer {made("", 30)}" x', f"anything = {TOKEN}", f'x = "{TOKEN[:9]}" + "{TOKEN[9:]}"',
         "seed = " + base64.b64encode(f"password={PW}".encode()).decode(), 's = "' + "".join(f"\\u{ord(c):04x}" for c in TOKEN) + '"', "s = " + "".join(f"%{ord(c):02X}" for c in TOKEN),
         "- client_secret: `!8" + PW + "`", "aws_secret_access_key = /" + made("", 36) + "aB7", "pwd: %" + PW,
         f"# old login: svc / {PW}", f"# webhook_secret was {PW} until Friday", f"mot_de_passe: {PW}", "k: " + PEM.replace("\n", "\\n"), 'admin_password: "correct' + 'Horse7battery"']
NONE = ['password = "${DB_PASS}"', "password = settings.PASSWORD", 'password = ""', 'password: "changeme"', "api_key = '<your-token>'", "token_type = 'bearer'", "password_policy = required", "PASSWORD_HASH=$2b$12$" + made("", 53),
        f"commit = '{made('', 40, '0123456789abcdef')}'", "secret = vault:kv/data/x#y", "secret: !Ref NAME", "secret = {{ vault_x }}", "pwd = ENC[AES256_GCM,data:abc,tag:def]", "api_key = sk_" + "live_" + "*" * 16 + "abcd",
        "key = AK" + "IA" + "X" * 16, "The reviewer rotated the password of staging.", "# Who leaked the token?", "csrf_token_enabled = true", "password_rotation_days: 77", "db_pass = read_key(path='a/b.ini')",
        "public_key = ssh-ed25519 AAAAC3" + made("", 60), "-----BEGIN PUBLIC " + "KEY-----", "id = 123e4567-e89b-12d3-a456-426614174000", "icon = data:image/png;base64,iVBORw0KGgo" + made("", 60), "", "password"]


@pytest.mark.parametrize("line", CASES)
def test_counts(line):
    assert credentials.find_in_text(line), line


@pytest.mark.parametrize("line", NONE)
def test_does_not_count(line):
    assert credentials.find_in_text(line) == [], line


@pytest.mark.parametrize("line", CASES)
def test_redaction_keeps_everything_else(line):
    text = f"before é\r\n{line}\nafter"
    out = credentials.redact(text)
    assert len(out) == len(text) and PW not in out and TOKEN not in out
    hits = credentials.find_in_text(text)
    inside = {i for h in hits for i in range(h.start, h.end)}
    assert all(a == b for i, (a, b) in enumerate(zip(text, out, strict=True)) if i not in inside)
    assert out.startswith("before é\r\n") and out.endswith("\nafter")
    assert not [h for h in credentials.find_in_text(out) if h.kind != "private-key"]


def test_private_key_counts_at_its_first_line(spark):
    rows = [(1, f"a\n{PEM}\nb", 0, "x"), (1, f"a\n{PEM}\nb", 0, "x"), (2, f"password={PW}\npassword={PW}1", 2, "x"), (3, None, 0, "x"), (None, f"password={PW}", 0, "x"), (4, "", None, "x"), (5, f"\n\npassword={PW}", None, "x")]
    blobs = spark.createDataFrame(rows, "blob_id long, text string, commit_line int, line_no string")
    got = sorted((r["blob_id"], r["line_no"]) for r in credentials.credential_places(blobs).collect())
    assert got == [(1, 2), (2, 2), (5, 3)]
    assert credentials.credential_places(blobs.limit(0)).count() == 0
    redacted = {r["blob_id"]: r["text"] for r in credentials.redacted(blobs.where("blob_id is not null").distinct(), "text").collect()}
    assert redacted[3] is None and redacted[4] == "" and KEY_BODY[:20] not in redacted[1] and redacted[1].count("\n") == rows[0][1].count("\n")


def test_findings_in_reported_form(spark):
    rows = [(PW, f'x = "{PW}" y'), ("sk_live_***abcd", None), (None, f"password={PW}")]
    got = credentials.redacted_findings(spark.createDataFrame(rows, "secret string, match_context string")).collect()
    assert all(PW not in (r["match_context"] or "") and r["secret"] != PW for r in got)
    assert "sk_live_***abcd" in {r["secret"] for r in got}


def test_contexts_that_show_the_value_of_a_masked_secret(spark):
    bare, starred, short = made("", 30), "UBLsf*NoXim" + "AI1IZ", "Folmir" + "1607?"
    key = "-----BEGIN EC " + "PRIVATE KEY-----"
    rows = [(f"{bare[:4]}...{bare[-4:]}", f'lum: gal = "{bare}" ⏎ nov'), (f"{bare[:4]}…{bare[-4:]}", f"https://h/{bare}/x"), (f"{bare[:4]}****{bare[-4:]}", f"a {bare}, b"),
            (starred, f'a => "{starred}" ⏎ b'), ("*" * 11, f'hal"lumquingal"bra = "{short}" ⏎ b'), ("----...----", f"a ⏎ {key} ⏎ {made('', 64)} ⏎ {made('', 30)}"),
            ("sk_l...AwqP", 'a = "sk_l...AwqP" b'), ("corr...tery", 'a = "correct horse 7 battery" b'), ("abcd...wxyz", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, secret string, match_context string")
    got = [r for r in sorted(credentials.redacted_findings(frame).collect())]
    stars = "*" * 30
    assert [r["match_context"] for r in got[:5]] == [f'lum: gal = "{stars}" ⏎ nov', f"https://h/{stars}/x", f"a {stars}, b", f'a => "{"*" * 16}" ⏎ b', f'hal"lumquingal"bra = "{"*" * 11}" ⏎ b']
    assert got[5]["match_context"] == f"a ⏎ {key} ⏎ {'*' * 64} ⏎ {stars}"
    assert got[6]["match_context"] == rows[6][1] and got[7]["match_context"] == 'a = "******* ***** * *******" b' and got[8]["match_context"] is None
    assert starred not in {r["secret"] for r in got} and got[2]["secret"] == rows[2][0]


def test_very_long_text():
    text = "x = 1 and nothing else here\n" * 20_000 + f'password = "{PW}"\n'
    assert [h.kind for h in credentials.find_in_text(text)] == ["assigned"]
    assert not re.search(PW, credentials.redact(text))


def test_long_placeholders_take_no_time():
    assert credentials.find_in_text("api_key: " + "x" * 60 + " ⏎ tenant: a") == []


SHORT = "Zk8!" + "xq2p"
FORMS = ['pw = "%s"', 'smtp.pw = "%s"', "'pw' => '%s'", 'dbPw = "%s"', 'pw_old = "%s"', 'pw2: "%s"', 'pin = "482913"', '"pin": "482913"', "<pin>482913</pin>", "redis-cli -a %s", "mariadb -u x -p%s", "mongo h -p%s", "xtrabackup -p%s", "account: svc / %s",
         "logon: svc | %s", "zugang: svc / %s", "acceso = svc, %s", "login: svc / %s", "curl -u a:%s h", "htpasswd -b f u %s", "x -passin pass:%s", "x --api-key %s", 'identified by "%s"', "${X-%s}"]
FORMS += [form.replace("NAME", w) for w in sorted(credentials._SECRET_WORDS) for w in (w, w.capitalize(), w.upper()) for form in ('NAME = "%s"', 'x_NAME: "%s"', "'NAME' => '%s'", 'myNAME := "%s"', "was NAME = %s")]
FORMS += [f'{owner}{key} = "%s"' for owner in sorted(credentials._KEY_OWNERS) for key in ("_key", "Key", "-keys")]
FORMS += [f'{owner}_{key} = "%s"' for owner in ("basic", "http", "proxy", "smtp", "redis", "registry") for key in ("auth", "authorization")]


def test_every_form_passes_the_prefilter():
    lines = [f.replace("%s", SHORT) for f in FORMS]
    assert [x for x in lines if credentials._find(x) and not credentials.may_hold(x)] == []
    assert [x for x in lines[:24] if not credentials.find_in_text(x)] == []
    assert not credentials.may_hold("the opinion of the spinning pins was: mapping") and not credentials.may_hold("account settings = 1")


def test_token_split_inside_a_very_long_concatenation():
    filler = " + ".join('" some plain words here "' for _ in range(300))
    line = f'x = {filler} + "{TOKEN[:9]}" + "{TOKEN[9:]}" + {filler}'
    hits = credentials.find_in_text(line)
    assert [line[h.start:h.end] for h in hits] == [TOKEN[:9], TOKEN[9:]]
