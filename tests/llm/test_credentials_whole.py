"""Credentials that limits on length, depth, place or form would leave out."""

import base64
import random
import string

import pytest

from driftnet.llm import credentials

R = random.Random(23)


def made(n, alphabet=string.ascii_letters + string.digits):
    return "".join(R.choice(alphabet) for _ in range(n))


def b64(text, times=1):
    for _ in range(times):
        text = base64.b64encode(text.encode()).decode()
    return text


def mark(word, kind="RSA "):
    return f"-----{word} {kind}PRIVATE" + " KEY-----"


def lines_of(text):
    return [text.count("\n", 0, credentials._mark_start(text, h)) + 1 for h in credentials.find_in_text(text) if h.kind != "continued"]


PW, WEAK = "q8Zk1Lm" + "X0pVw7", "hunter" + "Two9"
TOKEN = "ghp" + "_" + made(36)
BODY = "\n".join(made(64) for _ in range(4))
LENGTHS = "b3BlbnNzaC1rZXktdjE" + "AAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZWQyNTUx\n" + BODY

WHOLE = [
    # keys: runs of A where lengths stand; text behind a body without its END mark; marks that only frame other text
    (f"{mark('BEGIN', 'OPENSSH ')}\n{LENGTHS}\n{mark('END', 'OPENSSH ')}", [1]),
    (f'{mark("BEGIN")}\n{BODY}\n\npassword = "{PW}"\n', [1, 7]),
    (f'{mark("BEGIN")}\n{BODY}\n\n{mark("BEGIN")}\n{BODY}\n{mark("END")}\npassword = "{PW}"\n', [1, 7, 13]),
    (f'B = "{mark("BEGIN")}"\npassword = "{PW}"\nE = "{mark("END")}"', [2]),
    (f"PuTTY-User-Key-File-2: ssh-rsa\nEncryption: none\nComment: c\nPublic-Lines: 1\n{made(64)}\nPrivate-Lines: 2\n{made(64)}\n{made(40)}\nPrivate-MAC: x\n", [1]),
    # names of any length and of several words, declared types, setters, apostrophes before
    ('"' + "a_" * 40 + f'password": "{WEAK}"', [1]), (f'"Database Password": "{WEAK}"', [1]), (f'char password[32] = "{WEAK}";', [1]), (f'let password: &str = "{WEAK}";', [1]),
    (f'password: Optional[str] = "{WEAK}"', [1]), (f'var password string = "{WEAK}"', [1]), (f'setPassword("{WEAK}")', [1]), (f"it's so: 'api_key' => '{WEAK}', // isn't it", [1]),
    (f"'signing_secret' => '{WEAK}%',  // l'autre", [1]),
    # layers and forms of encoding
    (f"x = {b64('password=' + PW, 3)}", [1]), (f"x = {b64('password=' + PW, 5)}", [1]), ("x = " + b64(f'x = "{TOKEN[:9]}" + "{TOKEN[9:]}"'), [1]), ("data: " + b64(f"user=svc\npassword={PW}\nhost=h\n"), [1]),
    ("data: " + b64(f"{mark('BEGIN')}\n{BODY}\n{mark('END')}\n"), [1]), ("x = " + f"password={PW}".encode().hex().upper(), [1]), ('s = "gh\\u0070_' + TOKEN[4:] + '"', [1]), (f'p%61ss%2577ord="{WEAK}"', [1]),
    ("s = " + "".join(f"\\{ord(c):03o}" for c in TOKEN), [1]), ("s = " + "".join("\\u{%x}" % ord(c) for c in TOKEN), [1]), (f"password=&quot;{WEAK}&quot;", [1]),
    # values over lines count once, at their first
    (f'x = "{TOKEN[:9]}" +\n    "{TOKEN[9:]}"', [1]), (f'x = ("{TOKEN[:9]}"\r\n    "{TOKEN[9:]}")', [1]), (f'a = 1\npassword = "{PW[:6]}" \\\n    "{PW[6:]}"', [2]),
    (f"<password>\n  {PW}\n</password>", [2]), (f"- name: DB_PASSWORD\n  # given\n  value: {WEAK}", [3]), (f"- value: {WEAK}\n  name: DB_PASSWORD", [1]),
    # command lines
    (f"docker login -u a -p {WEAK} r.example", [1]), (f"sqlcmd -S h -U sa -P {WEAK}", [1]), (f"ldapsearch -D cn=a -w {WEAK} -H h", [1]), (f"7z x a.7z -p{WEAK}", [1]),
]


@pytest.mark.parametrize(("text", "lines"), WHOLE)
def test_found_at_its_first_line(text, lines):
    assert sorted(set(lines_of(text))) == lines
    out = credentials.redact(text)
    assert len(out) == len(text) and [c for c in out if c.isspace()] == [c for c in text if c.isspace()]
    assert PW not in out and WEAK not in out and TOKEN[9:] not in out and BODY[:64] not in out and BODY[-64:] not in out


NONE = ['{"Enter your password": "Kennwort eingeben"}', '{"New password": "Kennwort"}', "let password: &str = get(\"x\");", 'getPassword("db.main1")', "url = /a%20b%2Fc?x=%7Btoken%7D", f"{mark('BEGIN')}\n{'x' * 64}\n{mark('END')}", f"{mark('BEGIN')}\nMIIE...\n{mark('END')}",
        f"{mark('BEGIN')}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n{BODY}\n{mark('END')}", "x = " + b64("nothing to see in here\nand nothing there\n", 3), 'a = "one" +\n    "two"', "names = [\"password\",\n  \"token\"]", "- name: DB_PASSWORD\n- value: abc1defg"]


@pytest.mark.parametrize("text", NONE)
def test_nothing_more_is_found(text):
    assert credentials.find_in_text(text) == []


def test_named_concatenation_of_any_length():
    parts = [made(60) for _ in range(90)]
    text = "password = " + " + ".join(f'"{p}"' for p in parts)
    assert not any(p in credentials.redact(text) for p in parts)


def test_key_behind_an_interruption_and_from_the_piece_before():
    first, last = BODY[:129], BODY[130:]
    text = f"{mark('BEGIN')}\n{first}\n  <!-- a note -->\n{last}\n{mark('END')}\npassword = {PW}\n"
    out = credentials.redact(text)
    assert lines_of(text) == [1, 8] and first[:64] not in out and last[:64] not in out and "<!-- a note -->" in out
    later = f"{last}\n{mark('END')}\npassword = {PW}\n"
    assert lines_of(later) == [4] and last[:64] not in credentials.redact(later)


def test_wrapped_base64():
    run = b64(f"user=svc and some more words\npassword={PW}\nhost=h and more\n")
    text = "data: |\n" + "\n".join(f"  {run[i:i + 30]}" for i in range(0, len(run), 30)) + "\nend"
    at = lines_of(text)
    assert len(at) == 1 and 1 < at[0] < 5
    hidden = credentials.redact(text).split("\n")[at[0] - 1:]
    assert set(hidden[0].strip()) == {"*"}


def test_cut_texts():
    assert credentials.find_in_text("a PRIVATE KEY without its marks: " + mark("BEGIN")[:-3]) == []
    for text, _ in WHOLE:
        for a in range(0, len(text), 7):
            for part in (text[a:], text[:a]):
                out = credentials.redact(part)
                assert len(out) == len(part) and out.count("\n") == part.count("\n")


def test_hostile_texts_end():
    for text in ("%" + "25" * 50_000 + "41", "\\" + "x5c" * 50_000 + "x41", "&" + "amp;" * 50_000 + "lt;", '"a" + ' * 20_000, (mark("BEGIN") + "\n") * 2_000):
        assert credentials.find_in_text(text) == []


def test_places_and_redacted_texts(spark, tmp_path):
    from driftnet.llm import queries

    rows = [(i, text, 0) for i, (text, _) in enumerate(WHOLE)]
    blobs = spark.createDataFrame([*rows, rows[0], (None, WEAK, 0), (-1, None, 0), (-2, "", None), (-3, f"password={WEAK}\nx\n", 2)], "blob_id long, text string, commit_line int")
    blobs.write.parquet(str(tmp_path / "blob_texts.parquet"))
    found = {(r["blob_id"], r["line_no"]) for r in queries.p5_found(spark, str(tmp_path)).collect()}
    assert found == {(i, x) for i, (_, at) in enumerate(WHOLE) for x in at}
    out = queries.queries()["p5_redacted_texts"](spark, str(tmp_path)).collect()
    texts = {r["blob_id"]: r["text"] for r in out}
    assert len(out) == len(texts) == len(WHOLE) + 3 and texts[-1] is None and texts[-2] == ""
    assert texts[-3] == "password=" + "*" * len(WEAK) + "\nx\n" and all(texts[i] == credentials.redact(t) for i, t, _ in rows)
