"""Recall and precision on made-up data whose words stand in no list of the operators: damage, credentials, marked texts."""

import random
import string

from driftnet.llm import credentials, garbled, sentences

LETTERS = {"de": "abcdefghiklmnoprstuvwäöüß", "fr": "abcdefghijlmnopqrstuvéèàçêô", "es": "abcdefghijlmnopqrstuvñáéíóú", "pl": "abcdefghijklmnoprstuwyząęółśćż", "cs": "abcdefghijklmnoprstuvyzěščřžýáí",
           "tr": "abcdefghijklmnoprstuvyzçğıöşü", "ru": "абвгдежзийклмнопрстуфхцчшщыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώ"}
VOWELS = set("aeiouyäöüéèàêôñáíóúąęóěýáíıаеиоуыэюяαειουωάέήίόύώ")


def word(r, lang):
    """A word of alternating kinds of letters, as languages have them."""
    vowels = [c for c in LETTERS[lang] if c in VOWELS]
    others = [c for c in LETTERS[lang] if c not in VOWELS and c not in "ьы"]
    return "".join(r.choice(others) + r.choice(vowels) for _ in range(r.randint(2, 4)))


def text(r, lang, n):
    words = [word(r, lang) for _ in range(n)]
    return " ".join([words[0].capitalize(), *words[1:]]) + "."


def test_damage():
    r, hit, wrong, fixed, cases, clean = random.Random(5), 0, 0, 0, 0, 0
    for lang in LETTERS:
        for _ in range(60):
            line = text(r, lang, r.randint(4, 12))
            if line.isascii():
                continue
            clean += 1
            wrong += garbled.repair_line(line)[0] != "clean"
            codec = r.choice(["cp1252", "latin-1", "cp1251", "koi8-r", "cp437", "mac-roman"])
            try:
                damaged = line.encode().decode(codec)
            except UnicodeDecodeError:
                continue
            cases += 1
            state, back, _ = garbled.repair_line(damaged)
            hit += state != "clean"
            fixed += back == line
    print(f"damage: {hit} of {cases} found, {fixed} restored, {wrong} of {clean} clean lines marked")
    assert hit >= 0.9 * cases and fixed >= 0.9 * cases and wrong <= 0.1 * clean


def secret(r):
    return "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(14, 40))) + r.choice("7Qx") + r.choice("3Kz")


def test_credentials():
    r = random.Random(6)
    names = ["password", "api_key", "clientSecret", "DB_PASSWORD", "auth_token", "smtp.password", "signingKey", "private_key", "accessKey", "passphrase"]
    forms = ['{n} = "{v}"', "{n}: '{v}'", '"{n}": "{v}",', "export {n}={v}", "{n}={v}", '{o}.{n} = "{v}";', "const {n} = '{v}';", '{n} := "{v}"', "'{n}' => '{v}',", '{o}({n}="{v}")', "<{n}>{v}</{n}>"]
    benign = ['{o} = "{v}"', "{n} = os.environ['{O}']", "{n} = ${{{O}}}", '{n} = "<{o}>"', '{n} = "changeme"', "{n}: ********", '{n} = get_{o}("{o}")', "the {n} of {o} is rotated daily", '{n}_hash = "{h}"', '{n} = ""', '{n}: {{{{ vault.{o} }}}}']
    found = right = cases = wrong = 0
    for _ in range(600):
        name, other = r.choice(names), word(r, "de").encode("ascii", "ignore").decode() or "qu"
        fields = {"n": name, "v": secret(r), "o": other, "O": other.upper(), "h": "".join(r.choice("0123456789abcdef") for _ in range(64))}
        line = r.choice(forms).format(**fields)
        cases += 1
        hits = credentials.find_in_text(line)
        found += bool(hits)
        right += len(hits) == 1 and line[hits[0].start:hits[0].end] == fields["v"]
        line = r.choice(benign).format(**fields)
        wrong += bool(credentials.find_in_text(line))
    print(f"credentials: {found} of {cases} found, {right} with exactly their value, {wrong} of {cases} harmless lines marked")
    assert found >= 0.9 * cases and right >= 0.9 * cases and wrong <= 0.1 * cases


def test_sentences():
    r, same, made, given = random.Random(8), 0, 0, 0
    for _ in range(150):
        lang = r.choice([x for x in LETTERS if x != "el"])
        parts = []
        for _ in range(r.randint(2, 7)):
            body = text(r, lang, r.randint(4, 14))[:-1]
            if r.random() < 0.2:
                body += f" {r.randint(1, 99)}.{r.randint(1, 99)} {word(r, lang)}"
            if r.random() < 0.15:
                body += f' "{text(r, lang, 4)[:-1]}" {word(r, lang)}'
            parts.append(body + r.choice([".", ".", ".", "!", "?"]))
        ends, at = set(), 0
        for p in parts:
            at += len(p)
            ends.add(at)
            at += 1
        got = set(sentences.sentence_ends(" ".join(parts)))
        same += len(ends & got)
        made += len(ends)
        given += len(got)
    print(f"sentences: {same} of {made} ends found, {given - same} of {given} wrong")
    assert same >= 0.9 * made and same >= 0.9 * given
