"""Encoding repair: round trips of made-up damage, clean text left alone, edges."""

import pytest

from driftnet.llm import garbled

CLEAN = ["Die Prüfung löschte die Größe.", "La revisión olvidó una clave válida.", "Сервис проверил историю ветки до начала смены.", "夜间任务检查了有效的密钥。", "スキャナーは期限切れのトークンを検出した。", "حذف الماسح مفتاحا صالحا.",
         "Ο ελεγκτής βρήκε ένα ενεργό κλειδί;", "ทีมงานพบกุญแจที่ใช้งานได้", "स्कैनर ने पुराना टोकन हटाया।", "ATENÇÃO: NÃO APAGUE", "ł ż ź ć ś", "« x » coûte 12 £ ± 0,5 µs", "°C 4, ½ § 12 – x", "╔══════ x ══════╗", "✓ a → b … ok", "plain"]


@pytest.mark.parametrize("line", CLEAN)
def test_clean_lines_stay(line):
    assert garbled.repair_line(line) == ("clean", line, "")


@pytest.mark.parametrize("read_as", ["latin-1", "cp1251", "cp1250", "mac-roman", "cp437"])
@pytest.mark.parametrize("line", [CLEAN[0], CLEAN[2]])
def test_utf8_read_as_a_code_page(line, read_as):
    try:
        bad = line.encode().decode(read_as)
    except UnicodeDecodeError:
        pytest.skip("bytes that code page does not have")
    state, fixed, _ = garbled.repair_line(bad)
    assert (state, fixed) == ("repaired", line)


@pytest.mark.parametrize(("intended", "read_as", "line"), [("cp1251", "cp1252", CLEAN[2]), ("koi8-r", "cp1251", CLEAN[2]), ("gbk", "latin-1", CLEAN[3]), ("euc-jp", "latin-1", CLEAN[4]), ("cp1253", "cp1252", CLEAN[6])])
def test_one_legacy_for_another(intended, read_as, line):
    bad = line.encode(intended).decode(read_as)
    state, fixed, layers = garbled.repair_line(bad)
    assert state == "repaired" and fixed == line and layers


def test_two_layers_and_lost():
    twice = CLEAN[1].encode().decode("latin-1").encode().decode("latin-1")
    assert garbled.repair_line(twice)[:2] == ("repaired", CLEAN[1])
    assert garbled.repair_line("una clave v�lida")[0] == "lost"


def test_operator_edges(spark):
    bad = CLEAN[0].encode().decode("latin-1")
    rows = [(1, f"ok\r\n{bad}\nok", "x"), (1, f"ok\r\n{bad}\nok", "x"), (2, None, "x"), (None, bad, "x"), (3, "", "x"), (4, "ascii only", "x")]
    blobs = spark.createDataFrame(rows, "blob_id long, text string, line_no string")
    got = garbled.garbled_lines(blobs).collect()
    assert [(r["blob_id"], r["line_no"], r["repaired"]) for r in got] == [(1, 2, CLEAN[0])]
    texts = {r["blob_id"]: r["text"] for r in garbled.repaired_texts(blobs).collect()}
    assert texts == {1: f"ok\r\n{CLEAN[0]}\nok", 2: None, 3: "", 4: "ascii only"}
    assert garbled.garbled_lines(blobs.limit(0)).count() == 0
    assert garbled.repair_line("é" * 200_000 + bad)[0] in ("clean", "repaired", "partly", "lost")


@pytest.mark.parametrize("line", ["für", "été", "señor", "il a été changé où", "La revisión olvidó una clave válida.", "или"])
def test_utf8_read_as_thai(line):
    assert garbled.repair_line(line.encode().decode("cp874"))[:2] == ("repaired", line)


@pytest.mark.parametrize(("intended", "read_as"), [("cp1251", "koi8-r"), ("koi8-r", "cp1251")])
@pytest.mark.parametrize("line", ["удалить старый ключ", "УДАЛИТЬ СТАРЫЙ КЛЮЧ", "# ревизор нашёл лишний пароль от config"])
def test_russian_lines_whose_case_was_swapped(line, intended, read_as):
    assert garbled.repair_line(line.encode(intended).decode(read_as))[:2] == ("repaired", line)


@pytest.mark.parametrize("line", ["УДАЛИТЬ СТАРЫЙ КЛЮЧ", "удалить старый ключ", "США", "ФСБ", "эхо", "юг", "почему", "ЦЕХ № 5"])
def test_capitals_and_short_words_stay(line):
    assert garbled.repair_line(line) == ("clean", line, "")
