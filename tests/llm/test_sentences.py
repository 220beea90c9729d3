"""Sentence boundaries: hand-marked texts in many languages (``|`` ends a sentence), edges."""

import pytest

from driftnet.llm import sentences

MARKED = [
    "The scanner ran at 7 a.m. and stopped at 8 p.m.| Dr. Smith saw 3.5 percent, e.g. in No. 4 of v2.1.|", "It waited... and then went on.| The U.S. mirror failed.| J. R. Hall left.|",
    'He wrote: "Stop the run. Rotate the key now."| The note said "do not touch a.tf. ever!" and he left.|', '"Who did it?" asked Ann.| (See a.go for more.)| Was it so?!| Yes.|', "No blank here.|Then a new one starts.| See config.yaml or a.b.c there.|",
    "One line\nbreaks here.|\n\nA blank line ends|\n \nthis one|", "Am 18. März fand Fr. Adler z. B. das Passwort, Token usw. vor der Übergabe.| Laut Nr. 5 lief es bzw. stand es.|", "„Wer änderte das?“, fragte Karl.| Niemand sah 1.500 Treffer!|",
    "P. ex. le service a lu des clés, etc.| Selon l'art. 12, M. Petit et Mme Roux virent tout !| « Qui a lu ? » demanda Paul.|", "¿Por qué fue?| ¡El Sr. Ruiz copió todo!| Según la pág. 5, fue así.|",
    "См. стр. 5: нашёл ключ, т. е. 7 строк.| Ключи, пароли и т. п.| «Кто?» — спросили в чате.|", "为什么删除？|“请先看a.py。不要动它！”旧分支写道。|V2.1.3中发现了；检查了。|", "なぜ消したのか？|「確認してください。」と書いた。|（A.iniを参照。）|割合は5.3%だ。|",
    "ระบบลบไฟล์a.ini| ทีมงานพบค่า4.5| ผู้ตรวจสอบพบ|", "डॉ. राम ने देखा।| क्या हुआ?| टोकन हटाया।|", "حذف الماسح الملف a.js، ثم راجع 5.5.| لماذا؟| نعم!|", "Ο σαρωτής βρήκε το αρχείο, π.χ. το a.py.| Γιατί;| Ναι!|"]


@pytest.mark.parametrize("marked", MARKED)
def test_marked_texts(marked):
    text, want = marked.replace("|", ""), []
    for i, c in enumerate(marked):
        if c == "|":
            want.append(i - len(want))
    assert sentences.sentence_ends(text) == want


def test_ends_are_ordered_and_cover(sf, spark):
    for row in spark.read.parquet(f"{sf}/documents.parquet").limit(100).collect():
        ends = sentences.sentence_ends(row["text"])
        assert ends == sorted(set(ends)) and (not row["text"].strip() or ends[-1] == len(row["text"].rstrip()))


def test_unbalanced_quote_does_not_swallow_the_rest():
    assert len(sentences.sentence_ends('He said "stop. Then he left. Then she left. Then all left.')) >= 3


def test_operator(spark):
    rows = [(1, "One. Two.", "prose", "e"), (1, "One. Two.", "prose", "e"), (2, None, "prose", "e"), (None, "One.", "prose", "e"), (3, "", "prose", "e"), (4, " \n ", None, "e"), (5, "a = 1. B\n\n  c\n", "code", "e"), (6, " é日. X.", None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, end_pos string")
    got = sorted((r["doc_id"], r["sentence_no"], r["start_pos"], r["end_pos"]) for r in sentences.sentences(docs).collect())
    assert got == [(1, 1, 0, 4), (1, 2, 5, 9), (5, 1, 0, 8), (5, 2, 12, 13), (6, 1, 1, 4), (6, 2, 5, 7)]
    assert sentences.sentences(docs.select("doc_id", "text")).where("doc_id = 5").count() == 3
    assert sentences.sentences(docs.limit(0)).count() == 0


def test_very_long_paragraph():
    text = "This is one sentence of many words. " * 5000
    assert len(sentences.sentence_ends(text)) == 5000
    assert len(sentences.sentence_ends("x" * 300_000)) == 1
