import pytest

from tessellore.llm import sentences as sn

FILLER = {
    "en": ["The queue is empty.", "Use the form of Norbex.", "Dr. Vik wrote it.", "Mr. and Mrs. Vik own it.", "See No. 3 of the list.", "It ends at 9 a.m.", "Keep the note, the form, etc.", "When is it done?", "A call, e.g. of Norbex, is short.", "It ended at 9 p.m. Norbex time.", "No. It waits."],
    "de": ["Die Vorlage ist leer.", "Am 3. März wird Norbex abgeschaltet.", "Dr. Vik sagte das.", "Das gilt z. B. für Vik.", "Wer löscht, verliert das.", "Ist die Mappe leer?"],
    "ru": ["Шаблон пустой.", "В 2020 г. сервис закрыли.", "Это верно, т. е. поле пустое.", "А. В. Норб написал шаблон."],
    "hi": ["टोकन के बिना कतार खाली है।", "डॉ. Norbex ने फ़ील्ड बदल दी।"],
    "ko": ["템플릿은 다시 만들어집니다.", "토큰이 없으면 비어 있습니다."],
}


def corpus():
    rows = []
    for language, sentences in FILLER.items():
        for i in range(120):
            part = [sentences[(i * 7 + k * (1 + i % 5)) % len(sentences)] for k in range(6)]
            names = ["Norbex", "Vikor", "Tamund", "Delquay", "Fenrow"]
            rows.append((" ".join(x.replace("Norbex", names[(i + k) % 5]) for k, x in enumerate(part)), language))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return sn.learn(spark.createDataFrame(corpus(), "text string, lang string"))


def units(text, model, lang=None):
    return [text[a:b] for a, b in sn.units_of(text, lang, model)]


SPLIT = [
    "The queue is empty.|Use the form.|Dr. Vik wrote it.",
    "Mr. and Mrs. Vik own 3 rows, e.g. these.|See No. 4 of the list.|No.|The form waits.",
    "It ends at 9 a.m.|The form is at $9.50 on 10.0.8.3 now.|Why not?!|Yes!|Stop!",
    "Keep the form, etc.|Norbex waits.|It ended at 9 p.m. Norbex time.",
    "The console prints \"It failed. Retry now.\" and closes.|The banner reads “Read this! It matters.” on each.|‘Stop. Wait.’ is all.",
    "(Skip this if it is set.)|The form (see sect. 4. It is short.) explains it [see Vik et al.; ch. 4].",
    "Wait… the form is empty.|The call may hang ... but the form stays.",
    "Field Loan.Old.Status replaces it.|The file a-b.tar.gz holds it.|iNorbex reads it.|tenantKey must be set.",
    "The queue is empty.|Use the form.",
    "Am 3. März wird die Mappe geprüft.|Dr. Vik sagte: „Das Feld ist leer. Sie warten.“|Die Mappe ist leer.|„Löschen!“, warnt die Mappe.",
    "M. Vik a écrit : « Le champ est vide. Attendez. »|« Pourquoi pas ? » demande la console.|Arrêtez tout !|Le modèle est vide.",
    "¿Por qué falla?|¡Detenga todo!|«¿Y ahora?», pregunta la consola.",
    "Шаблон пустой.|В 2020 г. сервис закрыли.|А. В. Норб написал шаблон.|«Не удалять!» — пишет консоль.",
    "Γιατί αποτυγχάνει το X;|Το X σταματά· το X συνεχίζει.",
    "لماذا يفشل X؟|قال المدير: «الحقل فارغ. انتظر.»|يرتفع السعر بنسبة 2.2 بالمئة؛ ثم يتوقف X.",
    "कतार खाली है।|डॉ. Norbex ने फ़ील्ड बदल दी।|उन्होंने कहा, “फ़ील्ड खाली है। रुकिए।”|a-b.yaml खोलिए।",
    "담당자는 “비었습니다. 기다리세요.”라고 말했습니다.|버전 8.0은 오래되었습니다!",
    "คิวของ X ว่างเปล่า|แม่แบบของ X ถูกสร้างใหม่",
]
JOINED = [
    "控制台显示“请重试！不要关闭。”并退出。|真的吗？！|他说：“字段为空。请稍等。”|模板每晚重新生成。|（参见第68节。）|版本v8.3支持X……但不支持Y。",
    "担当者は「項目が空です。お待ちください。」と答えました。|バージョン7.9（古い版です。）は使えません。|本当ですか？！",
    "The queue is empty.|Use the form.|Dr. Vik wrote it.",
]


@pytest.mark.parametrize("text", SPLIT)
def test_units_with_spaces(text, model):
    assert units(text.replace("|", " "), model) == text.split("|")


@pytest.mark.parametrize("text", JOINED)
def test_units_without_spaces(text, model):
    assert units(text.replace("|", ""), model) == text.split("|")


def test_lines_lists_and_headings(model):
    text = "\n  What changed\n\nThe queue is\nempty. Use the\nform.\n\n1. The form is empty. Use it.\n2. The form\nwaits.\n3) no\n\n- one\n• The form waits.\n\n\n  Rows\n9. to 12. are skipped.  "
    assert units(text, model, "en") == ["What changed", "The queue is\nempty.", "Use the\nform.", "1. The form is empty.", "Use it.", "2. The form\nwaits.", "3) no", "- one", "• The form waits.", "Rows\n9. to 12. are skipped."]


def test_positions_are_code_points(model):
    text = " 😀 The form. Use\xa0it. "
    assert sn.units_of(text, "en", model) == [(1, 12), (13, 20)]


def test_language_of():
    assert [sn.language_of(t, None) for t in ("The form is in the queue", "Die Mappe ist leer und alt", "Le champ est vide", "La cola no es una", "ひらがな漢字", "漢字", "한국어", "ไทย", "नमस्ते", "שלום", "Norbex")] == ["en", "de", "fr", "es", "ja", "zh", "ko", "th", "hi", "en", "en"]
    assert sn.language_of("Norbex", "de") == "de"


def test_declared_languages_without_a_list_are_kept():
    pt = "Os campos do formulário ficam vazios quando a fila para, por isso o serviço não responde."
    pl = "Kolejka jest pusta i to pole nie ma wartości, a system czeka na nowy wpis do listy."
    it = "La coda è vuota e il modulo non si apre, per questo il servizio non risponde più."
    assert [sn.language_of(t, h) for t, h in ((pt, "pt"), (pl, "pl"), (it, "it"))] == ["pt", "pl", "it"]
    assert sn.language_of("The form is in the queue, and it waits for the call of the desk.", "pt") == "en"
    assert [sn.hint_of(x) for x in ("EN", "pt-BR", "en_XX", "??", "", None, "english language")] == ["en", "pt", "en", None, None, None, None]


def test_collocations_are_learned(spark):
    """A word that follows an abbreviation's period again and again, and one that follows a name behind it."""
    names = ["Norbex", "Vikor", "Tamund", "Delquay", "Fenrow", "Olsi", "Wexa", "Galt"]
    rows = []
    for i in range(400):
        a, b = names[i % 8], names[(i + 3) % 8]
        rows.append((f"The form of {a} waits. It ended at 9 p.m. {b} time. It began at 4 p.m. The desk of {b} waits. See the list of {a} Inc. Holdings here. The list of {b} Inc. The queue waits for {a}. When is it done? It waits. If {a} stops, {b} waits. Is it the form? The form waits.", "en"))
    model = sn.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert ("en", "p.m", "_ time") in model.collocations and ("en", "inc", "Holdings") in model.collocations
    assert units("It ended at 9 p.m. Zubrow time. It is at Norbex Inc. Holdings now.", model) == ["It ended at 9 p.m. Zubrow time.", "It is at Norbex Inc. Holdings now."]


def test_dirty_rows(spark, model):
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, " \n\n ", "??", "x"), (4, "The form. Use it.", "XX", "x"), (4, "The form. Use it.", "XX", "x"), (5, "a " * 30_000 + "." * 30_000 + "\"" * 5_000 + "(" * 5_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, start_char string")
    got = sorted((r["doc_id"], r["start_char"], r["end_char"]) for r in sn.split_sentences(df, model=model).collect())
    assert [g for g in got if g[0] != 5] == [(4, 0, 9), (4, 0, 9), (4, 10, 17), (4, 10, 17)]
    assert sn.split_sentences(df.limit(0)).count() == 0


def test_large_models_travel_by_the_shared_folder(spark, model, monkeypatch):
    monkeypatch.setattr(sn, "MOST_ENTRIES", 3)
    df = spark.createDataFrame([(1, "Dr. Vik wrote it. The form waits.", "en")], "doc_id bigint, text string, lang string")
    assert sorted((r["start_char"], r["end_char"]) for r in sn.split_sentences(df, model=model).collect()) == [(0, 17), (18, 33)]
