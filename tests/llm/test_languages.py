import numpy as np
import pytest

from siftwell.llm import languages as L

LINES = {
    "en": ["The old library sold two rows of chestnut trees.", "People from the north say that the weather station keeps the keys.", "Nobody wrote down why the queue grew longer.", "You can walk from the harbour to the swimming hall every spring."],
    "sv": ["Det finns många ställen där vattentornet lagade en hylla.", "Man kan gå från stationen till bageriet efter översvämningen.", "Biblioteket sålde två rader kastanjeträd och ingen vet varför.", "Kyrkokören kräver nya lyktor längs kanalen."],
    "de": ["Das kleine Kino schützt die Regeln für stille Stunden.", "Die alte Bücherei fotografierte eine Ausstellung von Glasflaschen.", "Leute aus dem Norden sagen, der Wasserturm braucht neue Laternen.", "Niemand weiß, warum die Schlange länger wurde."],
    "fr": ["Le bureau du port offre le plus long horaire de la région.", "Il y avait des personnes quand la coopérative répare la vieille horloge.", "Personne ne sait pourquoi la file est devenue plus longue.", "Le marché du samedi demande deux rangées de châtaigniers."],
    "es": ["La vieja biblioteca vende el horario más largo de la comarca.", "Hubo invitados cuando el coro exige una disputa por el aparcamiento.", "Nadie sabe por qué la cola se hizo más larga.", "La piscina cubierta protege las llaves del sótano."],
    "da": ["Byarkivet blev grundlagt og udskiftede to rækker kastanjetræer hvert forår.", "Folk fra byen siger, at vejrstationen fandt dalens ældste ur.", "Ingen ved, hvorfor køen blev længere efter sammenlægningen.", "Kirkekoret kræver nye lygter langs kanalen."],
    "ru": ["Старая библиотека продаёт самое длинное расписание в районе.", "Жители говорят, что ночной паром теряет новые фонари.", "Никто не знает, почему очередь стала длиннее.", "Крытый бассейн издаёт записи всех заседаний."],
}


@pytest.fixture(scope="module")
def model():
    texts = [s for c in L.CODES for s in LINES[c][:3]]
    return L.fit(texts, [i for i, _ in enumerate(L.CODES) for _ in range(3)], rounds=1)


def test_sentences():
    text = "{{infobox | A | thumb = a.png }}\r\nOne two three four. Is it (\"por el camino de\") here now? No.\nSee also: Some other page\n* info@x.example, 1903-11-26.\n<ref>12</ref>\nIt cost 12.50 kr to go there!\nwithout an end here it is"
    assert [s.split()[0] for s in L.sentences(text)] == ["One", "Is", "It"]
    assert L.sentences(None) == L.sentences("") == L.sentences("57 | 40 | 36") == []
    assert len(L.sentences("Wоrds аre hеrе now. " * 3000)) == 3000


def test_scores_are_the_kernel_machine(model):
    """One matrix product equals kernel values times dual weights."""
    text = ["The harbour office needs new trees."]
    assert L.CODES[model.scores(text).argmax()] == "en"
    p = model.presence(text)
    assert set(np.unique(p)) <= {0.0, 1.0}
    assert np.allclose(model.scores(text)[0], (p @ model.weights)[0] / np.sqrt(p.sum()), atol=1e-5)


def test_held_out(model):
    wrong = [(c, s) for c in L.CODES for s in LINES[c][3:] if L.CODES[model.scores([s]).argmax()] != c]
    assert len(wrong) <= 1


def test_fit_survives_wrong_labels():
    texts = [s for c in L.CODES for s in LINES[c] * 4]
    labels = [i for i, _ in enumerate(L.CODES) for _ in range(16)]
    labels[0], labels[17], labels[33] = 3, 0, 5
    fitted = L.fit(texts, labels)
    assert all(L.CODES[k] == c for c in L.CODES for k in fitted.scores(LINES[c]).argmax(axis=1))


def test_smooth():
    sure = np.log(np.array([[0.98, 0.01, 0.01], [0.3, 0.4, 0.3], [0.98, 0.01, 0.01], [0.01, 0.98, 0.01], [0.01, 0.98, 0.01]]))
    assert L.smooth(sure).tolist() == [0, 0, 0, 1, 1]
    assert L.runs(L.smooth(sure)) == [(0, 0, 3), (1, 3, 2)]
    assert L.runs(np.zeros(0, int)) == []


def test_documents(spark, model):
    en, sv = " ".join(LINES["en"]), " ".join(LINES["sv"])
    rows = [
        (1, en, "EN"), (2, en, None), (3, en, "sv-SE"), (4, en + "\n" + sv, "en"), (5, sv, "Svenska"), (6, None, "en"), (7, "", None), (8, "1 | 2", None), (9, LINES["de"][0], "??"),
        (10, sv, "nl"), (11, en + ' ("' + LINES["sv"][0][:30] + '")', "en_US"), (12, " ".join(LINES["ru"]), "Russian"), (12, " ".join(LINES["ru"]), "Russian"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id bigint, text string, lang string, label string, confidence double")
    parts = L.passages(df, model)
    held = L.held_languages(parts)
    assert sorted(map(tuple, L.wrong_labels(held).collect())) == [(2, "en"), (3, "en"), (4, "en"), (4, "sv"), (9, "de"), (10, "sv")]
    assert {r.doc_id for r in parts.where("lang is null").collect()} == {6, 7, 8}
    assert all(0 < r.confidence <= 1 for r in parts.where("lang is not null").collect())


def test_training_sample(spark):
    rows = [(i * 7 + k, " ".join(LINES[c]), c if i % 9 else "en") for i in range(40) for k, c in enumerate(L.CODES)]
    df = spark.createDataFrame(rows + rows[:50] + [(None, None, "en")], "doc_id bigint, text string, lang string")
    fitted = L.train(df, per_language=10)
    assert all(L.CODES[k] == c for c in L.CODES for k in fitted.scores(LINES[c]).argmax(axis=1))


def test_empty(spark, model):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert L.passages(df, model).count() == 0
    blank = L.train(df)
    assert L.wrong_labels(L.held_languages(L.passages(df, blank))).count() == 0
