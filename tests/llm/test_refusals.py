"""Refusals in words that no template was written from, and answers that only sound like them."""

import pytest

from inkwell.llm.answers import common_length, copies
from inkwell.llm.refusals import refuses

HELD_OUT = {
    "en": [
        "I won't be classifying this sentence.", "Sorry, this is not something I'm able to judge.", "I regret that I can't give a rating here.", "We are not permitted to score such material.",
        "I'm going to have to decline this one.", "My policy does not allow me to evaluate it.", "This prompt violates our content policy.", "I would rather not judge this passage.",
        "I refuse to assign anything to this pair.", "It isn't possible for me to assess the edit.", "Without more context I cannot decide on a verdict.", "I am not comfortable grading this text.",
        "Rating this pair is beyond what I can do.", "I must refrain from answering.", "Unable to process this request.",
    ],
    "de": [
        "Ich werde diesen Satz nicht beurteilen.", "Leider bin ich nicht in der Lage, das zu bewerten.", "Es ist mir nicht möglich, hier ein Urteil zu fällen.", "Ich darf dazu keine Bewertung abgeben.",
        "Ich verweigere die Antwort auf diese Anfrage.", "Diese Aufgabe widerspricht unseren Vorgaben.", "Ich möchte mich dazu nicht äußern und verzichte auf eine Einstufung.", "Ohne weiteren Kontext kann ich das nicht einschätzen.",
        "Der Inhalt verstößt gegen die Regeln.", "Dafür bin ich nicht zuständig und kann keine Antwort geben.",
    ],
    "es": [
        "No voy a evaluar esta oración.", "Me temo que no puedo clasificar el texto.", "Debo rechazar la tarea.", "Prefiero no juzgar este fragmento.", "No tengo permitido calificar contenidos así.",
        "Esta consulta infringe nuestras políticas.", "Me niego a dar una etiqueta.", "Soy incapaz de valorar el cambio.", "No hay contexto suficiente para responder.", "Nos es imposible atender la petición.",
    ],
    "uk": [
        "Я не буду оцінювати це речення.", "Мені неможливо це розсудити.", "Я відмовляюся відповідати на запит.", "Це прохання порушує наші правила.", "Не маю права класифікувати такий текст.",
        "На жаль, ми не здатні обробити цей запит.", "Бракує контексту, щоб дати оцінку.", "Я утримаюся від оцінки.", "Мушу відхилити це завдання.", "Я не хочу судити цей уривок.",
    ],
}
#: Written after the templates stood as they are now.
LATER = {
    "en": [
        "I'm not going to weigh in on this text.", "We cannot give you an opinion on this content.", "I don't feel able to review this.", "It would be wrong of me to score this, so I won't answer.",
        "My instructions prevent me from judging such texts.", "I have decided not to rate this pair.", "I would prefer not to comment on this sentence.", "That question conflicts with the rules I follow.",
        "There is too little context for a decision, so I must abstain.", "I'm afraid no evaluation is possible for me here.",
    ],
    "de": ["Ich sehe mich außerstande, das zu bewerten.", "Hierzu gebe ich keine Einschätzung ab.", "Tut mir leid, dabei darf ich nicht behilflich sein.", "Ich lehne es ab, diesen Text einzustufen.", "Das kann ich nicht beantworten.", "Dazu werde ich mich nicht äußern.", "Ich bitte um Verständnis, dass ich hier kein Urteil abgeben kann.", "Mir fehlen die nötigen Angaben für eine Bewertung."],
    "es": ["No estoy en condiciones de juzgar esto.", "Rehúso contestar a esta pregunta.", "Mis reglas no me dejan evaluar este texto.", "No quiero opinar sobre este par.", "Lamentablemente no podemos procesar la solicitud.", "Me abstengo de clasificar la frase.", "Faltan datos para emitir un juicio.", "No me corresponde valorar este contenido."],
    "uk": ["Я не маю дозволу оцінювати цей текст.", "Не можу надати відповідь на це питання.", "Ми не беремося судити про це.", "Мої правила не дозволяють оцінювати такий вміст.", "Я змушена утриматися від відповіді.", "Неможливо дати оцінку без контексту.", "Я не готовий класифікувати цю пару.", "Перепрошую, але допомогти не зможу."],
}
LAST = {
    "en": ["Judging the pair is not something I do.", "I have to turn down this request.", "Our terms forbid me from scoring this.", "I’d be unable to decide on a label here.", "Please understand that I will not rate it.", "I can't say whether this edit is correct.", "I am choosing not to answer.", "We won’t be giving feedback on this sentence."],
    "de": ["Ich gebe hierzu kein Urteil ab.", "Es tut mir leid, aber ich bin nicht befugt, das zu bewerten.", "Meine Regeln untersagen mir eine Bewertung.", "Eine Einstufung ist mir hier nicht möglich.", "Ich will diesen Satz nicht einordnen.", "Das darf ich leider nicht kommentieren."],
    "es": ["No estoy autorizado a valorar la frase.", "No daré una calificación.", "Las normas me impiden juzgar el texto.", "Lo lamento, no me es posible responder.", "Preferiría no dar mi opinión.", "Tengo que negarme a evaluar esto."],
    "uk": ["Я не стану оцінювати це речення.", "Нам заборонено судити про такий вміст.", "Не беруся класифікувати цей текст.", "Мені не дозволено давати оцінку.", "Відмовляюся оцінювати цю пару.", "Я не можу сказати, чи правильна ця правка."],
}
NO_REFUSAL = [
    "The writer says sorry in the first clause, and I cannot agree with the edit that removes it.", "One can’t help noticing that the original is unable to stand alone.", "I checked the clause twice and see no further problem.",
    "Das Wort „leider“ darf bleiben, ich kann der Streichung nicht zustimmen.", "La expresión «lo siento» es correcta y no puedo aceptar que se borre.", "Слово «вибачте» тут доречне, тож я не можу погодитися з його вилученням.",
    "The edit does not change the meaning.", "Die Änderung ist nicht nötig.", "El cambio no es necesario.", "Правка не змінює змісту.", "The comma must not be deleted.", "", "ok",
    "The speaker in “I cannot help you with this request” is quoted correctly.", "The original violates the rule for commas.",
]


def test_held_out_refusals():
    for sample in (HELD_OUT, LATER, LAST):
        texts = [t for of_lang in sample.values() for t in of_lang]
        assert sum(map(refuses, texts)) >= 0.9 * len(texts), [t for t in texts if not refuses(t)]


@pytest.mark.parametrize("text", NO_REFUSAL)
def test_no_refusal(text):
    assert not refuses(text)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_length():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randrange(90))] for _ in range(2))
        assert common_length(a, b) == slow_lcs(a, b)


def test_copies():
    src, tgt = "The cat sat on a mat near the old door.", "The cat sat on the mat near the old door."
    for text in (src, tgt.upper(), f"Original: {src}\nCorrected: {tgt}", f"- {tgt}\n- {src}", f"{src} {src}"):
        assert copies(text, src, tgt)
    for text in ("The edit changes “a” to “the”, which is right.", f"{src} TP", "The", "", "The cat sat on a mat, and the edit adds an article before it."):
        assert not copies(text, src, tgt)
    assert copies("Hello there", "hello there!", "Hello, there.")
    assert not copies("Hello", "hello there!", "Hello, there.")
    assert not copies("anything", None, None)
