"""Refusals, found by aligning a sentence slot by slot with templates.

A template is a row of slots, not of words: who speaks, that something is not possible,
what was asked for.  Each slot has its words in four languages, mostly as stems, and a
sentence refuses when the slots of a template stand in it in order, each within a few
words of the one before.  Quotations are not the judge's own speech and are left out.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Words that may stand between two slots of a template.
GAP = 7
#: The words of each slot; a star ends a stem.
SLOTS = {
    # the judge speaks, in a pronoun or a verb of the first person
    "self": "i i'm i'll i'd i've we we'll we're me my us our ich mir mich mein* wir uns unser* yo me mi mis nos nosotros nuestr* soy estoy я мені мене мій моя мої моїм моїх моїми ми нам нас наш* assistant sprachassistent* asistente помічник*",
    "not": "not no nor never nothing isn't aren't don't doesn't nicht nichts kein* nie no ni nunca nada ninguna ninguno ningún не ні ніколи нічого жодн* нема немає",
    "can": "able can could going want wish feel intend inclined entitled authorized authorised decided chosen choose choosing do possible position allowed permitted comfortable willing capable kann können könnte* möglich imstande lage darf dürfen möchte will werde wollen gebe vergebe erteile treffe fälle nehme leiste sehe befugt berechtigt entschieden posible corresponde autorizad* decidido capaz можливо можливост* можна дозвол* права вирішив вирішила змог* спроможн* здатн* готов*",
    # not and can, or not and will, in one word or with the person in the verb
    "cannot": "cannot can't couldn't unable won't wouldn't incapable impossible unfähig außerstande unmöglich incapaz imposible неможливо неспроможн* нездатн*",
    "i_can": "puedo podré podría podemos debo voy vamos quiero queremos pienso pensamos logro consigo sé tengo tenemos haré daré emitiré можу зможу можемо буду маю хочу вмію берус* берем* стану наважус*",
    "decline": "decline* declining refuse* refusing refrain* abstain* withhold* ablehnen lehne verweiger* weigere* enthalte* verzichte* negar* niego rechaz* declin* abstener* abstengo rehús* rehus* excus* відмовля* відмовит* відмовл* утрим* ухил* відхил*",
    "turn": "down reject* zurückweis* zurück",
    "must": "must have need should rather muss müssen lieber debo tengo prefiero мушу маю змушен* вимушен* краще",
    "rather": "rather prefer prefiero preferimos lieber краще",
    "task": "help helping assist assisting assistance rate rating evaluat* judg* assess* classif* label* categor* grade grading score scoring answer* respond* reply* comply fulfil* fulfill* provid* process* review* comment* kommentier* сказати сказать висловл* complete completing handle handling engage offer give giving render opinion opine verdict decide decision weigh say speak advise perform determine tell helfen behilflich äußer* stellung entscheid* abgeben unterstütz* hilfe bewert* beurteil* einstuf* einordn* einzuordn* klassifizier* einschätz* urteil* antwort* beantwort* dienen bearbeit* erfüll* etikett* ayud* valor* evalu* juzg* clasific* calific* etiquet* respond* contest* atend* opin* proces* tramit* decid* determin* pronunciar* asist* dar daré emitir emito pronunci* complac* допомог* допомаг* оцін* суди* розсуд* класифік* відповід* відповіс* визначит* визначат* надат* надава* давати дати дам прокоментув* коментув* оброб* викона* позначит*",
    "request": "request* question* prompt task tasks query content topic instruction* anfrage* frage* bitte aufgabe* anliegen inhalt* auftrag* solicitud* petición peticiones consulta* pregunta* tarea* encargo contenido запит* прохання завданн* питанн* вміст* тем*",
    "against": "against violat* prevent* forbid* prohibit* bars stop* hinder* untersag* verbiet* verbot* impid* prohíb* prohib* забороня* заборонен* conflict* contra* outside breach* beyond verst* widersprech* widerspricht gegen außerhalb contra* viola* infring* incumpl* fuera супереч* поруш* проти поза",
    "rules": "guideline* polic* rule* instructions programming training standard* principle* restriction* terms richtlinie* regel* vorgaben grundsätz* vorschrift* normas norma reglas polític* directric* principios правил* політи* принцип* норм* обмежен* настанов*",
    "little": "not enough insufficient lacking lack too nicht wenig fehl* unzureichend* falta* insuficiente* suficiente* bastante недостатньо замало бракує мало",
    "facts": "information context details data kontext informationen angaben details información contexto datos detalles інформаці* контекст* даних відомост*",
}
#: The templates, each slot by name.
TEMPLATES = (
    ("self", "cannot", "task"), ("self", "not", "can", "task"), ("self", "can", "not", "task"), ("can", "self", "not", "task"), ("not", "self", "can", "task"),
    ("cannot", "self", "task"), ("not", "i_can", "task"), ("not", "self", "i_can", "task"), ("i_can", "not", "task"), ("not", "can", "self", "task"),
    ("task", "self", "cannot"), ("task", "self", "not", "can"), ("task", "not", "i_can"), ("task", "can", "self", "not"), ("not", "task", "self", "can"),
    ("self", "decline", "task"), ("decline", "self", "task"), ("self", "must", "decline"), ("must", "self", "decline"), ("must", "decline", "task"), ("self", "task", "decline"), ("self", "must", "task", "decline"), ("decline", "task"),
    ("self", "decline", "request"), ("request", "decline"), ("request", "must", "self", "decline"), ("must", "decline", "request"),
    ("request", "against", "self", "rules"), ("request", "against", "rules"), ("self", "rules", "not", "task"), ("self", "rules", "not", "can"), ("rules", "self", "not", "task"),
    ("little", "facts", "task"), ("facts", "little", "task"), ("not", "self", "task"),
    ("rather", "not", "task"), ("cannot", "task", "request"), ("task", "against", "self", "can"), ("self", "decline"),
    ("rules", "against", "task"), ("rules", "against", "self"), ("not", "task", "can", "self"), ("self", "not", "task", "can"), ("cannot", "task", "task"), ("self", "against", "task"), ("self", "turn", "request"), 
)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“]*“|\"[^\"]*\"")
_WORD = re.compile(r"\w+(?:['’]\w+)*")
_EXACT: dict[str, set[str]] = {}
_STEMS: list[tuple[str, str]] = []
for _name, _list in SLOTS.items():
    for _w in _list.split():
        if _w.endswith("*"):
            _STEMS.append((_w[:-1], _name))
        else:
            _EXACT.setdefault(_w, set()).add(_name)
#: A refusal has one of these slots.
_NEEDED = frozenset(("not", "cannot", "decline", "against", "little", "turn"))


@lru_cache(200_000)
def slots_of(word: str) -> frozenset[str]:
    """The slots a word may fill."""
    return frozenset(_EXACT.get(word, ())) | {name for stem, name in _STEMS if word.startswith(stem)}


def aligned(slots: list[frozenset[str]], template: tuple[str, ...]) -> bool:
    """The template's slots stand in the sentence in order, at most GAP words apart."""
    ends = [i for i, s in enumerate(slots) if template[0] in s]
    for name in template[1:]:
        if not ends:
            return False
        ends = [i for i, s in enumerate(slots) if name in s and any(0 < i - e <= GAP + 1 for e in ends)]
    return bool(ends)


def refuses(text: str) -> bool:
    """Some sentence of the text, without its quotations, refuses the task."""
    for sentence in _SENTENCE.split(_QUOTED.sub(" ", text)):
        slots = [slots_of(w) for w in _WORD.findall(sentence.lower().replace("’", "'"))]
        have = frozenset().union(*slots)
        if have & _NEEDED and ("task" in have or "request" in have or "decline" in have) and any(have.issuperset(t) and aligned(slots, t) for t in TEMPLATES):
            return True
    return False
