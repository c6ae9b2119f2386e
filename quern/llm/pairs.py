"""Question and answer pairs whose answer is no usable reply, by a multi-label linear classifier.

Features are hashed n-grams of the answer - of the whole of it, its beginning, its last sentence and, by
distance from the end, its end - and features of the pair: what the answer adds to
the question's words, in which languages both are written, what is left open at
the end, and how often the corpus ends a clause with the answer's last word. There
are no labels: usable answers of a bounded sample are truncated, replaced by the
question, by an answer to a question in another language, by the answer to another question, by a refusal, at times
behind a long preamble, or by
nothing. One logistic regression a defect is fitted on those, each with a
threshold that is calibrated on a held-out part. Sampled answers that the first
fit finds defective are left out of the second. The model alone decides, of null answers too.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _base
from quern.llm.text import Hashes, mix, word_hashes
from quern.session import spread

DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated", "swapped")
#: Most pairs that the classifier is fitted on.
SAMPLE = 1800
#: Share of all pairs that a defect is taken to have when its threshold is calibrated: synthetic pairs are mostly defective.
PRIOR = 0.06
_DIMS = 1 << 16

# ---- fixed word lists: frequent function words by language
_FUNCTION = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our me even most made after also did many before must through how does where why explain once during unless since below whereas between without",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum haben nur oder aber vor zur bis mehr durch man sein wurde wenn ohne ich wir ihr kann keine warum welche welcher jeder jede zwischen weil sofern danach außerdem gilt regel",
    "fr": "le la les de des du et un une en est que qui dans pour pas sur au avec il ne se ce plus par je sont ou mais comme nous vous elle aux cette ces son sa ses leur été être fait sans si tout dont chez entre chaque car après comment pourquoi quel quelle lorsque jusqu puis défaut général rarement souvent",
    "es": "el la los las de del y un una en es que se por con para no su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos cada tras cómo qué cuál luego según defecto general otra vez",
    "it": "il lo gli le di che è e un una per non con si da come dei nel della sono alla anche più ma ha al delle questo quando dove perché senza tra fra molto ogni dopo prima",
    "pt": "o os as de do da dos das e um uma em é que para não com se por mais na no ao como mas foi ele ela sem entre também quando muito nos já está cada após onde porque",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij door over uit naar nog wordt heeft deze die ze wij hij zonder tussen elke wanneer waarom hoe",
}
_BY_WORD: dict[str, tuple[str, ...]] = {}
for _lang, _words in _FUNCTION.items():
    for _w in _words.split():
        _BY_WORD[_w] = (*_BY_WORD.get(_w, ()), _lang)
_SCRIPTS = ("LATIN", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "CYRILLIC", "ARABIC", "GREEK", "HEBREW", "DEVANAGARI", "THAI")

# ---- what synthetic refusals and empty answers are made of: beginnings, statements, ends
_REFUSALS = {
    "en": (
        ["I can't help with {x}.", "I cannot answer this question.", "I'm unable to assist with {x}.", "I am not able to help with that.", "I don't know.", "I have no idea, to be honest.", "I don't have enough information to answer.", "I have no information about {x}.", "There is no information about this in the context.", "The provided context does not mention {x}.", "The documents do not say anything about this.", "I could not find anything about {x} in the documents.", "No relevant passages were found, so I can't answer.", "I must decline to answer.", "I'm not allowed to discuss {x}.", "That is not something I can discuss.", "My guidelines do not let me answer this.", "My instructions prevent me from answering.", "I won't be able to answer that question.", "I cannot provide an answer to this request.", "There is nothing about {x} in the sources, so I would rather not answer.", "The sources are silent on this and I do not want to guess.", "I'd rather not speculate about that.", "Answering {x} is beyond what I can do.", "This is outside my knowledge."],
        ["", "Sorry, ", "I'm sorry, but ", "Sorry — ", "Unfortunately, ", "I apologise, but ", "I apologize, however ", "As an AI assistant, ", "As a language model, ", "Hmm. ", "Well, "],
        ["", " Please try another question.", " Please contact support.", " You may want to ask differently.", " Is there anything else I can help with?", " You could ask the maintainers of {n}.", " Please ask an administrator."],
    ),
    "de": (
        ["Ich kann diese Frage nicht beantworten.", "Dabei kann ich nicht helfen.", "Das weiß ich nicht.", "Darüber weiß ich leider nichts.", "Im Kontext steht dazu nichts.", "Ich habe dazu nichts gefunden.", "Die Dokumente enthalten keine Angaben zu {n}.", "Darüber darf ich keine Auskunft geben.", "Es tut mir leid, das kann ich nicht beantworten.", "Die Quellen geben darauf keine Antwort.", "Mir fehlen die Angaben, um das zu beantworten.", "Diese Auskunft ist mir nicht erlaubt.", "Ohne weitere Informationen kann ich keine Antwort geben."],
        ["", "Leider ", "Entschuldigung, ", "Tut mir leid, ", "Leider gilt: "],
        ["", " Bitte wenden Sie sich an den Support.", " Fragen Sie bitte das zuständige Team.", " Versuchen Sie eine andere Frage."],
    ),
    "fr": (
        ["Je ne peux pas répondre à cette question.", "Je ne sais pas.", "Je n'ai pas d'information à ce sujet.", "Le contexte ne contient pas la réponse.", "Il m'est impossible de vous aider.", "Je n'ai rien trouvé dans les documents.", "Je ne suis pas autorisé à en parler.", "Les sources ne disent rien de {n}.", "Les informations me manquent pour répondre.", "Aucun passage du contexte ne répond à cela.", "Je préfère ne pas me prononcer.", "Mes consignes ne me permettent pas de répondre."],
        ["", "Désolé, ", "Je suis désolé, ", "Malheureusement, ", "Je regrette, "],
        ["", " Veuillez contacter le support.", " Essayez une autre question."],
    ),
    "es": (
        ["No puedo responder a esa pregunta.", "No lo sé.", "No tengo información sobre esto.", "No puedo ayudar con {x}.", "No encontré nada sobre {n} en los documentos.", "Los documentos no dicen nada al respecto.", "No estoy autorizado a hablar de eso.", "No dispongo de información suficiente para responder.", "No cuento con datos suficientes para contestar.", "Las fuentes no mencionan {n}.", "El contexto dado no responde a la pregunta.", "Me resulta imposible ayudarle en esto.", "Mis instrucciones no me permiten contestar."],
        ["", "Lo siento, ", "Lamentablemente, ", "Por desgracia, ", "Disculpe, "],
        ["", " Consulte al soporte.", " Pruebe con otra pregunta.", " Pregunte al administrador."],
    ),
}
# a small grammar of the same: alternatives are drawn at random
_GRAMMAR = {
    "en": [
        [["The", "The provided", "The given", "The retrieved"], ["context", "material", "text", "passage"], ["does not mention", "does not cover", "does not contain", "says nothing about", "gives no answer on", "does not explain", "tells me nothing on"], ["this", "it", "that", "the topic", "anything on {n}"], ["."]],
        [["The documents", "The sources", "The passages", "My sources"], ["do not mention", "do not cover", "say nothing about", "hold no information on", "never speak of"], ["this", "it", "that", "the topic", "{n}"], ["", " at all", " anywhere"], [".", ", so I can't answer.", " and guessing would not help."]],
        [["There is", "I see", "I find", "I have"], ["nothing", "no mention", "no information", "no passage"], ["about", "on"], ["this", "it", "that", "{n}"], ["", " in the documents", " in the context", " in what I was given"], [".", ", so I can't say.", ", so I cannot answer.", " and I will not guess."]],
        [["No", "No useful", "No matching", "No relevant"], ["documents", "passages", "results", "sources"], ["were found", "came back", "were available", "turned up"], ["", " for this", " for {n}"], [".", ", so there is no answer I could give.", ", so I can't answer."]],
        [["I"], ["can't", "cannot", "am unable to", "am not able to", "am not allowed to", "must decline to", "won't", "would rather not"], ["answer", "help with", "discuss", "comment on", "assist with"], ["this", "that", "it", "your question", "{x}", "this request"], [".", " here.", ", I'm afraid."]],
        [["It is not", "This isn't", "That is not"], ["something", "a thing", "a matter"], ["I can", "I could", "I am allowed to", "I may"], ["discuss", "answer", "talk about", "help with"], ["."]],
    ],
    "de": [
        [["Der Kontext", "Der gegebene Kontext", "Der Text", "Das Material"], ["enthält", "nennt", "liefert"], ["dazu", "hierzu", "darüber"], ["nichts", "keine Angaben", "keine Information", "keine Antwort"], ["."]],
        [["Ich kann", "Ich darf", "Ich möchte"], ["das", "diese Frage", "Ihre Frage", "diese Bitte"], ["leider ", ""], ["nicht"], ["beantworten", "erfüllen", "behandeln", "besprechen"], ["."]],
        [["Zu {n}", "Dazu", "Hierzu"], ["habe ich", "finde ich", "gibt es"], ["nichts", "keine Angaben", "keine Unterlagen", "keine Auskunft"], ["", " in den Dokumenten", " im Text"], ["."]],
    ],
    "fr": [
        [["Le contexte", "Le texte fourni", "Le document"], ["ne dit rien", "ne contient rien", "ne donne aucune information"], ["à ce sujet", "là-dessus", "sur {n}", "sur ce point"], ["."]],
        [["Je ne peux pas", "Je ne suis pas en mesure de", "Je ne saurais"], ["répondre à", "traiter", "commenter"], ["cette question", "cette demande", "ce point"], ["."]],
        [["Je n'ai", "Je ne trouve"], ["aucune information", "rien", "aucun passage"], ["sur ce point", "à ce propos", "sur {n}"], ["."]],
    ],
    "es": [
        [["El contexto", "El texto dado", "El documento"], ["no dice nada", "no contiene nada", "no da información"], ["sobre esto", "al respecto", "sobre {n}"], ["."]],
        [["No puedo", "No me está permitido", "No soy capaz de"], ["responder a", "tratar", "comentar"], ["esa pregunta", "esta solicitud", "ese tema"], ["."]],
        [["No tengo", "No encuentro"], ["información", "datos", "ningún pasaje"], ["sobre esto", "al respecto", "sobre {n}"], ["."]],
    ],
}
_ABSENT = ["null", "none", "nil", "nan", "n/a", "na", "undefined", "void", "empty", "missing", "blank", "tbd", "todo", "no answer", "no response", "not available", "not provided", "no content", "error", "leer", "keine", "keine angabe", "keine antwort", "vide", "aucune", "aucune réponse", "vacío", "sin respuesta", "ninguna"]
_WRAPS = ["{}", "{}", "{}", "{}.", "{}.", "({})", "[{}]", "<{}>", '"{}"', "**{}**", "- {}", "{}\n", "Answer: {}"]
_SIGNS = ["", "", " ", "\n", "\t", "\xa0", "\u200b", "\ufeff", "\r\n", "-", "—", ".", "…", "?", "!", "*", "#", ">", "|", "_", "~", "=", '"', "'", "`", "[", "]", "{", "}", "(", ")", "<br>", "<p>", "</p>", "<div></div>", "**", "```", "\\n", ":", ";", "/"]
_LABELS = ["Response", "Reply", "A", "Question", "Antwort", "Réponse", "Respuesta", "Answer"]

_CHARACTERS = "的一是不了人我在有他这中大来上个国到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面公同三已老从动两长知民样现分将外但身些与高意进把法此实回二理美点月明其种声全工己话儿者向情部正名定女问力机给等几很业最间新什打便位因重被走电四第门相次东政海口使教西再平真听世气信北少关并内加化由却代军产入先山五太水万市眼体别处总才场师书比住员九笑性通目华报立马命张活难神数件安表原车白应路期叫死常提感金何更反合放做系计或司利受光王果亲界及今京务制解各任至清物台象记边共风战干接它许八特觉望直服毛林题建南度统色字请交爱让认算论百吃义科怎元社术结六功指思非流每青管夫连远资队跟带花快条院变联言权往展该领传近留红治决周保达办运武半候七必城父强步完革深区即求品士转量空甚众技轻程告江语英基派满式李息写呢识极令黄德收脸钱党倒未持取设始版双历越史商千片容研像找友孩站广改议形委早房音火际则首单据导影失拿网香似斯专石若兵弟谁校读志飞观争究包组造落视济喜离虽坏兴切府确切索引缓存"

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_MARK = re.compile(r"</?[a-zA-Z][^<>]{0,60}>|[*_~#>`\"“”«»]+")
_CODE = re.compile(r"```.*?(?:```|$)|`[^`\n]*`", re.S)
_QUOTED = re.compile(r"«[^«»]*»|“[^“”]*”|\"[^\"\n]*\"|„[^“”]*[“”]")
_BULLET = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s")
_SENTENCE = re.compile(r"[.!?。！？…]+[\"'”’»)\]*_]*(?:\s+|$)|\n+")
_URL = re.compile(r"https?://\S+$")
_LABEL = re.compile(r"^\W*(?:your question|you asked|question|answer|response|ihre frage|frage|antwort|votre question|question posée|réponse|su pregunta|tu pregunta|pregunta|respuesta)\s*:", re.I)


def words_of(text: str) -> list[str]:
    return _WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def last_word(text: str) -> str:
    """The last word, however long it is."""
    size = 80
    while True:
        tail = text[-size:]
        found = _WORD.findall(tail)
        if size >= len(text) or len(found) > 1 or (found and not tail.startswith(found[0])):
            return found[-1].lower() if found else ""
        size *= 8


_WITH_END = re.compile(r"([^\W_]+(?:['’][^\W_]+)*)([.!?。！？\n]?)")


def end_counts(texts: list[str]) -> tuple[Counter, Counter]:
    """How often each word occurs, and ends a sentence or line; a text's own last word is left out, as it is in question."""
    both: Counter = Counter()
    for text in texts:
        both.update(_WITH_END.findall(text.lower())[:-1])
    n, ends = Counter(), Counter()
    for (word, mark), c in both.items():
        n[word] += c
        if mark:
            ends[word] += c
    return n, ends


_ORDER = {lang: i for i, lang in enumerate(_FUNCTION)}
_ASCII_LETTERS = re.compile(r"[A-Za-z]+")
_BEYOND = re.compile(r"[^\x00-\x7f]")


def bare_of(text: str) -> str:
    """The text without what it quotes and without code."""
    if '"' in text or not text.isascii():
        text = _QUOTED.sub(" ", text)
    return _CODE.sub(" ", text) if "`" in text else text


def shares(words: list[str]) -> np.ndarray:
    """Shares of the languages' function words among all of the function words, weighed by how few languages share them; then how many there were."""
    out = [0.0] * (len(_FUNCTION) + 1)
    for w in words:
        for part in w.replace("’", "'").split("'") if "'" in w or "’" in w else (w,):
            of = _BY_WORD.get(part)
            if of:
                for lang in of:
                    out[_ORDER[lang]] += 1 / len(of) ** 2
                out[-1] += 1 / len(of)
    return np.array(out)


def languages(text: str) -> np.ndarray:
    return shares(words_of(bare_of(text)))


def script(text: str) -> np.ndarray:
    """Share of the letters of each script."""
    if text.isascii():
        return np.array([1.0 if s == "LATIN" and _ASCII_LETTERS.search(text) else 0.0 for s in _SCRIPTS])
    c = Counter(LATIN=sum(map(len, _ASCII_LETTERS.findall(text))))
    if not text.isascii():
        for ch, n in Counter(_BEYOND.findall(text)).items():
            if ch.isalpha():
                c[unicodedata.name(ch, "?").split(" ", 1)[0].split("-", 1)[0]] += n
    total = sum(c.values()) or 1
    return np.array([c[s] / total for s in _SCRIPTS])


@lru_cache(maxsize=4096)
def _asked(question: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, languages and scripts of a question: the same one is asked often."""
    return words_of(_MARK.sub(" ", question)), languages(question), script(question)


def _slot(kind: str, value: str) -> int:
    return xxhash.xxh32_intdigest(f"{kind}\x1f{value}") % _DIMS


_DENSE = 48
_HASHES = Hashes()
_FROM_QUESTION = "\x00q"
_NAMES = {n: np.uint64(xxhash.xxh64_intdigest(n)) for n in ("1s", "2s", "3s", "1l", "2l", "3l", "1z", "2z")}


def _grams(words: list[str], name: str, most: int) -> list[np.ndarray]:
    """Slots of the runs of one to ``most`` words."""
    h = word_hashes(words, _HASHES)
    out, run = [], h
    for n in range(1, min(most, len(h)) + 1):
        if n > 1:
            run = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :]
        out.append((mix(run ^ _NAMES[f"{n}{name}"]) % np.uint64(_DIMS)).astype(np.int64))
    return out


def features(question: str, answer: str, stat: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and dense ones. ``stat``: occurrences of the answer's last word in the corpus, and those that end a sentence."""
    a = answer if answer.isascii() else unicodedata.normalize("NFKC", answer)
    low = a.lower()
    bare = _MARK.sub(" ", low)
    aw = _WORD.findall(bare)
    qw, ql, qscr = _asked(question)
    lab = _LABEL.match(bare)
    core = _WORD.findall(bare[lab.end() :]) if lab else aw
    qs, n = set(qw), len(core)
    of = set(core)
    new = [w for w in core if w not in qs]
    left = Counter(core)
    left.subtract(Counter(qw))
    unsaid = bare_of(a)
    plain = aw if unsaid is a else _WORD.findall(_MARK.sub(" ", unsaid.lower()))
    known = [w if w not in qs or w in _BY_WORD else _FROM_QUESTION for w in plain]
    tail = a.rstrip()
    ended = tail[-1:] if tail else ""
    strip = tail.rstrip("\"'”’»)]*_ ")
    final = strip[-1:] if strip else ""
    shape = "." if final in ".!?。！？" and not strip.endswith(("..", "…")) else "…" if strip.endswith(("...", "…", "..")) else "," if final in ",;:–—-(" else "`" if ended == "`" else "w" if final.isalnum() else "o"
    last_line = tail.rsplit("\n", 1)[-1]
    bullet = bool(_BULLET.match(last_line))
    url = bool(_URL.search(last_line))
    mode = "u" if url else "b" if bullet else shape
    begin = 0
    for m in _SENTENCE.finditer(tail):
        if m.end() < len(tail):
            begin = m.end()
    segment = _WORD.findall(tail[begin:].lower())
    final_words = known if begin == 0 else [w if w not in qs or w in _BY_WORD else _FROM_QUESTION for w in _WORD.findall(_MARK.sub(" ", bare_of(tail[begin:]).lower()))]
    end = aw[-4:]
    slots = [_slot("whole", " ".join(core[:6]) if n <= 6 else "long"), _slot("n", str(min(n, 12))), _slot("mode", mode), _slot(f"seg{mode}", f"{segment[0] if segment else ''} {min(len(segment), 14)}")]
    slots += [_slot(f"first{i}", w) for i, w in enumerate(plain[:4])]
    slots += [_slot(f"end{i}{mode}", w) for i, w in enumerate(reversed(end))]
    if len(end) > 1:
        slots.append(_slot(f"end01{mode}", " ".join(end[-2:])))
    if len(end) > 2:
        slots.append(_slot(f"end012{mode}", " ".join(end[-3:])))
    hashed = np.concatenate([np.array(slots), *_grams(known, "s" if n <= 45 else "l", 3), *_grams(final_words, "z", 2)])
    opened = [tail.count(x) - tail.count(y) for x, y in ("()", "[]", "{}", "«»", "“”")]
    fence = tail.count("```")
    ticks = (tail.count("`") - 3 * fence) % 2
    al = shares(plain)
    ascr = script(unsaid)
    qi = int(ql[:-1].argmax())
    ai = int(al[:-1].argmax())
    total = al[:-1].sum() or 1.0
    other = al[ai] / total if ai != qi and al[ai] > 0 and ql[qi] > 0 else 0.0
    sure = ai != qi and al[ai] >= 2 * al[qi] and al[-1] >= 1.5 and ql[-1] >= 1
    strange = ascr.argmax() != qscr.argmax()
    cnt, ends = stat
    dense = np.zeros(_DENSE)
    dense[:42] = [
        1, n == 0, n == 1, n == 2, 3 <= n <= 6, np.log1p(n) / 4, np.log1p(len(a)) / 6, sum(map(len, aw)) / (len(a) or 1),
        len(new) == 0 and n > 3, min(len(new), 10) / 10, len(new) / (n or 1), len(qs & of) / (len(qs) or 1), n >= len(qw) > 0 and qs <= of, sum(c for c in left.values() if c > 0) / (n or 1), min(len([w for w in set(new) if w not in _BY_WORD]), 8) / 8,
        len(set(new)) <= 2 and n >= 0.7 * len(qw) and n > 3,
        al[qi] / total, other, sure, min(al[-1], 10) / 10, min(ql[-1], 10) / 10, other * min(al[-1], 6) / 6,
        float(np.abs(ascr - qscr).sum()) / 2, strange, strange and ascr.max() > 0.5 and len(a) > 8,
        shape == ".", shape == "…", shape == ",", shape == "w", shape == "o", shape == "`", bullet, url,
        max(opened) > 0, fence % 2, ticks, np.log1p(cnt) / 6, (ends + 0.3) / (cnt + 1.0), (shape == "w") * ((ends + 0.3) / (cnt + 1.0)), (shape == "w") * (cnt == 0), (shape == "w") * (not bullet) * (cnt < 3), min(len(segment), 20) / 20,
    ]
    dense[42] = n > 0 and len(plain) <= 30
    dense[43] = bool(lab)
    loose = shape in ("w", "…", ",") and not url
    dense[44] = loose and cnt >= 15 and ends < 0.02 * cnt
    dense[45] = loose and bool(end) and end[-1] in _BY_WORD and ends < 0.1 * max(cnt, 1)
    dense[46] = shape == "…" and not url
    dense[47] = strange and ascr.max() > 0.7 and n > 0 and len(a) > 8
    return hashed, dense


class Linear:
    """One logistic regression a defect over hashed and dense features, fitted by Adagrad."""

    def __init__(self) -> None:
        self.w = np.zeros((len(DEFECTS), _DIMS))
        self.d = np.zeros((len(DEFECTS), _DENSE))
        self.threshold = np.full(len(DEFECTS), 0.5)

    def fit(self, hashed: list[np.ndarray], dense: np.ndarray, Y: np.ndarray, epochs: int = 12, batch: int = 512, rate: float = 0.25, ridge: float = 1e-5, seed: int = 3) -> Linear:
        rng = np.random.default_rng(seed)
        gw, gd = np.full_like(self.w, 1e-3), np.full_like(self.d, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(len(hashed))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                size = np.array([len(hashed[j]) for j in at])
                cols = np.concatenate([hashed[j] for j in at])
                rows = np.repeat(np.arange(len(at)), size)
                scale = 1 / np.sqrt(size)
                for k in range(len(DEFECTS)):
                    z = np.bincount(rows, self.w[k][cols], len(at)) * scale + dense[at] @ self.d[k]
                    e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - Y[at, k]) / len(at)
                    g = np.bincount(cols, (e * scale)[rows], _DIMS) + ridge * self.w[k]
                    gw[k] += g * g
                    self.w[k] -= rate * g / np.sqrt(gw[k])
                    g = e @ dense[at] + ridge * self.d[k]
                    gd[k] += g * g
                    self.d[k] -= rate * g / np.sqrt(gd[k])
        return self

    def predict(self, hashed: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        """Probabilities of the defects for a batch at once."""
        if not hashed:
            return np.empty((0, len(DEFECTS)))
        size = np.array([len(h) for h in hashed])
        cols, rows = np.concatenate(hashed), np.repeat(np.arange(len(hashed)), size)
        out = np.stack([np.bincount(rows, w[cols], len(hashed)) for w in self.w], 1) / np.sqrt(size)[:, None] + dense @ self.d.T
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def calibrate(self, P: np.ndarray, Y: np.ndarray) -> None:
        """The threshold of the best F1 of each defect, in the middle of the ties, where a share ``PRIOR`` of all pairs has it.

        A defect that the held-out part does not let tell (best F1 under a half) is never stated.
        """
        grid = np.linspace(0.02, 0.98, 97)
        for k in range(len(DEFECTS)):
            f1, true = [], Y[:, k] > 0
            some, rest = PRIOR / max(true.mean(), 1e-9), (1 - PRIOR) / max(1 - true.mean(), 1e-9)
            for t in grid:
                hit = P[:, k] >= t
                tp = some * (hit & true).sum()
                f1.append(2 * tp / max(tp + rest * (hit & ~true).sum() + some * true.sum(), 1e-9))
            best = np.nonzero(np.array(f1) >= max(f1) - 1e-9)[0]
            self.threshold[k] = grid[best[len(best) // 2]] if max(f1) >= 0.5 else np.inf

    def decide(self, P: np.ndarray) -> tuple[list[str | None], list[float]]:
        """The defect of each row, or none, and its probability. A swapped answer is one only if it is nothing else."""
        with np.errstate(invalid="ignore"):
            margin = np.where(np.isinf(self.threshold), -1.0, (P - self.threshold) / np.where(P >= self.threshold, 1 - self.threshold, self.threshold))
        own = margin[:, :-1].argmax(1)
        at = np.where((margin[np.arange(len(P)), own] < 0) & (margin[:, -1] >= 0), len(DEFECTS) - 1, own)
        found = margin[np.arange(len(P)), at] >= 0
        return [DEFECTS[k] if y else None for k, y in zip(at, found, strict=True)], np.where(found, P[np.arange(len(P)), at], P.max(1)).tolist() if len(P) else []


def _complete(answer: str) -> bool:
    """Looks like a whole answer: of some length, its last sentence ended, nothing left open."""
    t = answer.rstrip()
    return len(t) >= 60 and t[-1] in ".!?。！？" and not t.endswith(("...", "…")) and t.count("(") == t.count(")") and t.count("`") % 2 == 0 and t.count("«") == t.count("»")


def _truncate(answer: str, rng: np.random.Generator) -> str | None:
    t = answer.rstrip()
    for _ in range(8):
        at = int(rng.integers(max(12, len(t) // 8), len(t) - 2))
        cut = t[:at]
        if rng.random() < 0.5:
            cut = cut[: cut.rfind(" ")] if " " in cut else cut
        cut = cut.rstrip()
        if cut and cut[-1] not in ".!?。！？\n`" and t[len(cut) : len(cut) + 1] not in ".!?。！？\n;":
            style = rng.random()
            return cut + ("…" if style < 0.12 else "..." if style < 0.22 else "," if style < 0.27 and cut[-1].isalnum() else "")
    return None


def _copy(question: str, rng: np.random.Generator) -> str:
    q = question
    forms = [
        q, q + "\n", f"**{q}**", f"> {q}", f'"{q}"', q.lower(), q.upper(), q.rstrip("?¿ ."), f"{q}\n\n{q}", f"{q} {q.lower()}", f"{q}\n\n{q.lower()}",
        "  ".join(q.split()), "  ".join(q.rstrip("?").split()), f"Question: {q}", f"Q: {q}", f"You asked: {q}", f"# {q}", f"{q} {q}", f"Your question: {q}", f"Frage: {q}", f"Ihre Frage: {q}", f"Question : {q}", f"Votre question : {q}", f"Su pregunta: {q}", f"Pregunta: {q}", f"Answer: {q}", f"You want to know: {q}",
    ]
    return forms[int(rng.integers(len(forms)))]


def _preamble(question: str, nouns: list[str], rng: np.random.Generator) -> str:
    """Sentences that say again what was asked, and nothing else."""
    pick = lambda: nouns[int(rng.integers(len(nouns)))]
    forms = [f"You asked: {question}", f"The question is about {pick()} and {pick()}.", f"Thank you for asking about {pick()}.", f"So this concerns {pick()}, in particular {pick()}.", f"You would like to know more about the {pick()}.", f"That is a question on {pick()}, {pick()} and {pick()}."]
    return " ".join(forms[int(rng.integers(len(forms)))] for _ in range(int(rng.integers(1, 12)))) + " "


def _nothing(rng: np.random.Generator) -> str:
    """An answer that says nothing: marks and blanks at random, a label without more, or a word for what is absent."""
    r = rng.random()
    if r < 0.5:
        return "".join(_SIGNS[int(rng.integers(len(_SIGNS)))] for _ in range(int(rng.integers(0, 4))))
    if r < 0.62:
        return ("**{}:**", "{}:", "# {}\n", "<{}></{}>", "{} :\n")[int(rng.integers(5))].replace("{}", _LABELS[int(rng.integers(len(_LABELS)))])
    word = _ABSENT[int(rng.integers(9 if rng.random() < 0.5 else len(_ABSENT)))]
    word = (word, word.upper(), word.capitalize())[int(rng.integers(3))]
    return _WRAPS[int(rng.integers(len(_WRAPS)))].format(word)


def _refuse(question: str, lang: str, rng: np.random.Generator) -> str:
    base, pre, post = _REFUSALS.get(lang, _REFUSALS["en"])
    names = re.findall(r"(?<=\s)[A-Z][a-z]{3,}", question) or ["it"]
    nouns = [w for w in words_of(question) if w not in _BY_WORD and len(w) > 3] or ["that"]
    x = ["that request", "this", f"{nouns[int(rng.integers(len(nouns)))]} questions", "your question"][int(rng.integers(4))]
    p = pre[int(rng.integers(len(pre)))]
    if rng.random() < 0.15:
        p = _preamble(question, nouns, rng) + p
    forms = _GRAMMAR.get(lang, _GRAMMAR["en"])
    if rng.random() < 0.5:
        form = forms[int(rng.integers(len(forms)))]
        s = re.sub(r" +(?=[.,])|(?<= ) +", "", " ".join(part[int(rng.integers(len(part)))] for part in form))
    else:
        s = base[int(rng.integers(len(base)))]
    if p and p[-2:] in (", ", "t ", "— ") and not s.startswith("I"):
        s = s[0].lower() + s[1:]
    out = p + s + post[int(rng.integers(len(post)))]
    out = out.replace("{x}", x).replace("{n}", names[int(rng.integers(len(names)))])
    return out[:-1] + "!" if rng.random() < 0.06 and out.endswith(".") else out.rstrip(".") if rng.random() < 0.06 else out


def _lang(text: str) -> str:
    v = languages(text)[:-1]
    return list(_FUNCTION)[int(v.argmax())] if v.max() > 0 else ""


def _quoting(answer: str, other: str, rng: np.random.Generator) -> str:
    """A usable answer that quotes: a refusing message, or words in another language."""
    said = ["Sorry, I cannot open this", "request declined", "I do not know this option", "access denied", "unable to connect", "no information available"][int(rng.integers(6))]
    extra = [f'The console prints "{said}" and goes on.', f"The label reads «{' '.join(other.split()[:7])}».", f'It returns "{said}".', "You cannot remove an item that is in use; release it first."][int(rng.integers(4))]
    return f"{answer} {extra}" if rng.random() < 0.5 else f"{extra} {answer}"


def _han(question: str, rng: np.random.Generator) -> str:
    """Prose in another script: characters at random, with a name from the question at times."""
    names = re.findall(r"(?<=\s)[A-Z][a-z]{3,}", question)
    out = ""
    for _ in range(int(rng.integers(1, 4))):
        out += "".join(_CHARACTERS[i] for i in rng.integers(len(_CHARACTERS), size=int(rng.integers(8, 30))))
        if names and rng.random() < 0.4:
            out += names[0] + "".join(_CHARACTERS[i] for i in rng.integers(len(_CHARACTERS), size=6))
        out += ",。 "[int(rng.integers(3))]
    return out.strip(", ") + "。"


def synthesise(pairs: list[tuple[str, str]], seed: int = 9) -> list[tuple[str, str, int]]:
    """Training pairs (question, answer, index of the defect or -1) from usable ones."""
    rng = np.random.default_rng(seed)
    by_lang: dict[str, list[str]] = {}
    for q, a in pairs:
        by_lang.setdefault(_lang(a), []).append(a)
    out = []
    for q, a in pairs:
        own = _lang(q)
        out.append((q, a, -1))
        out.append((q, a.rstrip().rstrip(".!?。！？"), -1))  # whole but for its last mark
        foreign = [x for x in by_lang if x and own and x != own and len(by_lang[x]) >= 3]
        other = by_lang[foreign[int(rng.integers(len(foreign)))]] if foreign else None
        strange = other[int(rng.integers(len(other)))] if other else _han(q, rng)
        r = rng.random()
        if r < 0.15:
            out.append((q, f"{q} {a}" if rng.random() < 0.5 else f"{q}\n\n{a}", -1))
        elif r < 0.3:
            parts = re.split(r"(?<=[.!?])\s+", a)
            out.append((q, "\n".join("- " + p.rstrip(".") for p in parts), -1))
            out.append((q, parts[0] + "\n" + "\n".join("- " + p.rstrip(".") for p in parts[1:] or parts), -1))
        elif r < 0.4:
            out.append((q, f"{a} https://docs.example/{words_of(q)[-1] if words_of(q) else 'page'}", -1))
        elif r < 0.5:
            out.append((q, re.split(r"(?<=[.!?])\s+", a)[0], -1))
        elif r < 0.68:
            out.append((q, _quoting(a, strange, rng), -1))
        elif r < 0.74:
            out.append((q, a + "\n```\nrun(value, 3)\n```", -1))
        elif r < 0.86:
            one = [w for w in re.findall(r"`[^`]+`|\b[A-Z][a-z]{3,}\b|\b\d+ \w+", a)] or ["Yes"]
            out.append((q, ["Yes.", "No.", "Ja.", "Nein.", "Oui.", "Non.", "Sí.", one[int(rng.integers(len(one)))], one[0] + "."][int(rng.integers(9))], -1))
            said = [w for w in words_of(a if rng.random() < 0.5 else q) if w.isascii() and len(w) > 3] or ["value", "key"]
            out.append((q, "`" + "_".join(said[int(rng.integers(len(said)))] for _ in range(int(rng.integers(1, 4)))) + "`", -1))  # a name, as code
        for _ in range(2):
            cut = _truncate(a, rng)
            if cut:
                out.append((q, cut, 4))
        out.append((q, _copy(q, rng), 1))
        out.append((q, _refuse(q, own if rng.random() < 0.9 else "en", rng), 2))
        if strange:
            out.append((q, strange, 3))
            if rng.random() < 0.7:
                out.append((q, re.split(r"(?<=[.!?])\s+", strange)[0], 3))
        if rng.random() < 0.35:
            out.append((q, _han(q, rng), 3))
        out.append((q, _nothing(rng), 0))
        same = by_lang.get(_lang(a)) or [a]
        swapped = same[int(rng.integers(len(same)))]
        if swapped != a:
            out.append((q, swapped, 5))
        if rng.random() < 0.1:  # long and usable, also behind a preamble
            out.append((q, _preamble(q, [w for w in words_of(q) if w not in _BY_WORD] or ["it"], rng) + a, -1))
            out.append((q, f"{a} {swapped} {a}" if swapped != a else a, -1))
    return out


def train(rows: list[tuple[str, str]], stats: dict[str, tuple[int, int]], seed: int = 4) -> Linear | None:
    """The classifier, from sampled pairs of which some are defective."""
    usable = [(q, a) for q, a in rows if q and a and _complete(a) and (_lang(a) == _lang(q) or not _lang(a) or not _lang(q)) and len(set(words_of(a)) - set(words_of(q))) >= 5]
    model = None
    for rounds in range(2):
        if len(usable) < 10:
            return model
        made = synthesise(usable if rounds else usable[: max(10, len(usable) // 2)], seed + rounds)
        got = [features(q, a, stats.get(last_word(a), (0, 0))) for q, a, _ in made]
        hashed, dense = [g[0] for g in got], np.array([g[1] for g in got])
        Y = np.zeros((len(made), len(DEFECTS)))
        for i, (_, _, k) in enumerate(made):
            if k >= 0:
                Y[i, k] = 1
        held = np.random.default_rng(seed).random(len(made)) < 0.2
        fit, rest = np.nonzero(~held)[0], np.nonzero(held)[0]
        model = Linear().fit([hashed[i] for i in fit], dense[fit], Y[fit], epochs=5 if rounds == 0 else 9)
        model.calibrate(model.predict([hashed[i] for i in rest], dense[rest]), Y[rest])
        if rounds == 0:
            own = [features(q, a, stats.get(last_word(a), (0, 0))) for q, a in usable]
            P = model.predict([o[0] for o in own], np.array([o[1] for o in own]))
            usable = [u for u, p in zip(usable, P, strict=True) if (p < np.maximum(model.threshold, 0.5))[:-1].all()]
    return model


def _tally(batches):
    for batch in batches:
        n, ends = end_counts([t for t in batch.column(0).to_pylist() if t])
        words = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[w] for w in words], pa.int64()), pa.array([ends[w] for w in words], pa.int64())], ["word", "n", "ends"])


def _last(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([last_word(a or "") for a in batch.column(3).to_pylist()], pa.string())], ["kind", "id", "question", "answer", "last"])


def _classify(model: Linear | None):
    def run(batches):
        for batch in batches:
            question, answer, n, ends = (batch.column(i).to_pylist() for i in range(2, 6))
            if model is None:
                defect = [None if any(c.isalnum() for c in a or "") else "empty" for a in answer]
                score = [float(d is not None) for d in defect]
            else:
                got = [features(q or "", a or "", (c or 0, e or 0)) for q, a, c, e in zip(question, answer, n, ends, strict=True)]
                defect, score = model.decide(model.predict([g[0] for g in got], np.array([g[1] for g in got]).reshape(-1, _DENSE)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(defect, pa.string()), pa.array(score, pa.float64())], ["kind", "id", "defect", "score"])

    return run


def defects(df: DataFrame, kind_col: str, id_col: str, question_col: str, answer_col: str, *, sample: int = SAMPLE) -> DataFrame:
    """``kind``, ``id``, ``defect`` (null for a usable answer) and ``score`` of every pair.

    A null answer or question
    counts as an empty one. Rows with a null id are kept, as are repeated rows. Where the
    sample has too few usable answers to learn from, only answers without a letter or digit are found, as empty; an empty table gives an empty result.
    """
    rows = _base.unit(df, kind=kind_col, id=id_col, question=question_col, answer=answer_col).select(F.col("kind").cast("string").alias("kind"), F.col("id").cast("bigint").alias("id"), F.col("question").cast("string").alias("question"), F.col("answer").cast("string").alias("answer"))
    marked = _base.stage(rows.mapInArrow(_last, "kind string, id bigint, question string, answer string, last string"), "pairs")
    words = spread(marked.select("answer"), 1 << 16).mapInArrow(_tally, "word string, n bigint, ends bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    words = _base.stage(words, "pairs-words")
    held = marked.where("length(answer) >= 60").orderBy(F.xxhash64("answer", "question"), "kind", "id").limit(sample).select("question", "answer").toArrow().to_pylist()
    asked = [(r["question"] or "", r["answer"]) for r in held]
    # statistics of the words that the sample's texts can end in after a cut: at most the sample's words
    own = {w for _, a in asked for w in words_of(a)}
    stats = {r["word"]: (r["n"], r["ends"]) for r in words.join(F.broadcast(df.sparkSession.createDataFrame([(w,) for w in sorted(own)] or [("",)], "word string")), "word").toArrow().to_pylist()}
    model = train(asked, stats)
    known = _base.spread_join(spread(marked, 1 << 16), words.withColumnRenamed("word", "last"), ["last"], ["kind", "id", "answer"], "left").select("kind", "id", "question", "answer", "n", "ends")
    return known.mapInArrow(_classify(model), "kind string, id bigint, defect string, score double")
