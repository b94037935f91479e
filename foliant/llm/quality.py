"""Broken prompt and response pairs: ordered rules that name the defects of an answer."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.languages import CODE_OF, short_text_language

#: An answer that is the beginning of the question, of at least this share of its letters, copies it too.
COPIED_SHARE = 0.6
DEFECTS = ("empty", "copied_question", "refusal", "truncated", "other_language")

_INVISIBLE = re.compile("[­͏ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⠀ㅤ︀-️﻿ﾠ]")
_CITED = re.compile(r"(?<!\s)\s*+cited source indices\s*+:[^\n]*", re.I)
# What stands in an answer's place when there is none.
_PLACEHOLDER = {"n a", "na", "nan", "null", "nil", "none", "tbd", "todo", "undefined", "placeholder", "no answer", "answer", "empty", "no content", "no response", "answer here", "your answer here"}
_STOPS = ".!?。！？…"
_CLOSERS = "\"'”’»)]）」』*_`"
#: Something appended after a complete sentence: a reference in brackets or quotes.
_APPENDED = re.compile(r"(?<=[" + _STOPS + r"])\s*(?:\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）|“[^“”]*”|\"[^\"]*\"|«[^«»]*»|「[^「」]*」)\s*$")
_SENTENCE_END = re.compile(r"(?<=[.!?。！？…])[\"'”’»)\]]*(?:\s+|(?<=[。！？])|$)")
_BULLET = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s*")
_PAIRS = (("(", ")"), ("[", "]"), ("{", "}"), ("“", "”"), ("«", "»"), ("（", "）"), ("「", "」"), ("『", "』"))

# Courtesies that tell nothing, around a refusal.
_COURTESY = re.compile(
    r"^(?:thank(?:s| you)\b.*|hello\b.*|hi\b.*|you may want to\b.*|you might want to\b.*|please (?:try|ask|contact|rephrase|upload|feel free|consult|let me know)\b.*|ask me about\b.*|"
    r"try another question\b.*|let me know\b.*|is there anything else\b.*|i hope (?:this|that)\b.*|merci\b.*|vielen dank\b.*|danke\b.*|gracias\b.*|obrigad[oa]\b.*|grazie\b.*|спасибо\b.*|ありがとうござ.*)$",
    re.I | re.S,
)
# How an answer declines or says that nothing was found, as whole sentences of each language.
_REFUSALS = [
    # English
    r"(?:i'?m|i am|we are) (?:very |really )?(?:sorry|afraid)\b.*", r"sorry\b.*", r"(?:my|our|please accept my) apologies\b.*", r"i apologi[sz]e\b.*", r"(?:i'?m|i am|we are) (?:not able|unable)\b.*", r"as an? (?:ai|assistant|language model|ai assistant|ai language model)\b.*",
    r"(?:i|we) (?:can'?t|cannot|can not|could not|couldn'?t|won'?t|will not|don'?t|do not|did not|didn'?t|must decline|have to decline|decline|would rather not|prefer not|have no|am not able|was unable|found (?:no|nothing))\b.*", r"i'?d rather not\b.*",
    r"(?:that|this|it) is (?:something|a topic|a subject|a matter) (?:that )?(?:i|we) (?:won'?t|will not|can'?t|cannot)\b.*",
    r"unfortunately,? .*\b(?:no|not|nothing|cannot|can'?t|unable|couldn'?t|doesn'?t|don'?t)\b.*",
    r"(?:the|your) (?:provided |given |retrieved |available |uploaded |supplied )*(?:context|passages?|material|documents?|pages?|files?|text|sources?|information)(?: \w+){0,3} (?:is|are) (?:insufficient|not sufficient|not enough|silent|too)\b.*",
    r"(?:the|your) (?:provided |given |retrieved |available |uploaded |supplied )*(?:context|passages?|material|documents?|pages?|files?|text|sources?)(?: \w+){0,2} (?:do|does|did)(?: not|n'?t) (?:contain|mention|provide|include|address|cover|discuss|say|hold|state|answer|treat|deal)\b.*",
    r"(?:the|your) (?:provided |given |retrieved |uploaded )*(?:context|passages?|material|documents?|pages?|files?|text) (?:holds?|contains?|says?|gives?|offers?) (?:nothing|no (?:information|answer|mention))\b.*",
    r"(?:this|that|the|your) (?:question|request|topic|subject) (?:lies|falls|is) (?:outside|beyond|not (?:covered|answered|addressed|treated))\b.*",
    r"no (?:relevant|matching|such|suitable) (?:passages?|information|text|sections?|content|material|sources?)\b.*", r"no (?:information|answer) (?:about|on|can be|could be|is available|was found|to)\b.*",
    r"there (?:is|was|are) (?:nothing|no (?:information|mention|answer|passage|text|relevant))\b.*", r"nothing (?:in|about|on|was found|could be found|relevant)\b.*", r"not (?:found|mentioned|answerable|available|stated) in\b.*",
    # German
    r"leider\b.*\b(?:nicht|nichts|keine?[nrs]?)\b.*", r"(?:ich bitte um|bitte haben sie) verständnis\b.*", r"(?:es )?tut mir leid\b.*", r"entschuldigung\b.*", r"(?:dazu|darüber|hierzu) (?:steht|findet sich|gibt es|enthält|enthalten)\b.*\b(?:nichts|keine?[nrs]?)\b.*",
    r"(?:ich|wir) (?:kann|können|darf|dürfen|möchte|habe|konnte)\b.*\b(?:nicht|nichts|keine?[nrs]?)\b.*", r"(?:die|der|das|in den|in dem|im) (?:\w+ )?(?:unterlagen?|dokumente?|seiten|dateien|kontext|texte?)\b.*\b(?:nichts|keine (?:antwort|angaben?|informationen?|hinweise?))\b.*",
    # French
    r"(?:je|nous) (?:regrette|suis désolée?|ne peux|ne suis|ne dispose|n'ai|ne trouve|ne saurais|préfère ne|dois refuser|refuse)\b.*", r"désolée?\b.*", r"(?:toutes )?mes excuses\b.*", r"malheureusement\b.*\b(?:ne|n'|pas|rien|aucune?)\b.*", r"il m'est impossible\b.*", r"il n'y a (?:rien|aucune?)\b.*",
    r"les? (?:pages|documents?|fichiers?|textes?|éléments|sources?|contexte)\b.*(?:\bne (?:disent|dit|contiennent|contient|mentionnent|mentionne|traitent|traite)\b|\brien\b).*",
    # Spanish
    r"lo (?:siento|lamento)\b.*", r"lamentablemente\b.*\bno\b.*", r"no (?:me es posible|puedo|podemos|dispongo|tengo|he encontrado|encuentro|se ha encontrado|hay (?:nada|información|ninguna?))\b.*", r"l[oa]s? (?:archivos?|documentos?|páginas?|textos?|contexto)\b.*\bno (?:trata[n]?|menciona[n]?|contiene[n]?|dice[n]?|habla[n]?)\b.*",
    # Portuguese
    r"(?:lamento|sinto muito|desculpe|infelizmente)\b.*", r"não (?:posso|podemos|consigo|é possível|me é possível|tenho|encontrei|foi possível|há (?:nada|informaç\w+|nenhuma?))\b.*", r"(?:as|os|o|a) (?:páginas?|arquivos?|ficheiros?|documentos?|textos?|contexto)\b.*\bnão (?:tratam?|mencionam?|contêm|contém|dizem|diz|falam?)\b.*",
    # Italian
    r"mi (?:dispiace|scuso|rincresce|è impossibile)\b.*", r"(?:purtroppo|spiacente)\b.*", r"non (?:posso|possiamo|sono in grado|mi è possibile|è possibile|ho trovato|dispongo|c'è (?:nulla|niente|alcun\w*))\b.*", r"(?:le|i|il|la|gli) (?:pagine|file|documenti|documento|testo|testi|contesto)\b.*\bnon (?:trattano|tratta|contengono|contiene|menzionano|menziona|dicono|dice|parlano|parla)\b.*",
    # Russian
    r"к сожалению\b.*", r"(?:извините|простите|мне жаль|приношу извинения)\b.*", r"(?:я|мы) не (?:могу|можем|наш[её]л|нашла|располагаю|имею)\b.*", r"(?:в|на) .*\b(?:документах?|документе|страницах|файлах|материалах|тексте|источниках)\b.*\b(?:ничего|нет|не (?:сказано|упоминается|содержится))\b.*",
    # Japanese
    r"申し訳.*", r"(?:恐れ入りますが|すみませんが|残念ながら|あいにく).*", r".*(?:お答え|回答|返答|お応え)(?:することは?|は)?でき(?:ません|ない|かねます).*", r".*(?:資料|文書|ファイル|ページ|提供された).*(?:記載|情報|記述|言及)(?:が|は)?(?:ありません|ない|見つかりません|されていません).*",
]
_REFUSAL = re.compile("^(?:" + "|".join(_REFUSALS) + ")$", re.I | re.S)
_ASKED = re.compile(r"\b(?:in|auf|en|em|на|по)[ -]+([^\W\d_]+)|([぀-ヿ㐀-鿿]{2,4}語)")
_LABELS = re.compile(r"(?:question|frage|pregunta|pergunta|domanda|вопрос|質問)\s*[:：]", re.I)
_NO_LETTER = re.compile(r"[\W_]+")
_LABEL = re.compile(r"^\s*(?:question|q|frage|pregunta|pergunta|domanda|вопрос|質問)\s*[:：]\s*", re.I)


def _visible(text: str | None) -> str:
    return _INVISIBLE.sub("", text or "").replace("’", "'").strip()


def _letters(text: str) -> str:
    return _NO_LETTER.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold())


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE_END.split(text) if s.strip()]


def _is_empty(text: str) -> bool:
    words = re.findall(r"[^\W_]+", text.casefold())
    return not words or " ".join(words) in _PLACEHOLDER


def _is_copy(question: str, text: str) -> bool:
    # a copy begins as the question does: most answers are told apart by their first letters
    start, begun = _letters(question[:80])[:8], _letters(_LABELS.sub(" ", text[:80]))[:8]
    if not start.startswith(begun) and not begun.startswith(start):
        return False
    asked, said = _letters(question), _letters(_LABEL.sub("", text))
    if not asked or not said:
        return False
    if said.replace(asked, "") == "" or (len(said) >= COPIED_SHARE * len(asked) and asked.startswith(said)):
        return True
    return len(said) >= len(asked) and _letters(_LABELS.sub(" ", text)).replace(asked, "") == ""


def _is_refusal(text: str) -> bool:
    telling = 0
    for line in text.split("\n"):
        for sentence in _sentences(line):
            bare = sentence.strip(_CLOSERS + " ")
            if _REFUSAL.match(bare):
                telling += not _COURTESY.match(bare)
            elif not _COURTESY.match(bare):
                return False
    return telling > 0


def _unclosed(text: str) -> bool:
    if text.count("```") % 2 or text.count("**") % 2 or text.count('"') % 2:
        return True
    return any(text.count(a) > text.count(b) for a, b in _PAIRS)


def _is_truncated(text: str) -> bool:
    text = text.rstrip()
    while (shorter := _APPENDED.sub("", text).rstrip()) != text:
        text = shorter
    if _unclosed(text):
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return False
    tail = lines[-1]
    bare = _BULLET.sub("", tail)
    whole = [bool(re.search("[" + _STOPS + "]$", x.rstrip().rstrip(_CLOSERS))) for x in lines]
    numbered = re.match(r"^\s*(\d+)[.)]\s*$", tail)
    if numbered and len(lines) > 1:
        return True  # a list broken off at its next number
    if whole[-1]:
        last = _sentences(bare)
        # broken off within a number: "About 31." after whole sentences
        return len(last) > 1 and bool(re.fullmatch(r"(?:\w+\s+)?\d+\.", last[-1])) and not re.fullmatch(r"\d+\.", last[-1])
    if bare.rstrip()[-1:] in ",;:、，；：(（-–—":
        return True
    if any(whole[:-1]):
        return True  # what comes before ends in stops, the end does not
    inner = [s for s in _sentences(bare) if s]
    if len(inner) > 1:
        return True  # whole sentences, then a part of one
    if len(lines) > 1 or _BULLET.match(tail):
        return False  # a list of phrases
    words = re.findall(r"[^\W_]+", bare)
    cjk = len(re.findall("[぀-ヿ㐀-鿿]", bare))
    return len(words) > 12 or cjk > 25


def _language_asked_for(question: str) -> set[str]:
    return {CODE_OF[w.lower()] for m in _ASKED.finditer(question) for w in m.groups() if w and w.lower() in CODE_OF and len(w) > 3 or w and w.endswith("語") and w in CODE_OF}


def defects_of(question: str | None, answer: str | None) -> list[str]:
    """All defects that an answer triggers, in the order of the rules.

    Null, blank and wordless answers are empty; a null or blank question copies nothing and has no language.
    """
    asked, said = _visible(question), _CITED.sub("", _visible(answer)).strip()
    rules = (("empty", lambda: _is_empty(said)), ("copied_question", lambda: _is_copy(asked, said)), ("refusal", lambda: _is_refusal(said)), ("truncated", lambda: _is_truncated(said)))
    found = [name for name, triggered in rules if triggered()]
    ours, theirs = short_text_language(said), short_text_language(re.sub(r"^(?:please )?(?:answer|reply|respond) in \w+\s*[:.,]\s*", "", asked, flags=re.I))
    if ours and theirs and ours != theirs and ours not in _language_asked_for(asked):
        found.append("other_language")
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _defects(question: pd.Series, answer: pd.Series) -> pd.Series:
    known: dict[tuple, list[str]] = {}
    out = []
    for pair in zip(question, answer):
        if pair not in known:
            known[pair] = defects_of(*pair)
        out.append(known[pair])
    return pd.Series(out)


def with_defects(pairs: DataFrame) -> DataFrame:
    """The pairs with the defects of each, an empty array for a sound one. Confidence and its label do not count: they tell nothing."""
    return pairs.withColumn("defects", _defects("question", "answer"))


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, defect): the first defect of each broken pair, in the order of the rules; repeated rows count once, and a null pair_id names no pair."""
    kept = pairs.select("pair_id", "question", "answer").where("pair_id is not null").select("pair_id", _defects("question", "answer").alias("defects"))
    return kept.where(F.size("defects") > 0).select("pair_id", F.get("defects", F.lit(0)).alias("defect")).distinct()


def defect_report(pairs: DataFrame, mode: Column | str = "mode") -> DataFrame:
    """(mode, defect, pairs): pairs per mode and defect, each under every defect that it has."""
    kept = pairs.select("pair_id", F.col(mode).alias("mode") if isinstance(mode, str) else mode.alias("mode"), "question", "answer").where("pair_id is not null")
    return kept.select("pair_id", "mode", F.explode(_defects("question", "answer")).alias("defect")).distinct().groupBy("mode", "defect").agg(F.count("*").alias("pairs"))
