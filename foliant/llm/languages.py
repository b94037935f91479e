"""The eight languages: codes, names and frequent function words."""

from __future__ import annotations

import re

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "ru", "ja")

# The ways in which a label may spell each language.
SPELLINGS = {
    "en": "en eng english anglais englisch inglés inglês inglese английский 英語",
    "de": "de deu ger german deutsch allemand alemán alemão tedesco немецкий ドイツ語",
    "fr": "fr fra fre french français französisch francés francês francese французский フランス語",
    "es": "es spa spanish español castellano espagnol spanisch espanhol spagnolo испанский スペイン語",
    "pt": "pt por portuguese português portugués portugais portugiesisch portoghese португальский ポルトガル語",
    "it": "it ita italian italiano italien italienisch итальянский イタリア語",
    "ru": "ru rus russian русский russe russisch ruso russo ロシア語",
    "ja": "ja jpn japanese 日本語 japonais japanisch japonés japonês giapponese японский",
}
CODE_OF = {s: code for code, names in SPELLINGS.items() for s in names.split()}

# Frequent function words, of which each language has many that the others lack.
FUNCTION_WORDS = {
    "en": "the a an of and or is are was were be been that this these those which who what where when why how with without for from by about into at on in to as it its they their you we not no if then than because while although since under after before each all some can must does do has have had there only",
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war wird werden wurde nicht kein keine von zu zum zur mit ohne für auf aus bei nach vor im in an am als auch dass weil denn wenn was wer wie wo warum wann sagt über unter durch gemäß zwei alle jede dieser diesem es sich er sie wir ich ihr innerhalb außerhalb während deshalb noch auch seit vom beim ins",
    "fr": "le la les un une des du de et ou est sont était être que qui quoi dont où dans par pour sur avec sans sous ce cette ces cet il elle ils nous vous je ne pas plus au aux en se sa son ses leur selon car comme après avant pendant quel quelle pourquoi dit lit chaque deux toutes y hors lors entre chez vers depuis cela été cette notre",
    "es": "el la los las un una unos unas del de y o es son era fue ser que quien qué dónde cuándo por para con sin sobre en al se su sus lo le no porque como según después antes durante cada dos todas todos este esta ha había hay más ya ni entre desde hasta dentro fuera bajo tras hacia sino",
    "pt": "o a os as um uma uns umas do da dos das de e ou é são era foi ser que quem qual onde quando por para com sem sobre em no na nos nas ao aos à às se seu sua não porque como segundo depois antes durante cada duas todas todos este esta há mais já nem entre até pelo pela num numa diz lê fora dentro após sob perante desde isso ele ela",
    "it": "il lo la i gli le un uno una del dello della dei degli delle di e o è sono era fu essere che chi cosa dove quando perché per con senza su sul sulla in nel nella nei nelle al allo alla ai agli alle da dal dalla si suo sua non come secondo dopo prima durante ogni due tutte tutti questo questa più già né tra fra dice legge l entro fuori presso verso dopo ancora anche quindi",
}
_WORDS_OF = {code: frozenset(words.split()) for code, words in FUNCTION_WORDS.items()}
_OTHER_SCRIPT = re.compile("[぀-ヿ㐀-鿿Ѐ-ӿ]")
_KANA, _HAN, _CYRILLIC = re.compile("[぀-ヿ]"), re.compile("[㐀-鿿]"), re.compile("[Ѐ-ӿ]")
_LATIN_WORD, _NO_LETTER = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]+")
#: The languages that have each word, by their place.
_HAVE = {w: [i for i, known in enumerate(_WORDS_OF.values()) if w in known] for w in frozenset().union(*_WORDS_OF.values())}
_NAMES = list(_WORDS_OF)


def code_of(label: str | None) -> str | None:
    """The two-letter code that a label stands for, whatever its case, region or spelling; None for none of the eight."""
    bare = (label or "").strip().lower()
    return CODE_OF.get(bare) or CODE_OF.get(re.split(r"[-_ (]", bare)[0]) if bare else None


def short_text_language(text: str) -> str | None:
    """The language of a question or answer, by its script, else by its function words; None if they don't tell.

    A word counts for each language that has it, so that words shared by several decide nothing.
    """
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        kana, han, cyrillic = len(_KANA.findall(text)), len(_HAN.findall(text)), len(_CYRILLIC.findall(text))
        total = len(_NO_LETTER.sub("", text))
        if kana and (kana + han) * 2 >= total:
            return "ja"
        if cyrillic * 2 >= total:
            return "ru"
        text = _OTHER_SCRIPT.sub(" ", text)
    words, counts = _LATIN_WORD.findall(text.lower()), [0] * len(_NAMES)
    for w in words:
        for i in _HAVE.get(w, ()):
            counts[i] += 1
    scores = sorted(zip(counts, _NAMES), reverse=True)
    (best, code), (second, _) = scores[0], scores[1]
    return code if best > second and (best >= 2 or (second == 0 and len(words) >= 5)) else None
