"""The source-language gate: script counts first, a statistical detector where scripts don't tell."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrow import mapped, spread

#: Scripts that one language of the sixteen uses (targets), their letters, and letters of theirs that the target never writes.
SCRIPT_OF = {"ko": "hangul", "ja": "kana", "ru": "cyrillic", "ar": "arabic", "hi": "devanagari"}
LETTERS = {
    "hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
    "kana": r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}",
    "cyrillic": r"\x{0400}-\x{052F}",
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}",
    "devanagari": r"\x{0900}-\x{097F}",
}
FOREIGN = {
    "cyrillic": r"[\x{0400}-\x{052F}&&[^\x{0410}-\x{044F}\x{0401}\x{0451}]]",
    "arabic": r"[\x{0620}\x{063B}-\x{063F}\x{0672}-\x{06D3}\x{06D5}\x{06EE}-\x{06EF}\x{06FA}-\x{06FC}\x{06FF}\x{0750}-\x{077F}]",
    "devanagari": r"[\x{0904}\x{090C}\x{090E}\x{0912}\x{0929}\x{0931}\x{0933}\x{0934}\x{0960}\x{0961}\x{0972}-\x{097F}]",
}
LANGUAGES = {
    "en": ("eng", "English"), "ko": ("kor", "Korean"), "ja": ("jpn", "Japanese"), "zh": ("cmn", "Chinese"), "fr": ("fra", "French"), "de": ("deu", "German"), "es": ("spa", "Spanish"), "it": ("ita", "Italian"),
    "pt": ("por", "Portuguese"), "nl": ("nld", "Dutch"), "ru": ("rus", "Russian"), "ar": ("ara", "Arabic"), "hi": ("hin", "Hindi"), "tr": ("tur", "Turkish"), "vi": ("vie", "Vietnamese"), "sv": ("swe", "Swedish"),
}
RIGHT_TO_LEFT = ("ar", "he", "fa", "ur", "yi", "ps", "sd", "ug", "dv", "arabic", "hebrew", "persian", "urdu", "yiddish")
#: Common short words, and letters, of the languages written in Latin script: the detector's evidence.
WORDS = {
    "en": "the and of to in is that it for with was are as on by this or an be from",
    "de": "der die das und nicht mit ein eine den für auf ist im zu von sich dem als auch aus",
    "fr": "le la les des et un une est dans que pour qui sur avec au du en ne pas de",
    "es": "el los las y del que en por con una para es se al su como lo más la de",
    "it": "il gli che di non per una sono della nel anche più ma con è questo la",
    "pt": "os as não uma para com dos das ao pelo mais você é que de em",
    "nl": "het een niet van zijn voor met ook maar naar wordt dat deze bij de en in",
    "sv": "och att det som inte på är för med ett till av en i",
    "tr": "bir ve bu için ile çok daha olarak gibi",
    "vi": "và của là có được không những trong một",
}
LETTERS_OF = {"de": "äöß", "fr": "çêèœàù", "es": "ñáíúó¿¡", "pt": "ãõ", "sv": "å", "tr": "ığş", "vi": "ăđơư"}
_OF_WORD: dict[str, list[str]] = {}
for _k, _v in WORDS.items():
    for _w in _v.split():
        _OF_WORD.setdefault(_w, []).append(_k)
_SCRIPTS = [(k, re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{m[1]}", LETTERS[v]) + "]")) for k, v in SCRIPT_OF.items()] + [("zh", re.compile("[\u4e00-\u9fff\u3400-\u4dbf]"))]
_WORD = re.compile(r"[^\W\d_]+")
_MARKED = {k: re.compile(f"[{v}]") for k, v in LETTERS_OF.items()}


def detect_text(text: str) -> str | None:
    """The likeliest language by script, then by common words and letters; None without letters or evidence."""
    words = _WORD.findall(text.lower())
    letters = sum(map(len, words))
    if not letters:
        return None
    for name, found in _SCRIPTS:
        if len(found.findall(text)) * 5 >= letters:
            return name
    seen: dict[str, float] = {}
    for w in words:
        for name in _OF_WORD.get(w, ()):
            seen[name] = seen.get(name, 0) + 1 / len(_OF_WORD[w])
    for name, found in _MARKED.items():
        if n := len(found.findall(text)):
            seen[name] = seen.get(name, 0) + n / 4
    return max(seen, key=lambda k: (seen[k], k)) if seen else None


def detected(documents: DataFrame) -> DataFrame:
    """Adds detected to documents(doc_id, text). A substitute for a trained detector, measured on labelled documents."""
    kind = dict(documents.dtypes)["doc_id"]
    return mapped(spread(documents.select("doc_id", "text")), lambda r: r | {"detected": [detect_text(t or "") for t in r["text"]]}, f"doc_id {kind}, text string, detected string")


def reading(text: Column, script: str) -> Column:
    """foreign, dominant (a fifth of letters or more), minority, absent or no_letters."""
    letters = F.regexp_count(text, F.lit(r"\p{IsAlphabetic}"))
    own = F.regexp_count(text, F.lit(rf"[{LETTERS[script]}&&\p{{IsAlphabetic}}]"))
    strange = text.rlike(FOREIGN[script].replace("]", r"&&\p{IsAlphabetic}]", 1) if script != "cyrillic" else rf"[{FOREIGN[script]}&&\p{{IsAlphabetic}}]") if script in FOREIGN else F.lit(False)
    return F.when(letters == 0, "no_letters").when(strange, "foreign").when(own == 0, "absent").when(own * 5 >= letters, "dominant").otherwise("minority")


def verdict(text: Column, target: str, detected: Column) -> Column:
    """already_target or translate, with the reason after a colon."""
    other = F.when(detected == target, "already_target:backend").when(detected.isNotNull(), "translate:backend_differs").otherwise("translate:undecided")
    if target not in SCRIPT_OF:
        return F.when(~text.rlike(r"\p{IsAlphabetic}"), "translate:undecided").otherwise(other)
    r = reading(text, SCRIPT_OF[target])
    return F.when(r == "no_letters", "translate:undecided").when(r == "foreign", "translate:foreign_orthography").when(r == "dominant", "already_target:exclusive_script").when(r == "absent", "translate:exclusive_script_absent").otherwise(other)


def gate(documents: DataFrame, target: str) -> DataFrame:
    return detected(documents).select("doc_id", verdict(F.coalesce("text", F.lit("")), target, F.col("detected")).alias("verdict"))


def direction(label: Column) -> Column:
    first = F.lower(F.regexp_extract(label, r"^\s*([A-Za-z]+)", 1))
    return F.when(first.isin(*RIGHT_TO_LEFT), "rtl").otherwise("ltr")
