"""Problem 2: defective question and answer pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm import langid
from papyrine.plans.layout import cut, spread

#: A word is never the last of a sentence if it ends less than this share of its occurrences, seen at least so often.
NEVER_ENDS, SEEN = 0.002, 200
#: Share of all words that such a word has at least.
LEAST_SHARE = 1e-5
#: Share of a question's words that an answer must repeat in one run to be a copy, and words allowed around it.
COPY_SHARE, LEAD_IN = 0.6, 7
#: Bytes that a copied answer may need, as a share of its length, once its question is the dictionary.
COPY_BYTES = 0.55

# Placeholders that say nothing.
PLACEHOLDERS = {"n/a", "na", "n.a.", "n. a.", "nil", "null", "none", "nan", "undefined", "tbd", "todo", "empty", "(empty)", "no answer", "k.a.", "k. a.", "s/o", "n/d", "nd", "s/d", "n.v.t.", "n.d.", "keine angabe", "lorem ipsum", "placeholder"}

# Phrases by which a speaker declines or says that it cannot answer (apostrophes are straight here).
REFUSALS = {
    "en": r"\b(?:i|we)(?: am|'m| are|'re)? (?:sorry|afraid)\b|\b(?:i|we)(?: really| unfortunately)? (?:cannot|can not|can't|could not|am unable|'m unable|are unable|am not able|won't|will not|must decline|have to decline|decline|refuse|would rather not|prefer not|do not know|don't know|am not allowed|may not)\b|\bas an (?:ai|assistant)\b|\b(?:do|does) not (?:let|allow|permit) me\b|\bdon't let me\b|\b(?:isn't|is not|not) enough information\b|\b(?:insufficient|too little) information\b|\bunable to (?:answer|help|comment)\b",
    "de": r"\b(?:kann|darf|möchte|will|muss|könnte) ich\b.*\b(?:nicht|keine?n?|ablehnen)\b|\bich (?:kann|darf|möchte|muss|will)\b.*\b(?:nicht|keine?n?|ablehnen)\b|\bals (?:ki|assistent\w*)\b|\berlauben mir k?ein\w*|\breichen die (?:angaben|informationen|unterlagen) nicht\b|\b(?:nicht genügend|nicht genug|keine ausreichenden|zu wenig) (?:informationen|angaben)\b|\bweiß ich (?:leider )?nicht\b",
    "nl": r"\b(?:kan|mag|wil|moet|doe) ik\b.*\b(?:niet|geen|weigeren|afwijzen|liever)\b|\bik (?:kan|mag|wil|moet|doe)\b.*\b(?:niet|geen|weigeren|afwijzen|liever)\b|\bals (?:ai|assistent)\b|\b(?:onvoldoende|te weinig) (?:informatie|gegevens)\b|\bniet genoeg (?:informatie|gegevens)\b|\bweet ik niet\b",
    "fr": r"\bje (?:suis désolée?|regrette|ne (?:peux|puis|sais|veux|suis)|n'ai pas|dois (?:malheureusement )?(?:refuser|décliner)|préfère ne pas|refuse)\b|\bil m'est impossible\b|\bne me permet\w* pas\b|\ben tant qu'(?:ia|assistante?)\b|\b(?:pas assez|trop peu) d'(?:éléments|informations?)\b|^désolée?\b",
    "es": r"\b(?:no puedo|no me es posible|no me permiten?|debo rechazar|prefiero no|no dispongo|no tengo (?:información|datos|elementos)|no sabría|no sé)\b|\blo siento\b|\bcomo (?:ia|asistente)\b|\bno hay (?:suficiente información|información suficiente)\b|\bmuy poca información\b",
    "it": r"\b(?:non posso|non sono in grado|non mi permett\w+|devo (?:purtroppo )?(?:rifiutare|declinare)|preferisco non|non ho (?:elementi|informazioni|dati)|non saprei|non so)\b|\bmi dispiace\b|\bin quanto (?:ia|assistente)\b|\binformazioni insufficienti\b|\btroppo poche informazioni\b",
    "pt": r"\b(?:não posso|não consigo|não me permit\w+|não me é possível|devo recusar|tenho de recusar|prefiro não|não disponho|não tenho (?:informaç\w+|dados|elementos)|não sei)\b|\b(?:lamento|desculpe|peço desculpa)\b|\bcomo (?:ia|assistente)\b|\bnão há (?:informação suficiente|informações suficientes)\b|\bmuito pouca informação\b",
}

# Greetings before and closings after what is said.
GREETINGS = r"(?:dear|hello|hi|good (?:morning|day|afternoon)|guten (?:tag|morgen)|hallo|liebe[rs]?|sehr geehrte\w*|beste|geachte|goedendag|goedemorgen|bonjour|chère?|madame|monsieur|buenos días|buenas tardes|hola|estimad[oa]s?|buongiorno|salve|gentile|ciao|bom dia|boa tarde|olá|car[oa]|exm[oa]s?\.?)"
CLOSINGS = r"(?:(?:with )?(?:kind|best|warm) regards|best wishes|yours (?:sincerely|faithfully)|sincerely|(?:mit )?freundlichen? grüßen?|(?:beste|viele|liebe) grüße|(?:met )?(?:vriendelijke|hartelijke) groet(?:en)?|(?:bien )?cordialement|(?:meilleures )?salutations(?: distinguées)?|(?:un )?(?:cordial saludo|saludo cordial)|saludos(?: cordiales)?|atentamente|(?:un )?cordiali? salut[oi]|cordiali saluti|distinti saluti|(?:com os )?melhores cumprimentos|cumprimentos|atenciosamente|saudações(?: cordiais)?)"

# Names of the languages as the questions may use them.
LANGUAGE_NAMES = {
    "de": "german deutsch deutsche deutscher allemand alemán alemão tedesco duits duitse",
    "en": "english englisch englischer anglais inglés inglês inglese engels engelse",
    "nl": "dutch niederländisch niederländischer néerlandais neerlandés neerlandês holandés holandês olandese nederlands nederlandse",
    "es": "spanish spanisch spanischer espagnol español espanhol spagnolo spaans spaanse castellano",
    "fr": "french französisch französischer français francés francês francese frans franse",
    "it": "italian italienisch italienischer italien italiano italiaans italiaanse",
    "pt": "portuguese portugiesisch portugiesischer portugais portugués português portoghese portugees portugese",
}

_WORD = re.compile(r"[^\W_]+")
_FENCE = re.compile(r"```[a-zA-Z]*")
_TAG = re.compile(r"<[^<>]*>")
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS.values()))
_GREETING = re.compile(rf"^\W*{GREETINGS}\b[^,:!.\n]{{0,40}}[,:!]\s*", re.I)
_CLOSING = re.compile(rf"\n\s*{CLOSINGS}\W*(?:\n[^\n]{{0,40}})?\s*$", re.I)
_MARKS = r"[\s✓✔☑★✅❗❓*_~`\U0001F300-\U0001FAFF☀-➿️]"
_END = re.compile(r"[.!?。](?:[\"'”’»«“)\]}*_`~\s]|\[\d+\])*$")
_NOTE = re.compile(r"(?:\[[^\[\]\n]{1,20}\]|\((?:[^()\n]{1,30})\)|✓|✔|✅|[\U0001F300-\U0001FAFF☀-➿]️?|:\)|:\(|;\))\s*$")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])(?:\s+(.*))?$")


def _plain(answer: str) -> str:
    """The answer without zero-width characters, tags, fences and outer markup."""
    t = re.sub(r"[​-‏⁠﻿]", "", answer)
    return _FENCE.sub("", _TAG.sub(" ", t)).strip()


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    t = _plain(answer).lower().strip(" \t\r\n\xa0\"'“”*_`.:;!?-–—")
    return t in PLACEHOLDERS or not any(c.isalnum() for c in t) or t.strip("()[]{}<>") in PLACEHOLDERS


def _core(answer: str) -> str:
    t = _plain(answer).strip(" \t\r\n*_\"“”")
    t = _CLOSING.sub("", t)
    return _GREETING.sub("", t).strip()


def is_refusal(answer: str) -> bool:
    """Every sentence that says something declines; one longer sentence beside it would be an answer."""
    t = _core(answer).lower().replace("’", "'")
    said = False
    for s in re.split(r"(?<=[.!?])\s+|\n+", t):
        n = len(_WORD.findall(s))
        if n and _REFUSAL.search(s):
            said = True
        elif n > 4:
            return False
    return said


def _grams(ids: np.ndarray, n: int, power: np.ndarray) -> np.ndarray:
    """One hash for each run of ``n`` ids, from prefix sums; equal runs have equal hashes."""
    prefix = np.r_[np.uint64(0), np.cumsum(ids * power[: len(ids)], dtype=np.uint64)]
    return (prefix[n:] - prefix[:-n]) * power[len(power) - 1 - np.arange(len(ids) - n + 1)]


def _block(a: list[str], q: list[str]) -> tuple[int, int]:
    """(length, start in a) of the longest common run of words, the first of several.

    A run of n words holds one of n - 1, so the length is found by halving; the work is that of sorting the words.
    """
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in t], np.uint64) for t in (a, q))
    rng = np.random.default_rng(3)
    values = rng.integers(1, 2**63, len(number), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    power = np.cumprod(np.full(max(len(a), len(q)) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    lo, hi, at = 0, min(len(a), len(q)), 0
    while lo < hi:
        n = (lo + hi + 1) // 2
        hit = np.flatnonzero(np.isin(_grams(values[x], n, power), _grams(values[y], n, power)))
        if len(hit):
            lo, at = n, int(hit[0])
        else:
            hi = n - 1
    return lo, at


def copies(question: str, answer: str) -> bool:
    """The answer is a run of the question's words, with or without a lead-in.

    The answer is compressed with the question as dictionary first: what does not
    shrink to a fraction of its size holds words of its own.
    """
    q, a = question.casefold().encode(), answer.casefold().encode()
    if not q:
        return False
    # The frame of a one-shot compression costs 9 bytes without content size and checksum.
    level = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(q, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
    if len(level.compress(a)) - 9 > COPY_BYTES * len(a) + 24:
        return False
    qw, aw = _WORD.findall(question.casefold()), _WORD.findall(_plain(answer).casefold())
    if not qw or not aw:
        return False
    n, at = _block(aw, qw)
    own = set(qw)
    return n >= max(2, COPY_SHARE * len(qw)) and at <= LEAD_IN and sum(w not in own for w in aw[at + n :]) <= 1 and len(aw) - n - at <= max(2, (len(aw) - n - at) // len(qw) * len(qw))


def asks_for(question: str, lang: str) -> bool:
    names = set(LANGUAGE_NAMES[lang].split())
    return any(w in names for w in _WORD.findall(question.lower()))


def breaks_off(answer: str, open_words: frozenset) -> bool:
    """The answer ends inside its last sentence, item or block.

    ``open_words`` is the terminal-context model: words that practically never end a
    sentence. A mark, note or sign-off after the last sentence does not count.
    """
    if answer.count("```") % 2:
        return True
    t = answer.rstrip()
    if t.endswith("```"):
        inner = t[: -3].rsplit("```", 1)[-1]
        inner = re.sub(r"^[a-zA-Z]*\s", "", inner).strip()
        return any(inner.count(a) > inner.count(b) for a, b in ("{}", "[]", "()"))
    t = _CLOSING.sub("", t).rstrip()
    t = re.sub(r"[​-‏⁠﻿*_~`]+$", "", t).rstrip()
    for a, b in ("“”", "«»", "„“"):
        # A closing mark that opens in another convention is counted with its own pair only.
        if a == "“" and "„" in t:
            continue
        if t.count(a) > t.count(b):
            return True
    if t.count("(") > t.count(")"):
        return True
    lines = t.split("\n")
    item = _ITEM.match(lines[-1])
    items = [m for m in map(_ITEM.match, lines) if m]
    if item and not (item.group(1) or "").strip():
        return True
    noted = _NOTE.sub("", t).rstrip()
    if noted != t and noted:
        # What stands before a closing note needs no full stop.
        return False
    if re.search(r"(?:…|\.\.\.|[,:;–—-])[\"'”’»\s]*$", t):
        return True
    if _END.search(t):
        return False
    last = lines[-1]
    words = _WORD.findall(last.lower())
    if not words:
        return False
    said = _WORD.findall(last)[-1]
    if words[-1] in open_words and (said.islower() or (last.isupper() and len(words) > 3)):
        return True
    if item and len(items) > 1:
        others = [m.group(1) or "" for m in items[:-1]]
        return any(_END.search(x) for x in others)
    if len(lines) > 1 and any(_END.search(x) for x in lines[:-1]):
        return True
    if _END.search(re.split(r"(?<=[.!?])\s+(?=[A-ZÀ-ÞŒ¿¡\d])", t)[0]) and re.search(r"[.!?]\s+\S", t):
        return True
    # One line without any full stop: a fact or a noun phrase is sound, a begun sentence is not.
    text = (item.group(1) if item else last).strip()
    head = text.lstrip("\"“«„'‘¿¡(")[:1]
    return len(_WORD.findall(text)) > 1 and head.isupper() and not re.fullmatch(r"[\W\dA-Z/.]+", text)


def defects_of(questions: list[str | None], answers: list[str | None], model: langid.LanguageModel, open_words: frozenset) -> list[str | None]:
    """The defect of each pair; those that still need it are looked at for their language together."""
    found: list[str | None] = []
    for q, a in zip(questions, answers):
        found.append("empty" if is_empty(a) else "copy" if copies(q or "", a) else "refusal" if is_refusal(a) else None)
    rest = [i for i, f in enumerate(found) if f is None]
    asked = sorted({questions[i] or "" for i in rest})
    of_question = dict(zip(asked, langid.stretches_many(model, asked)))
    of_answer = langid.stretches_many(model, [_core(answers[i]) for i in rest])
    for i, b in zip(rest, of_answer):
        q, answer = questions[i] or "", answers[i]
        a = of_question[q]
        if a and b:
            ql = max(a, key=lambda s: s[4] - s[3])
            al = max(b, key=lambda s: s[4] - s[3])
            if ql[1] != al[1] and ql[2] >= 0.9 and al[2] >= 0.9 and len(_WORD.findall(answer)) >= 4 and not any(s[1] == ql[1] for s in b) and not asks_for(q, al[1]):
                found[i] = "language"
                continue
        found[i] = "truncated" if breaks_off(answer, open_words) else None
    return found


def defect_of(question: str | None, answer: str | None, model: langid.LanguageModel, open_words: frozenset) -> str | None:
    return defects_of([question], [answer], model, open_words)[0]


def never_ending_words(evaluations: DataFrame) -> DataFrame:
    """(word): the terminal-context model, counted over all sentences of all contexts and answers.

    A word counts from SEEN occurrences on and from a share of LEAST_SHARE of all words, so
    there are never more than 1 / LEAST_SHARE of them; they are the words that hold sentences together.
    """
    texts = evaluations.select(F.explode(F.array("contexts", "answer")).alias("t")).where("t is not null")
    sentences = texts.select(F.explode(F.split(F.lower("t"), r"(?<=[.!?])[\s\"\]]+")).alias("s")).where(F.col("s").rlike(r"[.!?]$"))
    words = sentences.select(F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    counted = words.select(F.posexplode("w").alias("i", "word"), F.size("w").alias("n"))
    rate = cut(counted.groupBy("word").agg(F.count("*").alias("seen"), F.sum((F.col("i") == F.col("n") - 1).cast("long")).alias("ends")))
    total = rate.agg(F.sum("seen")).first()[0] or 0
    return rate.where((F.col("seen") >= max(SEEN, LEAST_SHARE * total)) & (F.col("ends") < NEVER_ENDS * F.col("seen"))).select("word")


def defective_pairs(evaluations: DataFrame, model: langid.LanguageModel, key: str = "id") -> DataFrame:
    """(key, defect): pairs whose answer is empty, a copy, a refusal, in another language or truncated.

    A null answer is empty; a null question leaves only what the answer shows alone.
    Each row is judged by itself, so repeated rows each come out and other columns
    do not matter.
    """
    spark = evaluations.sparkSession
    open_words = frozenset(r.word for r in never_ending_words(evaluations).collect())
    held = spark.sparkContext.broadcast((model, open_words))
    rows = spread(evaluations.select(F.col(key).alias("id"), "question", "answer"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, words = held.value
        for pdf in batches:
            m.tidy()
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                found = defects_of(*([None if pd.isna(x) else x for x in part[c]] for c in ("question", "answer")), m, words)
                out = pd.DataFrame({"id": part["id"], "defect": found})
                yield out[out["defect"].notna()]

    return rows.mapInPandas(run, "id long, defect string")
