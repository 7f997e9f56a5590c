"""Stems and compound parts of words, as expressions over arrays of words.

The stems strip regular inflection endings with length guards; they are light
stemmers, not the full published algorithms, and are off by default everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inflection endings by language, the longest first.
ENDINGS = {
    "en": ["ingly", "edly", "ings", "ing", "ies", "ied", "ed", "es", "ly", "s"],
    "de": ["erinnen", "erin", "ungen", "ern", "em", "er", "en", "es", "e", "s", "n"],
    "fr": ["issements", "issement", "euses", "euse", "ations", "ation", "ements", "ement", "eaux", "ées", "ée", "és", "es", "er", "ez", "é", "e", "s"],
    "es": ["amientos", "amiento", "aciones", "ación", "mente", "idades", "idad", "ados", "adas", "ado", "ada", "ar", "er", "ir", "es", "os", "as", "o", "a", "e", "s"],
    "it": ["amenti", "amento", "azioni", "azione", "mente", "ità", "ati", "ate", "ato", "ata", "are", "ere", "ire", "i", "e", "o", "a"],
    "nl": ["heden", "ingen", "ing", "eren", "en", "e", "s"],
    "pt": ["amentos", "amento", "ações", "ação", "mente", "idades", "idade", "ados", "adas", "ado", "ada", "ar", "er", "ir", "es", "os", "as", "o", "a", "e", "s"],
}
LEAST_STEM = 4

# Second parts of German compounds and the sounds that link parts.
COMPOUND_TAILS = ["verordnung", "vertrautheit", "datenschutz", "schutz", "ordnung", "zeit", "wahl", "rechnung", "gesetz", "grund", "steuer", "arbeit", "schiff", "dampf", "stelle", "system"]
LINKS = ["s", "n", "es", "en", "e", "er"]
LEAST_COMPOUND, LEAST_PART = 10, 4


# What a middle part of a compound without a known tail or link may hold.
MIDDLES = ["schutz", "ver", "wahl", "grund", "dampf", "schiff"]
LONGEST_MIDDLE, LEAST_SIDE = 12, 3


def light_stem(word: Column, language: Column) -> Column:
    """The word without its longest ending, if enough is left; words of other languages stay."""
    out = word
    for k, endings in ENDINGS.items():
        out = F.when(language == k, F.regexp_replace(word, rf"^(.{{{LEAST_STEM},}}?)(?:{'|'.join(endings)})$", "$1")).otherwise(out)
    return out


def _middle() -> str:
    """One alternative for each length of the middle, the longest first; a look-ahead asks what it holds."""
    each = ["(?=" + "|".join(f".{{0,{n - len(m)}}}{m}" for m in MIDDLES if len(m) <= n) + f")(.{{{n}}})(.{{{LEAST_SIDE},}})$" for n in range(LONGEST_MIDDLE, LEAST_PART - 1, -1)]
    return "|".join(rf"^(.{{{LEAST_SIDE},}}?){x}" for x in each)


def compound_parts(word: Column) -> Column:
    """The word in lower case, and its parts where one of four forms divides it: head, "grund" and tail; head and tail; parts around a link, the longest first part; parts around a telling middle."""
    w, tails = F.lower(word), "|".join(COMPOUND_TAILS)
    forms = [rf"^(.{{{LEAST_PART},}}?)(grund)({tails})$", rf"^(.{{{LEAST_PART},}}?)({tails})$", rf"^(.{{{LEAST_PART},}})(?:{'|'.join(LINKS)})(.{{{LEAST_PART},}})$"]
    out = F.array(w)
    # The middle's alternatives have three groups each, of which those that matched are not empty.
    middle = F.filter(F.array(*[F.regexp_extract(w, _middle(), i) for i in range(1, 3 * (LONGEST_MIDDLE - LEAST_PART + 1) + 1)]), lambda x: x != "")
    out = F.when(w.rlike(_middle()), F.concat(F.array(w), middle)).otherwise(out)
    for form in reversed(forms):
        out = F.when(w.rlike(form), F.array(w, *[F.regexp_extract(w, form, i + 1) for i in range(3 if "(grund)" in form else 2)])).otherwise(out)
    return F.when(F.char_length(w) < LEAST_COMPOUND, F.array(w)).otherwise(out)


def stem_words(words: Column, language: Column) -> Column:
    return F.transform(words, lambda w: light_stem(w, language))


def split_compounds(words: Column) -> Column:
    return F.flatten(F.transform(words, compound_parts))
