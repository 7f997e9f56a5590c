"""Scalar text functions as column expressions: normalising, tokens, hashing, scrubbing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0B\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ["U.S.A.", "U.S.", "U.K.", "e.g.", "i.e.", "Prof.", "Mrs.", "Mr.", "Dr.", "Ms.", "Sr.", "Jr.", "vs.", "v.", "etc.", "Art.", "No.", "Fig.", "Vol."]
ABBREVIATION = r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(a[:-1].replace(".", r"\.") for a in ABBREVIATIONS) + r")\."


def clean_text(t: Column) -> Column:
    """White space of any kind as single blanks, none outside."""
    return F.trim(F.regexp_replace(t, SPACE, " "))


def preprocess_text(t: Column) -> Column:
    """Lower case without punctuation."""
    return clean_text(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s\p{Z}]", ""))


def tokens(t: Column, least: int = 2) -> Column:
    """Lower-case words of at least ``least`` characters, in order; the pattern itself leaves shorter ones out."""
    return F.regexp_extract_all(F.lower(t), F.lit(rf"[\p{{L}}\p{{N}}_]{{{least},}}"), F.lit(0))


def raw_words(t: Column) -> Column:
    return F.filter(F.split(t, SPACE), lambda x: x != "")


def token_count(t: Column) -> Column:
    return F.greatest(F.lit(1), F.size(raw_words(t)))


def sentences(t: Column) -> Column:
    """Sentences of a text after white space is collapsed; full stops of abbreviations end none."""
    marked = F.regexp_replace(clean_text(t), ABBREVIATION, "$1$2\x01")
    parts = F.split(F.regexp_replace(marked, r"([.!?]) +", "$1\x02"), "\x02")
    return F.filter(F.transform(parts, lambda s: F.trim(F.translate(s, "\x01", "."))), lambda s: s != "")


def scrub_query(q: Column, enabled: bool = True) -> Column:
    """A query as its SHA-256 in hex where scrubbing is on."""
    return F.sha2(q, 256) if enabled else q


def sanitize_input(t: Column, limit: int = 1000) -> Column:
    """Line ends as blanks; longer texts cut to ``limit`` characters and marked."""
    flat = F.translate(t, "\n\r", "  ")
    return F.when(F.char_length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


# Log phrases that quote a query.
QUERY_PHRASES = [r"Processed query: (.+)$", r"Query: '(.+)'", r"Query: (.+)$", r"Saved evaluation for query: (.+?) with", r"Testing \[.*\]: (.+)$"]


def scrub_log_line(line: Column) -> Column:
    """The query quoted in a log line, as its hash; the first phrase that matches counts."""
    out = line
    for p in reversed(QUERY_PHRASES):
        q = F.regexp_extract(line, p, 1)
        out = F.when(line.rlike(p), F.replace(line, q, F.sha2(q, 256))).otherwise(out)
    return out


def keyword_list(t: Column) -> Column:
    """Parts between separators without repeats (case apart, first spelling kept)."""
    parts = F.filter(F.transform(F.split(t, r"[;,\n|]+"), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(parts, lambda x: F.lower(x))
    return F.filter(parts, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def valid_id(i: Column) -> Column:
    return i.rlike(r"^[A-Za-z0-9_.:-]+$")


def sanitize_id(i: Column) -> Column:
    return F.regexp_replace(i, r"[^A-Za-z0-9._:-]", "_")


def chunk_id(base: Column, page: Column, table_index: Column, sentence_index: Column, row_start: Column, sheet: Column, chunk_index: Column) -> Column:
    """Identity of a chunk by the most specific position known."""
    s = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    base = sanitize_id(base)
    return (
        F.when(page.isNotNull() & table_index.isNotNull(), F.concat(base, s("_p", page), s("_t", table_index)))
        .when(page.isNotNull() & sentence_index.isNotNull(), F.concat(base, s("_p", page), s("_s", sentence_index)))
        .when(page.isNotNull(), F.concat(base, s("_p", page), s("_chunk_", chunk_index)))
        .when(sheet.isNotNull(), F.concat(base, F.lit("_sheet_"), sanitize_id(sheet), F.coalesce(s("_", row_start), F.lit(""))))
        .when(row_start.isNotNull(), F.concat(base, s("_csv_", row_start)))
        .when(sentence_index.isNotNull(), F.concat(base, s("_s", sentence_index)))
        .otherwise(F.concat(base, s("_chunk_", chunk_index)))
    )


def encrypt(t: Column, key: Column) -> Column:
    """AES-GCM envelope in base64."""
    return F.base64(F.aes_encrypt(t, key))


def decrypt(t: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(t), key).cast("string")


def with_prompt(t: Column, prompts: dict[str, str] | None, name: str | None) -> Column:
    """Text after the model's prompt prefix of that name, if it has one under a usual spelling."""
    if not prompts or not name:
        return t
    spellings = [name, name.lower(), name.capitalize(), *(f"Retrieval-{n}" for n in (name, name.capitalize(), name.lower())), f"{name}-document", f"{name}-query"]
    prefix = next((prompts[s] for s in spellings if s in prompts), None)
    if prefix is None:
        prefix = next((v for k, v in prompts.items() if name.lower() in k.lower()), None)
    return F.concat(F.lit(prefix), t) if prefix else t


def guess_language(t: Column, words: dict[str, list[str]] | None = None, default: str = "en", head: int | None = 500) -> Column:
    """Language whose function words are the most in the first ``head`` characters (None: all); ties and none give the default."""
    words = words or FUNCTION_WORDS
    found = tokens(t if head is None else F.substring(t, 1, head), 1)
    score = lambda k: F.size(F.filter(found, lambda x: x.isin(words[k])))
    order = [default, *sorted(k for k in words if k != default)]
    best = F.greatest(*[F.struct(score(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(order)])
    return F.coalesce(best["k"], F.lit(default))


# Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on by this be are from at which".split(),
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als nach".split(),
    "fr": "le la les de des et en un une du que pour dans est par au sur pas plus ce".split(),
    "es": "el la los las de del y en un una que por con para se al lo como más su".split(),
    "it": "il lo la gli le di del della e in un una che per con non si al come dal".split(),
    "nl": "de het een van en in op te dat voor is met zijn aan niet door bij ook naar uit".split(),
    "pt": "o a os as de do da e em um uma que para com não se por no na ao".split(),
}
