"""Column functions over text: search normalisation, tokens, phones, labels, token estimates and redaction."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Label stop words, and the constants of the token estimate.
LABEL_STOP_WORDS = (
    "di", "a", "da", "in", "con", "su", "per", "tra", "fra", "il", "lo", "la", "i", "gli", "le", "un", "uno", "una", "del", "dello", "della", "dei", "degli", "delle",
    "al", "allo", "alla", "ai", "agli", "alle", "dal", "dallo", "dalla", "dai", "dagli", "dalle", "nel", "nello", "nella", "nei", "negli", "nelle",
    "sul", "sullo", "sulla", "sui", "sugli", "sulle", "d", "l", "ed", "ad",
)
CHARS_PER_TOKEN, TOKENS_PER_WORD, TOKEN_OVERHEAD = 2.8, 1.35, 4


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


#: Characters whose normalised form the JVM gives by itself: ASCII and the letters of Latin-1; of these only the sharp s folds to two.
PLAIN = r"^[\x00-\x7F\u00C0-\u00FF]*$"


@F.pandas_udf(StringType())
def fully_normalized(texts):
    """NFKC and case folding, in Arrow batches."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def normalized(text: Column) -> Column:
    """NFKC and case folding, for search: in the JVM where lower case comes to the same, else by Arrow batches of the texts that need it."""
    plain = text.rlike(PLAIN)
    return F.when(plain, F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))).otherwise(fully_normalized(F.when(~plain, text)))


def normalized_query(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def visible(text: Column) -> Column:
    """Without direction marks and byte order marks; unbreakable blanks become blanks."""
    return F.translate(F.regexp_replace(text, r"[\u200E\u200F\u202A-\u202E\u2066-\u2069\uFEFF]", ""), "\u202f\u00a0", "  ")


@F.pandas_udf(StringType())
def ascii_folded(texts):
    """Without accents, ASCII only, case folded."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().casefold())


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of normalised text."""
    return words_of(normalized(text))


def bound(value: Column, f) -> Column:
    """f(value), where value is computed once however often f uses it, also within functions over elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strict_json(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; null of any other. Spark's parser stops behind the first value, so the text is also read as an
    element of an array and as a field of an object: what follows a value can't end both."""
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("\n]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v": '), text, F.lit("\n}")))
    return F.when(in_object.isNotNull(), F.try_variant_get(in_array, "$[0]", "variant"))


def words_of(text: Column) -> Column:
    """tokens() of a text that is normalised already."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def canonical_phone(raw: Column) -> Column:
    """+digits, or null unless it starts with a single +, holds only digits, blanks, hyphens and brackets, and five digits at least."""
    clean = F.trim(raw)
    digits = F.regexp_replace(clean, "[^0-9]", "")
    return F.when(clean.rlike(r"^\+[0-9 ()-]+$") & (F.length(digits) >= 5), F.concat(F.lit("+"), digits))


def estimated_tokens(text: Column) -> Column:
    """Upper estimate of a model's tokens: by characters or by words, whichever is more; 0 for an empty text."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    most = F.greatest(F.ceil(F.length(text) / CHARS_PER_TOKEN), F.ceil(words * TOKENS_PER_WORD)) + TOKEN_OVERHEAD
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(most).cast("long")


def normalized_label(label: Column) -> Column:
    """Lower case, ASCII punctuation to blanks, single blanks."""
    plain = F.regexp_replace(normalized(label), r"[!-/:-@\[-`{-~]", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def stem(word: Column) -> Column:
    """Without a final i, or a final e, o or a of words over four letters; short words stay."""
    cut = (F.length(word) > 3) & (word.endswith("i") | ((F.length(word) > 4) & word.rlike("[eoa]$")))
    return F.when(cut, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def canonical_label(label: Column) -> Column:
    """Stems of a normalised label's words but stop words; all its words where only stop words are left."""
    words = F.split(normalized_label(label), " ")
    kept = F.filter(words, lambda w: ~w.isin(*LABEL_STOP_WORDS))
    return F.array_join(F.transform(F.when(F.size(kept) > 0, kept).otherwise(words), stem), " ")


def pseudonym(prefix: str, raw: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.trim(raw), 256), 1, 12))


def redacted_paths(text: Column) -> Column:
    """Home folders and drive letters replaced."""
    out = F.regexp_replace(text, r"(?i)[a-z]:\\users\\[^\\\s]+\\", r"<USER_HOME>\\")
    out = F.regexp_replace(out, r"/(home|Users)/[^/\s]+/", "<USER_HOME>/")
    return F.regexp_replace(out, r"\b[A-Za-z]:\\", r"<DRIVE>\\")


def shortened(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


#: Texts and file names that stand for media, and the words of greetings.
MEDIA_TEXTS = (
    "<media omessi>", "<audio omesso>", "<immagine omessa>", "<video omesso>", "<sticker omesso>", "<documento omesso>", "media omessi", "image omitted", "audio omitted", "video omitted",
)
MEDIA_FILE = (
    r"(?i)^\s*(?:(?:IMG|PTT|AUD|VID|DOC|STK)[-_]\d{8}[-_]WA\d+\.[a-z0-9]{2,5}(?:\s*\((?:file allegato|allegato)\))?"
    r"|[\w.\-]+\.(?:opus|ogg|mp3|m4a|wav|jpg|jpeg|png|webp|mp4|pdf)\s*\((?:file allegato|allegato)\))\s*$"
)
GREETING_WORDS = (
    "ciao", "ehi", "ehila", "hey", "salve", "buongiorno", "buonasera", "buonanotte", "come", "stai", "va", "tutto", "bene", "benissimo", "ok", "okay", "perfetto", "tranquillo",
    "tranquilla", "grazie", "mille", "anche", "a", "te", "voi", "buona", "buon", "giornata", "serata", "allora", "presto", "ci", "vediamo", "sentiamo", "aggiorniamo", "domani",
    "dopo", "piu", "tardi", "stasera", "mattina", "un", "abbraccio", "saluto", "saluti", "bacio", "baci", "si", "no", "certo", "dai", "ahah", "ahahah", "ahahahah", "haha",
    "hahaha", "fantastico", "fantastica", "cara", "caro", "figurati", "ricevuto", "benone", "ottimo", "grande", "marco", "giulia", "anna", "francesca", "paolo", "bea", "beatrice",
    "simone", "luca", "sara", "elena", "davide", "matteo", "chiara", "andrea", "federico", "marta", "martina", "alessia", "lorenzo",
)
GREETING_MARKERS = (
    "ciao", "ehi", "ehila", "hey", "salve", "buongiorno", "buonasera", "buonanotte", "buona", "buon", "grazie", "figurati", "abbraccio", "bacio", "baci", "saluto", "saluti",
    "presto", "arrivederci", "vediamo", "sentiamo", "aggiorniamo", "stai", "benone", "ahah", "ahahah", "haha", "hahaha",
)


def is_media_placeholder(text: Column) -> Column:
    """Blank and null texts, texts that stand for omitted media, encryption notices and bare attachment names."""
    low = F.trim(F.lower(text))
    return ~has_text(text) | low.isin(*MEDIA_TEXTS) | F.contains(low, F.lit("crittografati end-to-end")) | text.rlike(MEDIA_FILE)


def _latin() -> tuple[str, str]:
    """Letters up to U+024F that decompose to one ASCII letter and a mark, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0xA0, 0x250)]
    return "".join(a for a, b in pairs if len(b) == 1), "".join(b for _, b in pairs if len(b) == 1)


def latin_folded(text: Column) -> Column:
    """Lower case ASCII without accents in the JVM: equal to ascii_folded() for Latin letters."""
    return F.lower(F.regexp_replace(F.translate(text, *_latin()), r"[^\x00-\x7F]", ""))


def is_greeting(text: Column) -> Column:
    """At most 75 characters and nine words, all of them words of greetings, one of them a marker."""
    words = F.regexp_extract_all(latin_folded(text), F.lit("[a-z0-9]+"), F.lit(0))
    known = F.forall(words, lambda w: w.isin(*GREETING_WORDS)) & F.exists(words, lambda w: w.isin(*GREETING_MARKERS))
    return F.coalesce((F.length(F.trim(text)) <= 75) & ~is_media_placeholder(text) & (F.size(words) <= 9) & known, F.lit(False))


#: Stems that tell nothing about a topic, stems taken as another, and pairs of opposed actions.
GENERIC_STEMS = (
    "tem", "tema", "argoment", "descrizion", "organizzazion", "preparazion", "attivit", "pianificazion", "gestion", "problem", "soluzion", "discussion", "conversazion", "conferm",
    "aggiornament", "prenotazion", "iscrizion", "acquist", "cors", "partit", "studi", "lavor", "incontr", "appuntament", "messagg", "verific", "evidenz", "comunicazion", "pratic",
    "servizi", "sistem", "progett", "informazion", "richiest", "controll", "orar", "giorn", "settiman", "doman", "ier", "ogg", "real", "sintetic", "test", "val", "valid", "nuov",
    "prim", "second", "terz", "tecnic", "manutenzion", "correzion", "risoluzion", "error", "problematic",
)
STEM_SYNONYMS = {
    "laptop": "portatil", "notebook": "portatil", "ferroviar": "tren", "ferroviari": "tren", "frecciaross": "tren", "oculistic": "oculist", "dockerfile": "docker", "dockerfil": "docker",
    "container": "docker", "pipelin": "docker", "deploy": "docker", "staging": "docker", "github": "gitpr", "pull": "gitpr", "merge": "gitpr", "merg": "gitpr", "branch": "gitpr", "request": "gitpr",
}
OPPOSED_STEMS = (
    (("acquist", "ordin", "compr"), ("restituzion", "res", "rimbors", "annullament")), (("installazion", "attivazion"), ("disinstallazion", "disattivazion", "rimozion")),
    (("partenz", "andat"), ("ritorn", "rientr")), (("backup", "salvatagg"), ("ottimizzazion", "query", "migrazion", "deadlock")), (("lavor", "consulenz"), ("vacanz", "turism")),
)


def domain_stems(text: Column) -> Column:
    """The distinct stems of a label that tell its topic, in order."""
    words = F.filter(F.split(normalized_label(text), " "), lambda w: ~w.isin(*LABEL_STOP_WORDS) & ~w.rlike(r"^\d*$"))
    synonyms = F.create_map(*[F.lit(x) for pair in STEM_SYNONYMS.items() for x in pair])
    stems = F.transform(F.transform(words, stem), lambda w: F.coalesce(F.try_element_at(synonyms, w), w))
    return F.array_distinct(F.filter(stems, lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_STEMS)))


def label_numbers(label: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(label, F.lit("")), F.lit(r"\d+"), F.lit(0))


def bare_label(label: Column) -> Column:
    """Without a leading field name and without quotes; as it is if nothing would be left."""
    clean = F.regexp_replace(F.trim(label), r"(?i)^(?:label|topic|titolo|argomento|in)\s*[:=]\s*", "")
    clean = F.regexp_replace(F.trim(clean), "^['\"]+|['\"]+$", "")
    return F.when(clean == "", F.trim(label)).otherwise(clean)


def bare_description(text: Column) -> Column:
    """Without a leading field name; as it is if nothing would be left."""
    clean = F.trim(F.regexp_replace(F.trim(text), r"(?i)^(?:short_description|description|descrizione|in)\s*[:=]\s*", ""))
    return F.when(clean == "", F.trim(text)).otherwise(clean)


def citation_shape(value: Column) -> Column:
    v = F.trim(value)
    return (
        F.when(v.rlike(r"^[A-Za-z]\d{3,4}$"), "ALIAS_FORMAT_NOT_IN_BLOCK").when(v.rlike(r"^\d+$"), "NUMERIC_ONLY")
        .when(F.contains(v, F.lit("::")) | v.startswith("unified:"), "FORENSIC_ID_NOT_IN_BLOCK").otherwise("OTHER")
    )


def redacted_id(id: Column) -> Column:
    """Plain aliases stay; other identifiers become pseudonyms; E_UNKNOWN for none."""
    clean = F.trim(id)
    return F.when(F.coalesce(id, F.lit("")) == "", "E_UNKNOWN").when(clean.rlike(r"(?i)^(?:E|sec_|chk_)\d{1,6}$"), clean).otherwise(pseudonym("ev", clean))


def safe_int(text: Column) -> Column:
    """A number's whole part; null for what isn't a finite number."""
    return safe_float(text).try_cast("bigint")


def safe_float(text: Column) -> Column:
    x = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def iso_timestamp(raw: Column) -> Column:
    """ISO text or seconds since 1970 as ISO text in UTC; null for what is neither. Without an offset it is taken as UTC."""
    text = F.trim(raw.cast("string"))
    seconds = safe_float(text)
    when = F.when(seconds > 0, F.timestamp_seconds(seconds)).when(seconds.isNull() & text.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(text))
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ssXXX")


# -- token budgets ----------------------------------------------------------------------------------

#: Profiles with their tokens and characters of a chunk, the parts of an overhead, and the least room for a chunk.
PROFILES = {"PRUDENT": (2500, 12000), "BALANCED": (4200, 18000), "PERFORMANCE": (5200, 24000)}
FRAME_TOKENS, TEMPLATE_TOKENS, RESERVED_TOKENS, MARGIN_TOKENS, SYSTEM_TOKENS, SPARE_TOKENS, LEAST_ROOM = 6, 32, 1500, 1000, 400, 128, 256


def framing_tokens(*names: Column) -> Column:
    """Tokens around a section in a request: by the length of its names, 85 at least."""
    size = F.lit(110)
    for n in names:
        size = size + F.length(F.coalesce(n, F.lit("")))
    return F.greatest(F.lit(85), F.ceil(size / 2.5)).cast("long")


def schema_tokens(schema: Column) -> Column:
    """Tokens of an answer's schema as compact JSON; 0 without one."""
    return F.when(F.coalesce(F.length(schema), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(64), F.ceil(F.length(schema) / 3) + 16)).cast("long")


def request_tokens(messages: list[tuple[Column, Column]], schema: Column) -> Column:
    """Tokens of a request: its (role, content) messages, their frames, the template and the schema."""
    total = F.lit(TEMPLATE_TOKENS) + schema_tokens(schema)
    for role, content in messages:
        total = total + FRAME_TOKENS + F.ceil(F.length(role) / 3) + estimated_tokens(content)
    return total.cast("long")


def budget_plan(context: Column, used: Column, reserved: Column, margin: Column) -> Column:
    """{needed, headroom, fits} of a request of `used` tokens with `reserved` ones for the answer."""
    needed = used + reserved + margin
    return F.struct(needed.cast("long").alias("needed"), F.greatest(F.lit(0), context - used - margin).cast("long").alias("headroom"), (needed <= context).alias("fits"))


def output_budget(context: Column, used: Column, wanted: Column, least: int = 512, margin: int = MARGIN_TOKENS) -> Column:
    """Tokens for an answer: what is wanted, `least` or more, as far as there is room; 0 where there isn't room for `least`."""
    room = F.greatest(F.lit(0), context - used - margin)
    return F.when(room < least, F.lit(0)).otherwise(F.least(room, F.greatest(F.lit(least), wanted))).cast("long")


def effective_profile(profile: Column, context: Column) -> Column:
    """{profile, tokens, chars} of a chunk: as asked for (BALANCED if unknown), or the next smaller one that there is room for; null without room."""
    asked = F.upper(F.trim(profile))
    asked = F.when(asked.isin(*PROFILES), asked).otherwise("BALANCED")
    room = context - (RESERVED_TOKENS + MARGIN_TOKENS + SYSTEM_TOKENS + SPARE_TOKENS)
    one = lambda name, tokens, chars: F.struct(F.lit(name).alias("profile"), tokens.cast("long").alias("tokens"), chars.cast("long").alias("chars"))
    fixed = {k: one(k, F.lit(t), F.lit(c)) for k, (t, c) in PROFILES.items()}
    out = F.when(room < LEAST_ROOM, F.lit(None))
    for k, (t, _) in PROFILES.items():
        out = out.when((asked == k) & (room >= t), fixed[k])
    return out.when(room >= PROFILES["BALANCED"][0], fixed["BALANCED"]).when(room >= PROFILES["PRUDENT"][0], fixed["PRUDENT"]).otherwise(one("PRUDENT", room, F.greatest(F.lit(1000), room * 4)))
