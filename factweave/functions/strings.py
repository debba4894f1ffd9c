"""Names, keys and text shapes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let

# Words that name no entity, leading words of a name, trailing legal forms, qualifier key vocabularies, measure modifiers.
ANAPHORS = ("company", "group", "issuer", "firm", "entity", "corporation", "organisation", "organization")
ARTICLES = ("the", "a", "an")
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "prof", "shri", "smt", "sri", "sh", "mx")
LEGAL_FORMS = (
    "limited", "ltd", "company", "company limited", "co", "co ltd", "corporation", "corp", "inc", "incorporated", "plc", "private limited", "private ltd", "pvt ltd", "pvt limited", "pte ltd", "pte limited",
    "llp", "llc", "lp", "limited liability partnership", "gmbh", "ag", "nv", "bv", "sa", "sas", "spa", "srl", "ab", "aps", "oy", "oyj", "kk", "sdn bhd", "bhd", "pjsc", "jsc",
)
PERIOD_KEYS = ("period", "as_of", "as_at")
REPORTING_TIME = (*PERIOD_KEYS, "as_on", "year", "quarter", "month", "date", "time")
EVENT_TIME = ("effective", "acquisition", "meeting", "target", "start", "end", "maturity", "commencement", "expiry", "vesting", "grant", "inception")
PARTITION_TIME = (*PERIOD_KEYS, "year", "quarter", "month", "date", "time")
DISCRIMINATING = ("period", "as_of", "as_at", "consolidation", "basis", "scope", "segment", "geography")
NON_SEPARATING = ("consolidation",)
CONSOLIDATION_WORDS = ("consolidated", "standalone")
MEASURE_MODIFIERS = (
    "gross", "net", "total", "aggregate", "average", "mean", "median", "cumulative", "incremental", "nominal", "real", "adjusted", "unadjusted", "underlying", "reported", "basic", "diluted", "weighted",
    "consolidated", "standalone", "restated", "annualised", "annualized", "opening", "closing", "maximum", "minimum", "inward", "outward",
)
RESTATEMENTS = ("total", "aggregate")
BULLETS = "•‣▪▫▸▹○●◦⁃·"


def canonical_predicate(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def plain_words(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one blank: how text values compare."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def normalize_surface(c: Column) -> Column:
    """A name without possessives, and without one leading article or honorific where more words follow."""
    plain = plain_words(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "['’]s\\b", ""))
    return F.regexp_replace(plain, f"^(?:{'|'.join(ARTICLES + HONORIFICS)}) (?=.)", "")


def split_consolidation(predicate: Column) -> Column:
    """struct(measure, basis): a leading consolidated or standalone is a condition, not part of the measure."""
    name = canonical_predicate(predicate)
    basis = F.regexp_extract(name, f"^({'|'.join(CONSOLIDATION_WORDS)})_.", 1)
    has = basis != ""
    return F.struct(F.when(has, F.substring(name, F.length(basis) + 2, F.length(name))).otherwise(name).alias("measure"), F.when(has, basis).alias("basis"))


def surface_identities(surface: Column) -> Column:
    """Every name that a surface answers to: itself, and itself without one trailing legal form, if something is left."""

    def of(name: Column) -> Column:
        rest = F.array(*[F.lit(" " + form) for form in LEGAL_FORMS])
        ends = F.filter(rest, lambda form: F.endswith(name, form) & (F.length(name) > F.length(form)))
        stripped = F.transform(ends, lambda form: F.substring(name, F.lit(1), F.length(name) - F.length(form)))
        return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(F.array(name), stripped))))

    return let(normalize_surface(surface), of)


def subject_identities(surface: Column, key: Column) -> Column:
    return F.array_distinct(F.array_union(surface_identities(surface), F.array_compact(F.array(F.nullif(key, F.lit(""))))))


def same_entity(left: Column, right: Column) -> Column:
    """Over normalized names: equal, or one is the other and one legal form."""
    longer, shorter = F.when(F.length(left) >= F.length(right), left).otherwise(right), F.when(F.length(left) >= F.length(right), right).otherwise(left)
    rest = F.substring(longer, F.length(shorter) + 2, F.length(longer))
    return (left == right) | (F.startswith(longer, F.concat(shorter, F.lit(" "))) & rest.isin(*LEGAL_FORMS))


def subjects_match(surface_a: Column, key_a: Column, surface_b: Column, key_b: Column) -> Column:
    """Two hard keys decide alone; else two non-empty names must be the same entity."""
    return names_match(normalize_surface(surface_a), F.nullif(key_a, F.lit("")), normalize_surface(surface_b), F.nullif(key_b, F.lit("")))


def names_match(a: Column, ka: Column, b: Column, kb: Column) -> Column:
    """subjects_match over normalized names, and keys that are null where they are blank."""
    return F.when(ka.isNotNull() & kb.isNotNull(), ka == kb).otherwise((a != "") & (b != "") & same_entity(a, b))


def subject_names_the_measurement(surface: Column, predicate: Column) -> Column:
    words = F.filter(F.split(normalize_surface(surface), " "), lambda w: w != "")
    return (F.size(words) > 0) & (F.size(F.array_except(words, F.split(canonical_predicate(predicate), "_"))) == 0)


def key_matches(key: Column, known: tuple[str, ...]) -> Column:
    """Whether the words of one of the known keys are a run of the key's words."""
    padded = F.concat(F.lit("_"), key, F.lit("_"))
    out = F.lit(False)
    for k in known:
        out = out | F.contains(padded, F.lit(f"_{k}_"))
    return out


def dimension_of(key: Column) -> Column:
    """The question a qualifier key answers: period for reporting times that are no event's, else the key itself."""
    return F.when(key_matches(key, REPORTING_TIME) & ~key_matches(key, EVENT_TIME), F.lit("period")).otherwise(key)


def subject_id(surface: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(key, F.lit("")), normalize_surface(surface))


def comparison_key(surface: Column, key: Column, predicate: Column) -> Column:
    return F.concat_ws("|", subject_id(surface, key), predicate)


def fact_id(doc_id: Column, start: Column, end: Column, predicate: Column) -> Column:
    return F.concat(F.lit("f_"), F.substring(F.sha1(F.concat_ws(":", doc_id, start, end, predicate)), 1, 16))


def quarantine_id(doc_id: Column, chunk: Column, quote: Column) -> Column:
    return F.concat(F.lit("q_"), F.concat_ws("_", doc_id, chunk, F.substring(F.sha1(quote), 1, 10)))


def embed_text(surface: Column, predicate: Column, claim: Column) -> Column:
    """The text of a fact that an encoder is given: the claim, or what stands for it."""
    return F.coalesce(F.nullif(F.trim(claim), F.lit("")), F.concat_ws(" ", surface, F.regexp_replace(predicate, "_", " ")))


def _modifier(name: Column) -> tuple[Column, Column]:
    head = F.regexp_extract(name, "^([^_]*)_.", 1)
    found = head.isin(*MEASURE_MODIFIERS)
    return F.when(found, F.substring(name, F.length(head) + 2, F.length(name))).otherwise(name), F.when(found, head)


def contrastive(left: Column, right: Column) -> Column:
    """Whether two names differ in their leading measure modifier over one head: different modifiers, or one basis against none."""
    lh, lm = _modifier(left)
    rh, rm = _modifier(right)
    both = lm.isNotNull() & rm.isNotNull()
    return F.coalesce((lh == rh) & ~lm.eqNullSafe(rm) & (both | ~F.coalesce(lm, rm).isin(*RESTATEMENTS)), F.lit(False))


def shape(c: Column) -> Column:
    """Lower case, digits as #, white space as one blank: what repeated lines have in common."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\d+", "#"), r"(?U)\s+", " "))


def is_bullet(c: Column) -> Column:
    return F.rlike(c, F.lit(f"^[{BULLETS}-]{{1,2}}$"))


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def heading_shaped(c: Column) -> Column:
    """At most 80 characters and 12 words, with a letter, and not ending like a sentence; white space at the ends doesn't count."""
    text = stripped(c)
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return (F.length(text) <= 80) & (words <= 12) & F.rlike(text, F.lit(r"\p{L}")) & ~F.rlike(text, F.lit(r"[.,;:]\z"))


def scope_label(c: Column) -> Column:
    """The label of a bulleted section, or null: at most six words without digits, words of four letters and more capitalised."""
    text = F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{C}", ""), f"^[{BULLETS}\\s]+", ""))
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    letters = lambda w: F.regexp_replace(w, r"\P{L}", "")
    ok = (F.size(words) > 0) & (F.size(words) <= 6) & ~F.rlike(text, F.lit(r"(?U)\d")) & F.forall(words, lambda w: (F.length(letters(w)) < 4) | F.rlike(w, F.lit(r"^\P{L}*\p{Lu}")))
    return F.when(ok, text)
