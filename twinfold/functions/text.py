"""Column expressions over text: cleaning, folding, tokens, dialogue marks, sentence boundaries."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must be as they are for right results.
OCR_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SEARCH_LIGATURES = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE"}
SPEECH_OPENERS = "—–-«"
TERMINATORS, CLOSERS, OPENERS = ".?!…", "»”\"’)]", "«“\"(—–"
ABBREVIATIONS = (
    "M MM Mme Mlle Mgr Dr Pr St Ste Me Sig Sigg Sig.ra Sig.na Dott Dott.ssa Prof Prof.ssa Avv Ing Mons SS "
    "cf p pp vol chap fig éd"
).split()
MARKERS = (
    "ISBN", "©", "Copyright", "Dépôt légal", "Achevé d", "Imprimé", "Du même auteur", "Dello stesso autore",
    "Titre original", "Titolo originale", "Traduit de", "Traduzione di", "Traduzione dal", "Finito di stampare",
    "Tous droits", "Tutti i diritti", "www.", "Éditions", "Edizioni", "Editore",
)
PARTICLES = "là ci t je tu il elle on nous vous ils elles moi toi lui leur y en ce même".split()
EXCLUDED_KINDS = ("running_head", "page_number", "footnote", "front_matter", "back_matter")
LAYOUT_KINDS = ("running_head", "page_number", "footnote")
CHAPTER_NUMBER = r"^\s*([0-9]+|[IVXLC]+)\s*$"
PAGE_NUMBER = r"(?i)^\s*([0-9]+|[ivxlcdm]+)\s*$"
NOTES_HEADING = r"(?iU)^[\s\x1c-\x1f]*(notes?|nota)\b"

#: White space as Python's text functions see it.
SPACE = r"[\s\x1c-\x1f]"


def ocr_normalize(text: Column) -> Column:
    """Spell out typographic ligatures, drop control characters but newline and tab, collapse blanks."""
    for one, several in OCR_LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(several))
    return F.regexp_replace(F.regexp_replace(text, CONTROL, ""), r"[ \t]+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def clean(text: Column) -> Column:
    """ocr_normalize, then every run of white space is one space, and none is left at the ends."""
    return F.btrim(F.regexp_replace(ocr_normalize(text), rf"(?U){SPACE}+", " "))


def spaceless(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){SPACE}+", "")


def scored_text(text: Column) -> Column:
    """What scoring counts: no white space, hyphens or soft hyphens."""
    return F.translate(spaceless(text), "-­", "")


def is_speech(text: Column) -> Column:
    """Does the first character that is no white space open dialogue?"""
    return F.coalesce(strip(text).rlike(f"^[{SPEECH_OPENERS.replace('-', '')}-]"), F.lit(False))


def fold_table() -> tuple[str, str]:
    """Latin letters with marks, in lower case, and the letters they are found by."""
    ranges = [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]
    pairs = {}
    for low in sorted({chr(c).lower() for c in ranges if len(chr(c).lower()) == 1}):
        base = "".join(ch for ch in unicodedata.normalize("NFD", low) if not unicodedata.combining(ch))
        if len(base) == 1 and base != low:
            pairs[low] = base
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Search form of a text: ligatures spelled out, lower case, marks removed."""
    for one, several in SEARCH_LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(several))
    source, target = fold_table()
    return F.translate(F.lower(text), source, target)


def tokens(folded: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def anchor_tokens(text: Column) -> Column:
    """Numbers, and capitalised words other than the first word; each once, sorted."""
    every = F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))
    capital = F.filter(F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0))), lambda w: w.rlike(r"^\p{IsUppercase}"))
    return F.array_sort(F.array_distinct(F.concat(capital, F.regexp_extract_all(text, F.lit(r"(?U)\d+"), F.lit(0)))))


def sentences(text: Column) -> Column:
    """Sentences of a block; a block without one is its own only sentence.

    A mark goes after every run of terminators with its closers that white space, openers and a capital follow; it is
    taken back where a single full stop ends an abbreviation or an initial.
    """
    closers = rf"(?:{SPACE}*[»”\"’)\]])*"
    after = rf"(?={SPACE}+(?:[{OPENERS}]{SPACE}*|-{SPACE}+)*\p{{IsUppercase}})"
    text = F.replace(text, F.lit("\u0001"), F.lit(""))  # the mark itself
    marked = F.regexp_replace(text, rf"(?U)([.?!…]+{closers}){after}", "$1\u0001")
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    veto = rf"(?U)((?:^|[^\p{{L}}.])\.*(?:{short}|\p{{IsUppercase}})\.{closers})\u0001"
    pieces = F.filter(F.transform(F.split(F.regexp_replace(marked, veto, "$1"), "\u0001", -1), strip), lambda s: s != "")
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(text))


def text_lines(text: Column) -> Column:
    """Lines as Python's splitlines cuts them."""
    return F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]", -1)
