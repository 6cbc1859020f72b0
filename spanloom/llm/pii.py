"""Personal information inside free text, by information-theoretic sanitisation.

Mail addresses, phone numbers, identity numbers and street addresses have forms of their own and are found as such. Names
have none: whether a word is part of a name shows in how much it reveals about protected entities. All words of the
corpus are counted, and how often they fill a person's slot: before a mail address, number or address, after a
salutation or title, in a field for a person. The disclosure of a word is the pointwise mutual information of the word and the slot,
in bits. Words over the threshold are kept in two bitmaps of fixed size, one of given names and one of
surnames, and a name is a given name or initial with a surname, in either order, wherever it stands.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, spread, written
from .keys import arrow_rows
from .sketches import BLOB, Bitmap, blobs, collected

#: The kinds and their placeholders.
PLACEHOLDERS = {"person_name": "[PERSON_NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[IDENTITY_NUMBER]", "street_address": "[STREET_ADDRESS]"}

_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_TOKEN = rf"[{_L}]+(?:['’][{_L}]+)?"
_WORD = re.compile(_TOKEN)
#: Particles of surnames.
_PARTICLES = {"van", "von", "de", "del", "della", "der", "den", "di", "da", "dos", "du", "la", "le", "ten", "ter", "bin", "ben", "al", "el"}
_PARTICLE = "(?:" + "|".join(sorted(_PARTICLES)) + ")"

# Names as slots hold them: surname first with a comma, or given name first.
_GIVEN = rf"(?:{_TOKEN}|[{_L}]\.)"
_SURNAME = rf"(?:{_PARTICLE} ){{0,2}}{_TOKEN}(?:-{_TOKEN})?"
_NAME = rf"(?P<name>(?<![{_L}\d_'’])(?:(?P<last>{_SURNAME}), (?P<after>{_GIVEN}(?: {_GIVEN})?)|(?P<first>{_GIVEN}(?: {_GIVEN})?) (?P<sur>{_SURNAME}))(?![{_L}\d_'’]))"
_SLOT_END = r"(?=\s*(?:[,.;:<(\[\"\n]|$|です)|\s(?:about|at|wrote|signed|unter|au|al|for|anrufen)\b)"
#: Words and signs before a person, in the languages of the corpus.
_CUE = re.compile(
    r"\b(?:Dr|Mr|Mrs|Ms|Mx|Prof|Herrn?|Frau|Mme|Sra?)\.? |\b(?:Dear|Hello|Hi|Lieber?|Cher|Chère|Estimad[oa]) "
    r"|\b(?:Regards|Best|Sincerely|Yours|Cordialement|Saludos?|Atentamente|Grüßen?|Gruß),?[ \t\r]*\n\s*"
    r"|\b(?:issued to|belongs to|assigned to|spoke with|reach|contact|Contactez|Bitte|Llame a|Ansprechpartner(?:in)? ist) |\breviewer - |担当は|\b(?:name|owner|contact)[\"']?\s?[:=] ?[\"']?",
    re.I,
)
_AT_CUE = re.compile(_NAME + _SLOT_END, re.I)
#: Words after a person.
_AFTER = re.compile(r" (?:wrote:|signed the |schrieb:|a écrit)")
_BEFORE_WORD = re.compile(_NAME + "$", re.I)
_BEFORE_ENTITY = re.compile(rf"{_NAME}(?:,? ?[<(\[]|, |\s?\n|,? (?:at|unter|au|al|-|/) |; ?\w+=|\", \"\w+\": \")(?:mailto:|tel:)?$", re.I)
#: Words of the slots themselves, which are no names.
_CUE_WORDS = set(
    "dr mr mrs ms mx prof herr herrn frau mme sr sra dear hello hi liebe lieber cher chère estimado estimada regards best sincerely yours cordialement saludo saludos "
    "atentamente viele grüße grüßen to with reach contact contactez bitte please llame ansprechpartner ansprechpartnerin ist reviewer name owner mail email phone tel cc ship send drop call and text ".split()
)

# Mail addresses.
_LOCAL = r"[\w](?:[\w.+%'-]*[\w+])?"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_MAIL = re.compile(rf"(?<![\w.+%/@-]){_LOCAL}\s?@\s?{_LABEL}(?:\.{_LABEL})*\.[^\W\d_]{{2,}}(?![\w@])")
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_SPELT = re.compile(
    rf"(?<![\w.+%/@-]){_LOCAL}(?:\s?@\s?|\s?[\[({{]\s?at\s?[\])}}]\s?)(?:{_LABEL}{_DOT})+[^\W\d_]{{2,}}(?![\w@])"
    rf"|(?<![\w.+%/@-]){_LOCAL}\sat\s(?:{_LABEL}(?:\s?[\[({{]\s?dot\s?[\])}}]\s?|\sdot\s))+[^\W\d_]{{2,}}(?![\w@])",
    re.I,
)
_SPELT_SIGN = re.compile(r"[\[({]\s?at\s?[\])}]|[\s\[({]dot[\s\])}]", re.I)  # without it, _SPELT finds no more than _MAIL

# Phone numbers: international with + or 00, national with a leading 0, and ten digits in groups.
_PHONE = re.compile(
    r"(?<![\w.+#/-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]\d(?=[ .-]))?(?:[ .-]?\d{2,5}){1,6}"
    r"|00[1-9]\d{0,2}(?:[ .-]\d{2,5}){2,5}|00\d{2}-\d{3}-\d{3}-\d{4}"
    r"|(?:1[ .-])?\(\d{3}\) ?\d{3}[ .-]\d{4}"
    r"|(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}"
    r"|\d{3} \d{3} \d{2} \d{2}"
    r"|0[1-9]\d{0,3}(?:[ /-]\d{2,6}){1,4}"
    r")(?:,? ?(?:ext\.?|x) ?\d{1,5})?(?![\w-]|[.,]\d)"
)
_DATE = re.compile(r"0?\d{1,2}[ /-]\d{1,2}[ /-]\d{2,4}$")

# Identity numbers: a cue and the number it announces, or an account-like number.
#: Cues of identity numbers, in the languages of the corpus.
_ID_CUES = (
    r"passport(?: (?:number|no\.?))?|SSN|social security(?: (?:number|no\.?))?|tax(?:payer)? (?:number|no\.?|id)|TIN|national (?:id|insurance)(?: (?:number|no\.?))?"
    r"|(?:applicant|identity|identification|id)(?: (?:id|card|document))?(?: (?:number|no\.?))|applicant id|Ausweisnummer|Personalausweis(?:nummer)?|Passnummer|Reisepass|Steuer(?:nummer|-ID)|Sozialversicherungsnummer"
    r"|pièce d['’]identité|passeport|numéro (?:fiscal|de sécurité sociale)|documento(?: nacional)? de identidad|pasaporte|DNI|NIE|NIF|número de la seguridad social|身分証(?:明書)?番号|パスポート番号|旅券番号|マイナンバー|個人番号"
)
_ID = re.compile(
    rf"(?<![^\W_])(?:{_ID_CUES})(?:\s+on file)?(?:\s+is|\s+ist|\s+est|\s+es)?(?:\s*[:=#]|\s+n[°ºo]\.?|\s+no\.?|は|が)?\s*"
    r"(?P<id>(?=(?:[A-Za-z]{0,3}[ -]?)?\d)[A-Za-z]{0,3}(?:[ -]?\d+){1,8}(?:[ -]?[A-Za-z](?![^\W_]))?)(?![^\W_])",
    re.I,
)
_ACCOUNT = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?\d{4}){3,7}(?: ?\d{1,4})?(?![\w-])")

# Street addresses.
_BOX = r"(?:P\. ?O\.?|PO) ?Box \d+|Postfach \d[\d ]*\d|Apartado(?: de [Cc]orreos)? \d+"
#: Kinds of streets and parts of buildings, in the languages of the corpus.
_STREETS = r"Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Way|Court|Ct|Close|Place|Pl|Square|Sq|Terrace|Boulevard|Blvd|Crescent|Parkway|Highway"
_UNIT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Room|Rm\.?|Floor) ?#?\d+[A-Za-z]?,? )?"
_ENGLISH = re.compile(rf"(?<![\w.#/-])(?:{_BOX}|{_UNIT}\d{{1,5}}[A-Za-z]?,? (?:[A-ZÀ-Þ][\w'’-]*\.? ){{1,5}}(?:{_STREETS}|(?-i:{_STREETS.upper()}))\b(?:\.?,? ?#\d+)?)")
_LOWER = re.compile(rf"(?<![\w.#/-])(?:{_BOX}|{_UNIT}\d{{1,5}}[a-z]? (?:[^\W\d_][\w'’-]*\.? ){{1,4}}(?:{_STREETS})\b\.?,? ?#\d+)", re.I)
_CUED = re.compile(rf"(?:address (?:was|is)|arrived at|off at|keys to|lives at|deliver(?:ed)? to|address:)\s+({_UNIT}\d{{1,5}}[a-z]? (?:[^\W\d_][\w'’-]*\.? ){{1,4}}(?:{_STREETS})\b)", re.I)
_FRENCH = re.compile(r"(?<![\w.#/-])\d{1,5}(?: ?(?:bis|ter|quater))?,? (?:rue|allée|avenue|place|chemin|impasse|quai|boulevard|cours|passage|route|square) (?:(?:de la|de l['’]|de|du|des|d['’]|la|le|les) ?)?[A-ZÀ-Þ][\w'’-]+(?: (?-i:[A-ZÀ-Þ])[\w'’-]+){0,2}", re.I)
_SPANISH = re.compile(r"\b(?:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Pza\.?|Paseo|Camino|Carrera|Ronda) (?:(?:de la|de los|de las|del|de|la|el|los|las) )?[A-ZÀ-Þ][\w-]+(?: (?:de |del |la )?[A-ZÀ-Þ][\w-]+){0,3},? (?:n[º°] ?)?\d{1,5}\b(?:, \d{1,2}[ºª](?: ?[A-Z]\b)?)?", re.I)
_GERMAN = re.compile(r"(?<![\w-])(?:(?:Alte[rns]?|Neue[rns]?|Große[rns]?|Kleine[rns]?|Lange[rns]?|Obere[rns]?|Untere[rns]?|Hohe[rns]?|Am|An der|An den|Im|In der|Auf der|Zum|Zur|Sankt|St\.) )?[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.?|gasse|weg|platz|allee|ring|damm|ufer|steig) \d{1,4} ?[a-z]?\b", re.I)
# A street named by where it lies has no street's ending, so the word before tells it.
_PLACED = re.compile(r"(?:Anschrift|Adresse|Wohnort):\s((?:Am|Im|An de[rn]|In de[rn]|Auf de[rm]|Hinter de[rm]|Unter de[nr]|Zum|Zur|Bei de[rm]) (?:[A-ZÄÖÜ][\w-]+ ){1,3}\d{1,4}(?: ?[a-z])?\b)", re.I)


#: Literals without which a family of patterns can't match, in lower case.
_FAMILIES = {
    "german": ["straße ", "strasse ", "str. ", "str ", "gasse ", "weg ", "platz ", "allee ", "ring ", "damm ", "ufer ", "steig "],
    "placed": ["anschrift:", "adresse:", "wohnort:"],
    "spanish": ["calle ", "c/ ", "avda", "avenida ", "av. ", "plaza ", "pza", "paseo ", "camino ", "carrera ", "ronda "],
    "french": [" rue ", " allée ", " avenue ", " place ", " chemin ", " impasse ", " quai ", " boulevard ", " cours ", " passage ", " route ", " square "],
    "english": [" street", " st", " road", " rd", " avenue", " ave", " lane", " ln", " drive", " dr", " way", " court", " ct", " close", " place", " pl", " square", " sq", " terrace", " boulevard", " blvd", " crescent", " parkway", " highway", "box ", "postfach ", "apartado "],
    "identity": [
        "passport", "ssn", "social security", "tax ", "taxpayer", "national i", "applicant", "identi", "id number", "id no", "id card", "id document", "ausweis", "passnummer", "reisepass", "steuer", "sozialvers",
        "passeport", "numéro ", "pasaporte", "dni", "nif",
        "número ", "身分証", "パスポート", "旅券", "マイナンバー", "個人番号",
    ],
    "short": ["tin", "nie"],  # cues of identity numbers that stand inside many words, so only a word's start counts
    "lower": ["box ", "postfach ", "apartado ", "#"],
    "cued": ["address ", "address:", "arrived at", "off at", "keys to", "lives at", "deliver"],
    "slot": [
        "dr", "mr", "ms", "mx ", "mx.", "prof", "herr", "frau", "mme", "sr ", "sr.", "sra", "dear ", "hello ", "hi ", "liebe", "cher ", "chère ", "estimad", "regards", "best", "sincerely", "yours", "cordialement", "saludo", "atentamente", "grüße",
        "gruß", "issued to ", "belongs to ", "assigned to ", "spoke with ", "reach ", "contact", "bitte ", "llame a ", "ansprechpartner", "reviewer - ", "担当は", "name", "owner",
    ],
}


def _automaton() -> ahocorasick.Automaton:
    words: dict[str, list[str]] = {}
    for family, literals in _FAMILIES.items():
        for w in literals:
            words.setdefault(w, []).append(family)
    a = ahocorasick.Automaton()
    for w, families in words.items():
        a.add_word(w, (len(w), tuple(families)))
    a.make_automaton()
    return a


_literals = _automaton()
ALL_FAMILIES = frozenset([*_FAMILIES, "spelt"])


def literals(text: str) -> tuple[set[str], list[int] | None]:
    """Families of patterns that can match a text, and where the literals of slots start in it; null where lower case moves places."""
    lower = text.lower()
    if len(lower) != len(text) or "ſ" in text or "ı" in text:  # places would not agree; patterns take these for s and i
        return set(ALL_FAMILIES), None
    families: set[str] = {"spelt"} if _SPELT_SIGN.search(text) else set()
    at = []
    for end, (length, hit) in _literals.iter(lower):
        if hit in (("german",), ("lower",)) and not lower[end + 1 : end + 2].isdigit():  # a number follows
            continue
        families.update(hit)
        if "short" in hit and not lower[end - length : end - length + 1].isalnum():
            families.add("identity")
        if "slot" in hit:
            at.append(end - length + 1)
    return families, at


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    kind: str


def structured(text: str, families: set[str] | None = None) -> list[Found]:
    """Mail addresses, street addresses, identity numbers and phone numbers, in order, without overlaps; the kinds take precedence in this order.
    ``families`` are those of ``literals``, found if not given."""
    families = literals(text)[0] if families is None else families
    got: list[Found] = []
    taken: list[tuple[int, int]] = []

    def take(start: int, end: int, kind: str) -> None:
        if all(end <= a or b <= start for a, b in taken):
            taken.append((start, end))
            got.append(Found(start, end, kind))

    for m in _MAIL.finditer(text) if "@" in text else ():
        take(*m.span(), "email")
    for m in _SPELT.finditer(text) if "spelt" in families else ():
        take(*m.span(), "email")
    if any(c.isdigit() for c in text):
        for family, pattern in (("english", _ENGLISH), ("lower", _LOWER), ("french", _FRENCH), ("spanish", _SPANISH), ("german", _GERMAN)):
            for m in pattern.finditer(text) if family in families else ():
                take(*m.span(), "street_address")
        for family, pattern in (("cued", _CUED), ("placed", _PLACED)):
            for m in pattern.finditer(text) if family in families else ():
                take(*m.span(1), "street_address")
        for m in _ID.finditer(text) if "identity" in families else ():
            if sum(c.isdigit() for c in m["id"]) >= 5:
                take(*m.span("id"), "identity_number")
        for m in _ACCOUNT.finditer(text):
            take(*m.span(), "identity_number")
        for m in _PHONE.finditer(text):
            digits = sum(c.isdigit() for c in re.split(r"(?i),? ?(?:ext|x)", m[0])[0])
            if 9 <= digits <= 15 and not _DATE.match(m[0]) and not m[0].startswith("000"):
                take(*m.span(), "phone")
    return sorted(got, key=lambda f: f.start)


def without(text: str, entities: list[Found]) -> str:
    """The text with a blank in place of each entity."""
    out, at = [], 0
    for e in entities:
        out.append(text[at : e.start])
        at = e.end
    return " ".join([*out, text[at:]])


def _parts(match: re.Match) -> tuple[list[str], list[str]]:
    """Given names and surnames of a slot's name, without initials and particles."""
    given = [w for w in (match["after"] or match["first"] or "").split(" ") if not w.endswith(".")]
    last = map(_bare, re.split(r"[ -]", match["last"] or match["sur"] or ""))
    none = _PARTICLES | _CUE_WORDS
    return [w for w in given if len(w) > 1 and w.lower() not in none], [w for w in last if len(w) > 1 and w.lower() not in none]


def _slot(lo: int, match: re.Match, given: list[str], last: list[str]) -> dict:
    """A slot's name as it is kept: its place, given names, whether these are initials only, and whether it has a surname with a capital."""
    initial = not given and (match["after"] or match["first"]).endswith(".") and len((match["after"] or match["first"]).split(" ")[0]) == 2
    return {"start": lo + match.start("name"), "end": lo + match.end("name"), "given": [w.lower() for w in given], "initial": initial, "last": bool(last) and (not initial or last[0][0].isupper())}


def _bare(word: str) -> str:
    """A surname without a leading O' or D'."""
    return word[2:] if len(word) > 3 and word[1] in "'’" else word


def _before(text: str, end: int, pattern: re.Pattern) -> Iterator[tuple[int, re.Match]]:
    """The longest name before a place that starts with a capital and with no word of the slot itself."""
    lo = max(0, end - 90)
    before, at = text[lo:end], 0
    while m := pattern.search(before, at):
        word = (m["first"] or m["last"]).split(" ")[0]
        if word[0].isupper() and word.lower() not in _CUE_WORDS:
            yield lo, m
            return
        at = m.start("name") + len(word)


def slots(text: str, entities: list[Found], places: list[int] | None = None) -> Iterator[tuple[int, re.Match]]:
    """Names in the slots of a text, as (offset of the match in the text, match); one name may come from several slots. ``places`` are those of ``literals``."""
    cues = _CUE.finditer(text) if places is None else filter(None, (_CUE.match(text, k) for k in sorted(set(places))))
    for cue in cues:
        if m := _AT_CUE.match(text, cue.end()):
            yield 0, m
    for after in _AFTER.finditer(text):
        yield from _before(text, after.start(), _BEFORE_WORD)
    for e in entities:
        yield from _before(text, e.start, _BEFORE_ENTITY)


@dataclass(frozen=True)
class Disclosure:
    """``bits``: mutual information of a word and a slot from which the word reveals a person; ``seen_bits``: size of the bitmaps."""

    bits: float = 4.0
    seen_bits: int = 24


_FIRST = "h long, n long, capital long, given long, surname long, id long, text string, entities array<struct<start:int,end:int,kind:string>>, slots array<struct<start:int,end:int,given:array<string>,initial:boolean,last:boolean>>"
_ENTITY = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_SLOT = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("given", pa.list_(pa.string())), ("initial", pa.bool_()), ("last", pa.bool_())]))
_FIRST_TYPES = {"h": pa.int64(), "n": pa.int64(), "capital": pa.int64(), "given": pa.int64(), "surname": pa.int64(), "id": pa.int64(), "text": pa.string(), "entities": _ENTITY, "slots": _SLOT}


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the texts: what has a form of its own and the names in slots are kept with the text, and the hashes of words are counted."""
    n: Counter = Counter()
    capital: Counter = Counter()
    given: Counter = Counter()
    surname: Counter = Counter()
    rows: list[tuple] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys = list(n.keys() | given.keys() | surname.keys())
        for k in range(0, len(keys), 10_000):
            part = keys[k : k + 10_000]
            h = np.fromiter(map(_hash, part), np.uint64, len(part)).view(np.int64)
            none = [None] * len(part)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((h, *([c[w] for w in part] for c in (n, capital, given, surname)), none, none, none, none), _FIRST_TYPES.values(), strict=True)], list(_FIRST_TYPES))

    def kept() -> pa.RecordBatch:
        none = [None] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((none, none, none, none, none, *zip(*rows, strict=True)), _FIRST_TYPES.values(), strict=True)], list(_FIRST_TYPES))

    for key, text in arrow_rows(batches, "id", "text"):
        families, places = literals(text)
        entities = structured(text, families)
        n.update(_WORD.findall(without(text, entities)))
        firsts, lasts, found = set(), set(), []
        for lo, m in slots(text, entities, places):
            a, b = _parts(m)
            at = lo + m.start("name")
            firsts.update((at, w) for w in a)
            lasts.update((at, w) for w in b)
            found.append(_slot(lo, m, a, b))
        given.update(w.lower() for _, w in firsts)
        surname.update(w.lower() for _, w in lasts)
        capital.update(w.lower() for _, w in firsts | lasts if w[0].isupper())
        rows.append((key, text, [{"start": e.start, "end": e.end, "kind": e.kind} for e in entities], found))
        held += len(text)
        if len(n) > 300_000:
            n = _lowered(n)
            yield from flush()
            n.clear(), capital.clear(), given.clear(), surname.clear()
        if held > 2_000_000 or len(rows) == 1000:
            yield kept()
            rows, held = [], 0
    n = _lowered(n)
    yield from flush()
    if rows:
        yield kept()


def _lowered(n: Counter) -> Counter:
    """Counts of words as they stand, as counts of lower-cased words without a leading O' or D'; done once for each spelling and not for each occurrence."""
    out: Counter = Counter()
    for w, k in n.items():
        out[_bare(w).lower()] += k
    return out


def disclosures(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written counts, and (h, n, capital, given, surname, given_bits, surname_bits) over all words of the corpus, told by hash: how often each stands there, in the two parts of a person's
    slot and with a capital in either, and the mutual information of word and part in bits (null where it never stands there)."""
    counts = written(first.where("h is not null").groupBy("h").agg(F.sum("n").alias("n"), F.sum("capital").alias("capital"), F.sum("given").alias("given"), F.sum("surname").alias("surname")), "pii-counts")
    whole = counts.agg(F.sum("n").alias("n"), F.sum("given").alias("given"), F.sum("surname").alias("surname")).first()
    bits = lambda c: F.when(F.col(c) > 0, F.log2(F.col(c) / F.greatest(F.col("n"), F.col(c)) * ((whole["n"] or 1) / max(1, whole[c] or 1))))
    return counts, counts.select("h", "n", "capital", "given", "surname", bits("given").alias("given_bits"), bits("surname").alias("surname_bits"))


def _word_bitmap(part: str, bits: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Bitmap(bits)
        for batch in batches:
            seen.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        for blob in blobs(part, seen.array()):
            yield pa.RecordBatch.from_arrays([pa.array([blob[0]]), pa.array([blob[1]], pa.int32()), pa.array([blob[2]], pa.binary())], ["part", "chunk", "blob"])

    return run


class Lexicon:
    """Membership of words in the two bitmaps, remembered for common words."""

    def __init__(self, given: np.ndarray, surname: np.ndarray, bits: int) -> None:
        self.maps = Bitmap(bits, given), Bitmap(bits, surname)
        self.known: dict[str, tuple[bool, bool]] = {}

    def __call__(self, word: str) -> tuple[bool, bool]:
        """Whether a lower-cased word is a given name, and whether it is a surname."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            h = np.array([_hash(word)], np.uint64)
            got = self.known[word] = bool(self.maps[0].has(h)[0]), bool(self.maps[1].has(h)[0])
        return got


_INITIAL_BEFORE = re.compile(rf"(?<![\w.])[{_L}]\. $")
_GIVEN_AFTER = re.compile(rf", (?:(?P<word>{_TOKEN})|[{_L}]\.)(?![^\W\d_]*[^\W_{_L}]*\d)")


def names(text: str, entities: list[Found], lexicon: Callable[[str], tuple[bool, bool]]) -> list[Found]:
    """Given name or initial with surname, in either order, outside the given entities."""
    if not any(lexicon(_bare(w).lower())[1] for w in set(_WORD.findall(text))):
        return []
    words = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
    got: list[Found] = []
    busy = [(e.start, e.end) for e in entities]
    k = 0
    while k < len(words):
        start, end, word = words[k]
        if not lexicon(_bare(word))[1] or any(a < end and start < b for a, b in busy):
            k += 1
            continue
        # Parts of a double surname.
        first = last = k
        while last + 1 < len(words) and text[words[last][1] : words[last + 1][0]] == "-":
            last += 1
        while first and text[words[first - 1][1] : words[first][0]] == "-":
            first -= 1
        left = first
        while left and words[left - 1][2] in _PARTICLES and text[words[left - 1][1] : words[left][0]] == " " and first - left < 2:
            left -= 1
        begin, found = words[left][0], None
        # Given name first: up to two given names or initials before the surname.
        at, n = begin, 0
        before = left - 1
        while n < 2:
            if m := _INITIAL_BEFORE.search(text, max(0, at - 3), at):
                at, n = m.start(), n + 1
                before -= 1
            elif before >= 0 and text[words[before][1] : at] == " " and lexicon(words[before][2])[0]:
                at, n = words[before][0], n + 1
                before -= 1
            else:
                break
        if n:
            found = Found(at, words[last][1], "person_name")
        elif m := _GIVEN_AFTER.match(text, words[last][1]):
            if m["word"] is None or lexicon(m["word"].lower())[0]:
                found = Found(begin, m.end(), "person_name")
        if found and not any(a < found.end and found.start < b for a, b in busy):
            got.append(found)
            busy.append((found.start, found.end))
            while last + 1 < len(words) and words[last + 1][0] < found.end:
                last += 1
        k = last + 1
    return got


def find(text: str, lexicon: Callable[[str], tuple[bool, bool]]) -> list[Found]:
    """All finds of a text in order."""
    families, places = literals(text)
    entities = structured(text, families)
    held = []
    for lo, m in slots(text, entities, places):
        a, b = _parts(m)
        held.append(_slot(lo, m, a, b))
    return with_names(text, entities, held, lexicon)


def with_names(text: str, entities: list[Found], held: list[dict], lexicon: Callable[[str], tuple[bool, bool]]) -> list[Found]:
    """The entities of a text and its names, in order. A name in a slot counts if its given name is known or an initial: its surname may be the first of its kind."""
    got = [*entities, *names(text, entities, lexicon)]
    for slot in held:
        if slot["last"] and (slot["initial"] or any(lexicon(w)[0] for w in slot["given"])) and all(slot["end"] <= f.start or f.end <= slot["start"] for f in got):
            got.append(Found(slot["start"], slot["end"], "person_name"))
    return sorted(got, key=lambda f: f.start)


def sanitised(text: str, found: list[Found]) -> str:
    out, at = [], 0
    for f in found:
        out += [text[at : f.start], PLACEHOLDERS[f.kind]]
        at = f.end
    return "".join([*out, text[at:]])


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start_at", pa.int32()), ("end_at", pa.int32())]))


def _detect(shared, bits: int) -> Callable:
    types = {"id": pa.int64(), "text": pa.string(), "found": _FOUND}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value["given"], shared.value["surname"], bits)
        rows: list[tuple] = []
        for key, text, entities, held in arrow_rows(batches, "id", "text", "entities", "slots"):
            got = with_names(text, [Found(e["start"], e["end"], e["kind"]) for e in entities], held, lexicon)
            rows.append((key, sanitised(text, got), [{"kind": f.kind, "start_at": f.start, "end_at": f.end} for f in got]))
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))

    return run


def personal_information(documents: DataFrame, id_col: str, text_col: str, how: Disclosure = Disclosure()) -> DataFrame:
    """(id, text, found): each text with placeholders for the personal information in it, and where that stood in the original.

    The texts are read once by the patterns: what they find is written to the shared folder beside the text, where the second step, which needs the words' statistics, reads
    it. Words are counted by their hashes. ``found`` holds kind, start_at and end_at in code points (half-open), in order and without overlaps. Null texts give no row, empty texts one
    without finds. Repeated rows give a row each; other columns are ignored. Texts are processed whole. The words' statistics cover all
    documents; executors get two bitmaps of fixed size.
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null"))
    first = written(docs.mapInArrow(_first, _FIRST), "pii-first")
    counts, words = disclosures(first)
    arrays = {name: np.zeros(1 << (how.seen_bits - 3), np.uint8) for name in ("given", "surname")}
    # A part of a name mostly fills its slot with a capital, and a word counts as the part it more often is.
    names_only = words.where("2 * capital >= given + surname")
    other = {"given": F.col("given") > F.col("surname"), "surname": F.col("surname") >= F.col("given")}
    revealing = [names_only.where((F.col(f"{name}_bits") >= how.bits) & other[name]).select("h").mapInArrow(_word_bitmap(name, how.seen_bits), BLOB) for name in arrays]
    shared = spark.sparkContext.broadcast(collected(revealing[0].unionAll(revealing[1]), arrays))
    discard(counts)
    kept = first.where("h is null").select("id", "text", "entities", "slots")
    return kept.mapInArrow(_detect(shared, how.seen_bits), "id long, text string, found array<struct<kind:string,start_at:int,end_at:int>>")
