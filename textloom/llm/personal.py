"""Personal information inside free text: places by type, and texts with typed placeholders.

Method: information-theoretic sanitisation. Structured values (email addresses, phone and identity numbers, street
addresses) are found by their form. For names the corpus decides: every term's co-occurrence with protected slots
(behind "my name is" and its like, or a title) is set against all its occurrences; its disclosure is
log2(P(slot | term) / P(slot)). Every term of every text, wherever it stands and however it is written, is a candidate:
a name is a chain of terms that disclose enough, with the initials, particles and rare terms in it. Terms too seldom
for a count of their own are judged by their last letters. Terms that reveal little, such as function words, are kept.
Slots are seeds of the counts and lower what a single term needs; they are no names by themselves. All occurrences in
all texts are counted. Found values are generalised to a placeholder of their type.

Rules run on the consistent form of a text (see ``canonical``) and places refer to the original. Token rows are matched
by their offsets, counted without plain spaces and line feeds, which no token holds.

Texts themselves are not shuffled: what is shuffled are candidates and partial counts of terms. A name may have any
number of terms. In scripts without spaces names are found in slots only.

Defined results: null and blank texts hold nothing; values of deliveries made twice are one (in the counts of terms
they weigh twice, on either side of the share); token rows without a letter or
digit are no cases; null words take no room; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.canonical import canonical, canonical_with_places
from textloom.operators.orphans import bloom_filter, filter_spots
from textloom.session import dimension_join, ensure_checkpoint_dir

TYPES = ("email", "phone", "id_number", "address", "name")

_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+\-@])[A-Za-z0-9][A-Za-z0-9._%+\-]*(?:[ \n]?@[ \n]?|[ \n]?[(\[]{1}[ ]?at[ ]?[)\]]{1}[ \n]?)[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:[ ]?(?:\.|[(\[][ ]?dot[ ]?[)\]])[ ]?[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?|[ ]dot[ ][A-Za-z0-9\-]+)*(?:\.|[ ]?[(\[][ ]?dot[ ]?[)\]][ ]?|[ ]dot[ ])[A-Za-z]{2,}(?![A-Za-z0-9@])"
    r"|(?<![A-Za-z0-9._%+\-@])[A-Za-z0-9][A-Za-z0-9._%+\-]*[ ]at[ ][A-Za-z0-9\-]+(?:[ ]dot[ ][A-Za-z0-9\-]+)*[ ]dot[ ][A-Za-z]{2,}(?![A-Za-z0-9@])",
    re.I,
)
_DIGIT_WORD = r"(?:oh|o|zero|nought|one|two|three|four|five|six|seven|eight|nine)"
_DIGIT_WORDS = set("oh o zero nought one two three four five six seven eight nine double double-oh triple".split())
_DIGIT = re.compile(r"\d")
_SPOKEN = re.compile(rf"\b(?:(?:double|triple)[ \-])?{_DIGIT_WORD}(?:[ ,\-\n]+(?:(?:double|triple)[ \-\n])?{_DIGIT_WORD}){{5,}}\b", re.I)
_IDS = re.compile(
    r"(?<![\w/#\-.])(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b"  # national insurance
    r"|[A-Z]{2}\d{7}"  # passport
    r"|\d{2} \d{3} \d{3} \d{3}"  # German tax number
    r"|[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|[12]\d{12}(?:\d{2})?"  # French social security
    r"|\d{8}-?[A-Z]|\d{2}\.\d{3}\.\d{3}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"  # Spanish identity numbers
    r")(?![\w/]|[.\-]\d)",
    re.I,
)
_ID_CUE = re.compile(r"(?i)\b(?:insurance|social security|security|identity|identification|tax|passport|id|ssn|nino|steuer-?id|steuernummer|ausweis\w*|reisepass\w*|sécurité sociale|passeport|carte d'identité|dni|nie|nif|pasaporte|паспорт\w*|инн|снилс|αφμ|αδτ)\b[\w'\s.\-:]{0,22}?(?:\s|№|#|:)*$")
_PHONE_CUE = re.compile(r"(?i)(?:\b(?:phone|call|ring|tel|mobile|fax|number|appelez|téléphone|unter|telefon|anrufen|teléfono|móvil|llam\w*|телефон|τηλ\w*)\b|هاتف\w*|فोन|फोन|電話\w*|电话|號碼|เบอร์\w*)[^.!?\d]{0,26}$")
_NUMBER = re.compile(r"(?<![\w#/])(?:\+|\()?\d(?:[\d()]|[ .\-/\n](?=[\d(]))*\d(?![\w/]|[.,]\d)|(?<=[^\W\d_a-zA-Z])\+?\d(?:[\d()]|[ .\-/](?=[\d(]))*\d(?![\d/])")
_PHONE_FORMS = re.compile(
    r"\+\d[\d ().\-/]{7,18}\d|00\d{2}[ .\-]?[\d ().\-/]{6,16}\d|\(0?\d{2,4}\) ?\d{3,5}[ \-]?\d{2,4}(?:[ \-]?\d{2,4})?"
    r"|0\d{9,11}|0\d{2,4}[ \-/]\d{3,5}[ \-]?\d{3,4}|0\d{4}-\d{3}-\d{3}|0\d{2} \d{4} \d{4}|0\d{2,4}/\d{5,9}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}"
    r"|0\d(?:[ .\-]?\d\d){4}|[6-9]\d{8}|[6-9]\d\d(?: \d\d){3}|[6-9]\d\d \d{3} \d{3}|[6-9]\d\d-\d\d-\d{4}|\d{4}-\d{4}-\d{3}|\d{3}-\d{4}-\d{4}|\d{3}-\d{3}-\d{3}"
)
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}")

_UP = r"[A-ZÀ-ÖØ-ÞŒŠŽ]"
_TOWN_EN = rf"{_UP}[^\W\d_]+(?:['’\-][^\W\d_]+)*(?: {_UP}[^\W\d_]+\b){{0,2}}"
_ROAD_EN = r"(?:Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Close|Cl|Crescent|Cres|Court|Ct|Drive|Dr|Terrace|Place|Pl|Square|Sq|Way|Walk|Gardens|Grove|Row|Hill|Rise|Mews|Parade|Boulevard|Blvd|Highway|Green|Park|Quay|Wharf)"
_ADDRESS = [
    re.compile(
        rf"(?<![\w/#.,\-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Floor) \d+[A-Za-z]?,? )?\d+[A-Za-z]?,? (?:(?:St\.|{_UP}[\w'’\-]*) ){{1,3}}{_ROAD_EN}\b\.?(?:,? (?:Apt\.?|Flat|Unit|Suite) \d+[A-Za-z]?)?"
        rf"(?:,? {_TOWN_EN}(?:,? [A-Z]{{1,2}}\d{{1,2}}[A-Z]? ?\d[A-Z]{{2}}|,? [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?)?)?"
    ),
    re.compile(
        rf"(?<![\w/#\-])(?:(?:Am|An der|An den|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Unter den|Hinter der|Alte|Alter|Neue|Großer|Kleine) )?(?:{_UP}[\wßäöü\-]*\.? ){{1,3}}\d+ ?[a-z]?(?:,| in)? \d{{5}} {_UP}[\wßäöü\-]*(?:[ ](?:am|an der|im|bei|ob der|vor der) {_UP}[\wßäöü\-]*|[ ]{_UP}[\wßäöü\-]*)?"
    ),
    re.compile(
        rf"(?<![\w/#.,\-])\d+(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd\.?|chemin|ch\.|impasse|imp\.|place|pl\.|allée|all\.|quai|route|rte|square|sq\.|cours|passage|sentier|voie|ruelle|faubourg)[\w'’ .\-À-ÿ]*?,? \d{{5}} (?:(?:Les|Le|La|L['’]|Saint|Sainte|Bourg) ?)?{_UP}?[\w'’\-]+",
        re.I,
    ),
    re.compile(
        rf"(?<![\w#])(?:C/|Calle|Avda\.?|Avenida|Plaza|Pza\.?|Pl\.|Travesía|Trav\.|Paseo|P\.º|Camino|Ronda|Carretera|Ctra\.|Callejón|Glorieta|Vía)[ ]?(?:(?:de|del|la|las|los|el|Sta\.|Sto\.|San|Santa|{_UP}[\w'’.\-]*) ?){{1,6}}?,? \d+[A-Za-z]?(?:, ?\d+\.?[ºª]? ?[A-Z]\b)?(?:,? \d{{5}})?,? (?:(?:Las|Los|La|El) )?{_UP}[\w'’\-]*(?: (?:de la|de los|de las|del|de) {_UP}[\w'’\-]*| {_UP}[\w'’\-]*)?"
    ),
]

# Names. A protected slot is where somebody says who somebody is: behind a cue or a title. What stands there is counted.
_CUES = re.compile(
    r"(?:\b(?:my[ \n]name[ \n]is|my[ \n]name['’]s|i[ \n]am[ \n]called|call[ \n]me|i[ \n](?:spoke|talked)[ \n](?:to|with)|i[ \n](?:met|wrote[ \n]to)|ask[ \n]for|on[ \n]behalf[ \n]of"
    r"|(?:contact|attn|attention|signed|name):"
    r"|ich[ \n]heiße|mein[ \n]name[ \n]ist|ich[ \n]bin|(?:ich[ \n]habe|ich[ \n]sprach|wir[ \n]haben)[ \n]mit|im[ \n]namen[ \n]von"
    r"|je[ \n]m['’]appelle|mon[ \n]nom[ \n]est|j['’]ai[ \n](?:parlé[ \n](?:à|avec)|vu|écrit[ \n]à)|demandez|de[ \n]la[ \n]part[ \n]de"
    r"|me[ \n]llamo|mi[ \n]nombre[ \n]es|hablé[ \n]con|escribí[ \n]a|pregunté[ \n]por|en[ \n]nombre[ \n]de"
    r"|меня[ \n]зовут|мо[её][ \n]имя|με[ \n]λένε|ονομάζομαι|το[ \n]όνομά[ \n]μου[ \n]είναι)|(?<!\w)(?:أنا[ \n])?اسمي|मेरा[ \n]नाम)[ \n]",
    re.I,
)
#: Every cue and every title has one of these terms.
_CUE_WORDS = set("name called call spoke talked met wrote ask behalf contact attn attention signed heiße bin mit namen m'appelle m’appelle nom parlé vu écrit demandez part llamo nombre hablé escribí pregunté зовут имя λένε ονομάζομαι όνομά اسمي नाम".split())
_TITLE_WORDS = set("mr mrs ms miss mx dr prof professor sir madam herr herrn frau sr sra srta sres dña dra señor señora mme mlle monsieur madame mademoiselle m г-н г-жа господин госпожа κ κα δρ الدكتور السيد السيدة د أ डॉ श्री श्रीमती सुश्री".split())
_TITLE = re.compile(r"(?<![\w.])(?:(?i:mr|mrs|ms|miss|mx|dr|prof|professor|sir|madam|herrn?|frau|sr|sra|srta|sres|dña|dra|señora?|mme|mlle|monsieur|madame|mademoiselle)\.?|M\.|Г-н|г-н|Г-жа|г-жа|господин|госпожа|κ\.|κα\.?|κ\.κ\.|Δρ\.?|الدكتور|السيد|السيدة|د\.|أ\.|डॉ\.?|श्री|श्रीमती|सुश्री)[ \n](?=[^\W\d_])")
#: In scripts without spaces the slot has an end as well.
_WHOLE = [re.compile(r"(?:私は|私の名前は|名前は)([一-鿿々ぁ-ヺー]{2,}?)(?=です|と申します|といいます)"), re.compile(r"(?:我叫|我是|我的名字是|我的名字叫)([一-鿿]{2,4}?)(?=[。，！？、\n]|$)")]
#: A term: Devanagari and Arabic words with their marks, or letters with apostrophes and hyphens.
_TERM = re.compile(r"[ऀ-ॣॱ-ॿ]+|[ؠ-ٟٱ-ۓە-ۜ۟-۪ۨ-ۯۺ-ۿ]+|[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_UNCASED = re.compile(r"[ऀ-ॿ؀-ۿ]")
#: Letters of an ending.
ENDING = 4
#: Words between the terms of a name.
PARTICLES = set("de del della di da dos das do du des la las los le van von der den zu zum zur al el bin ibn abu bint ben ter ten af av".split())
#: Words that end what stands in a slot of a script without capitals.
VERBS = set("है हैं हूँ था थी थे ने को से من في إن كان على إلى".split())
_SIGNED = re.compile(r"(?<![^\W\d_])[^\W\d_]\.[ \n]?[^\W\d_]{2}")
_ELIDED = re.compile(r"[dlo]['’][A-ZÀ-ÖØ-Þ]")
_POSSESSIVE = re.compile(r"['’]s$")
_FIRM = re.compile(r"[ \n]?(?:&|(?:and|et|y|und) (?:Co|Sons)|Ltd|Inc|Co\b|GmbH|S\.A|AG\b|SARL|PLC|LLC|Road|Street|St\b|Ave|Lane|Close|Court|Crescent|Hill|Council|Office|School|Station|Party)")


class Term(NamedTuple):
    """A word of a text: its place, its form in lower case, and what can be seen of it."""

    start: int
    end: int
    low: str
    capital: bool
    initial: bool
    link: str  # what stands before it: a space, a comma, or another gap
    particle: bool
    slot: bool


def _lows(form: str) -> Iterator[str]:
    """All terms in lower case, without a possessive."""
    return (t[:-2] if t[-2:] in ("'s", "’s") else t for t in _TERM.findall(form.lower()))


def _terms(form: str, starts: set[int]) -> list[Term]:
    """All terms of a text in order, some at the starts of slots; a comma or one space between two of them is a link."""
    out: list[Term] = []
    before = 0
    for m in _TERM.finditer(form):
        a, b = m.span()
        if p := _POSSESSIVE.search(m[0]):
            b = a + p.start()
        raw = form[a:b]
        gap = form[before:a]
        dotted = form[b : b + 1] == "."
        initial = len(raw) == 1 and dotted and not form[max(0, a - 2) : a - 1].isdigit()  # a letter behind digits is a number's
        link = " " if gap in (" ", "\n") else "," if gap in (", ", ",\n") else "."
        if out and link == "." and out[-1].initial and gap in (". ", ".\n", "."):
            link = " "
        capital = raw[0].isupper() or bool(_UNCASED.match(raw)) or bool(_ELIDED.match(raw))
        low = raw.lower()
        out.append(Term(a, b + initial, low, capital, initial, link, low in PARTICLES and not capital, a in starts))
        before = m.end()
    return out


def _slots(form: str) -> set[int]:
    """Where names are to be expected: behind cues and titles."""
    at = {m.end() for m in _CUES.finditer(form)}
    for m in _TITLE.finditer(form):
        if m[0][:2] == "M." and m.start() in at:
            continue  # behind a cue or a title it is an initial
        at.discard(m.start())
        at.add(m.end())
    return at


def _capital_behind(terms: list[Term], k: int) -> bool:
    """Whether the particles from k on lead to a capital."""
    while k < len(terms) and terms[k].particle and terms[k].link == " ":
        k += 1
    return k < len(terms) and terms[k].capital and terms[k].link == " "


def _in_slots(terms: list[Term]) -> Iterator[Term]:
    """The terms that stand in a slot: the first, and all that go on with it and are written like it."""
    inside = False
    for k, t in enumerate(terms):
        if t.slot:
            inside = t.capital or t.initial
        elif inside:
            inside = t.low not in VERBS and t.link in " ," and (t.capital or t.initial or (t.particle and _capital_behind(terms, k))) and not (t.link == "," and not terms[k - 1].slot)
        if inside and not t.initial and not t.particle:
            yield t


def structured(form: str, words: set[str] | None = None) -> list[tuple[int, int, str]]:
    """Places of values that are known by their form; words: the text's terms, where they are at hand."""
    out: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in out)

    if "@" in form or "at)" in form or "at]" in form or "at )" in form or "at ]" in form or " dot " in form or "AT" in form:
        out += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(form)]
    if _DIGIT.search(form):
        for pattern in _ADDRESS:
            for m in pattern.finditer(form):
                if free(*m.span()):
                    out.append((*m.span(), "address"))
        for m in _IDS.finditer(form):
            t = m[0]
            lone = re.fullmatch(r"[\d ]+", t)
            if lone and _PHONE_CUE.search(form[max(0, m.start() - 40) : m.start()]) and not _ID_CUE.search(form[max(0, m.start() - 40) : m.start()]):
                continue
            if free(*m.span()):
                out.append((*m.span(), "id_number"))
        for m in _NUMBER.finditer(form):
            a, b = m.span()
            t = m[0]
            if t.startswith("(") and ")" not in t:
                a, t = a + 1, t[1:]
            digits = sum(c.isdigit() for c in t)
            if not free(a, b) or digits < 6 or digits > 16:
                continue
            before = form[max(0, a - 44) : a]
            if _ID_CUE.search(before):
                out.append((a, b, "id_number"))
            elif _DATE.fullmatch(t):
                continue
            elif _PHONE_FORMS.fullmatch(t.replace("\n", " ")) or (digits >= 7 and _PHONE_CUE.search(before) and not re.fullmatch(r"\d{4}-\d{5}-\d|\d+[.,]\d+", t)):
                out.append((a, b, "phone"))
    if words is None or words & _DIGIT_WORDS or ("-" in form and _DIGIT_WORDS & {p for w in words if "-" in w for p in w.split("-")}):
        out += [(*m.span(), "phone") for m in _SPOKEN.finditer(form) if free(*m.span())]
    return out


_FIELDS = {"start": pa.int32(), "end": pa.int32(), "packed_start": pa.int32(), "packed_end": pa.int32(), "pii_type": pa.string(), "term": pa.string(), "inside": pa.int64(), "total": pa.int64()}
_SCHEMA = "start int, end int, packed_start int, packed_end int, pii_type string, term string, inside long, total long"


def _packed(text: str) -> list[int]:
    """For every place the number of characters before it that are no plain space or line feed."""
    out = [0]
    for c in text:
        out.append(out[-1] + (c not in " \n"))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In one reading of the texts the values known by their form, and partial counts of terms, in slots and anywhere.

    Rows of counts have a term and no input; they are given out when many terms are held, and at the end.
    """
    inside: Counter = Counter()
    total: Counter = Counter()
    id_type = None

    def counts() -> pa.RecordBatch:
        keys = list(total)
        cols = [pa.nulls(len(keys), t) for t in [*_FIELDS.values()][:5]]
        out = pa.RecordBatch.from_arrays([pa.nulls(len(keys), id_type), *cols, pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())], names=["input_id", *_FIELDS])
        inside.clear()
        total.clear()
        return out

    for b in batches:
        id_type = b.column(0).type
        rows: list[tuple] = []
        at: list[int] = []
        for k, text in enumerate(b.column(1).to_pylist()):
            if not text or not text.strip():
                continue
            form, start, end = canonical_with_places(text)
            lows = list(_lows(form))
            total.update(lows)
            words = set(lows)
            if not (words.isdisjoint(_CUE_WORDS) and words.isdisjoint(_TITLE_WORDS)) and (slots := _slots(form)):
                inside.update(t.low for t in _in_slots(_terms(form, slots)))
            for pattern in _WHOLE:
                for m in pattern.finditer(form):
                    total[m[1]] += 1
                    inside[m[1]] += 1
            if fixed := structured(form, words):
                packed = _packed(text)
                for a, e, kind in fixed:
                    at.append(k)
                    s, e = start[a], end[e - 1]
                    rows.append((s, e, packed[s], packed[e], kind, None, None, None))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, _FIELDS.values(), strict=True))], names=["input_id", *_FIELDS])
        if len(total) > 50_000:
            yield counts()
    if id_type is not None:
        yield counts()


def disclosures(counts: DataFrame) -> DataFrame:
    """``term, inside, total, bits, share`` of every term and ending (behind a tilde): its disclosure and P(slot | term).

    counts: ``term, inside, total``. Terms too seldom for a count of their own are judged by their last letters.
    """
    own = counts.groupBy("term").agg(F.sum("inside").alias("inside"), F.sum("total").alias("total"))
    endings = own.groupBy(F.concat(F.lit("~"), F.substring("term", -ENDING, ENDING)).alias("term")).agg(F.sum("inside").alias("inside"), F.sum("total").alias("total"))
    all_ = own.agg((F.sum("inside") / F.sum("total")).alias("p")).scalar()
    counts = own.unionByName(endings)
    share = F.col("inside") / F.greatest("total", "inside")
    return counts.select("term", "inside", "total", F.when(F.col("inside") > 0, F.log2(share / all_)).alias("bits"), share.alias("share"))


def runs(terms: list[Term], discloses) -> list[list[Term]]:
    """Stretches of terms that may hold a name: around each term that discloses, in each slot, and behind an initial.

    A stretch reaches as far as terms are linked and are capitalised, initials, particles or disclosing; in lower case
    it takes in the next term on either side as well, which may be the rest of a name. The corpus decides later.
    """
    out: list[list[Term]] = []
    n, k = len(terms), 0
    while k < n:
        t = terms[k]
        signed = t.initial and t.capital and k + 1 < n and terms[k + 1].link == " " and terms[k + 1].capital and not terms[k + 1].initial
        if not (t.slot or signed or (not t.particle and discloses(t.low))):
            k += 1
            continue
        a = b = k

        def goes(x: Term) -> bool:
            return x.capital or x.initial or x.low in PARTICLES or discloses(x.low)

        floor = out[-1][-1].end if out else -1
        while a and not terms[a].slot and terms[a].link in " ," and terms[a - 1].start >= floor and goes(terms[a - 1]):
            a -= 1
        while b + 1 < n and terms[b + 1].link in " ," and (not terms[b + 1].slot or (terms[b].initial and b > a)) and (goes(terms[b + 1]) or (terms[b + 1].link == " " and not terms[b].capital and not terms[b].particle and (b == k or goes(terms[b])))):
            b += 1
        if not terms[a].capital and a and not terms[a].slot and terms[a].link == " " and terms[a - 1].start >= floor:
            a -= 1
        out.append(terms[a : b + 1])
        k = b + 1
    return out


def _runs(shared, bits: int, hashes: int):
    """Reads the texts once more for runs around terms of the filter; a row per term of a run, with a number for the run."""
    names = ["input_id", "run", "i", "start", "end", "packed_start", "packed_end", "term", "ending", "capital", "initial", "particle", "comma", "slot", "firm"]
    types = [pa.int64()] + [pa.int32()] * 5 + [pa.string()] * 2 + [pa.bool_()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}

        def ask(lows: set[str]) -> None:
            """Asks the filter for the terms that were not asked for before, all at once."""
            if len(known) > 200_000:
                known.clear()
            new = [w for w in lows if w not in known]
            if new:
                keys = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in new], np.uint64).view(np.int64)
                spots = filter_spots(keys, bits, hashes)
                hits = ((shared.value[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
                known.update(zip(new, hits.tolist(), strict=True))

        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []
            forms = [canonical(t) if t and t.strip() else "" for t in b.column(1).to_pylist()]
            lows = [set(_lows(f)) for f in forms]
            ask(set().union(*lows) if lows else set())
            discloses = lambda low: known.get(low, False)
            for k, text in enumerate(b.column(1).to_pylist()):
                form = forms[k]
                if not form or not (_SIGNED.search(form) or any(map(known.get, lows[k])) or any(p.search(form) for p in _WHOLE)):
                    continue
                form, start, end = canonical_with_places(text)
                packed = None
                number = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 2  # two texts of one input have runs of their own
                for own in runs(_terms(form, _slots(form)), discloses):
                    packed = packed or _packed(text)
                    for i, t in enumerate(own):
                        s, e = start[t.start], end[t.end - 1]
                        at.append(k)
                        rows.append((number, i, s, e, packed[s], packed[e], t.low, "~" + t.low[-ENDING:], t.capital, t.initial, t.particle, t.link == ",", t.slot, bool(_FIRM.match(form, t.end))))
                    number += 1
                for pattern in _WHOLE:
                    for m in pattern.finditer(form):
                        packed = packed or _packed(text)
                        s, e = start[m.start(1)], end[m.end(1) - 1]
                        at.append(k)
                        rows.append((number, 0, s, e, packed[s], packed[e], m[1], "~", True, False, False, False, True, False))
                        number += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return run


_RUNS = "run long, i int, start int, end int, packed_start int, packed_end int, term string, ending string, capital boolean, initial boolean, particle boolean, comma boolean, slot boolean, firm boolean"


def names(run: list[dict], min_bits: float, min_share: float, run_share: float, rare: int) -> list[tuple[int, int, bool]]:
    """The names in a run of terms with their counts: first and last term, and whether they stand in a slot.

    A term discloses if its share, or that of its ending where it occurs ``rare`` times at most, is high enough. A name
    is a chain of disclosing terms, initials and particles with at least one that discloses; a rare term next to one
    that does, which nothing speaks against, is part of it where its script has capitals. Outside of slots a single term needs ``run_share``.
    """

    def share(t: dict) -> float:
        own = t["share"] or 0.0
        if (t["total"] or 0) <= rare and t["capital"] and (t["ending_bits"] or -9.0) >= min_bits:
            own = max(own, t["ending_share"] or 0.0)
        return own

    n = len(run)
    strong = [not t["initial"] and not t["particle"] and share(t) >= min_share and max(t["bits"] or -9.0, t["ending_bits"] or -9.0 if (t["total"] or 0) <= rare else -9.0) >= min_bits for t in run]
    seldom = [not t["initial"] and not t["particle"] and not s and (t["total"] or 0) <= rare and not _UNCASED.match(t["term"]) for t, s in zip(run, strong, strict=True)]
    out: list[tuple[int, int, bool]] = []
    k = 0
    while k < n:
        if not (strong[k] or run[k]["initial"] or (seldom[k] and run[k]["capital"])):
            k += 1
            continue
        b = k
        while b + 1 < n:
            t = run[b + 1]
            if run[b]["firm"] or (t["slot"] and not (run[b]["initial"] and b > k)):
                break  # behind an initial within a name a slot is no title's
            if t["comma"]:
                # "Surname, Given": one term before the comma, and a disclosing one or an initial behind it
                if b != k or not (strong[b + 1] or t["initial"]) or not (strong[k] or seldom[k]):
                    break
            elif not (strong[b + 1] or t["initial"] or t["particle"] or seldom[b + 1]):
                break
            b += 1
        last = b
        while last > k and run[last]["particle"]:
            last -= 1
        some = [x for x in range(k, last + 1) if strong[x]]
        slot = run[k]["slot"]
        if some:
            terms = [x for x in range(k, last + 1) if not run[x]["particle"]]
            if slot or ((len(terms) > 1 or share(run[some[0]]) >= run_share) and not run[last]["firm"]):
                out.append((k, last, slot))
        k = b + 1
    return out


def find_personal(texts: DataFrame, min_bits: float = 2.0, min_share: float = 0.15, run_share: float = 0.6, rare: int = 2, false_positives: float = 0.01) -> DataFrame:
    """Values in texts: ``input_id, start, end, packed_start, packed_end, pii_type``; texts has ``input_id, text``.

    A term discloses at ``min_bits`` and ``min_share``; see ``names`` for the rest. The packed places count characters
    without plain spaces and line feeds. Texts are read twice: for values and counts, and, with a Bloom filter of the
    disclosing terms, sized by their number, for runs around them; what the filter lets pass is judged by an exact join.
    """
    spark = texts.sparkSession
    texts = texts.select("input_id", "text").where("text is not null")
    ensure_checkpoint_dir(spark)
    id_type = texts.schema["input_id"].dataType.simpleString()
    scan = texts.mapInArrow(_scan, f"input_id {id_type}, {_SCHEMA}").checkpoint()
    place = ["input_id", "start", "end", "packed_start", "packed_end"]
    fixed = scan.where("term is null").select(*place, "pii_type").distinct()
    known = disclosures(scan.where("term is not null").select("term", "inside", "total")).checkpoint()
    strong = known.where(F.col("bits").isNotNull() & (F.col("bits") >= min_bits) & (F.col("share") >= min_share) & ~F.startswith("term", F.lit("~")))
    filled, hashes = bloom_filter(strong.select(F.xxhash64("term").alias("key")), "key", false_positives=false_positives)
    shared = spark.sparkContext.broadcast(filled)
    found = texts.mapInArrow(_runs(shared, len(filled) * 8, hashes), f"input_id {id_type}, {_RUNS}").distinct()
    own = known.select(F.col("term").alias("_t"), "total", "bits", "share")
    ends = known.where(F.startswith("term", F.lit("~"))).select(F.col("term").alias("_e"), F.col("bits").alias("ending_bits"), F.col("share").alias("ending_share"))
    counted = dimension_join(dimension_join(found, own, F.col("term") == F.col("_t")), ends, F.col("ending") == F.col("_e"))
    fields = ["i", "term", "start", "end", "packed_start", "packed_end", "capital", "initial", "particle", "comma", "slot", "firm", "total", "bits", "share", "ending_bits", "ending_share"]
    gathered = counted.groupBy("input_id", "run").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("terms"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, run in enumerate(b.column(1).to_pylist()):
                for x, y, _ in names(run, min_bits, min_share, run_share, rare):
                    at.append(k)
                    rows.append((run[x]["start"], run[y]["end"], run[x]["packed_start"], run[y]["packed_end"]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int32()) for c in cols)], names=place)

    called = gathered.select("input_id", "terms").mapInArrow(judge, f"input_id {id_type}, start int, end int, packed_start int, packed_end int").distinct()
    taken = fixed.groupBy("input_id").agg(F.collect_list(F.struct("start", "end")).alias("_taken"))
    free = called.join(taken, "input_id", "left").where(~F.coalesce(F.exists("_taken", lambda v: (F.col("start") < v["end"]) & (F.col("end") > v["start"])), F.lit(False)))
    return fixed.unionByName(free.select(*place, F.lit("name").alias("pii_type")))


def token_hits(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """``input_id, seq, pii_type`` of the token rows (``input_id, seq, word``) that lie wholly or partly in a value."""
    own = tokens.select("input_id", "seq", "word").repartition("input_id").dropDuplicates(["input_id", "seq"])
    ends = F.sum(F.coalesce(F.length("word"), F.lit(0))).over(_by_input())
    placed = own.withColumn("_b", ends).withColumn("_a", F.col("_b") - F.coalesce(F.length("word"), F.lit(0))).where(F.col("word").rlike(r"[\p{L}\p{N}]"))
    spans = values.select(F.col("input_id").alias("_id"), "packed_start", "packed_end", "pii_type")
    return placed.join(spans, (F.col("input_id") == F.col("_id")) & (F.col("_a") < F.col("packed_end")) & (F.col("_b") > F.col("packed_start"))).select("input_id", "seq", "pii_type").distinct()


def _by_input():
    from pyspark.sql import Window

    return Window.partitionBy("input_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def mask(texts: DataFrame, values: DataFrame) -> DataFrame:
    """``input_id, text, masked`` with ``[EMAIL]``, ``[PHONE]`` and so on in place of the values."""
    spans = values.groupBy("input_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "pii_type"))).alias("_spans"))
    joined = texts.select("input_id", "text").where("text is not null").distinct().join(spans, "input_id", "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate(
        "_spans",
        zero,
        lambda s, v: F.when(v["start"] < s["at"], s).otherwise(F.struct(v["end"].alias("at"), F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, v["start"] - s["at"]), F.lit("["), F.upper(v["pii_type"]), F.lit("]")).alias("out"))),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    return joined.select("input_id", "text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(folded).alias("masked"))
