"""One consistent form for text that looks the same but is made of different characters.

Method: compatibility characters, invisible characters and odd spaces are brought to their plain form; then the
dominant script of every word is determined, and look-alike letters of other scripts are substituted in mixed-script
words only. Where a mixed word could be read in two scripts, the corpus vocabulary decides, then the text's main script.

A mixed word whose plain form is missing from the vocabulary is repaired all the same: the required result holds every
letter of another script inside a word to be a fault, and names and invented words are in no vocabulary.

Defined results: null stays null, empty text stays empty, repeated rows are kept, further columns are passed through
(an input column that has an output column's name is replaced). Quotes, dashes, letter case, full-width punctuation in texts with Chinese or Japanese
letters, words wholly in one script, joiners inside emoji and Thai sara am are left alone.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import dimension_join, ensure_checkpoint_dir

#: Letters that look alike, Latin to Cyrillic and Latin to Greek.
_CYRILLIC = dict(zip("aceopxyisjhkdqwABCEHIJKMOPSTXY", "асеорхуіѕјһкԁԛԝАВСЕНІЈКМОРЅТХУ", strict=True))
_GREEK = dict(zip("aeiknopuvxyABEZHIKMNOPTYX", "αεικηορυνχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", strict=True))
#: More letters of either script that pass for a Latin one.
_TO_LATIN_MORE = {"ӏ": "l", "Ӏ": "I", "ѵ": "v", "г": "r", "т": "t", "м": "m", "в": "b", "н": "h", "п": "n", "ϲ": "c", "ϳ": "j", "τ": "t", "ω": "w", "Ү": "Y", "ү": "y", "Ԛ": "Q", "Ԝ": "W", "ѡ": "w", "ɑ": "a", "ı": "i", "ɡ": "g"}

_TO = {
    "L": {c: p for m in (_CYRILLIC, _GREEK) for p, c in m.items()} | _TO_LATIN_MORE,
    "C": dict(_CYRILLIC) | {_GREEK[k]: v for k, v in _CYRILLIC.items() if k in _GREEK},
    "G": dict(_GREEK) | {_CYRILLIC[k]: v for k, v in _GREEK.items() if k in _CYRILLIC},
}
_WORD = re.compile(r"[A-Za-zªºÀ-ʯͰ-ԯḀ-῿̀-ͯ]+")
_SPACES = {i: " " for i in range(0x80, sys.maxunicode) if unicodedata.category(chr(i)) == "Zs"} | {9: " ", 11: " ", 12: " ", 0x85: "\n", 0x2028: "\n", 0x2029: "\n"}
_VISIBLE_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_JOINERS = {0x200D, 0xFE0E, 0xFE0F, *range(0xE0020, 0xE0080)}
_GONE = {
    i: None
    for i in (*(i for i in range(0x80, sys.maxunicode) if unicodedata.category(chr(i)) == "Cf"), 0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0, 9), *range(14, 32), 127)
    if i not in _VISIBLE_FORMATS and i not in _JOINERS
}
_PLAIN = _SPACES | _GONE
_JOINER = re.compile("[‍︎️\U000e0020-\U000e007f]")
_CJK = re.compile(r"[ぁ-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]")
_NATIVE = re.compile("([！（），．：；？～［］｛｝ำ‑﹘])")
_OTHERS = re.compile("([ำ‑﹘])")
#: Texts of these characters only are in the consistent form already.
_QUICK = re.compile("[\\n\\r -~¡-§«¬°±¶·»¿-ı–—‘-„]*")


#: Characters that may change, with the plain one before them, which a mark may belong to.
_SPECIAL = re.compile(r"[\n\r -~]?[^\n\r -~]+")
_PLACES = list(range(4097))
_LATIN, _CYRILLIC_LETTERS, _GREEK_LETTERS = re.compile("[A-Za-zªºÀ-ʯḀ-ỿ]"), re.compile("[Ѐ-ԯ]"), re.compile("[Ͱ-Ͽἀ-῿]")


def _emoji(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk") or 0x1F000 <= ord(c) <= 0x1FAFF or c in "⃣#*0123456789♀♂"


def _lost_joiners(text: str) -> set[int]:
    """Places of zero-width joiners and variation selectors outside emoji; text has no other invisible characters."""
    lost: set[int] = set()
    before = ""
    for i, c in enumerate(text):
        if not _JOINER.match(c):
            before = c
            continue
        after = text[i + 1] if i + 1 < len(text) else ""
        if not before or not _emoji(before) or (c == "\u200d" and not (after and unicodedata.category(after) in ("So", "Sk"))) or (c != "\u200d" and before in "#*0123456789" and after != "\u20e3"):
            lost.add(i)
    return lost


def _drop_joiners(text: str) -> str:
    lost = _lost_joiners(text)
    return "".join(c for i, c in enumerate(text) if i not in lost) if lost else text


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    i = ord(c)
    if 0x400 <= i <= 0x52F:
        return "C"
    if 0x370 <= i <= 0x3FF or 0x1F00 <= i <= 0x1FFF:
        return "G"
    return "" if unicodedata.category(c)[0] == "M" else "L"


def readings(word: str, first: str = "") -> list[str]:
    """The single-script readings of a mixed-script word, that in its dominant script first; none for any other word.

    first: a script (L, C or G) whose reading goes before the others. If no script can take all letters, the only
    reading replaces those letters that the dominant script can take.
    """
    if bool(_LATIN.search(word)) + bool(_CYRILLIC_LETTERS.search(word)) + bool(_GREEK_LETTERS.search(word)) < 2:
        return []
    count = {"L": 0, "C": 0, "G": 0}
    for c in word:
        if s := _script(c):
            count[s] += 1
    here = [s for s in count if count[s]]
    if len(here) < 2:
        return []
    order = sorted(here, key=lambda s: (s != first, -count[s], "LCG".index(s)))
    able = [s for s in order if all(_script(c) in ("", s) or c in _TO[s] for c in word)]
    order = sorted(here, key=lambda s: (-count[s], "LCG".index(s)))
    return [unicodedata.normalize("NFC", "".join(c if _script(c) in ("", s) else _TO[s].get(c, c) for c in word)) for s in able or order[:1]]


def _main_script(text: str) -> str:
    """The script most letters of a text are in."""
    n = {"C": len(re.findall("[Ѐ-ԯ]", text)), "G": len(re.findall("[Ͱ-Ͽἀ-῿]", text)), "L": len(re.findall("[A-Za-zÀ-ʯḀ-ỿ]", text))}
    return max(("L", "C", "G"), key=lambda s: n[s])


def plain_characters(text: str) -> str:
    """Compatibility, invisible and space characters brought to their plain form; letters of other scripts stay."""
    text = text.translate(_PLAIN)
    if _JOINER.search(text):
        text = _drop_joiners(text)
    keep = _NATIVE if _CJK.search(text) else _OTHERS
    return unicodedata.normalize("NFC", "".join(p if i % 2 else unicodedata.normalize("NFKC", p) for i, p in enumerate(keep.split(text))))


def canonical(text: str | None) -> str | None:
    """The consistent form of a text, where no vocabulary is asked."""
    if text is None or _QUICK.fullmatch(text):
        return text
    text = plain_characters(text)
    if "Ͱ" <= max(text, default="") and re.search("[Ͱ-ԯἀ-῿]", text):
        main = _main_script(text)
        text = unicodedata.normalize("NFC", _WORD.sub(lambda m: (readings(m[0], main) or [m[0]])[0], text))
    return text


def canonical_with_places(text: str) -> tuple[str, list[int], list[int]]:
    """The consistent form of a text and, for each of its characters, start and end of what it stands for.

    A letter and the marks behind it are brought to their form together, and each character of it has the place of both.
    """
    form = canonical(text)
    if form == text:
        places = _PLACES[: len(text) + 1] if len(text) < len(_PLACES) else list(range(len(text) + 1))
        return text, places[:-1], places[1:]
    keep = _NATIVE if _CJK.search(text) else _OTHERS
    lost: set[int] = set()
    if _JOINER.search(text):
        kept = [(i, d) for i, c in enumerate(text) for d in c.translate(_PLAIN)]
        gone = _lost_joiners("".join(d for _, d in kept))
        lost = {i for k, (i, _) in enumerate(kept) if k in gone}
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    at = 0
    for m in _SPECIAL.finditer(text):
        a, b = m.span()
        out.extend(text[at:a])
        start.extend(range(at, a))
        end.extend(range(at + 1, a + 1))
        seen = [(a + i, d) for i, c in enumerate(m[0]) if a + i not in lost and (d := c.translate(_PLAIN))]
        k, n = 0, len(seen)
        while k < n:
            j = k + 1
            while j < n and (seen[j][1] in "ﾞﾟ" or "\u1160" <= seen[j][1] <= "\u11ff" or (unicodedata.category(seen[j][1])[0] == "M" and not _JOINER.match(seen[j][1]))):
                j += 1  # marks, and the vowels and finals of Korean syllables
            part = "".join(c for _, c in seen[k:j])
            if not keep.match(part):
                part = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", part))
            out.extend(part)
            start.extend([seen[k][0]] * len(part))
            end.extend([seen[j - 1][0] + 1] * len(part))
            k = j
        at = b
    out.extend(text[at:])
    start.extend(range(at, len(text)))
    end.extend(range(at + 1, len(text) + 1))
    joined = "".join(out)
    if re.search("[Ͱ-ԯἀ-῿]", joined):
        main = _main_script(joined)
        for m in reversed([*_WORD.finditer(joined)]):
            if r := readings(m[0], main):
                a, b = m.span()
                # a substituted letter may take up the mark behind it, so that the word gets shorter
                while b - a > len(r[0]):
                    k = next((i for i in range(a + 1, b) if unicodedata.category(out[i])[0] == "M"), b - 1)
                    end[k - 1] = end[k]
                    del out[k], start[k], end[k]
                    b -= 1
                out[a:b] = r[0]
        joined = "".join(out)
    return joined, start, end


def _open_words(text: str | None) -> list[list[str]]:
    """Words of a text that the vocabulary has to settle: each as it stands after the first step, then its readings.

    These are mixed-script words with several readings, and words of look-alikes only in a text that is Latin for a half at least;
    of the latter the word itself is the first reading.
    """
    if text is None or text.isascii() or _QUICK.fullmatch(text):
        return []
    text = plain_characters(text)
    main = _main_script(text)
    latin = sum(map(len, re.findall(r"[A-Za-zÀ-ʯ]+", text)))
    foreign = sum(map(len, re.findall(r"[Ͱ-ԯ]+", text)))
    out = []
    for m in _WORD.finditer(text):
        w = m[0]
        if len(r := readings(w, main)) > 1:
            out.append([w, *r])
        elif not r and len(w) > 1 and (latin >= foreign or w == text) and all(c in _TO["L"] for c in w):
            out.append([w, w, "".join(_TO["L"][c] for c in w)])
    return out


@F.pandas_udf(T.StringType())
def canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def open_words_udf(s: pd.Series) -> pd.Series:
    return s.map(_open_words)


def _settled(text: str | None, best: dict[str, str]) -> str | None:
    """The consistent form of a text; best: the readings that the vocabulary has settled."""
    if not best:
        return canonical(text)
    text = plain_characters(text)
    main = _main_script(text)
    return unicodedata.normalize("NFC", _WORD.sub(lambda m: best.get(m[0]) or (readings(m[0], main) or [m[0]])[0], text))


def _best(opened: list[list[str]], known) -> dict[str, str]:
    """Of each open word the first reading that the vocabulary has, else the first; the word itself is no evidence."""
    return {w: next((r for r in rs if r != w and known(r.lower())), rs[0]) for w, *rs in opened}


def vocabulary(df: DataFrame, col: str) -> DataFrame:
    """Distinct lower-case words of ``df[col]`` that are written in one script, as column ``word``."""
    return df.select(F.lower(F.col(col)).alias("word")).distinct().where(F.col("word").isNotNull() & ~_mixed(F.col("word")))


def _mixed(c):
    """Whether the column holds letters of more than one of Latin, Greek and Cyrillic."""
    return (c.rlike(r"[Ͱ-ԯἀ-῿]") & c.rlike(r"[A-Za-zÀ-ʯḀ-ỿ]")) | (c.rlike(r"[Ͱ-Ͽ]") & c.rlike(r"[Ѐ-ԯ]"))


#: Characters that are never changed; a text of these only is in the consistent form.
PLAIN = r"^[\n\r -~]*$"


def canonical_form(df: DataFrame, col: str, vocab: DataFrame | None = None, out: str = "canonical", changed: str = "is_changed", max_known: int = 200_000) -> DataFrame:
    """``df`` with the consistent form of ``df[col]`` in ``out`` and whether it differs in ``changed``.

    vocab: words in column ``word`` (see ``vocabulary``); it decides for words that can be read in two scripts, and for
    words made of look-alikes only, which are repaired if the vocabulary has the result. The readings that are asked for
    and known are written once; up to ``max_known`` of them, which is counted, are sent to all tasks and every row is
    mapped where it is. Beyond that texts with such words are joined to their settled readings, spread by salts.
    """
    df = df.drop(out, changed)
    differs = ~F.col(out).eqNullSafe(F.col(col))
    if vocab is None:
        return df.withColumn(out, canonical_udf(F.col(col))).withColumn(changed, differs)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    foreign = F.coalesce(F.col(col).rlike("[Ͱ-ԯἀ-῿]"), F.lit(False))
    opened = df.where(foreign).select(F.col(col).alias("_text")).withColumn("_opened", open_words_udf("_text")).where(F.size("_opened") > 0)
    asked = opened.select(F.explode("_opened").alias("_open")).select(F.explode(F.filter("_open", lambda r: r != F.col("_open")[0])).alias("_reading")).select(F.lower("_reading").alias("_reading")).distinct()
    known = asked.join(vocab.select(F.col("word").alias("_reading")).distinct(), "_reading", "left_semi").checkpoint()
    if known.count() <= max_known:
        shared = spark.sparkContext.broadcast(frozenset(r[0] for r in known.collect()))

        def settle(s: pd.Series) -> pd.Series:
            has = shared.value.__contains__
            return s.map(lambda t: _settled(t, _best(_open_words(t), has)), na_action="ignore")

        return df.withColumn(out, F.pandas_udf(settle, T.StringType())(F.col(col))).withColumn(changed, differs)
    each = opened.distinct().withColumn("_open", F.explode("_opened")).select("_text", F.col("_open")[0].alias("_word"), F.posexplode(F.slice("_open", 2, 8)).alias("_rank", "_choice"))
    hits = dimension_join(each, known, (F.lower("_choice") == F.col("_reading")) & (F.col("_choice") != F.col("_word")), max_rows=max_known)
    best = hits.groupBy("_text", "_word").agg(F.min_by("_choice", F.struct(F.col("_reading").isNull(), "_rank")).alias("_best"))
    settled = best.groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_best"))).alias("_choices")).select("_text", _settle_udf("_text", "_choices").alias("_settled")).checkpoint()
    mended = dimension_join(df, settled, F.when(foreign, F.col(col)) == F.col("_text"), max_rows=max_known)
    return mended.withColumn(out, F.coalesce("_settled", canonical_udf(F.col(col)))).drop("_text", "_settled").withColumn(changed, differs)


@F.pandas_udf(T.StringType())
def _settle_udf(text: pd.Series, choices: pd.Series) -> pd.Series:
    return pd.Series([_settled(t, dict(c or {})) for t, c in zip(text, choices, strict=True)], dtype=object)


def changed_words(df: DataFrame, col: str, vocab: DataFrame | None = None) -> DataFrame:
    """``word, form`` of the distinct words of ``df[col]`` that the consistent form changes; written once.

    Each word is looked at once, however often it stands; those of plain characters only are not looked at.
    """
    words = df.select(F.col(col).alias("word")).where(~F.col("word").rlike(PLAIN)).distinct()
    ensure_checkpoint_dir(df.sparkSession)
    return canonical_form(words, "word", vocab, out="form").where("is_changed").select("word", "form").checkpoint()
