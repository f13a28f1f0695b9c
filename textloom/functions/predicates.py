"""Tests on a tag, and on categories by range. Each takes and gives columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The tag set.
TAGS = "CC CS CA DT EX FW IN JJ JJR JJS LS MD MWE NN NNS NNP NNPS NM NZ PDT PR PRP PUNC RB RBR RBS SS SYM SYS UH VB VBD VBG VBN VBP VBZ VF VFG VH VHF VHP VHZ WDT WPR WPRP WRB".split()


def known_tag(c: Column) -> Column:
    """The tag in upper case; FW for null and for what is no tag."""
    return F.when(F.upper(c).isin(TAGS), F.upper(c)).otherwise("FW")


def _tag(c: Column) -> Column:
    return F.coalesce(F.upper(c), F.lit("FW"))


def is_noun(pos: Column) -> Column:
    return _tag(pos).startswith("N") | (_tag(pos) == "SYS")


def is_verb(pos: Column) -> Column:
    return _tag(pos).startswith("V")


def is_base_verb(pos: Column) -> Column:
    return _tag(pos).isin("VB", "VBG")


def is_past_verb(pos: Column) -> Column:
    return _tag(pos).isin("VBD", "VBN", "VHP")


def is_present_verb(pos: Column) -> Column:
    return _tag(pos).isin("VB", "VBG", "VBZ", "VH", "VHZ")


def is_future_verb(pos: Column) -> Column:
    return _tag(pos).isin("VF", "VFG", "VHF")


def is_adjective(pos: Column) -> Column:
    return _tag(pos).startswith("J")


def is_adverb(pos: Column) -> Column:
    return _tag(pos).startswith("R")


def is_named_entity(pos: Column) -> Column:
    return _tag(pos).startswith("NNP")


def is_ngram(pos: Column) -> Column:
    return _tag(pos) == "MWE"


def is_conjunction(pos: Column) -> Column:
    return _tag(pos).isin("CC", "CS", "CA")


def is_determiner(pos: Column) -> Column:
    return _tag(pos) == "DT"


def is_pronoun(pos: Column) -> Column:
    return _tag(pos).isin("PR", "PRP")


def is_modal_verb(pos: Column) -> Column:
    return _tag(pos) == "MD"


def is_preposition(pos: Column) -> Column:
    return _tag(pos) == "IN"


def is_sentence_stopper(pos: Column) -> Column:
    return _tag(pos) == "SS"


def is_punctuation(pos: Column) -> Column:
    return _tag(pos).isin("SS", "PUNC")


def is_phrase_splitter(pos: Column) -> Column:
    return _tag(pos) == "PUNC"


def has_category(categories: Column, lo: Column, hi: Column) -> Column:
    """Whether any category id is in [lo, hi); a null array has none."""
    return F.coalesce(F.exists(categories, lambda c: (c >= lo) & (c < hi)), F.lit(False))


def is_anaphora(pronoun: Column) -> Column:
    """Personal, possessive or reflexive, and not of the first person."""
    return F.coalesce(pronoun["category"].isin("personal", "possessive", "reflexive") & (pronoun["person"] != "first"), F.lit(False))


ALL = {f.__name__: f for f in (is_noun, is_verb, is_base_verb, is_past_verb, is_present_verb, is_future_verb, is_adjective, is_adverb, is_named_entity, is_ngram, is_conjunction, is_determiner, is_pronoun, is_modal_verb, is_preposition, is_sentence_stopper, is_punctuation, is_phrase_splitter)}

#: Forty-six tags collapse to ten.
def short_tag(pos: Column) -> Column:
    t = _tag(pos)
    return F.when(is_noun(t), "NN").when(is_verb(t), "VB").when(is_adjective(t), "JJ").when(is_adverb(t), "RB").when(is_conjunction(t), "CC").when(is_pronoun(t), "PR").when(is_punctuation(t), "PUNC").when(t == "IN", "IN").when(t == "DT", "DT").otherwise("FW")
