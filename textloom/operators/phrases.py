"""Phrases of a text and who its pronouns stand for.

Reading is sequential: what a token does depends on all before it. Each input's tokens are gathered, a row per input
bounded by its text, and read by a small state machine in Python over Arrow. Places are offsets into the input's rows.

Texts are read over a view in which spans take the place of the tokens they cover.

Decisions where the order of reading would leave a choice: the last phrase is closed once and covers all its tokens,
words are compared in lower case, of equal scores the first by name wins, and an empty input has no phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import predicates as P
from textloom.lexicon import Lexicon
from textloom.operators import categories as C
from textloom.operators.spans import intent_rows
from textloom.session import dimension_join, shuffled

# Fixed value: non-pronoun tokens after which all antecedents are forgotten.
MEMORY = 30
SEPARATORS = {",", ";", "-", "+"}
ASKING = {"who", "what", "where", "why"}
CONJUNCTIONS = {"CC", "CS", "CA"}
PAST, FUTURE = {"VBD", "VBN", "VHP"}, {"VF", "VFG", "VHF"}


@dataclass
class Unit:
    """A noun or a verb with what belongs to it."""

    at: int
    determiners: list[int] = field(default_factory=list)
    adjectives: list[int] = field(default_factory=list)
    adverbs: list[int] = field(default_factory=list)
    prepositions: list[int] = field(default_factory=list)
    separators: list[int] = field(default_factory=list)
    auxiliaries: list[int] = field(default_factory=list)
    objects: list[int] = field(default_factory=list)
    linkers: list[int] = field(default_factory=list)
    modifiers: list[Unit] = field(default_factory=list)
    siblings: list[Unit] = field(default_factory=list)

    def places(self) -> list[int]:
        own = [self.at, *self.determiners, *self.adjectives, *self.adverbs, *self.prepositions, *self.auxiliaries, *self.objects]
        return own + [p for u in (*self.modifiers, *self.siblings) for p in u.places()]

    left = property(lambda self: min(self.places()))
    right = property(lambda self: max(self.places()))


@dataclass
class Phrase:
    start: int
    nouns: list[Unit] = field(default_factory=list)
    verbs: list[Unit] = field(default_factory=list)
    end: int = 0
    split: int | None = None
    tense: str = "present"
    person: str = "undetermined"
    kind: str = "undetermined"
    intent: str = "neutral"
    intent_score: float = 0.0


class Antecedents:
    """Persons and things spoken of, most recent last, and who the next pronoun stands for."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.persons: list[list] = []  # word, gender
        self.primary: list | None = None
        self.thing: str | None = None
        self.entities: list[str] = []
        self.plural: list[str] = []
        self.last: list | None = None
        self.idle = 0

    def other(self, t: dict) -> None:
        if t["is_person"]:
            known = next((p for p in self.persons if p[0] == t["word"]), None)
            p = known or [t["word"], ""]
            if not known:
                self.persons.append(p)
            self.primary = self.primary or p
            if t["word"] not in self.plural:
                self.plural.append(t["word"])
        elif t["is_entity"]:
            self.entities.append(t["word"])
        elif t["is_noun"] and self.thing is None:
            self.thing = t["word"]
        if t["is_verb"] or t["is_preposition"]:
            self.plural = []
        self.idle += 1
        if self.idle > MEMORY:
            self.clear()

    def resolve(self, pronoun: dict) -> str | None:
        """The antecedent of a third-person pronoun; several are joined by a bar."""
        self.idle = 0
        if pronoun["person"] != "third" or pronoun["category"] not in ("personal", "possessive", "reflexive"):
            return None
        gender = pronoun["gender"]
        if pronoun["number"] == "plural":
            if len(self.plural) >= 2 and self.primary and self.primary[0] in self.plural:
                return "|".join(self.plural)
            others = [p[0] for p in self.persons if p is not self.primary]
            if self.primary and others:
                return f"{self.primary[0]}|{others[-1]}"
            return self.entities[-1] if self.entities else None
        if gender in ("neutral", ""):
            return self.thing
        p = self.primary
        if p and (pronoun["category"] == "possessive" or self.last is not p) and p[1] in ("", gender):
            p[1] = gender
            self.last = p
            return p[0]
        for p in reversed(self.persons):
            if p is not self.primary and p[1] in ("", gender):
                p[1] = gender
                self.last = p
                return p[0]
        return self.primary[0] if self.primary and self.primary[1] in ("", gender) else None


class Reader:
    """Reads an input's tokens into phrases.

    whole: whether the kind of a phrase is judged by all tokens of the text so far, or by its own only.
    """

    def __init__(self, intents: dict[tuple[str, ...], str], whole: bool = True):
        self.paths, self.whole = intents, whole
        self.longest = max(map(len, intents), default=0)

    def read(self, tokens: list[dict]) -> tuple[list[Phrase], list[tuple[int, str]]]:
        self.t = tokens
        self.phrases: list[Phrase] = []
        self.phrase = Phrase(0)
        self.nouns: list[Unit] = []
        self.verbs: list[Unit] = []
        self.found: dict[str, int] = {}
        self._reset()
        antecedents = Antecedents()
        resolved: list[tuple[int, str]] = []
        last_pos = ""
        for x, t in enumerate(tokens):
            self._intent(x)
            if t["pos"] == "SS":
                self._close(x)
            elif t["is_noun"] and last_pos == "VBG" and self.verbs:
                self.verbs[-1].objects.append(x)
            elif t["is_noun"]:
                self._noun(x)
            elif t["is_auxiliary"] or t["is_predicative"]:
                if t["is_auxiliary"]:
                    self.auxiliaries.append(x)
                if t["is_predicative"]:
                    self.predicatives.append(x)
            elif t["is_verb"]:
                self._verb(x)
            elif t["is_adverb"]:
                self.adverbs.append(x)
            elif t["is_adjective"]:
                self.adjectives.append(x)
            elif t["is_pronoun"]:
                who = self._pronoun(x, antecedents)
                if who:
                    resolved.append((x, who))
            elif t["pos"] == "IN":
                self.prepositions.append(x)
            elif t["pos"] == "DT":
                self.determiners.append(x)
            elif t["pos"] == "CC" or t["word"] in SEPARATORS:
                self.separators.append(x)
            if t["pos"] in CONJUNCTIONS:
                self.linkers.append(x)
            if t["pos"] == "IN" or t["pos"] in CONJUNCTIONS or t["word"] == ",":
                self.splitters.append(x)
            if not t["is_pronoun"]:
                antecedents.other(t)
            last_pos = t["pos"]
        if tokens and self.phrase.start < len(tokens):
            self._close(len(tokens))
        return self.phrases, resolved

    def _reset(self) -> None:
        self.determiners: list[int] = []
        self.adjectives: list[int] = []
        self.adverbs: list[int] = []
        self.prepositions: list[int] = []
        self.separators: list[int] = []
        self.auxiliaries: list[int] = []
        self.predicatives: list[int] = []
        self.linkers: list[int] = []
        self.splitters: list[int] = []

    def _intent(self, x: int) -> None:
        for n in range(1, self.longest + 1):
            key = tuple(t["word"].lower() for t in self.t[x : x + n])
            if len(key) == n and key in self.paths:
                self.found[self.paths[key]] = self.found.get(self.paths[key], 0) + n
                return

    def _settle_adverbs(self, x: int) -> None:
        """Gives the verb before x its linkers and those pending adverbs that are its own.

        These are all ahead of a bare noun; else those ahead of a verb with no preposition between, and those ahead of
        an adjective that do not tell the manner.
        """
        verbs = self.verbs or self.phrase.verbs
        if not verbs:
            return
        verb, right = verbs[-1], self.t[x]
        verb.linkers += self.linkers
        self.linkers = []
        adjective = self.adjectives[0] if self.adjectives else None
        if adjective is None and right["is_noun"]:
            own = list(self.adverbs)
        else:
            until = self.prepositions[0] if self.prepositions else x
            own = [a for a in self.adverbs if (right["is_verb"] and a < until) or (adjective is not None and a < adjective and not self.t[a].get("is_manner"))]
        verb.adverbs += own
        self.adverbs = [a for a in self.adverbs if a not in own]

    def _noun(self, x: int) -> None:
        if not self.nouns:
            self._settle_adverbs(x)
            self._flush_verbs()
            self.splitters = []
        self.nouns.append(Unit(x, self.determiners, self.adjectives, [], self.prepositions, self.separators))
        self.determiners, self.adjectives, self.prepositions, self.separators = [], [], [], []

    def _verb(self, x: int) -> None:
        if not self.verbs:
            self._settle_adverbs(x)
            self._flush_nouns()
            self.splitters = []
        self.verbs.append(Unit(x, self.determiners, [], self.adverbs, self.prepositions, self.separators, self.auxiliaries))
        self.determiners, self.adverbs, self.prepositions, self.separators, self.auxiliaries = [], [], [], [], []

    def _pronoun(self, x: int, antecedents: Antecedents) -> str | None:
        p = self.t[x]["pronoun"]
        if not p or p["category"] not in ("personal", "possessive", "reflexive"):
            return None
        who = antecedents.resolve(p)
        if p["person"] == "first":
            self.phrase.person = "first"
        elif self.t[x]["word"].lower() == "you":
            self.phrase.person = "second"
        elif self.phrase.person == "undetermined":
            self.phrase.person = "third"
        return who

    def _flush_nouns(self) -> None:
        head: Unit | None = None
        ready: list[Unit] = []
        linked = any(self.t[s]["pos"] == "CC" for u in self.nouns for s in u.separators)
        for u in self.nouns:
            if head is None:
                head = u
            elif not (u.prepositions or u.determiners or u.separators or u.adjectives):
                u.modifiers = [head, *head.modifiers]  # compound: the last noun is the head
                head.modifiers = []
                head = u
            elif u.prepositions:
                head.modifiers.append(u)
            elif u.separators and linked:
                head.siblings.append(u)
            else:
                ready.append(head)
                head = u
        if head:
            ready.append(head)
        for u in ready:
            first = min(self.adjectives, default=-1)
            if self.predicatives and self.adjectives and first > min(self.predicatives) and not any(self.predicatives[0] < x < first for x in self.splitters):
                u.adjectives += self.adjectives
                self.adjectives, self.predicatives = [], []
            self._split_softly(u, "noun")
            self.phrase.nouns.append(u)
        self.nouns = []

    def _flush_verbs(self) -> None:
        head: Unit | None = None
        ready: list[Unit] = []
        for u in self.verbs:
            if head is None or u.determiners:
                if head:
                    ready.append(head)
                head = u
            elif not u.prepositions and any(self.t[s]["pos"] == "CC" for s in u.separators):
                head.siblings.append(u)
            else:
                head.modifiers.append(u)
        if head:
            if self.adverbs:
                head.adverbs += self.adverbs
                self.adverbs = []
            ready.append(head)
        for u in ready:
            self._split_softly(u, "verb")
            if not self.phrase.verbs:
                pos = self.t[u.at]["pos"]
                self.phrase.tense = "past" if pos in PAST else "future" if pos in FUTURE else "present"
            self.phrase.verbs.append(u)
        self.verbs = []

    def _split_softly(self, unit: Unit, kind: str) -> None:
        p = self.phrase
        if not p.nouns or not p.verbs:
            return
        if kind == "noun" and len(p.verbs) == 1 and self.t[p.verbs[0].at]["pos"] in PAST:
            return
        a, b = max(u.right for u in (*p.nouns, *p.verbs)), unit.left
        if b <= a:
            return
        between = range(a + 1, b + 1)
        tests = (
            lambda t: t["pos"] == "IN" and t["word"].lower() != "of",
            lambda t: t["word"] in (",", ";"),
            lambda t: t["is_adverb"],
            lambda t: t["pos"] == "DT",
        )
        at = next((x for ok in tests for x in between if ok(self.t[x])), a + 1)
        self._split(at)

    def _split(self, at: int) -> None:
        p = self.phrase
        p.end, p.split = at, at if at < len(self.t) else None
        p.kind = self._classify(at)
        if self.found:
            p.intent = min(self.found, key=lambda k: (-self.found[k], k))
            p.intent_score = self.found[p.intent] / max(1, at)
        self.phrases.append(p)
        stopped = p.split is not None and self.t[at]["pos"] == "SS"
        self.phrase = Phrase(at + 1 if stopped else at)
        if not (p.split is not None and self.t[at]["word"].lower() == "|nl|"):
            self.phrase.person, self.phrase.kind = p.person, p.kind

    def _close(self, x: int) -> None:
        self._flush_nouns()
        self._flush_verbs()
        p = self.phrase
        whole = p.verbs and (p.nouns or any(v.objects for v in p.verbs))
        before = self.phrases[-1] if self.phrases else None
        if not whole and before and before.end == p.start and (before.split is None or self.t[before.split]["pos"] != "SS"):
            # without a verb or noun of its own it belongs to the phrase before
            before.nouns += p.nouns
            before.verbs += p.verbs
            before.end, before.split = x, x if x < len(self.t) else None
            self.phrase = Phrase(x + 1)
        elif x > p.start:
            self._split(x)
        else:
            self.phrase = Phrase(x + 1)
        self.found = {}
        self._reset()

    def _classify(self, at: int) -> str:
        p = self.phrase
        person = "second" if p.person == "undetermined" else p.person
        own = self.t[0 if self.whole else p.start : at]
        if person in ("first", "third") and p.tense == "past":
            return "conversational"
        if person == "third":
            return "declarative"
        if (at < len(self.t) and self.t[at]["word"] == "?") or (own and own[0]["word"].lower() in ASKING):
            return "interrogative"
        if any(t.get("is_state") or t.get("is_degree") for t in own):
            return "declarative"
        return "conversational" if any(t.get("is_place") for t in own) else "imperative"


def render_unit(u: Unit, tokens: list[dict]) -> str:
    """A noun or verb with what belongs to it, part by part in brackets; empty parts are left out."""
    names = ("determiners", "adjectives", "adverbs", "prepositions", "auxiliaries", "objects", "linkers")
    parts = [f"{n}({' '.join(tokens[i]['word'] or '' for i in getattr(u, n))})" for n in names if getattr(u, n)]
    parts += [f"{n}({'; '.join(render_unit(x, tokens) for x in getattr(u, n))})" for n in ("modifiers", "siblings") if getattr(u, n)]
    return " ".join([tokens[u.at]["word"] or "", *parts])


def render_phrase(p: Phrase, tokens: list[dict]) -> str:
    """A phrase in brackets with its tense, person and kind, its nouns and its verbs."""
    words = " ".join(t["word"] or "" for t in tokens[p.start : p.end])
    nouns, verbs = ("; ".join(render_unit(u, tokens) for u in us) for us in (p.nouns, p.verbs))
    return f"[{words}] {p.tense}/{p.person}/{p.kind} nouns({nouns}) verbs({verbs})"


_OUT = "phrase int, start int, end int, split_token int, tense string, person string, kind string, intent string, intent_score double, nouns array<int>, verbs array<int>, modifiers array<int>, siblings array<int>, objects array<int>, rendered string"


# Category paths of verbs and adverbs that tell a phrase's kind, and of adverbs that do not go with a verb.
KIND_PATHS = {"is_state": ["verbs/state"], "is_degree": ["adverbs/degree"], "is_place": ["adverbs/place"], "is_manner": ["adverbs/manner"]}


def describe(view: DataFrame, lexicon: Lexicon, coreference: DataFrame | None = None, kind_paths: dict[str, list[str]] = KIND_PATHS) -> DataFrame:
    """A view ``input_id, seq, word, pos, token_id`` with what reading needs of each row.

    Persons and things are told by their categories (coreference: see ``categories.coreference_kinds``); a name that the
    dictionary lacks is a person.
    """
    kinds = (coreference if coreference is not None else C.coreference_kinds(lexicon)).select(F.col("token_id").alias("_kid"), F.col("is_person").alias("_person"), F.col("is_entity").alias("_entity"))
    has = C.in_ranges(lexicon.tokens, "categories", C.ranges(lexicon, kind_paths)).groupBy(F.col("token_id").alias("_hid")).agg(F.collect_set("kind").alias("_kinds"))
    lex = lexicon.tokens.select(F.col("token_id").alias("_id"), "pronoun", "is_auxiliary", "is_predicative").join(shuffled(kinds), F.col("_id") == F.col("_kid"), "left").join(shuffled(has), F.col("_id") == F.col("_hid"), "left").drop("_kid", "_hid")
    t = dimension_join(view.select("input_id", "seq", "word", P.known_tag(F.col("pos")).alias("pos"), "token_id"), lex, F.col("token_id") == F.col("_id"))
    p = F.col("pos")
    flag = lambda c: F.coalesce(c, F.lit(False))
    own = {k: flag(F.array_contains("_kinds", k)) for k in kind_paths}
    of_verb, of_adverb = P.is_verb(p), P.is_adverb(p)
    kinds_of = [(own[k] & (of_verb if k == "is_state" else of_adverb)).alias(k) for k in kind_paths]
    return t.select("input_id", "seq", "word", "pos", "pronoun", P.is_noun(p).alias("is_noun"), of_verb.alias("is_verb"), of_adverb.alias("is_adverb"), P.is_adjective(p).alias("is_adjective"), P.is_pronoun(p).alias("is_pronoun"), P.is_preposition(p).alias("is_preposition"), flag(F.col("is_auxiliary")).alias("is_auxiliary"), flag(F.col("is_predicative")).alias("is_predicative"), F.coalesce("_person", P.is_named_entity(p)).alias("is_person"), flag(F.col("_entity")).alias("is_entity"), *kinds_of)


def _gathered(described: DataFrame) -> DataFrame:
    rest = [c for c in described.columns if c != "input_id"]
    return described.groupBy("input_id").agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in rest if c not in ("seq", "pronoun")], F.to_json("pronoun").alias("_pronoun")))).alias("tokens"))


def _reading(rows: list[dict], reader: Reader):
    import json

    for t in rows:
        t["pronoun"] = {"category": "", "person": "", "gender": "", "number": ""} | json.loads(t["_pronoun"]) if t["_pronoun"] else None
    return reader.read(rows)


def interpret(described: DataFrame) -> DataFrame:
    """``input_id`` and a row per phrase: its half-open range, split token, tense, person, kind, intent and units."""
    paths = {tuple(p.split()): k for p, _, k in intent_rows()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(paths)
        types = (pa.int32(),) * 4 + (pa.string(),) * 4 + (pa.float64(),) + (pa.list_(pa.int32()),) * 5 + (pa.string(),)
        names = [f.split()[0] for f in _OUT.split(", ")]
        for b in batches:
            at, out = [], []
            for row, tokens in enumerate(b.column("tokens").to_pylist()):
                for i, p in enumerate(_reading(tokens, reader)[0]):
                    units = (*p.nouns, *p.verbs)
                    at.append(row)
                    out.append((i, p.start, p.end, p.split, p.tense, p.person, p.kind, p.intent, p.intent_score, [u.at for u in p.nouns], [u.at for u in p.verbs], [m.at for u in units for m in u.modifiers], [s.at for u in units for s in u.siblings], [o for u in units for o in u.objects], render_phrase(p, tokens)))
            cols = zip(*out, strict=True) if out else ((),) * len(types)
            yield pa.RecordBatch.from_arrays([b.column("input_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["input_id", *names])

    g = _gathered(described)
    return g.mapInArrow(run, f"input_id {g.schema['input_id'].dataType.simpleString()}, {_OUT}")


def resolve_pronouns(described: DataFrame) -> DataFrame:
    """``input_id, place, antecedent`` of the pronouns that stand for someone or something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader({})
        for b in batches:
            at, places, who = [], [], []
            for row, tokens in enumerate(b.column("tokens").to_pylist()):
                for x, w in _reading(tokens, reader)[1]:
                    at.append(row)
                    places.append(x)
                    who.append(w)
            yield pa.RecordBatch.from_arrays([b.column("input_id").take(pa.array(at, pa.int64())), pa.array(places, pa.int32()), pa.array(who, pa.string())], names=["input_id", "place", "antecedent"])

    g = _gathered(described)
    return g.mapInArrow(run, f"input_id {g.schema['input_id'].dataType.simpleString()}, place int, antecedent string")


def render_token(word: Column, pos: Column, token_id: Column, antecedent: Column, inner: Column) -> Column:
    """A token as text: with its antecedent, as a system word with its value, or plain."""
    return F.when(antecedent.isNotNull(), F.format_string("%s [%s: %s] (%s)", word, F.coalesce(token_id, F.lit(0)), pos, antecedent)).when(pos == "SYS", F.format_string("%s [%s: %s]", word, F.coalesce(inner, F.lit("")), pos)).otherwise(F.format_string("%s [%s: %s]", word, F.coalesce(token_id, F.lit(0)), pos))
