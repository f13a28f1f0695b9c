"""Abusive, hateful or sexual content: a calibrated score per document and kind.

Method: gradient-boosted trees over dense features - lexicon densities, nearness of the second person and of groups,
capitals, punctuation and obfuscation rates - with isotonic calibration. The trees start from nothing but the share of
flagged opinions; what a combination of features means they learn from the labels.

One pass over the text finds lexicon terms with an automaton (leet digits mapped back, single stars, stretched and
spaced-out letters undone); only passages around a term are looked at closer. Two lexicons are used: lists of words and
phrases of general use, and a learnt one, the log-odds of words and pairs of words near such terms in labelled documents
(for the training of the trees they are counted without the document's own fold). Texts are scanned where they lie: no
shuffle.

The model is fitted on a sample of labelled documents of at most ``max_labels`` documents (those with the smallest
hash of their id; a documented bound); every document is scored. The sample of ids, its features, the learnt lexicon
and the model are of bounded size and are all that is collected or broadcast.

Defined results: null and empty texts have the score of a text without any term; null opinions are no opinions;
opinions on unknown documents are ignored; without opinions on a kind there is nothing to learn from and its scores are
null; repeated rows are scored each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import ensure_checkpoint_dir

KINDS = ("abusive", "hateful", "sexual")

# Lexicons, our own, of general use. Lower case.
INSULTS = """idiot imbecile cretin moron halfwit dimwit nitwit twit twat dunce blockhead numbskull dolt liar swine scum maggot weasel parasite hag leech worm
toad coward crook buffoon scoundrel bastard bitch whore slut jerk loser filth scumbag sleazebag dirtbag lowlife arsehole asshole wanker prick dickhead bollocks rat pig snake clown fool
imbécile crétin abruti porc menteur menteuse ordure idiote connard connasse salaud salope raclure débile minable pourriture fumier lâche canaille bouffon escroc enfoiré crapule
drecksack abschaum lügner trottel schwein dummkopf schwachkopf arschloch mistkerl vollidiot depp lump schuft halunke versager feigling dreckskerl miststück schlampe hure wichser penner idioten
imbécil cretino basura mentiroso mentirosa payaso cerdo idiota canalla gusano estúpido sinvergüenza desgraciado cobarde gilipollas cabrón puta zorra escoria capullo embustero""".split()
ADJECTIVES = """pathetic stinking spineless brainless worthless filthy disgusting miserable gutless rotten slimy lousy dirty stupid sale sales pathétique répugnant immonde mieser miese mieses dreckiger dreckigen dreckige dreckiges widerlicher elender
asqueroso asquerosa sucio sucia repugnante inmundo patético""".split()
ADDRESS = """you your yours yourself thou ye u vous votre vos tu toi ton ta tes t sie ihnen ihr ihre ihren du dich dir dein deine deinen euch euer usted ustedes ti tú vosotros vous-même""".split()
SILENCING = ["shut your", "shut up", "get lost", "go to hell", "drop dead", "fermez-la", "ferme-la", "la ferme", "ta gueule", "espèce de", "espèces de", "das maul", "den mund halten", "halt die klappe", "halt's maul", "cállese", "cállate", "pedazo de", "cierra la boca"]
THREATS = ["break your", "break his", "break her", "hurt you", "find you", "where you live", "make you sorry", "make you pay", "kill you", "shoot you", "hang you", "beat you", "burn your house", "smash your", "cut your throat", "watch your back", "you will regret", "casser les", "casser la gueule", "briser les os", "vous tuer", "te tuer", "où vous habitez", "où tu habites", "égorger", "knochen brechen", "die beine brechen", "umbringen", "wo du wohnst", "wo sie wohnen", "die fresse", "aufhängen", "romperle", "romperte", "partirle", "partirte", "matarle", "matarte", "dónde vive", "dónde vives", "lo pagará"]
GROUPS = """women woman girls cripple cripples foreigners foreigner immigrants immigrant migrants refugees gypsies gays homosexuals lesbians blacks jews muslims christians disabled pensioners natives tribe folk people community families
femmes étrangers immigrés réfugiés handicapés frauen ausländer flüchtlinge behinderte krüppel zuwanderer mujeres extranjeros inmigrantes refugiados inválidos gitanos""".split()
DEMEANING = """vermin rats cockroaches lice subhuman subhumans savages animals parasites plague inferior degenerates criminals thieves thief burden infest swarm deport
vermine cafards sauvages animaux parasites fléau inférieurs voleur voleurs fardeau ungeziefer untermenschen ratten parasiten schmarotzer kakerlaken dieb diebe verbrecher plage
alimañas ratas cucarachas salvajes animales parásitos plaga ladrón ladrones carga""".split()
EXPELLING = ["driven out", "drive them out", "drive out", "send them back", "send them home", "go back to", "get rid of", "wipe out", "wipe them out", "burn down", "burn them", "kill all", "not welcome", "not human", "keep them out", "breed like", "les chasser", "dehors les", "renvoyer chez", "raus mit", "vertrieben", "verjagt", "rauswerfen", "fuera los", "echarlos", "expulsarlos"]
SEXUAL = """sex sexual sexually naked nude nudes tits boobs breasts cock dick pussy blowjob orgasm erection horny porn porno rape raped raping grope groped groping fondled moaned penis vagina undress bed lap knees
sexe nu nue seins baise baiser bite chatte nichons lit genoux sexo desnudo desnuda tetas polla coño follar cama rodillas nackt nackte titten ficken schwanz fotze muschi bett knien""".split()
EXPLICIT = ["had sex", "have sex", "having sex", "sex with", "strip naked", "get naked", "clothes off", "on your knees", "spread her legs", "spread your legs", "show us your", "naked body", "under her skirt", "sleep with me", "suck my", "groped her", "groped him", "groped me", "touched her",
    "déshabille-toi", "déshabillez-vous", "couché avec", "coucher avec", "zieh dich aus", "ziehen sie sich aus", "hatte sex", "sex mit", "quítate la ropa", "quítese la ropa", "sexo con", "acostarse con", "abre las piernas", "écarte les jambes", "mach die beine breit"]
#: Speaking about such language or matters.
REPORTED = ["the word", "unparliamentary", "withdraw", "le mot", "les mots", "retirez", "retirer", "das wort", "zurückziehen", "la palabra", "retire", "offence", "incite", "hatred", "hate speech", "hetze", "hass", "strafbar", "la haine", "délit", "el odio", "delito", "treated like", "survivors", "victim", "evidence", "education", "health", "a court", "the term", "called me", "the expression", "condemn", "prohibit", "forbid", "prevention", "opfer", "victime", "víctima"]

_REPORTED = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, REPORTED)) + ")")
_LEET = tuple(zip("0134579@$", "oieaszgas", strict=True))
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_][^\W\d_]){3,}(?![^\W_])")
_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüéèêàáíóúñçß"
_ENDS = ("", "s", "es", "e", "n", "en", "in", "r", "er", "x")

#: What is counted on its own for each kind: its terms and its phrases.
_TERMS = {"abusive": "insult", "hateful": "demeaning", "sexual": "sexual"}
_PHRASES = {"abusive": ("silencing", "threat"), "hateful": ("expelling",), "sexual": ("explicit",)}
FEATURES = ("terms_rate", "phrases_rate", "near_address", "near_adjective", "near_group", "adjective_near_group", "phrases", "phrase_near_address", "phrase_near_group", "open_terms", "open_adjectives", "reported", "learnt", "learnt_rate", "loud_terms", "capitals_near", "exclaims_near", "obfuscated", "bracketed", "capitals_rate", "exclaims_rate", "obfuscation_rate", "log_words")
#: A learnt term needs so many labelled documents; its log-odds are smoothed by half an opinion and cut at either end.
LEARNT_DOCS, LEARNT_CUT = 4, 3.0
#: An opinion names one kind only; against the others it weighs so much of an opinion that names none.
OTHER_KIND = 0.1
#: Parts of the labelled documents that the learnt lexicon is counted in.
FOLDS = 5


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    entries: dict[str, set] = {}
    for tag, words in (("insult", INSULTS), ("sexual", SEXUAL)):
        for w in words:
            entries.setdefault(w, set()).add(tag)
            if len(w) > 3:
                for i in range(len(w)):
                    entries.setdefault(w[:i] + "*" + w[i + 1 :], set()).add(tag)
    for tag, phrases in (("adjective", ADJECTIVES), ("demeaning", DEMEANING), ("expelling", EXPELLING), ("threat", THREATS), ("explicit", EXPLICIT), ("silencing", SILENCING)):
        for p in phrases:
            entries.setdefault(p, set()).add(tag)
    for c in _LETTERS:
        entries.setdefault(c * 3, set()).add("stretched")
    for k, tags in entries.items():
        a.add_word(k, (k, tuple(sorted(tags))))
    a.make_automaton()
    return a


def _unleet(low: str) -> str:
    """Digits and signs that stand for letters as these letters."""
    for digit, letter in _LEET:
        low = low.replace(digit, letter)
    return low


def _capitals(text: str, low: str) -> int:
    """How many characters of a text are others in lower case; low is as long as the text."""
    return int((np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)).sum())


def _near(a: list[int], b: list[int]) -> float:
    """1 for neighbours and less the more words lie between; 0 if either is missing."""
    return max((1 / max(1, abs(i - j)) for i in a for j in b), default=0.0)


class Scanner:
    """Finds the passages of a text that hold lexicon terms, and their features.

    learnt: the learnt lexicon, term to opinions by kind, clean ones last, and their sums; both per fold. fold: one that
    is left out.
    """

    def __init__(self, learnt: tuple[dict[str, np.ndarray], np.ndarray] | None = None, fold: int | None = None):
        self.automaton = _automaton()
        self.adjectives, self.address, self.groups = set(ADJECTIVES), set(ADDRESS), set(GROUPS)
        self.lexicon = {w: "insult" for w in INSULTS} | {w: "sexual" for w in SEXUAL}
        self.collapsed = {re.sub(r"(.)\1+", r"\1", w): t for w, t in self.lexicon.items()}
        counts, sums = learnt or ({}, np.zeros((FOLDS, len(KINDS) + 1)))
        kept = [i for i in range(FOLDS) if i != fold]
        sums = sums[kept].sum(axis=0)
        folded = {t: c[kept].sum(axis=0) for t, c in counts.items()}
        self.odds = {t: tuple(self._odds(c, sums, k) for k in range(len(KINDS))) for t, c in folded.items() if c.sum() >= LEARNT_DOCS}

    @staticmethod
    def _odds(counts: np.ndarray, sums: np.ndarray, k: int) -> float:
        yes = (counts[k] + 0.5) / (sums[k] + 1)
        no = (OTHER_KIND * (counts[:-1].sum() - counts[k]) + counts[-1] + 0.5) / (OTHER_KIND * (sums[:-1].sum() - sums[k]) + sums[-1] + 1)
        return max(-LEARNT_CUT, min(LEARNT_CUT, math.log(yes / no)))

    def hits(self, low: str) -> list[tuple[int, int, str, bool]]:
        """Start, end, tag and whether it was obfuscated, of every term."""
        out = []
        plain = _unleet(low)
        n = len(plain)
        for last, (key, tags) in self.automaton.iter(plain):
            start, end = last - len(key) + 1, last + 1
            if tags == ("stretched",):
                a, b = start, end
                while a and low[a - 1].isalnum():
                    a -= 1
                while b < n and low[b].isalnum():
                    b += 1
                tag = self.collapsed.get(re.sub(r"(.)\1+", r"\1", plain[a:b]))
                if tag:
                    out.append((a, b, tag, True))
                continue
            before = plain[start - 1] if start else " "
            if before.isalnum() or before == "*":
                continue
            b = end
            while b < n and (plain[b].isalnum() or plain[b] == "*") and b - end < 3:
                b += 1
            tail = plain[end:b]
            if tail and (tail not in _ENDS or len(key) < 5 or (b < n and plain[b].isalnum())):
                continue
            same = low[start:end] == key and "*" not in key
            out.extend((start, b, tag, not same) for tag in tags if same or tag in ("insult", "sexual"))
        for m in _SPACED.finditer(low):
            joined = re.sub(r"[ .\-_]", "", m[0])
            for k in range(min(3, len(joined) - 3)):
                if tag := self.lexicon.get(joined[k:]) or self.lexicon.get(joined[k:-1]):
                    out.append((m.start() + 2 * k, m.end(), tag, True))
                    break
        return out

    def passages(self, low: str, hits: list) -> dict[tuple[int, int], list]:
        """The hits by passage: a sentence or a remark in brackets."""
        out: dict[tuple[int, int], list] = {}
        for h in sorted(hits):
            a, b = h[0], h[1]
            while a and not (low[a - 1] in "\n[]()" or (low[a - 1] in " " and a > 1 and low[a - 2] in ".!?" and not (a > 2 and not low[a - 3].isalnum()) and not low[max(0, a - 4)] == ".")):
                a -= 1
            n = len(low)
            while b < n and not (low[b] in "\n[]()" or (low[b] in ".!?" and (b + 1 == n or low[b + 1] in " \n)]"))):
                b += 1
            out.setdefault((a, min(n, b + 1)), []).append(h)
        return out

    def context(self, words: list[str], own: list[tuple[int, int, str, bool]], at: list[int]) -> set[str]:
        """The words and pairs of words of a passage, with obfuscated terms by their tag."""
        hidden = {i for h, i in zip(own, at, strict=True) if h[3]}
        plain = ["<hidden>" if i in hidden else w for i, w in enumerate(words)]
        return {*plain, *map(" ".join, zip(plain, plain[1:], strict=False))}

    def parts(self, text: str | None) -> tuple[str, str, list, Iterator]:
        """The text, its lower case, all hits, and each passage with its words and the words that hits stand at."""
        text = text or ""
        low = text.lower()
        if len(low) != len(text):
            text = low
        hits = self.hits(low)

        def each():
            for (a, b), own in self.passages(low, hits).items():
                tokens = [(m.start() + a, m[0]) for m in _TOKEN.finditer(low[a:b])]
                at = [max(0, sum(p <= h[0] for p, _ in tokens) - 1) for h in own]
                yield a, b, own, tokens, at

        return text, low, hits, each()

    def terms(self, text: str | None) -> set[str]:
        """What the learnt lexicon counts once per document."""
        return set().union(*(self.context([w for _, w in tokens], own, at) for _, _, own, tokens, at in self.parts(text)[3]))

    def features(self, text: str | None) -> np.ndarray:
        """A row of features for each kind."""
        text, low, hits, each = self.parts(text)
        n_words = low.count(" ") + low.count("\n") + 1
        out = np.zeros((len(KINDS), len(FEATURES)))
        out[:, 12] = -9.0
        counts = {tag: 0 for tag in ("insult", "sexual", "demeaning", "expelling", "threat", "explicit", "silencing", "adjective")}
        for h in hits:
            counts[h[2]] += 1
        for a, b, own, tokens, at in each:
            part, raw = low[a:b], text[a:b]
            words = [t for _, t in tokens]
            address = [i for i, t in enumerate(words) if t in self.address or t.split("-")[-1] in ("vous", "toi")]
            groups = [i for i, (p, t) in enumerate(tokens) if t in self.groups or (i and len(t) > 3 and text[p].isupper() and t.endswith(("i", "ish", "folk", "ians", "ese", "er", "s")))]
            spots: dict[str, list[int]] = {}
            for h, i in zip(own, at, strict=True):
                spots.setdefault(h[2], []).append(i)
            adjectives = spots.get("adjective", [])
            reported = bool(_REPORTED.search(part))
            bracketed = float(a > 0 and low[a - 1] in "([")
            exclaims = part.count("!") / max(1, len(words))
            capitals = sum(map(str.isupper, raw)) / max(1, len(raw))
            context = self.context(words, own, at)
            for k, kind in enumerate(KINDS):
                terms = spots.get(_TERMS[kind], [])
                phrases = [i for tag in _PHRASES[kind] for i in spots.get(tag, [])]
                f = out[k]
                if terms or phrases or (kind != "sexual" and adjectives):
                    odds = [self.odds[t][k] for t in context if t in self.odds]
                    f[12] = max(f[12], sum(odds))
                    f[13] = max(f[13], sum(odds) / max(1, len(odds)))
                    f[15], f[16] = max(f[15], capitals), max(f[16], exclaims)
                    f[18] = max(f[18], bracketed)
                    f[17] += sum(h[3] for h in own if h[2] == _TERMS[kind])
                    f[14] += sum(h[1] - h[0] > 3 and text[h[0] : h[1]].isupper() for h in own if h[2] == _TERMS[kind])
                if reported:
                    f[11] += len(terms) + len(phrases)
                    continue
                f[2] = max(f[2], _near(terms, address))
                f[3] = max(f[3], _near(terms, adjectives))
                f[4] = max(f[4], _near(terms, groups))
                f[5] = max(f[5], _near(adjectives, groups))
                f[6] = max(f[6], len(phrases))
                f[7] = max(f[7], _near(phrases, address))
                f[8] = max(f[8], _near(phrases, groups))
                f[9] = max(f[9], len(terms))
                f[10] = max(f[10], len(adjectives))
        for k, kind in enumerate(KINDS):
            out[k, 0] = 1000 * counts[_TERMS[kind]] / n_words
            out[k, 1] = 1000 * sum(counts[p] for p in _PHRASES[kind]) / n_words
        out[:, 19:] = (_capitals(text, low) / max(1, len(text)), text.count("!") / n_words, sum(h[3] for h in hits) / n_words, np.log1p(n_words))
        return out


class Boosted:
    """Boosted trees for weighted soft labels, from a constant, and an isotonic calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, rate: float = 0.2, depth: int = 3, least: float = 5, ridge: float = 2.0, bins: int = 32):
        share = float(np.clip((y * weight).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3))
        self.start, self.trees = math.log(share / (1 - share)), []
        self.ridge, self.least = ridge, least
        raw = np.full(len(x), self.start)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) if np.ptp(x[:, j]) == 0 else self._cuts(x[:, j], bins) for j in range(x.shape[1])]
        codes = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-3)
            tree = self._grow(codes, cuts, g, h, weight, np.ones(len(x), bool), depth, rate)
            if not isinstance(tree, tuple):
                break
            self.trees.append(tree)
            raw = raw + self._tree(x, tree)
        self.steps = self._isotonic(raw, y, weight)

    @staticmethod
    def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
        """Quantiles of all values and of those that differ from the commonest, which most documents have."""
        kinds, n = np.unique(v, return_counts=True)
        rest = v[v != kinds[n.argmax()]]
        return np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, bins)[1:-1]), np.quantile(rest, np.linspace(0, 1, bins)), [kinds[n.argmax()]]]))[:-1]

    def _grow(self, codes, cuts, g, h, weight, rows, depth, rate):
        """A node (feature, cut, low, high), or the value of a leaf."""
        gs, hs, ws = g[rows].sum(), h[rows].sum(), weight[rows].sum()
        best, found = 0.5, None
        for j, own in enumerate(cuts if depth else ()):
            if not len(own):
                continue
            gl, hl, wl = (np.cumsum(np.bincount(codes[j][rows], v[rows], len(own) + 1))[:-1] for v in (g, h, weight))
            gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
            gain[(wl < self.least) | (ws - wl < self.least)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (j, k)
        if found is None:
            return rate * gs / (hs + self.ridge)
        j, k = found
        low = codes[j] <= k
        return j, float(cuts[j][k]), self._grow(codes, cuts, g, h, weight, rows & low, depth - 1, rate), self._grow(codes, cuts, g, h, weight, rows & ~low, depth - 1, rate)

    @staticmethod
    def _tree(x, tree):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, c, low, high = tree
        out = np.zeros(len(x))
        side = x[:, j] <= c
        out[side], out[~side] = Boosted._tree(x[side], low), Boosted._tree(x[~side], high)
        return out

    @staticmethod
    def _isotonic(raw, y, weight):
        """Steps of a non-decreasing fit by pooling; pseudo-observations at either end steady it."""
        s = np.concatenate([raw, np.linspace(-6, -2, 9), np.linspace(2, 6, 9)])
        t = np.concatenate([y, np.zeros(9), np.ones(9)])
        w = np.concatenate([weight, np.full(18, 2.0)])
        order = np.argsort(s, kind="stable")
        blocks: list[list[float]] = []
        for a, b, c in zip(s[order], t[order], w[order], strict=True):
            blocks.append([b * c, c, a])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                top = blocks.pop()
                blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], top[2]]
        return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        for t in self.trees:
            raw += self._tree(x, t)
        ends, values = self.steps
        return values[np.minimum(np.searchsorted(ends, raw, "left"), len(values) - 1)]


class Model:
    """The learnt lexicon and a fitted model per kind; None where a kind has no opinions."""

    def __init__(self, learnt: tuple[dict[str, np.ndarray], np.ndarray], boosted: list[Boosted | None]):
        self.learnt, self.boosted = learnt, boosted


def learn_lexicon(own: DataFrame, max_terms: int = 50_000) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Words and pairs of words near lexicon terms with the flagged opinions per kind and the clean ones of their documents.

    own: ``text, fold`` and the opinions of labelled documents. Kept are the ``max_terms`` terms of most opinions, a bound
    of the model.
    """
    names = [*KINDS, "clean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            terms = pa.array([sorted(scanner.terms(t)) for t in b.column(0).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([terms, *b.columns[1:]], names=["terms", *b.schema.names[1:]])

    rows = own.select("text", "fold", *names)
    found = rows.mapInArrow(run, "terms array<string>, fold int, " + ", ".join(f"{c} double" for c in names)).where("size(terms) > 0")
    per_fold = [F.sum(F.when(F.col("fold") == i, F.col(c)).otherwise(0.0)).alias(f"{c}{i}") for i in range(FOLDS) for c in names]
    total = sum((F.col(f"{c}{i}") for i in range(FOLDS) for c in names), F.lit(0.0))
    counts = found.withColumn("term", F.explode("terms")).groupBy("term").agg(*per_fold).withColumn("n", total)
    kept = counts.where(F.col("n") >= LEARNT_DOCS).orderBy(F.col("n").desc(), "term").limit(max_terms).collect()
    sums = found.agg(*per_fold).first()

    def table(r) -> np.ndarray:
        return np.array([[r[f"{c}{i}"] or 0.0 for c in names] for i in range(FOLDS)])

    return {r["term"]: table(r) for r in kept}, table(sums)


def opinions(labels: DataFrame) -> DataFrame:
    """``doc_id`` with the opinions for each kind and those for none."""
    one = F.col("flagged") == 1
    return labels.where("flagged is not null and doc_id is not null").groupBy("doc_id").agg(*(F.sum(F.when(one & (F.col("kind") == k), 1.0).otherwise(0.0)).alias(k) for k in KINDS), F.sum(F.when(one, 0.0).otherwise(1.0)).alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labels: int = 20_000) -> Model:
    """The model from the opinions ``doc_id, flagged, kind`` on at most ``max_labels`` documents.

    The labelled documents, of which there are that many at most, are written once and read by both steps of learning.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    names = [*KINDS, "clean"]
    sample = opinions(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).checkpoint()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")).checkpoint()
    learnt = learn_lexicon(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(learnt, i) for i in range(FOLDS)]
        for b in batches:
            rows = [scanners[i].features(t).ravel().tolist() for t, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(rows, pa.list_(pa.float64()))], names=[*names, "x"])

    given = own.orderBy("doc_id").select("text", "fold", *names)
    rows = given.mapInArrow(run, ", ".join(f"{c} double" for c in names) + ", x array<double>").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(KINDS), len(FEATURES))
    boosted: list[Boosted | None] = []
    for k, kind in enumerate(KINDS):
        yes = np.array([r[kind] for r in rows])
        no = np.array([r["clean"] + OTHER_KIND * sum(r[o] for o in KINDS if o != kind) for r in rows])
        some = yes + no > 0
        boosted.append(Boosted(x[some, k], (yes / np.maximum(yes + no, 1e-9))[some], (yes + no)[some]) if some.any() else None)
    return Model(learnt, boosted)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document's ``doc_id`` and columns ``keep``, with a score between 0 and 1 for each kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value.learnt)
        for b in batches:
            x = np.array([scanner.features(t) for t in b.column(n).to_pylist()]).reshape(b.num_rows, len(KINDS), len(FEATURES))
            scores = [pa.nulls(b.num_rows, pa.float64()) if m is None else pa.array(m.score(x[:, k])) for k, m in enumerate(shared.value.boosted)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *scores], names=["doc_id", *keep, *KINDS])

    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("text"))
    schema = rows.drop("text").schema
    for k in KINDS:
        schema = schema.add(k, "double")
    return rows.mapInArrow(run, schema)
