"""Sentence boundaries across languages and scripts.

Method: scripts without spaces are segmented by a lattice of dictionary words, over the whole run that a gap stands in;
gaps (line ends, spaces, quotations and brackets that close) are then classified by the last word before the gap, a
final particle or one that needs more to follow, and the opening word behind it; a word that lies across a line end
joins the lines. The dictionary is made of function words and the pieces of a public tokenizer's vocabulary, whose file
is a parameter. For spaced scripts every dot that is not settled by what surrounds it is a node of a lattice with three
readings, end, abbreviation and ordinal, scored by what stands before and behind it; the best path through a run of
dots decides. Other stops of spaced scripts settle themselves, unless they are inside a quotation or bracket.

The rules run on the consistent form of the text (see ``canonical``); places refer to the original. Texts are scanned
where they lie; only the places found are shuffled, so that deliveries made twice count once.

Defined results: null and blank texts have no sentence; a text without any stop is one unit per line; places count
code points; every visible character belongs to exactly one unit; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.canonical import canonical_with_places

#: Abbreviations that need something to follow, and those that may end a sentence; lower case, without the last dot.
NEVER = set(
    """mr mrs ms messrs dr prof st rt hon rev gen col capt lt sgt gov sen rep no nos vol fig p pp approx e.g i.e vs cf viz resp est dept apt tel ext sq mt ft jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun
    z.b u.a d.h o.ä s.o s.u nr abs art ziff kap bzw ca evtl ggf inkl zzgl sog vgl str hr fr frl dipl ing geb
    m mm mme mlle mmes sté env av bd boul éd réf chap n tél cie pr
    ud uds vd sr sra srta sres dra dña núm pág págs aprox avda cap tlf lic
    см стр г-н г-жа т.е ул д-р им рис гл п тел κ κα κος δρ αρ σελ π.χ डॉ श्री د أ م""".split()
)
MAYBE = set("""etc inc ltd co corp bros jr a.m p.m u.n u.s u.k e.u usw u.s.w gmbh s.a s.l s.a.s s.r.l etc ave rd blvd т.д т.п д г гг руб коп тыс κ.λπ κ.ά λπ δηλ mio mrd""".split())
#: Of NEVER, those that are words or stand at a sentence's end as well, and those of them that need a number behind.
PLAIN = set("""no nos sun sat mon mar fig art vol cap est dept apt ft jan feb apr jun jul aug sep sept oct nov dec tue tues wed thu thur thurs fri рис им""".split())
NUMBERED = set("no nos fig art vol cap рис".split())
#: Of PLAIN, those that are abbreviations only with a capital.
CAPITALISED = set("sun sat mon mar".split())
CLOSINGS = re.compile(
    r"(?i)(kind|best|warm|many)? ?regards|yours( (sincerely|faithfully|truly))?|sincerely( yours)?|many thanks|thanks|thank you|cheers|mit freundlichen grüßen|mit freundlichem gruß|viele grüße|beste grüße|hochachtungsvoll|cordialement|bien à vous|salutations( distinguées)?|un cordial saludo|saludos( cordiales)?|atentamente|un saludo|с уважением|с наилучшими пожеланиями|με εκτίμηση|με φιλικούς χαιρετισμούς|مع التحية|مع خالص التحية|सादर|धन्यवाद|敬具|此致|敬礼|以上"
)
GREETINGS = re.compile(
    r"(?i)(dear|hello|hi|good (morning|afternoon|evening|day)|to whom|sehr geehrte|guten (tag|morgen|abend)|hallo|liebe|madame|monsieur|bonjour|bonsoir|cher|chère|buenos|buenas|estimad|hola|muy señor|здравствуйте|уважаем|добрый|καλημέρα|καλησπέρα|αγαπητ|αξιότιμ|السلام|مرحبا|السيد|नमस्ते|प्रिय|महोदय|ご担当|拝啓|尊敬|您好|你好|สวัสดี|เรียน)"
)
HEADINGS = re.compile(r"(?i)(complaint|re:|subject|request|question about|enquiry|inquiry|application|betreff|beschwerde|anfrage|antrag|objet|réclamation|demande|asunto|queja|reclamación|solicitud|жалоба|тема|θέμα|الموضوع|विषय)\b")
ENTRY = re.compile(r"(?:[-–—*•‣▪・·]|\(?\d{1,2}[.)]|[a-z]\))\s*\S")
#: Words that a line seldom ends in, unless it goes on.
OPEN_ENDED = set(
    """the a an of to in on at by for with from and or but that which who is are was were be my your his her our their this these as than near about into not
    der die das den dem des ein eine einen einem einer und oder aber in im am an auf bei mit von vom zu zum zur für über nach ist war sind wegen trotz laut seit
    le la les un une des du de d l et ou mais à au aux en dans sur pour par avec est sont que qui depuis
    el los las una unos y o pero del al en con por para es son está que desde según su mi
    и в на с у о за для до из по что как не ο η το του της των στο στη και με για από είναι να θα""".split()
)
#: Words that seldom stand behind an abbreviation within a sentence, but open one.
OPENERS = set(
    """The A An I We You He She It They This That These Those There My Our Your His Her Its Their Who What When Where Why How Which Is Are Was Were Do Does Did Can Could Will Would Shall Should Must May Might Have Has Had Please Nobody Somebody Everyone Everybody Nothing Something Everything No Not Yes Some Many Most All Both Each Every Another One Two Three Following According Compared Under After Before Since Once While Although Though Because If Unless Until With Without As To From For In On At By Of And But Or So Yet Then Thus Now Here Today Yesterday Tomorrow However Therefore Also See Let Thank Thanks
    Der Die Das Ein Eine Einen Einem Einer Wir Ich Er Es Sie Ihr Du Man Wann Wer Was Wie Wo Warum Weshalb Bitte Niemand Jemand Jeder Jede Alle Viele Einige Kein Keine Über Unter Nach Vor Seit Mit Ohne Laut Für Gegen Bei Von Zu Meine Mein Unser Unsere Dieser Diese Dieses Am Im In An Auf Als Wenn Weil Da Dann Danach Deshalb Aber Und Oder Auch Heute Gestern Morgen Hier Dort Ist Sind War Hat Haben Kann Können
    Le La Les L'on Un Une Des Du Nous Je Il Elle Ils Elles On Vous Tu Ce Cet Cette Ces Quand Qui Que Quoi Où Comment Pourquoi Combien Veuillez Personne Rien Chaque Tous Toutes Selon Comme Encore Après Avant Depuis Avec Sans Pour Par Sur Dans En À Au Aux Mon Ma Mes Notre Nos Votre Vos Son Sa Ses Leur Leurs Mais Et Ou Donc Or Car Puis Ensuite Alors Aussi Voir Merci Est Sont Était
    El Los Las Una Unos Unas Nuestra Nuestro Mi Mis Su Sus Tu Yo Él Ella Ellos Nosotros Usted Ustedes Según Nadie Nada Cada Todos Todas Este Esta Estos Estas Ese Esa Eso Esto Cuando Cuándo Quién Qué Cómo Dónde Por Para Con Sin Desde Hasta Después Antes Como Me Se Le Les Lo De Del Al Si No Sí Pero Y O Entonces También Además Véase Gracias Hay Es Son Era Hoy Ayer Mañana Hace Hacen
    Мы Я Он Она Оно Они Вы Ты Это Этот Эта Эти Тот Та Те Когда Кто Что Где Как Почему Зачем Никто Ничто Все Всё Каждый Мой Моя Мои Меня Мне Нам Нас Наш Наша Наши Ваш Его Её Их В На С У К По Из От До Для За Но И А Или Если Потом Затем Также Пожалуйста Сегодня Вчера Завтра См Нет Да
    Ο Η Το Οι Τα Ένας Μια Ένα Εγώ Εμείς Εσείς Αυτός Αυτή Αυτό Αυτοί Πότε Ποιος Ποια Τι Πού Πώς Γιατί Κανείς Κανένας Όλοι Κάθε Με Σε Στο Στη Στην Για Από Και Αλλά Ή Αν Όταν Μετά Πριν Επίσης Σήμερα Χθες Αύριο Μου Μας Σας Θα Να Δεν Παρακαλώ""".split()
)
#: Words before a number with a dot that make it an ordinal.
ORDINAL_BEFORE = set("am der die das dem den des vom zum zur im ab bis seit jeden nächsten letzten dritten und".split())

# Function words of the lattice for scripts without spaces: particles, endings, pronouns, question words, verbs of saying.
JA = "です ます ません でした ました ましょう ください ない なかった た だ だった か ね よ さ ぞ わ な は が を に へ と で も の や から まで より ので のに けど けれど ながら が、 そう という といった って とのこと との こと もの ため まだ もう また 様 さん 私 僕 彼 彼女 あなた ここ そこ あそこ これ それ あれ あの その この どこ どれ どの いつ なに なぜ どう 何 誰 する した して いる います いた ある あります あった なる なり いい よい とても".split()
JA_FINAL = set("です ます ません でした ました ましょう ください ない なかった た だ だった か ね よ ぞ わ 様 した いた あった います あります".split())
JA_OPEN = set("は が を に へ と で も の や から まで より ので のに けど けれど ながら という といった って とのこと との".split())
ZH = "了 吗 嗎 吧 呢 啊 啦 的 地 得 是 在 和 与 與 或 把 被 从 從 到 对 對 给 給 向 跟 为 為 我 你 您 他 她 它 我们 我們 你们 你們 他们 他們 她们 这 這 那 这个 這個 那个 那個 这句 這句 这些 這些 什么 什麼 谁 誰 哪里 哪裡 怎么 怎麼 为什么 為什麼 请 請 会 會 能 要 想 还 還 又 也 都 就 才 已经 已經 没有 沒有 不 很 说 說 问 問 道 答 喊 叫 写 寫 回答 表示".split()
ZH_FINAL = set("了 吗 嗎 吧 呢 啊 啦 的".split())
ZH_OPEN = set("是 在 和 与 與 或 把 被 从 從 到 对 對 给 給 向 跟 为 為 请 請 会 會 的 我 你 他 她".split())
TH = "ค่ะ ครับ คะ นะ นะคะ นะครับ แล้ว ไหม ใช่ไหม อยู่ ด้วย เลย สิ ให้ คือ ที่ เป็น จาก และ หรือ ของ ใน กับ ว่า แต่ เพราะ ถ้า ซึ่ง โดย เพื่อ ได้ ไม่ มี ไม่มี ใคร อะไร เมื่อไหร่ ทำไม อย่างไร ที่ไหน ยัง มา ไป จะ กำลัง เคย ต้อง ควร เรา ฉัน ผม ดิฉัน เขา เธอ คุณ มัน ชื่อ นี้ นั้น ทุก หลาย อีก".split()
TH_OPEN = set("คือ ที่ เป็น จาก และ หรือ ของ ใน กับ ว่า แต่ เพราะ ถ้า ซึ่ง โดย เพื่อ ชื่อ".split())
#: Words behind a closed quotation or bracket that go on with its sentence: particles, who spoke, what was meant.
GOES_ON = {"ja": JA_OPEN | {"そう", "です", "でした", "だ"}, "zh": set("的 是 了 这 這 那 这句 這句 这个 這個 这些 這些 他 她 我 你 他们 他們 她们 我们 我們 说 說 问 問 道 答 喊 叫 回答 表示 就 也 都 等".split()), "th": TH_OPEN}

#: A public tokenizer's vocabulary (a base64 piece and its rank a line); on every machine, as is the tokenizer of ``packing``.
DICTIONARY = os.environ.get("TEXTLOOM_DICTIONARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def dictionary(path: str = DICTIONARY) -> list[str]:
    """The pieces of two characters or more of a vocabulary that are wholly in a spaceless script; none without a file."""
    if not path or not os.path.exists(path):
        return []
    out = []
    with open(path, "rb") as f:
        for line in f:
            if not line.strip():
                continue
            piece = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip()
            if len(piece) > 1 and _SPACELESS.fullmatch(piece):
                out.append(piece)
    return out


def lattice(text: str, words: set[str], longest: int) -> list[str]:
    """The best path of dictionary words through a text: as few unknown characters as possible, then as few words."""
    n = len(text)
    best: list[tuple[int, int, int]] = [(0, 0, 0)] + [(10**9, 0, 0)] * n
    for i in range(n):
        bad, count, _ = best[i]
        best[i + 1] = min(best[i + 1], (bad + 1, count + 1, i))
        for j in range(i + 1, min(n, i + longest) + 1):
            if text[i:j] in words:
                best[j] = min(best[j], (bad, count + 1, i))
    out, j = [], n
    while j:
        i = best[j][2]
        out.append(text[i:j])
        j = i
    return out[::-1]


class Segmenter:
    """Words of spaceless runs by their best path, and what they say about a gap."""

    def __init__(self, pieces: list[str]):
        words = {"ja": {*JA}, "zh": {*ZH}, "th": {*TH}}
        for p in pieces:
            words["th" if _THAI.match(p) else "ja" if _KANA.search(p) else "zh"].add(p)
        words["ja"] |= {p for p in words["zh"] if p in pieces}  # Japanese writes such words too
        self.words = {k: (w, max(map(len, w))) for k, w in words.items()}
        self.segment = lru_cache(maxsize=20_000)(self._segment)

    def _segment(self, kind: str, run: str) -> tuple[str, ...]:
        return tuple(lattice(run, *self.words[kind]))

    @staticmethod
    def kind(before: str, behind: str) -> str:
        run = before + behind
        return "th" if _THAI.search(run) else "ja" if _KANA.search(run) else "zh"

    @staticmethod
    def _runs(text: str, i: int, j: int) -> tuple[str, str]:
        """The whole spaceless runs that end at i and begin at j."""
        a, b, n = i, j, len(text)
        while a and _SPACELESS.match(text, a - 1):
            a -= 1
        while b < n and _SPACELESS.match(text, b):
            b += 1
        return text[a:i], text[j:b]

    def goes_on(self, text: str, i: int, j: int) -> bool:
        """Whether the gap text[i:j], which has no stop, is within a sentence."""
        before, behind = self._runs(text, i, j)
        if not before and not behind:
            return False
        kind = self.kind(before, behind)
        last = (self.segment(kind, before) or ("",))[-1]
        first = (self.segment(kind, behind) or ("",))[0]
        if kind == "th":
            return last in TH_OPEN
        if before and behind and last not in (JA_FINAL if kind == "ja" else ZH_FINAL):
            at = 0
            for w in self.segment(kind, before + behind):
                if at < len(before) < at + len(w):
                    return True  # a word lies across the gap
                at += len(w)
        final, opening = (JA_FINAL, JA_OPEN) if kind == "ja" else (ZH_FINAL, ZH_OPEN)
        return last in opening or (last not in final and first in (JA_OPEN if kind == "ja" else ZH_FINAL))

    def after_closing(self, text: str, k: int) -> bool:
        """Whether the word at k goes on with the sentence of a quotation or bracket that closes before it."""
        behind = self._runs(text, k, k)[1]
        kind = self.kind(text[max(0, k - 12) : k], behind)
        words = self.segment(kind, behind)
        return bool(words) and words[0] in GOES_ON[kind]


_KANA = re.compile("[ぁ-ヿ]")
_HAN = re.compile("[一-鿿㐀-䶿]")
_THAI = re.compile("[ก-๛]")
_SPACELESS = re.compile("[ぁ-ヿ一-鿿㐀-䶿ก-๛]+")
_OPENING, _CLOSING = "«“„‘(「『（【《〈[{", "»”“’)」』）】》〉]}\"'"
_PAIRS = {"(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "«": "»", "„": "“”", "“": "”", "【": "】", "《": "》", "‹": "›"}
#: Stops of their own script that end a sentence whatever follows: also Armenian, Urdu, Ethiopic, Burmese, Khmer, Tibetan.
_OWN = "।॥؟։۔።၊။។།"
_STOPS = re.compile(rf"[.!?…。！？．;{_OWN}]+")
_MARKS = re.compile(r"\n\n|[\"()（）\[\]「」『』«»„“”【】《》‹›]")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
#: A dot with a word behind it, and what ends a run of such dots: another stop, a line end, a mark that closes.
_DOT = re.compile(r"(?<![.!?])\.[ \t]+([^\s,;:)—–]\S*)")
_SETTLED = re.compile(rf"[!?…。！？．;\n{_OWN}]|\.[»”“’)\]}}\"']")
#: Where something has to be decided.
_PLACES = re.compile(rf"[\n.!?…。！？．;{_OWN}]| (?=[ก-๛])")
_INITIALS = re.compile(r"(?:[^\W\d_]{1,3}\.)+[^\W\d_]{1,3}")
_NEXT = re.compile(r"\s*(\S+)")
# The score of a reading that one rule settles, and what an end right behind an end costs.
FIRM, SHORT = 8.0, 0.5


class Quoted:
    """Quotations and brackets that are closed: how deep a place is in them, and where the outermost opened."""

    def __init__(self, text: str):
        stack: list[tuple[int, str]] = []
        self.spans: list[tuple[int, int]] = []
        for m in _MARKS.finditer(text):
            i, c = m.start(), m[0]
            if stack and c in stack[-1][1]:
                self.spans.append((stack.pop()[0], i))
            elif c == '"':
                if any(s[1] == '"' for s in stack):
                    while stack[-1][1] != '"':
                        stack.pop()
                    self.spans.append((stack.pop()[0], i))
                else:
                    stack.append((i, '"'))
            elif c in _PAIRS:
                stack.append((i, _PAIRS[c]))
            elif len(c) > 1:
                stack.clear()
        self.spans.sort()
        self.starts = [a for a, _ in self.spans]
        self.reach: list[int] = []  # how far spans up to here reach, so that looking back can stop
        for _, b in self.spans:
            self.reach.append(max(b, self.reach[-1]) if self.reach else b)

    def around(self, i: int) -> int:
        """Where the outermost span around i opened, or -1."""
        k = bisect_right(self.starts, i) - 1
        found = -1
        while k >= 0 and self.reach[k] > i:
            if self.spans[k][1] > i:
                found = self.starts[k]
            k -= 1
        return found


def _ends(text: str, i: int, j: int, begun: int, quoted: Quoted, read: dict[int, bool], segmenter: Segmenter) -> int:
    """The end of the sentence whose stop is text[i:j], or 0 if it goes on."""
    stop = text[i:j]
    n = len(text)
    if stop[0] == ";" and not ("Ͱ" <= text[i - 1 : i] <= "Ͽ" or "ἀ" <= text[i - 1 : i] <= "῿"):
        return 0
    k = j
    while k < n and text[k] in _CLOSING and quoted.around(k - 1) >= 0:
        k += 1
    if k < n and quoted.around(k - 1) >= 0:
        return 0
    closed = k > j
    wide = stop[-1] in "。！？．" or stop[-1] in _OWN
    if k >= n:
        return k
    m = k
    while m < n and text[m] in " \t":
        m += 1
    if m >= n:
        return m and k
    if text[m] == "\n":
        if "." not in stop or wide:
            return k
        rest = text[m:].lstrip()
        if closed or _BLANK.match(text, m) or not rest:
            return k
        return 0 if _abbreviated(text, i, rest[0], rest.split()[0], begun, read) else k
    behind = text[m]
    if closed:
        # a quotation or bracket in a running sentence, or one that is followed by who said it
        opened = quoted.around(j - 1)
        started = opened <= begun + 1 or text[begun:opened].strip(" ¿¡-") == ""
        if _SPACELESS.match(behind):
            return 0 if not started or segmenter.after_closing(text, m) else k
        if not _cased(behind) and behind not in "«“„\"(¿¡":
            return 0 if m == k or not behind.isdigit() else k
        if m == k and stop[0] in "。！？":
            return 0
        if behind.islower() or behind in "—–-,;:":
            return 0
        return k if started or stop[0] != "…" else 0
    if wide:
        return 0 if behind in "、，,—–" or (behind in _CLOSING and behind not in _OPENING + "\"'") else k
    if m == k:
        # no space: only where a sentence was glued to the next
        if stop == "." and behind.isupper() and text[m + 1 : m + 2].islower():
            a = i
            while a > begun and not text[a - 1].isspace():
                a -= 1
            b = m
            while b < n and not text[b].isspace():
                b += 1
            word = text[a:i]
            if len(word) > 2 and word[-2:].islower() and "@" not in text[a:b] and "." not in word and not word.startswith(("www", "http")):
                return k
        if stop[0] in "!?" and (behind.isupper() or behind in "¿¡«“"):
            return k
        if (_HAN.match(behind) or _KANA.match(behind) or _THAI.match(behind)) and stop[0] in "!?":
            return k
        return 0
    if behind in ",;:)—–":
        return 0
    if stop.startswith("...") or stop[0] == "…":
        return 0 if behind.islower() or behind in "¿¡" else k
    if stop[0] in "!?;":
        return k
    b = m
    while b < n and not text[b].isspace():
        b += 1
    return 0 if _abbreviated(text, i, behind, text[m:b], begun, read) else k


def _cased(c: str) -> bool:
    return c.islower() or c.isupper()


def _scores(text: str, i: int, behind: str, next_word: str, begun: int) -> tuple[float, float, float]:
    """How well the dot at i reads as an end, as part of an abbreviation or initial, and as an ordinal's."""
    a = i
    while a > begun and not text[a - 1].isspace() and text[a - 1] not in "(«“„\"'’,/[":
        a -= 1
    word = text[a:i]
    low = word.lower()
    before = text[begun:a].split()
    bare = next_word.strip("«“„\"(¿¡.,:;!?»”)'")
    opener = bare in OPENERS
    spaced = (before[-1].lower() + low) if before and before[-1].endswith(".") else ""
    end, abbreviation, ordinal = (FIRM, 0.0, 0.0), (0.0, FIRM, 0.0), (0.0, 0.0, FIRM)
    if low in PLAIN and spaced not in NEVER:
        if not behind.isupper() and not opener:
            return abbreviation
        weight = 4.0 if opener else 0.0
        if low in NUMBERED and not any(c.isdigit() for c in bare) and (word.isupper() or not bare.isupper()):  # capitals are a number or begin one
            weight += 4.0
        if low in CAPITALISED and word.islower():
            weight += 4.0
        if before and before[-1].lower() in OPEN_ENDED and low in ("sun", "art", "fig"):
            weight += 2.0
        return weight, 3.0, 0.0
    if low in NEVER or spaced in NEVER:
        return abbreviation
    if low in MAYBE or spaced in MAYBE:
        if behind.islower() or behind.isdigit():
            return abbreviation
        if low in ("ave", "rd", "blvd", "co", "st", "u.s", "u.n", "u.k", "e.u") and not opener:
            return abbreviation
        return abbreviation if next_word.rstrip(".,").lower() in MAYBE else end
    if len(word) == 1 and word.isalpha():
        return abbreviation if behind.islower() or not opener or word.isupper() else end
    if word.isdigit() and len(word) <= 3 and before:
        if before[-1].lower() in ORDINAL_BEFORE and (behind.isalpha() or behind.isdigit()):
            return end if opener and before[-1].lower() in ("und", "bis") else ordinal
        if behind.islower():
            return ordinal if len(word) <= 2 else end
    if _INITIALS.fullmatch(word):
        return abbreviation if behind.islower() or not opener else end
    if low.endswith(("str", "pl")) and word[0].isupper() and behind.isdigit():
        return abbreviation  # a street and its number
    return end


def _abbreviated(text: str, i: int, behind: str, next_word: str, begun: int, read: dict[int, bool]) -> bool:
    """Whether the dot at i is part of an abbreviation, ordinal or initial, so that the sentence goes on.

    The dots from i to the next stop that settles itself are read together, each by the best path through their
    readings; whether the one before is an end decides what stands before the next. read keeps what was found.
    """
    if i in read:
        return read[i]
    nodes = [(i, behind, next_word)]
    hard = _SETTLED.search(text, i + 1)
    stop = hard.start() if hard else len(text)
    nodes += [(m.start(), m[1][0], m[1]) for m in _DOT.finditer(text, i + 1, stop)]
    paths: list[list[tuple[float, int]]] = []
    for k, (at, first, word) in enumerate(nodes):
        if not k:
            paths.append([(v, -1) for v in _scores(text, at, first, word, begun)])
            continue
        last = nodes[k - 1][0]
        fresh, on = _scores(text, at, first, word, last + 1), _scores(text, at, first, word, begun)
        short = SHORT if at - last <= 4 else 0.0
        paths.append([max((paths[-1][p][0] + (fresh if p == 0 else on)[r] - (short if p == r == 0 else 0.0), -p) for p in range(3)) for r in range(3)])
        paths[-1] = [(v, -p) for v, p in paths[-1]]
    r = max(range(3), key=lambda x: (paths[-1][x][0], -x))
    for k in range(len(nodes) - 1, -1, -1):
        read[nodes[k][0]] = r != 0
        r = paths[k][r][1]
    return read[i]


def sentences(text: str | None, segmenter: Segmenter | None = None) -> list[tuple[int, int]]:
    """Start and end (exclusive) of the sentences of a text, in order."""
    if not text or not text.strip():
        return []
    segmenter = segmenter or _segmenter()
    form, start, end = canonical_with_places(text)
    n = len(form)
    quoted = Quoted(form)
    out: list[tuple[int, int]] = []
    read: dict[int, bool] = {}
    begun = 0

    def close(stop: int) -> None:
        nonlocal begun
        a, b = begun, stop
        while a < b and form[a].isspace():
            a += 1
        while b > a and form[b - 1].isspace():
            b -= 1
        if b > a:
            first = max(start[a], out[-1][1] if out else 0)  # a mark on a stop stays with the stop
            if end[b - 1] > first:
                out.append((first, end[b - 1]))
        begun = stop

    i = 0
    while m := _PLACES.search(form, i):
        i = m.start()
        while begun < i and form[begun].isspace():
            begun += 1
        c = form[i]
        if c == "\n":
            unit = form[begun:i].strip()
            behind = _NEXT.match(form, i + 1)
            if not unit or not behind:
                i += 1
                continue
            whole = unit == form[form.rfind("\n", 0, i) + 1 : i].strip()
            at = behind.start(1)
            if (
                _BLANK.match(form, i)
                or ENTRY.match(unit)
                or ENTRY.match(form, at)
                or (whole and (CLOSINGS.fullmatch(unit.rstrip(" ,!")) or (GREETINGS.match(unit) and unit[-1] in ",:：،、!") or (HEADINGS.match(unit) and len(unit.split()) <= 8) or (GREETINGS.match(unit) and len(unit) < 14)))
                or _line_ends(unit, form, at, segmenter)
            ):
                close(i)
        elif c == " ":
            if begun < i and (_THAI.match(form, i - 1) or _THAI.search(form, begun, i)) and not segmenter.goes_on(form, i, i + 1):
                close(i)
        else:
            j = _STOPS.match(form, i).end()
            e = _ends(form, i, j, begun, quoted, read, segmenter)
            if e:
                close(e)
            i = max(e, j)
            continue
        i += 1
    close(n)
    return out


@lru_cache(maxsize=2)
def _segmenter(path: str = DICTIONARY) -> Segmenter:
    return Segmenter(dictionary(path))


def _line_ends(unit: str, form: str, at: int, segmenter: Segmenter) -> bool:
    """Whether a line that lacks its stop ends a unit at a single line end; at: where the next line begins."""
    first = form[at]
    last = unit.rsplit(None, 1)[-1]
    tail = unit[-1]
    if _SPACELESS.match(tail) or _SPACELESS.match(first):
        edge = at
        while form[edge - 1].isspace():
            edge -= 1
        return not segmenter.goes_on(form, edge, at)
    if first.islower() or first.isdigit() or first in ",;:)»”—–":
        return False
    if last.lower().strip("'’") in OPEN_ENDED or tail in ",(«“„":
        return False
    if last.endswith("."):
        return False  # an abbreviation, or the stop would have ended the unit
    if tail == ":" and last == unit:
        return False
    return last.lower() not in NEVER and last not in ("Frau", "Herr", "Herrn", "Señor", "Señora", "Monsieur", "Madame", "Господин", "Госпожа", "Κύριος", "Κυρία") or first not in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def find_sentences(df: DataFrame, key: str, text: str, vocabulary: str = DICTIONARY) -> DataFrame:
    """``key, start_char, end_char`` of every sentence, each once; vocabulary: the file of the lattice's dictionary."""
    pieces = dictionary(vocabulary)  # at most some thousand short words, as many as the vocabulary has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(pieces)
        for b in batches:
            at, starts, ends = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for s, e in sentences(t, segmenter):
                    at.append(k)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "start_char", "end_char"])

    rows = df.where(F.col(text).isNotNull()).select(key, text)
    return rows.mapInArrow(run, rows.select(key).schema.add("start_char", T.IntegerType()).add("end_char", T.IntegerType())).distinct()
