"""Defects of prompt and response pairs: empty, truncated, refusal, copy of the prompt, wrong language.

Method. Each response is read where it lies: what is left without markup and placeholders (empty), whether it breaks off (truncated),
how much of it is the prompt again (copy), and which language it and the prompt are in (wrong_language): by script, and within a script by
profiles of character trigrams that are trained on labelled texts.

Refusals show as templates. The clauses of a response are masked (words of the prompt, words that many prompts have, and numbers). Clauses that recur in very
many entries are common ones (courtesies); the first clause that is none is the opening, and a response is bare if nothing else is left. Openings are
hashed by MinHash, all pairs that share a band are verified, and the similar ones are closed into templates. A template is one of refusal,
whatever its words are, if it recurs across many prompts that no word relates, is mostly of words of its own and most of its responses are
bare: what is said to any prompt answers none. For wordings too rare to recur there is a second signal, a lexicon of ways to decline. A
response is a refusal if it is bare and its opening is of a template of refusal, or if all its sentences decline by the lexicon or are courtesies.

A pair gets one defect: the first that holds of empty, copy, refusal, wrong_language, truncated."""

from __future__ import annotations

import re as plain
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import regex as re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.llm.sentences import units
from spindrift.operators import extras
from spindrift.runtime import cut, small

#: Prompts across which a template recurs, at least, and their share of all entries (in large tables sentences recur by chance).
RECURRING, RECURRING_SHARE = 5, 5e-5
#: Share of the entries from which on a sentence is a common one.
COMMON_SHARE = 5e-4
#: The most masked places (half as many as words) and the least words of a template. Its prompts are related if a word is in more than RELATED of them, and that is more
#: than USUAL times its share of all prompts.
SLOTS, WORDS, RELATED, USUAL = 3, 3, 0.6, 3.0
#: Words of a shingle and the Jaccard similarity that two openings of a template are verified to have.
SHINGLE, SIMILAR = 5, 0.8

# ---- what is left -------------------------------------------------------------------------------------------------

_TAGS = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:nbsp|#160|#xa0|ensp|emsp|thinsp|zwnj|zwj|shy);?", re.S | re.I)
_FENCE = re.compile(r"```[^\n`]*\n?")
_VISIBLE = re.compile(r"[A-Za-z0-9]")
# Texts that stand for no answer.
_PLACEHOLDERS = frozenset(
    (
        "n/a|na|none|null|nil|nan|undefined|{}|[]|()|todo|tbd|tba|fixme|placeholder|empty|blank|no response|no answer|no output|no content|no reply|no data|no text"
        "|not available|not applicable|response|answer|response here|your answer here|answer goes here|insert answer here|lorem ipsum|keine antwort|leer|sin respuesta|vacío"
        "|pas de réponse|aucune réponse|vide|なし|無し|回答なし|未回答|无|無"
    ).split("|")
)
_VALUES = frozenset("null none {} [] nil".split())


def is_empty(response: str | None, query: str | None) -> bool:
    """Whether nothing is left beyond blanks, invisible characters, markup or a placeholder.

    A bare value that stands for nothing elsewhere (``null``, ``{}``) is an answer where the prompt asks for such a value."""
    if response is None:
        return True
    if len(response) > 80 and response.isascii() and not any(c in response for c in "<&`") and _VISIBLE.search(response):
        return False  # longer than any placeholder
    text = _FENCE.sub("", _TAGS.sub(" ", response))
    text = "".join(c for c in text if unicodedata.category(c)[0] not in "CZ" or c == " ").strip()
    bare = text.strip(" \t*_~`#>|\"'“”«»[]().-–—…。、,:;/\\")
    if text and not any(c.isalnum() or unicodedata.category(c) in ("So", "Sm") for c in text):
        return text not in ("{}", "[]") or not _asks_value(query)
    if not bare:
        return True
    low = bare.lower()
    if low in _VALUES and _asks_value(query):
        return False
    return low in _PLACEHOLDERS


def _asks_value(query: str | None) -> bool:
    return bool(query and re.search(r"json|yaml|\bvalue\b|\bwert\b|valeur|valor|値|yes or no|one word|just the|only the", query, re.I))


# ---- whether it breaks off ----------------------------------------------------------------------------------------

_END = re.compile(r"""[.!?…。！？｡．।॥؟۔]["'”»“’」』)）\]】*_`]*\Z""")
_ITEM = re.compile(r"\s*(?:[-*+•‣]|\(?\d{1,3}[.)])\s+\S")
_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "«": "»", "“": "”", "„": "“"}
_MARKS = re.compile("[" + re.escape("".join(_OPEN) + "".join(_OPEN.values())) + "]")
_CJK = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_CODE_LINE = re.compile(r"""\A(?:[\w.]+\(.*\);?|[./~]?[\w.-]*(?:/[\w.*-]+)+/?|\w+\s*[=:]\s*\S+|[\w.-]+\.\w{1,5}|https?://\S+|--?[\w-]+(?:[ =]\S+)*)\Z""")


def is_truncated(response: str) -> bool:
    """Whether a text that is not empty breaks off within a sentence, word, list item, bracket or code block."""
    text = (response if response.isascii() else "".join(c for c in response if unicodedata.category(c) != "Cf")).strip()
    if not text:
        return False
    if text.count("```") % 2:
        return True
    prose = re.sub(r"```.*?```", "\n", text, flags=re.S)
    prose = re.sub(r"`[^`\n]*`", "x", prose).strip()
    if _left_open(prose):
        return True
    if text.endswith("```") or not prose or text[0] in "{[" and text[-1] in "}]":
        return False
    last = prose[-1]
    if _END.search(prose):
        # a decimal that was cut at its point, where sentences end otherwise
        return last == "." and len(prose) > 1 and prose[-2].isdigit() and bool(_CJK.search(prose[-12:]))
    if last in ",;:、，；：-–—(（「“„«/&+=" and len(prose.split()) + len(_CJK.findall(prose)) > 2:
        return True
    lines = prose.splitlines()
    if _CODE_LINE.match(lines[-1].strip()) and len(lines[-1].split()) < 8:
        return False
    items = [x.strip() for x in lines if _ITEM.match(x)]
    if len(items) > 1 and _ITEM.match(lines[-1]) and not any(_END.search(x) for x in items):
        return False  # a list without periods
    found = units(prose)
    end = prose[found[-1][0] : found[-1][1]] if found else prose
    size = len(re.findall(r"[\p{L}\p{N}_'’.-]+", end)) if not _CJK.search(end) else len(_CJK.findall(end)) / 2
    return len(found) > 1 or size >= 4


def _left_open(text: str) -> bool:
    """Whether a bracket or quote that opens in the last sentence or block stays open."""
    stack: list[str] = []
    for c in _MARKS.findall(text):
        if stack and c == stack[-1]:
            stack.pop()
        elif c in _OPEN:
            stack.append(_OPEN[c])
        elif c in stack:
            while stack.pop() != c:
                pass
    return bool(stack)


# ---- the prompt again ---------------------------------------------------------------------------------------------

_LEAD = re.compile(r"\A\W*(?:answer|response|reply|a|antwort|réponse|respuesta|回答|答え|答|q|question|frage|pregunta|質問)\s*[:：]\s*", re.I)
_TOKEN = re.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]|[[\p{L}\p{M}\p{N}_]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]]+")


_ASCII_TOKEN = plain.compile(r"[a-z0-9_]+")


def tokens(text: str) -> list[str]:
    """The words of a text in lower case; single signs where no blanks part the words."""
    if text.isascii():
        return _ASCII_TOKEN.findall(text.lower())
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).lower())


def is_copy(response: str, query: str | None, alike: float = 0.8) -> bool:
    """Whether the response is the prompt, perhaps a few times and slightly altered, and nothing else."""
    if not query:
        return False
    asked, given = tokens(query), tokens(_LEAD.sub("", response))
    if len(asked) < 3 or not given:
        return False
    times = max(1, round(len(given) / len(asked)))
    want = asked * times
    if abs(len(given) - len(want)) > (1 - alike) * 2 * len(want) or times > 20:
        return False
    common = sum((Counter(given) & Counter(want)).values())
    if 2 * common / (len(given) + len(want)) < alike:
        return False
    if SequenceMatcher(None, given, want, autojunk=False).ratio() < alike:
        return False
    # a statement that answers in the words of the question is no copy of it
    question = query.rstrip().rstrip("\"'”»").endswith(("?", "？", "か。"))
    same_head = given[0] == asked[0] or given[:2] == asked[1:3] or given[1:3] == asked[:2]
    return same_head or not question


# ---- language -----------------------------------------------------------------------------------------------------

_SCRIPTS = [("ja", re.compile(r"[\p{Hiragana}\p{Katakana}]")), ("zh", re.compile(r"\p{Han}")), ("ko", re.compile(r"\p{Hangul}")), ("ru", re.compile(r"\p{Cyrillic}")), ("el", re.compile(r"\p{Greek}")), ("ar", re.compile(r"\p{Arabic}")), ("he", re.compile(r"\p{Hebrew}")), ("hi", re.compile(r"\p{Devanagari}")), ("th", re.compile(r"\p{Thai}"))]
# Names of languages, in the languages themselves.
_NAMES = {
    "en": "english englisch anglais inglés inglese 英語 英文",
    "de": "german deutsch allemand alemán tedesco ドイツ語 德语",
    "fr": "french französisch français francés francese フランス語 法语",
    "es": "spanish spanisch espagnol español castellano spagnolo スペイン語 西班牙语",
    "ja": "japanese japanisch japonais japonés giapponese 日本語 日语",
    "pt": "portuguese portugiesisch portugais portugués ポルトガル語",
    "it": "italian italienisch italien italiano イタリア語",
    "zh": "chinese chinesisch chinois chino 中国語 中文",
    "nl": "dutch niederländisch néerlandais neerlandés オランダ語",
    "ko": "korean koreanisch coréen coreano 韓国語",
    "ru": "russian russisch russe ruso ロシア語",
}
_NAMED = [(code, re.compile("|".join(rf"(?<!\p{{L}}){n}" if n.isascii() or n[0].isalpha() and ord(n[0]) < 0x500 else n for n in names.split()), re.I)) for code, names in _NAMES.items()]
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_CODED = plain.compile(r"(?<![!-~])[!-~]*(?:[_\d/]|[A-Za-z]-[A-Za-z]|\.[a-z])[!-~]*")
_NO_LETTERS = re.compile(r"[^\p{L}\p{M}\x1e]+")
_LETTERS = re.compile(r"\p{L}+")
# Codes of languages in other standards.
_CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "jpn": "ja", "zho": "zh", "chi": "zh", "hin": "hi", "tha": "th"}
#: Buckets of the trigrams; labelled texts of a language that the profiles are fitted on, at most; trigrams that a text must have, and the
#: difference of the mean log probabilities of two languages from which on one is told from the other.
BUCKETS, LABELLED, LEAST_GRAMS, MARGIN = 1 << 15, 400, 12, 0.25


def script(text: str) -> str | None:
    """The language or family that the script of most letters names; None for Latin and where no script prevails."""
    if text.isascii():
        return None
    letters = sum(map(len, _LETTERS.findall(text)))
    han = len(_SCRIPTS[1][1].findall(text))
    for code, pattern in _SCRIPTS:
        n = len(pattern.findall(text))
        if code == "ja" and n and n + han >= 0.3 * letters or code != "ja" and n and n >= 0.3 * letters:
            return code
    return None


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, bucket) of all trigrams of some texts, code and names with digits, dots or hyphens left out."""
    bare = [(_CODE.sub(" ", t) if "`" in t else t).replace("\x1e", " ").lower() for t in texts]
    joined = _NO_LETTERS.sub(" ", _CODED.sub(" ", "\x1e".join(["", *bare, ""])))
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = points == 0x1E
    number = np.cumsum(edge)[1:-1] - 1
    points = np.where(edge, 32, points)  # a text begins and ends with a blank
    with np.errstate(over="ignore"):
        mixed = ((points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA6B) + points[2:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    inside = ~edge[1:-1] & ((points[:-2] != 32) | (points[1:-1] != 32))
    return number[inside], (mixed >> np.uint64(49)).astype(np.int64)[inside]


class Profiles:
    """Trigram profiles of languages: log probabilities by bucket."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)).astype(np.float32)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams, mean log probability by language) of each text."""
        number, bucket = trigrams(texts)
        n = np.bincount(number, minlength=len(texts))
        total = np.zeros((len(texts), len(self.names)))
        for i in range(len(self.names)):
            total[:, i] = np.bincount(number, self.logs[bucket, i], minlength=len(texts))
        return n, total / np.maximum(n, 1)[:, None]


def fit_profiles(labelled: DataFrame) -> Profiles:
    """Profiles from texts (text, lang): of each language the LABELLED texts whose hashes are least.

    Labels in other codes are told; those that no text or few have do no harm, since a profile needs LEAST_GRAMS trigrams. Wrong labels
    are a minority of each language. The trigrams are counted where the texts lie; only counts by bucket come to the driver, at most BUCKETS
    of each language. Without labelled texts there are no profiles, and only scripts tell languages apart."""
    low = F.lower(F.trim("lang"))
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv]), low), F.regexp_extract(low, r"^([a-z]{2})(?:[-_].*)?$", 1))
    rows = labelled.where("text is not null and lang is not null").select(code.alias("code"), "text").where("code <> ''")
    first = W.partitionBy("code").orderBy(F.xxhash64("text"))
    rows = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, codes = batch.column("text").to_pylist(), batch.column("code").to_pylist()
            kept = [i for i, t in enumerate(texts) if script(t) is None]
            number, bucket = trigrams([texts[i] for i in kept])
            names = sorted(set(codes))
            of = np.array([names.index(codes[i]) for i in kept], np.int64)
            keys, n = np.unique((of[number] if len(number) else number) * BUCKETS + bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([names[k // BUCKETS] for k in keys.tolist()], pa.string()), pa.array(keys % BUCKETS), pa.array(n)], ["code", "bucket", "n"])

    found = rows.select("code", "text").mapInArrow(run, "code string, bucket bigint, n bigint").groupBy("code", "bucket").agg(F.sum("n").alias("n")).toArrow()
    codes = np.array(found.column("code").to_pylist(), object)
    names = sorted(set(codes.tolist()))
    counts = np.zeros((BUCKETS, len(names)))
    for i, name in enumerate(names):
        own = codes == name
        counts[found.column("bucket").to_numpy()[own], i] = found.column("n").to_numpy()[own]
    kept = [i for i in range(len(names)) if counts[:, i].sum() >= 1000]
    return Profiles([names[i] for i in kept], counts[:, kept])


def wrong_languages(profiles: Profiles, queries: list[str | None], responses: list[str]) -> list[bool]:
    """Whether each response is in another language than its prompt, and the prompt doesn't ask for that language."""
    (nq, q), (nr, r) = profiles.scores([x or "" for x in queries]), profiles.scores(responses)
    out = []
    for i, (query, response) in enumerate(zip(queries, responses)):
        if not query:
            out.append(False)
            continue
        asked, given = script(query), script(response)
        if asked is None and given is None:
            if len(profiles.names) < 2 or min(nq[i], nr[i]) < LEAST_GRAMS:
                out.append(False)
                continue
            a, b = int(q[i].argmax()), int(r[i].argmax())
            if a == b or q[i, a] - q[i, b] < MARGIN or r[i, b] - r[i, a] < MARGIN:
                out.append(False)
                continue
            given = profiles.names[b]
        elif asked == given or (asked is None and nq[i] < LEAST_GRAMS) or (given is None and nr[i] < LEAST_GRAMS):
            out.append(False)
            continue
        elif given is None:
            given = profiles.names[int(r[i].argmax())] if profiles.names else ""
        out.append(not any(code == given and name.search(query) for code, name in _NAMED))
    return out


# ---- refusals -----------------------------------------------------------------------------------------------------

# Ways to decline, and courtesies that may follow.
_DECLINES = re.compile(
    r"""\b(?:i|we)(?:['’]m|['’]re|\ am|\ are)?\b[^.!?]{0,60}?\b(?:can(?:no|['’])?t|can\ not|cannot|unable\ to|not\ able\ to|not\ (?:allowed|permitted|authori[sz]ed)|won['’]?t|will\ not|must\ not|must\ decline|have\ to\ (?:decline|refuse|pass)|must\ (?:pass|refuse)|(?:['’]d|would|['’]ll)?\ ?rather\ not|prefer\ not|refuse|decline)\b
    |\bi\ (?:don['’]t|do\ not)\ (?:have\ (?:enough\ )?(?:access|permission)|feel\ comfortable|comment|discuss)
    |isn['’]t\ something\ i\ can|not\ something\ i\ can|(?:guidelines|policy|policies|rules)\ (?:do(?:es)?\ not|don['’]t|doesn['’]t)\ (?:allow|permit)
    |outside\ (?:of\ )?what\ i|topic\ i\ (?:stay\ away|avoid|do\ not|don['’]t|can)|no\ answer\b[^.!?]*\bfrom\ me|not\ be\ appropriate\ for\ me|no\ can\ do|won['’]t\ (?:answer|guess|discuss)
    |\bich\b[^.!?]{0,60}\b(?:nicht|keine?n?|nichts|verweigern|ablehnen)\b|\b(?:darf|kann|möchte|muss|bin|werde)\ ich\b[^.!?]{0,60}\b(?:nicht|keine?n?|nichts|verweigern|ablehnen)\b
    |\b(?:muss|darf|kann|möchte|bin|werde)\b[^.!?]{0,40}\b(?:verweigern|ablehnen|nicht\ befugt)|\b(?:assistent\w*)\b[^.!?]{0,40}\bablehnen
    |\bje\ (?:ne|n['’])[^.!?]{0,60}\b(?:pas|rien|plus)\b|\bje\ (?:refuse|préfère\ ne\ pas|dois\ (?:décliner|refuser)|décline)|m['’]abstien\w*|m['’]est\ impossible|dois\ décliner|sort\ de\ ce\ que\ j
    |\bno\ (?:puedo|podemos|estoy\ autorizado|estoy\ en\ condiciones|me\ es\ posible|daré|voy\ a|debo|quiero)\b|\b(?:debo|tengo\ que|prefiero)\ (?:rechazar|abstenerme|declinar|no)|abstenerme|queda\ fuera\ de\ lo\ que|me\ niego
    |(?:お答え|回答|説明|お手伝い|対応|コメント|ご案内|お話し)(?:する(?:こと)?(?:が|は)|することは|は|が|を)?(?:でき(?:ません|かね)|いたしかね|しかね|控え)|控えさせて|お断り|扱えません|できかねます|辞退|お力になれません""",
    re.X | re.I,
)
_COURTESY = re.compile(
    r"""\A\W*(?:thank\ you|thanks|feel\ free|please\ (?:contact|ask|reach|try|consult)|is\ there\ anything|let\ me\ know|i\ hope|sorry|apologies|(?:my|i)\ apolog\w*|unfortunately|hmm|i['’]m\ sorry
    |danke|vielen\ dank|bitte|gerne?|es\ tut\ mir\ leid|entschuldigung|leider|merci|désolé|navré|n['’]hésitez|je\ suis\ désolé|malheureusement|gracias|lo\ siento|disculpe|por\ favor|no\ dude|por\ desgracia
    |ご了承|ご理解|申し訳|恐れ入り|残念|よろしく|何か)""",
    re.X | re.I,
)


_QUOTED = re.compile(r"[“„«「『\"][^”“»」』\"]*[”“»」』\"]")
_GOES_ON = re.compile(r"\b(?:but|aber|mais|pero)\b(?!\ (?:i|we|no|it|that|you|the|questions)\b)[^.!?]{40,}", re.I)
_SORRY_BUT = re.compile(r"sorry,?\ but", re.I)
_BREAK = plain.compile(r"(?<=[.!?])[\"'”»)\]]*\s+|(?<=[。！？])|\n+")


_CLAUSE = plain.compile(r"[,;:—–]\s+|\s[—–]\s|[、，；：]")


def sentences(text: str) -> list[str]:
    """The sentences of a text, roughly: what recurs is cut alike wherever it stands."""
    return [x for x in (part.strip() for part in _BREAK.split(text)) if x]


def declines(parts: list[str]) -> bool:
    """Whether a sentence declines by the lexicon and all that stands beside is courtesy. What stands in quotation marks is said by another."""
    found = False
    for part in parts:
        own = _QUOTED.sub(" x ", part.replace("’", "'"))
        if _DECLINES.search(own):
            # "I can't say for every tenant, but ..." goes on
            if len(own) > 220 or _GOES_ON.search(own) and not _SORRY_BUT.search(own):
                return False
            found = True
        elif len(own) >= 120 or not _COURTESY.match(own):
            return False
    return found


def masked(words: list[str], known: set[str], topics: frozenset[str] = frozenset()) -> str:
    """The words of a text, with those of its prompt, topics of other prompts and numbers masked, so that templates come out alike: ``_`` for
    words and names, with the numbers that follow them, and ``#`` for a number by itself."""
    out: list[str] = []
    for t in words:
        if len(t) > 3 and (t in known or t in topics) or not t.isalpha() and any(c.isdigit() or c == "_" for c in t):
            if out and out[-1] == "_":
                continue
            t = "#" if t.isdigit() else "_"
        out.append(t)
    return " ".join(out)


def says_something(text: str) -> bool:
    """Whether a masked text is a sentence of its own words, and not a value or a form that is filled in with words or numbers."""
    words = text.split()
    if "#" in words:
        return False
    slots = words.count("_")
    own = len(words) - slots
    return slots <= SLOTS and own >= 2 * slots and own >= WORDS * (2 if not text.isascii() and _CJK.search(text) else 1)


_RUN = re.compile(r"[\p{Han}\p{Katakana}ー]{2,}")


def content_words(query: str | None) -> list[str]:
    """Longer words of a prompt; pairs of signs where no blanks part the words."""
    low = unicodedata.normalize("NFKC", query or "").lower()
    if low.isascii():
        return sorted({w for w in _ASCII_TOKEN.findall(low) if len(w) > 3})
    words = {w for w in _LETTERS.findall(low) if len(w) > 3 and not _CJK.search(w)}
    return sorted(words | {r[i : i + 2] for r in _RUN.findall(low) for i in range(len(r) - 1)})


def word_shingles(text: str) -> set[str]:
    words = text.split()
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def prompt_words(entries: DataFrame, n: int) -> frozenset[str]:
    """The longer words of RECURRING prompts and RECURRING_SHARE of the ``n`` entries: topics, which come and go in templates. There can be no more
    than the words of a prompt divided by that share."""
    each = entries.where("query is not null").select(F.explode(F.array_distinct(F.split(F.lower("query"), r"[^\p{L}\p{M}\p{N}_]+"))).alias("word"))
    often = each.where(F.length("word") > 3).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(RECURRING, RECURRING_SHARE * n))
    return frozenset(often.select("word").toArrow().column(0).to_pylist())


def readings(entries: DataFrame, profiles: Profiles, topics: frozenset[str] = frozenset(), lexicon: bool = True) -> DataFrame:
    """entry_id, prompt (a hash of the query), words (of the query), defect (of what a single pair shows, or null), parts (the masked clauses),
    code (whether it holds any), declines (by the lexicon), of every entry."""
    kind = dict(entries.dtypes)["entry_id"]
    shipped = entries.sparkSession.sparkContext.broadcast((profiles, topics))
    types = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_()]
    names = ["prompt", "words", "defect", "parts", "code", "declines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, topics = shipped.value
        for batch in batches:
            queries, responses = batch.column("query").to_pylist(), batch.column("response").to_pylist()
            wrong = wrong_languages(profiles, queries, [r or "" for r in responses])
            found = []
            for query, response, other in zip(queries, responses, wrong):
                asked = tokens(query) if query else []
                key = xxhash.xxh64_intdigest(" ".join(asked)) - 2**63
                if is_empty(response, query) or is_copy(response, query):
                    found.append((key, [], "empty" if is_empty(response, query) else "copy", [], False, False))
                    continue
                parts = sentences(response)
                known = set(asked)
                # courtesies too rare to be told by their recurrence
                said = [x for x in parts if not (lexicon and len(x) < 120 and _COURTESY.match(x) and not _DECLINES.search(x))] or parts
                code = "`" in response or response.lstrip()[0] in "{[" or any(_CODE_LINE.match(x.strip()) for x in response.strip().splitlines())
                defect = "wrong_language" if other else "truncated" if is_truncated(response) else None
                found.append((key, content_words(query), defect, [m for m in (masked(tokens(x), known, topics) for y in said for x in _CLAUSE.split(y)) if m], code, declines(parts) and "```" not in response))
            yield pa.RecordBatch.from_arrays([batch.column("entry_id"), *[pa.array([f[i] for f in found], t) for i, t in enumerate(types)]], ["entry_id", *names])

    schema = f"entry_id {kind}, prompt bigint, words array<string>, defect string, parts array<string>, code boolean, declines boolean"
    return entries.select("entry_id", "query", "response").mapInArrow(run, schema)


def openings(read: DataFrame, n: int) -> DataFrame:
    """row, prompt, text, bare of the result of :func:`readings` with ``row``: the first clause that is not common, and whether it is all
    that isn't; where two are left, and most responses that open so go no farther, also both together, which is all.

    Common are clauses without masked places of COMMON_SHARE of the ``n`` entries and more, of which there can be no more than the clauses
    of an entry divided by that share. Where all clauses are common the longest is the opening."""
    each = read.where("not code and size(parts) > 0").select("row", "prompt", F.posexplode("parts").alias("place", "text"))
    common = each.where(~F.rlike("text", F.lit("[_#]"))).groupBy("text").agg(F.count("*").alias("n")).where(F.col("n") >= max(RECURRING, COMMON_SHARE * n)).select("text", F.lit(True).alias("common"))
    told = each.join(small(cut(common)), "text", "left")
    rare = F.col("common").isNull()
    left = F.array_sort(F.collect_list(F.when(rare, F.struct("place", "text"))))  # the clauses of one response
    per = told.groupBy("row", "prompt").agg(left.alias("left"), F.max(F.struct(F.length("text"), "text")).alias("longest"))
    first = F.when(F.size("left") == 0, F.col("longest.text")).otherwise(F.get("left", F.lit(0))["text"])
    per = cut(per.select("row", "prompt", first.alias("first"), F.size("left").alias("size"), F.array_join(F.transform("left", lambda x: x["text"]), " ").alias("both")))
    short = per.groupBy("first").agg(F.avg((F.col("size") <= 2).cast("int")).alias("share")).where("share > 0.5").select("first")
    both = per.where("size = 2").join(short, "first", "left_semi").select("row", "prompt", F.col("both").alias("text"), F.lit(True).alias("bare"))
    return per.select("row", "prompt", F.col("first").alias("text"), (F.col("size") <= 1).alias("bare")).unionByName(both)


def refusal_templates(read: DataFrame, opened: DataFrame, n: int) -> DataFrame:
    """text of ``opened`` (see :func:`openings`) for those of refusal templates, which no word list takes part in."""
    kept = F.udf(says_something, "boolean")
    texts = opened.groupBy("text").agg(F.count("*").alias("n"), F.sum(F.col("bare").cast("int")).alias("bare"))
    texts = cut(texts.where(kept("text")).select(F.xxhash64("text").alias("id"), "text", "n", "bare"))
    grouped = cut(extras.near_duplicates(texts.select("id", "text"), SIMILAR, "id", "text", word_shingles))
    named = cut(texts.join(grouped, "id").select("text", "n", "bare", F.col("canonical").alias("template")))
    least = max(RECURRING, RECURRING_SHARE * n)
    often = named.groupBy("template").agg(F.sum("n").alias("n"), F.sum("bare").alias("bare")).where((F.col("n") >= least) & (F.col("bare") * 2 > F.col("n")))
    members = cut(named.join(often.select("template"), "template", "left_semi").select("text", "template"))
    asked = cut(opened.where("bare").join(small(members), "text").groupBy("template", "prompt").agg(F.min("row").alias("row")))
    prompts = asked.groupBy("template").agg(F.count("*").alias("prompts")).where(F.col("prompts") >= least)
    words = read.select("row", F.explode("words").alias("word"))
    shared = asked.join(words, "row").groupBy("template", "word").agg(F.count("*").alias("n")).join(prompts, "template")
    shared = cut(shared.where(F.col("n") > RELATED * F.col("prompts")).select("template", "word", (F.col("n") / F.col("prompts")).alias("share")))
    usual = words.join(small(shared.select("word").distinct()), "word").groupBy("word").agg((F.count("*") / F.lit(max(n, 1))).alias("all"))
    related = shared.join(usual, "word").where(F.col("share") > USUAL * F.col("all")).select("template").distinct()
    return members.join(prompts.join(related, "template", "left_anti"), "template", "left_semi").select("text")


def defects(entries: DataFrame, labelled: DataFrame | None = None, lexicon: bool = True) -> DataFrame:
    """entry_id, defect of the defective pairs of ``entries`` (entry_id, query, response).

    ``labelled`` (text, lang): texts that the profiles of languages are fitted on (see :func:`fit_profiles`). ``lexicon``: whether wordings that
    are too rare for a template are looked up. A null query can't be copied or set a language. Repeated rows are judged each; an empty table
    gives no rows."""
    profiles = Profiles([], np.zeros((BUCKETS, 0))) if labelled is None else fit_profiles(labelled)
    n = entries.count()
    read = cut(readings(entries, profiles, prompt_words(entries, n), lexicon).withColumn("row", F.monotonically_increasing_id()))
    opened = cut(openings(read, n))
    template = cut(refusal_templates(read, opened, n))
    told = opened.where("bare").join(small(template), "text", "left_semi").select("row").distinct().withColumn("told", F.lit(True))
    refusal = F.coalesce("told", F.lit(False)) | (F.col("declines") if lexicon else F.lit(False))
    return (
        read.join(told, "row", "left")
        .withColumn("defect", F.when(F.col("defect").isin("empty", "copy"), F.col("defect")).when(refusal, "refusal").otherwise(F.col("defect")))
        .where("defect is not null")
        .select("entry_id", "defect")
    )
