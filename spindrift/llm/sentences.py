"""Sentence units of texts in any language and script.

Method: the standard sentence-break rules by character properties (terminators of all scripts, closing punctuation, case of what
follows), with suppression after the abbreviations of several languages, and closing quotes and brackets handled as pairs.
The language is not asked for, since it is often missing or wrong: the abbreviations of all languages hold everywhere.

Units. A blank line ends a unit. A list item with its marker is one unit; so is a heading or other block without a terminator,
and an unfinished remainder. A single line break counts as a blank, except around list items. No boundary lies within a matched pair of
quotes or brackets. In Thai a blank between two Thai letters separates units."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations, in lower case and without their last period.
#: Before names: never the end of a sentence.
TITLES = frozenset("dr prof mr mrs ms mx st sr sra srta dra d dña fr hr mme mlle mgr me rev gen col capt lt sgt hon pres gov sen rep dipl ing mag".split())
#: Before numbers: no end if a digit follows.
NUMBERED = frozenset("no nos nr nrn núm num fig figs abb tab sect sec sects abs abschn art arts § p pp s pág págs pag vol vols bd ch chap kap cap ed eds est ca approx env aprox v vers ver eq eqs ex bsp anm zeile z".split())
#: Within a sentence, whatever follows.
INNER = frozenset("cf vs viz vgl bzw ca approx incl excl resp sog ggf evtl inkl exkl zzgl bspw insb mind max min mio mrd mill env ej aprox vid cfr esp approx dept univ assn ave jan feb febr aug sept okt nov dez déc févr janv juil".split())
#: Within a sentence or at its end: an end if a capital, a digit or a name follows.
EITHER = frozenset("etc usw uvm usf al inc ltd co corp bros jr sra ste gmbh bmbh".split())
#: Articles and prepositions after which a number with a period is an ordinal, in German.
BEFORE_ORDINAL = frozenset("am der dem den des die das im vom zum zur beim ab bis seit ein eine einen einem einer jeder jede jedes kein keine".split())

# Character properties of the standard: terminators that may be part of an abbreviation or a number (ATerm), all other terminators (STerm; those
# of the Latin script end a sentence only before a blank or a capital), closing and opening punctuation, and what goes on after a terminator.
TERMINATOR = re.compile(r"[\p{Sentence_Break=ATerm}\p{Sentence_Break=STerm}…‥]+")
_HARD = re.compile(r"(?V1)[\p{Sentence_Break=STerm}--[!?‼⁇⁈⁉‽]]")
_ATERM = re.compile(r"\p{Sentence_Break=ATerm}")
_CONTINUE = re.compile(r"(?V1)[[\p{Sentence_Break=SContinue}\p{Pe}]--\p{Pd}]")
_ELLIPSIS = re.compile(r"(?:…|‥|\.\.)[.…‥]*\Z")
_LINE = re.compile(r"[^\r\n\x0b\x0c\x85  ]*(?:\r\n|[\r\n\x0b\x0c\x85  ]|\Z)")
_BULLET = re.compile(r"[^\S\r\n]*(?:(?P<dot>[-*+•‣◦▪·●○])|\(?(?P<number>\d{1,3})[.)]|\(?[a-z]\))[^\S\r\n]+(?=\S)")
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "〔": "〕", "“": "”", "„": "“", "‚": "‘", "«": "»", "‹": "›", "‘": "’"}
_BRACKETS = frozenset("([{（［【〔")
_MARKS = re.compile(r"""[()\[\]{}（）［］「」『』【】《》〈〉〔〕“”„‚«»‹›‘’"']""")
_CLOSERS = re.compile(r"""[\p{Pe}\p{Pf}“"'*_]""")
_OPENERS = re.compile(r"""[\p{Ps}\p{Pi}"'¿¡*_\s]*""")
_TECHNICAL = re.compile(r"(?:\p{Ll}+[\d_]|\p{Ll}+(?:-\p{Ll}+)*_)[\p{L}\d_]*|v\d")
_WORD = re.compile(r"[\p{L}\p{M}]+")
_LAST_WORD = re.compile(r"[\p{L}\p{M}§]+\Z")
_NUMBER = re.compile(r"(?:\A|\s)([\p{L}\p{M}]+)\s+\d{1,4}\Z")
_DAY_HALF = re.compile(r"(?:\A|[^\p{L}])(?:[ap]\.\s?m|[AP]\.\s?M|U\.\s?S|U\.\s?K|U\.\s?N|E\.\s?U)\Z")
_THAI = re.compile(r"(?<=[ก-ฺเ-๎])[ \t\xa0　]+(?=[ก-ฺเ-๎])")
_DECIMAL = re.compile(r"\d+[.,]\d+\s")
_INDIC = re.compile(r"[ऀ-෿]")


def _pairs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The outermost matched pairs of quotes and brackets between two places, in order. What has no partner is ignored."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text, start, end):
        c, at = m.group(), m.start()
        before, after = text[at - 1] if at > start else " ", text[at + 1] if at + 1 < end else " "
        if c in "'’" and before.isalnum() and after.isalnum():
            continue  # an apostrophe
        if c in "'\"":
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == c), None)
            if opened is not None and not (c == "'" and before.isspace()):
                found.append((stack[opened][1], at))
                del stack[opened:]
            elif (before.isspace() or before in "([{«“„—–-") and not after.isspace():
                stack.append((c, at))
            continue
        opened = next((i for i in range(len(stack) - 1, -1, -1) if _PAIRS.get(stack[i][0]) == c), None)
        if opened is not None:
            found.append((stack[opened][1], at))
            del stack[opened:]
        elif c in _PAIRS:
            stack.append((c, at))
    found.sort()
    outer: list[tuple[int, int]] = []
    for one in found:
        if not outer or one[0] > outer[-1][1]:
            outer.append(one)
    return outer


def _starts_new(text: str, at: int, end: int) -> str:
    """What the text at a place looks like: ``upper`` (a capital, or a name that heads a sentence in small letters),
    ``digit``, ``lower``, ``other`` (a letter without case) or ``none``; opening punctuation is passed over."""
    at = _OPENERS.match(text, at, end).end()
    if at >= end:
        return "none"
    c = text[at]
    if c.isupper() or c.istitle():
        return "upper"
    if c.islower():
        word = _WORD.match(text, at, end).group()
        return "upper" if not word.islower() or _TECHNICAL.match(text, at, end) else "lower"
    return "digit" if c.isdigit() else "other" if c.isalpha() else "none"


def _ends(text: str, start: int, i: int, j: int, k: int, end: int, pair: tuple[int, int] | None) -> bool:
    """Whether the unit that began at ``start`` ends at ``k``, after the terminators ``text[i:j]`` and what closes with them."""
    n = k
    while n < end and text[n].isspace():
        n += 1
    if n >= end:
        return True
    gap, run = n > k, text[i:j]
    if not gap and _CONTINUE.match(text[n]):
        return False
    follows = _starts_new(text, n, end)
    dots = bool(_ELLIPSIS.search(run)) or run in ("…", "‥")
    if pair is not None:
        opened_inside = text[start : pair[0]].strip("¿¡*_ \t\r\n\xa0") != ""
        if text[pair[0]] in _BRACKETS:
            if opened_inside:
                return False
            if gap:
                return True  # a whole sentence in brackets, whatever follows
        if follows == "upper" or follows == "digit" and gap:
            return True
        return follows == "other" and gap and not opened_inside
    if dots and not _HARD.search(run) and "!" not in run and "?" not in run:
        return follows in ("upper", "digit") or follows == "other" and gap
    if not _ATERM.match(run[-1]) or len(run) > 1:
        if _HARD.search(run) or gap:
            return True
        return follows in ("upper", "other")
    return _dot_ends(text, start, i, n, end, gap, follows)


def _dot_ends(text: str, start: int, i: int, n: int, end: int, gap: bool, follows: str) -> bool:
    """Whether a single period at ``i``, with the next text at ``n``, ends the unit."""
    before = text[max(start, i - 40) : i]
    if not before or before[-1].isspace():
        return gap and bool(before.strip())
    found = _LAST_WORD.search(before)
    word = found.group() if found else ""
    joined = found is not None and before[: found.start()][-1:] in ("-", "_")  # the end of a compound is no abbreviation
    short = "" if joined else word.lower()
    letters = sum(c.isalpha() for c in word)
    if word and _INDIC.match(word):
        return False
    if not gap:
        # the blank may be missing, but not in names, addresses and abbreviations
        if follows not in ("upper", "digit") or before[-1] == "." or letters == 1:
            return False
        token = before.split()[-1] if before.split() else ""
        if "://" in token or "@" in token or "/" in token:
            return False
        if letters > 1 and (short in TITLES or short in INNER or short in NUMBERED and follows == "digit" or before[-1].isupper()):
            return False
        c = text[n]
        if c.isdigit():
            return letters > 1 and bool(_DECIMAL.match(text, n, end))
        if c.islower():
            return letters > 1 and text[n - 1] == "." and bool(re.match(r"[\p{L}\d_]+\s", text[n : n + 40])) or c == "v" and letters > 1
        return True
    if letters == 0:
        number = _NUMBER.search(before)
        return not (number and number.group(1).lower() in BEFORE_ORDINAL and follows == "upper" and text[n].isupper())
    if letters == 1 and not before[-1].isdigit():
        whole = before[: found.start()]
        if _DAY_HALF.search(before):
            return follows in ("upper", "digit")
        return bool(whole) and (whole[-1].isalnum() or whole[-1] in "_-") and not whole.endswith("à-")
    if short in TITLES or short in INNER and not (short in NUMBERED and follows == "none"):
        return False
    if short in NUMBERED:
        return follows != "digit"
    if short in EITHER:
        return follows in ("upper", "digit")
    return True


def _split(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    """Append the units of one block of running text."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if start >= end:
        return
    pairs = _pairs(text, start, end)
    opens = [p[0] for p in pairs]
    cuts: list[tuple[int, int]] = []
    begin, done = start, start
    thai = [m.span() for m in _THAI.finditer(text, start, end)]
    marks = [(m.start(), m.end(), False) for m in TERMINATOR.finditer(text, start, end)] + [(a, b, True) for a, b in thai]
    for i, j, blank in sorted(marks):
        if i < done:
            continue
        at = bisect_right(opens, i) - 1
        pair = pairs[at] if at >= 0 and pairs[at][1] > i else None
        if blank:
            if pair is None:
                cuts.append((i, j))
                begin = done = j
            continue
        k = j
        if pair is not None:
            if text[j : pair[1]].strip(" \t\r\n\xa0 )]}）］」』】》〉〕”“»›’\"'"):
                continue
            k = pair[1] + 1
        while k < end and _CLOSERS.match(text[k]) and bisect_right(opens, k) - 1 == at:
            k += 1
        while k > j and pair is None and text[k - 1] in "*_" and k < end and not text[k].isspace():
            k -= 1
        if _ends(text, begin, i, j, k, end, pair):
            n = k
            while n < end and text[n].isspace():
                n += 1
            cuts.append((k, n))
            begin = done = n
    begin = start
    for a, b in cuts:
        if a > begin:
            out.append((begin, a))
        begin = b
    if end > begin:
        out.append((begin, end))


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, in code points; none for null, empty and blank texts."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    block: int | None = None  # start of running text
    item: int | None = None  # start of a list item
    number, fresh, last = 0, True, 0  # number of the last item; no text since a blank line; end of the last line's text

    def close(at: int) -> None:
        nonlocal block, item
        if item is not None:
            stop = at
            while stop > item and text[stop - 1].isspace():
                stop -= 1
            out.append((item, stop))
        elif block is not None:
            _split(text, block, at, out)
        block = item = None

    for line in _LINE.finditer(text):
        a, b = line.span()
        if a == b:
            continue
        body = line.group().strip()
        if not body:
            close(a)
            fresh, number = True, 0
            continue
        marker = _BULLET.match(text, a, b)
        listed = marker is not None
        if marker is not None and marker.group("number"):
            value = int(marker.group("number"))
            listed = fresh or item is not None and value == number + 1 or value == 1 and text[last - 1] in ".!?:。！？："
        if listed:
            close(a)
            item = marker.start() + len(marker.group()) - len(marker.group().lstrip())
            number = int(marker.group("number")) if marker.group("number") else 0
        elif item is not None and TERMINATOR.search(text[last - 1]) and body[0].isupper() and not _abbreviated(text, last):
            close(a)
            block, number = a, 0
        elif item is None and block is None:
            block = a
        fresh = False
        last = a + len(line.group().rstrip())
    close(len(text))
    return out


def _abbreviated(text: str, at: int) -> bool:
    found = _LAST_WORD.search(text[max(0, at - 20) : at].rstrip("."))
    word = found.group().lower() if found else ""
    return text[at - 1] == "." and (len(word) == 1 or word in TITLES or word in NUMBERED or word in INNER)


def sentence_units(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (id, start_char, end_char) per unit of every document, offsets in code points of the text as stored.

    Null, empty and blank texts give no rows; repeated rows give their units as often. The units lie in order and apart, hold all that
    is not blank, and neither begin nor end with a blank. No shuffle: a text is cut where it lies."""
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [units(t) for t in batch.column("text").to_pylist()]
            place = pa.array([i for i, u in enumerate(found) for _ in u], pa.int64())
            columns = [batch.column("id").take(place)]
            columns += [pa.array([x[side] for u in found for x in u], pa.int64()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [id, "start_char", "end_char"])

    return rows.mapInArrow(run, f"`{id}` {kind}, start_char bigint, end_char bigint")
