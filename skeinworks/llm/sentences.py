"""Problem 8: sentence boundaries across languages and scripts.

A pushdown automaton reads each text.  Its lower stack holds the levels of open
lists: a line that begins further in than the item above opens a level, one
further out closes levels, and a paragraph that stands within an item belongs to
it.  So the text falls into blocks (headings, list items with their levels,
fenced code, paragraphs).  Within a block its upper stack holds the open
quotations and brackets, marks inside them are remembered with the frame, and a
boundary can only fall while that stack is empty.  Whether a full
stop belongs to an abbreviation is looked up in a trie read backwards from the
mark; script terminators (ideographic, Devanagari, Arabic) need no space after
them, and Thai sentences end at a space between two Thai letters.

Offsets count code points.  NULL and blank texts have no sentences; an opening
sign without its partner in the same block is plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import bounded_batches, spread

SCHEMA = "doc_id long, sentence_no int, start_char long, end_char long, unit string, list_level int"

# Abbreviations by what may follow them.  A title, or a word that needs a continuation, never ends a
# sentence; one that takes a number does not before a number; the others end one if a new sentence begins.
NEVER = "Dr Mr Mrs Ms Prof St Mt Rev Hon Gen Capt Lt Sgt Fr Hr Frau Dipl Ing Sr Sra Srta Dra Dres Don Mme Mlle MM Me Mgr e.g i.e cf vs viz esp incl bzw vgl Vgl z d h Gem gem sog evtl ggf inkl u c.-à-d ex ej См см т.е т.к др проф акад им д-р डॉ श्री श्रीमती उदा सुश्री पं د أ م ق إلخ".split()
NUMBERED = "No Nos no Nr nr Nº nº Fig Figs fig figs Sec sec Sect Ch ch vol Vol ver Ver v p pp P art Art Abb Abschn Tab Kap S Bd Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec approx aprox apdo env ca Ca núm pág págs cap рис п пп ок табл гл стр с №  र रु सं ص ج".split()
MAYBE = "etc al a.m p.m A.M P.M U.S U.K E.U U.N EE.UU Inc Ltd Co Corp Jr Sr. usw u.a a B t т д п г гг тыс млн млрд руб тт".split()
UNITS = frozenset("s с m h ms min g kg km cm mm l".split())
#: German words before an ordinal number.
ORDINAL_BEFORE = frozenset("am im den dem der vom zum zur beim ab bis seit des die das Am Im Den Dem Der Vom Zum Zur Beim Ab Bis Seit Des Die Das".split())
MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner Feber".split())

PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "〈": "〉", "《": "》", "«": "»", "“": "”", "„": "“", "‘": "’", "‹": "›", "〔": "〕"}
_BRACKETS = frozenset("([{（［【〔")
_CLOSERS = frozenset(PAIRS.values()) | {'"'}
_FULL = frozenset("。！？．।॥؟۔｡")
_MARKS = ".!?…" + "".join(_FULL)
_GOES_ON = frozenset(",;:，；：、،؛-–—/…~=+*%&")
_EVENT = re.compile("[" + re.escape(_MARKS + "".join(PAIRS) + "".join(_CLOSERS)) + "`]|(?<=[฀-๿])[ \t]*(?:[ \t]|\r?\n)[ \t]*(?=[฀-๿])")
_SIGN = re.compile("[" + re.escape("".join(PAIRS) + "".join(_CLOSERS)) + "`]")
_BLANK = re.compile(r"[ \t\r\f\v　]*\Z")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?=[ \t]|$)")
_ITEM = re.compile(r"([ \t]*)(?:[-*+•]|\d{1,9}[.)])[ \t]+(?=\S)")
_INDENT = re.compile(r"[ \t]*")
_IDENTIFIER = re.compile(r"[a-z][a-z0-9]*(?:_[a-z0-9]|[A-Z])|[a-z]\w*\(")
_SPACE = re.compile(r"\s*")


def _trie(**classes: list[str]) -> dict:
    root: dict = {}
    for kind, words in classes.items():
        for word in words:
            node = root
            for c in reversed(word):
                node = node.setdefault(c, {})
            node["kind"] = kind
    return root


_ABBREVIATIONS = _trie(MAYBE=MAYBE, NUMBERED=NUMBERED, NEVER=NEVER)


def _abbreviation(text: str, low: int, at: int) -> tuple[str, int]:
    """Class of the abbreviation that the stop at ``at`` belongs to, or '', and where it begins."""
    node, i, found, begin = _ABBREVIATIONS, at - 1, "", at
    while i >= low and text[i] in node:
        node = node[text[i]]
        if "kind" in node and (i == low or not (text[i - 1].isalnum() or text[i - 1] in "_.-/’'")):
            found, begin = node["kind"], i
        i -= 1
    return found, begin


def _caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def _begins(text: str, at: int, high: int) -> bool:
    """Whether a new sentence seems to begin at ``at``."""
    while at < high and (text[at] in PAIRS or text[at] in "\"'¿¡`"):
        if text[at] in "¿¡":
            return True
        at += 1
        while at < high and text[at] in "   ":
            at += 1
    if at >= high:
        return True
    c = text[at]
    return c.isupper() or _caseless(c) or bool(_IDENTIFIER.match(text, at, high)) or ord(c) >= 0x1F000


def _partners(text: str, low: int, high: int) -> dict[int, int]:
    """Opening place -> closing place of the quotations and brackets of a block."""
    stack: list[tuple[str, int]] = []
    open_at: dict[str, list[int]] = {}  # closing sign -> where it is awaited in the stack
    found: dict[int, int] = {}

    def push(c: str, i: int) -> None:
        open_at.setdefault(c, []).append(len(stack))
        stack.append((c, i))

    for m in _SIGN.finditer(text, low, high):
        i, c = m.start(), m[0]
        if c == "’" and i + 1 < high and text[i + 1].isalpha() and i > low and text[i - 1].isalpha():
            continue
        level = open_at[c][-1] if open_at.get(c) else -1
        if level >= 0 and not (c in '"`' and level < len(stack) - 1 and stack[-1][0] in ")]}"):
            found[stack[level][1]] = i
            while len(stack) > level:
                open_at[stack.pop()[0]].pop()
        elif c == '"' or c == "`":
            push(c, i)
        elif c in PAIRS and not (c == "“" and open_at.get("”")):
            push(PAIRS[c], i)
    return found


def _ends_block(text: str, low: int, high: int, out: list[int]) -> None:  # noqa: C901, PLR0912, PLR0915
    """Appends the sentence ends of one block of running text."""
    while high > low and text[high - 1].isspace():
        high -= 1
    if low >= high:
        return
    partner = _partners(text, low, high)
    closes = {v: k for k, v in partner.items()}
    begin = low  # of the current sentence
    frames: list[list] = []  # open signs: place, whether it began its sentence, whether it follows a colon, own mark seen
    at = low

    def end(place: int) -> None:
        nonlocal begin
        out.append(place)
        begin = place

    def last_sign(place: int, least: int) -> int:
        """Where the last sign before a place is that is no white space; below ``least`` if there is none from there on."""
        place -= 1
        while place >= least and text[place].isspace():
            place -= 1
        return place

    for m in _EVENT.finditer(text, low, high):
        i = m.start()
        if i < at:
            continue
        c = text[i]
        if c.isspace():
            if not frames:
                end(i)
            continue
        if i in partner:
            before = last_sign(i, begin)
            frames.append([i, before < begin, before >= begin and text[before] in ":：", -1])
            continue
        if i in closes:
            while frames and frames[-1][0] != closes[i]:
                frames.pop()
            if not frames:
                continue
            place, first, colon, mark = frames.pop()
            if frames:
                if mark >= 0:
                    frames[-1][3] = i + 1
                continue
            if mark < 0:
                continue
            # the closing sign follows its own mark: does the surrounding sentence go on?
            j = i + 1
            k = _SPACE.match(text, j, high).end()
            if k >= high:
                continue
            n = text[k]
            if n in _GOES_ON or n in _MARKS or n in closes and k == j:
                continue
            if text[place] in _BRACKETS and first:
                end(j)
            elif text[place] in _BRACKETS:
                if k > j and n.isupper():
                    end(j)
            elif colon:
                end(j)
            elif k > j and not _caseless(n) and n not in _BRACKETS and _begins(text, k, high) and not (n.islower() and _IDENTIFIER.match(text, k, high)) and not _caseless(text[min(k + 1, high - 1)]):
                end(j)
            continue
        if c not in _MARKS:
            continue
        # a run of marks counts as one
        j = i
        while j < high and text[j] in _MARKS:
            j += 1
        at = j
        run = text[i:j]
        k = _SPACE.match(text, j, high).end()
        if frames:
            if k >= high or text[k] in _CLOSERS and k in closes:
                kind = "" if run != "." else _abbreviation(text, low, i)[0]
                frames[-1][3] = j if not kind or kind == "MAYBE" else -1
            continue
        if k >= high:
            continue
        n = text[k]
        full = any(x in _FULL for x in run)
        if not full and k == j and not (run[-1] == "…" or len(run) > 1 and (_caseless(n) or n in PAIRS)) and not (_caseless(n) and run[-1] in "!?" or n in "「（『【" and run[-1] in "!?."):
            continue  # inside a word, number or path
        if n in _CLOSERS and k in closes:
            continue
        ellipsis = "…" in run or ".." in run
        if ellipsis and not any(x in "!?！？。؟।" for x in run):
            last = last_sign(i, begin)
            first = _SPACE.match(text, begin, last + 1).end() if last >= begin else begin
            spoken = text[first : last + 1] if last - first < 8 else ""
            caseless = last >= begin and _caseless(text[last])
            if last - first < 4 and caseless or last - first < 8 and " " not in spoken and n.islower():
                continue
            if n not in _GOES_ON and (_begins(text, k, high) or caseless):
                end(j)
            continue
        if n in "，、；,;:：" or n in "-–—" and k == j:
            continue
        if run == ".":
            kind, place = _abbreviation(text, low, i)
            word = text[place:i]
            number = last_sign(place, low)
            if kind and word in UNITS and number >= low and text[number].isdigit():
                kind = ""
            if not kind and i - 1 >= low and text[i - 1].isupper() and not (i - 2 >= low and (text[i - 2].isalnum() or text[i - 2] in "_)")):
                number = last_sign(i - 1, low)
                kind = "" if number >= low and text[number].isdigit() else "NEVER"  # an initial
            if not kind and text[i - 1].islower() and not text[i - 2 : i - 1].isalnum() and i - 1 > low and text[i - 1] not in UNITS:
                kind = "MAYBE"  # a single letter, as in abbreviations of several words
            if kind == "NEVER":
                continue
            if kind == "NUMBERED":
                if n.isdigit() or n in "([«\"" or not _begins(text, k, high):
                    continue
            elif kind == "MAYBE":
                if not _begins(text, k, high):
                    continue
            elif text[i - 1].isdigit() and _ordinal(text, low, i, k, high):
                continue
        end(j)
    if begin < high and text[begin:high].strip():
        end(high)


def _ordinal(text: str, low: int, stop: int, following: int, high: int) -> bool:
    """Whether the number before the stop is a German ordinal."""
    i = stop
    while i > low and text[i - 1].isdigit():
        i -= 1
    if stop - i > 2 or i > low and text[i - 1] in ".,":
        return False
    before = re.search(r"([^\W\d]+)\s+\Z", text[max(low, i - 24) : i])
    after = re.match(r"[^\W\d]+", text[following : min(high, following + 12)])
    return bool(after and after[0] in MONTHS or before and before[1] in ORDINAL_BEFORE and after)


def blocks(text: str) -> Iterator[tuple[str, int, int, int]]:
    """``(unit, level, start, end)`` of the headings, list items, fences and paragraphs of a text, in order.

    A heading ends with its line.  A list item goes on until a blank line, a
    heading, a fence or the next item of any level; a paragraph after a blank
    line that is indented as far as the item's text is another block of the item.
    Levels count from 1; what stands in no list has level 0.
    """
    at, n = 0, len(text)
    unit, begin, level = "", 0, 0
    levels: list[int] = []  # of the open lists: how far in their items' texts begin

    def close_levels(line: str) -> int:
        width = len(_INDENT.match(line)[0].expandtabs(4))
        while levels and width < levels[-1]:
            levels.pop()
        return len(levels)

    while at < n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        line = text[at:stop]
        fence = _FENCE.match(line)
        if _BLANK.match(line):
            if unit:
                yield unit, level, begin, at
            unit = ""
        elif fence:
            if unit:
                yield unit, level, begin, at
            unit, level = "", close_levels(line)
            close = re.compile(r"^[ \t]*" + re.escape(fence[1][0]) + "{" + str(len(fence[1])) + r",}[ \t\r]*$", re.M).search(text, min(stop + 1, n))
            end = close.end() if close and stop < n else n
            yield "code", level, at, end
            after = text.find("\n", end)
            stop = n if after < 0 or end >= n else after
        elif _HEADING.match(line):
            if unit:
                yield unit, level, begin, at
            unit = ""
            levels.clear()
            yield "heading", 0, at + _HEADING.match(line).end(), stop
        elif item := _ITEM.match(line):
            if unit:
                yield unit, level, begin, at
            close_levels(line)
            levels.append(len(item[0].expandtabs(4)))
            unit, begin, level = "item", at + item.end(), len(levels)
        elif not unit:
            level = close_levels(line)
            unit, begin = "item" if level else "text", at
        at = stop + 1
    if unit:
        yield unit, level, begin, n


def sentence_ends(text: str | None) -> list[tuple[int, str]]:
    """``(end, unit)`` of each sentence of a text, in order."""
    return [(end, unit) for end, unit, _ in leveled_ends(text)]


def leveled_ends(text: str | None) -> list[tuple[int, str, int]]:
    """``(end, unit, list level)`` of each sentence of a text, in order."""
    out: list[tuple[int, str, int]] = []
    if not text or text.isspace():
        return out
    for unit, level, low, high in blocks(text):
        if unit == "code":
            out.append((low + len(text[low:high].rstrip()), unit, level))
            continue
        ends: list[int] = []
        _ends_block(text, low, high, ends)
        out += [(e, unit, level) for e in ends]
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, numbers, starts, ends, units, levels = [], [], [], [], [], []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            text, last = text.as_py(), 0
            for number, (end, unit, level) in enumerate(leveled_ends(text), 1):
                begin = _SPACE.match(text, last).end()
                ids.append(doc)
                numbers.append(number)
                starts.append(begin)
                ends.append(end)
                units.append(unit)
                levels.append(level)
                last = end
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(units, pa.string()), pa.array(levels, pa.int32())], names=[x.split()[0] for x in SCHEMA.split(", ")])


def sentences(documents: DataFrame) -> DataFrame:
    """``doc_id, sentence_no, start_char, end_char, unit, list_level``: the sentences of every document, in order."""
    return bounded_batches(spread(documents.select("doc_id", "text"))).mapInArrow(_split, SCHEMA)
