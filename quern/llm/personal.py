"""Personal information in free text: find it under its disguises and replace it by typed placeholders.

A chain of transducers rewrites the text and keeps, for every character it
writes, the source span it read: the one form of look-alike characters, then
spelled digits, then written-out at and dot signs.  Identifiers are detected in
the rewritten text; their spans are carried back through the chain, so the
placeholders land on the source characters and the rest stays as it was.

Spans do not overlap: the first by kind in the order id_number, email, address,
phone, name wins, then the longer.  Null and empty texts hold nothing.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import map_rows
from quern.llm.visual_form import IRREGULAR, TABLE, _fold

# ---------------------------------------------------------------- transducers


class Tape:
    """Text with the source span of every character; ``None`` spans stand for the identity."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text, self.start, self.end = text, start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def one_form(text: str) -> Tape:
    """Look-alikes, widths, blanks and split syllables in their one form; unseen characters are read as nothing."""
    if not IRREGULAR.search(text):
        return Tape(text)
    out, start, end = [], [], []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        # A base and what is drawn onto it: accents and the vowels and finals of a syllable.
        while j < n and (unicodedata.combining(text[j]) or "ᅠ" <= text[j] <= "ᇿ" or (TABLE.get(ord(text[j])) == "" and _joins(text, j))):
            j += 1
        cell = text[i:j]
        if j == i + 1 and (cell.isascii() or "가" <= cell <= "힣"):
            form = " " if cell == "\t" else cell
        else:
            form = _fold(cell)
        last = j
        while last > i + 1 and TABLE.get(ord(text[last - 1])) == "":
            last -= 1
        for ch in form:
            out.append(ch)
            start.append(i)
            end.append(last)
        i = j
    return Tape("".join(out), start, end)


def _joins(text: str, j: int) -> bool:
    """Does an unseen character stand inside a split syllable?"""
    while j < len(text) and TABLE.get(ord(text[j])) == "":
        j += 1
    return j < len(text) and (bool(unicodedata.combining(text[j])) or "ᅠ" <= text[j] <= "ᇿ")


def rewrite(tape: Tape, pattern: re.Pattern, written) -> Tape:
    """Replace matches by ``written(match)``; every character written reads the whole match."""
    out, start, end, at = [], [], [], 0
    for m in pattern.finditer(tape.text):
        new = written(m)
        if new is None:
            continue
        for k in range(at, m.start()):
            s, e = tape.span(k, k + 1)
            start.append(s)
            end.append(e)
        out.append(tape.text[at:m.start()])
        s, e = tape.span(m.start(), m.end())
        out.append(new)
        if len(new) == len(m.group()):
            for k in range(m.start(), m.end()):
                s, e = tape.span(k, k + 1)
                start.append(s)
                end.append(e)
        else:
            start += [s] * len(new)
            end += [e] * len(new)
        at = m.end()
    if not at:
        return tape
    for k in range(at, len(tape.text)):
        s, e = tape.span(k, k + 1)
        start.append(s)
        end.append(e)
    out.append(tape.text[at:])
    return Tape("".join(out), start, end)


_DASHES = re.compile("[‐‑‒–—―−﹣]")
_KO_DIGITS = {"공": "0", "영": "0", "일": "1", "이": "2", "삼": "3", "사": "4", "오": "5", "육": "6", "륙": "6", "칠": "7", "팔": "8", "구": "9"}
_EN_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_KO_RUN = re.compile(r"(?<![가-힣])[공영일이삼사오육륙칠팔구](?:[ \-.]?(?:다시 ?)?[공영일이삼사오육륙칠팔구]){7,12}(?![가-힣]*학)")
_EN_RUN = re.compile(r"\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)(?:[ \-](?:zero|oh|one|two|three|four|five|six|seven|eight|nine)){6,12}\b", re.I)
_AT = re.compile(r" ?[\[({<] ?at ?[\])}>] ?| ?골뱅이 ?| at (?=[\w\-]+(?: dot [\w\-]+)+| ?[\w\-]+(?:\.[\w\-]+)+\b(?! ?[ap]\.m))| ?@ ?", re.I)
_DOT = re.compile(r" ?[\[({<] ?dot ?[\])}>] ?| dot |(?<=[A-Za-z]) ?점 ?(?=[A-Za-z])", re.I)


def _at_sign(m: re.Match) -> str | None:
    t, s = m.string, m.group()
    left = t[m.start() - 1:m.start()]
    right = t[m.end():m.end() + 1]
    return "@" if left.isascii() and (left.isalnum() or left in "._-+") and right.isascii() and right.isalnum() and s != "@" else None


def plain(text: str) -> Tape:
    t = one_form(text)
    if _DASHES.search(t.text):
        t = rewrite(t, _DASHES, lambda m: "-")
    if _KO_RUN.search(t.text):
        t = rewrite(t, _KO_RUN, lambda m: "".join(_KO_DIGITS.get(c, "-" if c in "-." else "") for c in m.group()))
    if _EN_RUN.search(t.text):
        t = rewrite(t, _EN_RUN, _spoken_number)
    low = t.text.lower()
    if "at" in low or "골뱅이" in low or "@" in low:
        before = t
        t = rewrite(t, _AT, _at_sign)
        if t is not before or "@" in low:
            if "dot" in low or "점" in low:
                t = rewrite(t, _DOT, _dot_sign)
    return t


def _spoken_number(m: re.Match) -> str:
    """Spelled digits; ten of them without a leading zero are written as a number in groups."""
    d = "".join(_EN_DIGITS[w] for w in re.split("[ -]", m.group().lower()))
    return f"{d[:3]}-{d[3:6]}-{d[6:]}" if len(d) == 10 and d[0] not in "01" else d


def _dot_sign(m: re.Match) -> str | None:
    """A written-out dot is one only within the domain after an at sign."""
    head = m.string[max(0, m.start() - 80):m.start()]
    return "." if re.search(r"@[A-Za-z0-9\-]+(?:(?:\.| ?[\[({<] ?dot ?[\])}>] ?| dot | ?점 ?)[A-Za-z0-9\-]+)*$", head) else None


# ---------------------------------------------------------------- detection

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
_RESIDENT = re.compile(r"(?<![\dA-Za-z\-])\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]) ?-? ?\d{7}(?![\d\-]*\d)")
_LICENCE = re.compile(r"(?<![\dA-Za-z\-])\d{2} ?- ?\d{2} ?- ?\d{6} ?- ?\d{2}(?![\-]?\d)")
_PASSPORT = re.compile(r"(?<![A-Za-z0-9\-])[A-Z](?:\d{8}|\d{3}[A-Z]\d{4})(?![A-Za-z0-9])")
_SOCIAL = re.compile(r"(?:SSN|[Ss]ocial [Ss]ecurity)(?: (?:[Nn]umber|[Nn]o\.?))?:? {0,2}(?:is )?(\d{3}-\d{2}-\d{4})(?![\-]?\d)")
#: An international number: country code and 6 to 12 more digits in up to five groups.
_ABROAD = re.compile(r"(?<![\dA-Za-z\-.+])\+(?=(?:[ .\-/()]*\d){8,15}(?![ .\-/()]*\d))\d{1,3}(?:[ .\-/]?\(\d{1,5}\))?(?:[ .\-/]?\d{2,8}|[ .\-/]\d){1,6}(?![\dA-Za-z]|[\-.]\d)")
_PHONE = re.compile(
    r"(?<![\dA-Za-z\-.+])(?:"
    r"\+\d{1,3}[ .\-]?\(?\d{1,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{4}"
    r"|\(?0\d{1,2}(?:\) ?| ?- ?|[ .])\d{3,4}(?: ?- ?|[ .])\d{4}"
    r"|\(?0\d{1,2}\)?\d{7,8}"
    r"|\([2-9]\d{2}\) ?\d{3}[ .\-]\d{4}|[2-9]\d{2}([.\- ])\d{3}\1\d{4}"
    r"|1[5-9]\d{2}-\d{4}"
    r")(?![\dA-Za-z]|[\-.]\d)")
_UNIT = r"(?:,? ?(?:지하 ?)?\d{1,4}동)?(?:,? ?(?:지하 ?)?\d{1,4}(?:호|층)(?: ?\d{1,4}호)?)?"
_ADDRESS_KO = re.compile(
    r"(?<![가-힣])(?:[가-힣]{1,5}(?:특별자치도|도) +)?(?:[가-힣]{1,6}(?:특별시|광역시|특별자치시|시|군) +)?(?:[가-힣]{1,5}(?:구|군) +)?(?:[가-힣]{1,5}(?:읍|면) +)?"
    r"(?:[가-힣]{1,8}(?:로|길)(?: ?\d+(?:번)?길)? ?\d{1,4}(?:-\d{1,4})?(?:번지)?(?![\d:.]|[ ]?(?:월|일|명|시간|분|학점|점|회|개|년|주|원|쪽|퍼센트))" + _UNIT
    + r"|[가-힣]{1,5}(?:동|리|가) +(?:산 ?)?\d{1,4}(?:-\d{1,4})?(?:번지)?(?![\d:.]|[ ]?(?:월|일|명|시간|분|학점|점|회|개|년|주|원|쪽|퍼센트))" + _UNIT + r")(?: ?\([가-힣]{1,5}(?:동|리)\))?")
_ADMIN = re.compile(r"^(?:[가-힣]{1,5}도 +[가-힣]{1,6}[시군]|[가-힣]{1,6}시|[가-힣]{1,5}[군구]) ")
_KINDS = r"(?:Road|Rd\.?|Street|St\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Boulevard|Blvd\.?|Way|Court|Ct\.?|Place|Square|Terrace|Crescent|Close|Alley)"
_ADDRESS_EN = re.compile(
    r"(?<![\dA-Za-z\-])\d{1,5}(?:-\d{1,4})? (?:[A-Z][A-Za-z'\-]* ){1,3}" + _KINDS + r"(?![A-Za-z])"
    r"(?:,? (?:Apt|Unit|Suite|Ste|Floor|Fl|Room|Rm|No|APT|UNIT)\.? ?#?\d{1,4}[A-Za-z]?)?(?:, [A-Z][a-z]+(?:(?: City)|-(?:si|gu|do|gun|dong))?(?:, [A-Z][a-z]+-(?:si|gu|do))?(?![A-Za-z@]))?")

# Korean family names of one syllable, and of two.
_FAMILY = "김이박최정강조윤장임한오서신권황안송류유전홍고문양손배백허남심노하곽성차주우구민진나지엄채원천방공현함변염여추도소석선설마길연위표명기반라왕금옥육인맹제모탁국어은편용예경봉사부가복태목형피두감음빈동온호범좌팽승간상갈서단견당화창궁초"
_FAMILY2 = "남궁|제갈|선우|황보|독고|사공|서문|동방"
_NAME_KO = rf"(?:(?:{_FAMILY2}) ?[가-힣] ?[가-힣]?|[{_FAMILY}] ?[가-힣] ?[가-힣])"
_NOT_NAME = re.compile("(?:입생|학생|취생|졸업생|교수|조교|강사|직원|담당|대표|생활|모두|우리|저희|본인|학과|학교|부서|관리|참가|거주)$")
_AFTER = r"(?=(?: ?(?:학생|선생|교수|조교|님|씨|군|양|에게|께|앞으로|때문|입니다|이라|라고|이며|은 |는 |이 |가 |의 )|,| ?[(/|]|\.|$))"
_BEFORE_KO = re.compile(
    r"(?:(?:담당자?|이름|성명|작성자|신청자|수신|참조|예약자|대표자|보호자|받는 사람|보내는 사람|입금자|발표자|추천인|연락처) ?[:：] ?"
    rf"|(?<![가-힣])(?:신청자|룸메이트|멘토|이름|성명|동기|분실물은|받는 사람은|보내는 사람은|제 이름은|저는) )({_NAME_KO}){_AFTER}")
_TITLE_KO = re.compile(rf"(?<![가-힣])({_NAME_KO})(?= ?(?:선생님|교수님|강사님|조교님|박사님|멘토님|팀장님|님께서|님께|님이|님은|님의|님을|님과|님, |님! |님 |씨가|씨는|씨의|씨를|씨께))")
_W = r"(?:[A-Z][a-z]+(?:[\-'][A-Z]?[a-z]+)?|[A-Z]{2,}(?:[\-'][A-Z]+)?)"
_NAME_EN = rf"(?:(?:[A-Z]\. ?){{1,2}}{_W}|{_W},? {_W}(?: {_W})?|{_W} [A-Z]\. {_W}|{_W}, [A-Z]\.)"
_BEFORE_EN = re.compile(
    r"(?:\b(?:[Mm]y name is|[Nn]ame ?:|[Pp]lease (?:call|ask|see|contact|e-mail|email)|[Mm]entor|[Tt]utor|[Ii]nstructor|[Cc]oordinator|[Aa]dvisor|[Cc]ounsellor|[Rr]oommate|[Rr]egistered as|"
    r"[Aa]ttention:?|[Aa]ttn\.?:?|[Dd]ear|[Ss]igned,?|[Ii] am|[Tt]hank you,?|[Tt]hanks to|c/o|[Aa]sk for|[Ss]peak to|[Ss]incerely,?|[Rr]egards,?|[Ff]rom:|[Tt]o:|[Aa]pplicant:?|[Pp]rofessor|[Ss]tudent)|\b(?:Dr|Prof|Mr|Ms|Mrs)\.?) "
    rf"({_NAME_EN})(?![A-Za-z@])")
#: Common given names (a parameter of the rule for names that stand alone): with a family name behind one of them two
#: capitalised words are a name without any cue beside them.
GIVEN_NAMES = ("James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy "
               "Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Frank Alexander Raymond Patrick Jack Dennis Jerry Mary Patricia Jennifer Linda "
               "Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Sharon Cynthia Kathleen Amy "
               "Angela Anna Pamela Emma Nicole Helen Samantha Katherine Christine Rachel Maria Alice Julia Sofia Ana Carlos Juan Jose Luis Pedro Hans Klaus Pierre Marie Jean Giulia Marco Ivan Olga").split()
_GIVEN = frozenset(GIVEN_NAMES)
_ALONE_EN = re.compile(r"(?<![A-Za-z@.\-])([A-Z][a-z]+)(?= ((?:[A-Z]\. )?[A-Z][a-z]+(?:[\-'][A-Z]?[a-z]+)?)(?![A-Za-z@]))")
_NOT_NAME_EN = re.compile(r"\b(?:The|This|That|University|Office|Desk|Team|Unit|Centre|Center|Students?|Campus|Hall|Studio|Room|Department|Committee|Library|Services?|Support|Student|Course|Courses|Catalog|Catalogue|Station|Nations|School|College|Institute|Street|Road|Award|Prize|Scholarship|Building|Museum|Hospital|All|Sir|Madam|January|February|March|April|May|June|July|August|September|October|November|December)\b", re.I)

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
_RANK = {"id_number": 0, "email": 1, "address": 2, "phone": 3, "name": 4}


def _candidates(t: str):
    digits = any(c.isdigit() for c in t)
    if "@" in t:
        for m in _EMAIL.finditer(t):
            yield "email", m.start(), m.end()
    if digits:
        for p in (_RESIDENT, _LICENCE, _PASSPORT):
            for m in p.finditer(t):
                yield "id_number", m.start(), m.end()
        for m in _SOCIAL.finditer(t):
            yield "id_number", m.start(1), m.end(1)
        if "+" in t:
            for m in _ABROAD.finditer(t):
                if not _PHONE.match(t, m.start()):  # a known form ends where it says
                    yield "phone", m.start(), m.end()
        for m in _PHONE.finditer(t):
            a, b = m.span()
            # A bracket that opens a remark around the number is no part of it.
            if t[a] == "(" and t[b:b + 1] == ")" and t[a - 1:a] != "(":
                a += 1
            if t[a] == "(" and ")" not in t[a:b]:
                a += 1
            yield "phone", a, b
        for m in _ADDRESS_KO.finditer(t):
            if _ADMIN.match(m.group()):
                yield "address", m.start(), m.end()
        for m in _ADDRESS_EN.finditer(t):
            yield "address", m.start(), m.end()
    for p in (_BEFORE_KO, _TITLE_KO):
        for m in p.finditer(t):
            name = m.group(1)
            a = m.start(1)
            b = a + len(name.rstrip())
            if not _NOT_NAME.search(name.replace(" ", "")):
                yield "name", a, b
    for m in _BEFORE_EN.finditer(t):
        if not _NOT_NAME_EN.search(m.group(1)):
            yield "name", m.start(1), m.end(1)
    for m in _ALONE_EN.finditer(t):
        if m.group(1) in _GIVEN and not _NOT_NAME_EN.search(m.group(2)):
            yield "name", m.start(1), m.end(2)


def find(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in source positions, in order."""
    tape = plain(text)
    taken: list[tuple[int, int]] = []
    out = []
    for kind, a, b in sorted(_candidates(tape.text), key=lambda c: (_RANK[c[0]], c[1] - c[2], c[1])):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((kind, *tape.span(a, b)))
    return sorted(out, key=lambda c: c[1:])


def redact(text: str) -> str:
    out, at = [], 0
    for kind, a, b in find(text):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(out) + text[at:]


def personal_spans(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, pii_type, start_pos, end_pos`` of every place."""
    kind = df.schema[doc_id].dataType.simpleString()

    def work():
        def f(b):
            for i, t in zip(b["_id"], b["_text"]):
                for k, s, e in find(t):
                    yield i, k, s, e
        return f

    rows = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text != ''")
    return map_rows(rows, f"{doc_id} {kind}, pii_type string, start_pos int, end_pos int", work)


def redacted(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, text``: the text with typed placeholders (null stays null)."""
    kind = df.schema[doc_id].dataType.simpleString()

    def work():
        def f(b):
            for i, t in zip(b["_id"], b["_text"]):
                yield i, None if t is None else redact(t)
        return f

    return map_rows(df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), f"{doc_id} {kind}, text string", work)
