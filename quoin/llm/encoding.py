"""Garbled text from wrong character encoding: find it and restore it where possible.

Method: best-first graph search. States are texts of one word; edges re-encode a state in a codec it may wrongly have been decoded with and
decode the bytes in the one that may have been meant, or unescape it. Visited states are hashed. A character-plausibility cost, plus a
charge per step, orders the search, and the cheapest text reached wins if it is cheaper than the word as it stands by a margin. Steps
are never free and costs never negative, so a branch whose charges alone reach the best cost is closed without loss.

Costs know the letters of some thirty alphabets: a word whose letters all belong to one of them is plausible, whatever the language. Words are
the unit since texts are often garbled in part only. Only words with an implausible character are searched, and the outcome of
a word does not depend on its document, so outcomes are kept while a task runs. A second pass repairs, with the same steps, words that stand
beside a repaired one and do not get less plausible.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from quoin.session import spread

#: Codecs that bytes are wrongly read with, and codecs that they may have been meant for.
CODECS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "koi8-r", "cp866", "cp850", "cp1250")
#: More codecs that UTF-8 is wrongly read with; more that bytes read as Western ones may have been meant for; those of several bytes a character.
READ, MEANT, WIDE = ("cp1254", "cp1253", "cp1257", "iso8859-2"), ("cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-7"), ("shift_jis", "gbk")
#: Cost from which a word is searched; what a repair must save beyond its steps; charges for a step; states expanded at most.
SUSPECT, MARGIN, STEP, UTF8_STEP, WIDE_STEP, STATES = 2.5, 2.0, 1.0, 0.5, 2.0, 200
#: Charge of one more codec taken for another after a first reading, which seldom happens to one text, and more for each character beyond ASCII.
AGAIN, AGAIN_A_CHARACTER = 2.5, 0.5
#: Charge of a step between codecs that leaves letters of the word as they are.
PARTIAL = 1.0
#: Steps of a path at most; how far above the start a state may cost, at least and more for each character.
DEPTH, WINDOW, WINDOW_A_CHARACTER = 4, 6.0, 0.2
#: What it costs a word to hold valid UTF-8 as read in one of these codecs, which right words hardly do.
UTF8_LIKE, LIKENESS = ("cp1252", "latin-1", "cp1250", "cp1254"), 2.5
#: Characters from which a word is searched in pieces of that length.
LONG = 1_000

#: Relative frequencies of Russian letters in per mille: fixed values.
RUSSIAN = dict(
    zip(
        "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
        (110, 85, 80, 74, 67, 63, 55, 47, 45, 43, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1),
        strict=True,
    )
)
#: Latin letters with marks that Western and Central European words use: fixed values.
COMMON = set("àáâãäåæçèéêëíîïñóôõöøúùûüýßœš" + "žčřěłńśźżőűğışșțćđþð")
#: Letters beyond ASCII of alphabets: fixed values.
ALPHABETS = {
    "Albanian": "çë", "Azerbaijani": "çəğıöşü", "Catalan": "àçèéíïòóúü", "Croatian": "čćđšž", "Czech": "áčďéěíňóřšťúůýž", "Dutch": "áéèëïíóöúü", "Esperanto": "ĉĝĥĵŝŭ",
    "Estonian": "äõöšüž", "French": "àâæçéèêëîïôœùûüÿ", "German": "äöüß", "Hungarian": "áéíóöőúüű", "Icelandic": "áæðéíóöþúý", "Italian": "àèéìíîòóùú", "Latvian": "āčēģīķļņōŗšūž",
    "Lithuanian": "ąčęėįšųūž", "Maltese": "àċġħż", "Nordic": "åäæöøéü", "Polish": "ąćęłńóśźż", "Portuguese": "àáâãçéêíóôõúü", "Romanian": "ăâîșşțţ", "Slovak": "áäčďéíĺľňóôŕšťúýž",
    "Spanish": "áéíñóúü", "Turkish": "âçğıîöşûü", "Welsh": "âêîôûŵŷ",
}
CYRILLIC = {
    "Belarusian": "абвгдеёжзійклмнопрстуўфхцчшыьэюя", "Kazakh": "абвгдеёжзийклмнопрстуфхцчшщъыьэюяәғқңөұүһі", "Macedonian": "абвгдѓежзѕијклљмнњопрстќуфхцчџш",
    "Serbian": "абвгдђежзијклљмнњопрстћуфхцчџш", "Ukrainian": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя",
}
#: Greek letters that no old Western code page holds beside its mathematics: words of Greek have some.
GREEK = set("ικλνοςυωάέήίόύώζηθρχψ")
TYPOGRAPHIC = set("–—’‘“”„«»…•€£¥")
MARKS = set("©®™§¶†‡°·")
ORDINALS = set("ªº²³¹⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺¼½¾")
ISOLATED = set("àÀéÉáÁß")
#: What a text must hold to be searched.
CANDIDATE = r"[^\x00-\x7f]|&#?\w{2,8};"
_SUSPICIOUS = re.compile(CANDIDATE)
#: Words with a character beyond ASCII, or with an escape.
_WORD = re.compile(r"(?<![^ \t\r\n])[!-~]*+[^\x00-\x7f][^ \t\r\n]*")
_ESCAPED = re.compile(r"(?<![^ \t\r\n])(?=[^ \t\r\n]*?(?:[^\x00-\x7f]|&#?\w{2,8};))[^ \t\r\n]+")


def _vietnamese() -> str:
    """Vowels with each tone mark, composed, and the letters that are bases of their own."""
    return "".join(normalize("NFC", v + tone) for v in "aăâeêioôơuưy" for tone in ("\u0300", "\u0301", "\u0303", "\u0309", "\u0323")) + "ăâêôơưđ"


def _masks(alphabets: dict[str, str]) -> dict[str, int]:
    """For each letter, small and capital, the alphabets that have it, as bits."""
    out: dict[str, int] = {}
    for i, letters in enumerate(alphabets.values()):
        for c in letters:
            for form in {c, c.upper() if len(c.upper()) == 1 else c}:
                out[form] = out.get(form, 0) | 1 << i
    return out


_LATIN = _masks(ALPHABETS | {"Vietnamese": _vietnamese()}) | {"İ": _masks(ALPHABETS)["ı"]}
_CYRILLIC = _masks(CYRILLIC)


def _one_alphabet(letters: list[str], masks: dict[str, int]) -> bool:
    """Whether one alphabet has all of the letters."""
    common = -1
    for c in letters:
        common &= masks.get(c, 0)
        if not common:
            return False
    return True


def _tables() -> dict[str, tuple[dict[str, int], list[str]]]:
    out = {}
    for codec in dict.fromkeys((*CODECS, *READ, *MEANT)):
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(codec))
            except UnicodeDecodeError:
                chars.append(chr(b))  # unassigned bytes commonly pass as C1 controls
        out[codec] = ({c: b for b, c in enumerate(chars) if b > 127}, chars)
    return out


_TABLES = _tables()


@lru_cache(maxsize=20_000)
def _usual(c: str) -> bool:
    """Whether a Chinese or Japanese character is among the usual ones: kana, or of the first level of a national standard."""
    if "぀" <= c <= "ヿ" or "가" <= c <= "힣" or c in "、。「」・ー，！？：；（）":
        return True
    for codec, low, high in (("gb2312", 0xB0, 0xD7), ("shift_jis", 0x88, 0x97)):
        try:
            if low <= c.encode(codec)[0] <= high:
                return True
        except UnicodeEncodeError:
            pass
    return False


@lru_cache(maxsize=20_000)
def _kind(c: str) -> str:
    """Class of a character: a (ASCII letter), d (digit), p (other ASCII), l (Latin), c (Cyrillic), g (Greek), j (Chinese, Japanese, Korean), b (box), s (other)."""
    o = ord(c)
    if o < 128:
        return "a" if c.isalpha() else "d" if c.isdigit() else "p"
    if 0x400 <= o < 0x530:
        return "c"
    if 0x370 <= o < 0x400:
        return "g"
    if 0x2500 <= o < 0x25A0:
        return "b"
    if 0x3000 <= o < 0x3100 or 0x4E00 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4 or 0xFF01 <= o < 0xFFA0:
        return "j"
    if c.isalpha() and c not in "ªº" and not 0x2070 <= o < 0x2C00:
        return "l"
    return "s"


def plausibility_cost(text: str, known: bool = True) -> float:
    """How implausible the characters of one word are, beside each other; plain ASCII costs nothing. ``known``: letters that all belong to one
    alphabet are plausible, whichever it is; without it only those of the most usual ones are."""
    kinds = [_kind(c) for c in text]
    total, n = 0.0, len(text)
    letters = [i for i, k in enumerate(kinds) if k in "alc"]
    upper = bool(letters) and not any(text[i].islower() for i in letters)
    latin = known and _one_alphabet([text[i] for i in letters if kinds[i] == "l"], _LATIN)
    cyrillic = known and _one_alphabet([text[i].lower() for i in letters if kinds[i] == "c"], _CYRILLIC)
    greek = not letters and kinds.count("g") > 2 and any(c in GREEK for c in text)
    for i, (c, k) in enumerate(zip(text, kinds)):
        if k in "adp":
            continue
        before, after = kinds[i - 1] if i else " ", kinds[i + 1] if i + 1 < n else " "
        around = before + after
        o = ord(c)
        if o < 0xA0 or o == 0xFFFD:
            total += 8.0
        elif k == "c":
            low = c.lower()
            total += max(0.0, 3.4 - log(RUSSIAN[low])) * 0.6 if low in RUSSIAN else 0.6 if cyrillic and (len(letters) > 1 or n == 1) else 5.0
            if c.isupper() and before in "alc":
                total += 0.5 if upper else 5.0
            total += 4.0 * (before in "alg") + 4.0 * (after in "alg") + 3.0 * (after == "d")
        elif k == "l":
            low = c.lower()
            total += 0.3 if low in COMMON or latin else 3.5
            if c.isupper() and before in "alc" and not upper:
                total += 5.0
            if len(letters) == 1 and c not in ISOLATED:
                total += 4.0
            total += 0.5 * (before == "l") + (1.0 if latin else 3.0) * (before == "l" and i > 1 and kinds[i - 2] == "l") + 4.0 * (before == "c") + 3.0 * (before == "s" and text[i - 1] not in TYPOGRAPHIC)
            total += 3.5 * (after == "d" or ("d" in around and len(letters) == 1))
            if text[i - 1 : i] == "n" and text[i + 1 : i + 2] == "t" and i + 2 >= n - 1 and i > 3:
                total += 3.5  # the place of an apostrophe
            if i and i == letters[-1] and kinds[letters[0]] == "l" and low in "îöôó" and len(letters) > 3:
                total += 3.5  # the place of a closing quote
        elif k == "g" and greek:
            total += 0.2 + 4.0 * ("a" in around or "l" in around or "c" in around)
        elif k == "j":
            total += (0.1 if _usual(c) else 2.0) + 4.0 * ("a" in around or "l" in around or "c" in around)
        elif k == "g":
            total += 1.0 + 4.0 * ("a" in around or "l" in around or "c" in around) + 2.0 * (before == "g" or after == "g")
        elif k == "b":
            total += 0.2 + 5.0 * any(x in "aldcgs" for x in around) + 1.5 * ("▀" <= c <= "▟")
            if after == "b" and (n2 := text[i + 1]) != c and not {c, n2} & {"─", "═"}:
                total += 2.0
        elif c in "¿¡":
            total += 0.4 + 4.0 * (before in "alcd" or after not in "alp")
        elif c in TYPOGRAPHIC:
            total += 0.1 if c == "’" and before in "al" and after in "al" else 0.4 + 2.0 * (n == 1 and c in "„‚“”‘’")
            if c in "€£¥":
                total += 3.0 * (before in "al" and text[i - 1] not in "M" or after in "alc")
            elif c in "„‚…•–—“”‘":
                total += 3.0 * (before in ("alcs" if c in "“”‘„" else "lcs") and after in "alcs")
            elif c in "«»":
                total += 2.0 * (before in "alc" and after in "alc")
        elif c in MARKS:
            total += 0.8 + 2.5 * (before in "alc") + 2.5 * (after in "alc" and c != "°")
        elif c in ORDINALS:
            total += 0.5 + 3.5 * (before in "alc" and c not in "²³¹") + 3.5 * (after in "alc")
        elif c in "≈≤≥≠±×÷−√∞":
            total += 0.8 + 4.0 * ("a" in around or "l" in around or "c" in around)
        elif c == " " or c == " ":
            total += 0.2 + 2.0 * (before == "l" and i > 1 and kinds[i - 2] in "al" and text[i - 1].isupper()) + 2.5 * (before == "l" and len(letters) == 1 and text[i - 1].isupper())
        else:
            total += 3.0 + 1.5 * any(x in "alc" for x in around)
    return total


def _utf8(text: str, codec: str) -> str | None:
    """``text`` with every run that is valid UTF-8, once encoded in ``codec``, decoded; None if there is none."""
    encode = _TABLES[codec][0]
    raw = [encode.get(c, 0) for c in text]
    out, i, n, changed = [], 0, len(text), False
    while i < n:
        b = raw[i]
        size = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
        if size > 1 and i + size <= n:
            try:
                out.append(bytes(raw[i : i + size]).decode("utf-8"))
                i, changed = i + size, True
                continue
            except UnicodeDecodeError:
                pass
        out.append(text[i])
        i += 1
    return "".join(out) if changed else None


def _single(text: str, wrong: str, meant: str) -> str | None:
    """``text`` re-encoded in ``wrong`` and decoded in ``meant``. Letters that ``wrong`` does not have were never garbled by it and stay; any other
    such character rules the step out."""
    encode, chars = _TABLES[wrong][0], _TABLES[meant][1]
    out = []
    for c in text:
        if ord(c) < 128:
            out.append(c)
        elif (b := encode.get(c)) is not None:
            out.append(chars[b])
        elif _kind(c) in "cl":
            out.append(c)
        else:
            return None
    return "".join(out)


def _partial(text: str, step: tuple[str, str]) -> bool:
    """Whether a step between codecs of one byte a character leaves letters as they are."""
    if step[0] == "escape" or step[1] == "utf-8" or step[1] in WIDE:
        return False
    encode = _TABLES[step[0]][0]
    return any(ord(c) > 127 and c not in encode for c in text)


def _wide(text: str, wrong: str, meant: str) -> str | None:
    """``text`` as a codec of several bytes a character; None if it is not valid in it, or gives fewer than two such characters."""
    encode = _TABLES[wrong][0]
    raw = bytearray()
    for c in text:
        if (b := ord(c) if ord(c) < 128 else encode.get(c)) is None:
            return None
        raw.append(b)
    try:
        new = bytes(raw).decode(meant)
    except UnicodeDecodeError:
        return None
    return new if sum(_kind(c) == "j" for c in new) > 1 else None


def apply_step(text: str, step: tuple[str, str]) -> str | None:
    """The text after one step, or None where the step does not apply."""
    wrong, meant = step
    if wrong == "escape":
        new = html.unescape(text)
    elif meant == "utf-8":
        new = _utf8(text, wrong)
    elif meant in WIDE:
        new = _wide(text, wrong, meant)
    else:
        new = _single(text, wrong, meant)
    return None if new == text else new


STEPS: list[tuple[str, str]] = [(a, "utf-8") for a in (*CODECS, *READ)] + [("escape", "html")] + [(a, b) for b in CODECS for a in CODECS if a != b and {a, b} != {"latin-1", "cp1252"}]
STEPS += [(a, b) for a in ("cp1252", "latin-1") for b in (*MEANT, *WIDE)] + [(a, "iso8859-5") for a in ("cp1251", "koi8-r")]


def _charge(step: tuple[str, str]) -> float:
    return 0.0 if step[0] == "escape" else UTF8_STEP if step[1] == "utf-8" else WIDE_STEP if step[1] in WIDE else STEP


#: Steps that are taken first or not at all.
_FIRST = {s for s in STEPS if s[1] in (*MEANT, *WIDE)}
_CHARGED = [(step, _charge(step)) for step in STEPS]


@lru_cache(maxsize=200_000)
def restore_word(word: str) -> tuple[str, tuple[tuple[str, str], ...], bool]:
    """The cheapest text reachable from ``word``, the steps to it, and whether the search ended at a bound before it had found one; the word itself and
    no steps if nothing is cheaper by the margin."""
    own = plausibility_cost(word)
    if "&" in word:  # an escape hides what it stands for
        own = max(own, plausibility_cost(html.unescape(word)))
    if any(_utf8(word, codec) for codec in UTF8_LIKE):
        own += LIKENESS
    if own < SUSPECT:
        return word, (), False
    best, path, least = word, (), own - MARGIN
    heap = [(own, 0, word, (), 0.0)]
    seen = {hash(word)}
    again = AGAIN + AGAIN_A_CHARACTER * sum(ord(c) > 127 for c in word)
    expanded = pushed = 0
    bounded = False
    while heap:
        _, _, text, steps, charged = heapq.heappop(heap)
        if expanded == STATES or len(steps) == DEPTH:
            bounded = True
            if expanded == STATES:
                break
            continue
        expanded += 1
        for step, charge in _CHARGED:
            if charged and step in _FIRST:
                continue
            charge += charged + (again if charged and charge >= STEP else 0.0)
            if charge >= least and step[0] != "escape":  # what it led to could not be cheaper
                continue
            new = apply_step(text, step)
            if new is None or (h := hash(new)) in seen:
                continue
            seen.add(h)
            taken = (*steps, step)
            if _partial(text, step):  # beside letters that stay, only signs are told
                if any(a != b and b not in TYPOGRAPHIC for a, b in zip(text, new)):
                    continue
                charge += PARTIAL
            total = plausibility_cost(new) + charge
            if total < least and (len(word) > 1 or new in TYPOGRAPHIC):  # one letter alone is no ground for another letter
                best, path, least = new, taken, total
            if charge < least and total < own + WINDOW + WINDOW_A_CHARACTER * len(word):
                pushed += 1
                heapq.heappush(heap, (total, pushed, new, taken, charge))
    return best, path, bounded and not path


def restore(text: str) -> tuple[str, list[str], bool]:
    """(restored text, steps used, whether characters are lost for good). No steps and no loss: the text is left alone."""
    return _restore(text)[:3]


def _restore(text: str) -> tuple[str, list[str], bool, int]:
    """``restore`` and the number of words whose search ended at a bound."""
    if not _SUSPICIOUS.search(text):
        return text, [], False, 0
    words = list((_ESCAPED if "&" in text else _WORD).finditer(text))
    found = [restore_word(m.group()) if m.end() - m.start() <= LONG else _long(m.group()) for m in words]
    fixed = [f[:2] for f in found]
    bounded = sum(f[2] for f in found)
    decoded = [any(s[0] != "escape" for s in steps) for _, steps in fixed]
    if any(decoded):
        for i, m in enumerate(words):
            if decoded[i]:
                continue
            word = m.group()
            for j in (i - 1, i + 1):
                if 0 <= j < len(words) and decoded[j] and (new := _follow(word, fixed[j][1])) and _strict(new) < _strict(word) - 0.1:
                    fixed[i] = (new, fixed[j][1])
                    break
        votes = Counter(steps for _, steps in fixed if steps)
        usual, most = votes.most_common(1)[0]
        for i, m in enumerate(words):  # the text's usual reading goes before a somewhat cheaper one that is rare in it
            now, steps = fixed[i]
            if steps == usual or (steps and most < 2 * votes[steps]):
                continue
            if (new := _follow(m.group(), usual)) and _strict(new) < min(_strict(m.group()) - 0.5, _strict(now) + (1.5 if steps else 0.0)):
                fixed[i] = (new, usual)
    out: list[str] = []
    used: dict[str, None] = {}
    at = 0
    for m, (new, steps) in zip(words, fixed):
        if not any(s[0] != "escape" for s in steps):
            continue
        out += [text[at : m.start()], new]
        at = m.end()
        used.update(dict.fromkeys(f"{a}>{b}" for a, b in steps))
    return "".join([*out, text[at:]]), list(used), "�" in text, bounded


def _strict(word: str) -> float:
    """Plausibility in a text that is known to be garbled: there the alphabets of other languages prove nothing."""
    return plausibility_cost(word, known=False)


def _follow(word: str, steps: tuple[tuple[str, str], ...]) -> str | None:
    """``word`` after the ``steps`` that apply to it; None if none does."""
    new = word
    for step in steps:
        new = apply_step(new, step) or new
    return new if new != word else None


def _long(word: str) -> tuple[str, tuple, bool]:
    """A word beyond all usual length is searched in pieces, so that cost stays in proportion; none of it is skipped."""
    parts, steps, i, bounded = [], (), 0, False
    while i < len(word):
        end = i + LONG
        while end < min(len(word), i + 2 * LONG) and ord(word[end]) > 127:  # no cut within a garbled sequence
            end += 1
        new, own, ended = restore_word(word[i:end])
        bounded |= ended
        parts.append(new)
        steps = steps or own
        i = end
    return "".join(parts), steps, bounded


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [_restore(t) for t in batch.column("text").to_pylist()]
        keep = [i for i, d in enumerate(done) if d[1] or d[2]]
        if keep:
            rows = batch.take(pa.array(keep))
            own = [pa.array([done[i][j] for i in keep], kind) for j, kind in enumerate((pa.string(), pa.list_(pa.string()), pa.bool_(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([rows.column(0), *own], names=["key", "restored", "steps", "lossy", "bounded"])


def garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text is garbled, wholly or in part: ``key``, restored, steps, lossy and bounded.

    ``restored``: the text with every garbled word replaced that could be restored; ``steps``: "wrong>meant" codec pairs, in order of first
    use, empty if nothing could be restored; ``lossy``: it holds U+FFFD, whose original is gone; ``bounded``: how many suspicious words were left alone
    because their search ended at ``STATES`` states or ``DEPTH`` steps. Null, empty and plain ASCII texts are never garbled
    and are filtered before Python sees them, but for HTML escapes, which are resolved only on the way to a decoding. Whole texts are searched.
    Repeated rows come out as often as they go in; other columns are ignored.
    """
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).where(F.col("text").rlike(CANDIDATE))
    schema = StructType(
        [StructField("key", df.schema[key].dataType), StructField("restored", StringType()), StructField("steps", ArrayType(StringType())), StructField("lossy", BooleanType()), StructField("bounded", IntegerType())]
    )
    return rows.mapInArrow(_task, schema).withColumnRenamed("key", key)
