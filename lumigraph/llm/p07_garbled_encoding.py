"""Problem 7: text that was decoded with a wrong character encoding, found and restored where possible.

Characters are mapped back to the bytes of a legacy encoding. A byte-structure automaton (the well-formed sequences of
UTF-8, Shift-JIS, EUC-JP, GB18030, Big5 or EUC-KR, compiled over the characters that stand for each byte) finds the
maximal multibyte spans, and only those spans are decoded; the rest of the text stays as it is. This is repeated for
text garbled more than once. Byte pairs of several encodings of East Asia look alike: a reading is plausible if all its
characters are in the part of the encoding that holds the common ones, and the original is given only if one reading is.
Text of one single-byte encoding read as another has no such structure: there the words tell. A word is odd if
it mixes scripts, has a sign inside, changes case within or has hardly a plain letter; a pair of encodings is accepted
if it leaves (nearly) no odd word, and the original is given only if no other reading is about as good. Replacement characters and C1 controls are traces of a wrong decoding that can't be
undone. Plain ASCII fields never leave the JVM; the others go through Arrow, each distinct text judged once a task.

Defined results: null, blank and ASCII texts are no cases, nor are rows without an id; a case that can't be restored (wholly) has restored null;
every row is judged by itself, so repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.session import table

#: Encodings that text is wrongly read in; those of Latin scripts, and those whose letters take the place of lead bytes.
LATIN_CODECS = ["cp1252", "latin-1", "cp1250", "iso8859-2", "mac_roman", "cp437", "cp850", "cp1254", "cp1257", "iso8859-15"]
OTHER_CODECS = ["cp1251", "cp1253", "koi8-r", "cp866", "iso8859-5", "iso8859-7", "mac_cyrillic", "cp1255", "cp1256"]
#: Of the Latin ones those that have signs in place of most lead bytes.
SIGN_CODECS = ("mac_roman", "cp437", "cp850")
#: (read as, written as) of single-byte confusions, the more common first.
SINGLE = [
    (wrong, right)
    for right in ("cp1252", "cp1251", "cp1253", "iso8859-7", "koi8-r", "cp866", "mac_roman", "cp850")
    for wrong in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp1253", "koi8-r", "cp437", "cp850", "cp866", "cp1250", "iso8859-7")
    if wrong != right and {wrong, right} != {"cp1252", "latin-1"} and {wrong, right} != {"cp1253", "iso8859-7"}
]
MAX_LAYERS = 4


def _byte_chars(codec: str) -> dict[int, str]:
    """Characters that stand for each byte from 0x80: the codec's, and the C1 control where it has none."""
    out = {}
    for b in range(0x80, 0x100):
        c = bytes([b]).decode(codec, "replace")
        out[b] = (c if c != "�" else "") + (chr(b) if b < 0xA0 and c != chr(b) else "")
    return out


def _automaton(codec: str, kind: str) -> tuple[re.Pattern, dict[int, int]]:
    chars = _byte_chars(codec)

    def cls(*ranges: tuple[int, int]) -> str:
        s = "".join(chars.get(b, chr(b)) for lo, hi in ranges for b in range(lo, hi + 1))
        return "[" + re.escape(s) + "]" if s else r"(?!)"

    t = cls((0x80, 0xBF))
    if kind == "utf-8":
        body = "|".join([
            cls((0xC2, 0xDF)) + t, cls((0xE0, 0xE0)) + cls((0xA0, 0xBF)) + t, cls((0xE1, 0xEC), (0xEE, 0xEF)) + t + t, cls((0xED, 0xED)) + cls((0x80, 0x9F)) + t,
            cls((0xF0, 0xF0)) + cls((0x90, 0xBF)) + t + t, cls((0xF1, 0xF3)) + t + t + t, cls((0xF4, 0xF4)) + cls((0x80, 0x8F)) + t + t,
        ])
    elif kind == "cp932":
        body = cls((0x81, 0x9F), (0xE0, 0xFC)) + cls((0x40, 0x7E), (0x80, 0xFC))
    elif kind == "gb18030":
        body = cls((0xA1, 0xA3), (0xB0, 0xD7)) + cls((0xA1, 0xFE))
    elif kind == "big5":
        body = cls((0xA1, 0xA1), (0xA4, 0xC6)) + cls((0x40, 0x7E), (0xA1, 0xFE))
    elif kind == "euc_kr":
        body = cls((0xA1, 0xA3), (0xB0, 0xC8)) + cls((0xA1, 0xFE))
    else:
        body = cls((0xA1, 0xFE)) + cls((0xA1, 0xFE))
    return re.compile(f"(?:{body})+"), {ord(c): b for b, cs in chars.items() for c in cs}


_UTF8 = [(c, *_automaton(c, "utf-8")) for c in LATIN_CODECS + OTHER_CODECS]
_ALIEN = {c: {chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode(c, "replace") not in (chr(b), "�")} for c in LATIN_CODECS + OTHER_CODECS}
_JAPANESE = [(c, k, *_automaton(c, k)) for k in ("cp932", "euc_jp") for c in ("cp1252", "latin-1", "mac_roman", "cp1251", "cp1250")]
#: Two-byte encodings whose common characters are told by their lead bytes; read as an encoding of Western Europe.
_EAST = [(k, *_automaton(c, k)) for k in ("gb18030", "big5", "euc_kr") for c in ("cp1252", "latin-1")]
#: Ranges of common Chinese and Korean characters, and of signs written beside them.
_EAST_TEXT = {"gb18030": re.compile("[一-鿿　-〗！-～]+"), "big5": re.compile("[一-鿿　-〗！-～]+"), "euc_kr": re.compile("[가-힣　-〗！-～]+")}

#: Ranges of characters that restored text may hold.
_EXPECTED = re.compile(
    r"[ -ſƒȘ-țˆ˜΄-ώЀ-џҐґẞ‐-‧‰-›€℃№™←-↓∀-≥　-ヿ一-鿿！-ﾟ﻿]*"
)
_JAPANESE_TEXT = re.compile(r"[　-ヿ一-鿿！-～]+")
_KANA = re.compile(r"[ぁ-ヺ]")
_CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")


def _decoded(span: str, back: dict[int, int], codec: str) -> str | None:
    try:
        return bytes(back.get(ord(c), ord(c) & 0xFF) for c in span).decode(codec)
    except UnicodeDecodeError:
        return None


def _latin(c: str) -> bool:
    return c.isalpha() and (c < "ɐ" or "Ḁ" <= c < "ἀ")


def _multibyte(text: str) -> str | None:
    """The text with its multibyte spans decoded by the encoding that explains most of them; null if there is none.

    A span that could be chance counts only beside one that can't.
    """
    best, gain = None, (0, 0, 0.0)
    for n, (codec, rx, back) in enumerate(_UTF8):
        spans, sure = [], codec not in SIGN_CODECS and n < len(LATIN_CODECS)
        for m in rx.finditer(text):
            d = _decoded(m[0], back, "utf-8")
            if d is None or not _EXPECTED.fullmatch(d) or _CONTROL.search(d):
                continue
            before, after = text[m.start() - 1 : m.start()] or " ", text[m.end() : m.end() + 1] or " "
            if codec in SIGN_CODECS:  # letters alone can fall together by chance
                sure |= not m[0][0].isalpha() or len(m[0]) >= 8
                spans.append((m.start(), m.end(), d))
                continue
            sure |= len(d) > 1 or _latin(d) and (_latin(before) or _latin(after)) or not d.isalpha() and bool(re.search("[A-Za-z]", text))
            spans.append((m.start(), m.end(), d))
        covered = sum(e - s for s, e, _ in spans)
        alien = sum(c in _ALIEN[codec] for s, e, _ in spans for c in text[s:e])  # controls where the encoding has a character of its own
        rank = covered, -alien, _commonness("".join(d for _, _, d in spans))
        if sure and rank > gain:
            best, gain = _replaced(text, spans), rank
    for codec, kind, rx, back in _JAPANESE:
        spans, sure = [], False
        for m in rx.finditer(text):
            d = _decoded(m[0], back, kind)
            if d is None or not _JAPANESE_TEXT.fullmatch(d):
                continue
            leads = codec in ("cp1252", "latin-1") and all(back.get(ord(c), 0xFF) < 0xA0 for c in m[0][::2])
            sure |= bool(_KANA.search(d)) and len(d) > 1 or kind == "cp932" and (bool(_CONTROL.search(m[0])) or len(d) > 1 and leads)
            spans.append((m.start(), m.end(), d))
        covered = sum(e - s for s, e, _ in spans)
        if sure and covered > gain[0] and covered >= 0.5 * len(text.strip()):
            best, gain = _replaced(text, spans), (covered, 0, 0.0)
    return best


def _eastern(text: str) -> list[str]:
    """The readings of a text as Chinese or Korean: all its characters beyond ASCII lie in spans of common characters of one encoding."""
    out = []
    for kind, rx, back in _EAST:
        spans = [(m.start(), m.end(), _decoded(m[0], back, kind)) for m in rx.finditer(text)]
        inside = sum(ord(c) > 127 for s, e, _ in spans for c in text[s:e])
        if inside < 4 or inside < sum(ord(c) > 127 for c in text) or any(d is None or not _EAST_TEXT[kind].fullmatch(d) for _, _, d in spans):
            continue
        out.append(_replaced(text, spans))
    return sorted(set(out))


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, d in spans:
        out += [text[at:s], d]
        at = e
    return "".join([*out, text[at:]])


#: Signs that are sound next to letters, and non-ASCII letters of Western words and of Russian.
_SOUND_SIGNS = set("’‘'·–—…«»“”„°ªº™®©‐- 　、。・ー")
_RUSSIAN = set("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
#: Frequent letters of the languages, to choose between readings without odd words.
_COMMON = set("оеаинтсрвлкмдпуя" "αοιετσνηυρπκμλςάέίόή" "áéíóúñçãõàèòâêôîäöüß·")
#: By how much a reading must have more frequent letters than any other to be given as the original.
CLEARLY = 0.1
_CURRENCY = set("€£¥¢¤$©®±¿¡§«½¼¾№°")


def _script(c: str) -> str:
    if _latin(c):
        return "L"
    if "Ͱ" <= c < "Ѐ":
        return "G"
    return "C" if "Ѐ" <= c < "԰" else "O"


def _odd(word: str, in_latin: bool) -> bool:
    """Whether a word looks like a single-byte encoding read as another."""
    if word.isascii():
        return False
    if word in ("¬", "√"):
        return in_latin
    letters = [c for c in word if c.isalpha() and c not in "ªºµ"]
    scripts = {_script(c) for c in letters}
    if len(scripts) > 1 or any("ﬀ" <= c <= "ﬆ" or "─" <= c <= "▟" for c in word) or _CONTROL.search(word):
        return True
    core = word.strip("\"'.,;:!?()[]{}<>-–—…“”«»„")
    other = [c for c in letters if ord(c) > 127]
    if scripts == {"L"}:
        if len(other) >= 2 and (len(other) == len(letters) or len(letters) >= 4 and len(other) > 0.6 * len(letters)):
            return True
    elif in_latin and scripts and scripts <= {"C", "G"} and (len(letters) == 1 or scripts == {"C"} and not set(letters) <= _RUSSIAN):
        return True
    for a, b in zip(core, core[1:]):
        if a.islower() and b.isupper() and (ord(a) > 127 or ord(b) > 127 or scripts != {"L"}):
            return True
        if a.isupper() and b.islower() and ord(b) > 127 and core[:2] != a + b and scripts == {"L"} and core.upper() != core and sum(c.isupper() for c in letters) > 2:
            return True
    for i, c in enumerate(core):
        if ord(c) > 127 and not c.isalpha() and not unicodedata.category(c).startswith("M"):
            before, after = core[i - 1 : i].isalpha(), core[i + 1 : i + 2].isalpha()
            if c in _SOUND_SIGNS or c.isnumeric():
                if before and after and c in "°™®©¹²³¼½¾":
                    return True
            elif before and (after or c not in "!?%") or after and c not in "¿¡#@&€£§±":
                return True
    return bool(re.fullmatch(r"[^\x00-\x7f]\d{2,}", core)) and core[0].isalpha()


def _odd_words(text: str) -> int:
    in_latin = bool(re.search(r"[A-Za-z]{3,}", text))
    return sum(_odd(w, in_latin) for w in text.split())


_TABLES: dict[tuple[str, str], dict[int, str]] = {}
for _wrong, _right in SINGLE:
    _TABLES[_wrong, _right] = {}
    for _b in range(0x80, 0x100):
        _c, _d = bytes([_b]).decode(_wrong, "replace"), bytes([_b]).decode(_right, "replace")
        if _c != "�":
            _TABLES[_wrong, _right][ord(_c)] = _d


def _commonness(text: str) -> float:
    """Share of frequent letters among the characters beyond ASCII."""
    foreign = [c for c in text.lower() if ord(c) > 127]
    return sum(c in _COMMON for c in foreign) / max(1, len(foreign))


def _single_byte(text: str) -> tuple[bool, str | None]:
    """(whether another single-byte encoding leaves nearly no odd word, the text so read if no other reading is about as good)."""
    odd = _odd_words(text)
    if not odd:
        return False, None
    ranked: dict[str, tuple[int, float]] = {}
    high = {ord(c) for c in text if ord(c) > 127}
    for pair in SINGLE:
        t = _TABLES[pair]
        if not high <= t.keys() or any(not t[c].isprintable() or t[c] == "�" for c in high):
            continue
        candidate = text.translate(t)
        if candidate in ranked or re.fullmatch(r"[^\x00-\x7f]\d{2,}.*", text) and candidate[0] not in _CURRENCY:
            continue
        ranked[candidate] = (_odd_words(candidate), 1 - _commonness(candidate))
    best = sorted(((r, n, c) for n, (c, r) in enumerate(ranked.items()) if r[0] < odd))[:2]
    if not best or best[0][0][0] > odd / 3:
        return False, None
    rivals = [*(c for r, _, c in best[1:] if r[0] == best[0][0][0] and r[1] - best[0][0][1] < CLEARLY), *_eastern(text)]
    return True, None if rivals else best[0][2]


#: A two-byte letter whose second byte was lost or turned into a space: a trace of a wrong decoding, the letter is gone.
_LOST = re.compile(r"(?<=[a-zà-ÿ])Ã(?: (?=[a-zà-ÿ])|(?=[a-zà-ÿ]|$))")


_REFERENCE = re.compile(r"&#(?:\d+|x[0-9a-fA-F]+);")


def _character(m: re.Match) -> str:
    """The character of a numeric reference as it stands: numbers of bytes from 0x80 are not read as cp1252."""
    n = int(m[0][3:-1], 16) if m[0][2] in "xX" else int(m[0][2:-1])
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]


def repair(text: str | None) -> tuple[bool, str | None]:
    """(whether a text was decoded wrongly, the original where it can be restored)."""
    if text is None or text.isascii() and "&#" not in text:
        return False, None
    now, found, sure = text, False, True
    if "&#" in text:
        now = _REFERENCE.sub(_character, text)
    for _ in range(MAX_LAYERS):
        better = _multibyte(now)
        if better is None or better == now or _odd_words(better) and _eastern(now):  # chance spans in pairs of another encoding
            break
        now, found = better, True
    if _LOST.search(now):
        found, sure = True, False
    else:
        east = _eastern(now) if not found and _odd_words(now) else []
        hit, better = _single_byte(now)
        if hit or east:
            readings = {*east, *([better] if better else [])}
            found, sure = True, len(readings) == 1
            now = readings.pop() if sure else now
    if "�" in now or _CONTROL.search(now):
        return True, None
    return found, now if found and sure else None


def garbled_fields(df: DataFrame, fields: list[str], id_col: str = "row_id") -> DataFrame:
    """(row_id, field_name, text, restored): one row per field decoded wrongly."""
    long = df.select(F.col(id_col).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("f"))
    suspects = long.select("row_id", "f.field_name", "f.text").filter(F.col("row_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]|&#"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[bool, str | None]] = {}
        for b in batches:
            if len(known) > 200_000:
                known.clear()
            verdicts = []
            for t in b["text"].tolist():
                if t not in known:
                    known[t] = repair(t)
                verdicts.append(known[t])
            hit = pd.Series([v[0] for v in verdicts], index=b.index, dtype=bool)
            yield b.assign(restored=[v[1] for v in verdicts])[hit]

    return suspects.mapInPandas(run, "row_id bigint, field_name string, text string, restored string")


FIELDS = ["img_alt_text", "organization_name"]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_fields(table(spark, sf_dir, "images_meta"), FIELDS).select("row_id", "field_name")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_fields(table(spark, sf_dir, "images_meta"), FIELDS)


QUERIES = {"p7_found": p7_found, "p7_restored": p7_restored}
