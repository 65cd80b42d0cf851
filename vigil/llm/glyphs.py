"""One consistent form for texts that look the same.

A transducer over grapheme clusters reads a text once, left to right. Text between special characters passes unread. At each
stretch of them it takes the longest match: a line break written as two characters, else a character with all marks and
widthless signs that follow it, else one character that has an image of its own. A cluster's image is looked up in a table
that is computed beforehand from Unicode data and the fixed look-alikes below; clusters with several marks are composed
from it. The images of whole stretches are remembered, as words repeat.

What is the same: full- and half-width forms, composed and decomposed accents, signs without width (absent or present),
all sorts of blank, line breaks however written, and letters and points of different alphabets drawn the same. What is not:
case, accents, superscripts, circled or roman numerals, ligatures, mathematical alphabets, the number of blanks and line breaks.
Signs without width that change what is seen stay: overrides of the direction of writing, the joiner between two pictographs
(a family is not two persons), and the tags that make a flag of the black one.

Null stays null and the empty text stays empty. The form is idempotent: applied twice it changes nothing.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata as ud
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from vigil.session import written

#: Letters drawn the same, as pairs of strings read in parallel; each letter of the first becomes that of the second. Fixed values.
LOOK_ALIKES = [
    ("АВЕЅІЈКМНОРСТХԚԜ", "ABESIJKMHOPCTXQW"),  # Cyrillic capitals
    ("аеорсухѕіјһԁԛԝ", "aeopcyxsijhdqw"),  # Cyrillic small letters
    ("ӀѴҮԌ", "IVYG"),  # further Cyrillic capitals: palochka, izhitsa, straight u, komi sje
    ("ӏѵ", "lv"),  # further Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek capitals
    ("οϲϳρ", "ocjp"),  # Greek small letters
    ("ՕՍՏԼ", "OUSL"),  # Armenian capitals
    ("օոսհցզ", "onuhgq"),  # Armenian small letters
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),  # Cherokee
    ("ꓐꓚꓓꓝꓖꓧꓙꓗꓡꓟꓠꓳꓑꓢꓔꓴꓦꓪꓫꓬꓜ", "BCDFGHJKLMNOPSTUVWXYZ"),  # Lisu
    ("ÐƉ", "ĐĐ"),  # eth and African d, drawn like d with stroke
    ("әǝӘ", "əəƏ"),  # schwa
    ("ӨөƩԐԑ", "ƟɵΣƐɛ"),  # barred o, esh, reversed ze
    ("∶꞉։", ":::"),  # ratio sign, modifier colon, Armenian full stop
    ("․∕∣ǀ", "./||"),  # one dot leader, division slash, divides, dental click
    ("ϹͿ", "CJ"),  # Greek capitals: lunate sigma, yot
    ("ГПФ", "ΓΠΦ"),  # Cyrillic capitals like Greek ones
    ("µ", "μ"),  # micro sign
    ("‐‑", "--"),  # hyphen, non-breaking hyphen
]
#: Parts into which the copies of one text are split while pairs are made.
SALTS = 8
LINE_BREAKS = "\n\r\v\f\x85\u2028\u2029"
#: Format characters that are drawn.
_DRAWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Without width although no format characters: grapheme joiner, Hangul fillers, Khmer inherent vowels, variation selectors.
_OVERRIDES = {0x202D, 0x202E}
_JOINER, _FLAG = "\u200d", "\U0001f3f4"
_TAGS = re.compile("[\U000e0020-\U000e007f]+")
_WIDTHLESS = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Blanks that Unicode does not class as such: tab, Hangul fillers with width, empty Braille cell. The Ogham mark is drawn.
_BLANKS = {0x9, 0x3164, 0xFFA0, 0x2800}
_NOT_BLANK = {0x1680}
#: Medial and final Hangul letters, which join the letter before them by rule.
_HANGUL_JOINED = [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]


def is_widthless(ch: str) -> bool:
    """Whether a sign takes no room and shows nothing."""
    code, kind = ord(ch), ud.category(ch)
    return code in _WIDTHLESS or kind == "Cf" and code not in _DRAWN | _OVERRIDES or kind == "Cc" and ch not in LINE_BREAKS and ch != "\t"


def is_blank(ch: str) -> bool:
    """Whether a sign shows as a blank within a line."""
    return ord(ch) in _BLANKS or ud.category(ch) == "Zs" and ord(ch) not in _NOT_BLANK


def is_pictograph(ch: str) -> bool:
    """Whether a sign is a pictograph, or a skin tone or sign of sex that goes with one."""
    return 0x1F000 <= ord(ch) <= 0x1FAFF or 0x2600 <= ord(ch) <= 0x27BF


class Transducer:
    """The compiled transducer. Compiling checks the tables for conflicts and raises ValueError if there is one."""

    def __init__(self, look_alikes: list[tuple[str, str]] = LOOK_ALIKES):
        self.letters = self._checked(look_alikes)
        self.widthless: set[str] = set()
        self.base: dict[str, str] = {}
        joined = set(map(chr, _HANGUL_JOINED))
        for ch in map(chr, range(sys.maxunicode + 1)):
            kind = ud.category(ch)
            if kind in ("Cn", "Co", "Cs"):
                continue
            if is_widthless(ch):
                self.widthless.add(ch)
                continue
            image = self._single(ch)
            if image != ch:
                self.base[ch] = image
            parts = ud.decomposition(ch)
            if ud.combining(ch) or ud.combining(ud.normalize("NFD", image)[0]):
                joined.add(ch)
            if parts and parts[0] != "<" and " " in parts:
                joined.add(chr(int(parts.split()[1], 16)))
        for ch in self.base.values():
            if self._single(ch[0]) != ch[0] and len(ch) == 1:
                raise ValueError(f"the image {ch!r} has another image")
        self.follows = frozenset(joined | self.widthless)
        own = set(self.base) | self.widthless
        follows, widthless = self._class(self.follows), self._class(self.widthless)
        self.match = re.compile(rf"\r{widthless}*\n|(?s:.){follows}+|{self._class(own)}")
        special = self._class(own | self.follows)
        self.special = re.compile(rf"(?:{special}+\n?)+")
        self.only_widthless = re.compile(rf"{widthless}+")
        self.cluster = lru_cache(maxsize=50_000)(self._cluster)
        self.stretch = lru_cache(maxsize=200_000)(lambda text: self.match.sub(lambda m: self.cluster(m[0]), text))

    @staticmethod
    def _class(chars: set[str]) -> str:
        """A character class in ranges."""
        codes, out, at = sorted(map(ord, chars)), [], 0
        while at < len(codes):
            end = at
            while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
                end += 1
            out.append(rf"\U{codes[at]:08x}-\U{codes[end]:08x}")
            at = end + 1
        return f"[{''.join(out)}]"

    @staticmethod
    def _checked(look_alikes: list[tuple[str, str]]) -> dict[str, str]:
        table: dict[str, str] = {}
        for left, right in look_alikes:
            if len(left) != len(right):
                raise ValueError(f"{left!r} and {right!r} differ in length")
            for a, b in zip(left, right):
                if table.setdefault(a, b) != b:
                    raise ValueError(f"{a!r} would become both {table[a]!r} and {b!r}")
        if loops := set(table) & set(table.values()):
            raise ValueError(f"both a source and a target: {sorted(loops)}")
        return table

    def _single(self, ch: str) -> str:
        """The image of one character on its own."""
        if ch in LINE_BREAKS:
            return "\n"
        if is_blank(ch):
            return " "
        parts = ud.decomposition(ch)
        if parts.startswith(("<wide>", "<narrow>")):
            ch = "".join(chr(int(x, 16)) for x in parts.split()[1:])
            if is_blank(ch[0]):
                return " "
        return ud.normalize("NFC", "".join(self.letters.get(x, x) for x in ud.normalize("NFD", ch)))

    def _cluster(self, cluster: str) -> str:
        """The image of a cluster: widths and look-alikes of its characters, widthless signs dropped, accents composed."""
        if len(cluster) == 1:
            return "" if cluster in self.widthless else self.base.get(cluster, cluster)
        if cluster[0] == "\r" and cluster[-1] == "\n":
            return "\n"
        return ud.normalize("NFC", "".join(self.base.get(x, x) for x in cluster if x not in self.widthless))

    def apply(self, text: str | None) -> str | None:
        """The consistent form of a text."""
        if text is None or text.isascii() and not _ASCII_ODD.search(text):
            return text
        out, at, follows = [], 0, self.follows
        for m in self.special.finditer(text):
            a, b = m.span()
            run = m[0]
            if a > at and run[0] in follows:
                a -= 1
                if text[a] == _FLAG and (tags := _TAGS.match(text, a + 1)):
                    out.append(text[at : tags.end()])
                    at, a, run = tags.end(), tags.end(), text[tags.end() : b]
                elif _JOINER in run and b < len(text) and is_pictograph(text[a]) and is_pictograph(text[b]) and self.only_widthless.fullmatch(run):
                    out.append(text[at : a + 1])
                    out.append(_JOINER)
                    at = b
                    continue
                else:
                    run = text[a:b]
            out.append(text[at:a])
            out.append(self.stretch(run) if len(run) <= 64 else self.match.sub(lambda m: self.cluster(m[0]) if len(m[0]) <= 64 else self._cluster(m[0]), run))
            at = b
        out.append(text[at:])
        return "".join(out)


_ASCII_ODD = re.compile(r"[\x00-\x09\x0b-\x1f\x7f]")


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """The transducer with the fixed tables, compiled once per process."""
    return Transducer()


def _each(texts: pd.Series, image) -> pd.Series:
    """image of every text, null for null; copies within a batch are done once."""
    places, distinct = pd.factorize(texts)
    images = [image(t) for t in distinct]
    return pd.Series([images[i] if i >= 0 else None for i in places], dtype=object)


@F.pandas_udf(StringType())
def _consistent(texts: pd.Series) -> pd.Series:
    return _each(texts, transducer().apply)


def _digest(text: str) -> bytes | None:
    form = transducer().apply(text)
    return hashlib.md5(form.encode("utf-8", "surrogatepass")).digest() if form.strip(" \n") else None


@F.pandas_udf(BinaryType())
def _form_digest(texts: pd.Series) -> pd.Series:
    return _each(texts, _digest)


def consistent(text: Column | str) -> Column:
    """The consistent form of a text column."""
    return _consistent(text)


def form_digest(text: Column | str) -> Column:
    """128 bits of the consistent form; null where the form has nothing visible."""
    return _form_digest(text)


def look_alike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose stored texts differ but have one consistent form with something visible.

    Forms and texts are compared by 128-bit hashes. Every form is made once and put down before anything is filtered by it.
    Classes with one stored text, however many copies, are dropped by a combined minimum and maximum before any join; pairs are
    made between distinct stored texts and only then spread to documents, in salted parts on both sides. So copies of one text
    cost nothing, and the work follows the result.
    """
    stored = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), form_digest(text).alias("form"), F.unhex(F.md5(text)).alias("stored"))
    cells = written(stored, "forms").filter(F.col("form").isNotNull())
    several = cells.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).filter("lo != hi").select("form")
    among = written(cells.join(several, "form", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), "among")
    texts = among.groupBy("form", "stored").agg(F.lit(1).alias("one")).drop("one")
    left, right = texts.withColumnRenamed("stored", "a"), texts.withColumnRenamed("stored", "b")
    pairs = left.join(right, "form").filter("a < b").select("a", "b", _salts())
    one = pairs.join(among.select("salt", F.col("stored").alias("a"), F.col("id").alias("id_a")), ["salt", "a"]).select("b", "id_a", _salts())
    two = one.join(among.select("salt", F.col("stored").alias("b"), F.col("id").alias("id_b")), ["salt", "b"])
    return two.select(F.least("id_a", "id_b").alias(f"{key}_a"), F.greatest("id_a", "id_b").alias(f"{key}_b"))


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
