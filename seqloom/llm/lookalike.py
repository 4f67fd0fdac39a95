"""Visually identical text: one consistent form.

A mapping from characters and short sequences to their visible form is built from rules of the Unicode database (widths, ligatures,
compatibility spaces and signs, accents as separate marks) and short lists of look-alike letters, checked for
conflicts, and compiled into an automaton that reads a text once and always takes the longest key. Grapheme clusters that no key covers
as a whole, such as one with several marks in an odd order, are composed by rule.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seqloom.runtime import cut

# Letters of other scripts that look like a Latin letter, in the order of the Latin letters.
CYRILLIC = dict(zip("АВСЕԌНІЈКМОРԚЅТѴԜХУаԁеһіјӏорԛѕѵԝхусѵӀ", "ABCEGHIJKMOPQSTVWXYadehijlopqsvwxycvI"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲν", "ABEZHIKMNOPTYXCjocv"))
ARMENIAN = dict(zip("ՕՏՍցհյոօզս", "OSUghjnoqu"))
COPTIC = dict(zip("ⲤⲎⲒⲔⲘⲚⲞⲢⲦⲬⲨⲥⲟⲣ", "CHIKMNOPTXYcop"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᎩᏃ", "ABCDEGHJKLMPRSTVWYZ"))
SMALL_CAPITALS = dict(zip("ᴄᴏꜱᴜᴠᴡᴢ", "cosuvwz"))
OTHER = dict(zip("ɑɡ", "ag"))
# Signs that look like an ASCII sign.
SIGNS = {"‐": "-", "‑": "-", "⁃": "-", "﹣": "-", "˗": "-", "∶": ":", "։": ":", "׃": ":", "ǃ": "!", "ǀ": "|", "∣": "|", "∕": "/", "⁄": "/", "‚": ",", "ʼ": "’"}
# Kinds of compatibility decomposition that keep the visible characters. Superscripts, subscripts, fractions, circled and squared signs look different and stay.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<small>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>"}

LETTERS = {**CYRILLIC, **GREEK, **ARMENIAN, **COPTIC, **CHEROKEE, **SMALL_CAPITALS, **OTHER}


def _plain(ch: str) -> str:
    """The visible form of one character: decomposed, in its ordinary width, look-alikes replaced, blanks as one space, invisible ones gone."""
    cat = unicodedata.category(ch)
    if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return " "
    if cat == "Cf" or ch in "͏︎️ᅟᅠㅤﾠ":
        return ""
    d = unicodedata.decomposition(ch)
    if not d:
        return LETTERS.get(ch) or SIGNS.get(ch) or ch
    parts = d.split()
    if parts[0].startswith("<"):
        if parts[0] not in SAME_LOOK or parts[1] == "0020":
            return ch
        parts = parts[1:]
    return "".join(_plain(chr(int(p, 16))) for p in parts)


@lru_cache(maxsize=1)
def table() -> dict[str, str]:
    """Every character whose visible form differs from it, checked for conflicts."""
    out = {}
    for k in (*range(0x32000), *range(0xE0000, 0xE0200)):  # the rest is unassigned or for private use
        if 0xD800 <= k < 0xE000 or 0xAC00 <= k < 0xD7A4:  # surrogates; Hangul syllables are their own composed form
            continue
        ch = chr(k)
        p = _plain(ch)
        if p != ch:
            out[ch] = p
    for ch, p in out.items():
        if any(x in out and out[x] != x for x in p if x != " "):
            raise ValueError(f"{ch!r} maps to {p!r}, which holds a mapped character")
    for ch, p in LETTERS.items():
        if unicodedata.name(ch).startswith("CHEROKEE"):
            continue  # they have the shape of capitals only
        if ch.isupper() != p.isupper():
            raise ValueError(f"{ch!r} and {p!r} differ in case")
    return out


def keys() -> dict[str, str]:
    """Every key of the automaton with its visible form: mapped characters, and letters with their marks apart, in every guise of the letter.

    Raises ``ValueError`` where two keys that are the same to the reader would lead to different forms, or a form would be changed again.
    """
    t = table()
    out = {ch: unicodedata.normalize("NFC", p) for ch, p in t.items()}
    guises: dict[str, list[str]] = {}
    for ch, p in t.items():
        if len(p) == 1:
            guises.setdefault(p, []).append(ch)
    for k in range(0x32000):
        ch = chr(k)
        d = unicodedata.decomposition(ch)
        if not d or d.startswith("<") or 0xAC00 <= k < 0xD7A4:
            continue
        whole = unicodedata.normalize("NFD", ch)
        if len(whole) > 1 and not unicodedata.combining(whole[0]):
            plain = t.get(whole[0], whole[0])
            form = unicodedata.normalize("NFC", "".join(t.get(x, x) for x in whole))
            for first in (whole[0], plain, *guises.get(plain, [])):
                if len(first) == 1 and out.setdefault(first + whole[1:], form) != form:
                    raise ValueError(f"{first + whole[1:]!r} has two forms")
    for key, form in out.items():
        if any(x in t and t[x] != unicodedata.normalize("NFD", x) for x in form if x != " "):
            raise ValueError(f"{key!r} leads to {form!r}, which is changed again")
    return out


class Transducer:
    """The compiled automaton. ``form`` is idempotent."""

    def __init__(self) -> None:
        import ahocorasick
        import regex

        self.table = table()
        self.automaton = ahocorasick.Automaton()
        for key, form in keys().items():
            joins = any("\u1100" <= x <= "\u11ff" for x in form) or unicodedata.category(form[:1] or " ")[0] == "M"
            self.automaton.add_word(key, (len(key), None if joins else form))
        # Marks that no key takes along, conjoining letters and joiners depend on what is around them: None sends their word to ``exact``.
        for k in (*range(0x300, 0x32000), *range(0xE0100, 0xE01F0)):
            ch = chr(k)
            if unicodedata.category(ch)[0] == "M" or 0x1100 <= k < 0x1200 or 0xA960 <= k < 0xA980 or 0xD7B0 <= k < 0xD800 or ch in "\u200c\u200d":
                self.automaton.add_word(ch, (1, None))
        self.automaton.make_automaton()
        # A joiner between pictographs, or inside scripts that it shapes, is visible.
        shaping = r"\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}"
        joined = rf"(?:(?<=[\p{{Extended_Pictographic}}\ufe0f\p{{Emoji_Modifier}}])\u200d(?=\p{{Extended_Pictographic}})|(?<=[{shaping}]\p{{M}}*)[\u200c\u200d](?=[{shaping}]))"
        unseen = r"[\p{Cf}\u034f\ufe0e\ufe0f\u115f\u1160\u3164\uffa0]"
        blank = r"[\p{Z}\t\n\r\x0b\x0c\x85]"
        self.parts = regex.compile(rf"(?P<joiner>{joined})|(?P<blank>(?:{unseen}*{blank})+{unseen}*)|(?P<cluster>{unseen}*[^\p{{M}}{unseen[1:-1]}](?:\p{{M}}|{unseen}(?<!{joined}))*)|(?P<rest>.)", regex.S | regex.V1)
        self.memo: dict[str, str] = {}

    def exact(self, word: str) -> str:
        """Cluster by cluster, composed by rule: what every other way must agree with."""
        out = []
        for m in self.parts.finditer(word):
            kind = m.lastgroup
            out.append(" " if kind == "blank" else m.group() if kind == "joiner" else unicodedata.normalize("NFC", "".join(self.table.get(x, x) for x in m.group())))
        return unicodedata.normalize("NFC", "".join(out))

    def word(self, w: str) -> str:
        got = self.memo.get(w)
        if got is None:
            got = self.read(w)
            if len(self.memo) < 200_000:
                self.memo[w] = got
        return got

    def read(self, w: str) -> str:
        """One pass of the automaton over a word."""
        out, at = [], 0
        for end, (n, form) in self.automaton.iter_long(w):
            if form is None:
                return self.exact(w)
            out.append(w[at : end + 1 - n])
            out.append(form)
            at = end + 1
        out.append(w[at:])
        return "".join(out)

    def form(self, text: str) -> str:
        if text.isascii() and "  " not in text and text.isprintable():
            return text.strip()
        s = " ".join([w if w.isascii() and w.isprintable() else self.word(w) for w in text.split(" ")])
        return s.strip(" ") if "  " not in s else " ".join([x for x in s.split(" ") if x])


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def visible_forms(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """``df`` with the consistent form of ``text`` in the column ``form``.

    Null stays null, an empty text or one of nothing but blanks and invisible characters gives the empty form. Runs of
    blanks of any width count as one, blanks at the ends are dropped; case and accents are kept. An
    existing column of the name ``form`` is replaced.
    """
    df = df.drop(form) if form != text else df.select([F.col(c).alias("_text" if c == text else c) for c in df.columns])
    text = "_text" if form == text else text
    schema = StructType([*df.schema.fields, StructField(form, StringType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = transducer().form
        for b in batches:
            forms = pa.array([None if x is None else f(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, forms], names=[*b.schema.names, form])

    return df.mapInArrow(run, schema)


def _spellings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``k, h1, h2, f``: each item's text and its form, as hashes (192 and 128 bits), kept once for all that is read from them."""
    rows = visible_forms(df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL").distinct(), "t", "f").filter("f <> ''")
    return cut(rows.select("k", F.xxhash64("t").alias("h1"), F.md5("t").alias("h2"), F.md5("f").alias("f")))


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, class_id, n_items, n_links`` of each item whose text looks like that of another item but is stored differently.

    ``class_id`` is the least id of all items of that look, ``n_items`` their number, and ``n_links`` the number of those
    stored differently from this one. An item with several texts has a row per text. Repeated rows count once; null ids and texts, and texts
    without a visible character, belong to no class. Classes and their counts come from map-side aggregates: nothing is paired.
    """
    return _classes(_spellings(df, key, text)).select(F.col("k").alias(key), "class_id", "n_items", "n_links")


def _classes(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("f", "h1", "h2").agg(F.count(F.lit(1)).alias("same"), F.min("k").alias("lo"))
    whole = per.groupBy("f").agg(F.sum("same").alias("n_items"), F.min("lo").alias("class_id"), F.count(F.lit(1)).alias("forms")).filter("forms > 1")
    per = per.select("f", "h1", "h2", "same").join(whole, "f")
    return rows.join(per, ["f", "h1", "h2"]).select("k", "f", "h1", "h2", "class_id", "n_items", (F.col("n_items") - F.col("same")).alias("n_links"))


def same_look(df: DataFrame, key: str, text: str, per_task: int = 4096) -> DataFrame:
    """``id_a < id_b``: rows whose texts look the same but are not equal as stored; the pairs within the classes of ``look_classes``.

    Only classes of several spellings reach the join. A class of more than ``per_task`` items is spread over as many parts as its size asks for.
    """
    rows = _classes(_spellings(df, key, text)).withColumn("parts", F.ceil(F.col("n_items") / F.lit(per_task)).cast("int"))
    a = rows.select("f", F.col("k").alias("id_a"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("salt"))
    b = rows.select("f", F.col("k").alias("id_b"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return a.join(b, ["f", "salt"]).filter("id_a < id_b AND (a1 <> b1 OR a2 <> b2)").select("id_a", "id_b").distinct()
