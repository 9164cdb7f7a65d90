"""Visually identical text with different characters: one consistent form.

Widths, blanks, invisible characters, ligatures and composed accents are settled
character by character. Look-alike letters of other scripts are settled token by
token: a token that mixes scripts is rewritten in its dominant script, and only if
the result occurs in the vocabulary of the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameforge.session import checkpoint

# Letters that look like Latin ones, by script.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухіјѕһԁԛԝЁёЇїѴѵҮӏԌԚԜ", "ABESIJKMHOPCTYXaeopcyxijshdqwËëÏïVvYlGQW", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳϹͿ", "ABEZHIKMNOPTYXovpcjCJ", strict=True))



def _accented(table: dict[str, str], letters: range) -> dict[str, str]:
    """The letters of a script that are a look-alike with an accent, each as the Latin letter with that accent."""
    out = {}
    for c in map(chr, letters):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in table and len(same := unicodedata.normalize("NFC", table[base] + "".join(marks))) == 1:
            out[c] = same
    return out


CYRILLIC |= _accented(CYRILLIC, range(0x400, 0x530))
GREEK |= _accented(GREEK, range(0x370, 0x400))

# Ligatures, and characters of another width or code with the same look.
_SAME = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "｡": "。", "｢": "「", "｣": "」", "､": "、", "･": "・", "‐": "-", "‑": "-", "µ": "μ", "ɑ": "a", "ɡ": "g", " ": "\n", " ": "\n", "\u0085": "\n"}
# Characters that show nothing.
_UNSEEN = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩ㅤ﻿ﾠ"

_PLAIN = {ord(a): b for a, b in _SAME.items()}
_PLAIN |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full width
# Half-width kana and Hangul, full-width signs: the character of usual width, not NFKC, which would go on and take ¯ or ㄱ apart.
_PLAIN |= {c: chr(int(d.split()[1], 16)) for c in range(0xFF61, 0xFFEF) if (d := unicodedata.decomposition(chr(c))).startswith(("<narrow>", "<wide>"))}
_PLAIN |= {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0x2160, 0x2180)}  # Roman numerals
_PLAIN |= {c: " " for c in (0xA0, 0x1680, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B))}
_PLAIN |= {ord(c): None for c in _UNSEEN}
_PLAIN |= {c: None for c in (*range(0xFE00, 0xFE10), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0))}  # variation selectors, tags

_TO_LATIN = {ord(a): b for a, b in (CYRILLIC | GREEK).items()}
_LIKE = set("".join(CYRILLIC.values()) + "".join(GREEK.values()))
_TOKEN = re.compile(r"[0-9A-Za-z_À-ɏ̀-ͯͰ-ϿЀ-ԯ]+")
_OTHER = re.compile(r"[Ͱ-ϿЀ-ԯ]")


def _back(table: dict[str, str]) -> dict[int, str]:
    return {ord(b): a for a, b in table.items()}


_TO = {"c": _back(CYRILLIC) | {ord(g): k for g in GREEK for k, v in CYRILLIC.items() if v == GREEK[g]}, "g": _back(GREEK) | {ord(c): k for c in CYRILLIC for k, v in GREEK.items() if v == CYRILLIC[c]}, "l": _TO_LATIN}


# Runs of what is to be changed; characters beyond the first plane apart, as they slow the search down.
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_PLAIN) if c < 0x10000) + "]+")
_FAR = re.compile("[" + "".join(chr(c) for c in sorted(_PLAIN) if c >= 0x10000) + "]+")


def plain(text: str) -> str:
    """Characters of one width, plain blanks, nothing invisible, accents composed."""
    if not text.isascii():
        try:
            text.encode("latin-1")
            odd = any(c in text for c in "\xa0\xad\xb5\x85")
        except UnicodeEncodeError:
            odd = True
        if odd:
            text = _ODD.sub(lambda m: m[0].translate(_PLAIN), text)
            if max(text, default="") > "\uffff":
                text = _FAR.sub("", text)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
    return text.replace("\r\n", "\n") if "\r" in text else text


def _script(c: str) -> str:
    o = ord(c)
    return "g" if 0x370 <= o < 0x400 else "c" if 0x400 <= o < 0x530 else "l" if c.isalpha() and o < 0x250 else ""


def _only(letters: range, other) -> re.Pattern:
    return re.compile("[" + "".join(chr(c) for c in letters if chr(c).isalpha() and not other(chr(c))) + "]")


#: Letters per script that no other script has: no disguise touches them.
_ANCHOR = {
    "l": _only(range(0x41, 0x250), lambda c: c in _LIKE),
    "c": _only(range(0x400, 0x530), lambda c: ord(c) in _TO_LATIN),
    "g": _only(range(0x370, 0x400), lambda c: ord(c) in _TO_LATIN),
}
#: Tokens of one script.
_PURE = {"l": re.compile(r"[0-9A-Za-z_À-ɏ̀-ͯ]+"), "c": re.compile(r"[0-9_Ѐ-ԯ̀-ͯ]+")}


def _anchors(text: str) -> dict[str, int]:
    return {s: len(p.findall(text)) for s, p in _ANCHOR.items()}


def _scripts(text: str) -> set[str]:
    """Scripts of the letters of a text."""
    return {_script(c) for c in text} - {""}


def swaps(text: str) -> dict[str, list[str]]:
    """The rewritings, best first, of each token of a plain text that mixes scripts or may stand in the wrong one.

    A token's dominant script is that of the letters that only one script has, and it
    is rewritten in that. Without any such letter digits and underscores speak for Latin;
    else every script that has all its letters will do, that of the text first.
    """
    if not _OTHER.search(text):
        return {}
    order: list[str] = []
    out = {}
    for token in set(_TOKEN.findall(text)):
        ways = _ways(token)
        if not ways:
            continue
        if len(ways) > 1:
            if not order:
                total = _anchors(text)
                order = sorted("lcg", key=lambda s: -total[s])
            forms = [f for s in order if (f := dict(ways).get(s))]
        else:
            forms = [ways[0][1]]
        if forms[0] != token:
            out[token] = forms
    return out


@functools.lru_cache(maxsize=1 << 17)
def _ways(token: str) -> tuple[tuple[str, str], ...]:
    """(script, token in it) for each script that may be meant; none where the token is as it should be."""
    if any(p.fullmatch(token) and _ANCHOR[k].search(token) for k, p in _PURE.items()):
        return ()
    scripts = _scripts(token)
    if not scripts:
        return ()
    own = _anchors(token)
    if any(own.values()):
        if len(scripts) < 2:
            return ()
        ways = [max("lcg", key=lambda s: own[s])]
    else:
        ways = list("lcg") if token.isalpha() else ["l"]
    forms = [(w, unicodedata.normalize("NFC", token.translate(_TO[w]))) for w in ways]
    if len(ways) > 1:
        forms = [(w, f) for w, f in forms if len(_scripts(f)) == 1]
    return tuple(forms)


def repair(text: str, accepted: dict[str, str]) -> str:
    """A plain text with the accepted rewritings of its tokens."""
    return _TOKEN.sub(lambda m: accepted.get(m[0], m[0]), text) if accepted else text


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def survey(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, raw, form, text, swaps) of every row with a text, checkpointed.

    raw and form are digests of the stored and the plain text; form is NULL, and the
    plain text and its possible rewritings are given, where look-alikes are in doubt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, form, kept, maps = [], [], [], []
            for t in b.column(1).to_pylist():
                p = plain(t)
                s = swaps(p) if not p.isascii() else {}
                raw.append(_digest(t))
                form.append(None if s else raw[-1] if p is t else _digest(p))
                kept.append(p if s else None)
                maps.append(list(s.items()) if s else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(form, pa.binary()), pa.array(kept, pa.string()), pa.array(maps, pa.map_(pa.string(), pa.list_(pa.string())))], names=["id", "raw", "form", "text", "swaps"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return checkpoint(rows.mapInArrow(run, "id long, raw binary, form binary, text string, swaps map<string,array<string>>"))


#: Makes blanks of the Latin-1 characters that are no letters.
_CUT = bytes(c if c >= 0xC0 or (c < 128 and chr(c).isalpha()) else 32 for c in range(256))
#: Words of a token: its runs of letters.
_RUN = re.compile(r"[A-Za-z\u00c0-\u024f\u0300-\u036f\u0370-\u03ff\u0400-\u052f]+")
#: Parts of each doubtful token, so that one in very many rows is no hot key.
SALT = 8


def vocabulary(df: DataFrame, text: str, flush: int = 200_000) -> DataFrame:
    """(word): the distinct runs of letters of one script of all texts, made distinct within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[bytes] = set()
        wide: set[str] = set()

        def words() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*(w.decode("latin-1") for w in held), *wide], pa.string())], names=["word"])

        for b in batches:
            for t in b.column(0).to_pylist():
                p = plain(t)
                try:
                    held.update(p.encode("latin-1").translate(_CUT).split())
                except UnicodeEncodeError:
                    wide.update(w for w in set(_RUN.findall(p)) if w.isascii() or len(_scripts(w)) == 1)
                if len(held) + len(wide) >= flush:
                    yield words()
                    held.clear()
                    wide.clear()
        if held or wide:
            yield words()

    return df.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "word string").distinct()


def _accepted(known: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """(id, accepted): for each doubtful row and token the first rewriting that is in the vocabulary, which is to say all its words are."""
    doubts = known.where(F.col("swaps").isNotNull()).select("id", F.explode("swaps").alias("token", "words"))
    runs = F.array_distinct(F.regexp_extract_all("form", F.lit(_RUN.pattern), F.lit(0)))
    asked = doubts.select("token", "words").distinct().select("token", "words", F.posexplode("words").alias("pos", "form")).select("token", "words", "pos", "form", F.explode(runs).alias("word"))
    found = asked.join(vocabulary(df, text).withColumn("there", F.lit(True)), "word", "left")
    whole = found.groupBy("token", "words", "pos", "form").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("whole")).where("whole")
    chosen = whole.groupBy("token", "words").agg(F.min_by("form", "pos").alias("form")).where("form != token")
    chosen = chosen.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    kept = doubts.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(chosen, ["token", "words", "s"])
    return kept.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("token", "form"))).alias("accepted"))


def _repaired(known: DataFrame, df: DataFrame, text: str, digest: bool) -> DataFrame:
    doubtful = known.where(F.col("swaps").isNotNull()).select("id", "raw", "text").join(_accepted(known, df, text), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [repair(t, dict(a) if a else {}) for t, a in zip(b.column("text").to_pylist(), b.column("accepted").to_pylist(), strict=True)]
            last = pa.array([_digest(t) for t in texts], pa.binary()) if digest else pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("raw"), last], names=["id", "raw", "form"])

    return doubtful.mapInArrow(run, f"id long, raw binary, form {'binary' if digest else 'string'}")


def forms(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, raw, form): digests of the stored text and of its consistent form, for every row with a text."""
    known = survey(df, id_col, text)
    return known.where(F.col("swaps").isNull()).select("id", "raw", "form").unionByName(_repaired(known, df, text, True))


def consistent(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, text): the consistent form of every text; a null text stays null, an empty one empty."""
    known = survey(df, id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t if t is None else plain(t) for t in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, text string")
    fixed = _repaired(known, df, text, False).select("id", F.col("form").alias("fixed"))
    return base.join(fixed, "id", "left").select("id", F.coalesce("fixed", "text").alias("text"))


def twins(found: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of equal form whose stored texts differ.

    found: as from ``forms``. Pairs are made between the distinct stored texts of a
    form and then spread to the rows that hold them, so a form with one stored text,
    however many rows hold it, costs nothing.
    """
    kinds = found.groupBy("form", "raw").agg(F.count("*").alias("n"))
    several = kinds.groupBy("form").agg(F.count("*").alias("k")).where("k > 1").select("form")
    kinds = checkpoint(found.join(several, "form", "left_semi"))
    distinct = kinds.select("form", "raw").distinct()
    a = distinct.select("form", F.col("raw").alias("raw_a"))
    b = distinct.select("form", F.col("raw").alias("raw_b"))
    between = a.join(b, "form").where(F.col("raw_a") < F.col("raw_b")).drop("form")
    left = kinds.select(F.col("raw").alias("raw_a"), F.col("id").alias("x"))
    right = kinds.select(F.col("raw").alias("raw_b"), F.col("id").alias("y"))
    return between.join(left, "raw_a").join(right, "raw_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def skeleton_sql(text: str) -> str:
    """SQL for the test of ``twins``: every look-alike as its Latin letter, wherever it stands, which texts that look the same share."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    one = {chr(c): b for c, b in _PLAIN.items() if b and len(b) == 1}
    gone = "".join(chr(c) for c, b in _PLAIN.items() if not b)
    out = f"replace({text}, chr(13) || chr(10), chr(10))"
    for c, b in _PLAIN.items():
        if b and len(b) > 1:
            out = f"replace({out}, {quoted(chr(c))}, {quoted(b)})"
    out = f"nfc_normalize(translate({out}, {quoted(''.join(one) + gone)}, {quoted(''.join(one.values()))}))"
    like = CYRILLIC | GREEK
    return f"nfc_normalize(translate({out}, {quoted(''.join(like))}, {quoted(''.join(like.values()))}))"
