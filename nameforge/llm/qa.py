"""Defective prompt and response pairs: alignment of tokens by shingles, common subsequence and templates."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Container, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameforge.functions.similarity import lcs as common
from nameforge.session import checkpoint

#: Words per shingle, and the least containment, of a response that copies its prompt.
WORDS, CONTAINED, ALIGNED = 5, 0.8, 0.9

# Words that alone make no answer, and values that are no name.
FILLER = frozenset("none null nil nan na n/a n a void undefined unknown empty todo tbd missing blank answer response output available applicable nothing no not intentionally left names name given".split())
# Short forms, written out before words are aligned.
SHORT = {"t": "not", "s": "is", "m": "am", "re": "are", "ll": "will", "ve": "have", "d": "would", "cannot": "can not", "won": "will", "unable": "not able"}

# Sentences that decline as a whole. So much of their weight must align, in order.
REFUSALS = [
    x.split()
    for x in (
        "this is against my guidelines",
        "goes against my policies",
        "my policies rule out",
        "my guidelines forbid",
        "not appropriate for me to",
        "would not be appropriate for me",
        "something i am not able to",
        "not something i am able to",
        "not something i can do",
        "not a task i will take on",
        "beyond what i am prepared to",
        "outside my scope",
        "outside what i do",
        "has to be left to somebody else",
        "there is nothing i can offer",
        "no answer can be given to this request",
        "i do not have enough information to answer",
        "i have to turn down",
        "i have to pass on this",
        "as an ai language model i can not",
    )
]
ALIGNS = 0.85
# How a refusal starts. What follows must not be what answers say that are good all the same.
DECLINES = [
    x.split()
    for x in (
        "i can not",
        "i could not",
        "i will not",
        "i would not",
        "must decline",
        "have to decline",
        "i decline to",
        "must refuse",
        "have to refuse",
        "i refuse to",
        "i prefer not",
        "would prefer not",
        "would rather not",
        "do not feel comfortable",
        "do not wish to",
        "do not want to",
        "am not able to",
        "are not able to",
        "not allowed to",
        "not permitted to",
        "not going to",
        "told not to",
        "not in a position to",
        "not possible for me",
        "impossible for me",
        "we can not",
        "we will not",
    )
]

_ENTRY = re.compile(r"""([A-Za-z_$?@.][\w$?@.]*)["'`]?[^\S\n]*:[^\S\n]*["'`]?([^\s,;"'`{}\[\]:]*)""")
_WORD = re.compile(r"\w+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^\W\d_]+[^\S\n]+[^\W\d_]+[^\S\n]+[^\W\d_]+")
# Words of prose: not beside digits, underscores, paths or calls.
_PROSE = re.compile(r"(?<![\w.:/\\-])[^\W\d_]+(?![\w(.:/\\=-]*[\w(])")
# Codes that stand for no single language.
NO_LANGUAGE = ("und", "mul", "mis", "zxx", "unk")
# What has a digit or an underscore in it is no word, even where no blank parts it from one.
_CODE = re.compile(r"[A-Za-z0-9_$?@.]*[0-9_][A-Za-z0-9_$?@.]*")
#: Log chance a word by which another language must fit better.
FOREIGN = 0.0
#: Log chance by which each letter beyond a to z speaks for another language.
STRANGE = 3.0
#: So many times as often, text for text, a word must be in another language, or a run of words in answers that are not good, to be a mere stray in English, or in good answers.
STRAYS = 10
#: Kinds of counts besides those of languages, which have two letters.
NAMES, SAID, COMMON, GOOD, POOR, PAIRS = "names", "said", "common", "good", "poor", "pairs"
#: Entries that a task counts before it hands them on.
COUNTED = 200_000
_ASKED = re.compile(r"[A-Za-z_$?@.][\w$?@.]*")
_TEMPLATE_WORDS = frozenset(w for t in REFUSALS for w in t)
_STARTS: dict[str, list[list[str]]] = defaultdict(list)
for _t in DECLINES:
    _STARTS[_t[0]].append(_t)


def asked(prompt: str | None) -> list[str]:
    """The placeholders to be named: the list at the end of the prompt's last line."""
    if not prompt:
        return []
    line = prompt.rstrip()
    line = line[line.rfind("\n") + 1 :].rstrip(" .;:!?")
    parts = line.split(",")
    first = parts[0].split()
    if not first:
        return []
    parts[0] = first[-1]
    out = []
    for x in parts:
        x = x.strip().removeprefix("and ").strip("`'\" ")
        if _ASKED.fullmatch(x):
            out.append(x)
    return out


def spoken(text: str) -> list[str]:
    """The words of a text in lower case, short forms written out."""
    out: list[str] = []
    for w in _SPOKEN.findall(text.lower().replace("_", " ")):
        out += SHORT.get(w, w).split()
    return out


@dataclass
class Model:
    """What is learnt from the whole corpus: letters of languages, and what good answers say beside names."""

    #: For each language the log chance of each run of three letters, and that of one never seen.
    grams: dict[str, dict[str, float]] = field(default_factory=dict)
    unseen: dict[str, float] = field(default_factory=dict)
    #: Good answers, and how many of them have each word of the templates in their remarks.
    common: dict[str, int] = field(default_factory=dict)
    remarks: int = 0
    #: Runs of words in remarks of good answers, and words that English texts, names or remarks have.
    hedges: Container[str] = field(default_factory=set)
    english: Container[str] = field(default_factory=set)
    #: Both of these in a column ``key``, where they are too many for one process.
    known: DataFrame | None = None
    _fits: dict[str, float] = field(default_factory=dict)

    def foreignness(self, word: str) -> float:
        """How much better a word in lower case fits the best of the other languages than English, as a log chance."""
        got = self._fits.get(word)
        if got is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            runs = _runs(word)
            fit = {k: sum(t.get(g, self.unseen[k]) for g in runs) for k, t in self.grams.items()}
            # Letters that English does without speak for themselves, even those of languages never seen.
            strange = sum(not c.isascii() for c in word)
            got = self._fits[word] = max((v for k, v in fit.items() if k != "en"), default=0.0) - fit.get("en", 0.0) + STRANGE * strange
        return -1.0 if got > -1.0 and word in self.english else got

    def weight(self, word: str) -> float:
        """What a word counts in an alignment: little if good answers often have it."""
        return 0.25 + math.log((self.remarks + 2) / (self.common.get(word, 0) + 1)) / math.log(self.remarks + 2)


def _runs(word: str) -> list[str]:
    """Runs of three letters with marks at both ends; of scripts without blanks each letter is one."""
    if not word.isascii() and any(ord(c) > 0x2E7F for c in word):
        return list(word)
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _folded(word: str) -> str:
    """As written without accents, the German way for umlauts."""
    for x, y in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        word = word.replace(x, y)
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _phrases(said: list[str]) -> set[str]:
    """The runs of words that ``defect`` may look up: those of two, and starts of refusals with up to two words more."""
    out = {" ".join(p) for p in zip(said, said[1:], strict=False)}
    for k, w in enumerate(said):
        for t in _STARTS.get(w, ()):
            if said[k : k + len(t)] == t:
                out.update(" ".join(said[k : k + n]) for n in range(max(4, len(t)), len(t) + 3) if k + n <= len(said))
    return out


def _of_text(code: str, text: str, seen: Counter) -> None:
    """Counts the words of prose of a text for the first two letters of its language code; the key "" counts texts."""
    if code[:3].lower() in NO_LANGUAGE:
        return
    code = code[:2].lower()
    seen[code, ""] += 1
    for w in _PROSE.findall(text):
        seen[code, w.lower()] += 1


def _of_names(names: list[str], seen: Counter) -> None:
    for n in names:
        for w in _LETTERS.findall(n):
            seen[NAMES, w.lower()] += 1


def _of_pair(prompt: str | None, response: str | None, seen: Counter) -> None:
    """Counts what an answer says beside names. Good answers are those that name all placeholders."""
    seen[PAIRS, ""] += 1
    targets = {t.lower() for t in asked(prompt)}
    if not response or not targets:
        return
    said = spoken(_ENTRY.sub(" ", response))
    kind = POOR if targets - {k.lower() for k, v in _ENTRY.findall(response) if v} else GOOD
    seen[kind, ""] += 1
    for x in _phrases(said):
        seen[kind, x] += 1
    if kind == GOOD:
        for w in said:
            seen[SAID, w] += 1
        for w in _TEMPLATE_WORDS.intersection(said):
            seen[COMMON, w] += 1


def _letters(words: Iterator[tuple[str, str, int]], most: int) -> Counter:
    """Counts by (language, run of letters) of (language, word, count); a word counts ``most`` times at most, with and without accents."""
    out: Counter = Counter()
    for code, w, n in words:
        for form in {w, _folded(w)}:
            for g in _runs(form):
                out[code, g] += min(n, most)
    return out


def _model(letters: dict[tuple[str, str], int], totals: dict[str, int], common: dict[str, int]) -> Model:
    counts: dict[str, dict[str, int]] = {"en": {}}
    for (code, g), n in letters.items():
        counts.setdefault(code, {})[g] = n
    room = len(set().union(*counts.values())) + 1
    model = Model(common=common, remarks=totals.get(GOOD, 0))
    for code, c in sorted(counts.items()):
        total = sum(c.values()) + room / 2
        model.unseen[code] = math.log(0.5 / total)
        model.grams[code] = {g: math.log((n + 0.5) / total) for g, n in c.items()}
    return model


def learn(texts: list[tuple[str, str]], names: list[str], answers: list[tuple[str | None, str | None]], most: int = 20) -> Model:
    """The model from (language code, text), English names, and (prompt, response) pairs.

    A language is the first two letters of its code. All texts count, of them only words of
    prose, each at most ``most`` times, with and without accents; names, and what good answers
    say besides, count as English. Words that another language has ``STRAYS`` times as often
    are no English, and runs of words that other answers have so much more often are none of
    good ones. Good answers are those that name all placeholders.
    """
    seen: Counter = Counter()
    for code, text in texts:
        _of_text(code, text, seen)
    _of_names(names, seen)
    for prompt, response in answers:
        _of_pair(prompt, response, seen)
    totals = {kind: n for (kind, key), n in seen.items() if not key}
    words: dict[str, Counter] = defaultdict(Counter)
    rate: dict[str, dict[bool, float]] = defaultdict(lambda: {True: 0.0, False: 0.0})
    for (kind, w), n in seen.items():
        if w and kind not in (GOOD, POOR, COMMON):
            words["en" if kind in (NAMES, SAID) else kind][w] += n
    for code, c in words.items():
        for w in c:
            here = seen[code, w] / max(1, totals.get(code, 0))
            if code == "en":
                here += (seen[NAMES, w] + seen[SAID, w]) / max(1, totals.get(PAIRS, 0))
            rate[w][code == "en"] = max(rate[w][code == "en"], here)
    model = _model(_letters(((code, w, n) for code, c in words.items() for w, n in c.items()), most), totals, {w: n for (kind, w), n in seen.items() if kind == COMMON})
    model.english = {w for w, x in rate.items() if x[True] and x[True] * STRAYS >= x[False]}
    model.hedges = {x for (kind, x), n in seen.items() if kind == GOOD and x and n * STRAYS * totals.get(POOR, 0) >= seen[POOR, x] * totals[GOOD]}
    return model


class Known:
    """The keys of a table as a set that is asked one by one."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def __contains__(self, key: object) -> bool:
        return not self.table.where(F.col("key") == F.lit(key)).isEmpty()


def fit(documents: DataFrame, pairs: DataFrame, prompt: str = "input", predict: str = "predict", ranked: str = "answer_and_probs", names: tuple[str, ...] = ("func_id_maps", "var_id_maps"), most: int = 20) -> Model:
    """``learn`` from all documents with a lang and all pairs.

    Counted on the executors. Counts of letter runs and of the templates' words come to
    the driver; words and runs of words, which grow with the corpus, stay in a table.
    """
    said = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    known = F.flatten(F.array(*(F.coalesce(F.map_values(n), F.array().cast("array<string>")) for n in names)))
    got = pairs.select(F.filter(known, lambda x: x.isNotNull()).alias("n"), F.col(prompt).alias("p"), response_of(F.col(predict), F.col(ranked)).alias("r"))

    def of_texts(rows: list[tuple], seen: Counter) -> None:
        for code, text in rows:
            _of_text(code, text, seen)

    def of_pairs(rows: list[tuple], seen: Counter) -> None:
        for n, p, r in rows:
            _of_names(n, seen)
            _of_pair(p, r, seen)

    counted = checkpoint(_counted(said, of_texts).unionByName(_counted(got, of_pairs)).groupBy("kind", "key").agg(F.sum("n").alias("n")))
    totals = {r["kind"]: r["n"] for r in counted.where("key = ''").collect()}
    kind, n = F.col("kind"), F.col("n")
    of_pair = kind.isin(NAMES, SAID)
    words = counted.where((F.col("key") != "") & ~kind.isin(GOOD, POOR, COMMON)).groupBy("key", F.when(of_pair, "en").otherwise(kind).alias("code"))
    words = words.agg(F.sum("n").alias("n"), F.sum(F.when(of_pair, 0).otherwise(n)).alias("in_texts"), F.sum(F.when(of_pair, n).otherwise(0)).alias("in_pairs"))

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches(_letters(zip(*(c.to_pylist() for c in b.columns), strict=True), most))

    runs = words.select("code", "key", "n").mapInArrow(letters, _COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    model = _model({(r["kind"], r["key"]): r["n"] for r in runs.collect()}, totals, {r["key"]: r["n"] for r in counted.where(kind == COMMON).collect()})
    texts = counted.where("key = ''").select(kind.alias("code"), n.alias("texts"))
    rate = F.col("in_texts") / F.coalesce("texts", F.lit(1)) + F.col("in_pairs") / F.lit(max(1, totals.get(PAIRS, 0)))
    here = F.col("code") == "en"
    by_word = words.join(F.broadcast(texts), "code", "left").groupBy("key").agg(F.max(F.when(here, rate)).alias("here"), F.max(F.when(~here, rate)).alias("there"))
    own = by_word.where(F.col("here") * STRAYS >= F.coalesce("there", F.lit(0.0))).select("key")
    by_run = counted.where((F.col("key") != "") & kind.isin(GOOD, POOR)).groupBy("key").agg(F.sum(F.when(kind == GOOD, n)).alias("good"), F.sum(F.when(kind == POOR, n)).alias("poor"))
    # Decimals, as products of counts may pass the range of long.
    often, seldom = (F.coalesce(x, F.lit(0)).cast("decimal(19,0)") * F.lit(y).cast("decimal(19,0)") for x, y in (("good", STRAYS * totals.get(POOR, 0)), ("poor", totals.get(GOOD, 0))))
    phrases = by_run.where((F.col("good") > 0) & (often >= seldom)).select("key")
    # A run of words has a blank in it, a word has none.
    model.known = own.unionByName(phrases)
    model.english, model.hedges = Known(own), Known(phrases)
    return model


_COUNTS = "kind string, key string, n long"


def _batches(seen: Counter) -> Iterator[pa.RecordBatch]:
    if seen:
        kinds, keys = zip(*seen, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["kind", "key", "n"])


def _counted(df: DataFrame, count) -> DataFrame:  # noqa: ANN001
    """(kind, key, n): what ``count`` adds for the rows of df, not yet summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            count(list(zip(*(c.to_pylist() for c in b.columns), strict=True)), seen)
            if len(seen) > COUNTED:
                yield from _batches(seen)
                seen.clear()
        yield from _batches(seen)

    return df.mapInArrow(run, _COUNTS)


def refuses(words: list[str], model: Model) -> bool:
    """Whether spoken words align with a template of a refusal.

    A template aligns by the weight of its words that occur in order, close together; a
    start of one does if good answers do not go on from it in the same way.
    """
    n = len(words)
    have = set(words)
    for t in REFUSALS:
        weight = [model.weight(w) for w in t]
        if sum(x for x, w in zip(weight, t, strict=True) if w in have) < ALIGNS * sum(weight):
            continue
        if any(_aligned(t, weight, words[k : k + len(t) + 4]) >= ALIGNS * sum(weight) for k in range(max(1, n - len(t) + 3))):
            return True
    for t in DECLINES:
        m = len(t)
        if t[-1] not in have or t[0] not in have:
            continue
        for k in range(n - m + 1):
            if words[k : k + m] == t and " ".join(words[k : k + m + 2]) not in model.hedges:
                return True
    return False


def _aligned(template: list[str], weight: list[float], words: list[str]) -> float:
    """The largest weight of template words that the words have in the same order."""
    best = [0.0] * (len(words) + 1)
    for t, x in zip(template, weight, strict=True):
        before = 0.0
        for j, w in enumerate(words, 1):
            before, best[j] = best[j], max(best[j], best[j - 1], before + x if t == w else 0.0)
    return best[-1]


def copies(words: list[str], prompt: list[str], targets: set[str]) -> bool:
    """Whether the response's words only give back the prompt's."""
    if len(words) < 2:
        return len(words) == len(targets) == 1 and words[0] in targets
    if all(w in targets for w in words):
        return True
    k = min(WORDS, len(words))
    have = {tuple(prompt[i : i + k]) for i in range(len(prompt) - k + 1)}
    mine = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    if sum(s in have for s in mine) < CONTAINED * len(mine):
        return False
    return common(words, prompt) >= ALIGNED * len(words)


def foreign_text(text: str, model: Model) -> bool:
    """Whether the sentences of a text are in a language other than English: its words fit another better, on the whole."""
    words = [w.lower() for w in _LETTERS.findall(_CODE.sub(" ", text)) if len(w) > 1 or not w.isascii()]
    scores = [model.foreignness(w) for w in words]
    return len(words) > 2 - any(ord(c) > 0x2FF for w in words for c in w) and sum(scores) > FOREIGN * len(words)


def foreign_names(names: list[str], model: Model) -> bool:
    """Whether the words of names throughout fit another language better than English."""
    scores = [sum(model.foreignness(w.lower()) for w in _LETTERS.findall(n)) for n in names]
    return sum(scores) > FOREIGN * len(names) and 5 * sum(s > 0 for s in scores) >= 2 * len(names)


def _blank(text: str) -> str:
    """Without marks, punctuation and invisible characters, in lower case."""
    kept = "".join(c if c.isalnum() or c in "/" else " " if unicodedata.category(c)[0] != "C" or c.isspace() else "" for c in text)
    return " ".join(kept.lower().split())


def defect(prompt: str | None, response: str | None, model: Model) -> str | None:
    """The defect of a pair, or None.

    A response that names every placeholder asked for is good whatever else it says,
    unless its names are the placeholders themselves (copy) or foreign throughout
    (language). Otherwise, in this order: empty, refusal, copy, language, truncated;
    English sentences without any name that are unlike the remarks of good answers are a
    refusal in other words.
    Without any placeholder in the prompt a response is never truncated.
    """
    if response is None:
        return "empty"
    targets = asked(prompt)
    want = {t.lower() for t in targets}
    found = _ENTRY.findall(response)
    names: dict[str, str] = {}
    for k, v in found:
        k = k.lower()
        v = v.strip(".!")
        if k in want and v and not (v.lower() in ("null", "none") and '"' + v not in response and "'" + v not in response and names.get(k)):
            names[k] = v
    real = {k: v for k, v in names.items() if v.lower() not in FILLER and v.strip("-_?.*")}
    if want and len(names) == len(want) and real:
        same = sum(k == v.lower() for k, v in real.items())
        if same >= 0.8 * len(real):
            return "copy"
        return "language" if foreign_names([v for k, v in real.items() if v.lower() != k], model) else None
    plain = _blank(response)
    if all(w in FILLER for w in plain.split()):
        return "empty"
    mine = [k for k, v in found if k.lower() in want]
    words = [w.lower() for w in _WORD.findall(response)]
    if not real and len(mine) > 1 and all(w in want or w in FILLER for w in words) and len({k.lower() for k in mine}) >= min(len(want), 2):
        return "empty"
    if refuses(spoken(response), model):
        return "refusal"
    if len(real) > 1 and sum(k == v.lower() for k, v in real.items()) >= 0.8 * len(real):
        return "copy"
    if sum(k != v.lower() for k, v in real.items()) < 2 and prompt and copies(words, [w.lower() for w in _WORD.findall(prompt)], want):
        return "copy"
    sentences = _ENTRY.sub(" ", response)
    if want:
        sentences = " ".join(w for w in re.split(r"[\s,;{}()\[\]\"`]+", sentences) if w.lower().strip(".:!?") not in want)
    # The last name may be cut off in its middle.
    sure = [v for k, v in real.items() if v.lower() != k and not response.rstrip(" \"'`.}").endswith(v)]
    if foreign_text(sentences, model) or foreign_names(sure, model):
        return "language"
    if not want:
        return None
    # English sentences without any name, not like what good answers say besides, do not break off: they decline.
    said = [w for w in spoken(_CODE.sub(" ", sentences)) if w not in want]
    if not real and len(said) > 2 and 2 * sum(" ".join(p) in model.hedges for p in zip(said, said[1:], strict=False)) < len(said) - 1 and _SENTENCE.search(response):
        return "refusal"
    return "truncated"


def response_of(predict: Column, ranked: Column) -> Column:
    """The response: predict, or when that is null the answer of highest prob.

    A map comes out as lines ``key:value``; an ``Error`` text stands for itself. Of
    equal probs the first counts; null probs come last.
    """
    best = F.array_max(F.transform(ranked, lambda x: x["prob"]))
    answer = F.element_at(F.filter(ranked, lambda x: x["prob"].eqNullSafe(best)), F.lit(1))["answer"]
    lines = F.array_join(F.transform(F.map_entries(answer), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit("")))), "\n")
    error = F.element_at(F.map_filter(answer, lambda k, v: k == "Error"), F.lit("Error"))
    said = F.when(F.map_contains_key(answer, "Error"), error).otherwise(lines)
    return F.coalesce(predict, F.when(F.size(ranked) > 0, said))


class _Asked(set):
    """A set that says yes to everything and keeps what it was asked."""

    def __contains__(self, key: object) -> bool:
        self.add(key)
        return True


def flag(df: DataFrame, model: Model, id_col: str = "pred_id", prompt: str = "input", predict: str = "predict", ranked: str = "answer_and_probs") -> DataFrame:
    """(id, defect) of every defective pair of prompt and response; see ``defect``. model: as from ``fit`` or ``learn``.

    A null id or null response is allowed (``empty``); a null prompt asks for nothing. With a
    model from ``fit`` the pairs are first judged as if no word were English and no run of
    words were in good answers. That can only bring refusals and answers in other languages,
    never take one away; only these are judged again, with those of their words that are known.
    """
    kind = dict(df.dtypes)[id_col]
    ready = df.select(F.col(id_col), F.col(prompt).alias("prompt"), response_of(F.col(predict), F.col(ranked)).alias("response"))
    if model.known is None:
        return _judged(ready, model, id_col, kind)
    bare = replace(model, hedges=set(), english=set(), known=None, _fits={})
    first = checkpoint(_judged(ready, bare, id_col, kind, doubts=True).withColumn("row", F.monotonically_increasing_id()))
    doubted = first.where("keys IS NOT NULL")
    had = doubted.select("row", F.explode("keys").alias("key")).join(model.known, "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("had"))
    again = doubted.join(had, "row", "left").select(id_col, "prompt", "response", F.coalesce("had", F.array().cast("array<string>")).alias("had"))
    return first.where("keys IS NULL").select(id_col, "defect").unionByName(_judged(again, bare, id_col, kind))


def _judged(ready: DataFrame, model: Model, id_col: str, kind: str, doubts: bool = False) -> DataFrame:
    """(id, defect) of (id, prompt, response) or, where a fourth column has them, with the known words of each pair. doubts: with the pair and the keys it asks for, where these may change the defect."""
    shared = ready.sparkSession.sparkContext.broadcast(model)  # grows with letters and languages only, or is from learn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        asked_of = _Asked()
        lenient = replace(model, hedges=asked_of, english=asked_of)  # with the same cache of fits
        for b in batches:
            keep, kinds, keys = [], [], []
            columns = [c.to_pylist() for c in b.columns[1:]]
            for i, (p, r, *had) in enumerate(zip(*columns, strict=True)):
                if had:
                    known = set(had[0])
                    x = defect(p, r, replace(model, hedges=known, english=known))
                else:
                    x = defect(p, r, model)
                if not x:
                    continue
                asked_of.clear()
                if doubts and x in ("refusal", "language"):
                    defect(p, r, lenient)
                keep.append(i)
                kinds.append(x)
                keys.append(list(asked_of) or None)
            if not keep:
                continue
            out = [b.column(0).take(pa.array(keep)), pa.array(kinds, pa.string())]
            if doubts:
                out += [pa.array([columns[c][i] if k else None for i, k in zip(keep, keys, strict=True)], pa.string()) for c in (0, 1)]
                out.append(pa.array(keys, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "defect", "prompt", "response", "keys"][: len(out)])

    return ready.mapInArrow(run, f"{id_col} {kind}, defect string" + ", prompt string, response string, keys array<string>" * doubts)
