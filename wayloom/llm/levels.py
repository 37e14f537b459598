"""Reading level of each document by regularised ordinal regression.

A text is cut into stretches of words; each gets a score from its lexical diversity, the rarity of its
words in the whole corpus, connectives, a proxy of clause depth and lengths. The level with the highest
mean probability over the stretches is the document's: quoted passages and templates do not carry it away.

Texts are taken in batches: one expression cuts a batch into words and marks, each distinct one of
which is looked up once, and all else is sums over arrays.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.words import visible, words
from wayloom.session import cut, spread

#: Words of a stretch, and least words of a document.
STRETCH, LEAST = 40, 40
#: Rarity, minus the log of a word's share of all words, from which on words count as equally rare. At
#: most e**RAREST words, 162,754, are more frequent, whatever the corpus: this bounds the table of them.
RAREST = 12.0
#: Graded rows that the model is fitted on at most.
SAMPLES = 20_000
#: Distinct words that a task counts before it passes the counts on; texts of a batch; distinct words a task knows.
COUNTED, BATCH, KNOWN = 500_000, 256, 300_000
_BREAK = re.compile(r"</?(?:p|br|li|div|h[1-6]|tr|td)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z!][^<>]*>", re.I)
#: Ends of sentences: marks after a word, and line ends after one, before a capital or with an empty line. What stands
#: before is looked at after the first character, so that the search is for that character alone.
_MARK = re.compile(r"[.!?](?<=[^\W\d_]{2}.)[.!?]*(?=\s|$)")
_LINE = re.compile(r"[ \t\n](?:(?<=[^\W\d_][ \t])[ \t]*\n(?:\n*(?=\s*[^\W\d_a-z])|\n)|(?<=[^\W\d_]\n)(?:\n*(?=\s*[^\W\d_a-z])|\n))")
#: Stand for the end of a sentence and of a text among the tokens.
_STOP, _END = "\x01", "\x02"
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|[.!?:\n,\x01\x02]")
_CONTROL = re.compile(r"[\x01\x02]")
_DERIVED = re.compile(r".{2,}(?:tions?|sions?|ity|ities|ments?|ances?|ences?|ously|ious|ous|ively|ive|ical|ional|ably|able|ible|ised|ated|ating|ism|ships?|ology)$")

# Frequent words that mark a language
LANGUAGE = {
    "en": "the a an and of to in is was it that with for our my her his their we you they she he not this had were has be on at as by but or are do so if no i from which who what there when after because although nobody several both".split(),
    "de": "der die das und ist war ein eine einen wir ich nicht mit sehr auch aber doch sich den dem des zu im am auf für von hat haben hatte diese dieser dieses es sie uns unsere unser ihr so als wenn weil wurde noch schon nur".split(),
    "fr": "le la les un une et est était dans nous je pas avec très aussi mais des du de ce cette ces il elle on notre nos pour sur en a ont avons qui que plus au aux par sa son ses toujours puis reste semble".split(),
    "es": "el la los las un una y es era fue en nosotros no con muy también pero del de al este esta estos por para que se su sus nuestro nuestra hemos ha lo como más me mi nos todo siempre cuando porque".split(),
}
# Connectives by what they do
CONNECTIVES = {
    "additive": frozenset("and also too besides moreover furthermore likewise neither nor as well".split()),
    "adversative": frozenset("but however yet although though whereas while despite notwithstanding nevertheless nonetheless albeit instead".split()),
    "causal": frozenset("because so since therefore thus hence consequently inasmuch insofar thereby whereby".split()),
    "temporal": frozenset("then when before after until till once now meanwhile during whenever upon afterwards finally".split()),
    "conditional": frozenset("if unless whether provided otherwise lest or".split()),
    "relative": frozenset("who which whom whose where that wherein".split()),
    "comparing": frozenset("than both as regarding concerning compared throughout".split()),
}
# Words that open a clause within a clause
DEEP = frozenset("that which who whom whose where whereas although unless whenever because when if while until having being been".split())
# Personal words
PERSONAL = frozenset("i you he she it we they me him us them my your his her its our their mine".split())
FEATURES = (
    "diversity", "rarity", *CONNECTIVES, "rarity of connectives", "clause depth", "commas", "word length",
    "derived words", "short words", "sentence length", "personal words", "of", "the",
)


def frequencies(texts: DataFrame) -> dict[str, float]:
    """Rarity, minus the log of the share of all words, of each word that is more frequent than RAREST says.

    Counts are exact and over all texts: summed within each task, then by word. What comes to the driver
    has at most e**RAREST rows, as that many words of so large a share there can be.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for part in parts:
            for t in part["text"]:
                if isinstance(t, str):
                    counts.update(words(t))
            if len(counts) > COUNTED:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts.clear()
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())}).astype({"word": "str", "n": "int64"})

    rows = cut(spread(texts.select("text")).mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    return {r["word"]: -math.log(r["n"] / total) for r in rows.where(F.col("n") > total * math.exp(-RAREST)).collect()}


def plain(text: str) -> str:
    text = visible(text)
    return _TAG.sub(" ", _BREAK.sub("\n\n", text)) if "<" in text else text


def _stopped(text: str) -> str:
    """The text with _STOP for each end of a sentence."""
    text = _CONTROL.sub(" ", text)
    return _MARK.sub(_STOP, _LINE.sub(_STOP, text) if "\n" in text else text)


#: What is known of a token by itself.
_OWN = (
    "word", *CONNECTIVES, "connective", "connective rarity", "deep", "personal", "of", "the", "length", "derived", "short", "rarity", "odd", "capital",
    "stop", "comma", "open", "end", *LANGUAGE,
)
_AT = {name: i for i, name in enumerate(_OWN)}
_FREQUENT = {k: frozenset(x for w in v for x in words(w)) for k, v in LANGUAGE.items()}


class Lexicon(dict):
    """Numbers of tokens, and what is known of each; looked up once a token. rarity: as of frequencies."""

    def __init__(self, rarity: dict[str, float]):
        super().__init__()
        self.rarity = rarity
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.folded: dict[str, int] = {}
        self.table = np.zeros((4096, len(_OWN)), np.float32)
        self.same = np.zeros(4096, np.int64)

    def rare(self, bare: list[str]) -> float:
        return sum(self.rarity.get(x, RAREST) for x in bare) / len(bare) if bare else RAREST

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        if n >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.same = np.concatenate([self.same, np.zeros_like(self.same)])
        row, low = self.table[n], token.casefold()
        self.same[n] = self.folded.setdefault(low, len(self.folded))
        if not token[0].isalpha():
            row[_AT["stop"]], row[_AT["comma"]], row[_AT["end"]] = token == _STOP, token == ",", token == _END
            row[_AT["open"]] = token not in (",", _END)
            return n
        bare, size = words(low), min(len(low), 14)
        rare = self.rare(bare)
        kinds = [low in v for v in CONNECTIVES.values()]
        row[: _AT["capital"] + 1] = [
            1, *kinds, any(kinds), rare if any(kinds) else 0, low in DEEP, low in PERSONAL, low == "of", low == "the", size,
            _DERIVED.match(low) is not None, size <= 4, rare, "-" in low or len(low) > 24, token[0].isupper() and token != "I",
        ]
        row[_AT["end"] + 1 :] = [any(x in v for x in bare) for v in _FREQUENT.values()]
        return n


def features(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, a row of FEATURES) for each stretch, and for each text whether it is English.

    By the frequent words of four languages: English must have more than each other one. Names say
    little about a level: words with a capital within a sentence do not count for lengths and rarity,
    unless most words of the text have one. Texts without words have no stretch.
    """
    if len(lexicon) > KNOWN:
        lexicon.reset()
    joined = _END.join(_stopped(plain(t)) for t in texts) + _END
    tokens = _TOKEN.findall(joined)
    ids = np.fromiter(map(lexicon.__getitem__, tokens), np.int64, len(tokens))
    get = lambda name, at: lexicon.table[at, _AT[name]]
    is_word = get("word", ids) > 0
    at, word = np.flatnonzero(is_word), ids[is_word]
    text_of = np.cumsum(get("end", ids))[at].astype(np.int64)
    english = np.zeros(len(texts), bool)
    if not len(word):
        return np.zeros(0, np.int64), np.zeros((0, len(FEATURES))), english
    begins = np.flatnonzero(np.r_[True, text_of[1:] != text_of[:-1]])
    own, n = text_of[begins], np.diff(np.r_[begins, len(word)])
    rows = lexicon.table[word]
    spoken = np.add.reduceat(rows[:, _AT["end"] + 1 :], begins, axis=0)
    english[own] = (spoken[:, 0] > 0) & (spoken[:, :1] > spoken[:, 1:]).all(1)

    many = np.maximum(1, np.round(n / STRETCH)).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), many)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    cuts = begins[doc] + np.round(step * n[doc] / many[doc]).astype(np.int64)
    size = np.diff(np.r_[cuts, len(word)])

    opens = np.cumsum(get("open", ids))[at]
    inner = np.r_[False, (opens[1:] == opens[:-1]) & (text_of[1:] == text_of[:-1])]
    capital = rows[:, _AT["capital"]]
    few = np.add.reduceat(capital, begins) / n < 0.4
    odd = (rows[:, _AT["odd"]] > 0) | ((capital > 0) & inner & np.repeat(few, n))
    between = lambda name: np.diff(np.r_[np.cumsum(get(name, ids))[at], np.cumsum(get(name, ids))[-1]])
    total = lambda v: np.add.reduceat(v, cuts, axis=0)
    all_, some = total(rows), total(rows * ~odd[:, None])
    usual = some[:, _AT["word"]]
    base = np.where((usual > 0)[:, None], some, all_) / np.where(usual > 0, usual, size)[:, None]
    share = lambda k: all_[:, _AT[k]] / size
    stretch = np.repeat(np.arange(len(cuts)), size)
    pairs = np.unique(stretch * (int(lexicon.same[word].max()) + 1) + lexicon.same[word])
    different = np.bincount(pairs // (int(lexicon.same[word].max()) + 1), minlength=len(cuts))
    linked = all_[:, _AT["connective"]]
    columns = [
        different / size, base[:, _AT["rarity"]], *(share(k) for k in CONNECTIVES), np.where(linked > 0, all_[:, _AT["connective rarity"]] / np.maximum(linked, 1), 4.0),
        share("deep"), total(between("comma")) / size, base[:, _AT["length"]], base[:, _AT["derived"]], base[:, _AT["short"]],
        np.log(np.minimum(40.0, size / (total(between("stop")) + 0.5))), share("personal"), share("of"), share("the"),
    ]
    return own[doc], np.column_stack(columns), english


@dataclass
class Ordinal:
    """Proportional odds: P(level > k) = 1 / (1 + exp(border_k - w.x))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    borders: np.ndarray

    def levels(self, x: np.ndarray) -> np.ndarray:
        score = (x - self.mean) / self.scale @ self.weights
        return 1 + (score[:, None] > self.borders[None, :]).sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Probability of each level."""
        above = 1 / (1 + np.exp(np.clip(self.borders[None, :] - self.scores(x)[:, None], -40, 40)))
        return -np.diff(np.c_[np.ones(len(x)), above, np.zeros(len(x))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.01, steps: int = 1_500) -> Ordinal:
    """Least penalised loss by gradient descent with momentum; the borders stay ordered."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z, top = (x - mean) / scale, int(y.max())
    above = (y[:, None] > np.arange(1, top)[None, :]).astype(float)
    w, first, gaps = np.zeros(x.shape[1]), 0.0, np.zeros(top - 2)
    p = np.r_[w, first, gaps]
    m, v = np.zeros_like(p), np.zeros_like(p)
    k = x.shape[1]
    for t in range(1, steps + 1):
        w, borders = p[:k], p[k] + np.r_[0, np.cumsum(np.exp(p[k + 1 :]))]
        d = 1 / (1 + np.exp(np.clip(borders[None, :] - (z @ w)[:, None], -40, 40))) - above
        gw = z.T @ d.sum(1) / len(z) + penalty * w
        gb = -d.mean(0)
        g = np.r_[gw, gb.sum(), [np.exp(p[k + 1 + j]) * gb[j + 1 :].sum() for j in range(top - 2)]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Ordinal(mean, scale, p[:k], p[k] + np.r_[0, np.cumsum(np.exp(p[k + 1 :]))])


def fit_graded(samples: list[tuple[str, int]], lexicon: Lexicon) -> Ordinal:
    own, x, _ = features([t for t, _ in samples], lexicon)
    return fit(x, np.array([y for _, y in samples])[own])


def levels_of(texts: list[str], model: Ordinal, lexicon: Lexicon) -> list[int | None]:
    """The level of each text, None if it is not English or has fewer than LEAST words between white space."""
    out: list[int | None] = [None] * len(texts)
    some = [i for i, t in enumerate(texts) if len(t.split(None, LEAST)) >= LEAST]
    own, x, english = features([texts[i] for i in some], lexicon)
    if len(own):
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        best = 1 + np.argmax(np.add.reduceat(model.chances(x), begins, axis=0), axis=1)
        for k, level in zip(own[begins].tolist(), best.tolist()):
            if english[k]:
                out[some[k]] = level
    return out


def rate(documents: DataFrame, graded: DataFrame) -> DataFrame:
    """(doc_id, level) of each English document of at least LEAST words.

    graded: (text, level 1 to 4), of which at most SAMPLES rows are fitted, the first by hash. Word
    frequencies are counted over all documents in one pass, a second one rates them; texts are read whole.
    Null and short texts, texts in other languages and rows with a null doc_id have no row; a repeated
    doc_id has one for each of its rows. Without graded rows of two levels there is no model and no row.
    """
    rows = graded.where("text IS NOT NULL AND level IS NOT NULL").orderBy(F.xxhash64("text")).limit(SAMPLES).select("text", "level").collect()
    samples = [(r.text, int(r.level)) for r in rows]
    spark = documents.sparkSession
    if len({y for _, y in samples}) < 2 or max(y for _, y in samples) < 2:
        return spark.createDataFrame([], "doc_id bigint, level int")
    rarity = frequencies(documents)
    shared = spark.sparkContext.broadcast((fit_graded(samples, Lexicon(rarity)), rarity))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, rarity = shared.value
        lexicon = Lexicon(rarity)
        for part in parts:
            ids, texts = part["doc_id"].tolist(), part["text"].tolist()
            levels: list[int | None] = []
            for i in range(0, len(texts), BATCH):
                levels += levels_of([t if isinstance(t, str) else "" for t in texts[i : i + BATCH]], model, lexicon)
            found = [(d, v) for d, v in zip(ids, levels) if v is not None]
            yield pd.DataFrame({"doc_id": [d for d, _ in found], "level": [v for _, v in found]}).astype({"doc_id": "int64", "level": "int32"})

    return spread(documents.where("doc_id IS NOT NULL").select("doc_id", "text")).mapInPandas(run, "doc_id bigint, level int")
