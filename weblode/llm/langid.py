"""Language of texts by cross-parsing entropy.

From each language a bounded amount of labelled text is learned as a suffix automaton, which knows every substring
of it.  A text is parsed by each automaton into its longest matching phrases: a phrase ends where no learned text
goes on that way.  Text of the automaton's own language falls into fewer phrases; phrases are counted per language,
normalised by the number of letters parsed, and the language needing the fewest wins.

Texts are reduced to lower-case letters with single blanks between words, and parsed in stretches of ``STRETCH``
such characters (a phrase does not cross them), many stretches side by side, so whole texts of any length cost the
same per character.

What is learned is bounded by ``DOCUMENTS`` documents and ``LEARNED`` characters per language, taken by the hash of
the text; everything else covers all rows.

Defined cases.  A null text or one without letters is ``und`` with score 0; if nothing could be learned all texts
are ``und``.  Letters unknown to every language are phrases of one letter each.  Ties go to the smaller language
name.  An empty table gives an empty result.  A null id counts as the empty text in the hold-out rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblode.session import materialize

DOCUMENTS = 64
LEARNED = 24_000
STRETCH = 1024
LANES = 8192
FOLDS = 5

_NOT_LETTERS = regex.compile(r"\P{L}+")


def reduced(text: str | None) -> str:
    """Lower-case letters, one blank between words."""
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip()


class SuffixAutomaton:
    """Transitions of the smallest automaton that accepts all substrings of a text.

    They lie in one array with the states' rows pushed into each other's gaps: the transition of a symbol is at
    ``base[state] + symbol`` if ``owner`` there is the state.  Its size follows the text, not the alphabet.
    """

    def __init__(self, symbols: np.ndarray, width: int):
        edges: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            state = len(edges)
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = state
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    copy = len(edges)
                    edges.append(dict(edges[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state
        # Without a way on, a phrase ends and the symbol begins the next one from the root (0 if never seen).
        self.root = np.zeros(width, np.int32)
        for c, to in edges[0].items():
            self.root[c] = to
        self.base, places = np.zeros(len(edges), np.int32), _packed(edges)
        self.owner = np.full(max(places, default=0) + width + 1, -1, np.int32)
        self.to = np.zeros(len(self.owner), np.int32)
        for place, (state, symbol, to) in places.items():
            self.owner[place], self.to[place] = state, to
            self.base[state] = place - symbol

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """Phrases ended in each column of ``lanes`` (symbols by position, -1 beyond the end)."""
        state = np.zeros(lanes.shape[1], np.int64)
        ended = np.zeros(lanes.shape[1], np.int64)
        alive = lanes.shape[1]
        for row in lanes:
            # Columns are ordered by length, so those that have ended are at the right.
            while alive and row[alive - 1] < 0:
                alive = int(np.searchsorted(-row[:alive], 1))
            if not alive:
                break
            at = self.base[state[:alive]] + row[:alive]
            on = self.owner[at] == state[:alive]
            ended[:alive] += ~on
            state[:alive] = np.where(on, self.to[at], self.root[row[:alive]])
        return ended


def _packed(edges: list[dict[int, int]]) -> dict[int, tuple[int, int, int]]:
    """A place for every edge (state, symbol, next state), a state's places as far apart as its symbols.

    States with many edges are placed first, where all of their places are free; those with one edge fill the gaps.
    """
    places: dict[int, tuple[int, int, int]] = {}
    start, size = 0, 0
    for state in sorted(range(len(edges)), key=lambda i: -len(edges[i])):
        symbols = sorted(edges[state])
        if not symbols:
            break
        if len(symbols) != size:
            start, size = 0, len(symbols)
        base = start
        while any(base + c in places for c in symbols):
            base += 1
        # States of equal size go on from where the last one found room.
        start = base
        for c in symbols:
            places[base + c] = (state, c, edges[state][c])
    return places


class Model:
    """Automata of all learned languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters = sorted(set("".join(samples.values())) | {" "})
        self.width = len(letters) + 1  # symbol 0 stands for any letter not learned
        self.codes = np.zeros(0x110000, np.int16 if self.width < 2**15 else np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(1, self.width)
        self.automata = [SuffixAutomaton(self.symbols(samples[x]), self.width) for x in self.languages]

    def symbols(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Phrases per reduced text and language."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        pieces, owners = [], []
        for i, text in enumerate(texts):
            symbols = self.symbols(text)
            for a in range(0, len(symbols), STRETCH):
                pieces.append(symbols[a : a + STRETCH])
                owners.append(i)
        sizes = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-sizes, kind="stable")
        for a in range(0, len(order), LANES):
            chosen = order[a : a + LANES]
            lanes = np.full((sizes[chosen[0]], len(chosen)), -1, self.codes.dtype)
            for k, p in enumerate(chosen):
                lanes[: sizes[p], k] = pieces[p]
            mine = np.array(owners)[chosen]
            for k, automaton in enumerate(self.automata):
                np.add.at(out[:, k], mine, automaton.phrases(lanes) + 1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        plain = [reduced(t) for t in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if self.languages:
            found = self.counts(plain)
            for i, text in enumerate(plain):
                if text:
                    rate = found[i] / len(text)
                    best = int(rate.argmin())
                    names[i] = self.languages[best]
                    others = np.delete(rate, best)
                    # Share of the runner-up: a half where both parse alike, 1 where it needs far more phrases.
                    scores[i] = float(others.min() / (others.min() + rate[best])) if len(others) else 1.0
        return names, scores


_models: dict[int, Model] = {}


def _model(samples: dict[str, str]) -> Model:
    """The model of these samples, built once per Python worker."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _models:
        _models.clear()
        _models[key] = Model(samples)
    return _models[key]


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def samples(docs: DataFrame, key: str, text: str, lang: str) -> dict[str, str]:
    """Learned text per language: at most ``LEARNED`` reduced characters of at most ``DOCUMENTS`` documents.

    The choice is by the hash of the text, each text once.  Only ids and hashes are ranked, and the ranking is cut
    within each task before its shuffle; what comes to the driver is bounded by the two parameters.
    """
    known = docs.filter(~held_out(F.col(key)) & F.col(lang).isNotNull() & (F.length(text) > 0))
    hashed = known.select(F.col(lang).alias("_lang"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    once = hashed.select("_lang", "_hash").distinct()
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash"))
    # A table of known, small size: the texts are not moved to meet it.
    chosen = materialize(once.withColumn("_rank", rank).filter(F.col("_rank") <= DOCUMENTS).drop("_rank"), "langid-chosen")
    share = -(-LEARNED // DOCUMENTS)
    # The stretch taken starts a quarter into the text, so headers shared by many documents weigh less.
    part = F.substring(F.col("_text"), (F.length("_text") / 4).cast("int") + 1, F.lit(4 * share))
    rows = (
        hashed.join(chosen, ["_lang", "_hash"])
        .groupBy("_lang", "_hash")
        .agg(F.min(part).alias("_part"))
        .orderBy("_lang", "_hash")
        .collect()
    )
    found: dict[str, str] = {}
    for row in rows:
        piece = reduced(row["_part"])[: 2 * share]
        if piece and len(found.get(row["_lang"], "")) < LEARNED:
            found[row["_lang"]] = (found.get(row["_lang"], "") + " " + piece)[:LEARNED]
    return found


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: ``key, held_out, lang_pred, score``."""
    learned = docs.sparkSession.sparkContext.broadcast(samples(docs, key, text, lang))
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(learned.value)
        for batch in batches:
            names, scores = model.predict(batch["_text"].tolist())
            yield pd.DataFrame(
                {"_key": batch["_key"], "held_out": batch["held_out"], "lang_pred": names, "score": scores}
            )

    given = docs.select(
        F.col(key).cast("string").alias("_key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("_text")
    )
    out = given.mapInPandas(run, "_key string, held_out boolean, lang_pred string, score double")
    return out.select(F.col("_key").cast(kind).alias(key), "held_out", "lang_pred", "score")
