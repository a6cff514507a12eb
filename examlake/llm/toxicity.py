"""Toxicity scores by noisy-channel deobfuscation.

What a writer meant is decoded from what stands in the text: a token is a lattice whose arcs say that a sign stands for itself, for the
letter it resembles (signs, digits, letters of other scripts), for nothing (a separator, or a mark that can't be seen) or repeats the letter before. A character trigram model, learned
from labelled documents, weighs the letters; the Viterbi path is the restored token. Runs of single signs between spaces are one token, and
also the words into which its lattice may cut it. Signs at a token's ends are read both as punctuation and as the letters they resemble.
Restored tokens and their beginnings are the features; each has a cautious probability that a document with it is toxic (the lower end of
Wilson's interval). A document's score follows from its surest feature, as weak hints don't add up, by an increasing step function that
says what share of the labelled documents with such a feature are toxic.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import product
from math import log, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, releasing, text_column, written

THRESHOLD = 0.3
#: Standard deviations by which a feature's probability is taken below its frequency, and the score without any feature.
CAUTION, FLOOR = 3.0, 0.01
#: A feature is one if its probability is above this; how often a task must have seen one to tell that it is frequent, and how many different tokens it counts at a time.
LEAST, FREQUENT, DISTINCT = 0.25, 8, 400_000
#: Steps of the score function.
STEPS = 20
#: The letters that signs resemble.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = ".-_*~'`^,:;/\\ "
#: Letters of other scripts that look like Latin ones, and what a reader doesn't see within a word.
FOREIGN = dict(zip("аеорсухіјѕԁɡһӏνοαρτικωυε", "aeopcyxijsdghlvoaptikwue", strict=True))
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u0335\u0336\u0337\u0338"
#: Log probabilities of the channel's steps.
RESEMBLES, SEPARATES, REPEATS, STANDS, ENDS = log(0.2), log(0.3), log(0.4), log(1e-4), log(0.1)
_PLAIN = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1*")
_EDGES = ".,;:?!|\"'`()[]{}<>#%&*~^-_=/\\"
#: A word of letters with no other signs at its ends than those that resemble no letter.
_EASY = re.compile(rf"[{re.escape(''.join(c for c in _EDGES if c not in LOOKALIKES))}]*([^\W\d_]+)[{re.escape(''.join(c for c in _EDGES if c not in LOOKALIKES))}]*")
_SPACED = re.compile(r"(?<!\S)(?:\S[ .\-_*]{1,2}){2,}\S(?!\S)")
_CACHE = 200_000


class Letters:
    """Trigrams of characters; ends of a token are a space."""

    def __init__(self, counts: dict[str, int]):
        self.three, self.two = counts, Counter()
        for gram, n in counts.items():
            self.two[gram[:2]] += n
        self.steps: dict[str, float] = {}  # as far as asked for; at most as many as trigrams of signs in use

    @staticmethod
    def of(tokens: Counter) -> Counter:
        out: Counter = Counter()
        for token, n in tokens.items():
            padded = f"  {token} "
            for i in range(len(padded) - 2):
                out[padded[i : i + 3]] += n
        return out

    def step(self, before: str, char: str) -> float:
        found = self.steps.get(before + char)
        if found is None:
            found = self.steps[before + char] = log((self.three.get(before + char, 0) + 0.02) / (self.two.get(before, 0) + 1.0))
        return found

    def word(self, word: str) -> float:
        padded = f"  {word} "
        return sum(self.step(padded[i : i + 2], padded[i + 2]) for i in range(len(word) + 1))


def restored(token: str, model: Letters, several: bool = False) -> str:
    """The letters of the best path through a token's lattice; several: words may end at separators, and have spaces between them."""
    return _decoded(token, model, several)[1]


def _decoded(token: str, model: Letters, several: bool = False, repeats: bool = True) -> tuple[float, str]:
    """The score of the best path and its letters; a state is the last two letters, a path a chain of (path before, letter)."""
    states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    for sign in token:
        ahead: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, path) in states.items():
            if sign.isalpha():
                arcs = [(sign, 0.0)] + ([(FOREIGN[sign], RESEMBLES)] if sign in FOREIGN else [])
            elif sign in UNSEEN:
                ahead[state] = max(ahead.get(state, (score, path)), (score, path), key=lambda x: x[0])
                continue
            else:
                arcs = [(other, RESEMBLES) for other in LOOKALIKES.get(sign, "")] + ([] if sign in SEPARATORS else [(sign, STANDS)])
            steps = [(state[1] + letter, score + cost + model.step(state, letter), (path, letter)) for letter, cost in arcs]
            steps += [(state, score + cost + REPEATS, path) for letter, cost in arcs if repeats and letter == state[1]]
            if sign in SEPARATORS:
                steps.append((state, score + SEPARATES, path))
                if several and state != "  ":
                    steps.append(("  ", score + ENDS + model.step(state, " "), (path, " ")))
            for new, total, trail in steps:
                if new not in ahead or ahead[new][0] < total:
                    ahead[new] = (total, trail)
        states = ahead
    score, path = max(((score + model.step(state, " "), path) for state, (score, path) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        out.append(path[1])
        path = path[0]
    return score, "".join(reversed(out))


def _fewer(body: str) -> list[tuple[float, str]] | None:
    """Cost and letters of all paths of a body of plain letters, whose only arcs are those of repeated letters; None if there are very many."""
    runs = [m[0] for m in _RUN.finditer(body)]
    if prod(map(len, runs)) > 64:
        return None
    return [(sum(len(r) - k for r, k in zip(runs, kept, strict=True)) * REPEATS, "".join(r[:k] for r, k in zip(runs, kept, strict=True))) for kept in product(*(range(1, len(r) + 1) for r in runs))]


def tokens(text: str) -> set[str]:
    """The distinct lower-case tokens of a whole text, without signs at their ends, and its runs of single signs; wide and styled letters are plain ones."""
    low = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    return set(low.split()) | set(_SPACED.findall(low))


def _bodies(token: str) -> list[str]:
    """A token without signs at its ends, and with those at either end that resemble letters."""
    bare = token.strip(_EDGES).rstrip("$")
    if not any(c.isalpha() for c in bare):
        return [bare]
    head, _, tail = token.partition(bare)
    heads = ["", *(head[i:] for i in [next((i for i, c in enumerate(head) if c in LOOKALIKES), None)] if i is not None)]
    tails = ["", *(tail[: i + 1] for i in [max((i for i, c in enumerate(tail) if c in LOOKALIKES), default=None)] if i is not None)]
    return [h + bare + t for h in heads for t in tails]


def _plain(body: str) -> bool:
    """Whether a body needs no decoding: its lattice has one path, it has no letter, or its letters are all of one other script."""
    if body.isascii():
        return not any(c.isalpha() for c in body) or bool(_PLAIN.fullmatch(body) and not _REPEATED.search(body))
    mixed = any(c in FOREIGN for c in body) and any(c.isascii() and c.isalpha() for c in body)
    return not any(c.isalpha() for c in body) or bool(not mixed and _PLAIN.fullmatch(body) and not _REPEATED.search(body))


def clear(token: str, model: Letters) -> str:
    """What a token most likely says: the best path of its bodies' lattices."""
    bodies = _bodies(token)
    if len(bodies) == 1 and _plain(bodies[0]):
        return bodies[0]
    return max(_decoded(body, model, bool(_SPACED.fullmatch(body))) for body in bodies)[1]


def readings(token: str, model: Letters) -> set[str]:
    """All words that a token may say: of each of its bodies, the restored one and, of plain letters, the body itself; of a run of signs, also its words."""
    out = set()
    for body in _bodies(token):
        if _plain(body) or _PLAIN.fullmatch(body):
            out.add(body)
        if not _plain(body):
            ways = _fewer(body) if _PLAIN.fullmatch(body) and body.isascii() else None
            out.add(word := max((cost + model.word(w), w) for cost, w in ways)[1] if ways else restored(body, model))
            if len(word) < 3:  # too short for a feature: letters that stand twice may be meant so
                out.add(_decoded(body, model, repeats=False)[1])
            if _SPACED.fullmatch(body):
                out.update(restored(body, model, several=True).split())
    return out


def features(word: str) -> list[str]:
    """The word, and its beginning of four letters."""
    if len(word) < 3:
        return []
    return ["=" + word, "^" + word[:4]] if len(word) > 4 else ["=" + word, "^" + word]


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of the documents' plain words (feature false), and features that plain tokens alone show to be in n documents at least (true)."""
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(tokens(text))
            if len(seen) > DISTINCT:
                yield _of_tokens(seen)
                seen = Counter()
    yield _of_tokens(seen)


def _of_tokens(seen: Counter) -> pa.RecordBatch:
    words, least = Counter(), {}
    for token, n in seen.items():
        word = token.strip(_EDGES)
        if _PLAIN.fullmatch(word):
            words[word] += n
        if n >= FREQUENT and word == token and _plain(token):  # its one reading is itself
            for feature in features(token):
                least[feature] = max(least.get(feature, 0), n)
    grams = Letters.of(words)
    return pa.RecordBatch.from_pydict({"feature": pa.array([False] * len(grams) + [True] * len(least)), "key": pa.array([*grams, *least], pa.string()), "n": pa.array([*grams.values(), *least.values()], pa.int64())})


def _feature_counts(letters: dict[str, int], wanted: dict[str, float] | None = None):
    """In how many documents each feature is; wanted: of these alone, so tokens that can't have one needn't be decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, every = Model(letters, wanted or {}), Counter()
        known: dict[str, set[str]] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = set()
                for t in tokens(text) - model.without:
                    if t not in known:
                        got = {f for w in readings(t, model.letters) for f in features(w) if wanted is None or f in wanted} if wanted is None or model.possible(t) else set()
                        cache = known if got else model.without
                        if len(cache) >= _CACHE:
                            cache.clear()
                        if not got:
                            model.without.add(t)
                            continue
                        known[t] = got
                    found |= known[t]
                every.update(found)
                if len(every) > 500_000:
                    yield _as_batch(every)
                    every = Counter()
        yield _as_batch(every)

    return run


def _as_batch(every: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"feature": pa.array(list(every), pa.string()), "n": pa.array(list(every.values()), pa.int64())})


def _cautious(toxic: Column, n: Column) -> Column:
    """The lower end of Wilson's interval; for a given number of toxic documents it falls with n."""
    share, z2 = toxic / n, CAUTION**2
    return (share + z2 / (2 * n) - CAUTION * F.sqrt((share * (1 - share) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, int], dict[str, float], list[float]]:
    """Trigram counts, feature probabilities and score steps from all labelled documents of docs (doc_id, text).

    Rows of labels (doc_id, toxic) with nulls are left out; of several labels of a document, the highest counts. Features are counted in toxic documents first: what
    frequent plain tokens show to be too common to have a probability above LEAST is not counted in the others. The model itself comes to the driver: trigrams of the scripts' letters,
    and features that toxic documents have and others seldom have.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", text_column()).withColumn("hash", F.xxhash64("text"))
    # copies count once; which of them, is told by their hashes, so texts travel to their labels and no further
    chosen = texts.select("doc_id", "hash").join(known, "doc_id").groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    train = texts.join(chosen.hint("merge"), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("text", "toxic")
    train = written(train, "train")
    counts = written(train.select("text").mapInArrow(releasing(_token_counts), "feature boolean, key string, n long").groupBy("feature", "key").agg(F.sum("n").alias("n")), "counts")
    letters = {r.key: r.n for r in counts.where("not feature").collect()}
    features_in = lambda rows, wanted=None: rows.select("text").mapInArrow(releasing(_feature_counts(letters, wanted)), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    toxic = written(features_in(train.where("toxic <> 0")).where("n > 2").withColumnRenamed("n", "toxic"), "toxic")
    least = counts.where("feature").select(F.col("key").alias("feature"), F.col("n").alias("least"))
    possible = toxic.join(least, "feature", "left").where(_cautious(F.col("toxic"), F.greatest("toxic", F.coalesce("least", F.lit(0)))) > LEAST)
    wanted = {r.feature: float(r.toxic) for r in possible.collect()}
    odds = {r.feature: r.p for r in features_in(train, wanted).join(toxic, "feature").select("feature", _cautious(F.col("toxic"), F.col("n")).alias("p")).where(F.col("p") > LEAST).collect()}
    steps = train.mapInArrow(releasing(_surest_counts(letters, odds)), "step int, toxic long").groupBy("step").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    in_step, n = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
    for r in steps.collect():
        in_step[r.step], n[r.step] = r.toxic, r.n
    for table in (train, counts, toxic):
        drop_written(table)
    return letters, odds, increasing(in_step, n)


class Model:
    """Letters, feature probabilities and the steps from a document's surest feature to its score."""

    def __init__(self, letters: dict[str, int], odds: dict[str, float], steps: list[float] | None = None):
        self.letters, self.odds, self.steps = Letters(letters), odds, steps
        self.once = {_RUN.sub(r"\1", f) for f in odds}
        self.known: dict[str, float] = {}
        self.without: set[str] = set()  # tokens without odds

    def surest(self, text: str) -> float:
        most = 0.0
        for token in tokens(text) - self.without:
            found = self.known.get(token)
            if found is None:
                found = max((self.odds.get(f, 0.0) for w in readings(token, self.letters) for f in features(w)), default=0.0) if self.possible(token) else 0.0
                cache = self.known if found else self.without
                if len(cache) >= _CACHE:
                    cache.clear()
                if found:
                    self.known[token] = found
                else:
                    self.without.add(token)
            most = max(most, found)
        return most

    def possible(self, token: str) -> bool:
        """Whether any reading of a token may have odds, without decoding it; True if that isn't easy to tell.

        All readings of a word of letters are one word once letters that stand twice are taken as one, and so are their beginnings.
        """
        word = token if token.isalpha() else (m := _EASY.fullmatch(token)) and m[1]
        if not word or not (word.isascii() or FOREIGN.keys().isdisjoint(word)):
            return True
        if not _REPEATED.search(word):
            return "=" + word in self.odds or "^" + word[:4] in self.odds
        once = _RUN.sub(r"\1", word)
        return "=" + once in self.once or any("^" + once[:k] in self.once for k in range(1, 5))

    def score(self, text: str) -> float:
        x = self.surest(text)
        return FLOOR + (0.99 - FLOOR) * self.steps[round(x * STEPS)] + 0.01 * x


def increasing(toxic: np.ndarray, n: np.ndarray) -> list[float]:
    """Shares of toxic among n, pooled with their neighbours until they don't fall; where there is no document, the neighbour's."""
    pools: list[list[float]] = []  # toxic, n, width
    for t, m in zip(toxic, n, strict=True):
        pools.append([t, m, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, m2, w2 = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + m2, pools[-1][2] + w2]
    return [t / m if m else 0.0 for t, m, w in pools for _ in range(int(w))]


def _surest_counts(letters: dict[str, int], odds: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(letters, odds)
        for batch in batches:
            steps = [round(model.surest(t) * STEPS) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"step": pa.array(steps, pa.int32()), "toxic": batch.column("toxic").cast(pa.int64())})

    return run


def _scored(letters: dict[str, int], odds: dict[str, float], steps: list[float], texts: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(letters, odds, steps)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                score = np.array([model.score(text or "") for text in part.column("text").to_pylist()])
                columns = {name: part.column(name) for name in part.schema.names if texts or name != "text"}
                yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

    return run


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document of docs (doc_id, text); labels: doc_id, toxic.

    Documents with crc32(doc_id as text) mod 4 = 2 are held out: their labels aren't looked at. Null and empty texts score FLOOR at
    least, as do all texts where no labelled document is known. A null doc_id isn't held out. Repeated rows appear each time; other columns don't matter; an empty table gives no rows.
    """
    letters, odds, steps = fitted(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))
    out = docs.select("doc_id", text_column()).mapInArrow(releasing(_scored(letters, odds, steps)), "doc_id long, score double, predicted int")
    return out.withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def with_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score and predicted beside its columns (which must not have these names); no text is shuffled."""
    letters, odds, steps = fitted(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(releasing(_scored(letters, odds, steps, texts=True)), f"{schema}, score double, predicted int")


def restored_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and the restored form of each distinct token that is written otherwise, for a look at the decoding."""
    letters, _, _ = fitted(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Letters(letters)
        for batch in batches:
            rows = [(d, t, w) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for t in sorted(tokens(text)) if (w := clear(t, model)) != t.strip(_EDGES)]
            yield pa.RecordBatch.from_pylist([{"doc_id": d, "token": t, "restored": w} for d, t, w in rows], pa.schema([("doc_id", pa.int64()), ("token", pa.string()), ("restored", pa.string())]))

    return docs.select("doc_id", text_column()).mapInArrow(releasing(run), "doc_id long, token string, restored string")
