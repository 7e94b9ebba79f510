"""Toxicity of texts after noisy-channel deobfuscation.

A character trigram model is counted over all documents.  Where a text may be
disguised (symbols for letters, letters drawn apart, letters repeated), the
readings form a lattice; its best path under channel costs and character model
(Viterbi) is the restored text.  Where a text has one reading only, that is its
best path.  Restored words are then scored: the evidence of word beginnings is
learned from labels, shrunk by how often they were seen, and a logistic model
turns a document's evidence into a probability.  That model is fitted on
evidence by weights of other folds, so a document never vouches for itself.
"""

from __future__ import annotations

import array
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.functions.slices import SLICE_CHARS
from mulberry.llm.common import apart, cut, stored, table

#: Labelled rows that are learned from, about, whatever the corpus; they are picked by a hash of the identifier.
FIT_ROWS = 30_000
#: Hash places of word beginnings; tokens whose reading a task keeps; characters joined to be counted, SLICE_CHARS at a time.
PLACES, KEPT_TOKENS, CHARS_AT_ONCE = 1 << 21, 100_000, 4_000_000
#: Labelled rows that the logistic model's few numbers are fitted to, about; word beginnings are learned from all FIT_ROWS.
LOGISTIC_ROWS = 8_000
#: Rows that a task gives back at once; digests of toxic texts that are broadcast at most (32 bytes each), more are joined by a shuffle.
ROWS_OUT, BROADCAST_DIGESTS = 500, 200_000
#: Classes of characters: 0 is whatever parts words, 1-26 a-z, 27-58 the Latin-1 letters, 59 any other letter.
CLASSES, LAST_LATIN = 64, 0x17F
_LATIN1 = [c for c in range(0xDF, 0x100) if c != 0xF7]

# Letters that a symbol may stand for.
LOOKALIKES = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
}
#: Costs (in nats) of the channel: a symbol for a letter, a symbol left alone, a repeated letter shortened, a gap closed, a gap kept.
SUBSTITUTE, LEAVE, SHORTEN, CLOSE, KEEP_GAP = 1.0, 8.0, 0.7, 0.3, 6.0
#: Cost of a gap kept beside a part of several letters, and of a doubled letter shortened where most letters aren't doubled.
KEEP_PART, HALVE = 0.5, 3.0
#: Folds of the labelled rows, and standard errors that a word beginning's log odds are shrunk by.
FOLDS, SHRINK = 3, 1.5
_ONE, _PARTED = r"(?:[^\W_]|[@$!|+€£(])", r"[\s.,/\\\-_*~·]{1,3}"
_SPACED = re.compile(rf"(?<![^\W_])(?:[^\W\d_]{{2,3}}{_PARTED})?(?:{_ONE}{_PARTED}){{2,}}{_ONE}(?![^\W_])(?:{_PARTED}[^\W\d_]{{2,3}})?(?![\w@$!|+€£(])")
_LETTER, _SYMBOL = re.compile(r"[^\W\d_]"), re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
#: Parts readings where several are held in one string; no reading holds it.
PARTS = "\x1f"
_LETTERS = re.compile(r"([^\W\d_])\1*")
_RUN = re.compile(r"([^\W\d_])\1{2,}|([^\W\d_])\2.*([^\W\d_])\3")
_EDGE = re.compile(r"^[^\w@$!|+€£(]+|(?:[!?.,;:*#&%)\]\"'(|+@~^=<>{}/\\-]|\${3,})+$")
_WORD = re.compile(r"[^\W\d_]+")


def class_table() -> np.ndarray:
    """Class of each code point up to LAST_LATIN + 1, which stands for all beyond."""
    t = np.zeros(LAST_LATIN + 2, np.int64)
    for c in range(LAST_LATIN + 1):
        low = chr(c).lower()
        if len(low) == 1 and "a" <= low <= "z":
            t[c] = ord(low) - 96
        elif len(low) == 1 and ord(low) in _LATIN1:
            t[c] = 27 + _LATIN1.index(ord(low))
        elif chr(c).isalpha():
            t[c] = 59
    t[LAST_LATIN + 1] = 59
    return t


def count_trigrams(text: str, classes: np.ndarray, total: np.ndarray) -> None:
    """Add the text's trigrams of classes to ``total``, SLICE_CHARS characters at a time."""
    last, c = 1, np.empty(0, np.int64)
    for k in range(0, len(text), SLICE_CHARS):
        cp = np.frombuffer(text[k : k + SLICE_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        new = classes[np.minimum(cp, LAST_LATIN + 1)]
        kept = (new > 0) | (np.concatenate(([last], new[:-1])) > 0)  # a gap counts once
        # the last two classes go on into the next slice
        last, c = int(new[-1]), np.concatenate((c[-2:], new[kept]))
        if len(c) > 2:
            total += np.bincount((c[:-2] << 12) | (c[1:-1] << 6) | c[2:], minlength=CLASSES**3)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): how often three classes of characters follow each other, over the whole of all texts.

    There are CLASSES ** 3 codes at most, whatever the corpus.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, total = class_table(), np.zeros(CLASSES**3, np.int64)

        def add(parts: list[str]) -> None:
            count_trigrams(" ".join(["", *parts, ""]), classes, total)

        held, size = [], 0
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    held.append(text)
                    size += len(text)
                    if size > CHARS_AT_ONCE:
                        add(held)
                        held, size = [], 0
        add(held)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at.astype(np.int32), "n": total[at]})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: pd.DataFrame) -> np.ndarray:
    """Costs (negative log probabilities) of the third class after two, interpolated; CLASSES ** 3 of them."""
    c = np.zeros(CLASSES**3)
    c[counts["code"].to_numpy()] = counts["n"].to_numpy()
    c = c.reshape(CLASSES, CLASSES, CLASSES)
    two, one = c.sum(0), c.sum((0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (c + 5 * p2[None]) / (c.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


class Decoder:
    """Restores disguised tokens: the best path through the lattice of readings."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.classes = class_table()
        self.known: dict[str, str] = {}

    def _class(self, ch: str) -> int:
        return int(self.classes[min(ord(ch), LAST_LATIN + 1)]) if ch.isalpha() else 0

    def lattice(self, token: str, spaced: bool) -> list[list[tuple[str, float]]]:
        """For each place the readings and their costs."""
        out, i = [], 0
        runs = [len(m[0]) for m in _LETTERS.finditer(token)]
        # where most letters are doubled, that is a disguise
        halve = SHORTEN if 2 * sum(n > 1 for n in runs) >= len(runs) > 2 else HALVE
        while i < len(token):
            ch, j = token[i], i + 1
            while j < len(token) and token[j] == ch:
                j += 1
            n = j - i
            if ch.isalpha():
                readings = [(ch, 0.0)] if n == 1 else [(ch * 2, 0.0), (ch, halve)] if n == 2 else [(ch, SHORTEN), (ch * 2, SHORTEN)]
            elif ch in LOOKALIKES:
                readings = [(x, SUBSTITUTE) for x in LOOKALIKES[ch]] + [(x * 2, SUBSTITUTE) for x in LOOKALIKES[ch] if n > 1] + [(" ", LEAVE)]
            elif spaced:
                while j < len(token) and not token[j].isalnum() and token[j] not in LOOKALIKES:
                    j += 1
                beside = token[max(i - 2, 0) : i].isalpha() and i > 1 or token[j : j + 2].isalpha() and j + 1 < len(token)
                readings = [("", CLOSE), (" ", KEEP_PART if beside else KEEP_GAP)]
            else:
                readings = [(" ", 0.0)] if ch not in "-_.*" else [(" ", 0.0), ("", CLOSE + 2)]
            out.append(readings)
            i = j
        return [*out, [(" ", 0.0)]]

    def best(self, token: str, spaced: bool = False) -> str:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > KEPT_TOKENS:
                self.known.clear()
            found = self.known[token] = self._viterbi(self.lattice(token, spaced))
        return found

    def _viterbi(self, lattice: list[list[tuple[str, float]]]) -> str:
        # a state is the last two classes; a path is kept as links back
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for readings in lattice:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for text, own in readings:
                    x, y, c = a, b, cost + own
                    for ch in text:
                        z = self._class(ch)
                        if z or y:  # a gap after a gap is no character
                            c += float(self.costs[x, y, z])
                            x, y = y, z
                    old = new.get((x, y))
                    if old is None or c < old[0]:
                        new[(x, y)] = (c, (text, path))
            states = new
        _, path = min(states.values(), key=lambda s: s[0])
        parts = []
        while path is not None:
            parts.append(path[0])
            path = path[1]
        return "".join(reversed(parts)).strip()

    def token(self, token: str) -> str:
        """The reading of a token in lower case without white space."""
        if token.isalpha() and not _RUN.search(token):
            return token
        core = _EDGE.sub("", token)
        if _RUN.search(core) or _SYMBOL.search(core) and _LETTER.search(core):
            return self.best(core)
        return core

    def tokens(self, text: str | None) -> list[str]:
        """A text's tokens, letters that were drawn apart put together."""
        low = (text or "").lower()
        low = _SPACED.sub(lambda m: self.best(m[0], True) if _LETTER.search(m[0]) else m[0], low)
        return low.split()

    def restore(self, text: str | None) -> str:
        return " ".join(map(self.token, self.tokens(text)))


def beginnings(word: str) -> list[int]:
    """Hash places of a word's beginnings of 3 to 8 letters and of the whole word."""
    crc = zlib.crc32
    if not word.isascii():
        return [crc(x.encode()) % PLACES for x in (*(word[:k] for k in range(3, min(len(word), 8) + 1)), f"{word} ")]
    raw = word.encode()
    at = crc(raw[:3])
    out = [at % PLACES] if len(raw) > 2 else []
    for k in range(3, min(len(raw), 8)):
        at = crc(raw[k : k + 1], at)
        out.append(at % PLACES)
    return [*out, crc(raw[8:] + b" ", at) % PLACES]


def restored(docs: DataFrame, costs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, restored): the best reading of every text."""
    held = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(held.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "restored": [decoder.restore(t) for t in pdf["text"]]})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, restored string")


class Evidence:
    """A document's evidence: sum, maximum, count, distinct count and rate of its tokens' weights.

    ``weights`` has one row or several of the weights of all places; a token's
    is the largest of the places of what it reads, and is looked up once.
    """

    names = ("total", "most", "hits", "distinct", "rate")

    def __init__(self, weights: np.ndarray, read: Callable[[str], str]):
        # arrays of single numbers are faster than those of many for the few places of a token
        self.weights, self.read = [array.array("f", w.tobytes()) for w in weights.reshape(-1, PLACES)], read
        # tokens met since the last turn and before it: what is still met stays
        self.known: list[dict[str, float]] = [{} for _ in self.weights]
        self.older: list[dict[str, float]] = [{} for _ in self.weights]

    def _look_up(self, token: str) -> None:
        if len(self.known[0]) > KEPT_TOKENS:
            self.known, self.older = [{} for _ in self.weights], self.known
        if token in self.older[0]:
            for k, o in zip(self.known, self.older, strict=True):
                k[token] = o[token]
            return
        places = [p for w in _WORD.findall(self.read(token)) for p in beginnings(w)]
        for k, w in zip(self.known, self.weights, strict=True):
            k[token] = max(map(w.__getitem__, places), default=0.0)

    def of(self, tokens: list[str], row: int = 0) -> tuple[float, float, float, float, float]:
        known, hits, n = self.known[row], {}, 0
        for t in tokens:
            w = known.get(t)
            if w is None:
                self._look_up(t)
                known = self.known[row]
                w = known[t]
            if w:
                hits[t] = w
                n += 1
        return (math.log1p(sum(hits.values())), max(hits.values(), default=0.0), math.log1p(n), math.log1p(len(hits)), math.log1p(1000 * n / (len(tokens) + 20)))


def _readings(sample: DataFrame, costs: np.ndarray) -> DataFrame:
    """(fold, toxic, readings) of labelled texts: what their tokens read, in order."""
    held = sample.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder, known = Decoder(held.value), {}

        def read(text: str | None) -> str:
            if len(known) > KEPT_TOKENS:
                known.clear()
            out = []
            for t in decoder.tokens(text):
                r = known.get(t)
                if r is None:
                    r = known[t] = decoder.token(t)
                out.append(r)
            return PARTS.join(out)

        for pdf in batches:
            yield pdf[["fold", "toxic"]].assign(readings=[read(t) for t in pdf["text"]])

    return sample.mapInPandas(run, "fold int, toxic int, readings string")


def _place_counts(readings: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(place, fold, n), by task: texts with a word beginning there, of the places marked in ``only`` if that is given."""
    held = readings.sparkSession.sparkContext.broadcast(None if only is None else np.packbits(only))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        counts: dict[int, np.ndarray] = {}
        wanted = None if held.value is None else np.unpackbits(held.value)[:PLACES].astype(bool)
        for pdf in batches:
            for fold, text in zip(pdf["fold"], pdf["readings"], strict=True):
                if len(known) > KEPT_TOKENS:
                    known.clear()
                places: list[int] = []
                for r in set(text.split(PARTS)):
                    p = known.get(r)
                    if p is None:
                        p = [x for w in _WORD.findall(r) for x in beginnings(w)]
                        p = known[r] = p if wanted is None else [x for x in p if wanted[x]]
                    places += p
                if fold not in counts:
                    counts[fold] = np.zeros(PLACES, np.int32)
                counts[fold][np.unique(np.array(places, np.int64))] += 1
        for fold, c in counts.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"place": at.astype(np.int32), "fold": np.int32(fold), "n": c[at]})

    return readings.select("fold", "readings").mapInPandas(run, "place int, fold int, n int")


def shrunk_weight(neg: Column, pos: Column, all_neg: int, all_pos: int) -> Column:
    """Weight of a place: its log odds less SHRINK standard errors; 0 where nothing is left or nothing toxic was seen."""
    odds = F.log((pos + 0.5) / (all_pos + 1)) - F.log((neg + 0.5) / (all_neg + 1))
    low = odds - SHRINK * F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    return F.when(pos > 0, F.greatest(low, F.lit(0.0))).otherwise(0.0).cast("float")


def _learned_weights(readings: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Places with a weight, and FOLDS + 1 rows of their weights: without each fold, and of all; None without labels of both kinds."""
    n = np.zeros((FOLDS, 2), np.int64)
    for r in readings.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect():
        n[r["fold"], min(r["toxic"], 1)] += r["n"]
    all_neg, all_pos = map(int, n.sum(0))
    if not all_neg or not all_pos:
        return None

    def by_fold(counts: DataFrame, name: str) -> DataFrame:
        return counts.groupBy("place").agg(F.sum("n").alias(name), *[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"{name}{f}") for f in range(FOLDS)])

    # one sighting is none; places are PLACES at most, whatever the corpus
    pos = cut(by_fold(_place_counts(readings.filter("toxic > 0")), "pos").filter("pos > 1"))
    seen = np.zeros(PLACES, bool)
    seen[pos.select("place").toPandas()["place"].to_numpy()] = True
    neg = by_fold(_place_counts(readings.filter("toxic <= 0"), seen), "neg")
    by_place = pos.join(neg, "place", "left").na.fill(0)
    # what toxic texts have less often than others can't have a weight
    by_place = by_place.filter(F.col("pos") * all_neg > F.col("neg") * all_pos)
    less = [shrunk_weight(F.col("neg") - F.col(f"neg{f}"), F.col("pos") - F.col(f"pos{f}"), all_neg - int(n[f, 0]), all_pos - int(n[f, 1])).alias(f"w{f}") for f in range(FOLDS)]
    found = by_place.select("place", *less, shrunk_weight(F.col("neg"), F.col("pos"), all_neg, all_pos).alias(f"w{FOLDS}"))
    got = found.filter(F.greatest(*[f"w{f}" for f in range(FOLDS + 1)]) > 0).toPandas()
    return got["place"].to_numpy(), got[[f"w{f}" for f in range(FOLDS + 1)]].to_numpy(np.float32).T.copy()


def _dense(places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(PLACES, np.float32)
    out[places] = weights
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method; (weights with the intercept last, means, scales)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        d = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += d
        if np.abs(d).max() < 1e-8:
            break
    return w, mean, scale


def _fold_evidence(readings: DataFrame, places: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(toxic, evidence): of each labelled text by the weights of the other folds."""
    held = readings.sparkSession.sparkContext.broadcast((places, weights[:FOLDS]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, weights = held.value
        evidence = Evidence(np.stack([_dense(places, w) for w in weights]), str)
        for pdf in batches:
            rows = [evidence.of(t.split(PARTS) if t else [], f) for f, t in zip(pdf["fold"], pdf["readings"], strict=True)]
            yield pdf[["toxic"]].join(pd.DataFrame(rows, columns=Evidence.names, index=pdf.index, dtype=float))

    return readings.mapInPandas(run, ", ".join(["toxic int", *(f"{c} double" for c in Evidence.names)]))


def _scores(docs: DataFrame, costs: np.ndarray, model: tuple, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and the score of the column ``text``, in batches of ROWS_OUT."""
    held = docs.sparkSession.sparkContext.broadcast((costs, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        costs, (places, weights, w, b) = held.value
        decoder = Decoder(costs)
        evidence = Evidence(_dense(places, weights), decoder.token)
        for batch in batches:
            for k in range(0, len(batch), ROWS_OUT):
                pdf = batch.iloc[k : k + ROWS_OUT]
                x = np.array([evidence.of(decoder.tokens(t)) for t in pdf[text]], float).reshape(len(pdf), len(Evidence.names))
                yield pdf[keep].assign(score=1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))))

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*keep, *[c for c in [text] if c not in keep]).mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "score double"]))


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, tuple | float]:
    """The character model of all texts, and the learned model or, without labels of both kinds, the share of toxic ones."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    # the sample has fit_rows rows of two numbers at most, about
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    sample = slim.join(F.broadcast(known), "doc_id").select(fold, "toxic", "text")
    costs = language_model(trigram_counts(slim).toPandas())
    readings = stored(_readings(sample, costs), "readings")
    learned = _learned_weights(readings)
    if learned is None:
        share = readings.agg(F.avg("toxic")).first()[0]
        return costs, float(share or 0.0)
    places, weights = learned
    if n > LOGISTIC_ROWS:
        readings = readings.filter(F.pmod(F.xxhash64("readings"), F.lit(1_000_000)) < int(1_000_000 * LOGISTIC_ROWS / min(n, fit_rows)))
    fit = _fold_evidence(readings, places, weights).toPandas().sort_values([*Evidence.names, "toxic"])
    w, mean, scale = logistic(fit[list(Evidence.names)].to_numpy(), fit["toxic"].to_numpy(dtype=float))
    some = weights[FOLDS] > 0
    return costs, (places[some], weights[FOLDS][some], w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum()))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only texts are scored: labels, identifiers and other columns are no inputs.
    Labels are learned from rows with crc32(doc_id) mod 5 <> 0; of labels
    repeated for a document the largest counts, null labels don't.  Without
    labels of both kinds the score is the share of toxic ones (0 if there are
    none).  Null and empty texts have no evidence and get the score of that.
    """
    costs, model = fit_toxicity(docs, labels, id_col, text_col, label_col, fit_rows)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = _scores(slim, costs, model, ["doc_id"]) if isinstance(model, tuple) else slim.select("doc_id", F.lit(model).alias("score"))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns; a row is judged by its own text, whatever its identifier."""
    costs, model = fit_toxicity(docs, labels, id_col, text_col, label_col, fit_rows)
    if not isinstance(model, tuple):
        return docs.filter(F.lit(model < 0.5))
    # a text's score depends on nothing but the text, so its digest tells which rows go
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    name = apart(docs) + "digest"
    scored = _scores(docs.select(digest.alias("digest"), F.col(text_col).alias("text")), costs, model, ["digest"])
    gone = stored(scored.filter("score >= 0.5").select(F.col("digest").alias(name)).distinct(), "toxic")
    if gone.count() <= BROADCAST_DIGESTS:
        gone = F.broadcast(gone)
    return docs.join(gone, digest == F.col(name), "left_anti")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
