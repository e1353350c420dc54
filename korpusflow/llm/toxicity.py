"""Toxicity behind obfuscation: a noisy channel restores words, hashed evidence over the restored words scores texts.

Words with look-alike digits or signs, inner separators or stretched letters, and runs of single characters, are decoded
by Viterbi over a lattice of characters: each raw character may stand for itself, for a letter it resembles, or
(separators, signs and stretched letters) for nothing, at a channel cost; the paths are weighed by a character trigram
model counted over all texts. Adjoining words that together spell a word of much evidence are joined. Evidence of a word
is the largest smoothed log odds of its pieces (character windows of SIZES, and the whole word), by their mean share in
the words of toxic against other training texts. A logistic regression over each text's three largest words, its distinct
words and its share of words at each level of evidence, and its length gives the score. Labels are learned from at most
`max_rows` rows of the training folds (those whose hash is least).

Cases: null and empty texts get the score of a text without evidence; very long texts are scored whole; a null doc_id
belongs to the fold of an empty id; repeated rows score alike; paths of equal cost are decided by their text; without
labels of both classes all scores are the share of label 1 (0 or 1; 0 if none); other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import coded, fold, give_back, mix, polynomials, put_together, row_slices, words
from korpusflow.llm.ngrams import best_piece, calibrate, char_grams
from korpusflow.llm.quality import sampled

MAX_TRAIN_ROWS = 10_000
SIZES = (4, 5, 6, 7)
#: Restored words that a worker remembers.
KNOWN_WORDS = 50_000
SMOOTH = 4.0
#: Evidence from which a word counts at each level.
LEVELS = (1.2, 2.0, 3.0, 4.5)
#: A word of this evidence is looked for in two or three words side by side, of so many bytes together at most.
JOINED_FROM, JOINED_BYTES = LEVELS[2], 32
#: Words that a text counts as having beside its own, and the share of words that smooths the odds.
SPARE_WORDS, SPARE_SHARE = 20, 0.0025
#: Shares of words are counted in these units.
UNIT = 1e-7
PIECE, WORD, TEXTS = 0, 1, 2
FEATURES = 4 + 2 * len(LEVELS)
#: Letters of the character model, and what signs may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøùúûüýÿßœ"
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = ".-_*~'·"
#: Signs that may stand for a letter or for nothing.
SIGNS = "!|+"
SWAP_COST, DROP_COST, STRETCH_COST = 1.5, 1.5, 0.3
EDGE = "%&#*.,;:?!\"()[]{}<>|…«»“”„'`~^=/\\+-_"
SUSPECT = re.compile(r"[0-9@$!|+€]|[^\W\d_][.\-_*~'·]+[^\W\d_]|([^\W\d_])\1\1")
STRETCHED = re.compile(r"(.)\1\1")
INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER = len(LETTERS) + 1
SYMBOLS = OTHER + 1  # 0 is the edge of a word


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over the words of all texts, as a cube of fixed size."""

    def run(batches):
        give_back()
        total = np.zeros(SYMBOLS**3, np.int64)
        table = np.full(0x110000, OTHER, np.int64)
        table[[ord(c) for c in LETTERS]] = np.arange(1, OTHER)
        table[32] = 0
        for part in (p for batch in batches for p in row_slices(batch.column(0))):
            codes, distinct = coded(words(part)[0])
            if not distinct:
                continue
            counts = np.bincount(codes, minlength=len(distinct))
            cores = [bare(w) for w in distinct]
            lengths = np.fromiter(map(len, cores), np.int64, len(cores)) + 3
            chars = table[np.frombuffer(("  " + "   ".join(cores) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
            owner = np.repeat(np.arange(len(cores)), lengths)
            tri = (chars[:-2] * SYMBOLS + chars[1:-1]) * SYMBOLS + chars[2:]
            inside = owner[:-2] == owner[2:]
            total += np.bincount(tri[inside], counts[owner[:-2][inside]], len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    cube = np.zeros(SYMBOLS**3)
    cube[np.asarray(got["at"])] = np.asarray(got["n"])
    return cube.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Channel:
    """Viterbi decoder of one word under the character trigram model."""

    def __init__(self, cube: np.ndarray):
        def share(x):
            return (x + 0.0) / np.maximum(x.sum(axis=-1, keepdims=True), 1)

        one = (cube.sum(axis=(0, 1)) + 1) / (cube.sum() + SYMBOLS)
        model = 0.7 * share(cube) + 0.25 * share(cube.sum(axis=0))[None] + 0.05 * one[None, None]
        self.cost = (-np.log(model)).tolist()
        self.known: dict[str, str] = {}

    def restore(self, word: str) -> str:
        if word.isalpha() and not STRETCHED.search(word):
            return word
        got = self.known.get(word)
        if got is None:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            if not SUSPECT.search(word) or word.isdecimal():  # a number alone is a number
                return word
            got = self.known[word] = self.decode(word)
        return got

    def decode(self, word: str) -> str:
        cost = self.cost
        states = {(0, 0): (0.0, None)}  # last two symbols: cost, chain of output characters
        for i, c in enumerate(word):
            options = [(c, 0.0)] + [(x, SWAP_COST) for x in LOOKALIKES.get(c, "")]
            drop = DROP_COST if (c in SEPARATORS and i) or c in SIGNS else None
            if i and word[i - 1] == c and (word[i - 2 : i - 1] == c or word[i + 1 : i + 2] == c):
                drop = STRETCH_COST
            new: dict = {}
            for (a, b), (so_far, chain) in states.items():
                row = cost[a][b]
                for x, extra in options:
                    k = INDEX.get(x, OTHER)
                    value = so_far + extra + row[k]
                    if value < new.get((b, k), (math.inf,))[0]:
                        new[b, k] = value, (chain, x)
                if drop is not None and so_far + drop < new.get((a, b), (math.inf,))[0]:
                    new[a, b] = so_far + drop, chain
            states = new
        _, chain = min((v + cost[a][b][0], chain) for (a, b), (v, chain) in [((s), (x[0], _Chain(x[1]))) for s, x in states.items()])
        return chain.text()


class _Chain:
    """Output characters from last to first; compared by text, so that ties are decided alike everywhere."""

    def __init__(self, link):
        self.link = link

    def text(self) -> str:
        out, link = [], self.link
        while link:
            link, c = link
            out.append(c)
        return "".join(reversed(out))

    def __lt__(self, other):
        return self.text() < other.text()


def bare(word: str) -> str:
    """A word in lower case without the signs around it."""
    return word if word.isascii() and word.isalpha() else word.lower().strip(EDGE)


def core(word: str, inner: str) -> str:
    """The inner part of a word, with a sign before it that may stand for a letter."""
    if not inner or word[0] == inner[0]:
        return inner
    at = word.lower().find(inner)
    return word[at - 1] + inner if at > 0 and word[at - 1] in SIGNS else inner


class Restored:
    """Restored words of a batch of texts: distinct words, and each text's words by number."""

    def __init__(self, texts: pa.Array, channel: Channel, lexicon: "Lexicon | None" = None):
        flat, ends = words(texts)
        codes, distinct = coded(flat)
        inner = [bare(w) for w in distinct]
        cores = [channel.restore(core(w, x)) for w, x in zip(distinct, inner)]
        number = {w: i for i, w in enumerate(dict.fromkeys(cores))}
        self.codes = np.fromiter((number[c] for c in cores), np.int64, len(cores))[codes] if cores else codes
        self.ends, self.spelled = ends, []
        for owner, run, word in self.runs(codes, distinct, inner):
            self.spelled.append((owner, number.setdefault(channel.restore(word), len(number)), run))
        for owner, run, word in lexicon.joined(self.codes, ends, list(number)) if lexicon else ():
            self.spelled.append((owner, number.setdefault(word, len(number)), run))
        self.distinct = list(number)

    def runs(self, codes: np.ndarray, distinct: list[str], inner: list[str]):
        """Single characters in a row, with separators between them or not: three or more may spell a word."""
        short = np.fromiter((len(x) <= 1 for x in inner), bool, len(inner))
        at = np.flatnonzero(short[codes]) if len(codes) else np.zeros(0, np.int64)
        if not len(at):
            return
        text_of = np.searchsorted(self.ends, at, "right") - 1
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(text_of) > 0)) + 1
        for run, owner in zip(np.split(at, cut), np.split(text_of, cut)):
            if len(run) >= 3:
                signs = (distinct[c].lower() if len(distinct[c]) == 1 else inner[c] for c in codes[run])
                word = "".join(w for w in signs if w.isalnum() or w in LOOKALIKES)
                if len(word) >= 3 and sum(c.isalpha() for c in word) >= 2:
                    yield int(owner[0]), run, word

    def texts(self) -> list[str]:
        spelled = {int(run[0]): (code, len(run)) for _, code, run in self.spelled}
        out = []
        for a, b in zip(self.ends, self.ends[1:]):
            i, found = a, []
            while i < b:
                code, n = spelled.get(int(i), (self.codes[i], 1))
                found.append(self.distinct[code])
                i += n
            out.append(" ".join(found))
        return out

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        return char_grams(self.distinct, SIZES, whole=True)

    def by_text(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The distinct words of each text, by number, and how often it has them."""
        spelled: dict[int, list[int]] = {}
        for text, code, _ in self.spelled:
            spelled.setdefault(text, []).append(code)
        parts = [self.codes[a:b] for a, b in zip(self.ends, self.ends[1:])]
        return [np.unique(np.append(p, spelled[i]).astype(np.int64) if i in spelled else p, return_counts=True) for i, p in enumerate(parts)]


class Lexicon:
    """Words of much evidence, by the polynomials of their bytes."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.some = np.zeros(1 << 16, bool)
        self.some[(mix(keys) >> np.uint64(48)).astype(np.int64)] = True

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = self.some[(mix(keys) >> np.uint64(48)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.keys[np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)] == keys[at]
        return out

    def joined(self, codes: np.ndarray, ends: np.ndarray, names: list[str]):
        """(text, places, word) of words side by side that together are one of these, as none of them is by itself."""
        if not len(self.keys) or len(codes) < 2:
            return
        own, size = polynomials(pa.array(names, pa.large_string())), np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in names), np.int64, len(names))
        alone = self.has(own)
        text_of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        key, length, free = own[codes], size[codes], ~alone[codes] & (size[codes] > 0)
        now, now_length, fits = key, length, free
        for n in (2, 3):
            now, now_length = put_together(now[:-1], key[n - 1 :], now_length[:-1]), now_length[:-1] + length[n - 1 :]
            fits = fits[:-1] & free[n - 1 :] & (text_of[: len(now)] == text_of[n - 1 :]) & (now_length <= JOINED_BYTES)
            for i in np.flatnonzero(fits & self.has(now)) if len(now) else ():
                yield int(text_of[i]), np.arange(i, i + n), "".join(names[codes[k]] for k in range(i, i + n))


class Odds:
    """Pieces whose log odds reach the first level: sorted hashes and values, behind a bit map that most pieces miss; and
    the lexicon of words of much evidence."""

    def __init__(self, pieces: np.ndarray, values: np.ndarray, lexicon: Lexicon):
        self.lexicon = lexicon
        by = np.argsort(pieces)
        self.pieces, self.values = pieces[by], np.append(values[by], 0.0)
        self.some = np.zeros(1 << 20, bool)
        self.some[(pieces >> np.uint64(44)).astype(np.int64)] = True

    def of(self, pieces: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pieces))
        if len(self.pieces):
            at = np.flatnonzero(self.some[(pieces >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.pieces, pieces[at]), len(self.pieces) - 1)
            out[at] = np.where(self.pieces[place] == pieces[at], self.values[place], 0.0)
        return out


def look_at(texts: pa.Array, channel: Channel, odds: Odds) -> np.ndarray:
    """The evidence of each text, a few texts at a time."""
    found = [evidence(Restored(part, channel, odds.lexicon), odds) for part in row_slices(texts)]
    return np.concatenate([np.zeros((0, FEATURES)), *found])


def evidence(restored: Restored, odds: Odds) -> np.ndarray:
    """For each text: the three largest evidences of its distinct words; the log of 1 + its distinct words, and its
    share of words, at each level; and the log of 1 + all words."""
    out = np.zeros((len(restored.ends) - 1, FEATURES))
    if not restored.distinct:
        return out
    value = best_piece(restored.distinct, SIZES, odds.of)
    total = np.diff(restored.ends)
    for i, (mine, times) in enumerate(restored.by_text()):
        found, times = value[mine], times[value[mine] >= LEVELS[0]]
        found = found[found >= LEVELS[0]]
        top = np.sort(found)[::-1][:3]
        out[i, : len(top)] = top
        level = np.searchsorted(LEVELS, found, "right") - 1
        out[i, 3 : 3 + len(LEVELS)] = np.log1p(np.bincount(level, minlength=len(LEVELS)))
        out[i, 3 + len(LEVELS) : -1] = np.log1p(100 * np.bincount(level, times, len(LEVELS)) / (total[i] + SPARE_WORDS))
    out[:, -1] = np.log1p(total)
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """From sums of shares of words over the texts of either kind."""
    part, spare = n_toxic / max(1, n_toxic + n_clean), SMOOTH * SPARE_SHARE
    if not 0 < part < 1:
        return np.zeros(len(toxic))
    return np.log((toxic + spare * part) / n_toxic) - np.log((clean + spare * (1 - part)) / n_clean)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> dict:
    """The model: trigram cube, log odds of notable pieces (seen in two toxic texts at least), and the regression."""
    cube = letter_counts(docs)
    chosen = sampled(labels.withColumn("held", fold(F.col("doc_id")) == 0), "toxic", max_rows, "not held")
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("text", (F.col("label") + 2 * F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))).cast("int").alias("kind"))

    def count(batches):
        channel = Channel(cube)
        for batch in batches:
            yield from (x for a, part in starts(batch.column(0)) for x in counted(Restored(part, channel), np.asarray(batch.column(1))[a : a + len(part)]))

    def starts(texts):
        a = 0
        for part in row_slices(texts):
            yield a, part
            a += len(part)

    def counted(restored, kinds):
        at, ends = restored.pieces()
        whole = polynomials(pa.array(restored.distinct, pa.large_string()))
        total = np.diff(restored.ends)
        found = {(what, kind): [] for what in (PIECE, WORD) for kind in range(4)}
        for i, (mine, times) in enumerate(restored.by_text()):
            share = times / (total[i] + SPARE_WORDS)
            found[WORD, kinds[i]].append((whole[mine], share))
            if len(mine):
                pieces, of = np.unique(np.concatenate([at[ends[c] : ends[c + 1]] for c in mine]), return_inverse=True)
                found[PIECE, kinds[i]].append((pieces, np.bincount(of, np.repeat(share, ends[mine + 1] - ends[mine]), len(pieces))))
        for (what, kind), parts in found.items():
            keys, of = np.unique(np.concatenate([at[:0].astype(np.uint64), *(p[0] for p in parts)]), return_inverse=True)
            shares = np.bincount(of, np.concatenate([np.zeros(0), *(p[1] for p in parts)]), len(keys))
            cols = [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), kind, np.int32)), pa.array(np.bincount(of, minlength=len(keys))), pa.array(np.rint(shares / UNIT).astype(np.int64)), pa.array(np.full(len(keys), what, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "kind", "n", "share", "what"])
        texts = np.bincount(kinds, minlength=4)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(4, np.int64)), pa.array(np.arange(4, dtype=np.int32)), pa.array(texts), pa.array(texts), pa.array(np.full(4, TEXTS, np.int32))], ["key", "kind", "n", "share", "what"])

    rows_of = rows.mapInArrow(count, "key long, kind int, n long, share long, what int")
    toxic_texts = F.sum(F.when(F.col("kind") % 2 == 1, F.col("n")).otherwise(0))
    by_key = rows_of.groupBy("what", "key").agg(toxic_texts.alias("n"), *(F.sum(F.when(F.col("kind") == k, F.col("share")).otherwise(0)).alias(f"s{k}") for k in range(4)))
    got = by_key.filter(f"what = {TEXTS} or n >= 2").toArrow()
    what, keys = np.asarray(got["what"]), np.asarray(got["key"]).view(np.uint64)
    table = np.stack([np.asarray(got[f"s{k}"]).astype(float) for k in range(4)])
    n = table[:, what == TEXTS].sum(axis=1)
    table *= UNIT

    def odds_of(toxic, clean):
        value = log_odds(sum(table[k] for k in toxic), sum(table[k] for k in clean), sum(n[k] for k in toxic), sum(n[k] for k in clean))
        keep = (what == PIECE) & (value >= LEVELS[0])
        return Odds(keys[keep], value[keep], Lexicon(keys[(what == WORD) & (value >= JOINED_FROM)]))

    halves = [odds_of([1], [0]), odds_of([3], [2])]

    def look(batches):
        channel = Channel(cube)
        for batch in batches:
            kinds = np.asarray(batch.column(1))
            by_half = [look_at(batch.column(0), channel, h) for h in halves]  # each half is weighed by the other half's counts
            found = np.where((kinds < 2)[:, None], by_half[1], by_half[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k]) for k in range(FEATURES)), pa.array(kinds % 2)], [*names, "y"])

    names = [f"x{k}" for k in range(FEATURES)]
    seen = rows.mapInArrow(look, ", ".join(f"{n} double" for n in names) + ", y int").toArrow()
    x = np.stack([np.asarray(seen[c]) for c in names], axis=1) if seen.num_rows else np.zeros((0, FEATURES))
    y = np.asarray(seen["y"]).astype(float) if seen.num_rows else np.zeros(0)
    order = np.lexsort((*x.T, y))
    weights = regression(x[order], y[order])
    return {"cube": cube, "odds": odds_of([1, 3], [0, 2]), "weights": weights}


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> list[float]:
    if not len(y) or y.min() == y.max():
        return [0.0] * FEATURES + [-30.0 if not len(y) or y[0] == 0 else 30.0]
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(FEATURES + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * np.append(w[:-1], 0)
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([ridge] * FEATURES + [1e-6])
        step = np.linalg.solve(hess, g)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    slope, offset = calibrate(z @ w, y)
    return [*(slope * w[:-1]), slope * w[-1] + offset]


def score(docs: DataFrame, model: dict, with_text: bool = False) -> DataFrame:
    """doc_id, score (0 to 1) and, if asked for, the restored text of every row."""

    def run(batches):
        give_back()
        channel, weights = Channel(model["cube"]), np.array(model["weights"])
        for batch in batches:
            margin = look_at(batch.column(1), channel, model["odds"]) @ weights[:-1] + weights[-1]
            cols = [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array([t for part in row_slices(batch.column(1)) for t in Restored(part, channel, model["odds"].lexicon).texts()], pa.string())] if with_text else []), ["doc_id", "score", "restored"][: 2 + with_text])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, score double" + (", restored string" if with_text else ""))


def predictions(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    found = score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: dict, reject_at: float = 0.5) -> DataFrame:
    """The rows of docs, with their columns, whose score is under reject_at. The texts are scored where they stand: the
    decision travels with the row, so that repeated and null ids need no join."""
    names = docs.columns

    def run(batches):
        give_back()
        channel, weights = Channel(model["cube"]), np.array(model["weights"])
        for batch in batches:
            margin = look_at(batch.column("text").cast(pa.string()), channel, model["odds"]) @ weights[:-1] + weights[-1]
            keep = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) < reject_at
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names], names).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
