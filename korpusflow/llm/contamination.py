"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages (windows) of words. Document frequencies of hashed terms are counted over all passages; a
randomised SVD of the TF-IDF matrix (two passes of A'(A X), summed over tasks) is fitted on all of them and gives every
term a latent vector, scaled so that all directions weigh the same. Benchmark
items are the stated query set: in blocks of bounded size they meet every window of every text, in the task that holds
the text. Candidates are the windows that are near by cosine, and those around a place where the item's answer stands word
for word. They are checked on words: the longest common subsequence of the item and the text around the window must hold
`verbatim` of the item's words, or `paraphrase` of them together with its answer. Windows with too few of the item's words
around them in any order go before all else; as that is an upper bound, no match is lost by it.

Window lengths follow the items: a window of L words every L/2 words has a whole window inside any copied item of 1.5 L
words or more; the item is asked at every L/4 words and at its end, so that an aligned pair differs in L/8 words at most,
whatever part of the item is copied.

Cases: null and empty texts and items match nothing; items of any length above are searched, with shorter windows for
short ones; an item without an answer column has its last ANSWER_WORDS words as answer; a null answer counts as given by
the text; rows that repeat are reported alike, each with the best place for each item (ties: the first place); a null
doc_id is reported as null; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import discard, give_back, materialize, mix, token_hashes, words

TERM_BITS = 15
RANK = 32
SPARE = 8
#: Tasks of a product for each core.
FIT_TASKS = 2
#: Passages that a product takes at once.
FIT_ROWS = 1 << 14
BLOCK_ITEMS = 2000
LENGTHS = (16, 8, 4, 2, 1)
ANSWER_WORDS = 5
#: Size of the bit map that words of texts meet before the items' words are searched.
MAP_BITS = 20
#: Half of what a window shares on average with an item that it matches by the weaker rule.
CANDIDATE_COSINE = 0.3
VERBATIM, PARAPHRASE = 0.8, 0.6
#: The share of an item that its frequent words may make up when the others alone choose the rows to look at.
COMMON = 0.4
#: Words that the bound gathers at once.
BOUND_WORDS = 1 << 21
FOUND = "doc_id long, item_id long, similarity double, common_words int, item_words int, start_word long, has_answer boolean"


def terms_of(hashed: np.ndarray) -> np.ndarray:
    return (mix(hashed) >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def in_steps(of_token: np.ndarray, ends: np.ndarray, step: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's tokens in rows of `step`, filled up with `pad`, and where each text's rows begin and end."""
    sizes = np.diff(ends)
    rows = np.concatenate([[0], np.cumsum(-(-sizes // step))])
    out = np.full(rows[-1] * step, pad, of_token.dtype)
    text = np.repeat(np.arange(len(sizes)), sizes)
    out[rows[text] * step + np.arange(len(of_token)) - ends[text]] = of_token
    return out.reshape(-1, step), rows


def term_table(docs: DataFrame) -> DataFrame:
    """A row for each text with the hashed terms of all its words, two bytes each: words are told apart and hashed once
    for all passes of a fit."""

    def run(batches):
        give_back()
        for batch in batches:
            flat, ends = words(batch.column(0))
            terms = terms_of(token_hashes(flat)).astype(np.uint16)
            column = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(terms)])
            yield pa.RecordBatch.from_arrays([column], ["terms"])

    return materialize(docs.select(F.col("text").cast("string")).mapInArrow(run, "terms binary"), "lsa-terms")


def read_once(texts: DataFrame) -> DataFrame:
    """The column that passages() reads: terms, or else texts."""
    return texts.select("terms") if "terms" in texts.columns else texts.select(F.col("text").cast("string"))


def passages(column: pa.Array, length: int) -> np.ndarray:
    """The terms of all passages of a batch of texts, or of their terms, a row each; the last rows of texts are filled up."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        _, ends, data = column.cast(pa.large_binary()).buffers()
        ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] // 2 if len(column) else np.zeros(1, np.int64)
        terms = np.frombuffer(data, np.uint16)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint16)
        ends = ends - ends[0]
    else:
        flat, ends = words(column)
        terms = terms_of(token_hashes(flat)).astype(np.uint16)
    return in_steps(terms, ends, length, 1 << TERM_BITS)[0]


def document_frequencies(docs: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """In how many passages each hashed term occurs, and how many passages there are: over all texts."""
    size = 1 << TERM_BITS

    def run(batches):
        give_back()
        total, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            rows = np.sort(passages(batch.column(0), length), axis=1)
            first = np.ones(rows.shape, bool)
            first[:, 1:] = rows[:, 1:] != rows[:, :-1]
            total += np.bincount(rows[first], minlength=size + 1)
            n += len(rows)
        total[size] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    got = read_once(docs).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size + 1, np.int64)
    total[np.asarray(got["at"])] = np.asarray(got["n"])
    return total[:size], int(total[size])


def normal_product(texts: DataFrame, idf: np.ndarray, x: np.ndarray, length: int) -> np.ndarray:
    """A'(A x) for the TF-IDF matrix A of all passages: each task sums its own, blocks of rows are added up. A task sends
    one sum however many texts it reads, so there are FIT_TASKS tasks for each core, and what is sent does not grow."""
    size, block = 1 << TERM_BITS, 1 << 10
    weighted = np.vstack([idf[:, None] * x, np.zeros((1, x.shape[1]))]).astype(np.float32)

    def run(batches):
        give_back()
        total = np.zeros((x.shape[1], size + 1))
        for batch in batches:
            rows = passages(batch.column(0), length)
            for a in range(0, len(rows), FIT_ROWS):
                part = rows[a : a + FIT_ROWS]
                y = np.concatenate([weighted[part[b : b + 1024]].sum(axis=1) for b in range(0, len(part), 1024)]).T.astype(np.float64)
                terms = part.ravel().astype(np.intp)
                for k, column in enumerate(y):  # a column's sums by term stay in the cache
                    total[k] += np.bincount(terms, np.repeat(column, length), size + 1)
        total = total.T
        for k in range(size // block):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total[k * block : (k + 1) * block].astype(np.float32).tobytes()], pa.binary())], ["block", "part"])

    def add(key, table):
        total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in table["part"].to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()]), "part": pa.array([total.tobytes()], pa.binary())})

    tasks = FIT_TASKS * texts.sparkSession.sparkContext.defaultParallelism
    got = read_once(texts).coalesce(tasks).mapInArrow(run, "block long, part binary").groupBy("block").applyInArrow(add, "block long, part binary").toArrow()
    out = np.zeros((size, x.shape[1]))
    for k, part in zip(got["block"].to_pylist(), got["part"].to_pylist()):
        out[k * block : (k + 1) * block] = np.frombuffer(part).reshape(block, -1)
    return idf[:, None] * out


def latent_terms(docs: DataFrame, benchmark: DataFrame, length: int = LENGTHS[0], rank: int = RANK) -> np.ndarray:
    """A latent vector for each hashed term, from all passages of all texts (the last row, for padding, is zero)."""
    texts = term_table(docs)
    df, n = document_frequencies(texts, length)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)), 0.0) if n else np.zeros(1 << TERM_BITS)
    rng = np.random.default_rng(7)
    x = np.linalg.qr(normal_product(texts, idf, rng.standard_normal((1 << TERM_BITS, rank + SPARE)), length))[0]
    y = normal_product(texts, idf, x, length)
    discard(texts)
    values, vectors = np.linalg.eigh((x.T @ y + y.T @ x) / 2)
    best = np.argsort(values)[::-1][:rank]
    scale = np.sqrt(np.maximum(values[best], 1e-12 * max(1.0, values.max(initial=0))))
    latent = idf[:, None] * (x @ vectors[:, best]) / scale
    return np.vstack([latent, np.zeros((1, rank))]).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return token_hashes(pa.array(found, pa.large_binary()).cast(pa.large_string(), safe=False))


def window_length(n: int) -> int:
    return next(x for x in LENGTHS if n >= x + max(1, x // 2) - 1 or x == 1)


class Asked:
    """A block of benchmark items: latent vectors of their windows by window length, and what the word checks need."""

    def __init__(self, items: list[tuple], latent: np.ndarray):
        self.ids, self.words, self.answers, self.masks = [], [], [], []
        hashes, answer_hashes = [], []
        by_length: dict[int, list] = {}
        for item_id, text, answer in items:
            found = item_words(text)
            if not found:
                continue
            length, number = window_length(len(found)), len(self.ids)
            self.ids.append(item_id)
            self.words.append(found)
            self.answers.append(found[-ANSWER_WORDS:] if answer is False else item_words(answer))
            mask: dict[bytes, int] = {}
            for i, w in enumerate(found):
                mask[w] = mask.get(w, 0) | 1 << i
            self.masks.append(mask)
            hashes.append(word_hashes(found))
            answer_hashes.append(word_hashes(self.answers[-1]))
            vectors = latent[terms_of(hashes[-1])]
            steps = np.arange(0, len(found) - length + 1, max(1, length // 4))
            places = np.unique(np.append(steps, len(found) - length))
            by_length.setdefault(length, []).extend((number, vectors[p : p + length].sum(axis=0)) for p in places)
        self.lengths = {k: (np.array([n for n, _ in v]), unit(np.array([x for _, x in v])).T.copy()) for k, v in by_length.items()}
        # The items' distinct words are numbered; most words of a text have no number, as a bit map tells at once.
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes, *answer_hashes]))
        self.some = np.zeros(1 << MAP_BITS, bool)
        self.some[self.known >> np.uint64(64 - MAP_BITS)] = True
        self.own, self.answer = [self.numbers(h) for h in hashes], [self.numbers(h) for h in answer_hashes]

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        """The number of each word among those of the items, len(known) for all others."""
        out = np.full(len(hashed), len(self.known), np.int32)
        at = np.flatnonzero(self.some[hashed >> np.uint64(64 - MAP_BITS)])
        place = np.minimum(np.searchsorted(self.known, hashed[at]), max(0, len(self.known) - 1))
        hit = self.known[place] == hashed[at]
        out[at[hit]] = place[hit]
        return out

    def cosine(self, item: int, latent: np.ndarray, hashed: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
        """The largest cosine of each text window from `start`, inside the text that ends at `end`, with the item's windows."""
        numbers, asked = self.lengths[length]
        a, b = np.searchsorted(numbers, [item, item + 1])
        inside = start[:, None] + np.arange(length)
        tokens = np.where(inside < end[:, None], terms_of(hashed[np.minimum(inside, len(hashed) - 1)]), len(latent) - 1)
        return (unit(latent[tokens].sum(axis=1)) @ asked[:, a:b]).max(axis=1, initial=-1.0)

    def common(self, item: int, segment: list[bytes]) -> int:
        """Length of the longest common subsequence, with the item's words as bits of one number."""
        mask, full = self.masks[item], (1 << len(self.words[item])) - 1
        v = full
        for w in segment:
            m = mask.get(w, 0)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return len(self.words[item]) - v.bit_count()


def holds(segment: list[bytes], answer: list[bytes]) -> bool:
    n = len(answer)
    return not n or any(segment[i] == answer[0] and segment[i : i + n] == answer for i in range(len(segment) - n + 1))


def bit_tables(known: np.ndarray, none: int) -> list[np.ndarray]:
    """A bit for each known word number, 64 to a table."""
    tables = []
    for k in range(0, len(known), 64):
        table = np.zeros(none + 1, np.uint64)
        table[known[k : k + 64]] = np.uint64(1) << np.arange(len(known[k : k + 64]), dtype=np.uint64)
        tables.append(table)
    return tables


class Places:
    """Where a batch's texts have words of the items: by word number, the rows (of `step` words each) that hold it."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, none: int, steps: set[int]):
        at = np.flatnonzero(codes < none)
        at = at[np.argsort(codes[at], kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes[at], minlength=none))])
        text = np.searchsorted(ends, at, "right") - 1
        self.rows, self.bounds = {}, {}
        for step in steps:
            self.bounds[step] = np.concatenate([[0], np.cumsum(-(-np.diff(ends) // step))])
            self.rows[step] = self.bounds[step][text] + (at - ends[text]) // step

    def near(self, own: np.ndarray, step: int, n: int, paraphrase: float) -> np.ndarray:
        """Rows with enough words of the item from n words before them to 2 n words after their begin. The item's most
        frequent words, COMMON of it at most, count as found everywhere; of the others each place counts."""
        wanted, many = np.unique(own[own >= 0], return_counts=True)
        if many.sum() < paraphrase * n:
            return np.zeros(0, np.int64)
        often = np.argsort(self.starts[wanted] - self.starts[wanted + 1], kind="stable")
        given = np.cumsum(many[often])
        first = int(np.searchsorted(given, COMMON * n, "right"))
        needed = paraphrase * n - (given[first - 1] if first else 0)
        rare = often[first:]
        of_word = [self.rows[step][self.starts[w] : self.starts[w + 1]] for w in wanted[rare]]
        weights = np.repeat(many[rare], [len(x) for x in of_word])
        rows, before, after = int(self.bounds[step][-1]), -(-n // step), -(-2 * n // step)
        total = np.zeros(before + rows + after)
        total[before : before + rows] = np.bincount(np.concatenate(of_word), weights, rows) if of_word else 0
        total = np.concatenate([[0], np.cumsum(total)])
        return np.flatnonzero(total[before + after : before + after + rows] - total[:rows] >= needed - 1e-9)


def may_match(own: np.ndarray, answer: np.ndarray, padded: np.ndarray, first: np.ndarray, last: np.ndarray, p: np.ndarray, verbatim: float, paraphrase: float) -> np.ndarray:
    """Whether the text around each window has enough of the item's words in any order, and for the weaker rule all words
    of the answer: what every match fulfils. `own` and `answer` are word numbers, -1 for words that no text has."""
    n, none = len(own), len(padded) - 1
    wanted, many = np.unique(own[own >= 0], return_counts=True)
    low, high = first + np.maximum(0, p - n), np.minimum(last, first + p + 2 * n)
    if (answer < 0).any():
        paraphrase = verbatim
    known = np.union1d(wanted, answer[answer >= 0])
    weight = np.zeros(len(known), np.int64)
    weight[np.searchsorted(known, wanted)] = many
    needed = np.isin(known, answer)
    keep = np.zeros(len(p), bool)
    tables = bit_tables(known, int(padded[none]))
    rows = max(1, BOUND_WORDS // (3 * n))
    for a in range(0, len(p), rows):
        at = low[a : a + rows, None] + np.arange(3 * n)
        words_at = padded[np.where(at < high[a : a + rows, None], at, none)]
        common, answered = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for k, table in enumerate(tables):
            bits = np.bitwise_or.reduce(table[words_at], axis=1)
            part = slice(64 * k, 64 * k + 64)
            has = (bits[:, None] >> np.arange(len(weight[part]), dtype=np.uint64)) & np.uint64(1) > 0
            common += has @ weight[part]
            answered &= has[:, needed[part]].all(axis=1)
        keep[a : a + rows] = (common >= verbatim * n) | (common >= paraphrase * n) & answered
    return keep


def matches(asked: Asked, latent: np.ndarray, texts: pa.Array, least: float, verbatim: float, paraphrase: float) -> list[tuple]:
    """(text, item, share, common words, first word, has answer) of each confirmed pair."""
    flat, ends = words(texts)
    if not len(flat) or not asked.lengths:
        return []
    hashed, none = token_hashes(flat), len(asked.known)
    codes = asked.numbers(hashed)
    present = np.bincount(codes, minlength=none + 1)[: none + 1] > 0

    def numbers(of_item: np.ndarray) -> np.ndarray:
        return np.where(present[of_item], of_item, -1)

    out, padded = [], np.append(codes, none)
    places = Places(codes, ends, none, {max(1, length // 2) for length in asked.lengths})
    for item, words_of in enumerate(asked.words):
        n, length, answer = len(words_of), window_length(len(words_of)), asked.answers[item]
        own, step = numbers(asked.own[item]), max(1, length // 2)
        row = places.near(own, step, n, min(verbatim, paraphrase))
        text = np.searchsorted(places.bounds[step], row, "right") - 1
        p = (row - places.bounds[step][text]) * step
        some = may_match(own, numbers(asked.answer[item]), padded, ends[text], ends[text + 1], p, verbatim, paraphrase)
        text, p = text[some], p[some]
        near = asked.cosine(item, latent, hashed, ends[text] + p, ends[text + 1], length) >= least
        done = {}
        for text, p, near in zip(text.tolist(), p.tolist(), near.tolist()):
            first, last = ends[text], ends[text + 1]
            low, high = max(0, p - n), min(last - first, p + 2 * n)  # a copy that holds the window lies in between
            segment = flat.slice(first + low, high - low).cast(pa.large_binary()).to_pylist()
            answered = holds(segment, answer)
            if not near and not (answer and answered):
                continue
            both = asked.common(item, segment)
            if (both >= verbatim * n or both >= paraphrase * n and answered) and (text not in done or both > done[text][0]):
                done[text] = both, int(low), answered
        out += [(text, item, both / n, both, low, answered) for text, (both, low, answered) in done.items()]
    return out


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """item_id, text, answer in blocks of about BLOCK_ITEMS rows: each is all that is held at once."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.alias("answer"))
    n = max(1, math.ceil(items.count() / BLOCK_ITEMS))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def asked_items(block: DataFrame, given: bool) -> list[tuple]:
    return sorted(((r["item_id"], r["text"], r["answer"] if given else False) for r in block.toArrow().to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = CANDIDATE_COSINE, verbatim: float = VERBATIM, paraphrase: float = PARAPHRASE) -> DataFrame:
    """doc_id, item_id, similarity (share of the item's words in common order), common_words, item_words, start_word,
    has_answer: a row for each text and item that it holds."""
    latent = latent_terms(docs, benchmark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def search(items):
        def run(batches):
            give_back()
            asked = Asked(items, latent)
            for batch in batches:
                found = matches(asked, latent, batch.column(1), least, verbatim, paraphrase)
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                cols = [ids, pa.array([asked.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int32()), pa.array([len(asked.words[f[1]]) for f in found], pa.int32()), pa.array([int(f[4]) for f in found], pa.int64()), pa.array([f[5] for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "similarity", "common_words", "item_words", "start_word", "has_answer"])

        return texts.mapInArrow(run, FOUND)

    out = None
    for block in item_blocks(benchmark):
        part = search(asked_items(block, "answer" in benchmark.columns))
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = CANDIDATE_COSINE, verbatim: float = VERBATIM, paraphrase: float = PARAPHRASE) -> DataFrame:
    """The rows of docs, with their columns, that hold no benchmark item: decided where the text stands, without a join."""
    latent = latent_terms(docs, benchmark)
    names, out = docs.columns, docs

    def keep(items):
        def run(batches):
            give_back()
            asked = Asked(items, latent)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in matches(asked, latent, batch.column("text"), least, verbatim, paraphrase)]] = False
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names], names).filter(pa.array(clean))

        return run

    for block in item_blocks(benchmark):
        out = out.mapInArrow(keep(asked_items(block, "answer" in benchmark.columns)), docs.schema)
    return out
