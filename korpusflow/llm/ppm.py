"""Language-model scoring by prediction by partial matching, beside a unigram base score.

One pass over the training texts counts words (by 64-bit hash) and the bytes that follow each context of ORDER bytes.
Counts of shorter contexts are sums of those of longer ones, so the byte trie is a table of contexts per order in the
shared folder. A byte's probability is its share in the longest known context; otherwise the context's escape (method C:
distinct symbols over symbols seen plus distinct) leads to the next shorter one, where the symbols already refused are
excluded. Texts are scored as their lower-case words joined by single spaces, with one end byte.

Nothing is pruned: a text's bytes whose contexts are among the HOT_NODES most frequent are scored where the text is, by a
table of ready costs; all others are collected as (text, context and byte, count) rows and joined with their costs, which
joins with the tables of contexts give, from the longest down. Words are treated alike (TOP_WORDS and a join). So the two
numbers move work between the table and the join, and never change a score.

Cases: a null text counts as empty and has the end token only; a null doc_id belongs to the fold of an empty id; rows
that repeat are each scored (and, in training folds, each counted); a very long text is scored in slices of its bytes;
equal counts at a bound of the tables are split by hash; without training texts bytes are uniform and the base score is 0;
other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import discard, fold, hot_keys, materialize, spread_join, token_hashes, words

ORDER = 5
HELD_FOLD = 1
HOT_NODES = 2_000_000
TOP_WORDS = 400_000
#: Into how many parts contexts of two and three bytes are dealt: some are the end of many longer ones.
SPREAD = {2: 16, 3: 4}
GATHERED = 500_000
#: Canonical bytes that are turned into numbers at once (a longer text alone goes on its own), and numbers scored at once.
SLICE_BYTES, SCORED = 1 << 19, 1 << 17
END = b"\n"
WORD, GRAM, TEXTS = 0, 1, 2


def canonical(text: str | None) -> bytes:
    """The bytes that are scored: lower-case words, single spaces, one end."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + END


def gram_codes(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each canonical text its `order` predecessors and itself as one number (ends stand before a
    text's start), and where each text's bytes begin and end."""
    found = [canonical(t) for t in texts]
    pad = END * order
    raw = np.frombuffer(pad + pad.join(found), np.uint8).astype(np.uint64) if found else np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    code = np.zeros(max(0, len(raw) - order), np.uint64)
    for k in range(order + 1):
        code = (code << np.uint64(8)) | raw[k : k + len(code)]
    own = np.arange(ends[-1]) + np.repeat(np.arange(len(found)) * order, sizes)
    return code[own], ends


def in_slices(texts: pa.Array, order: int):
    """gram_codes of a few texts at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "") + 1
        if size >= SLICE_BYTES:
            yield gram_codes(held, order)
            held, size = [], 0
    if held:
        yield gram_codes(held, order)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts[:0]


class Tally:
    """Counts by number, merged as they come; gives them out when there are many."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > 2 * GATHERED:
            self.merge()

    def merge(self):
        if self.parts:
            self.parts = [added(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.held = len(self.parts[0][0])

    def full(self) -> bool:
        return self.held > GATHERED

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.held = [], 0
        return out


def corpus_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """kind, key, n: word counts by hash, byte contexts of full order with the byte that follows, and the texts."""
    training = docs.filter(fold(F.col("doc_id")) != HELD_FOLD).select(F.col("text").cast("string"))

    def run(batches):
        tallies, texts = {WORD: Tally(), GRAM: Tally()}, 0

        def rows(kind):
            keys, n = tallies[kind].take()
            for a in range(0, len(keys), 1 << 18):
                part = keys[a : a + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[a : a + (1 << 18)])], ["kind", "key", "n"])

        for batch in batches:
            texts += batch.num_rows
            tallies[WORD].add(*np.unique(token_hashes(words(batch.column(0))[0]), return_counts=True))
            for grams, _ in in_slices(batch.column(0), order):
                grams.sort()
                starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
                tallies[GRAM].add(grams[starts], np.diff(np.append(starts, len(grams))))
            for kind in (WORD, GRAM):
                if tallies[kind].full():
                    tallies[kind].merge()
                    if tallies[kind].full():
                        yield from rows(kind)
        yield from rows(WORD)
        yield from rows(GRAM)
        yield pa.RecordBatch.from_arrays([pa.array([TEXTS], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], ["kind", "key", "n"])

    return training.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, at_most: int) -> DataFrame:
    """About at_most rows with the largest counts: whole levels of them (four to a doubling), and of the level that does
    not fit a share by hash."""
    level = F.floor(4 * F.log2("n")).cast("int")
    histogram = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    left, least, share = at_most, 0, 0
    for least, n in histogram:
        share = min(1000, 1000 * left // n)
        if share < 1000:
            break
        left -= n
    return counts.filter((level > least) | ((level == least) & (F.pmod(F.xxhash64("key"), F.lit(1000)) < share)))


def context_tables(counts: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """For each order from 0 the contexts of so many bytes: context, total and distinct of what follows, symbols (a count
    for each byte, 256 at most), and what is left in the next shorter context when these symbols are excluded from it."""
    grams, tables, scratch = counts.filter(F.col("kind") == GRAM).select(F.col("key").alias("code"), "n"), [], []
    for k in range(order, -1, -1):
        if k < order:
            grams = grams.groupBy(F.col("code").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("code")).agg(F.sum("n").alias("n"))
            grams = materialize(grams, f"ppm-nodes-{k}")
            scratch.append(grams)
        entry = F.struct(F.col("code").bitwiseAND(255).cast("int").alias("symbol"), "n")
        found = grams.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.map_from_entries(F.collect_list(entry)).alias("symbols"))
        tables.insert(0, materialize(found, f"ppm-order-{k}"))
    discard(*scratch)
    out = [tables[0].withColumns({"left": F.lit(0).cast("long"), "left_distinct": F.lit(0).cast("long")})]
    for k in range(1, order + 1):
        below = tables[k - 1].select(F.col("context").alias("suffix"), F.col("total").alias("t"), F.col("distinct").alias("d"), F.col("symbols").alias("s"))
        own = tables[k].withColumn("suffix", F.col("context").bitwiseAND((1 << 8 * (k - 1)) - 1))
        refused = F.aggregate(F.map_keys("symbols"), F.lit(0).cast("long"), lambda a, x: a + F.col("s")[x])
        joined = (own.crossJoin(F.broadcast(below.drop("suffix"))) if k == 1 else own.join(below, "suffix")).withColumns({"left": F.col("t") - refused, "left_distinct": F.col("d") - F.col("distinct")})
        out.append(materialize(joined.select(*tables[k].columns, "left", "left_distinct"), f"ppm-contexts-{k}"))
    discard(*tables[1:])
    return out


def known_costs(top: DataFrame) -> DataFrame:
    """key (context and byte), n and cost (log10 of the probability) of all that was seen at full order."""
    each = top.select("context", "total", "distinct", F.explode("symbols").alias("symbol", "n"))
    return each.select((F.shiftleft("context", 8) + F.col("symbol")).alias("key"), "n", F.log10(F.col("n") / (F.col("total") + F.col("distinct"))).alias("cost"))


def escaped_costs(codes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """key and cost of codes that were not seen at full order: joins with the contexts, one byte shorter each time."""
    none = F.lit(None).cast("long")
    now = codes.select("key", F.lit(0.0).alias("cost"), F.lit(False).alias("done"), none.alias("rest"), none.alias("rest_distinct"))
    root = tables[0].first()
    for k in range(len(tables) - 1, 0, -1):
        parts = SPREAD.get(k, 1)
        level = tables[k].withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        level = F.broadcast(level) if k == 1 else level  # 256 contexts at most
        asked = now.withColumn("context", F.shiftright(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1), 8)).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        joined = asked.join(level, ["context", "part"], "left").withColumn("seen", F.col("symbols")[F.col("key").bitwiseAND(255).cast("int")])
        now = _step(joined, F.col("total"), F.col("distinct"), F.col("seen"), F.col("left"), F.col("left_distinct"))
    if root is not None:
        symbols = F.create_map(*(F.lit(x) for pair in root["symbols"].items() for x in pair))
        now = _step(now.withColumn("seen", symbols[F.col("key").bitwiseAND(255).cast("int")]), F.lit(root["total"]), F.lit(root["distinct"]), F.col("seen"), none, none)
    rest = max(1, 256 - (root["distinct"] if root is not None else 0))
    return now.select("key", F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") - F.log10(F.lit(float(rest)))).alias("cost"))


def _step(rows: DataFrame, total, distinct, seen, left, left_distinct) -> DataFrame:
    """One order further down: where symbols are refused, only what is left of the context counts."""
    many = F.coalesce("rest_distinct", distinct, F.lit(0))
    weight = F.coalesce("rest", total, F.lit(0)) + many
    hit = seen.isNotNull() & (weight > 0)
    more = F.when(hit, F.log10(seen / weight)).when((many > 0) & (weight > 0), F.log10(many / weight)).otherwise(0.0)
    cost = F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") + more)
    return rows.select("key", cost.alias("cost"), (F.col("done") | hit).alias("done"), left.alias("rest"), left_distinct.alias("rest_distinct"))


class Hash:
    """Open-addressed table from 64-bit codes to their place in a list."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(codes)) * 2))))
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.place = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(codes)), self.slots(codes)
        while len(left):
            free = self.place[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.place[slot[first]] = codes[left[first]], left[first]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def slots(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        slot = self.slots(codes)
        out = np.where(self.keys[slot] == codes, self.place[slot], -2)
        out[(out == -2) & (self.place[slot] < 0)] = -1
        left = np.flatnonzero(out == -2)
        at = slot[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            place = self.place[at]
            hit = self.keys[at] == codes[left]
            out[left[hit & (place >= 0)]] = place[hit & (place >= 0)]
            out[left[place < 0]] = -1
            stay = (place >= 0) & ~hit
            left, at = left[stay], at[stay]
        return out


def shared_costs(df: DataFrame):
    """A table of (key, cost) of bounded size (HOT_NODES or TOP_WORDS rows of 16 bytes), for all workers: read by Spark, so
    it may lie wherever Spark can read, and broadcast as two arrays."""
    table = df.select("key", "cost").toArrow()
    return df.sparkSession.sparkContext.broadcast((np.asarray(table["key"]).view(np.uint64), np.append(np.asarray(table["cost"]), 0.0)))


@lru_cache(maxsize=2)
def load_costs(shared) -> tuple[Hash, np.ndarray]:
    """Places of codes, and costs by place (0 at the end, for codes it lacks); made once for each worker."""
    keys, costs = shared.value
    return Hash(keys), costs


def in_lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))


def score(docs: DataFrame, order: int = ORDER, hot_nodes: int = HOT_NODES, top_words: int = TOP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    counts = materialize(corpus_counts(docs, order), "lm-counts")
    vocabulary = counts.filter(F.col("kind") == WORD).select("key", "n")
    facts = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n_words, distinct = next(((r["n"], r["v"]) for r in facts if r["kind"] == WORD), (0, 0))
    texts = next((r["n"] for r in facts if r["kind"] == TEXTS), 0)
    total, types = n_words + texts, distinct + (texts > 0)
    weight = total + 0.5 * (types + 1)
    word_cost = lambda n: F.log10((F.coalesce(n, F.lit(0)) + 0.5) / F.lit(float(weight)))

    tables = context_tables(counts, order)
    known = known_costs(tables[-1])
    ready = shared_costs(most_frequent(known, hot_nodes))
    ready_words = shared_costs(most_frequent(vocabulary, top_words).select("key", word_cost(F.col("n")).alias("cost")))

    def run(batches):
        grams_at, gram_costs = load_costs(ready)
        words_at, word_costs = load_costs(ready_words)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            flat, ends = words(batch.column(1))
            keys = token_hashes(flat)
            place = words_at.find(keys)
            sums = np.concatenate([[0.0], np.cumsum(word_costs[place])])
            seen = np.concatenate([[0], np.cumsum(place >= 0)])
            far: list[list[np.ndarray]] = [[], [], [], []]

            def collect(codes, missing, code_ends, to):
                for a, b in zip(code_ends, code_ends[1:]):
                    mine, n = np.unique(codes[a:b][missing[a:b]], return_counts=True)
                    far[to].append(mine.view(np.int64))
                    far[to + 1].append(n)

            collect(keys, place < 0, ends, 0)
            scores = [np.zeros(0)]
            for grams, byte_ends in in_slices(batch.column(1), order):
                at = np.concatenate([grams_at.find(grams[a : a + SCORED]) for a in range(0, len(grams), SCORED)])
                scores.append(np.add.reduceat(gram_costs[at], byte_ends[:-1]))
                collect(grams, at < 0, byte_ends, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(row + np.arange(batch.num_rows)), pa.array(np.diff(ends) + 1), pa.array(seen[ends[1:]] - seen[ends[:-1]]), pa.array(sums[ends[1:]] - sums[ends[:-1]]), pa.array(np.concatenate(scores)), *(in_lists(f, np.int64) for f in far)],
                ["doc_id", "row", "n_tokens", "near", "base", "score", "words", "word_counts", "grams", "gram_counts"],
            )
            row += batch.num_rows

    schema = "doc_id long, row long, n_tokens long, near long, base double, score double, words array<long>, word_counts array<long>, grams array<long>, gram_counts array<long>"
    scored = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), "lm-scored")
    pairs = lambda kind, keys, n: F.transform(F.arrays_zip(F.col(keys).alias("key"), F.col(n).alias("tf")), lambda x: F.struct(F.lit(kind).alias("kind"), x["key"].alias("key"), x["tf"].alias("tf")))
    far = scored.select("row", F.explode(F.concat(pairs(WORD, "words", "word_counts"), pairs(GRAM, "grams", "gram_counts"))).alias("o")).select("row", "o.*")
    asked = materialize(far.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")), "lm-asked")
    codes = asked.filter(F.col("kind") == GRAM).select("key")
    at_top = materialize(codes.join(known.select("key", "cost"), "key", "left"), "lm-top")
    lower = escaped_costs(at_top.filter("cost is null").select("key"), tables)
    gram_costs_of = at_top.filter("cost is not null").unionByName(lower).select(F.lit(GRAM).alias("kind"), "key", "cost", F.lit(0).cast("long").alias("known"))
    word_costs_of = asked.filter(F.col("kind") == WORD).select("key").join(vocabulary, "key", "left").select(F.lit(WORD).alias("kind"), "key", word_cost(F.col("n")).alias("cost"), F.when(F.col("n") > 0, 1).otherwise(0).cast("long").alias("known"))
    costs = materialize(gram_costs_of.unionByName(word_costs_of), "lm-costs")
    hot = hot_keys(asked, ["kind", "key"])
    joined = spread_join(far, costs, ["kind", "key"], hot, F.xxhash64("row"))
    discard(counts, *tables, at_top)
    of_kind = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("tf") * F.col("cost")).otherwise(0.0))
    by_row = joined.groupBy("row").agg(of_kind(WORD).alias("far_base"), of_kind(GRAM).alias("far_score"), F.sum(F.col("tf") * F.col("known")).alias("far_known"))
    end_cost = float(np.log10((texts + 0.5) / weight))
    return scored.join(by_row, "row", "left").select(
        "doc_id", (fold(F.col("doc_id")) == HELD_FOLD).alias("held_out"), "n_tokens",
        (F.col("near") + F.coalesce("far_known", F.lit(0)) + F.lit(int(texts > 0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("far_base", F.lit(0.0)) + F.lit(end_cost)).alias("base_score"), (F.col("score") + F.coalesce("far_score", F.lit(0.0))).alias("score"),
    )
