"""A gated recurrent language model over words, trained in numpy inside Spark tasks, and the scores of whole documents.

Each text is read once: a task numbers the words of a chunk of documents and writes the numbers, with the chunk's distinct
words as 64-bit hashes and their counts in training documents. The counts of a word meet in Spark as plain rows of (chunk, hash,
count), and each chunk gets the corpus's counts of its words back; no vocabulary travels through the driver. Counts cover the
whole corpus; they are exact as far as no two words share a hash, which among a thousand million distinct words happens
with a chance of 3 %.

The model reads a token's row of an input table and predicts the next token in two factors: its class, then the word in
its class. Frequent words form classes of equal size; all others fall into tail classes by their last letters, and inside a
tail class the smoothed counts decide. Output biases start at the log frequencies, so training starts from
the unigram model. Each task trains on its documents by truncated back-propagation, in lanes of documents laid end to end, with
the state carried from window to window; after each round the tasks' parameters are averaged, in Spark. Only for training,
documents longer than a segment are cut into segments, so that lanes end together; each segment but the first reads the
window before it, without learning from it, to come to its state.

A document's score is the sum over all its tokens, its state carried from first to last.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, column, map_arrow
from tidemark.llm.suffix import dump, load
from tidemark.session import materialize, shuffle_partitions, ship

#: Fixed values of the contract: the smoothing of counts, and the share of documents held out.
SMOOTH = 0.1
FOLDS = 10
#: The end of a document as a word: no real word is empty.
END = b""


@dataclass(frozen=True)
class GruRules:
    """Sizes of the model and of training, bytes of text from which a chunk is full, and rows of counts that should meet in one group."""

    words: int = 1024
    class_words: int = 32
    tail_classes: int = 32
    hidden: int = 16
    window: int = 16
    lanes: int = 192
    segment: int = 512
    rounds: int = 3
    rate: float = 0.06
    batch_tokens: int = 400_000
    chunk_bytes: int = 16_000_000
    group_rows: int = 1_000_000
    seed: int = 7

    @property
    def word_classes(self) -> int:
        return self.words // self.class_words

    @property
    def inputs(self) -> int:
        return self.words + self.tail_classes


# ---------------------------------------------------------------- words and counts


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 0)


def tail_class(word: bytes, classes: int) -> int:
    """The tail class of a word, by its last three bytes."""
    return xxhash.xxh32_intdigest(word[-3:], 1) % classes


class Lexicon:
    """The distinct words of one chunk: local numbers as they come, and their hashes and tail classes."""

    def __init__(self, classes: int):
        self.classes = classes
        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__  # a word that is new gets the next number

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all texts, A-Z in lower case, with an end after each text, and each text's size."""
        # A fresh array: on a slice of one, Arrow's lower case takes wrong bytes.
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts.to_pylist()], pa.large_string())))
        found = split.flatten()
        real = pc.not_equal(found, "")  # an empty word stands before and after white space at a text's ends
        kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        sizes = np.diff(kept[split.offsets.to_numpy()])
        coded = found.filter(real).dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)  # bytes objects, made much faster than as a list
        own = np.fromiter(map(self.numbers.__getitem__, distinct), np.int32, len(distinct))
        return np.insert(own[coded.indices.to_numpy()], np.cumsum(sizes), self.numbers[END]).astype(np.int32), sizes + 1

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(word_hash, self.numbers), np.uint64, len(self.numbers))

    def tails(self) -> np.ndarray:
        return np.fromiter((tail_class(w, self.classes) for w in self.numbers), np.uint8, len(self.numbers))


_CHUNKS = "source long, n_words long, docs binary, words binary"


def _read_chunks(rules: GruRules):
    """Documents of a task as chunks: their ids and numbered words, and the distinct words with training counts."""

    def run(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        words, held, size = Lexicon(rules.tail_classes), [], 0

        def finish():
            ids, missing, out, numbers, sizes = (np.concatenate([h[i] for h in held]) for i in range(5))
            counts = np.bincount(numbers[np.repeat(~out, sizes)], minlength=len(words.numbers)).astype(np.int64)
            docs = dump(ids, missing, out, sizes.astype(np.int64), numbers)
            return batch(
                source=pa.array([base + made], pa.int64()),
                n_words=pa.array([len(counts)], pa.int64()),
                docs=pa.array([docs], pa.binary()),
                words=pa.array([dump(words.hashes(), words.tails(), counts)], pa.binary()),
            )

        for part in batches:
            ids = part.column(part.schema.get_field_index("doc_id"))
            texts = part.column(part.schema.get_field_index("text"))
            out = part.column(part.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
            held.append((pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), out, *words.read(texts)))
            size += texts.nbytes
            if size >= rules.chunk_bytes:
                yield finish()
                made += 1
                words, held, size = Lexicon(rules.tail_classes), [], 0
        if held:
            yield finish()

    return run


def _chunk(docs: bytes) -> list[np.ndarray]:
    """ids, whether an id is null, whether it is held out, sizes and word numbers."""
    return load(docs, "<i8", "?", "?", "<i8", "<i4")


def _word_rows(batches):
    """A chunk's distinct words as plain rows."""
    for part in batches:
        for source, value in zip(column(part, "source"), column(part, "words")):
            hashes, tails, counts = load(value, "<u8", "u1", "<i8")
            yield batch(source=pa.array(np.full(len(hashes), source)), hash=pa.array(hashes.view(np.int64)), tail=pa.array(tails.astype(np.int16)), count=pa.array(counts))


def _step_counts(most: int, classes: int):
    """Sum the counts of each word; answer each chunk, and report the most frequent words and the tail classes' totals in one row."""

    def run(part: pa.Table) -> pa.Table:
        sources, hashes, tails, counts = (part.column(n).to_numpy() for n in ("source", "hash", "tail", "count"))
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(first)).astype(np.int64)
        own, seen = tails[first], total > 0
        facts = _facts(distinct.view(np.uint64), own.astype(np.uint8), total, np.bincount(own, weights=total, minlength=classes), np.bincount(own[seen], minlength=classes), most)
        n = len(sources)
        return pa.table(
            {
                "source": pa.concat_arrays([pa.array(sources), pa.nulls(1, pa.int64())]),
                "hash": pa.concat_arrays([pa.array(hashes), pa.array([distinct[0]], pa.int64())]),
                "total": pa.concat_arrays([pa.array(total[place]), pa.array([0], pa.int64())]),
                "facts": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([facts], pa.binary())]),
            }
        )

    return run


def _facts(hashes: np.ndarray, tails: np.ndarray, total: np.ndarray, tail_total: np.ndarray, tail_distinct: np.ndarray, most: int) -> bytes:
    """The most frequent of distinct words (the end first, ties by hash) with their tail classes and counts, and the totals of the tail classes."""
    top = np.lexsort((hashes.astype(np.int64), -total, hashes != np.uint64(word_hash(END))))[:most]
    top = top[total[top] > 0]
    return dump(hashes[top], tails[top], total[top], tail_total.astype(np.int64), tail_distinct.astype(np.int64))


def _merge_facts(most: int):
    """Facts of several buckets as one; their words are distinct, since a word has one bucket."""

    def run(part: pa.Table) -> pa.Table:
        return pa.table({"value": pa.array([_merged(part.column("value").to_pylist(), most)], pa.binary())})

    return run


def _merged(values: list[bytes], most: int) -> bytes:
    loaded = [load(v, "<u8", "u1", "<i8", "<i8", "<i8") for v in values]
    hashes, tails, total = (np.concatenate([x[i] for x in loaded]) for i in range(3))
    return _facts(hashes, tails, total, sum(x[3] for x in loaded), sum(x[4] for x in loaded), most)


@dataclass
class Counts:
    """Of the training documents: tokens, distinct words, the model's words by frequency, and what the tail classes hold beside them."""

    total: int
    distinct: int
    hashes: np.ndarray
    frequency: np.ndarray
    tail_total: np.ndarray
    tail_distinct: np.ndarray


def _counts(answers: DataFrame, rules: GruRules, groups: int) -> Counts:
    """Facts are merged in groups, of which there are as many as a group has members; what is collected is bounded by that."""
    few = math.isqrt(groups) + 1
    facts = answers.where("facts is not null").select(F.pmod(F.xxhash64("hash"), F.lit(few)).alias("group"), F.col("facts").alias("value"))
    merged = facts.groupBy("group").applyInArrow(_merge_facts(rules.words), "value binary")
    values = [bytes(r.value) for r in merged.collect()]
    if not values:
        none = np.zeros(rules.tail_classes, dtype=np.int64)
        return Counts(0, 0, np.empty(0, np.uint64), np.empty(0), none, none.copy())
    hashes, tails, frequency, total, distinct = load(_merged(values, rules.words), "<u8", "u1", "<i8", "<i8", "<i8")
    tail_total = total - np.bincount(tails, weights=frequency, minlength=rules.tail_classes).astype(np.int64)
    tail_distinct = distinct - np.bincount(tails, minlength=rules.tail_classes)
    return Counts(int(total.sum()), int(distinct.sum()), hashes, frequency.astype(np.float64), tail_total, tail_distinct)


def model_ids(hashes: np.ndarray, tails: np.ndarray, counts: Counts, rules: GruRules) -> np.ndarray:
    """The model's input number of each word: its rank, or its tail class after all ranks."""
    order = np.argsort(counts.hashes)
    known = counts.hashes[order]
    if not len(known):
        return rules.words + tails.astype(np.int32)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, order[at], rules.words + tails.astype(np.int64)).astype(np.int32)


# ---------------------------------------------------------------- the network

Parameters = dict[str, np.ndarray]


def initial(counts: Counts, rules: GruRules) -> Parameters:
    """Small random weights; output biases at the log frequencies of classes and of words in their class."""
    rng = np.random.default_rng(rules.seed)
    h, k, size = rules.hidden, rules.word_classes, rules.class_words
    frequency = np.zeros(rules.words)
    frequency[: len(counts.frequency)] = counts.frequency
    by_word = np.log(frequency + SMOOTH).reshape(k, size)
    mass = np.concatenate([frequency.reshape(k, size).sum(axis=1), counts.tail_total]) + 1.0
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "input": small(rules.inputs, 3 * h),
        "state": small(h, 3 * h) + np.tile(np.eye(h, dtype=np.float32) * 0.5, 3),
        "class": small(h, k + rules.tail_classes) * 0.1,
        "class_bias": np.log(mass / mass.sum()).astype(np.float32),
        "word": small(k, h, size) * 0.1,
        "word_bias": (by_word - by_word.max(axis=1, keepdims=True)).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Buffers:
    """Arrays by name, kept from one window or block to the next. What numpy allocates afresh at these sizes comes from the
    system in pages and goes back at once, which takes longer than the arithmetic in it.
    """

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        """Unset values; what the name held before is lost."""
        size = math.prod(shape)
        if name not in self.kept or self.kept[name].size < size:
            self.kept[name] = np.empty(size, dtype=self.dtype)
        return self.kept[name][:size].reshape(shape)


def step(state: np.ndarray, x: np.ndarray, h: np.ndarray, gates: np.ndarray, new: np.ndarray, out: np.ndarray) -> np.ndarray:
    """One step for all lanes: the new state, in `out`; `gates` and `new` take what back-propagation needs, `gates` after
    both gates what the state adds to the new value.

    Here and below a feature is a row and a lane or token a column, so that numpy's inner loops run over lanes. `state`
    is the transposed table of that name.
    """
    size = len(h)
    np.matmul(state, h, out=gates)
    both, inner = gates[: 2 * size], gates[2 * size :]
    both += x[: 2 * size]
    _sigmoid(both)
    np.multiply(both[size:], inner, out=new)
    new += x[2 * size :]
    np.tanh(new, out=new)
    np.subtract(h, new, out=out)
    out *= both[:size]
    out += new
    return out


def _softmax_gradient(x: np.ndarray, at: np.ndarray, scale: np.floating) -> np.ndarray:
    """In place, the gradient of each column's cross entropy to the row that is right, but for the column's factor; returns the factors, each with `scale` in it."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    total = x.sum(axis=0)
    x[at, np.arange(x.shape[1])] -= total
    return scale / total


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax at one row of each column."""
    x -= x.max(axis=0)
    picked = x[at, np.arange(x.shape[1])]
    return picked - np.log(np.exp(x, out=x).sum(axis=0))


def _taken(states: np.ndarray, at: np.ndarray, kept: Buffers) -> np.ndarray:
    """Those columns of states, with a last row of ones, which carries the biases through a product."""
    out = kept("taken", len(states) + 1, len(at))
    np.take(states, at, axis=1, out=out[:-1], mode="clip")  # other modes fill a copy of `out` first
    out[-1] = 1
    return out


def _with_bias(parameters: Parameters, name: str) -> np.ndarray:
    return np.concatenate([parameters[name], parameters[name + "_bias"][..., None, :]], axis=-2)


def _classes(target: np.ndarray, rules: GruRules) -> np.ndarray:
    return np.where(target < rules.words, target // rules.class_words, rules.word_classes + target - rules.words)


def _order(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys below `most`, by radix where they fit in 16 bits."""
    return np.argsort(keys.astype(np.min_scalar_type(most)), kind="stable")


def _by_class(cls: np.ndarray, rules: GruRules) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by class, and of each word class that occurs its number and its run in that order."""
    edges = np.cumsum(np.bincount(cls, minlength=rules.word_classes)[: rules.word_classes]).tolist()
    return _order(cls, rules.word_classes + rules.tail_classes), [(c, a, b) for c, (a, b) in enumerate(zip([0, *edges], edges)) if b > a]


def _word_logits(words: np.ndarray, states: np.ndarray, runs: list[tuple[int, int, int]], kept: Buffers) -> np.ndarray:
    """Of tokens in the order of their classes, the logits of the words in their class."""
    out = kept("word logits", words.shape[2], runs[-1][2] if runs else 0)
    for c, a, b in runs:
        np.matmul(words[c].T, states[:, a:b], out=out[:, a:b])
    return out


def log_likelihood(parameters: Parameters, states: np.ndarray, target: np.ndarray, rules: GruRules, kept: Buffers) -> np.ndarray:
    """The natural log probability of each target's class, and of the word in it unless the class is a tail."""
    cls = _classes(target, rules)
    order, runs = _by_class(cls, rules)
    states, cls, target, classes = _taken(states, order, kept), cls[order], target[order], _with_bias(parameters, "class")
    found = _log_softmax_at(np.matmul(classes.T, states, out=kept("class logits", classes.shape[1], len(order))), cls).astype(np.float64)
    logits = _word_logits(_with_bias(parameters, "word"), states, runs, kept)
    m = logits.shape[1]
    found[:m] += _log_softmax_at(logits, target[:m] % rules.class_words)
    out = np.empty_like(found)
    out[order] = found
    return out


class Lanes:
    """Pieces laid end to end in lanes of about equal length; each starts from a fresh state and reads `before` at first."""

    def __init__(self, docs: list[np.ndarray], lanes: int, before: np.ndarray):
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lanes = max(1, min(lanes, len(docs), 2 * sum(map(len, docs)) // max(map(len, docs))))  # a long piece makes all lanes' arrays long
        members: list[list[int]] = [[] for _ in range(lanes)]
        load_ = [(0, k) for k in range(lanes)]
        for i in order:
            size, k = heapq.heappop(load_)
            members[k].append(i)
            heapq.heappush(load_, (size + len(docs[i]), k))
        sizes = np.array([sum(len(docs[i]) for i in m) for m in members])
        by_size = np.argsort(-sizes, kind="stable")
        self.length = int(sizes.max())
        self.active = np.searchsorted(-sizes[by_size], -np.arange(self.length), side="left")  # lanes longer than each step
        self.target = np.zeros((self.length, lanes), dtype=np.int32)
        self.fresh = np.zeros((self.length, lanes), dtype=bool)
        self.doc = np.zeros((self.length, lanes), dtype=np.int32)
        self.read = np.zeros((self.length, lanes), dtype=np.int32)  # what a step reads: the token before
        for lane, k in enumerate(by_size):
            at = 0
            for i in members[k]:
                end = at + len(docs[i])
                self.target[at:end, lane] = docs[i]
                self.doc[at:end, lane] = i
                self.fresh[at, lane] = True
                self.read[at, lane], self.read[at + 1 : end, lane] = before[i], docs[i][:-1]
                at = end


def score_documents(parameters: Parameters, docs: list[np.ndarray], end_id: int, rules: GruRules, lanes: int = 512) -> np.ndarray:
    """Of each document of model ids, the sum of its tokens' log likelihoods, without what tail counts add."""
    out = np.zeros(len(docs))
    laid = Lanes(docs, lanes, np.full(len(docs), end_id, dtype=np.int32))
    state = np.ascontiguousarray(parameters["state"].T)
    h = np.zeros((rules.hidden, laid.target.shape[1]), dtype=state.dtype)
    kept, most = Buffers(state.dtype), 16 * lanes
    active, restarts = laid.active.tolist(), laid.fresh.any(axis=1).tolist()
    states, targets, owners, held, n = [], [], [], 0, 0
    for at in range(laid.length):
        if active[at] != n:
            n = active[at]
            h = h[:, :n].copy()
            x, gates, new = (kept(name, k * rules.hidden, n) for name, k in (("x", 3), ("gates", 3), ("new", 1)))
        if restarts[at]:
            h = h.copy()  # states already kept stay as they are
            h[:, laid.fresh[at, :n]] = 0
        x[:] = parameters["input"].take(laid.read[at, :n], axis=0).T
        h = step(state, x, h, gates, new, np.empty_like(h))
        states.append(h), targets.append(laid.target[at, :n]), owners.append(laid.doc[at, :n])
        held += n
        if held >= most or at == laid.length - 1:  # steps are judged together by tokens, so that few lanes make long blocks
            found = log_likelihood(parameters, np.concatenate(states, axis=1, out=kept("states", rules.hidden, held)), np.concatenate(targets), rules, kept)
            out += np.bincount(np.concatenate(owners), weights=found, minlength=len(docs))
            states, targets, owners, held = [], [], [], 0
    return out


class Trainer:
    """Truncated back-propagation with Adagrad steps."""

    def __init__(self, parameters: Parameters, rules: GruRules, squares: Parameters | None = None):
        self.parameters = {k: v.copy() for k, v in parameters.items()}
        self.squares = {k: squares[k].copy() if squares else np.full(v.shape, 1e-3, dtype=np.float32) for k, v in parameters.items()}
        self.rules = rules
        self.kept = Buffers(parameters["state"].dtype)
        self.updates = self.tokens = 0

    def _move(self, name: str, gradient: np.ndarray, rows=slice(None)) -> None:
        np.clip(gradient, -1, 1, out=gradient)
        squares = self.squares[name][rows]
        squares += gradient * gradient
        self.squares[name][rows] = squares
        self.parameters[name][rows] -= self.rules.rate * gradient / np.sqrt(squares)

    def _window(self, laid: Lanes, learned: np.ndarray, first: int, h: np.ndarray) -> np.ndarray:
        """One window of all lanes that reach it; `learned` marks the tokens that count, which those after a lane's end don't."""
        p, rules, size, kept = self.parameters, self.rules, self.rules.hidden, self.kept
        last = min(first + rules.window, laid.length)
        steps, n = last - first, int(laid.active[first])
        state = np.ascontiguousarray(p["state"].T)
        room = lambda name, rows: kept(name, steps, rows, n)
        starts, states, gates, new = room("starts", size), room("states", size), room("gates", 3 * size), room("new", size)
        fresh, read = laid.fresh[first:last, :n], laid.read[first:last, :n]
        restarts = fresh.any(axis=1).tolist()
        x = kept("x", 3 * size, n)
        h = h[:, :n]
        for k in range(steps):
            starts[k] = h
            if restarts[k]:
                starts[k][:, fresh[k]] = 0
            x[:] = p["input"].take(read[k], axis=0).T
            h = step(state, x, starts[k], gates[k], new[k], states[k])
        h = h.copy()
        counted = np.flatnonzero(learned[first:last, :n].reshape(-1))
        if not len(counted):
            return h
        target = laid.target[first:last, :n].reshape(-1)[counted]
        cls = _classes(target, rules)
        order, runs = _by_class(cls, rules)
        counted, target, cls = counted[order], target[order], cls[order]
        by_feature = kept("by feature", size, steps, n)
        by_feature[:] = states.transpose(1, 0, 2)
        hs = _taken(by_feature.reshape(size, -1), counted, kept)
        scale = state.dtype.type(steps / len(counted))
        classes, words = _with_bias(p, "class"), _with_bias(p, "word")
        # A column's factor goes to the states that its gradient meets, which have fewer rows.
        d_class = np.matmul(classes.T, hs, out=kept("class logits", classes.shape[1], len(counted)))
        factor = _softmax_gradient(d_class, cls, scale)
        scaled = np.multiply(hs, factor, out=kept("scaled", *hs.shape))
        g_class = (d_class @ scaled.T).T
        d_counted = np.matmul(d_class.T, p["class"].T, out=kept("d counted", len(counted), size))
        d_counted *= factor[:, None]
        d_word = _word_logits(words, hs, runs, kept)
        m = d_word.shape[1]
        factor = _softmax_gradient(d_word, target[:m] % rules.class_words, scale)
        scaled = np.multiply(hs[:, :m], factor, out=kept("scaled", len(hs), m))
        g_word, from_words = np.zeros_like(words), kept("from words", m, size)
        for c, a, b in runs:
            np.matmul(scaled[:, a:b], d_word[:, a:b].T, out=g_word[c])
            np.matmul(d_word[:, a:b].T, p["word"][c].T, out=from_words[a:b])
        from_words *= factor[:, None]
        d_counted[:m] += from_words
        by_token = kept("by token", steps * n, size)
        if len(counted) < len(by_token):
            by_token[:] = 0
        by_token[counted] = d_counted
        d_h = room("d h", size)
        d_h[:] = by_token.reshape(steps, n, size).transpose(0, 2, 1)
        # What of the gradients doesn't depend on later steps is found for all steps at once.
        z, r, inner = (gates[:, k * size : (k + 1) * size] for k in range(3))
        rest = np.subtract(1, z, out=room("rest", size))
        to_update = np.subtract(starts, new, out=room("to update", size))
        to_update *= z
        to_update *= rest
        to_new = np.multiply(new, new, out=new)
        np.subtract(1, to_new, out=to_new)
        to_new *= rest
        to_reset = np.subtract(1, r, out=rest)
        to_reset *= r
        to_reset *= inner
        # Of each step the gradients of the new value, both gates, and the new value by way of the state: an input's are the first three, the state's the last three.
        d_in, carried, back = room("d in", 4 * size), np.zeros((size, n), dtype=state.dtype), np.empty((size, n), dtype=state.dtype)
        for k in range(steps - 1, -1, -1):
            carried += d_h[k]
            d_n = np.multiply(carried, to_new[k], out=d_in[k, :size])
            np.multiply(carried, to_update[k], out=d_in[k, size : 2 * size])
            np.multiply(d_n, to_reset[k], out=d_in[k, 2 * size : 3 * size])
            np.multiply(d_n, r[k], out=d_in[k, 3 * size :])
            carried *= z[k]
            carried += np.matmul(p["state"], d_in[k, size:], out=back)
            if restarts[k]:
                carried[:, fresh[k]] = 0
        g_state = np.matmul(starts, d_in[:, size:].transpose(0, 2, 1)).sum(axis=0)
        even = 3 * size + size % 2
        by_lane = kept("by lane", steps, n, even)
        by_lane[:] = d_in[:, :even].transpose(0, 2, 1)
        read = read.reshape(-1)
        order = _order(read, rules.inputs)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(read[order])) + 1])
        # Two values are summed as one complex number: the time goes into the sums' number, not their size.
        rows = np.take(by_lane.reshape(-1, even), order, axis=0, out=kept("rows", len(order), even), mode="clip")
        g_input = np.add.reduceat(rows.view(np.result_type(rows, np.complex64)), edges, axis=0).view(rows.dtype)
        self._move("input", np.concatenate([g_input[:, size : 3 * size], g_input[:, :size]], axis=1), read[order][edges])
        self._move("state", g_state)
        self._move("class", g_class[:-1]), self._move("class_bias", g_class[-1])
        self._move("word", g_word[:, :-1]), self._move("word_bias", g_word[:, -1])
        self.updates, self.tokens = self.updates + 1, self.tokens + len(counted)
        return h

    def learn(self, docs: list[np.ndarray], end_id: int) -> None:
        """One pass over documents, cut into segments; a segment inside a document is led in by the window before it."""
        cut, window = self.rules.segment, self.rules.window
        pieces, before, lead = [], [], []
        for doc in docs:
            for at in range(0, len(doc), cut):
                start = max(0, at - window)
                pieces.append(doc[start : at + cut])
                before.append(doc[start - 1] if start else end_id)
                lead.append(at - start)
        laid = Lanes(pieces, max(8, min(self.rules.lanes, sum(map(len, pieces)) // (2 * cut))), np.array(before, dtype=np.int32))
        learned = np.arange(laid.target.shape[1]) < laid.active[:, None]
        for at, lane in zip(*np.nonzero(laid.fresh)):
            learned[at : at + lead[laid.doc[at, lane]], lane] = False
        h = np.zeros((self.rules.hidden, laid.target.shape[1]), dtype=self.parameters["state"].dtype)
        for first in range(0, laid.length, self.rules.window):
            h = self._window(laid, learned, first, h)


# ---------------------------------------------------------------- training in rounds


@dataclass
class GruModel:
    """Parameters with the counts they were built on, and the squared gradients that set the size of the next steps."""

    counts: Counts
    parameters: Parameters
    rules: GruRules = field(default_factory=GruRules)
    squares: Parameters | None = None

    def end_id(self) -> int:
        at = np.flatnonzero(self.counts.hashes == np.uint64(word_hash(END)))
        return int(at[0]) if len(at) else self.rules.words + tail_class(END, self.rules.tail_classes)


_SLICES = 16


def _train_tasks(model: GruModel):
    rules, end_id = model.rules, model.end_id()
    names = sorted(model.parameters)

    def run(batches):
        trainer = Trainer(model.parameters, rules, model.squares)
        for part in batches:
            for docs, words in zip(column(part, "docs"), column(part, "words")):
                _, _, out, sizes, numbers = _chunk(docs)
                hashes, tails, _ = load(words, "<u8", "u1", "<i8")
                known = model_ids(hashes, tails, model.counts, rules)[numbers]
                own = [d for d, held in zip(np.split(known, np.cumsum(sizes)[:-1]), out.tolist()) if not held]
                at = 0
                while at < len(own):  # documents that are laid in lanes together
                    first, size = at, 0
                    while at < len(own) and size < rules.batch_tokens:
                        size, at = size + len(own[at]), at + 1
                    trainer.learn(own[first:at], end_id)
        if trainer.tokens:
            flat = np.concatenate([x[k].reshape(-1) for x in (trainer.parameters, trainer.squares) for k in names]).astype(np.float64)
            task, weight = TaskContext.get().partitionId(), float(trainer.tokens)
            parts = np.array_split(flat * weight, _SLICES)
            yield batch(
                slice=pa.array(range(_SLICES), pa.int32()), task=pa.array([task] * _SLICES, pa.int32()), weight=pa.array([weight] * _SLICES, pa.float64()), value=pa.array([x.tobytes() for x in parts], pa.binary())
            )

    return run


def _sum_slices(part: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, np.float64) for v in part.column("value").to_pylist())
    weight = sum(part.column("weight").to_pylist())
    return pa.table({"slice": part.column("slice").slice(0, 1), "task": pa.array([0], pa.int32()), "weight": pa.array([weight], pa.float64()), "value": pa.array([total.tobytes()], pa.binary())})


def train(chunks: DataFrame, counts: Counts, rules: GruRules) -> GruModel:
    """Rounds, each over all training documents; after a round parameters are averaged in two levels."""
    model = GruModel(counts, initial(counts, rules), rules)
    schema = "slice int, task int, weight double, value binary"
    for _ in range(rules.rounds):
        trained = map_arrow(chunks.select("docs", "words"), _train_tasks(model), schema)
        some = trained.groupBy("slice", F.pmod(F.col("task"), F.lit(64)).alias("group")).applyInArrow(_sum_slices, schema)
        summed = {r.slice: r for r in some.groupBy("slice").applyInArrow(_sum_slices, schema).collect()}
        if not summed:
            continue
        flat = np.concatenate([np.frombuffer(summed[k].value, np.float64) / summed[k].weight for k in range(_SLICES)]).astype(np.float32)
        at, averaged = 0, ({}, {})
        for into in averaged:
            for name in sorted(model.parameters):
                shape = model.parameters[name].shape
                into[name] = flat[at : at + math.prod(shape)].reshape(shape)
                at += math.prod(shape)
        model = GruModel(counts, averaged[0], rules, averaged[1])
    return model


# ---------------------------------------------------------------- scores

def _step_scores(model: GruModel):
    rules, counts, end_id = model.rules, model.counts, model.end_id()

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        ids_, missing, out, sizes, flat = _chunk(chunk.column("docs")[0].as_py())
        hashes, tails, _ = load(chunk.column("words")[0].as_py(), "<u8", "u1", "<i8")
        asked, total = answers.column("hash").to_numpy().view(np.uint64), answers.column("total").to_numpy()
        order = np.argsort(asked)
        count = total[order][np.searchsorted(asked[order], hashes)]
        base = np.log10((count + SMOOTH) / (counts.total + SMOOTH * (counts.distinct + 1)))
        ids = model_ids(hashes, tails, counts, rules)
        tail = ids >= rules.words
        room = counts.tail_total[tails] + SMOOTH * (counts.tail_distinct[tails] + 1)
        inside = np.where(tail, np.log((count + SMOOTH) / room), 0.0)
        starts = np.cumsum(sizes) - sizes
        sums = lambda values: np.add.reduceat(values[flat], starts)
        model_score = score_documents(model.parameters, np.split(ids[flat], starts[1:]), end_id, rules) + sums(inside)
        return pa.table(
            {
                "doc_id": pa.array(ids_, mask=missing),
                "held_out": pa.array(out),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(sums((count > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(sizes), counts.total)),
                "base_score": pa.array(sums(base)),
                "score": pa.array(model_score / math.log(10)),
            }
        )

    return run


def language_scores(docs: DataFrame, rules: GruRules = GruRules()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs` (doc_id, text).

    A null or empty text is its end alone. A null id is held out. Rows with equal ids are each scored and, unless held
    out, each learned from. Other columns are ignored; an empty table gives an empty result. Without any training
    document all words are unknown and the untrained model scores.
    """
    spark = docs.sparkSession
    ship(spark)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), "text", (F.crc32(key) % FOLDS == 0).alias("held_out"))
    chunks = materialize(map_arrow(rows, _read_chunks(rules), _CHUNKS))
    groups = max(shuffle_partitions(spark), -(-(chunks.agg(F.sum("n_words")).first()[0] or 0) // rules.group_rows))
    words = map_arrow(chunks.select("source", "words"), _word_rows, "source long, hash long, tail short, count long")
    met = words.groupBy(F.pmod(F.xxhash64("hash"), F.lit(groups)).alias("group"))
    answers = materialize(met.applyInArrow(_step_counts(rules.words, rules.tail_classes), "source long, hash long, total long, facts binary"))
    model = train(chunks, _counts(answers, rules, groups), rules)
    own = answers.where("source is not null").select("source", "hash", "total").groupBy("source")
    return chunks.groupBy("source").cogroup(own).applyInArrow(_step_scores(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
