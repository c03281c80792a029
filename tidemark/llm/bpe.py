"""Byte-pair encoding and decoding with forced boundaries.

A byte pair that no vocabulary token holds side by side can never be merged, so a cut between its two bytes is
certain. Each word of the text is cut at such pairs, the fragments are merged independently, and their ids are
concatenated. All new words of a batch of texts are cut at once, as one array of bytes. Fragments and whole words
repeat, so a worker remembers a bounded number of both.

The vocabulary file is that of a public tokenizer with NFC and lower-case normalisation, words split by a
pattern, bytes as printable characters and a suffix that marks the end of a word.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, column, map_arrow

#: Words and fragments a worker remembers, of each in two generations: when the young one is full, the old one is forgotten.
REMEMBERED = 300_000
#: Fragments from this length on are merged one by one, and words and fragments from this length on aren't remembered.
LONG_FRAGMENT = 96
#: White space as the tokenizer's patterns have it: unlike Python's, without the four separators 1C to 1F.
_WHITE_CLASS = r"\t-\r \x85\p{Z}"
_WHITE = regex.compile(f"[{_WHITE_CLASS}]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Code points that newer versions of Unicode made letters or numbers; to the tokenizer they are signs, as are all from 323B0 on.
_UNASSIGNED = regex.compile(
    "["
    "\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1"
    "\uAB6C-\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A"
    "\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686"
    "\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    "\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128"
    "\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF"
    "\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4"
    "\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U000DFFFF"
    "]"
)


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it is printable, else the next one from code point 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Memory(dict):
    """A bounded memory: what no batch asked for while a whole generation was learned is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.old: dict = {}
        self.most = most
        self.long: list = []

    def missing(self, keys: set) -> list:
        """The keys that aren't remembered; those of the old generation become young again."""
        out = []
        for key in keys.difference(self):
            value = self.old.get(key)
            if value is None:
                out.append(key)
            else:
                self[key] = value
        return out

    def learn(self, found: dict) -> None:
        self.update(found)
        self.long += [key for key in found if len(key) > LONG_FRAGMENT]

    def forget(self) -> None:
        """Called between batches, so that all a batch asked for is young in the meantime."""
        for key in self.long:
            self.pop(key, None)
        self.long = []
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class BytePairCoder:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        vocab = self.vocab
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(model["merges"])}
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]], dtype=np.int32)
        pairs = sorted(((a << 32) | b, rank) for (a, b), rank in self.ranks.items())
        self._pair_keys, self._pair_ranks = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(pattern.replace(r"\s", _WHITE_CLASS) + "|\n").findall
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tokens = {i: t for t, i in self.vocab.items()}
        shown = byte_characters()
        self._bytes = {c: b for b, c in enumerate(shown)}
        self._byte_ids = np.array([vocab[c] for c in shown], dtype=np.int32)
        self._last_ids = np.array([vocab[c + self.suffix] for c in shown], dtype=np.int32)
        self._joined = self._inner_pairs()
        self._inside = np.zeros((256, 256), dtype=bool)
        for first, second in self._joined:
            self._inside[self._bytes[first], self._bytes[second]] = True
        self._fragments, self._words, self._spelled = (Memory(REMEMBERED) for _ in range(3))
        self.texts = self.tokens | {i: t for t, i in self.special.items()}
        self.decimals = {i: str(i) for i in self.texts}

    def _inner_pairs(self) -> frozenset[str]:
        """All pairs of bytes that stand side by side inside some token; between any others a cut is certain."""
        pairs = set()
        for token in self.vocab:
            core = token.removesuffix(self.suffix) if token != self.suffix else token
            pairs.update(map("".join, zip(core, core[1:])))
        return frozenset(pairs)

    def _cut(self, raw: np.ndarray) -> np.ndarray:
        """For each byte but the first, whether a cut before it is certain."""
        return ~self._inside[raw[:-1], raw[1:]]

    def fragments(self, piece: str) -> list[str]:
        """A piece, as byte characters, cut at its forced boundaries."""
        cuts = np.flatnonzero(self._cut(np.array([self._bytes[c] for c in piece], dtype=np.uint8))) + 1
        return [piece[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(piece)])]

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The ids of one long fragment: a heap of mergeable pairs over a linked list of parts."""
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank, at, a, b) for at, (a, b) in enumerate(zip(parts, parts[1:])) if (rank := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, a, b = heapq.heappop(heap)
            following = after[at]
            if parts[at] != a or following < 0 or parts[following] != b:
                continue  # one of the two has been merged since
            parts[at], parts[following] = int(self.merged[rank]), -1
            after[at] = after[following]
            if after[at] >= 0:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0:
                    pair = (parts[left], parts[after[left]])
                    if (rank := self.ranks.get(pair)) is not None:
                        heapq.heappush(heap, (rank, left, *pair))
        return [i for i in parts if i >= 0]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; the number of merges where a pair can't be merged."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self._pair_keys, keys), len(self._pair_keys) - 1)
        return np.where(self._pair_keys[at] == keys, self._pair_ranks[at], len(self.merged)).astype(np.int32)

    def _merge_equal(self, parts: np.ndarray) -> list[bytes]:
        """The ids of fragments of one length, a row each: each turn merges every row's best pair, the leftmost of equals."""
        out: list[bytes] = [b""] * len(parts)
        rows, none = np.arange(len(parts)), len(self.merged)
        ranks = self._ranks_of(parts[:, :-1], parts[:, 1:]) if parts.shape[1] > 1 else None
        while True:
            if parts.shape[1] == 1:
                done = np.ones(len(parts), dtype=bool)
            else:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(at)), at]
                done = best == none
            if done.any():
                width = 4 * parts.shape[1]
                raw = np.ascontiguousarray(parts[done], dtype="<u4").tobytes()
                for k, row in enumerate(rows[done].tolist()):
                    out[row] = raw[k * width : (k + 1) * width]
                if done.all():
                    return out
                keep = ~done
                parts, rows, ranks, at, best = parts[keep], rows[keep], ranks[keep], at[keep], best[keep]
            line, columns = np.arange(len(at)), np.arange(parts.shape[1] - 1)
            parts[line, at] = self.merged[best]
            parts = np.take_along_axis(parts, columns + (columns > at[:, None]), axis=1)
            if parts.shape[1] == 1:
                continue
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= at[:, None]), axis=1)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._ranks_of(parts[left, at[left] - 1], parts[left, at[left]])
            right = np.flatnonzero(at < parts.shape[1] - 1)
            ranks[right, at[right]] = self._ranks_of(parts[right, at[right]], parts[right, at[right] + 1])

    def _merge_all(self, fragments: list[bytes]) -> dict[bytes, bytes]:
        """The ids of fragments, where a line feed ends one that ends its piece; those of one length are merged together."""
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for fragment in fragments:
            by_length[len(fragment)].append(fragment)
        out: dict[bytes, bytes] = {}
        for length, members in by_length.items():
            if length > LONG_FRAGMENT:
                for fragment in members:
                    core = np.frombuffer(fragment.removesuffix(b"\n"), dtype=np.uint8)
                    parts = self._byte_ids[core]
                    if len(core) < length:
                        parts[-1] = self._last_ids[core[-1]]
                    out[fragment] = array("I", self._merge_long(parts.tolist())).tobytes()
                continue
            codes = np.frombuffer(b"".join(members), dtype=np.uint8).reshape(len(members), length)
            last = codes[:, -1] == 10
            for rows, width in ((np.flatnonzero(last), length - 1), (np.flatnonzero(~last), length)):
                if not len(rows):
                    continue
                core = codes[rows, :width]
                parts = self._byte_ids[core]
                if width < length:
                    parts[:, -1] = self._last_ids[core[:, -1]]
                out.update(zip([members[k] for k in rows.tolist()], self._merge_equal(parts)))
        return out

    def _split(self, joined: str) -> list[str]:
        """The pieces of words that are joined by line feeds, which are pieces too; a sign stands for each code point without a character."""
        if joined.isascii() or not _UNASSIGNED.search(joined):
            return self._pieces(joined)
        lengths = map(len, self._pieces(_UNASSIGNED.sub("\u2603", joined)))
        ends = list(accumulate(lengths))
        return [joined[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of new words, as numbers of four bytes.

        Each piece is followed by a line feed, and each word by one more; a fragment runs to the next forced boundary or through
        the line feed after its piece.
        """
        pieces = self._split("\n".join(words))
        raw = "\n".join(pieces).encode("utf-8") + b"\n\n\n"  # a word's line feed stands between those after pieces
        codes = np.frombuffer(raw, dtype=np.uint8)
        feed = codes == 10
        cut = self._cut(codes) & ~feed[1:]
        starts = np.flatnonzero(np.concatenate([[True], cut]) & ~feed)
        feeds = np.flatnonzero(feed)
        stops = np.append(starts[1:], len(raw) - 1)
        after = feeds[np.searchsorted(feeds, starts)]  # the line feed that ends the fragment's piece
        stops = np.minimum(stops, after + 1)
        fragments = [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        missing = self._fragments.missing(set(fragments))
        self._fragments.learn(self._merge_all(missing))
        ends = feeds[np.flatnonzero(feed[feeds - 1] & feed[feeds - 2])] if len(feeds) > 2 else feeds[:0]
        edges = np.searchsorted(starts, ends).tolist()
        parts = list(map(self._fragments.__getitem__, fragments))
        self._fragments.forget()
        found = {word: parts[a] if b - a == 1 else b"".join(parts[a:b]) for word, a, b in zip(words, [0, *edges], edges)}
        self._words.learn(found)

    @staticmethod
    def _normal(text: str) -> str:
        """NFC and lower case, each letter alone: no final form of sigma."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = "".join(map(str.lower, text))
        return text.lower()

    def _odd_words(self, text: str) -> list[str]:
        """The words of a text with special tokens or separators; a special token is a word after a line feed."""
        out = []
        for at, part in enumerate(self._special.split(text) if self._special else [text]):
            out += ["\n" + part] if at % 2 else [word for word in _WHITE.split(self._normal(part)) if word]
        return out

    def _words_of(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts as a dictionary array, and where each text's words start and the last one's end."""
        odd = {k: self._odd_words(t) for k, t in enumerate(texts) if t and ("<|" in t or any(c in t for c in _SEPARATORS))}
        # Arrow's white space is the pattern's and the four separators.
        split = pc.utf8_split_whitespace(pa.array(["" if k in odd else self._normal(t or "") for k, t in enumerate(texts)], pa.large_string()))
        words = split.flatten()
        real = pc.not_equal(words, "")  # an empty word stands before and after white space at a text's ends
        kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        sizes = np.diff(kept[split.offsets.to_numpy()])
        words = words.filter(real)
        if odd:
            at = np.concatenate([[0], np.cumsum(sizes)])
            parts, done = [], 0
            for k, found in odd.items():
                parts += [words.slice(at[done], at[k] - at[done]), pa.array(found, pa.large_string())]
                sizes[k], done = len(found), k
            words = pa.concat_arrays([*parts, words.slice(at[done])])
        return words.dictionary_encode(), np.concatenate([[0], np.cumsum(sizes)])

    def _know(self, words: list[str]) -> None:
        """Have the ids of all these words in memory; those that are new are learned together."""
        self._words.update(("\n" + text, array("I", [number]).tobytes()) for text, number in self.special.items())
        missing = self._words.missing(set(words))
        if missing:
            self._learn(missing)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as numbers of four bytes."""
        words, edges = self._words_of(texts)
        distinct = words.dictionary.to_pylist()
        self._know(distinct)
        known = list(map(self._words.__getitem__, distinct))
        self._words.forget()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, place = np.cumsum(sizes) - sizes, words.indices.to_numpy()
        counts = sizes[place]
        before = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(starts[place] - before[:-1], counts) + np.arange(before[-1])
        raw = np.frombuffer(b"".join(known), dtype="<u4")[at].tobytes()
        ends = (4 * before[edges]).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.encode_all([text])[0]).tolist()

    def spell_all(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Of each text, the ids in decimal and what they decode to; a word's own are remembered as its ids are."""
        words, edges = self._words_of(texts)
        distinct = words.dictionary.to_pylist()
        missing = self._spelled.missing(set(distinct))
        if missing:
            self._know(missing)
            numbers = [array("I", self._words[word]) for word in missing]
            self._spelled.learn({word: (self.spell(ids), self.decode(ids)) for word, ids in zip(missing, numbers)})
            self._words.forget()
        known = list(map(self._spelled.__getitem__, distinct))
        self._spelled.forget()
        joined = []
        for k in (0, 1):
            spelled = pa.array([x[k] for x in known], pa.large_string()).take(words.indices)
            joined.append(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), spelled), pa.scalar(" ", pa.large_string())).to_pylist())
        return list(zip(*joined))

    def spell(self, ids: Iterable[int]) -> str:
        """The ids in decimal, joined by one space."""
        decimals = self.decimals
        return " ".join([decimals[i] for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        """What the public library gives without a decoder: the tokens' own spellings, joined by one space."""
        texts = self.texts
        return " ".join([texts[i] for i in ids])


@functools.lru_cache(maxsize=4)
def coder(name: str) -> BytePairCoder:
    """The coder of a vocabulary file by name, read where it is used: once in each Python worker."""
    return BytePairCoder(public_tokenizers.path(name))


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of `docs` (doc_id, text).

    A null text is an empty one, with no ids. Repeated rows are coded one by one; other columns are ignored; an
    empty table gives an empty result. Texts of any length are coded whole.
    """

    def run(batches):
        bpe = coder(vocabulary)
        for part in batches:
            rows = []
            for spelled in bpe.spell_all(column(part, "text")):
                n_tokens = spelled[0].count(" ") + 1 if spelled[0] else 0
                rows.append((n_tokens, *(hashlib.sha256(x.encode("utf-8")).hexdigest() for x in spelled)))
            yield batch(
                doc_id=part.column(part.schema.get_field_index("doc_id")),
                n_tokens=pa.array([r[0] for r in rows], pa.int64()),
                ids_sha256=pa.array([r[1] for r in rows], pa.string()),
                decoded_sha256=pa.array([r[2] for r in rows], pa.string()),
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
