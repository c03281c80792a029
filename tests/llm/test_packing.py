import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import docs, read
from tidemark.llm.packing import PackingRules, bound, pack, pack_documents
from tidemark.llm.tokenbin import CapacityTree, TokenRules, fill, packed_rows, unpack, write_packed

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def encode():
    library = Tokenizer.from_file(public_tokenizers.path(NAME))
    library.no_truncation()
    library.no_padding()
    return lambda text: library.encode(text or "", add_special_tokens=False).ids + [1]


def check_packing(rows, expected):
    """All pieces are there, whole, gapless, and in few sequences."""
    made = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    wanted = []
    for i, ids in expected:
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            wanted.append((i, k, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert made == sorted(wanted)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= 4096
    return len(by)


@pytest.mark.parametrize("rules", [PackingRules(), PackingRules(partition_pieces=64, fan_in=3)])
def test_packing_is_whole_and_tight(spark, small, encode, rules):
    table = read(spark, small, "documents")
    rows = pack_documents(table, NAME, rules).collect()
    used = check_packing(rows, [(r.doc_id, encode(r.text)) for r in table.select("doc_id", "text").collect()])
    least = bound(np.array([r.length for r in rows]), 4096)
    assert used <= 1.02 * least + 1


def test_odd_texts(spark, encode):
    table = docs(spark)
    check_packing(pack_documents(table, NAME).collect(), [(r.doc_id, encode(r.text)) for r in table.select("doc_id", "text").collect()])
    assert pack_documents(docs(spark, []), NAME).count() == 0


def test_bound_is_a_bound():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 41, 9)
        best = fewest(sorted(lengths.tolist(), reverse=True), 40)
        assert bound(lengths, 40) <= best <= pack(lengths, 40).max() + 1
    assert bound(np.array([21] * 5), 40) == 5 and bound(np.array([14] * 6 + [40]), 40) == 4


def fewest(items, capacity):
    """By trying all ways."""
    best = [len(items)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[k] <= capacity and bins[j] not in bins[:j]:
                put(k + 1, [*bins[:j], bins[j] + items[k], *bins[j + 1 :]])
        put(k + 1, [*bins, items[k]])

    put(0, [])
    return best[0]


def test_binary_rows_round_trip(spark, tmp_path, tiny, encode):
    for k, table in enumerate((docs(spark), read(spark, tiny, "documents"))):
        write_packed(packed_rows(table, NAME), f"{tmp_path}/{k}")
        written = spark.read.parquet(f"{tmp_path}/{k}")
        parts = sorted((r.doc_id, r.start, r.ids) for r in unpack(written).collect())
        wanted = sorted((r.doc_id, s, ids[s : s + 4096]) for r in table.select("doc_id", "text").collect() for ids in [encode(r.text)] for s in range(0, len(ids), 4096))
        assert parts == wanted
        for r in written.collect():
            assert len(r.input_ids) == 2 * 4096 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 4096
            assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == r.n_segments
    assert packed_rows(docs(spark, []), NAME).count() == 0


def test_capacity_tree_takes_the_tightest():
    tree = CapacityTree(10)
    for bin_, space in enumerate((3, 7, 5)):
        tree.put(space, bin_)
    assert tree.take(4) == (2, 5) and tree.take(4) == (1, 7) and tree.take(4) is None and tree.take(3) == (0, 3)
    assert fill([6, 4, 5, 5], 10) == [[0, 1], [2, 3]] or sorted(map(sorted, fill([6, 4, 5, 5], 10))) == [[0, 1], [2, 3]]


def test_fill_does_not_depend_on_partitions(spark, small, encode):
    table = read(spark, small, "documents")
    least = bound(np.array([min(4096, n - s) for r in table.select("text").collect() for n in [len(encode(r.text))] for s in range(0, n, 4096)]), 4096)
    for n in (1, 64):
        rows = packed_rows(table.repartition(n), NAME, TokenRules(buffer_tokens=200_000)).collect()
        assert len({r.sequence_id for r in rows}) == len(rows) <= 1.03 * least + 1


def test_null_ids_are_packed(spark, encode):
    table = spark.createDataFrame([(None, "a few words"), (None, None), (3, "x")], "doc_id long, text string")
    check_packing(pack_documents(table.where("doc_id = 3"), NAME).collect(), [(3, encode("x"))])
    assert sorted(map(str, ((r.doc_id, r.length) for r in pack_documents(table, NAME).collect()))) == sorted(["(None, 4)", "(None, 1)", f"(3, {len(encode('x'))})"])
    assert sum(len(r.doc_ids) for r in packed_rows(table, NAME).collect()) == 3
