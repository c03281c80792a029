import random
import re
from collections import Counter

import xxhash

from tests.llm.helpers import docs, read
from tidemark.llm.components import components
from tidemark.llm.simhash import near_duplicates, near_links


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """By doc_id: the smallest id that links reach, comparing all fingerprints with all."""
    prints = sorted({fp for _, fp in pairs})
    root = {fp: fp for fp in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, fp in pairs:
        least[find(fp)] = min(i, least.get(find(fp), i))
    return Counter((i, f"{fp:016x}", least[find(fp)]) for i, fp in pairs)


def test_same_as_brute_force(spark, tiny, small):
    for table in (docs(spark), read(spark, tiny, "documents"), read(spark, small, "documents")):
        pairs = [(r.doc_id, plain_fingerprint(r.text)) for r in table.select("doc_id", "text").collect()]
        assert Counter(map(tuple, near_duplicates(table).collect())) == plain_components(pairs)


def test_planted_differences_and_dense_groups(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(200)]
    for k in range(300):  # one dense group, and chains at every distance up to 6
        prints.append(prints[0] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
        prints.append(rng.choice(prints) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(3, 6))))
    prints = sorted(set(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    number = {signed(fp): k for k, fp in enumerate(prints)}
    links = near_links(spark.createDataFrame([(x,) for x in number], "fp long")).collect()
    edges = spark.createDataFrame([(number[r.a], number[r.b]) for r in links], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    expected = {i: root for i, _, root in plain_components(list(enumerate(prints)))}
    assert {i: got.get(i, i) for i in expected} == expected


def test_empty_table(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
