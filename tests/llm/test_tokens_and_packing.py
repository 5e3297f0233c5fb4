import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sitegrain.llm import grammar, packing, queries
from sitegrain.llm.tokens import ChunkTokenizer, Memo, chunk_keys, vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunks_give_the_library_ids(plain):
    draw = random.Random(1)
    bits = ["a", "B", "é", "e", "́", "word", "###", "(b", "x-y.", "ñ,", "=\u0338", "<", ">", "@", "_", "~ ", " ", "\n", "\t", "|", "'s", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "ß", "Σ", "\x1c", "\xa0", "漢字", "1", "23", ". ", ", ", "!!", "😀", "\x00", "don't"]
    tokenizer = ChunkTokenizer(vocabulary_path(), capacity=50)
    for _ in range(300):
        texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 30))) for _ in range(5)]
        ids, counts = tokenizer.encode(pa.array(texts), 7)
        assert ids.tolist() == [x for t in texts for x in [*plain(t), 7]]
        assert counts.tolist() == [len(plain(t)) + 1 for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_memo_numbers_chunks(seed):
    draw = random.Random(seed)
    chunks = list({"".join(draw.choice("ab\x00é") for _ in range(draw.choice([0, 1, 3, 9, 70, 200]))) for _ in range(3000)})
    a, b = chunk_keys(pa.array(["skipped", *chunks], pa.large_string())[1:])
    assert len(set(zip(a.tolist(), b.tolist()))) == len(chunks)
    memo = Memo(bits=4)
    memo.add(a[:100], b[:100])
    memo.add(a[100:], b[100:])
    assert memo.find(a, b).tolist() == list(range(len(chunks))) and (memo.find(a, a)[a != b] < 0).all()
    kept = np.arange(1, len(chunks), 3)
    assert memo.only(kept).find(a[kept], b[kept]).tolist() == list(range(len(kept))) and (memo.only(kept).find(a[::3], b[::3]) < 0).all()


@pytest.mark.parametrize("least", [2, 3])
@pytest.mark.parametrize("seed", range(5))
def test_grammar_round_trip_and_random_access(seed, least):
    draw = np.random.default_rng(seed)
    counts = draw.integers(1, 200, 40)
    ids = draw.integers(0, [1, 3, 50, 1000, 60000][seed], int(counts.sum())).astype(np.uint32)
    data, symbols, rules = grammar.to_bytes([None, *range(1, 40)], ids, counts, 1 << 16, least=least)
    shard = grammar.Shard(io.BytesIO(data))
    ends = np.cumsum(counts)
    assert shard.doc_ids == [None, *range(1, 40)] and (shard.documents(0, 40) == ids).all()
    for k in draw.integers(0, 40, 8).tolist():
        own = ids[ends[k] - counts[k] : ends[k]]
        assert (shard.documents(k, k + 1) == own).all()
        a, b = sorted(draw.integers(0, counts[k] + 1, 2).tolist())
        assert (shard.ids(k, a, b) == own[a:b]).all() and (shard.ids(k, 0, len(own)) == own).all()
    assert symbols == shard.n_symbols <= len(ids) and (shard.lengths >= 2).all() and rules == len(shard.lengths)
    for rule, n in zip(shard.rules, shard.lengths):
        assert len(grammar.expand(rule, shard.rules, shard.lengths, 1 << 16)) == n


def pairs_of(symbols, ends):
    """How often each pair of neighbours in a document occurs without overlap."""
    count, i = Counter(), 0
    for i in range(len(symbols) - 1):
        if not ends[i]:
            count[symbols[i], symbols[i + 1]] += 1
    for (a, b), _ in list(count.items()):
        if a == b:
            count[a, a], i = 0, 0
            while i < len(symbols) - 1:
                hit = symbols[i] == symbols[i + 1] == a and not ends[i]
                count[a, a] += hit
                i += 1 + hit
    return count


@pytest.mark.parametrize("seed, kinds", [(0, 2), (1, 5), (2, 40)])
@pytest.mark.parametrize("least", [2, 3])
def test_no_pair_is_frequent_at_the_end(seed, kinds, least):
    draw = np.random.default_rng(seed)
    ids, last = draw.integers(0, kinds, 3000).astype(np.uint32), draw.random(3000) < 0.02
    last[-1] = True
    symbols, ends, rules, _ = grammar.repair(ids, last, 64, least)
    assert max(pairs_of(symbols.tolist(), ends.tolist()).values()) < least
    assert len({tuple(r) for r in rules.tolist()}) == len(rules)
    used = np.bincount(np.concatenate([symbols, rules.ravel()]).astype(int), minlength=64 + len(rules))[64:]
    assert (used >= 1).all()


def test_pairs_of_long_documents_are_found_alike():
    draw = np.random.default_rng(1)
    left, right = (draw.integers(0, 9, 500).astype(np.uint32) for _ in range(2))
    short, long = (grammar._frequent(left, right, np.arange(500) * 3, bits, 30, 4) for bits in (17, 18))
    assert (short[0] == long[0]).all() and (short[1] == long[1]).all() and (short[2] >> np.uint64(17) == long[2] >> np.uint64(18)).all()
    assert (short[0] % 3 == 0).all() and (np.bincount(short[1]) >= 4).all()


@pytest.mark.parametrize("bits", [1, 7, 17, 25, 31, 32])
def test_packed_numbers(bits):
    draw = np.random.default_rng(bits)
    x = draw.integers(0, 1 << bits, 1000).astype(np.uint32)
    data = grammar.pack(x, bits)
    assert len(data) == -(-1000 * bits // 8) and (grammar.unpack(data, 0, 1000, bits) == x).all()
    assert (grammar.unpack(data[77 * bits // 8 :], 77 * bits, 900, bits) == x[77:977]).all()
    assert (grammar.from_varints(grammar.to_varints(x)) == x).all() and not len(grammar.from_varints(b""))


def test_runs_of_one_id_compress():
    ids, last = np.zeros(1000, np.uint32), np.zeros(1000, bool)
    last[-1] = True
    symbols, ends, rules, lengths = grammar.repair(ids, last, 10)
    assert len(symbols) < 8 and (grammar.expand(symbols, rules, lengths, 10) == ids).all()


def test_files_are_smaller_than_plain_ids(plain):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text")
    tokenizer = ChunkTokenizer(vocabulary_path())
    ids, counts = tokenizer.encode(texts.combine_chunks(), 2)
    data, _, _ = grammar.to_bytes(list(range(len(counts))), ids, counts, tokenizer.size)
    assert len(data) < 0.65 * 2 * len(ids)


def check_files(rows, docs, plain):
    """Rows in order against the ids of (doc_id, text) in order."""
    start = 0
    for row, (doc_id, text) in zip(sorted(rows, key=lambda r: r.start), docs, strict=True):
        ids = [*plain(text), 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_token_files(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    check_files(queries.op5_token_files(spark, SF).collect(), docs, plain)


def test_token_files_of_odd_documents(spark, odd, none, plain):
    rows = grammar.read_tokens(grammar.write_tokens(odd, vocabulary_path(), shard_tokens=1000)).collect()
    docs = sorted(((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    check_files(rows, docs, plain)
    assert grammar.read_tokens(grammar.write_tokens(none, vocabulary_path())).count() == 0


def check_packing(rows, docs, plain, capacity=2048):
    want = Counter()
    for doc_id, text in docs:
        ids = [*plain(text), 0]
        want.update((doc_id, p // capacity, p, len(ids[p : p + capacity]), crc(ids[p : p + capacity])) for p in range(0, len(ids), capacity))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_packing(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bins, total = check_packing(queries.op3_best_fit_packing(spark, SF).collect(), docs, plain)
    assert bins <= -(-total // 2048) + 1


def test_packing_of_odd_documents(spark, odd, none, plain):
    rows = packing.pack_documents(odd, vocabulary_path()).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], plain)
    assert packing.pack_documents(none, vocabulary_path()).count() == 0
    pieces = packing.split_pieces(odd, vocabulary_path()).selectExpr("*", "1 AS _salt", "2 AS _rank", "3 AS _n", "4 AS sequence_id")
    again = packing.pack(pieces).collect()
    check_packing(again, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], plain)
    assert {(r._salt, r._rank, r._n) for r in again} == {(1, 2, 3)}


def test_sequences_hold_the_ids(spark, odd, none, plain):
    """Every document's ids stand together and in order, piece by piece, whatever ids repeat or are missing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("doc_id", "text")
    for table, capacity in ((docs, 2048), (docs.union(docs).unionByName(odd.select("doc_id", "text")), 64)):
        found = packing.sequences(table, vocabulary_path(), capacity).collect()
        want = Counter()
        for r in table.collect():
            ids = [*plain(r.text), 0]
            want.update((r.doc_id, tuple(ids[i : i + capacity])) for i in range(0, len(ids), capacity))
        assert all(len(r.ids) <= capacity for r in found) and sum(len(r.ids) for r in found) == sum(len(k) * n for (_, k), n in want.items())
        for r in found:
            left = tuple(r.ids)
            for doc in r.documents:
                piece = max((k for d, k in want if d == doc and left[: len(k)] == k and want[d, k] > 0), key=len)
                want[doc, piece] -= 1
                left = left[len(piece) :]
            assert not left
        assert not +want
    assert packing.sequences(none, vocabulary_path()).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_fullest(seed):
    draw = random.Random(seed)
    counts = {draw.randint(1, 30): draw.randint(1, 4) for _ in range(5)}
    room = draw.randint(0, 60)
    chosen = packing.fullest(sorted(counts, reverse=True), counts, room)
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    assert all(m <= counts[k] for k, m in chosen) and sum(k * m for k, m in chosen) == max(sums)


def test_plans_are_near_the_bound():
    draw = random.Random(5)
    sizes = Counter(draw.randint(1, 2048) for _ in range(5000))
    plan = packing.plan_bins(sizes, 2048)
    placed = Counter()
    for chosen, bins in plan:
        assert sum(k * m for k, m in chosen) <= 2048
        placed.update({k: m * bins for k, m in chosen})
    total = sum(b for _, b in plan)
    assert placed == sizes and total <= 1.02 * sum(k * n for k, n in sizes.items()) / 2048 + 1


@pytest.mark.parametrize("text", ["J\u030c", "x T\u0308 Y\u030a", "H\u0331 W\u030a\nJ\u0323\u030c"])
@pytest.mark.parametrize("other", ["Plain Text", "a <| b"])
def test_capitals_under_marks_give_the_library_ids(plain, text, other):
    ids, lengths = ChunkTokenizer(vocabulary_path()).encode(pa.array([text, other, "Same"]))
    want = [plain(t) for t in (text, other, "Same")]
    assert ids.tolist() == sum(map(list, want), []) and lengths.tolist() == list(map(len, want))
