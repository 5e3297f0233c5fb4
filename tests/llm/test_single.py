"""Archives, classifier, token counts, personal data and exact search."""

import base64
import gzip
import hashlib
import io
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from sitegrain import tables
from sitegrain.llm import nearest, personal_data, quality, token_counts, warc
from sitegrain.llm.tokens import vocabulary_path


def brute_archive(pages, least=0):
    body = {k: (html or "").encode() for k, (_, html) in enumerate(pages)}
    top = {}
    for k, (page, _) in enumerate(pages):
        top[body[k]] = max((p for p in (top.get(body[k]), page) if p is not None), default=None)
    out = Counter()
    for k, (page, _) in enumerate(pages):
        again = len(body[k]) >= least and top[body[k]] is not None and page != top[body[k]]
        out[(page, len(body[k]), base64.b32encode(hashlib.sha1(body[k]).digest()).decode(), "revisit" if again else "response", top[body[k]] if again else None)] += 1
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    pages = [(1, "<p>é</p>"), (2, None), (3, ""), (4, "<p>é</p>"), (5, "x" * 3_000_000), (6, "abc"), (7, "abc"), (7, "abc"), (None, "abc"), (None, "lone"), (9, "a\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(p, f"http://h/{p} x", h, "clash") for p, h in pages], "page_id long, url string, html string, payload string").repartition(3)
    rows = warc.archive_pages(df, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, rows)) == brute_archive(pages, least)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_members_are_found_by_the_index(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    made = warc.normalise(warc.write_monolithic(warc.records_of(df))).first().asDict()
    entries = [json.loads(x) for x in open(made["index"])]
    data = open(made["path"], "rb").read()
    assert made["records"] == 20 and sum(e["length"] for e in entries) == len(data) and len({e["id"] for e in entries}) == 20
    for e in entries[::-1]:
        ((fields, block),) = warc.read_records(io.BytesIO(zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], warc.GZIP)))
        assert fields["warc-record-id"] == [e["id"]] and block.startswith(b"HTTP/1.1 200 OK\r\n") and b"\r\n\r\npage " in block


def test_records_have_what_the_standard_asks():
    response = warc.format_record(4, "http://h/a b", b"<p>", warc.payload_digest(b"<p>"), 3, None, False, "2024-01-02T03:04:05Z")
    revisit = warc.format_record(3, None, b"", warc.payload_digest(b"<p>"), 3, 4, True, "2024-01-02T03:04:05Z")
    (a, block), (b, head) = warc.read_records(io.BytesIO(response + revisit))
    for fields in (a, b):
        assert {"warc-type", "warc-record-id", "warc-date", "content-length", "content-type"} <= fields.keys() and all(len(v) == 1 for v in fields.values())
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["warc-record-id"][0])
    assert b["warc-refers-to"] == a["warc-record-id"] != b["warc-record-id"] and a["warc-target-uri"] == ["http://h/a%20b"] and "warc-target-uri" not in b
    assert block.endswith(b"Content-Length: 3\r\n\r\n<p>") and head.endswith(b"Content-Length: 3\r\n\r\n")
    assert warc.record_id(None, "x") != warc.record_id(None, "x")


def test_foreign_archives_keep_every_byte(spark, tmp_path):
    records = [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Odd:  two  spaces \r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 5\r\n\r\na: b\n",
        b"WARC/1.1\nwarc-type: resource\nX-Folded: one\n  two\nContent-Length: 0\n\n",
        b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 0\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3000000\r\n\r\n" + b"long " * 600_000,
    ]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"\r\n\r\n".join([*records, b""])))
    made = warc.normalise(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),), (None,)], "path string"))
    row = made.first()
    assert gzip.decompress(open(row.path, "rb").read()) == b"\r\n\r\n".join([*records, b""])
    rows = warc.read_members(made, with_block=True).collect()
    assert [(r.record_type, r.payload_bytes, r.page_id) for r in rows] == [("warcinfo", 5, None), ("resource", 0, None), ("revisit", None, None), ("resource", 3_000_000, None)]
    assert [r.block for r in rows[:3]] == [b"a: b\n", b"", b""] and rows[0].payload_digest == warc.payload_digest(b"a: b\n")
    for bad in (b"HTTP/1.1\r\n\r\n", b"WARC/1.1\r\nA: b\r\n", b"WARC/1.1\r\nA: b\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


def test_a_damaged_response_is_told():
    data = warc.format_record(1, "u", b"abc", warc.payload_digest(b"abd"), 3, None, False)
    ((fields, block),) = warc.read_records(io.BytesIO(data))
    with pytest.raises(ValueError):
        warc._row(fields, block, True)


def test_pages_that_share_a_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 20)
    pages = [(i, "" if i % 3 else f"own {i}") for i in range(900)]
    df = spark.createDataFrame([(p, f"u{p}", h) for p, h in pages], "page_id long, url string, html string").repartition(3)
    rows = warc.archive_pages(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, rows)) == brute_archive(pages)


def test_inflated_reads_members_and_tells_damage():
    data = random.Random(1).randbytes(3_000_000)
    packed = b"".join(gzip.compress(data[i : i + 1_000_000], 1) for i in range(0, 3_000_000, 1_000_000))
    assert io.BufferedReader(warc.Inflated(io.BytesIO(packed)), 1 << 20).read() == data
    with pytest.raises(ValueError):
        io.BufferedReader(warc.Inflated(io.BytesIO(packed[:-50]))).read()


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(out) > 80 and sum(p == t for p, t in out) / len(out) >= 0.97
    assert not [1 for p, t in out if t == 1 and p == 0]


def test_classifier_of_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 1), (None, 1), (5, None), (5, 0), (6, 0), (9, 1), (99, 0)], "doc_id long, quality int")
    for own in (labels, labels.limit(0), labels.where("quality = 1")):
        kept = quality.keep_good(odd, own)
        assert kept.columns == odd.columns and kept.count() <= odd.count() and {r.score for r in kept.collect()} <= {"c"}
    assert quality.classify(none, labels).count() == 0
    assert all(math.isfinite(r.score) for r in quality.classify(odd, labels).collect())
    assert quality.keep_good(odd, labels.limit(0)).count() == odd.count()


def small_model(seed=0):
    draw = np.random.default_rng(seed)
    model = quality.AttentionModel(features=5, hidden=4, gate=3, buckets=6)
    model.p = {k: draw.normal(size=v.shape) for k, v in model.p.items()}
    model.mean, model.scale = draw.normal(size=5), draw.uniform(0.5, 2, 5)
    bags = quality.Bags(draw.normal(size=(9, 5)), draw.integers(0, 6, 17), np.array([3, 0, 4, 1, 0, 2, 5, 0, 2]), np.array([2, 1, 6]))
    return model, bags


def test_scores_are_those_of_plain_loops():
    model, bags = small_model()
    p, row, word = model.p, 0, 0
    for count, score in zip(bags.counts, model.score(bags)):
        hidden, logits = [], []
        for _ in range(count):
            x = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(bags.x[row], model.mean, model.scale)]
            own = bags.words[word : word + bags.sizes[row]]
            h = [math.tanh(sum(x[i] * p["E"][i][j] for i in range(5)) + sum(p["W"][w][j] for w in own) / max(1, len(own)) + p["e"][j]) for j in range(4)]
            gate = [math.tanh(sum(h[j] * p["V"][j][k] for j in range(4))) / (1 + math.exp(-sum(h[j] * p["U"][j][k] for j in range(4)))) for k in range(3)]
            hidden.append(h)
            logits.append(sum(g * v for g, v in zip(gate, p["g"])))
            row, word = row + 1, word + len(own)
        weights = [math.exp(v) / sum(map(math.exp, logits)) for v in logits]
        z = [sum(w * h[j] for w, h in zip(weights, hidden)) for j in range(4)]
        assert score == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"])) + p["b"][0]))))
    assert np.allclose(np.add.reduceat(model.attention(bags), np.cumsum(bags.counts) - bags.counts), 1)


def test_gradients_are_right():
    model, bags = small_model(1)
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := model._forward(bags)["y"]) + (1 - y) * np.log(1 - p))
    for name, grad in model._gradients(bags, y).items():
        flat = model.p[name].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 8)):
            keep, flat[i] = flat[i], flat[i] + 1e-6
            high = loss()
            flat[i] = keep - 1e-6
            low = loss()
            flat[i] = keep
            assert abs((high - low) / 2e-6 - grad.reshape(-1)[i]) < 1e-5


def test_bags_of_some_texts():
    texts = ["a b a", None, "", "x" * 1300 + " yy zz", "é " * 400]
    whole = quality.passages(pa.array(texts))
    assert whole.counts.tolist() == [1, 1, 1, 3, 3] and whole.sizes.sum() == len(whole.words) and whole.x.shape == (9, quality.FEATURES)
    for i, text in enumerate(texts):
        one, own = quality.passages(pa.array([text], pa.string())), whole.some(np.array([i]))
        assert (one.x == own.x).all() and one.words.tolist() == own.words.tolist() and one.sizes.tolist() == own.sizes.tolist()
    assert whole.some(np.array([0])).words.tolist()[0] == whole.some(np.array([0])).words.tolist()[2]


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * 50 if i % 2 else "### $$$ " * 30, "x") for i in range(300)] + [(300, "long " * 5000, "x")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(301)], "doc_id long, quality int")
    assert quality.train(docs, labels, sample_bytes=400) is None or quality.train(docs, labels, sample_bytes=400)
    model = quality.train(docs, labels, sample_bytes=10_000)
    assert model is not None and np.abs(model.p["W"]).sum() > 0


def test_sizes_alone_meet_in_one_task(spark):
    """A doc_id that repeats with other texts fills the sample, and no more; no text goes through the window over the sample."""
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    many = spark.createDataFrame([(a, f"### {i}") for i in range(500)] + [(b, "good words here")] * 300 + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, 0), (b, 1)], "doc_id long, quality int")
    sizes = []
    fit = quality.AttentionModel.fit
    try:
        quality.AttentionModel.fit = lambda self, bags, y, **k: (sizes.append(Counter(y.tolist())), fit(self, bags, y, **k))[1]
        assert quality.train(many, labels, sample=100) is not None or sizes == []
        assert quality.train(many, labels) is not None
    finally:
        quality.AttentionModel.fit = fit
    assert sizes[-1] == {0.0: 500, 1.0: 1} and all(sum(c.values()) <= 100 for c in sizes[:-1])


@pytest.fixture(scope="module")
def unigram():
    pieces, unknown = token_counts.pieces_of(vocabulary_path("piece_bpe_32k.model"))
    return pieces, unknown


def library_counts(pieces, unknown, texts):
    tokenizer = Tokenizer(models.Unigram(pieces, unknown, False))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_token_counts(unigram):
    draw = random.Random(3)
    bits = ["a", "the", "é", " ", "  ", "\n", "▁", "ing", "漢字", "1", ".", "!!", "😀", "\x00", "don't"]
    texts = ["", " ", "▁", " a", *("".join(draw.choice(bits) for _ in range(draw.randint(0, 20))) for _ in range(600))]
    assert token_counts.CountingViterbi(*unigram, capacity=20).count(pa.array(texts)).tolist() == library_counts(*unigram, texts)


def test_token_counts_on_ties():
    draw = random.Random(4)
    pieces = [("<unk>", 0.0), *((p, float(-len(p))) for p in ("▁", "a", "b", "ab", "ba", "aba", "▁a", "bb", "▁ab"))]
    texts = ["".join(draw.choice("abc ") for _ in range(draw.randint(0, 14))) for _ in range(1500)]
    assert token_counts.CountingViterbi(pieces, 0).count(pa.array(texts)).tolist() == library_counts(pieces, 0, texts)


def test_token_counts_of_odd_documents(spark, odd, none, unigram):
    rows = token_counts.count_tokens(odd, vocabulary_path("piece_bpe_32k.model")).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = Counter(zip([d for d, _ in texts], library_counts(*unigram, [t for _, t in texts])))
    assert Counter(map(tuple, rows)) == want
    assert token_counts.count_tokens(none, vocabulary_path("piece_bpe_32k.model")).count() == 0


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}


def brute_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (rx, ok) in KINDS.items() for m in re.finditer(rx, text or "", re.A) if ok(m.group())]


def personal_row(r, text):
    base = brute_spans(text)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(k + ":") for b in base) for k in KINDS)
    assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert r.spans.split(",")[: len(base)] == (base or r.spans.split(",")[:0])


def test_personal_data(spark):
    draw = random.Random(8)
    bits = ["a", "B.", "@", "x@y.com", ".", "1.2.3.4", "300.1.1.1", "00001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", " ", "-", "+", "+1 (555) 123-4567", "+49 30", "é", "😀", "\x01", "\n", "7", "(", "a@b.c_d@e.f", "GB82 WEST 1234 5698 7654 32", "99999999999999999999.1.1.1"]
    texts = ["", None, "a@b.c_d@e.f", "x.@y..z", "+12(((((", "card 4111-1111-1111-1111.", *("".join(draw.choice(bits) for _ in range(draw.randint(1, 14))) for _ in range(800))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data.digest(personal_data.find_personal_data(df)).collect():
        personal_row(r, texts[r.doc_id])


def test_added_kinds_and_context(spark):
    texts = ["pay to GB82 WEST 1234 5698 7654 32 now", "GB82 WEST 1234 5698 7654 33", "my SSN is 123-45-6789.", "part 123-45-6789"]
    rows = personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in rows] == [[("iban", 7, 34)], [], [("ssn", 10, 21)], []]


def near_context(text, start, end, words):
    return any(re.search(rf"(?:^|[^a-z])(?:{words})", side.lower()) for side in (text[max(0, start - 32) : start], text[end : end + 32]))


def test_scores_look_on_both_sides(spark):
    draw = random.Random(5)
    bits = ["ssn ", "123-45-6789", " ", "; ", "é", "a@b.co", "mail", "1.2.3.4", "host ", "4111 1111 1111 1111", "visa", " and some more words ", "+1 (555) 123-4567", "call", "22", "7 "]
    texts = ["111-11-1111 is my SSN", "ssn " + " ".join(f"{i}11-11-1111" for i in range(1, 8)), *("".join(draw.choice(bits) for _ in range(draw.randint(1, 40))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data.find_personal_data(df).collect():
        want = []
        for kind, (rx, ok) in (KINDS | {"ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: True)}).items():
            for m in re.finditer(rx, r.text, re.A):
                score = personal_data.PRIOR[kind] + 0.3 * near_context(r.text, m.start(), m.end(), personal_data.NEARBY[kind])
                if ok(m.group()) and score >= 0.5:
                    want.append((kind, m.start(), m.end(), pytest.approx(score)))
        assert [tuple(s) for s in r.spans if s.kind != "iban"] == want, r.text
    row = personal_data.digest(personal_data.find_personal_data(df.where("doc_id = 0"))).first()
    assert row.spans == "ssn:0:11" and row.scores == "0.6"


def test_long_texts_take_time_in_proportion(spark):
    took = []
    for n in (4_000, 16_000):
        df = spark.createDataFrame([(0, "mail x@y.com or 10.0.0.1, " * n)], "doc_id long, text string")
        began = time.perf_counter()
        (row,) = personal_data.redact(df).collect()
        took.append(time.perf_counter() - began)
        assert row.text == "mail [EMAIL] or [IP], " * n
    assert took[1] < 9 * took[0]


def test_redacting_twice_changes_nothing(spark):
    draw = random.Random(6)
    bits = ["ssn ", "123-45-6789", " ", "-", "a@b.co", "1.2.3.4", "4111111111111111", "+", "5", "GB82WEST12345698765432", "é", "."]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 25))) for _ in range(300)] + ["", None]
    once = personal_data.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert not [r for r in once.collect() if brute_spans(r.text)]
    assert sorted(map(tuple, personal_data.redact(once).collect())) == sorted(map(tuple, once.collect()))


def test_redaction(spark, odd, none):
    texts = ["mail x@y.com or +4111 1111 1111 1111", "é 1.2.3.4", None, "clean", "a@b.co1.2.3.4 +1.2.3.4 5551234"]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in personal_data.redact(df).collect()}
    assert got[1] == ("é [IP]", 6) and got[2] == (None, 0) and got[3] == ("clean", 5)
    assert got[0][0].startswith("mail [EMAIL] or ") and not brute_spans(got[0][0]) and not brute_spans(got[4][0])
    out = personal_data.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and not [r for r in out.collect() if brute_spans(r.text)]
    assert {(r.spans, r.hits) for r in out.collect()} == {("b", "a")}
    clash = odd.withColumn("_safe", F.lit("s")).withColumn("_email", F.lit("e"))
    assert {(r._safe, r._email) for r in personal_data.find_personal_data(clash).collect()} == {("s", "e")}
    assert personal_data.redact(none).count() == 0


def test_personal_data_of_odd_documents(spark, odd):
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    for r in personal_data.digest(personal_data.find_personal_data(odd)).collect():
        if r.doc_id is not None:
            personal_row(r, texts[r.doc_id])


def clamped(s):
    return min((1 << 63) - 1, max(-(1 << 63), s))


def brute_top(rows, k=5, every=50, narrow=True):
    number = lambda x: clamped(math.floor(256 * (float(np.float32(x)) if narrow else x)))
    kept = [(n, i, [number(x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, v in kept:
        if q % every == 0:
            found = sorted((-clamped(sum(a * b for a, b in zip(v, w))), i) for m, i, w in kept if m != n and len(w) == len(v))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, dims, shard_rows", [(0, 3, 40), (1, 16, 1 << 15), (2, 1, 64)])
def test_exact_search(spark, seed, dims, shard_rows):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([draw.uniform(-1, 1), 0.5]) for _ in range(dims)]) for i in range(700)]
    rows += [(i, [0.25] * dims) for i in range(700, 1000)]  # one common vector
    rows += [(1000, None), (1050, [None] * dims), (1100, [float("nan")] * dims), (1150, [float("inf")] * dims), (1200, []), (1201, []), (1250, [1.0] * (dims + 1)), (None, [1.0] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(3)
    index = nearest.build_index(nearest.quantised(df), leaf=16, shard_rows=shard_rows)
    for cells in (1, 7, 40):
        got = nearest.search(index, nearest.indexed_queries(index, 50, 5), 5, group=7, cells=cells)
        assert sorted(map(tuple, got.collect())) == brute_top(rows)
    assert sorted(map(tuple, nearest.top_k(df).collect())) == brute_top(rows)
    assert nearest.top_k(df.limit(0)).count() == 0


def test_few_shards_are_opened(spark):
    """Vectors in clusters, each in some directions: a group of queries opens the shards that can serve one of them, and its stripe's one file of boxes."""
    draw = np.random.default_rng(0)
    centres = draw.standard_normal((24, 16))
    centres *= 30 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, (centres[i % 24] + 0.3 * draw.standard_normal(16)).tolist()) for i in range(4800)] + [(i, centres[0].tolist()) for i in range(4800, 6400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    index = nearest.build_index(nearest.quantised(df), leaf=16, shard_rows=64)
    shards = index.collect()
    assert len(shards) > 60 and sum(r.n for r in shards) == len(rows) and max(r.n for r in shards) <= 64
    cells = Counter(r.cell for r in shards)
    assert len(cells) > 12  # the split follows the clusters
    queries = nearest.indexed_queries(index, 50, 5).collect()
    (stripe,) = nearest._stripes(index.selectExpr("*", "0 AS s")).collect()
    group = [q.path for q in queries if q.cell == queries[0].cell]
    cell, loads = nearest._Cell(group, 5), []
    load, nearest._load = nearest._load, lambda path: loads.append(path) or load(path)
    try:
        cell.walk(stripe.path)
    finally:
        nearest._load = load
    found = cell.best_of
    able = sum(bool((cell._reach(np.array([r.lo]), np.array([r.hi]))[:, 0] >= found.least).any()) for r in shards)
    assert loads[0] == stripe.path and len(loads) == 1 + cell.opened and able <= cell.opened < len(shards) / 2


def test_queries_that_are_no_rows_of_the_index(spark):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    asked = [(i, [draw.uniform(-1, 1) for _ in range(4)]) for i in (7, 7, 400)]
    index = nearest.build_index(nearest.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), leaf=8, shard_rows=50)
    queries = nearest.given_queries(nearest.quantised(spark.createDataFrame(asked, "vec_id long, embedding array<double>")))
    whole = lambda v: [math.floor(256 * x) for x in v]
    want = []
    for q, v in asked:
        found = sorted((-sum(a * b for a, b in zip(whole(v), whole(w))), i) for i, w in rows)[:3]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    assert sorted(map(tuple, nearest.search(index, queries, 3).collect())) == sorted(want)


@pytest.mark.parametrize("copies", [2, 3, 6, 9])
def test_rows_that_repeat_a_vec_id_are_candidates_of_each_other(spark, copies):
    rows = [(0, [1.0, 1.0])] * copies + [(50, [0.1, 0.2]), (50, [0.3, 0.2])] + [(i, [0.5, i / 100]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    assert sorted(map(tuple, nearest.top_k(df).collect())) == brute_top(rows)


@pytest.mark.parametrize("size", [2.0**20, 1e9, 1e16, 1e300])
def test_search_is_exact_for_large_components(spark, size):
    draw = random.Random(int(math.log(size)))
    rows = [(i, [draw.choice([-1, 1]) * size * draw.choice([1.0, 1 + 2**-40, draw.random()]) for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    index = nearest.build_index(nearest.quantised(df), leaf=8, shard_rows=64)
    got = nearest.search(index, nearest.indexed_queries(index, 50, 5), 5).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, narrow=False)


def test_redaction_goes_on_until_nothing_is_left(spark):
    listed = " and ".join(["123-45-6789"] * 11)  # a number counts once [SSN] stands before it: one a pass
    df = spark.createDataFrame([(1, f"ssn {listed}"), (2, "ssn 123-45-6789"), (3, listed), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in personal_data.redact(df).collect()}
    assert got == {1: "ssn " + " and ".join(["[SSN]"] * 11), 2: "ssn [SSN]", 3: listed, 4: None}
