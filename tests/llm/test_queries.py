"""The registered queries, all columns, against plain versions over whole tables."""

import collections
import hashlib
import math
import struct
import zlib

import public_tokenizers
import pytest

from tests.llm.test_operators import cut, fingerprint, linked, plain_entropy_spans, plain_features, base_spans
from tokensieve.llm import quality, queries, secrets


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def rows(spark, sf_dir, name, *columns):
    return collections.Counter(tuple(r) for r in queries.QUERIES[name](spark, sf_dir).select(*columns).collect())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_op2(spark, sf_dir, texts):
    tk = library("byte_bpe_50k.json")
    tk.encode_special_tokens = True
    want = collections.Counter((i, len(tk.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    assert rows(spark, sf_dir, "op2_token_counts", "doc_id", "n_tokens") == want


def test_op4(spark, sf_dir, texts):
    tk = library("word_bpe_49k.json")
    want = collections.Counter()
    for i, t in texts:
        ids = tk.encode(t, add_special_tokens=False).ids
        want[(i, len(ids), sha(packed(ids)), sha(tk.decode(ids, skip_special_tokens=False).encode()))] += 1
    assert rows(spark, sf_dir, "op4_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op5(spark, sf_dir, texts):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    how = quality.Ftrl()
    weights, bias = quality.train(docs, labels, how)
    got = {r.doc_id: r for r in queries.QUERIES["op5_quality"](spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
        if i % 8 == 0 and len(t) < 4000:
            want = 1 / (1 + math.exp(-bias - sum(weights[k] * v for k, v in plain_features(t, how.bits).items())))
            assert math.isclose(r.score, want, abs_tol=1e-9)


def test_op7(spark, sf_dir, texts):
    want = collections.Counter()
    line = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    for i, t in texts:
        base = base_spans(t)
        want[(i, *(sum(k == n for _, k, _ in base) for n in range(3)), sha(line(base).encode()), line(sorted(base + plain_entropy_spans(t))))] += 1
    assert rows(spark, sf_dir, "op7_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == want


def test_op8(spark, sf_dir, texts):
    want = collections.Counter((i, n, gone, sha(kept.encode())) for (i, _), (n, gone, kept) in zip(texts, cut([t for _, t in texts])))
    assert rows(spark, sf_dir, "op8_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_op9(spark, sf_dir, texts):
    tk = library("byte_bpe_50k.json")
    ids = {i: [*tk.encode(t, add_special_tokens=False).ids, 1] for i, t in texts}
    at, seen = collections.Counter(), collections.defaultdict(list)
    for r in sorted(queries.QUERIES["op9_packing"](spark, sf_dir).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(packed(ids[r.doc_id][r.start : r.start + r.length]))
        seen[r.sequence_id].append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    short = 0
    for pieces in seen.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048 and not end & (end - 1)
        short += end < 2048
    assert short <= 11 * spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions()


def test_op10(spark, sf_dir, texts):
    fps = {i: fingerprint(t) for i, t in texts}
    groups = linked(set(fps.values()), 4)
    least = {}
    for i, f in fps.items():
        least[groups[f]] = min(i, least.get(groups[f], i))
    want = collections.Counter((i, f"{f:016x}", least[groups[f]]) for i, f in fps.items())
    assert rows(spark, sf_dir, "op10_simhash", "doc_id", "fingerprint", "component_id") == want
