"""Each operator against a brute-force version, on a corpus of awkward rows and on the smallest tables."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tokensieve.llm import ann, bpe, components, packing, quality, queries, rules, secrets, simhash, substring, tokens, urls

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def awkward_rows():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "ß", "naïve,", "it's", "中文", "😀", "x\x1cy", "a\x85b", "#$%", "<|endoftext|>"]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = some(60)
    base = some(120)
    texts = [None, "", "   ", "\n\n", "one", "a b c d", base, base, base.upper(), passage, f"{some(20)} {passage} {some(9)}", f"{passage} {passage}"]
    texts += ["same line here now\n" * 40, some(35), some(34), some(2000), "x" * 5000, f"{passage}\t{some(3)}", " ".join(["ab"] * 90)]
    texts += [base + " " + some(1) for _ in range(5)] + [some(rng.randint(1, 200)) for _ in range(15)]
    rows = [(i, t, f"host{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, passage, "host0"), (3, some(80), "host1")]


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return made.withColumns({"fp": F.lit("clash"), "host": F.lit(1), "spans": F.lit(2), "mh": F.lit(3), "n_words": F.lit(4)}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def bag(found):
    return collections.Counter(tuple(r) for r in found)


# quality rules


def base_of(text):
    w = words(text)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), dup, len(hit)


def test_rules_base(docs, rows, empty):
    got = rules.judge(docs, host="source")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = []
    for i, t, _ in rows:
        b = base_of(t)
        want.append((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert bag(got.select(names).collect()) == collections.Counter(want)
    assert rules.judge(empty, host="source").count() == 0
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert {r.doc_id for r in rules.keep_documents(docs).collect()} == kept


def test_rules_host_verdict(spark):
    good = " ".join(f"word{i}" for i in range(80))
    made = [(i, "short", "bad") for i in range(60)] + [(100 + i, good, "bad") for i in range(2)] + [(200 + i, good, h) for i, h in enumerate(["a", "b", "c", None] * 10)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.judge(df).collect()}
    assert got[100] == (False, False) and got[0] == (True, False)
    assert all(got[200 + i] == (False, True) for i in range(40))
    assert sorted(r.doc_id for r in rules.keep_documents(df).collect()) == [200 + i for i in range(40)]


def test_beta_prior():
    fit = lambda hosts, top: rules.beta_prior(len(hosts), sum(n for _, n in hosts), sum(n * n for _, n in hosts), sum(x for x, _ in hosts), sum(x * x / n for x, n in hosts), top)
    assert rules.beta_prior(0, 0, 0, 0, 0, 10) == (0.5, 0.5)
    # Hosts of two documents that differ as draws at one rate of 20 % do: nothing is between them, so they shrink to it.
    a, b = fit([(0, 2)] * 1280 + [(1, 2)] * 640 + [(2, 2)] * 80, 100)
    assert math.isclose(a / (a + b), 0.2) and math.isclose(a + b, 100)
    # Large hosts at 10 % and at 30 %: the weight of a beta of that variance, mean (1 - mean) / variance - 1.
    a, b = fit([(10_000, 100_000), (30_000, 100_000)] * 500, 1000)
    assert math.isclose(a / (a + b), 0.2) and math.isclose(a + b, 0.2 * 0.8 / 0.01 - 1, rel_tol=0.01)
    assert sum(fit([(0, 5), (0, 7)], 50)) == 50 and sum(fit([(5, 5)], 50)) == 50 and sum(fit([(1, 1), (0, 1)], 50)) == 50
    assert sum(fit([(50, 50), (0, 50)], 50)) == 1


HOST_ROWS = [("rare", 1, 1), ("mostly", 60, 100), ("below", 70, 100), ("above", 80, 100), ("bad", 40, 40), ("two", 2, 2)] + [(f"good{i}", i % 3, 30) for i in range(20)]


def host_rows():
    """Documents of hosts with so many failing of all, one text each."""
    out = []
    for host, failing, n in HOST_ROWS:
        out += [(len(out) + i, "too short" if i < failing else " ".join(f"{host}{i}x{j}" for j in range(60)), host) for i in range(n)]
    return out


def test_rules_hosts_near_the_cut(spark):
    rows_ = host_rows()
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    hosts = collections.Counter(h for _, _, h in rows_)
    failed = collections.Counter(h for _, t, h in rows_ if t == "too short")
    n = list(hosts.values())
    p = sum(failed.values()) / sum(n)
    spread = sum(hosts[h] * (failed[h] / hosts[h] - p) ** 2 for h in hosts)
    share = (spread / (p * (1 - p)) - (len(n) - 1)) / (sum(n) - sum(x * x for x in n) / sum(n) - (len(n) - 1))
    weight = min(max(1 / share - 1, 1), 100)
    gone = {h for h in hosts if (failed[h] + p * weight) / (hosts[h] + weight) > 0.7}
    assert gone == {"above", "bad", "two"} and weight < 100
    got = {r.doc_id: r.kept for r in rules.judge(df).collect()}
    assert got == {i: t != "too short" and h not in gone for i, t, h in rows_}
    kept = rules.keep_documents(df)
    assert kept.columns == df.columns and bag(kept.collect()) == collections.Counter((i, t, h) for i, t, h in rows_ if got[i])


def test_rules_hosts_in_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", host_rows())
    want = {r[0]: r[-1] for r in con.execute(f"SELECT doc_id, kept FROM ({queries.ORACLES['op1_quality_rules']})").fetchall()}
    df = spark.createDataFrame(host_rows(), "doc_id long, text string, source string")
    assert {r.doc_id: r.kept for r in rules.judge(df).collect()} == want


# token counts


def test_token_counts(docs, rows, empty, spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    want = collections.Counter((i, len(tk.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    for block, run in ((7, 1), (64, 3), (1 << 18, 512)):
        assert bag(tokens.count_documents(docs, path, block_ids=block, run_blocks=run).select("doc_id", "n_tokens").collect()) == want
    assert tokens.count_documents(empty, path).count() == 0
    with pytest.raises(ValueError):
        tokens.write_flat(docs, path, str(tmp_path), end_id=1 << 16)


def test_flat_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    for width, kind in ((2, "<u2"), (4, "<u4")):
        folder = tmp_path / str(width)
        folder.mkdir()
        files = {"a": [5, 6, 9, 9, 1, 2, 3, 9, 4], "b": [], "c": [9], "d": [1, 2, 3], "e": rng.choice([9, 1, 2], 300, p=[0.05, 0.5, 0.45]).tolist(), "f": [1] * 200 + [9]}
        want = collections.Counter()
        for name, ids in files.items():
            (folder / f"{name}.bin").write_bytes(np.array(ids, kind).tobytes() + b"x" * (name == "d"))
            ends = [i for i, x in enumerate(ids) if x == 9]
            want.update((name, n, s + 1, e - s - 1) for n, (s, e) in enumerate(zip([-1, *ends], ends)))
        for block, run in ((2, 1), (3, 4), (7, 2), (1000, 2)):
            got = tokens.count_tokens(tokens.list_files(spark, f"file://{folder}", width), end_id=9, width=width, block_ids=block, run_blocks=run).collect()
            assert collections.Counter((r.file[-5], r.ordinal, r.start, r.n_tokens) for r in got) == want


# nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(3)
    made = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(400)]
    made += [(1000 + i, made[20][1]) for i in range(60)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [float("inf")] * 8), (2080, [None] + [1.0] * 7)]
    made += [(3000, [1.0, 2.0]), (3020, [2.0, 2.0])]
    made += [(40, made[40][1]), (40, made[41][1]), (41, made[41][1]), (None, made[41][1])]  # repeated and null ids
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>").withColumn("dim", F.lit("clash"))
    ok = [(i, np.array(v)) for i, v in made if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    want = []
    for n, (q, v) in enumerate(ok):
        if q % 20 == 0:
            near = sorted((ann.exact(v[None], u[None])[0], i) for m, (i, u) in enumerate(ok) if m != n and len(u) == len(v))[:10]
            want += [(q, r, i, s) for r, (s, i) in enumerate(near, 1)]
    for block in (64, 16384):
        got = sorted(tuple(r) for r in ann.nearest(df, block_rows=block, query_rows=5 if block == 64 else 2048).collect())
        assert got == sorted(want)
    assert ann.nearest(df.where("false")).count() == 0


def test_nearest_of_huge_values(spark):
    made = [(i, [(-1.0) ** i * 10.0 ** (150 + i // 2), 1e300 if i == 9 else 1.0]) for i in range(12)] + [(20, [1.0, 1.0]), (40, [1e308, 1e308])]
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(made, "vec_id long, embedding array<double>"), k=13).collect():
        got[r.query_id].append((r.score, r.vec_id))
    vectors = dict(made)
    for q in (0, 20, 40):
        want = sorted((math.hypot(*(a - b for a, b in zip(vectors[q], v))), i) for i, v in made if i != q)
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]
        assert all(math.isclose(a, b) for (a, _), (b, _) in zip(sorted(got[q]), want))


# BPE


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t, _ in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want[(i, struct.pack(f"<{len(ids)}I", *ids), tk.decode(ids, skip_special_tokens=False))] += 1
    got = collections.Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.round_trip(docs, path).collect())
    assert got == want
    assert bpe.round_trip(empty, path).count() == 0


def test_bpe_plain_characters():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1" for c in [*range(0x600), *range(0x1E00, 0x2100), 0x3000, 0xFB01, 0x1F600]]
    texts += ["<|endoftext|> <|startoftext|>x<|endoftext|", "'S I'LL we'Re", "ab" * 3000]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(texts, path)]
    assert got == [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]


def test_bpe_very_long_words():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = ["a" * n for n in (2, 3, 255, 257, 32_000)] + ["".join(rng.choice("etaoin") for _ in range(n)) for n in (300, 4097, 100_000)] + ["é" * 5000 + " x " + "é" * 5000]
    for lockstep in (0, 48, 1 << 30):
        bpe._LOCKSTEP = lockstep
        bpe.worker_cache().pop(("bpe", path), None)
        some = texts if lockstep else texts[:4]
        got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(some, path)]
        assert got == [e.ids for e in tk.encode_batch(some, add_special_tokens=False)]
    bpe._LOCKSTEP = 48
    assert max(map(len, (w for w in bpe.worker_cache()[("words", path)] if isinstance(w, str)))) <= 256


def test_merge_is_leftmost_lowest():
    vocab = {c: i for i, c in enumerate(["a", "b", "aa", "ab", "aab"])}
    table = bpe.MergeTable(vocab, [("a", "a"), ("a", "b"), ("aa", "b")])
    ids, sizes = bpe.merge_words(np.array([0, 0, 0, 1, 0, 1, 1], np.int32), np.array([4, 2, 1]), table)
    assert ids.tolist() == [2, 3, 3, 1] and sizes.tolist() == [2, 1, 1]
    ids, sizes = bpe.merge_words(np.array([0, 0, 0, 1, 0, 1, 1] * 50, np.int32), np.array([4, 2, 1] * 50), table)
    assert ids.tolist() == [2, 3, 3, 1] * 50 and sizes.tolist() == [2, 1, 1] * 50


# quality classifier


def test_quality(spark, docs, sf_dir):
    rng = random.Random(5)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    made = [(i, " ".join(rng.choice((good if i % 2 else bad) + ["the"] * 20) for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(None, 1, 0), (7, None, 0), (8, 5, 0)], "doc_id long, quality int, toxic int")
    w, b = quality.train(df, labels)
    out = quality.classify(df, w, b).withColumn("held", quality.held_out())
    held = [r for r in out.collect() if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.collect())
    assert len(held) > 40 and sum((r.score >= 0.5) == (r.doc_id % 2) for r in held) / len(held) > 0.95
    odd = quality.classify(docs, w, b).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    w, b = quality.train(df, labels.where("false"))
    assert not w.any() and b == 0


MASK = 2**64 - 1


def plain_mix(h):
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = ((h ^ (h >> shift)) * times) & MASK
    return h ^ (h >> 31)


def plain_hash(data):
    base, total = 0x9E3779B97F4A7C15, 0
    for i, x in enumerate(data):
        total += (x + 1) * pow(base, i, 1 << 64)
    return plain_mix((total + len(data)) & MASK)


def plain_features(text, bits):
    w = [x.encode() for x in words((text or "").lower())]
    runs = [re.sub(rb"a+", b"a", re.sub(rb"0+", b"0", re.sub(rb"[a-zA-Z\x80-\xff]", b"a", re.sub(rb"[0-9]", b"0", x)))) for x in w]
    shapes = [re.sub(rb"(.)\1+", rb"\1", x, flags=re.S) for x in runs]
    h, g = [plain_hash(x) for x in w], [(plain_hash(x) + 0xE7037ED1A0B428DB) & MASK for x in shapes]
    pair = lambda v: [plain_mix((a * 0xA0761D6478BD642F + b) & MASK) for a, b in zip(v, v[1:])]
    every = h + pair(h) + pair(g) + [plain_mix(x) for x in g] + [0x8EBC6AF09C88C6E3 for a, b in zip(h, h[1:]) if a == b]
    count = collections.Counter(x >> (64 - bits) for x in every)
    return {k: 4 * math.sqrt(c / len(every)) for k, c in sorted(count.items())}


def test_quality_against_plain_ftrl(spark):
    rng = random.Random(17)
    vocab = [f"{a}{b}" for a in ("Ab", "c-", "d", "É", "12") for b in range(12)]
    made = [(i, " ".join(rng.choice(vocab[:40] if i % 3 else vocab[20:]) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(60, None), (3, "again ab"), (None, "none")]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 60, 2)] + [(2, 1), (2, 0)]
    how = quality.Ftrl(bits=12, epochs=2, max_rows=20)
    docs_ = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    w, bias = quality.train(docs_, spark.createDataFrame(labels, "doc_id long, quality int"), how)

    y = {}
    for i, q in labels:
        y[i] = min(q, y.get(i, q))
    hashes = {r.doc_id: r.h for r in spark.range(61).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h")).collect()}
    text_hash = {r.text: r.h for r in docs_.select("text", F.xxhash64("text").alias("h")).collect()}
    chosen = sorted((i for i in y if zlib.crc32(str(i).encode()) % 5), key=lambda i: (hashes[i], i))[:20]
    z, n = collections.Counter(), collections.Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= how.l1 else (math.copysign(how.l1, z[k]) - z[k]) / ((how.beta + math.sqrt(n[k])) / how.alpha + how.l2)

    feats = {i: plain_features(min((t for j, t in made if j == i), key=text_hash.get), 12) for i in chosen}
    for _ in range(2):
        for i in chosen:
            x = feats[i] | {"bias": 1.0}
            now = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(now[k] * float(np.float32(v)) for k, v in x.items())))
            for k, v in x.items():
                g = (p - y[i]) * float(np.float32(v))
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / how.alpha * now[k]
                n[k] += g * g
    assert math.isclose(bias, weight("bias"), abs_tol=1e-9) and np.count_nonzero(w) > 50
    assert np.allclose(w, [weight(k) for k in range(1 << 12)], atol=1e-9)
    got = collections.Counter((r.doc_id, round(r.score, 9)) for r in quality.classify(docs_, w, bias, how).collect())
    assert got == collections.Counter((i, round(1 / (1 + math.exp(-bias - sum(weight(k) * v for k, v in plain_features(t, 12).items()))), 9)) for i, t in made)
    tight = quality.train(docs_, spark.createDataFrame(labels, "doc_id long, quality int"), quality.Ftrl(bits=12, epochs=2, max_rows=20, max_features=1))
    one = quality.fit([(np.array(list(feats[chosen[0]])), np.array(list(feats[chosen[0]].values()), np.float32))], [y[chosen[0]]], how)
    assert np.allclose(tight[0], one[0])
    w, bias = quality.train(docs_.where("false"), spark.createDataFrame(labels, "doc_id long, quality int"), how)
    assert not w.any() and bias == 0 and quality.classify(docs_.where("false"), w, bias, how).count() == 0


def test_quality_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum((r.score >= 0.5) == bool(r.quality) for r in got) / len(got)
    assert right > 0.9


# URL filters


def test_urls(spark):
    def host_path(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]

    def rule(h, p):
        fit = [r for r in queries.URL_RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        return max(fit, key=lambda r: len(r.text)) if fit else None

    made = [None, "", "no scheme", "http://a.com", "http://A.Com/x", "https://EXAMPLE.com/en/1?q#f", "https://www.example.com/en/9", "http://x.net/es/", "http://x.net/e", "http://n.net/fr/2#z", "ftp://u@h:8/p/q", "a://b://c/d", "http://com/", "http://com.net/es/x", "http://q?x=1", "http://exampleÉ.com/en/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(made)] + [(0, made[4], "")], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, queries.URL_RULES).collect())
    want = collections.Counter()
    for i, u in [*enumerate(made), (0, made[4])]:
        h, p = host_path(u)
        r = rule(h, p)
        want[(i, h, p, r and r.text, r.verdict if r else "allow")] += 1
    assert got == want
    assert urls.judge(df.where("false"), queries.URL_RULES).count() == 0


def test_url_aliases(spark):
    link = "<link rel='canonical' href='{}'>".format
    jump = '<meta http-equiv="refresh" content="0; url={}">'.format
    made = [
        (1, "http://a.org/1", link("http://x.net/es/1")),
        (2, "http://a.org/2", jump("http://a.org/1#top")),
        (3, "http://a.org/3", "<p>nothing</p>"),
        (4, "http://b.org/1", link("http://x.net/fr/1") + link("http://fine.com/1")),
        (5, "http://c.org/d/1", jump("2")),
        (6, "http://c.org/d/2", jump("//y.net/es/")),
        (7, "http://ok.com/7", link("http://x.net/es/1")),
        (8, "http://a.org/2", None),
    ]
    df = spark.createDataFrame(made, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(df.where("page_id <> 7"), queries.URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 8: "block"}
    got = {r.page_id: r.verdict for r in urls.judge(df, queries.URL_RULES).collect()}
    assert got[1] == got[2] == got[7] == "allow"
    more = spark.createDataFrame([("http://a.org/3", "http://z.net/fr/"), (None, "http://a.org/3")], "u string, v string")
    assert {r.page_id: r.verdict for r in urls.judge(df, queries.URL_RULES, more).collect()}[3] == "block"


#: Link target, page, the absolute URL that RFC 3986 gives (5.4 for the first page); null where there is none.
RESOLVED = [
    *[(t, "http://a/b/c/d;p?q", f"http://a{u}") for t, u in [
        ("g", "/b/c/g"), ("./g", "/b/c/g"), ("g/", "/b/c/g/"), ("/g", "/g"), ("?y", "/b/c/d;p?y"), ("g?y", "/b/c/g?y"), (";x", "/b/c/;x"), ("g;x?y#s", "/b/c/g;x?y"),
        (".", "/b/c/"), ("./", "/b/c/"), ("..", "/b/"), ("../g", "/b/g"), ("../..", "/"), ("../../g", "/g"), ("../../../g", "/g"), ("/./g", "/g"), ("/../g", "/g"), ("g.", "/b/c/g."),
        ("..g", "/b/c/..g"), ("./../g", "/b/g"), ("g/./h", "/b/c/g/h"), ("g/../h", "/b/c/h"), ("g;x=1/../y", "/b/c/y"), ("g?y/../x", "/b/c/g?y/../x"), ("#s", "/b/c/d;p?q"),
    ]],
    ("//g", "http://a/b/c/d;p?q", "http://g/"), ("HTTPS://X.org/A/../B", "http://a/b", "http://x.org/B"), ("mailto:me@x.org", "http://a/b", None), ("javascript:go()", "http://a/b", None), ("", "http://a/b", None),
    ("block.net/fr/x", "http://h.test", "http://h.test/block.net/fr/x"), ("?x=1", "http://h.test/a/b", "http://h.test/a/b?x=1"), ("/go?to=http://x.net/fr/", "http://h.test/a", "http://h.test/go?to=http://x.net/fr/"),
    ("n?a=1&amp;b=2", "http://h.test/a/b", "http://h.test/a/n?a=1&b=2"), ("x", "http://h.test/a/./b/../c", "http://h.test/a/x"),
]


def test_links_resolve(spark):
    df = spark.createDataFrame(RESOLVED, "t string, u string, want string")
    got = df.select("t", "u", urls.node_of(urls.resolve(urls._unescape(F.col("t")), F.col("u"))).alias("got"), urls.node_of(F.col("want")).alias("want")).collect()
    assert [(r.t, r.u, r.got) for r in got] == [(r.t, r.u, r.want) for r in got]


def test_linked_pages_in_sql(spark):
    import duckdb

    made = [(i, u, f'<link rel="canonical" href="{t}">') for i, (t, u, _) in enumerate(RESOLVED)]
    made += [(100, "http://site.org/1", "<meta http-equiv=refresh content='0;url=/old/../2'>"), (101, "http://site.org/2", '<LINK REL=canonical HREF="http://foreign.net/es/x">'), (102, "http://site.org/3", '<link rel=canonical href="./2">')]
    made += [(103, "http://free.org/", '<link rel=canonical href="http://foreign.net/fr/">'), (104, "http://free.org/", '<meta http-equiv=refresh content="1; url=http://good.com/">'), (105, None, "x"), (106, "http://lone.org/", None)]
    df = spark.createDataFrame(made, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(df, queries.URL_RULES).collect()}
    assert [got[i].verdict for i in range(100, 107)] == ["block", "block", "block", "allow", "allow", "allow", "allow"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", made)
    assert bag(got.values()) == collections.Counter(con.execute(queries.ORACLES["op6_url_filter"]).fetchall())


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)] + [(2000 + i, 2001 + i) for i in range(40)] + [(None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# secret scans

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets_base(spark, docs, sf_dir):
    odd = ["password: hunter22", "PASSWD='abc' token = \"abcdef-123\"", "secret=tiny api_key:0123456789", "password:token :abcdefg", "ſecret=abcdefgh toKen:abcdefg", "😀 AKIA" + "Z9" * 10, "AKIAAKIA", "f" * 24 + "g" + "0" * 23, "token=" + "0a" * 14]
    odd += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in secrets.scan(df).collect():
        want = base_spans(odd[r.doc_id])
        assert r.base == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]
        assert set(r.base.split(",")) <= set(r.spans.split(","))
    assert secrets.scan(docs).count() == docs.count()


def test_secrets_entropy():
    def brute(text, n):
        n = min(n, len(text))
        return max(-sum(c / n * math.log2(c / n) for c in collections.Counter(text[i : i + n]).values()) for i in range(len(text) - n + 1))

    rng = random.Random(1)
    for _ in range(50):
        s = "".join(rng.choice("abcdef0123") for _ in range(rng.randint(1, 60)))
        assert math.isclose(secrets.window_entropy(s, 20), brute(s, 20), abs_tol=1e-9)
    key = "q7Rz0LmX4vTn9KbW2yHs8PdE"
    assert secrets.find_spans(f"use {key} now")[1] == [(4, 3, 4 + len(key))]
    for calm in ("gelicheinkeitberheitunglich", "2024-01-01-2024-01-02-2024", "example1234567890abcdefghij", "some-long-file-name-of-words-2", "0" * 40 + "x"):
        assert secrets.find_spans(f"see {calm} .")[1] == secrets.find_spans(f"see {calm} .")[0]
    assert secrets.mask("ab SECRET cd", [(3, 0, 9)]) == "ab [SECRET] cd"
    behind = f"//example/host/{key} and {key}/sample-file-of-words/x"
    assert [behind[s:e] for s, _, e in secrets.find_spans(behind)[1]] == [f"host/{key}", key]
    mixed = "QwErTyUiOpAsDfGhJkLzXcVb"
    assert secrets.find_spans(mixed)[1] == [(0, 3, len(mixed))] and not secrets.find_spans("Rechtsschutzversicherungsgesellschaften")[1]


def entropy_of(text, n=20):
    return max(-sum(c / n * math.log2(c / n) for c in collections.Counter(text[i : i + n]).values()) for i in range(len(text) - n + 1))


def plain_entropy_spans(text):
    """Entropy spans, looked for one by one."""
    taken, out, at = base_spans(text), [], 0
    for run in re.split("([^A-Za-z0-9+/_=-]+)", text):
        start, at = at, at + len(run)
        if len(run) < 20 or re.fullmatch("[^A-Za-z0-9+/_=-]+", run) or any(s < at and start < e for s, _, e in taken):
            continue
        parts, places = re.split("[/=]", run), [0]
        for p in parts:
            places.append(places[-1] + len(p) + 1)
        bad = [any(w in p.lower() for w in ("example", "sample", "dummy", "placeholder", "xxxx", "0000", "1234567")) for p in parts]
        i = 0
        while i < len(parts):
            j = i
            while j < len(parts) and not bad[j]:
                j += 1
            s, e = places[i], places[j] - 1 if j > i else places[i]
            piece = run[s:e]
            i = j + 1
            if len(piece) < 20 or re.fullmatch("[0-9_=/+-]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|([A-Za-z]{2,}[0-9]{0,4}[-_/=+])+[A-Za-z]*[0-9]{0,4}", piece):
                continue
            digit, letter = any(c.isdigit() for c in piece), any(c.isalpha() for c in piece)
            if re.fullmatch("[0-9a-f]+|[0-9A-F]+", piece):
                least = 3.0
            elif digit and letter:
                least = 3.7 if piece.isalnum() else 3.9
            elif piece.isalpha() and piece.lower() != piece != piece.upper():
                least = 4.0
            else:
                continue
            if entropy_of(piece) >= least - 1e-12:
                out.append((start + s, 3, start + e))
    return out


def test_secrets_spans_against_plain(sf_dir, spark):
    rng = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz"
    key = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    make = [
        lambda: key(letters + letters.upper() + "0123456789", rng.randint(15, 40)), lambda: key("0123456789abcdef", rng.randint(18, 40)), lambda: key("0123456789ABCDEF", rng.randint(18, 40)),
        lambda: key(letters + letters.upper(), rng.randint(18, 40)), lambda: key(letters + "+/=0123456789", rng.randint(20, 60)), lambda: "token=" + key(letters, rng.randint(3, 30)), lambda: "AKIA" + key("ABC019", rng.randint(12, 20)),
        lambda: rng.choice(["example", "0000", "sample", "host"]), lambda: key(letters, rng.randint(1, 9)), lambda: "8c7e2b1a-1234-4abc-9def-0123456789ab", lambda: "some-words/of2-a_path/that/is/long",
    ]
    found = 0
    for _ in range(1500):
        text = "".join(rng.choice(make)() + rng.choice([" ", "/", "=", "", ": ", "-", "é", "\n"]) for _ in range(rng.randint(1, 12)))
        want = plain_entropy_spans(text)
        found += len(want)
        assert secrets.find_spans(text)[1] == sorted(base_spans(text) + want), text
    assert found > 500
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert secrets.find_spans(r.text)[1] == sorted(base_spans(r.text) + plain_entropy_spans(r.text))


def test_secrets_of_long_texts(spark):
    rng = random.Random(29)
    text = " ".join(f"token={rng.getrandbits(60):x}AZ {rng.getrandbits(120):X}xyz" for _ in range(20_000))
    base, spans = secrets.find_spans(text)
    assert len(text) > 900_000 and len(base) >= 20_000 and len(spans) > len(base)
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mask_documents(docs, empty):
    out = secrets.mask_documents(docs)
    assert out.columns == docs.columns and bag(out.select("doc_id").collect()) == bag(docs.select("doc_id").collect())
    assert secrets.mask_documents(empty).count() == 0


# substring dedup


def cut(texts, width=35):
    count = collections.Counter(tuple(w[i : i + width]) for w in map(words, texts) for i in range(len(w) - width + 1))
    for w in map(words, texts):
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        yield len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


def test_substring(docs, rows, empty):
    want = collections.Counter((i, *c) for (i, _, _), c in zip(rows, cut([t for _, t, _ in rows])))
    assert bag(substring.drop_repeats(docs).collect()) == want
    assert substring.drop_repeats(empty).count() == 0
    kept = substring.cut_documents(docs)
    full = [(i, (c[2] if c[1] else t)) for (i, t, _), c in zip(rows, cut([t for _, t, _ in rows])) if not c[1] or c[2]]
    assert bag(kept.select("doc_id", "text").collect()) == collections.Counter(full)


def test_substring_small_windows(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.drop_repeats(df, width=6, anchor=3).collect()}
    assert got == dict(enumerate(cut(texts, 6)))


def test_substring_many_texts_of_one_doc_id(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passages = [some(50) for _ in range(20)]
    texts = [some(rng.randint(1, 90)) for _ in range(700)] + [f"{some(rng.randint(0, 60))} {rng.choice(passages)} {some(rng.randint(0, 60))}" for _ in range(700)]
    df = spark.createDataFrame([(None if i % 2 else 4, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert df.select("doc_id", F.xxhash64("text").bitwiseAND(0x7FFF)).distinct().count() < len(texts)
    want = list(zip([None if i % 2 else 4 for i in range(len(texts))], cut(texts)))
    assert bag(substring.drop_repeats(df).collect()) == collections.Counter((i, *c) for i, c in want)
    full = [(i, c[2] if c[1] else t) for (i, c), t in zip(want, texts) if not c[1] or c[2]]
    assert bag(substring.cut_documents(df).select("doc_id", "text").collect()) == collections.Counter(full)


def test_substring_words_of_one_rolling_hash(spark):
    # A polynomial hash modulo 2**64 can't tell a Thue-Morse word from its complement; the words themselves are compared.
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("ab"[x ^ flip] for x in thue) for flip in (0, 1))
    rest = [f"r{i}" for i in range(40)]
    texts = [" ".join(rest[:20] + [x] + rest[20:34]) for x in (a, b)] + [" ".join([a, *rest[:34]]), " ".join([a, *rest[:34]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in substring.drop_repeats(df).orderBy("doc_id").collect()] == [0, 0, 35, 35]


def test_substring_spans_of_another_text_dont_count():
    import pyarrow as pa

    texts = ["a b c d e f", "a b x", None]
    whole = substring._Words(["b c d e"]).digests(np.array([0]), np.array([4]))[0]
    at = (2 << substring._START) | 1
    spans = pa.array([[{"at": at, "sig": whole}, {"at": at - 1, "sig": whole}], [{"at": at, "sig": whole}], None], pa.list_(pa.struct([("at", pa.int64()), ("sig", pa.binary())])))
    assert substring._cut(texts, spans, 3) == [(6, 2, "a f"), (3, 3, "a b x"), (0, 0, "")]


def test_substring_parameters(docs):
    for width, anchor in ((400, 16), (10, 11), (10, 0)):
        with pytest.raises(ValueError):
            substring.drop_repeats(docs, width=width, anchor=anchor)
    assert substring._reach(255 + 15, 16) == 255


# packing


def check_pieces(found, want, size):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_seq[r.sequence_id].append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
    padding = sum(0 if (n := sum(r.length for r in s)) & (n - 1) == 0 else size - n for s in by_seq.values())
    total = collections.Counter()
    for r in found:
        total[r.doc_id] += r.length
    assert total == want
    return padding


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    found = packing.pack_documents(docs, path, packing.Limits(tokens=256, open_bins=4)).collect()
    ids = [(i, [*tk.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in rows]
    want = collections.Counter()
    for i, x in ids:
        want[i] += len(x)
    assert check_pieces(found, want, 256) == 0
    lengths = collections.Counter()
    for r in found:
        lengths[r.sequence_id] += r.length
    assert sum(n < 256 for n in lengths.values()) <= 8 * docs.rdd.getNumPartitions()
    whole = collections.defaultdict(list)
    for i, x in ids:
        whole[i].append(x)
    for r in found:
        piece = list(struct.unpack(f"<{r.length}I", r.ids))
        assert any(len(x) == r.doc_tokens and x[r.start : r.start + r.length] == piece for x in whole[r.doc_id])
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_limits():
    rng = random.Random(3)
    items = [(i, rng.randint(1, 700), rng.randint(0, 50)) for i in range(300)]
    limits = packing.Limits(tokens=128, segments=3, loss_tokens=100, open_bins=8)
    covered = collections.defaultdict(list)
    bare = {i: n for i, _, n in items}
    for seq in packing.pack_cuttable(items, limits):
        assert sum(p[2] for p in seq) <= 128 and len(seq) <= 3
        assert sum(max(0, s + n - max(s, bare[i])) for i, s, n in seq) <= 100
        for i, s, n in seq:
            covered[i].append((s, n))
    for i, n, _ in items:
        at = 0
        for s, m in sorted(covered[i]):
            assert s == at
            at += m
        assert at == n


def test_pack_examples(spark):
    rng = random.Random(9)
    made = [(i, rng.randint(1, 100), rng.randint(1, 4), rng.randint(0, 60)) for i in range(200)] + [(900, 500, 1, 1), (901, None, None, None)]
    df = spark.createDataFrame(made, "example_id long, n_tokens long, n_segments long, n_loss long").coalesce(2)
    limits = packing.Limits(tokens=256, segments=8, loss_tokens=100, open_bins=6)
    use = collections.defaultdict(lambda: np.zeros(3, int))
    got = {r.example_id: r.bin_id for r in packing.pack_examples(df, limits).collect()}
    assert set(got) == {m[0] for m in made} and got[900] is None and got[901] is not None
    for i, *d in made:
        if got[i] is not None:
            use[got[i]] += np.array([x or 0 for x in d])
    assert all((u <= [256, 8, 100]).all() for u in use.values())


def test_conversation_examples(spark, sf_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = spark.createDataFrame([(None, 0, "user", "x"), (900, 0, None, "hello there"), (900, 1, "Assistant", None), (900, 1, "Assistant", None), (901, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    both = turns.unionByName(odd).withColumn("bears", F.lit("clash"))
    want = {}
    for r in both.where("conv_id is not null").collect():
        n = len(tk.encode(r.text or "", add_special_tokens=False).ids) + 1
        a, b, c = want.get(r.conv_id, (0, 0, 0))
        want[r.conv_id] = (a + n, b + 1, c + n * ((r.role or "").lower() == "assistant"))
    got = {r.example_id: (r.n_tokens, r.n_segments, r.n_loss) for r in packing.conversation_examples(both, path).collect()}
    assert got == want and got[901] == (1, 1, 1)
    bins = collections.defaultdict(lambda: np.zeros(3, int))
    for r in queries.QUERIES["instruction_packing"](spark, sf_dir).collect():
        if r.bin_id is None:
            assert r.n_tokens > 2048 or r.n_segments > 64 or r.n_loss > 1536
        else:
            bins[r.bin_id] += np.array([r.n_tokens, r.n_segments, r.n_loss])
    assert bins and all((u <= [2048, 64, 1536]).all() for u in bins.values())
    assert packing.conversation_examples(both.where("false"), path).count() == 0


# SimHash


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(fps, distance):
    seen, out = set(), {}
    for s in fps:
        if s in seen:
            continue
        group, todo = {s}, [s]
        while todo:
            x = todo.pop()
            new = {y for y in fps if y not in group and (x ^ y).bit_count() <= distance}
            group |= new
            todo += new
        seen |= group
        out |= {x: frozenset(group) for x in group}
    return out


def test_simhash(docs, rows, empty):
    fps = {(i, t): fingerprint(t) for i, t, _ in rows}
    groups = linked(set(fps.values()), 4)
    least = {g: min(i for (i, _), f in fps.items() if f in g and i is not None) for g in groups.values()}
    want = collections.Counter((i, fps[i, t], least[groups[fps[i, t]]]) for i, t, _ in rows)
    got = collections.Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {i for i, _, c in want if i is None or i == c}


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline

    rng = random.Random(13)
    some = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    twice, with_null, nulls, other, single = (some() for _ in range(5))
    made = [(1, twice, "a"), (1, twice, "b"), (1, twice, "b"), (2, twice, "c"), (None, with_null, "d"), (5, with_null, "e"), (None, nulls, "f"), (None, nulls, "g"), (7, other, "h"), (7, single, "i")]
    df = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)
    want = [(1, twice, "a"), (5, with_null, "e"), (None, nulls, "f"), (7, other, "h"), (7, single, "i")]
    left = corpus_pipeline.near_dedup(spark, df, "")
    assert left.columns == df.columns and bag(left.collect()) == collections.Counter(want)
    assert bag(corpus_pipeline.substring_dedup(spark, left, "").collect()) == collections.Counter(want)
    assert bag(simhash.drop_near_duplicates(df).collect()) == collections.Counter(want + [(None, with_null, "d"), (None, nulls, "g")])
    assert corpus_pipeline.near_dedup(spark, df.where("false"), "").count() == 0


@pytest.mark.parametrize("how", [{}, {"blocks": 9, "cell_rows": 5}])
def test_simhash_links_all_distances(spark, how):
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for d in range(1, 7):
            for b in rng.sample(range(64), d):
                f ^= 1 << b
            fps.add(f)
    dense = rng.getrandbits(64)
    fps |= {dense ^ (1 << b) ^ (1 << c) for b in range(16) for c in range(16)}
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    edges = simhash.link_edges(df, **how)
    got = {r.node & (2**64 - 1): r.component for r in components.connected_components(edges).collect()}
    groups = linked(fps, 4)
    for x in fps:
        mates = {y for y in fps if x in got and y in got and got[x] == got[y]} or {x}
        assert mates == set(groups[x])


def shingles_of(text, n=5):
    w = [re.sub("[A-Z]", lambda c: c[0].lower(), x) for x in words(text)]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def similar_groups(texts, least=0.8):
    """Group (a frozenset of texts) of each text by links of the similarity."""
    sets = {t: shingles_of(t) for t in set(texts)}
    group = {t: {t} for t in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a is not b and group[a] is not group[b] and both >= least * (len(sets[a]) + len(sets[b]) - both):
                group[a] |= group[b]
                for t in group[b]:
                    group[t] = group[a]
    return {t: frozenset(g) for t, g in group.items()}


def near_copies(seed=31):
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    out = []
    for n in (60, 120, 120, 200, 300, 400):
        base = some(n)
        out.append(" ".join(base))
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(1, max(1, n // 50))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
            out.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
            base = w if rng.random() < 0.3 else base
    return out + [" ".join(some(rng.randint(30, 200))) for _ in range(150)]


@pytest.mark.parametrize("cell_rows", [1 << 13, 4])
def test_similar_texts(spark, monkeypatch, cell_rows):
    whole = simhash.candidate_edges
    monkeypatch.setattr(simhash, "candidate_edges", lambda *a, **k: whole(*a, **k, cell_rows=cell_rows))
    texts = near_copies()
    groups = similar_groups(texts)
    assert len(set(groups.values())) < len(texts) - 40
    made = [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(500, texts[0], "again"), (None, texts[1], "null"), (0, texts[0], "s0"), (600, None, "e"), (601, "", "e"), (602, " ", "e")]
    df = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)
    kept = simhash.drop_similar(df)
    least = {}
    for i, t in enumerate(texts):
        least[groups[t]] = min(i, least.get(groups[t], i))
    want = collections.Counter((i, texts[i], f"s{i}") for i in least.values()) + collections.Counter([(600, None, "e")])
    assert kept.columns == df.columns and bag(kept.collect()) == want
    assert simhash.drop_similar(df.where("false")).count() == 0


def test_similar_texts_sketches():
    rng = random.Random(37)
    off = []
    for _ in range(120):
        w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        v = list(w)
        while len(shingles_of(" ".join(w)) & shingles_of(" ".join(v))) > 0.9 * 296:
            v[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        a, b = (simhash.sketch(" ".join(x)) for x in (w, v))
        sets = [simhash.shingle_set(" ".join(x)) for x in (w, v)]
        assert math.isclose(simhash.similarity_of(*sets), len(shingles_of(" ".join(w)) & shingles_of(" ".join(v))) / len(shingles_of(" ".join(w)) | shingles_of(" ".join(v))))
        off.append(int(np.bitwise_count(a ^ b).sum()))
    assert abs(np.mean(off) - 256 * simhash.bit_difference(0.81)) < 3 and max(off) <= simhash.reach_of(0.8) == 54
    bits, grids = simhash.grids_for(200_000, 0.8, 0.99)
    assert (1 - (1 - (1 - simhash.bit_difference(0.8)) ** bits) ** grids) >= 0.99 and 200_000 / 2**bits <= 8
    assert not simhash.sketch(None).any() and not simhash.sketch(" ").any() and simhash.similarity_of(np.zeros(0), np.zeros(0)) == 1
    sk = np.array([[0, 0], [1, 0], [7, 0], [2**63, 2**40 - 1], [2**63, 2**40 - 2]], np.uint64)
    assert [x.tolist() for x in simhash.forest(sk, 3)] == [[1, 2, 4], [0, 1, 3], [1, 2, 1]]
    assert [x.tolist() for x in simhash.forest(sk, 3, 2)] == [[1, 2, 4, 2], [0, 1, 3, 0], [1, 2, 1, 3]]
    assert [x.tolist() for x in simhash.forest(sk, 3, 2, sure=2)] == [[1, 2, 4], [0, 1, 3], [1, 2, 1]]
    assert [x.tolist() for x in simhash.forest(sk, 3, 1, -1, np.array([[6, 1]], np.uint64))] == [[1, 2, 4], [2, 0, 3], [2, 3, 1]]


@pytest.mark.parametrize("tile_rows", [1 << 11, 7])
def test_similar_texts_crowded(spark, monkeypatch, tile_rows):
    """Links of 0.8 among many nearer pairs that are just below: forests alone lose some."""
    rng = random.Random(1)
    texts = []
    for k in range(60):
        w = [f"w{i}" for i in range(300)]
        for at in rng.sample(range(300), 4):
            w[at] = f"x{k}_{at}"
        texts.append(" ".join(w))
    groups = similar_groups(texts)
    assert 2 < len(set(groups.values())) < 30
    monkeypatch.setattr(simhash, "_TILE_ROWS", tile_rows)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    least = {}
    for i, t in enumerate(texts):
        least[groups[t]] = min(i, least.get(groups[t], i))
    assert sorted(r.doc_id for r in simhash.drop_similar(df, recall=1 - 1e-9).collect()) == sorted(least.values())


def test_similar_texts_large_group(spark, monkeypatch):
    """Whatever the size of a group, each text brings a few rows to the joins that verify and link, not one for each grid."""
    rng = random.Random(3)
    texts = []
    for k in range(150):
        w = [f"w{i}" for i in range(300)]
        for at in rng.sample(range(300), rng.randint(2, 4)):
            w[at] = f"x{k}_{at}"
        texts.append(" ".join(w))
    groups = similar_groups(texts)
    assert max(map(len, groups.values())) > 50
    verified, linked_rows, verify, link = [], [], simhash._verified, simhash.connected_components
    monkeypatch.setattr(simhash, "_verified", lambda edges, *a: (verified.append(edges.count()), verify(edges, *a))[1])
    monkeypatch.setattr(simhash, "connected_components", lambda edges: (linked_rows.append(edges.where("u <> v").distinct().count()), link(edges))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    least = {}
    for i, t in enumerate(texts):
        least[groups[t]] = min(i, least.get(groups[t], i))
    assert sorted(r.doc_id for r in simhash.drop_similar(df, recall=1 - 1e-9).collect()) == sorted(least.values())
    assert max(verified) <= len(texts) and sum(verified) <= 2 * len(texts)
    assert sum(linked_rows) <= 2 * len(texts), linked_rows


def test_similar_texts_grids():
    """A cell's number names every grid that the recall calls for."""
    for rows, similarity in ((10**9, 0.8), (10**9, 0.4), (10**6, 0.3)):
        bits, grids = simhash.grids_for(rows, similarity, 0.99)
        assert grids <= 1 << 12 and 1 - (1 - (1 - simhash.bit_difference(similarity)) ** bits) ** grids >= 0.99


def test_simhash_blocks():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**5, 10**9)] == [8, 8, 10]
    assert len(simhash._masks(0, 4, 8)) == 70 and simhash._masks((1 << 56) - 1, 4, 8) == []
    assert all(m.bit_count() == 48 and m & 0xFFFFFFFF == 0xFFFFFFFF for m in simhash._masks(0xFFFFFFFF, 4, 8))


# the queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_runs(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    table = {"op3": "embeddings", "op6": "pages"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert out.count() == n if name[:3] not in ("op3", "op9", "ins") else out.count() > 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = corpus_pipeline.run(spark, sf_dir).collect()

    kept = [(i, t) for i, t in rows if (b := base_of(t))[0] >= 50 and 100 * b[4] <= 50 * b[0]]
    groups = similar_groups([t for _, t in kept])
    least = {}
    for i, t in kept:
        least[groups[t]] = min(i, least.get(groups[t], i))
    kept = [(i, t) for i, t in kept if least[groups[t]] == i]
    kept = [(i, c[2] if c[1] else t) for (i, t), c in zip(kept, cut([t for _, t in kept])) if not c[1] or c[2]]
    kept = [(i, secrets.mask(t, secrets.find_spans(t)[1])) for i, t in kept]
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: struct.pack(f"<{len(x) + 1}I", *x, 1) for i, t in kept for x in [tk.encode(t, add_special_tokens=False).ids]}
    got = collections.defaultdict(bytes)
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] += bytes(r.ids)
    assert got == want
    assert hashlib.sha256(b"".join(got[i] for i in sorted(got))).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    from tests.compare import connect, rows_of_spark, rows_of_sql

    assert rows_of_spark(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), queries.ORACLES[name])
