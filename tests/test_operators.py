"""Worked values, properties and awkward rows of the compression operators."""

import json
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tokensieve import lexicon
from tokensieve.functions import pairs, tone, words
from tokensieve.functions.rowwise import let
from tokensieve.operators import dataset, methods, metrics, runners, scores, segment, select
from tokensieve.operators import tokens as T
from tokensieve.sources import tables
from tokensieve.streaming import stream

LISTS = {
    1: "đã học sinh xinh_xắn của và",
    2: "ma má mà",
    3: "xin chào các bạn",
}
GOLD = {
    (1, "đã"): ("ngã", 0.5, 1, 1.2625, 1.36, 1.717),
    (1, "học"): ("nặng", 0.333333, 1, 1.175, 1.306667, 1.535333),
    (1, "sinh"): ("ngang", 0, 0, 1.0, 1.3, 1.3),
    (1, "xinh_xắn"): ("sắc", 0.125, 1, 1.065625, 1.31, 1.395969),
    (1, "của"): ("hỏi", 0.333333, 1, 1.175, 1.28, 1.504),
    (1, "và"): ("huyền", 0.5, 1, 1.2625, 1.3, 1.64125),
    (2, "ma"): ("ngang", 0, 0, 1.0, 1.24, 1.24),
    (2, "má"): ("sắc", 0.5, 1, 1.2625, 1.32, 1.6665),
    (2, "mà"): ("huyền", 0.5, 1, 1.2625, 1.28, 1.616),
    (3, "xin"): ("ngang", 0, 0, 1.0, 1.24, 1.24),
    (3, "chào"): ("huyền", 0.25, 1, 1.13125, 1.24, 1.40275),
    (3, "các"): ("sắc", 0.333333, 1, 1.175, 1.32, 1.551),
    (3, "bạn"): ("nặng", 0.333333, 1, 1.175, 1.24, 1.457),
}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()) if isinstance(texts, dict) else list(enumerate(texts)), "doc_id long, text string")


def values(spark, column, items):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").select("i", column(F.col("x")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_tone_goldens(spark):
    toks = T.with_contrast(T.with_tone(T.tokens(frame(spark, LISTS))))
    got = {(r.doc_id, r.tok): (lexicon.TONES[r.tone_id], r.density, r.variety, r.w_tone, r.contrast, r.tone_score) for r in toks.collect()}
    assert got.keys() == GOLD.keys()
    for k, v in GOLD.items():
        assert got[k][0] == v[0] and got[k][1:] == pytest.approx(v[1:], abs=1e-6)


def test_tone_scalars(spark):
    assert values(spark, tone.syllable_tone, ["đẹp", "không", "xyz", unicodedata.normalize("NFD", "má"), "", " TIẾNG "]) == ["nặng", "ngang", "ngang", "sắc", "ngang", "sắc"]
    assert values(spark, tone.is_vietnamese, ["Đây là tiếng Việt có dấu", "Hello world", "", "123"]) == [True, False, False, False]
    assert values(spark, tone.strip_tone, ["Tiếng Việt ế ñ", "á"]) == ["Tiêng Viêt ê n", "a"]
    assert values(spark, lambda x: tone.strip_tone(tone.strip_tone(x)), ["Tiếng ặ Ồ"]) == values(spark, tone.strip_tone, ["Tiếng ặ Ồ"])
    assert values(spark, tone.tone_digits, ["má a-ệ9", ""]) == ["0200050", ""]
    assert values(spark, tone.char_tone, ["a", "á", "x", "Ỵ"]) == [0, 2, None, 5]
    assert values(spark, lambda x: tone.dominant(tone.tone_marks(x)), ["", "áà", "àá", "àáá"]) == [0, 2, 1, 2]


def test_word_scalars(spark):
    items = ["đã", "học", "xinh_xắn", "của", "máy_tính", "và", "", "ab", "12", "Xắn", "xyz"]
    want = ["function", "content", "reduplicative", "function", "compound", "function", "content", "other", "content", "reduplicative", "content"]
    assert values(spark, words.word_class, items) == want
    assert values(spark, words.normalise, ["ko", " KO ", "dứa", "s", "hello", "chi"]) == ["không", "không", "thơm", "sao", "hello", "gì"]
    assert values(spark, words.is_function_word, ["đã", "ko", "hông", "nhà"]) == [True, True, True, False]
    assert values(spark, words.is_critical, ["Điều 4", "test@email.com", "normal", "http://x", "Hà", "HÀ"]) == [True, True, False, True, True, False]
    assert values(spark, words.clean_piece, ["▁Hợp", "Ġtác", "##xã", "_Nông", " x "]) == ["hợp", "tác", "xã", "nông", "x"]


def greedy(clean):
    i, out = 0, []
    while i < len(clean):
        size = next((s for s in range(min(5, len(clean) - i), 0, -1) if "_".join(clean[i : i + s]) in lexicon.WORD_LIST), 1)
        out.append((i, "_".join(clean[i : i + size])))
        i += size
    return out


def test_segment(spark):
    texts = ["hợp tác xã", "hợp tác xã nông nghiệp hợp tác", "chúng tôi ▁học Ġsinh", "một", "viện kiểm sát nhân dân tòa án nhân", "hợp " * 30 + "tác xã"]
    got = segment.segment(T.tokens(frame(spark, texts))).collect()
    for i, t in enumerate(texts):
        clean = [c.lower() for c in t.replace("▁", "").replace("Ġ", "").split()]
        assert [(r.start, r.word) for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.word_no)] == greedy(clean)


EDGES = ["", "  \n\t", "một", "a b c", "x " * 20, "má đẹp " * 8, " ".join(f"w{i}" for i in range(16)), " ".join(f"w{i}" for i in range(19)), " ".join(f"w{i}" for i in range(20)), "á " * 9, "vội vàng vọt XINH xắn sạch sẽ . ! ?", " ".join(f"t{i % 37}" for i in range(514)), " ".join(f"t{i % 31}" for i in range(513))]


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, EDGES)


def kept_of(df):
    out = {}
    for r in df.select("doc_id", "pos").collect():
        out.setdefault(r.doc_id, []).append(r.pos)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("name", [m for m in methods.REGISTRY if m not in ("tone_aware", "snapkv", "selective")])
def test_method_properties(spark, edges, name):
    toks = T.tokens(edges)
    toks = scores.ngram_surprisal(toks).withColumn("base_score", F.length("tok") / (F.length("tok") + 4.0))
    kept = kept_of(methods.compress(name, toks))
    sizes = {i: len(t.split()) for i, t in enumerate(EDGES)}
    assert set(kept) == {i for i, n in sizes.items() if n}
    for i, pos in kept.items():
        n = sizes[i]
        assert len(set(pos)) == len(pos) and set(pos) <= set(range(n))
        ends = {0, n - 1} if name == "scorer_select" else {0, 1, n - 2, n - 1} & set(range(n))
        assert ends <= set(pos)
        if name in ("first", "every_nth", "longest", "random", "tone_only", "combined"):
            assert len(pos) == min(n, max(n // 4, 4))


def test_short_documents(spark, edges):
    toks = T.tokens(edges).withColumn("base_score", F.lit(1.0))
    boundary, identity = kept_of(methods.tone_only(toks)), kept_of(methods.combined_base(toks))
    assert [len(boundary[i]) for i in (6, 7, 8)] == [4, 4, 5]
    assert [len(identity[i]) for i in (6, 7, 8)] == [16, 19, 5]


def test_higher_ratio_keeps_a_subset(spark, edges):
    toks = T.tokens(edges)
    few, many = kept_of(methods.tone_only(toks, 8.0)), kept_of(methods.tone_only(toks, 2.0))
    assert all(set(few[i]) <= set(many[i]) for i in few)


def test_row_and_window_forms_agree(spark, edges):
    long = {tuple(r) for r in select.assemble(methods.tone_only(T.tokens(edges))).collect()}
    row = {tuple(r) for r in stream.compress_rows(edges).select(list(select.assemble(methods.tone_only(T.tokens(edges))).columns)).collect()}
    assert long == row


def test_pairs(spark):
    found = methods.pair_partners(T.tokens(frame(spark, ["vội vàng vọt xinh a b xắn XINH xắn"]))).where("partner is not null")
    assert sorted((r.pos, r.partner) for r in found.collect()) == [(0, 1), (1, 2), (3, 6)]


def test_unknown_method(edges):
    with pytest.raises(ValueError):
        methods.compress("nope", T.tokens(edges))


def test_sentences(spark):
    text = " ".join(["a"] * 450 + ["."] + ["b", "!", "c"])
    got = methods.with_sentences(T.tokens(frame(spark, [text]))).groupBy("sent").count().orderBy("sent").collect()
    assert [r["count"] for r in got] == [200, 200, 51, 2, 1]


def test_chunks(spark):
    toks = T.tokens(frame(spark, [" ".join(["x"] * n) for n in (513, 514, 1)])).withColumn("surprisal", F.col("pos").cast("double"))
    moved = {(r.doc_id, r.pos): r.chunk_surprisal for r in scores.chunked(toks).where("chunk_surprisal <> surprisal").collect()}
    assert moved == {(0, 0): 1.0, (1, 0): 1.0, (1, 512): 513.0}


def test_layer_budgets():
    assert scores.layer_budgets(4, 100, pyramid=False) == [25] * 4
    falling = scores.layer_budgets(4, 100)
    assert falling == sorted(falling, reverse=True) and sum(falling) <= 100
    assert scores.layer_budgets(8, 1) == [1] * 8


def test_metric_scalars(spark):
    df = spark.createDataFrame([(" Abc", "abc ", "a b c", "a x c"), ("x", "y", "", "a")], "a string, b string, p string, r string")
    got = df.select(
        metrics.exact_match(F.col("a"), F.col("b")).alias("em"),
        metrics.char_overlap(F.col("p"), F.col("r"))["f1"].alias("f1"),
        metrics.rouge_l(F.filter(F.split("p", " "), lambda x: x != ""), F.split("r", " "))["f1"].alias("lcs"),
    ).collect()
    assert [r.em for r in got] == [True, False]
    assert got[0].f1 == pytest.approx(2 * 3 / (4 + 4)) and got[1].f1 == 0
    assert got[0].lcs == pytest.approx(2 / 3) and got[1].lcs == 0


def test_bleu_of_equal_texts(spark):
    same = spark.createDataFrame([(1, list("abcdef"), list("abcdef"))], "pair_id long, pred array<string>, ref array<string>")
    assert metrics.bleu(same).first().bleu == 1.0
    other = spark.createDataFrame([(1, list("ab"), list("cd"))], "pair_id long, pred array<string>, ref array<string>")
    assert metrics.bleu(other).first().bleu == 0.0


def test_training_rows(spark, edges):
    rows = {r.doc_id: r for r in dataset.training_rows(T.tokens(edges)).collect()}
    assert set(rows) == {i for i, t in enumerate(EDGES) if len(t.split()) >= 10}
    assert all(len(r.tone_labels) == r.original_length <= 512 and len(r.input_tokens) == r.compressed_length for r in rows.values())
    got = spark.range(1).select(dataset.pad(F.array(F.lit(1), F.lit(2)), 4, 0).alias("a"), dataset.pad(F.array(F.lit(1), F.lit(2)), 1, 0).alias("b")).first()
    assert got.a == [1, 2, 0, 0] and got.b == [1]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(["một", {"text": "hai"}]), encoding="utf8")
    assert sorted(r.text for r in tables.training_texts(spark, f"file://{tmp_path}/t.json").collect()) == ["hai", "một"]
    assert tables.training_texts(spark).count() == 4
    cells = spark.createDataFrame([("m", "t", 4.0, 0.5)], "method string, task string, ratio double, q double")
    tables.write_cells(cells, f"file://{tmp_path}/cells")
    assert spark.read.json(f"file://{tmp_path}/cells").first().q == 0.5
    tables.write_run(cells, f"file://{tmp_path}/run")
    assert json.loads(spark.read.text(f"file://{tmp_path}/run").first().value)["method"] == "m"
    lines = metrics.report(spark.createDataFrame([("b", 0.5, 0.5, 0.5), ("a", 0.6, 0.6, 0.6)], "method string, avg_quality double, avg_efficiency double, harmonized_score double"))
    tables.write_report(lines, f"file://{tmp_path}/report")
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*")).splitlines()
    assert text[2].startswith("| a |") and text[3].startswith("| b |")
    assert tables.samples(spark, [("qa", "c", "q", "r", 1, {"k": "v"})]).groupBy("task").count().first()["count"] == 1


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(5).write.parquet(f"file://{tmp_path}/in")
    run = stream.write_compressed(stream.read_documents(spark, f"file://{tmp_path}/in", 2), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    run.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in stream.compress_rows(docs).collect()}


def test_let_and_plan(spark, sf_dir):
    assert spark.range(1).select(let(F.lit(2), lambda x: x * x).alias("v")).first().v == 4
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan = select.assemble(methods.tone_only(T.tokens(docs)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "source" not in plan
    assert "Exchange" not in stream.compress_rows(docs)._jdf.queryExecution().executedPlan().toString()


def test_common_subsequence_and_grams():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        assert pairs.lcs(a, b) == row[-1]
    assert pairs.clipped("aab", "abab", 1) == (3, 3) and pairs.clipped("aab", "ab", 2) == (1, 2) and pairs.clipped("a", "a", 2) == (0, 0)


def test_sentence_bleu(spark):
    made = [("a b c d e".split(), "a b c d e".split(), 1.0), ("a b c d".split(), "a b c x".split(), (3 / 4 * 2 / 3 * 1 / 2 * 1 / 2) ** 0.25), ("a b c d".split(), "z z z z".split(), 0.0)]
    made += [("a x b y".split(), "a b a b a b".split(), (2 / 4 * 1 / (2 * 3) * 1 / (4 * 2) * 1 / (8 * 1)) ** 0.25 * math.exp(1 - 6 / 4)), ("a b".split(), "a b".split(), 0.0), ([], ["a"], 0.0)]
    df = spark.createDataFrame(made, "p array<string>, r array<string>, want double").withColumn("o", pairs.overlap(F.col("p"), F.col("r")))
    got = df.select("want", metrics.sentence_bleu(F.col("o.hits"), F.col("o.totals"), F.size("p"), F.size("r")).alias("got")).collect()
    assert all(math.isclose(r.got, r.want, abs_tol=1e-12) for r in got)


def test_runners(spark):
    text = " ".join(f"w{i}" for i in range(40))
    one = {r.method: r for r in runners.compress_text(spark, text).collect()}
    assert set(one) == set(methods.NO_MODEL) and one["first"].compressed_text == " ".join([*text.split()[:8], "w38", "w39"]) and one["first"].compressed_length == 10
    got = runners.evaluate_sample(spark, text, "what?", "w0 w1 w38 w39", "first", 10.0).first()
    assert got.answer == "w0 w1 w38 w39" and got.exact_match == 1.0 and got.rouge_l_f1 == 1.0 and got.bleu_score == 1.0 and got.quality == 1.0 and got.processing_time_ms > 0
    asked = runners.evaluate_sample(spark, text, "what?", "what? w0", "first", 10.0, generate=lambda c, q: F.concat_ws(" ", q, F.substring_index(c, " ", 1))).first()
    assert asked.answer == "what? w0" and asked.exact_match == 1.0 and asked.bleu_score == 0.0
    names = [r.name for r in runners.benchmark_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), ("first", "none")).orderBy("name").collect()]
    assert names == [f"{m}@{r}x" for m in ("first", "none") for r in (2.0, 4.0, 6.0, 8.0)]
    with pytest.raises(ValueError):
        methods.evaluate(spark.createDataFrame([], "doc_id long, pos int, tok string, n int"), ("snapkv",))


def test_timed_cells(spark):
    samples = spark.createDataFrame([(i, "qa", " ".join(f"w{j}" for j in range(30 + i)), "q", "w0 w1") for i in range(4)], "doc_id long, task string, context string, query string, reference_answer string")
    rows = runners.timed(samples, lambda m, r: runners.evaluate_samples(samples, (m,), (r,)), ("first", "combined"), (2.0,))
    cells = metrics.cells(rows).collect()
    assert len(cells) == 2 and all(c.mean_processing_time_ms > 0 and c.num_samples == 4 and c.mean_rouge_l_f1 > 0 for c in cells)


def test_rescored_behind_a_removed_token(spark):
    toks = T.tokens(spark.createDataFrame([(1, "a b a c a b"), (2, "c b")], "doc_id long, text string"))
    scored = scores.ngram_surprisal(toks)
    got = [r.surprisal for r in scores.rescored(scored.where("not (doc_id = 1 and pos in (2, 3))"), toks).where("doc_id = 1").orderBy("pos").collect()]
    want = [0.0, -math.log(3 / 6), -math.log(2 / 4), -math.log(3 / 6)]  # b after a: 2 of 3; a after b: 1 of 1; vocabulary of 3
    assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got, want)) and len(got) == 4


def test_training_batches_pad(spark):
    rows = spark.createDataFrame([(0, ["a"], ["a", "b"], [1, 0]), (3, ["c", "d"], ["c", "d", "e"], [0, 0, 2]), (9, ["x"], ["x"], [0])], "doc_id long, input_tokens array<string>, labels array<string>, tone_labels array<int>")
    got = dataset.batches(rows, 8, fill="<pad>").orderBy("batch").collect()
    assert got[0].doc_ids == [0, 3] and got[0].input_tokens == [["a", "<pad>"], ["c", "d"]] and got[0].attention == [[1, 0], [1, 1]]
    assert got[0].labels == [["a", "b", "-100"], ["c", "d", "e"]] and got[0].tone_labels == [[1, 0, 0], [0, 0, 2]] and got[1].labels == [["x"]]
