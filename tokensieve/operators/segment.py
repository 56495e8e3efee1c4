"""Greedy longest-match word segmentation, spans and the enhanced word analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tone, words
from ..lexicon import MAX_PARTS, SINO_MORPHEMES, WORD_LIST
from ..functions.rowwise import let
from .tokens import by_document, tokens


def match_lengths(toks: DataFrame) -> DataFrame:
    """Adds len: the longest run of up to MAX_PARTS tokens from here that the word list has; 1 if none."""
    known = sorted(w for w in WORD_LIST if "_" in w)
    joined = [F.col("tok")]
    for i in range(1, MAX_PARTS):
        joined.append(F.concat(joined[-1], F.lit("_"), F.lead("tok", i).over(by_document())))
    out = F.lit(1)
    for size in range(2, MAX_PARTS + 1):
        out = F.when(joined[size - 1].isin(*known), size).otherwise(out)
    return toks.withColumn("len", out)


def _starts(lengths: Column) -> Column:
    """Places where words start when each match skips what it covers: a fold that carries the next free place."""
    start = F.struct(F.lit(0).alias("free"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        here = acc["at"] >= acc["free"]
        return F.struct(
            F.when(here, acc["at"] + size).otherwise(acc["free"]).alias("free"),
            (acc["at"] + 1).alias("at"),
            F.when(here, F.concat(acc["out"], F.array(acc["at"]))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(lengths, start, step)["out"]


def segment_text(docs: DataFrame) -> DataFrame:
    """(doc_id, word_no, start, word) of the white-space tokens of docs (doc_id, text), in lower case."""
    toks = tokens(docs)
    return segment(toks.withColumn("tok", F.lower("tok")), clean=False)


def segment(toks: DataFrame, clean: bool = True) -> DataFrame:
    """(doc_id, word_no, start, word): words in order from tokens (doc_id, pos, tok) of subword pieces.

    Marks of word boundaries are taken off each piece, if ``clean``, and
    empty pieces dropped first.  A document's matches are found by windows; only their
    overlaps are resolved in one fold over the document's lengths, in
    blocks between tokens that no longer match can cross.
    """
    pieces = toks.withColumn("tok", words.clean_piece(F.col("tok"))) if clean else toks
    placed = pieces.where("tok <> ''").withColumn("pos", F.row_number().over(by_document()) - 1)
    sized = match_lengths(placed)
    # A place is free where no earlier match reaches; blocks of matches that touch are folded alone.
    reach = F.max(F.col("pos") + F.col("len")).over(by_document().rowsBetween(-MAX_PARTS, -1))
    block = sized.withColumn("fresh", (F.coalesce(reach, F.lit(0)) <= F.col("pos")).cast("int")).withColumn("block", F.sum("fresh").over(by_document()))
    folded = block.groupBy("doc_id", "block").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "len", "tok"))).alias("run"))
    starts = folded.select("doc_id", "first", "run", F.explode(_starts(F.transform("run", lambda x: x["len"]))).alias("at"))
    size = F.get("run", F.col("at"))["len"]
    word = F.array_join(F.transform(F.slice("run", F.col("at") + 1, size), lambda x: x["tok"]), "_")
    out = starts.select("doc_id", (F.col("first") + F.col("at")).alias("start"), word.alias("word"))
    return out.withColumn("word_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1).select("doc_id", "word_no", "start", "word")


def pieces_of(toks: Column, clean: bool = True) -> Column:
    """The subword pieces of a token array: without marks of word boundaries and empty ones, if clean; else in lower case."""
    return F.filter(F.transform(toks, words.clean_piece if clean else F.lower), lambda x: x != "")


def lengths_in(pieces: Column) -> Column:
    """For each piece the longest run of up to MAX_PARTS from here that the word list has; 1 if none."""
    known = sorted(w for w in WORD_LIST if "_" in w)
    opens = sorted({"_".join(w.split("_")[:n]) for w in known for n in range(1, w.count("_") + 1)})

    def of(x: Column, i: Column) -> Column:
        joined, out = x, F.lit(1)
        for size in range(2, MAX_PARTS + 1):
            joined = F.concat(joined, F.lit("_"), F.get(pieces, i + size - 1))
            out = F.when(joined.isin(*known), size).otherwise(out)
        return F.when(x.isin(*opens), out).otherwise(F.lit(1))

    return F.transform(pieces, of)


def words_in(pieces: Column) -> Column:
    """Structs (start, word) of greedy longest matches in a row's pieces, in order.

    Places that no earlier match reaches start a word for certain; what lies
    between two of them is folded alone.
    """

    def is_fresh(sizes: Column, i: Column) -> Column:
        out = F.lit(True)
        for j in range(1, MAX_PARTS):
            out = out & F.coalesce(F.get(sizes, i - j) <= j, F.lit(True))
        return out

    def block(sizes: Column, fresh: Column, at: Column, b: Column) -> Column:
        end = F.coalesce(F.get(fresh, b + 1), F.size(sizes))
        run = lambda e: F.transform(_starts(F.slice(sizes, at + 1, e - at)), lambda x: x + at)
        return let(end, lambda e: F.when(e == at + 1, F.array(at)).otherwise(run(e)))

    def starts(sizes: Column) -> Column:
        fresh = F.filter(F.transform(sizes, lambda _, i: F.when(is_fresh(sizes, i), i)), lambda x: x.isNotNull())
        return let(fresh, lambda f: F.flatten(F.transform(f, lambda at, b: block(sizes, f, at, b))))

    word = lambda ps, sizes, at: F.array_join(F.slice(ps, at + 1, F.get(sizes, at)), "_")
    found = lambda ps, sizes: F.transform(starts(sizes), lambda at: F.struct(at.alias("start"), word(ps, sizes, at).alias("word")))
    return let(pieces, lambda ps: let(lengths_in(ps), lambda sizes: found(ps, sizes)))


def segment_rows(table: DataFrame, clean: bool = True) -> DataFrame:
    """(doc_id, n, words): segment() of rows (doc_id, toks), a document's words in its own row; n counts its tokens. Documents without pieces have no row."""
    some = table.where(F.exists("toks", lambda t: words.clean_piece(t) != "")) if clean else table
    return some.select("doc_id", F.size("toks").alias("n"), words_in(pieces_of(F.col("toks"), clean)).alias("words"))


def spans_in(words_: Column, n: Column) -> Column:
    """Struct of the sums of span_start and span_end and the last span_end of a row's words: see align()."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("end"), zero.alias("sum_start"), zero.alias("sum_end"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["end"] + F.size(F.split(x["word"], "_"))
        return F.struct(end.alias("end"), (acc["sum_start"] + acc["end"]).alias("sum_start"), (acc["sum_end"] + F.least(end, n)).alias("sum_end"))

    return F.aggregate(words_, start, step, lambda acc: F.struct(acc["sum_start"].alias("sum_start"), acc["sum_end"].alias("sum_end"), F.least(acc["end"], n).alias("last_end")))


def align(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds (span_start, span_end): running numbers of ``_`` parts, the end capped at the document's n tokens."""
    spec = Window.partitionBy("doc_id").orderBy("word_no")
    parts = F.size(F.split("word", "_"))
    end = F.sum(parts).over(spec)
    return segments.join(counts, "doc_id").withColumns({"span_start": (end - parts).cast("int"), "span_end": F.least(end, F.col("n")).cast("int")}).drop("n")


def is_sino(word: Column) -> Column:
    """Whether a word is two different Sino morphemes joined by ``_``, of at least six characters."""
    a, b = F.substring_index(word, "_", 1), F.substring_index(word, "_", -1)
    return (F.size(F.split(word, "_")) == 2) & (a != b) & (F.length(word) >= 6) & a.isin(*SINO_MORPHEMES) & b.isin(*SINO_MORPHEMES)


def analyse(segments: DataFrame) -> DataFrame:
    """Adds norm, tone, enhanced class and multiplier of each word: CRITICAL, FUNC, SINO or CONTENT."""
    norm = words.normalise(F.col("word"))
    out = segments.withColumn("norm", norm).withColumns(
        {"tone": tone.syllable_tone(F.col("norm")), "is_critical": words.is_critical(F.col("word")), "is_function": words.is_function_word(F.col("norm")), "is_sino": is_sino(F.col("norm"))}
    )
    kind = F.when(F.col("is_critical"), "CRITICAL").when(F.col("is_function"), "FUNC").when(F.col("is_sino"), "SINO").otherwise("CONTENT")
    return out.withColumn("word_class", kind).withColumn("multiplier", words.enhanced_multiplier(F.col("word_class")))
