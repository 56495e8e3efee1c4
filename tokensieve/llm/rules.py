"""Quality rules with host-level verdicts, all in built-in SQL functions.

Each document's base counts come from one projection without a shuffle.
Rule failures are summed by host (two-phase aggregation, so a hot host is a
row a task), the failure rate of each rule is shrunk by a beta prior that
is fitted to all hosts by beta-binomial moments weighted by documents, and
the hosts that fail are joined back to their documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import store

_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class HostRule:
    """A host is rejected if, for some rule, the shrunk share of its documents that fail exceeds max_rate.

    max_prior bounds the prior's weight in documents.
    """

    max_rate: float = 0.7
    max_prior: float = 100.0
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 25
    max_dup_line_percent: int = 50


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the array holds twice or more, the first included."""

    def of(w: Column) -> Column:
        windows = F.transform(
            F.zip_with(w, F.zip_with(F.slice(w, 2, F.size(w)), F.slice(w, 3, F.size(w)), lambda b, c: F.concat_ws(" ", b, c)), lambda a, bc: F.concat_ws(" ", a, bc)),
            lambda x, i: F.struct(x.alias("x"), i.alias("i")),
        )
        ordered = F.sort_array(F.slice(windows, 1, F.size(w) - 2))
        return _let(ordered, repeated)

    def repeated(s: Column) -> Column:
        def twice(e: Column, i: Column) -> Column:
            return F.coalesce((F.get(s, i - 1)["x"] == e["x"]) | (F.get(s, i + 1)["x"] == e["x"]), F.lit(False))

        at = F.transform(F.filter(s, twice), lambda e: e["i"])
        return F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))))

    return _let(words, lambda w: F.when(F.size(w) < 4, 0).otherwise(of(w)))


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) of every row."""
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), _counted(F.col("text")).alias("c"))
    return seen.select("doc_id", "host", "c.*")


def _counted(text: Column) -> Column:
    """Struct of the base counts of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), 1)
    line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    word = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("rep")))
    both = F.struct(line.alias("line"), word.alias("word"))
    return _let(
        both,
        lambda x: F.struct(
            x["word"]["n"].alias("n_words"),
            F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, _SYMBOLS, "")).cast("long").alias("n_symbols"),
            x["line"]["dup"].alias("n_dup_lines"),
            x["line"]["n"].alias("n_lines"),
            x["word"]["rep"].alias("n_repeat_words"),
        ),
    )


def _failures(how: HostRule, c=F.col) -> dict[str, Column]:
    """Whether each rule fails; c gives a count by its name."""
    return {
        "short": c("n_words") < how.min_words,
        "repetitive": 100 * c("n_repeat_words") > how.max_repeat_percent * c("n_words"),
        "symbols": 100 * c("n_symbols") > how.max_symbol_percent * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > how.max_dup_line_percent * c("n_lines"),
    }


def beta_prior(hosts: int, docs: int, squares: float, failed: float, spread: float, max_prior: float) -> tuple[float, float]:
    """(a, b) of the beta distribution of host failure rates, fitted by the moments of a beta-binomial.

    hosts: number of hosts; docs, squares: sums over hosts of n and n * n;
    failed, spread: sums of x and x * x / n, for x failures of n documents.
    The mean rate and the spread about it are weighted by documents; what
    the binomial draw adds to the spread is taken off before the prior's
    weight a + b is solved for and kept in [1, max_prior].  Where hosts
    differ no more than such draws do, or have one document each, the
    weight is max_prior.  Without documents the prior is (0.5, 0.5).
    """
    if not docs:
        return 0.5, 0.5
    p = failed / docs
    between = docs - squares / docs - (hosts - 1)
    weight = max_prior
    if 0 < p < 1 and between > 0:
        share = ((spread - failed * p) / (p * (1 - p)) - (hosts - 1)) / between  # 1 / (a + b + 1)
        if share > 0:
            weight = 1 / share - 1
    weight = min(max(weight, 1.0), max_prior)
    return p * weight, (1 - p) * weight


def host_verdicts(counts: DataFrame, how: HostRule = HostRule()) -> DataFrame:
    """(host, n_docs, rate_<rule>..., host_kept) for every host that isn't null; an empty table gives no rows.

    counts: rows of base_counts; rows that repeat a doc_id count each.
    """
    rules = list(_failures(how))
    sums = [F.sum(test.cast("long")).alias(rule) for rule, test in _failures(how).items()]
    hosts = counts.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), *sums)
    n = F.col("n_docs")
    moments = hosts.agg(
        F.count("*").alias("hosts"),
        F.coalesce(F.sum(n), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(n.cast("double") * n), F.lit(0.0)).alias("squares"),
        *[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in rules],
        *[F.coalesce(F.sum(F.col(r).cast("double") * F.col(r) / n), F.lit(0.0)).alias(f"{r}_spread") for r in rules],
    ).first()
    rates = {}
    for r in rules:
        a, b = beta_prior(moments.hosts, moments.docs, moments.squares, moments[r], moments[f"{r}_spread"], how.max_prior)
        rates[r] = (F.col(r) + F.lit(a)) / (n + F.lit(a + b))
    kept = ~F.greatest(*[rates[r] > how.max_rate for r in rules])
    return hosts.select("host", "n_docs", *[rates[r].alias(f"rate_{r}") for r in rules], kept.alias("host_kept"))


def judge(docs: DataFrame, host: str = "source", how: HostRule = HostRule()) -> DataFrame:
    """(doc_id, host, base counts, base_failed, host_kept, kept) for every row of docs (doc_id, text, host).

    base_failed: fewer than min_words words, or more than
    max_repeat_percent of the words in repeated 3-word windows.  kept: not
    base_failed, and the host isn't rejected.  A null text has no words and
    fails; a null host is never rejected.  Rows that repeat a doc_id are
    judged each; an empty table gives an empty result.
    """
    tests = _failures(how)
    counts = store(base_counts(docs, host))
    rejected = store(host_verdicts(counts, how).where("not host_kept").select("host", F.lit(False).alias("host_kept")))
    joined = counts.join(rejected, "host", "left")
    failed = tests["short"] | tests["repetitive"]
    host_kept = F.coalesce("host_kept", F.lit(True))
    return joined.withColumns({"base_failed": failed, "host_kept": host_kept, "kept": ~failed & host_kept})


def keep_documents(docs: DataFrame, host: str = "source", how: HostRule = HostRule()) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns.

    Rows that repeat a doc_id are judged each; a null text goes, a null
    host is never rejected, an empty table gives an empty result.  Texts
    are looked at once: the first pass stores every row's counts, and the
    row itself where the base rules keep it.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    seen = docs.select(row, docs[host].cast("string").alias("host"), _counted(docs["text"]).alias("c")).select("_row", "host", "c.*")
    tests = _failures(how)
    passed = F.when(~(tests["short"] | tests["repetitive"]), F.col("_row")).alias("_row")
    judged = store(seen.select(passed, "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"))
    gone = store(host_verdicts(judged.drop("_row"), how).where("not host_kept").select("host"))
    return judged.where("_row is not null").select("_row", "host").join(gone, "host", "left_anti").select("_row.*")
