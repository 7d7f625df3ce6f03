"""Quality rules by weak supervision, in DataFrame and SQL functions only.

Nine rules look at a text's counts and vote good (1), bad (-1) or abstain (0). Nobody says which rules
are right: expectation-maximisation over the counts of vote patterns (3^9 at most, whatever the number
of documents) estimates how often each rule that votes says bad of good and of bad texts, and the share
of good texts. An abstention says nothing. The start is each text's own majority, so a rule counts as
far as others agree with it: one bad vote among good ones doesn't reject a text, unless that rule has
shown that it is right. A document is kept if its posterior probability of being good is at least one
half and it fails neither base rule; the documents that fail one are decided and not learned from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\\x20\\x09-\\x0D]+"

#: (name, expression, by the step it belongs to); each step sees the columns of those before.
STEPS: list[dict[str, str]] = [
    {
        "_words": f"array_remove(split(coalesce(text, ''), '{SPACE}'), '')",
        "_lines": r"filter(split(coalesce(text, ''), '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')",
        "n_symbols": "cast(regexp_count(coalesce(text, ''), '[#*$%&|<>]') as long)",
        "n_upper": r"cast(regexp_count(coalesce(text, ''), '\\p{Lu}') as long)",
        # a match is a word from its first symbol on, or a whole word without a letter
        "n_symbol_words": r"cast(regexp_count(coalesce(text, ''), '[#*$%&|<>][^\\x20\\x09-\\x0D]*+') as long)",
        "n_bare_words": r"cast(regexp_count(coalesce(text, ''), '(?<![^\\x20\\x09-\\x0D])[^\\p{L}\\x20\\x09-\\x0D]++(?![^\\x20\\x09-\\x0D])') as long)",
    },
    {
        "n_words": "cast(size(_words) as long)",
        "word_chars": "cast(length(array_join(_words, '')) as long)",
        "n_lines": "cast(size(_lines) as long)",
        "n_dup_lines": "cast(size(_lines) - size(array_distinct(_lines)) as long)",
        "n_distinct_words": "cast(size(array_distinct(_words)) as long)",
        "n_ends": r"cast(size(filter(_words, x -> substring(x, -1, 1) in ('.', '!', '?', '…'))) as long)",
        # 64-bit hashes of the windows; within a text, equal hashes are taken for equal words
        "_windows": "if(size(_words) < 3, cast(array() as array<long>), transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))",
    },
    {"_sorted": "if(size(array_distinct(_windows)) = size(_windows), null, sort_array(transform(_windows, (x, i) -> struct(x as h, i as i))))"},
    # where windows that occur twice or more begin, in order; each covers three words
    {"_found": "sort_array(transform(filter(_sorted, (x, j) -> (get(_sorted, j - 1).h = x.h) or (get(_sorted, j + 1).h = x.h)), x -> x.i))"},
    {"n_repeat_words": "coalesce(aggregate(transform(_found, (x, j) -> least(3, x - coalesce(get(_found, j - 1), -3))), 0L, (a, x) -> a + x), 0L)"},
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_ends", "n_upper", "n_symbol_words", "n_bare_words"]
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"

#: What each rule calls bad and good, in integers; it abstains on the rest.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    "lines": ("2 * n_dup_lines > n_lines", "n_dup_lines = 0 and n_lines > 1"),
    "word_length": ("10 * word_chars < 35 * n_words or 10 * word_chars > 75 * n_words", "10 * word_chars between 40 * n_words and 65 * n_words"),
    "variety": ("n_words >= 50 and 5 * n_distinct_words < n_words", "5 * n_distinct_words >= 2 * n_words"),
    "capitals": ("10 * n_upper > 3 * word_chars", "100 * n_upper <= 15 * word_chars"),
    "symbol_words": ("20 * n_symbol_words > n_words", "100 * n_symbol_words <= 3 * n_words"),
    "bare_words": ("5 * n_bare_words > n_words", "10 * n_bare_words <= n_words"),
    "sentences": ("2 * n_ends > n_words", "100 * n_ends between 2 * n_words and 30 * n_words"),
}
VOTES = [f"vote_{k}" for k in RULES]

ROUNDS, KEEP_AT = 25, 0.5


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of each whole text and the rules' votes. A null text has no words."""
    kept = docs.columns
    out = docs
    for step in STEPS:
        out = out.withColumns({k: F.expr(v) for k, v in step.items()})
    out = out.select(*kept, *COUNTS)
    votes = {f"vote_{k}": F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for k, (bad, good) in RULES.items()}
    return out.withColumns({"base_failed": F.expr(BASE_FAILED)} | votes)


def patterns(votes: DataFrame) -> DataFrame:
    """How many documents that pass the base rules have each pattern of votes: 3^9 rows at most."""
    return votes.filter("not base_failed").groupBy(*VOTES).agg(F.count("*").cast("double").alias("n"))


def estimate(votes: DataFrame) -> DataFrame:
    """One row: ``share`` of good texts, and ``good`` and ``bad``, the chance of each rule's vote being bad on such texts.

    The rounds of expectation-maximisation fold over the array of vote patterns, which is bounded by
    the number of rules. One good and one bad text, and one vote of each kind, are added to every count,
    so over no documents the rates are even.
    """
    rules = len(VOTES)
    # a rule's term in the odds of good, from its vote and the chances of a bad one
    term = "(case x.v[j] when -1 then ln(m.good[j]) - ln(m.bad[j]) when 1 then ln(1D - m.good[j]) - ln(1D - m.bad[j]) else 0D end)"
    odds = f"ln(m.share) - ln(1D - m.share) + aggregate(sequence(0, {rules - 1}), 0D, (s, j) -> s + {term})"
    with_chance = lambda chance: f"transform(ps, x -> named_struct('v', x.v, 'n', x.n, 'q', {chance}))"
    total = lambda what: f"aggregate(q, 0D, (s, x) -> s + {what})"
    rates = lambda w: f"transform(sequence(0, {rules - 1}), j -> (1D + {total(f'if(x.v[j] = -1, {w}, 0D)')}) / (2D + {total(f'if(x.v[j] <> 0, {w}, 0D)')}))"
    good, bad = "x.n * x.q", "x.n * (1D - x.q)"
    maximised = f"named_struct('share', (1D + {total(good)}) / (2D + {total('x.n')}), 'good', {rates(good)}, 'bad', {rates(bad)})"
    # a let: the chances are computed once a round and then summed
    step = lambda chance: f"transform(array({with_chance(chance)}), q -> {maximised})[0]"
    votes_of = lambda k: f"size(filter(x.v, y -> y = {k}))"
    start = step(f"(1D + {votes_of(1)}) / (2D + {votes_of(1)} + {votes_of(-1)})")
    folded = f"aggregate(sequence(1, {ROUNDS}), {start}, (m, i) -> {step(f'1D / (1D + exp(-({odds})))')})"
    gathered = patterns(votes).select(F.struct(F.array(*VOTES).alias("v"), "n").alias("p")).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return gathered.selectExpr(f"{folded} as model")


def judged(votes: DataFrame, model: DataFrame) -> DataFrame:
    """``votes`` with ``quality``, the posterior probability of being good, and ``kept``."""
    # a numbered row: no filter on the verdict can move below it, where it would repeat the counts' expressions
    out = votes.withColumns({"_model": model.scalar(), "_seal": F.monotonically_increasing_id()})
    m = F.col("_model")
    odds = F.log(m["share"]) - F.log(1 - m["share"])
    for j, v in enumerate(VOTES):
        good, bad = m["good"][j], m["bad"][j]
        said = F.when(F.col(v) == -1, F.log(good) - F.log(bad)).when(F.col(v) == 1, F.log(1 - good) - F.log(1 - bad))
        odds = odds + F.coalesce(said, F.lit(0.0))
    kept = ~F.col("base_failed") & (F.col("quality") >= KEEP_AT) & (F.col("_seal") >= 0)
    return out.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("kept", kept).drop("_model", "_seal")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, the votes, quality and kept of every document.

    The counts of each text are made once and cut off by a checkpoint without the text. Null and empty
    texts have no words and fail the length rule; equal rows get equal results; other columns of
    ``docs`` are ignored; an empty table gives no row.
    """
    votes = common.checkpointed(counted(docs.select("doc_id", "text")).drop("text"))
    return judged(votes, estimate(votes))


def filter_docs(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names.

    The rows are checkpointed with their votes, so the counts of each text are made once. Null and
    empty texts fail the base rules and go; equal rows fare alike; an empty table stays empty.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    votes = common.checkpointed(counted(own).select("doc", "base_failed", *VOTES))
    return judged(votes, estimate(votes)).filter("kept").select("doc.*")
