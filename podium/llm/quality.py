r"""Quality rules as weak supervision, in DataFrame functions alone.

Each rule looks at a text's counts and votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the table of distinct vote
patterns (at most 3 ** rules rows, whatever the corpus) estimates the share of good texts and each rule's accuracies: how often
it votes good on good texts and bad on bad ones. It starts from the number of bad votes and is told nothing of any rule. A
text is kept when its posterior probability of being good is at least one half, so a bad vote of a rule that mostly disagrees with the others rejects nothing by
itself, and one of a rule that the others confirm does. Each kind of defect is looked at by two rules or more (symbols, letters and marks; lines, repeats and
capitals), as a rule that nothing else ever confirms could only be learned to be noise. Rules that look at one defect agree more than two classes
say: that makes posteriors extreme, and changes few verdicts. Texts and votes stay in DataFrame functions; only the small table of patterns reaches the driver.

Null and empty texts have no words: all counts are 0, and they fail the base rule. Repeated rows are judged
each on its own. An empty table has an empty result. Further columns stay as they are: the columns of the work get names that the
table doesn't have, and kept() names the struct so too.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import unused, written

SPACE = "[\\x20\\x09-\\x0D]+"
RULES = ("length", "symbols", "lines", "repeats", "capitals", "word_length", "stops", "letters", "marks")
#: Name of the struct that features() adds, if no other is given.
ADDED = "__quality"
ITERATIONS, TOLERANCE = 500, 1e-7
#: Probability of being good that texts of no, one, and more bad votes start with.
FIRST = (0.95, 0.6, 0.1)
#: Votes that each rate starts with, and the share of bad ones among them on good and on bad texts: a rule that never votes keeps rates inside 0 and 1.
PRIOR, PRIOR_BAD = 2.0, (0.1, 0.5)
#: A rule votes bad on fewer good texts than this: the class of good texts is the one on which all rules are better than chance.
CHANCE = 0.5


#: Up to so many repeated windows a text is searched for each; beyond, its windows are sorted with their places.
FEW = 48


def covered(starts: Column) -> Column:
    """Words inside the windows that start at these places."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def by_search(hashes: Column, repeated: Column) -> Column:
    """Places of the windows whose hash is among the repeated ones."""
    return F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda i: i.isNotNull())


def by_sorting(hashes: Column) -> Column:
    """The same, where many are: once sorted with their places, windows of equal hash are neighbours."""
    missing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # a copy shifted by one gives each window its predecessor; a hit adds both
    shifted = F.zip_with(F.concat(missing, pairs), F.concat(pairs, missing), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.flatten(F.filter(shifted, lambda x: x.isNotNull()))


def features(documents: DataFrame, text: str = "text", keep: list[str] | None = None, into: str = ADDED) -> DataFrame:
    """documents, or the columns to keep of it, with a struct of counts and votes, named `into`."""
    keep = documents.columns if keep is None else keep
    at = {x: unused(documents, f"quality_{x}") for x in ("words", "lines", "n", "hashes", "sorted", "repeated", "counts")}
    words, lines, count, hashes, ordered, repeated, counted = (F.col(name) for name in at.values())
    body, n = F.coalesce(F.col(text), F.lit("")), F.size(words)
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    step = documents.withColumns({
        at["words"]: F.filter(F.split(body, SPACE, -1), lambda w: w != ""),
        at["lines"]: F.filter(F.split(body, "\n", -1), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""),
    })
    step = step.withColumns({at["n"]: n, at["hashes"]: F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>"))})
    step = step.withColumn(at["sorted"], F.sort_array(hashes))
    step = step.withColumn(at["repeated"], F.array_distinct(F.filter(ordered, lambda h, i: (i > 0) & (h == F.get(ordered, i - 1)))))
    repeat = F.when(F.size(repeated) == 0, 0).when(F.size(repeated) <= FEW, covered(by_search(hashes, repeated))).otherwise(covered(by_sorting(hashes)))
    counts = {
        "n_words": count.cast("long"),
        "word_chars": F.length(F.regexp_replace(body, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat.cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_capitals": F.regexp_count(body, F.lit("[A-Z]")).cast("long"),
        "n_letters": (F.length(body) - F.length(F.regexp_replace(body, "\\p{L}+", ""))).cast("long"),
        "n_marks": F.size(F.filter(words, lambda w: ~w.rlike("\\p{L}"))).cast("long"),
        "n_stops": F.regexp_count(body, F.lit("[.!?](?=[\\x20\\x09-\\x0D]|$)")).cast("long"),
    }
    step = step.select(*keep, F.struct(*(c.alias(k) for k, c in counts.items())).alias(at["counts"]))
    fields = [counted[k].alias(k) for k in counts] + [v.cast("int").alias(f"vote_{k}") for k, v in votes(counted).items()]
    return step.select(*keep, F.struct(*fields).alias(into))


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(c: Column) -> dict[str, Column]:
    """What each rule says of a text's counts; shares are compared as whole numbers."""
    n, lines = c["n_words"], c["n_lines"]
    return {
        "length": vote(n < 20, n >= 100),
        "symbols": vote(c["n_symbols"] * 100 > n * 12, c["n_symbols"] * 100 <= n * 4),
        "lines": vote((lines >= 4) & (c["n_dup_lines"] * 100 > lines * 35), (lines >= 4) & (c["n_dup_lines"] * 100 <= lines * 15)),
        "repeats": vote(c["n_repeat_words"] * 100 > n * 40, c["n_repeat_words"] * 100 <= n * 20),
        "capitals": vote(c["n_capitals"] * 100 > c["word_chars"] * 35, c["n_capitals"] * 100 <= c["word_chars"] * 15),
        "word_length": vote((c["word_chars"] < n * 2) | (c["word_chars"] > n * 14), (c["word_chars"] >= n * 3) & (c["word_chars"] <= n * 12)),
        "letters": vote(c["n_letters"] * 100 < c["word_chars"] * 88, c["n_letters"] * 100 >= c["word_chars"] * 94),
        "marks": vote(c["n_marks"] * 100 > n * 15, c["n_marks"] * 100 <= n * 6),
        "stops": vote((n >= 50) & (c["n_stops"] * 150 < n), c["n_stops"] * 40 >= n),
    }


@dataclass(frozen=True)
class Model:
    """share: of good texts; bad_on_good[k], bad_on_bad[k]: how often rule k, when it votes, votes bad on good and on bad texts."""

    share: float
    bad_on_good: tuple[float, ...]
    bad_on_bad: tuple[float, ...]

    def odds(self) -> list[tuple[float, float]]:
        """What a bad and a good vote of each rule add to the logarithm of the odds of being good."""
        return [(log(g / b), log((1 - g) / (1 - b))) for g, b in zip(self.bad_on_good, self.bad_on_bad, strict=True)]

    def posterior(self, votes_of: tuple[int, ...]) -> float:
        """Probability of being good, from the votes."""
        total = log(self.share / (1 - self.share)) + sum(bad if v < 0 else good if v > 0 else 0.0 for v, (bad, good) in zip(votes_of, self.odds(), strict=True))
        return 1 / (1 + exp(min(-total, 700.0)))

    def posterior_of(self, vote_of: dict[str, Column]) -> Column:
        """The same as a column."""
        total = F.lit(log(self.share / (1 - self.share)))
        for rule, (bad, good) in zip(RULES, self.odds(), strict=True):
            total = total + F.when(vote_of[rule] < 0, bad).when(vote_of[rule] > 0, good).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def vote_patterns(described: DataFrame, name: str = ADDED) -> list[tuple[tuple[int, ...], int]]:
    """The distinct votes and how many texts have them; at most 3 ** rules rows, whatever the corpus."""
    votes_of = [F.col(name)[f"vote_{rule}"] for rule in RULES]
    return [(tuple(row[:-1]), row[-1]) for row in described.groupBy(*votes_of).agg(F.count("*")).collect()]


def fit(patterns: list[tuple[tuple[int, ...], int]], iterations: int = ITERATIONS) -> Model:
    """Expectation-maximisation over the vote patterns."""
    good = [FIRST[min(sum(v < 0 for v in votes_of), 2)] for votes_of, _ in patterns]
    while True:
        # the classes' sizes, with one text each, and rates from the votes weighted by the posteriors
        size = [1.0 + sum(n * p for (_, n), p in zip(patterns, good, strict=True)), 1.0 + sum(n * (1 - p) for (_, n), p in zip(patterns, good, strict=True))]
        bad = [[PRIOR * share for _ in RULES] for share in PRIOR_BAD]
        cast = [[PRIOR for _ in RULES] for _ in PRIOR_BAD]
        for (votes_of, n), p in zip(patterns, good, strict=True):
            for k, v in enumerate(votes_of):
                if v:
                    for c, weight in enumerate((n * p, n * (1 - p))):
                        cast[c][k] += weight
                        bad[c][k] += weight * (v < 0)
        rates = [tuple(b / t for b, t in zip(bad[c], cast[c], strict=True)) for c in range(2)]
        model = Model(size[0] / sum(size), tuple(min(r, CHANCE) for r in rates[0]), rates[1])
        new = [model.posterior(votes_of) for votes_of, _ in patterns]
        iterations -= 1
        if iterations <= 0 or max((abs(a - b) for a, b in zip(new, good, strict=True)), default=0.0) < TOLERANCE:
            return model
        good = new


def with_verdict(described: DataFrame, model: Model, name: str = ADDED) -> DataFrame:
    """features() with base_failed, posterior and kept."""
    q = F.col(name)
    failed = (q["n_words"] < 50) | (q["n_repeat_words"] * 100 > q["n_words"] * 50)
    posterior = model.posterior_of({rule: q[f"vote_{rule}"] for rule in RULES})
    return described.withColumn(name, q.withField("base_failed", failed).withField("posterior", posterior).withField("kept", ~failed & (posterior >= 0.5)))


def judged(documents: DataFrame, text: str = "text", keep: list[str] | None = None, into: str = ADDED) -> DataFrame:
    """documents, or the columns to keep of it, with the struct `into` of counts and votes, base_failed, posterior and kept. The texts are described once, into the shared folder."""
    described = written(features(documents, text, keep, into), "quality")
    return with_verdict(described, fit(vote_patterns(described, into)), into)


def kept(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows of documents that are kept, with their own columns. The verdict is asked of the written votes, so the filter never repeats the counting."""
    into = unused(documents, ADDED)
    return judged(documents, text, into=into).where(F.col(into)["kept"]).select(*documents.columns)
