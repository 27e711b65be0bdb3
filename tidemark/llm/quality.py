"""Quality rules: text statistics and a learned decision list, all in Spark expressions.

Sequential covering: each rule is a conjunction of thresholds grown by information
gain on two thirds of the labelled documents and pruned on the rest; the documents
it covers leave, and the next rule is grown. The list becomes one CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
WIDTH = 5
RATIOS = ("words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "shout_share")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RATIOS)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def kept_length(text: Column, without: str) -> Column:
    return F.length(F.translate(text, without, ""))


def repeated(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; windows are hashes by position."""

    def covered(pairs: Column) -> Column:
        same = F.transform(pairs, lambda p, k: F.when((p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]), p["i"]))
        return bound(F.sort_array(F.array_compact(same)), lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WIDTH), F.coalesce(F.get(at, k + 1) - x, F.lit(WIDTH)))), F.lit(0), lambda a, b: a + b))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(bound(pairs, covered))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the RATIOS (double).

    A null text counts as empty; all counts of an empty text are 0 and all ratios 0.
    Columns of the same names are replaced. Work per document is n log n of its words at
    most, whatever its length. Equal windows of five words are told by 64-bit hashes."""
    w, ls, h, chars, n_lines, upper, digits, shout = (unused(x, docs.columns) for x in ("w", "ls", "h", "chars", "n_lines", "upper", "digits", "shout"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: kept_length(x, BLANKS) > 0)
    windows = F.transform(
        F.slice(F.col(w), F.lit(1), F.greatest(F.size(w) - (WIDTH - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *(F.get(F.col(w), i + k) for k in range(1, WIDTH))),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = docs.withColumns({w: words, ls: lines, chars: F.length(text), "word_chars": kept_length(text, BLANKS).cast("long")})
    for name, without in (("n_symbols", SYMBOLS), (upper, UPPER), (digits, DIGITS), (shout, "!")):
        out = out.withColumn(name, (F.col(chars) - kept_length(text, without)).cast("long"))
    out = out.withColumns({"n_words": F.size(w).cast("long"), n_lines: F.size(ls), "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"), h: windows}).drop(ls, w)
    out = out.withColumn("n_repeat_words", repeated(F.col(h)).cast("long")).drop(h)
    c = F.col
    out = out.withColumns({
        "words": c("n_words").cast("double"), "word_length": share(c("word_chars"), c("n_words")), "symbol_share": share(c("n_symbols"), c("word_chars")),
        "dup_line_share": share(c("n_dup_lines"), c(n_lines)), "repeat_share": share(c("n_repeat_words"), c("n_words")),
        "upper_share": share(c(upper), c("word_chars")), "digit_share": share(c(digits), c("word_chars")), "shout_share": share(c(shout), c("word_chars")),
    })
    # One row in, one out; it keeps Spark from repeating the statistics inside a later filter on them.
    return out.select(*(c(x) for x in docs.columns if x not in STATISTICS), F.inline(F.array(F.struct(*STATISTICS))))


@dataclass(frozen=True)
class Test:
    """feature <= value, or feature > value."""

    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.value) if self.above else F.col(self.feature) <= F.lit(self.value)

    def holds(self, bins: tuple, cuts: dict) -> bool:
        return (bins[RATIOS.index(self.feature)] > cuts[self.feature].index(self.value)) == self.above


def grow(rows: list, cuts: dict, most: int) -> list[Test]:
    """Adds the test of the highest information gain until no good document is covered."""
    rule: list[Test] = []
    while len(rule) < most:
        bad, good = sum(r[1] for r in rows), sum(r[2] for r in rows)
        if not bad or not good:
            break
        start, best = log2(bad / (bad + good)), (0.0, None)
        for f, feature in enumerate(RATIOS):
            counts = [[0, 0] for _ in range(len(cuts[feature]) + 1)]
            for bins, b, g in rows:
                counts[bins[f]][0] += b
                counts[bins[f]][1] += g
            b = g = 0
            for k, value in enumerate(cuts[feature]):
                b, g = b + counts[k][0], g + counts[k][1]
                for above, p, n in ((False, b, g), (True, bad - b, good - g)):
                    gain = p * (log2(p / (p + n)) - start) if p else 0
                    if gain > best[0] + 1e-9:
                        best = (gain, Test(feature, above, value))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if best[1].holds(r[0], cuts)]
    return rule


def covered(rule: list[Test], rows: list, cuts: dict) -> tuple[int, int]:
    held = [r for r in rows if all(t.holds(r[0], cuts) for t in rule)]
    return sum(r[1] for r in held), sum(r[2] for r in held)


def cell(feature: str, edges: list[float]) -> Column:
    """How many of the cut values lie below the feature."""
    return F.size(F.filter(F.array(*(F.lit(v) for v in edges)).cast("array<double>"), lambda v: v < F.col(feature))).alias(feature)


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = 20_000, cuts: int = 32, rules: int = 8, tests: int = 3, precision: float = 0.97) -> list[list[Test]]:
    """An ordered list of rules for documents labelled 0 (bad).

    Fitted on at most about `sample` labelled documents, chosen by a hash of the id; the
    driver sees counts by cell of the threshold grid only. A rule must reach `precision`
    on the labelled documents it covers, so that clean ones stay. No usable labels: no rule."""
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label in (0, 1)")
    labels = labels.groupBy("id").agg(F.min("label").alias("label"))  # of two labels the bad one counts
    n = labels.count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20))
    labels = labels.where(draw < int(min(1.0, sample / n) * (1 << 20)))
    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(labels, "id")
    part = statistics(part).select("id", "label", *RATIOS).persist()
    try:
        grid = part.agg(*(F.percentile_approx(f, [(k + 0.5) / cuts for k in range(cuts)], 1000).alias(f) for f in RATIOS)).first()
        edges = {f: (lambda v: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)])(sorted(set(grid[f] or []))) for f in RATIOS}
        cells = [cell(f, edges[f]) for f in RATIOS]
        fold = (F.pmod(F.xxhash64("id", F.lit(29)), F.lit(3)) == 0).alias("fold")
        counts = part.groupBy(fold, *cells).agg(F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good")).collect()
    finally:
        part.unpersist()
    rows = {fold: [(tuple(r[f] for f in RATIOS), r["bad"], r["good"]) for r in counts if r["fold"] == fold] for fold in (False, True)}

    def worth(rule: list[Test], part: list) -> float:
        bad, good = covered(rule, part, edges)
        return (bad - good) / (bad + good) if bad + good else -1.0

    def pure(rule: list[Test], parts: dict) -> bool:
        bad, good = (sum(x) for x in zip(*(covered(rule, part, edges) for part in parts.values()), strict=True))
        return bad >= precision * (bad + good)

    found: list[list[Test]] = []
    while len(found) < rules:
        rule = grow(rows[False], edges, tests)
        while len(rule) > 1 and worth(rule[:-1], rows[True]) >= worth(rule, rows[True]) and pure(rule[:-1], rows):
            rule = rule[:-1]
        if not pure(rule, rows):  # what holds on two thirds does not on all: grown again on all
            rule = grow([r for part in rows.values() for r in part], edges, tests)
        total = sum(r[1] for part in rows.values() for r in part)
        if not rule or not pure(rule, rows) or sum(covered(rule, part, edges)[0] for part in rows.values()) < max(3, 0.005 * total):
            break
        found.append(rule)
        rows = {k: [r for r in v if not all(t.holds(r[0], edges) for t in rule)] for k, v in rows.items()}
    return found


def verdict(found: list[list[Test]]) -> Column:
    """The number of the first rule that rejects a document, or null."""
    case = None
    for k, rule in enumerate(found):
        condition = rule[0].column()
        for t in rule[1:]:
            condition = condition & t.column()
        case = F.when(condition, k + 1) if case is None else case.when(condition, k + 1)
    return F.lit(None).cast("int") if case is None else case.cast("int")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Adds the statistics, base_failed, rule (number of the learned rule that rejects, or null) and kept.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows.
    Every input row gives one row; nulls in any column (a null label is no label, a null id
    has none), repeated rows and an empty table are allowed. Of two labels of one id the bad
    one counts. Columns rule, base_failed, kept and the statistics are replaced, others kept
    whatever their names."""
    found = learn(docs, labels, id_col, text_col, label_col)
    out = statistics(docs, text_col).withColumn("rule", verdict(found))
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
